"""Linear baselines of all folds at once: sums of products for each fold, and each training set as all folds less one.

What moves is one small matrix a fold from each task; rows are read once for ridge and linear regression, and once a step
for logistic regression, whatever the number of folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable

#: Newton's steps of a logistic regression end below this change of a coefficient, or after so many.
SMALLEST, MOST_STEPS = 1e-9, 100
#: A training column whose variance is below this part of its mean square is constant.
CONSTANT = 1e-12


@dataclass
class Model:
    """A model of each fold over columns that are filled (fill), centred (mean) and divided (sd): arrays of fold x column."""

    fill: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray

    def ready(self, x: np.ndarray, fold: int) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill[fold], x) - self.mean[fold]) / self.sd[fold]

    def line(self, x: np.ndarray, fold: int) -> np.ndarray:
        return self.ready(x, fold) @ self.weights[fold] + self.intercept[fold]


def summed(rows: DataFrame, columns: Sequence[str], folds: int, shape: tuple[int, ...], part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of part(x, y, fold), an array (folds, *shape) for some rows, from partial sums of tasks."""
    ensure_importable(rows.sparkSession)
    names = [*columns, "_y"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, *shape))
        for pdf in batches:
            total += part(pdf[names[:-1]].to_numpy(float), pdf["_y"].to_numpy(float), pdf["fold"].to_numpy(int))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "value": total.ravel()[at]})

    out = np.zeros(folds * int(np.prod(shape)))
    slim = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col("_y").cast("double").alias("_y"), F.col("fold").cast("int").alias("fold"))
    for r in slim.mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(folds, *shape)


def prepared(rows: DataFrame, columns: Sequence[str], folds: int, fill: Sequence[dict[str, float]]) -> tuple[Model, np.ndarray, np.ndarray]:
    """(a model without weights, sums of products, row counts) of each fold's training rows: products of the filled, centred
    and divided columns and the centred label. One pass: a missing value is a column of its own, so that what it is filled
    with, which differs between folds, is only put in when the sums are known."""
    p = len(columns)
    row = rows.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate([*columns, "_y"]) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    shift = np.array([row[f"m{i}"] or 0.0 for i in range(p + 1)])
    unit = np.array([row[f"s{i}"] or 1.0 for i in range(p + 1)])

    def part(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        gone = np.isnan(x)
        z = np.concatenate([np.ones((len(x), 1)), np.where(gone, 0.0, (x - shift[:p]) / unit[:p]), gone, ((y - shift[p]) / unit[p])[:, None]], axis=1)
        return np.stack([z[fold == k].T @ z[fold == k] for k in range(folds)])

    sums = summed(rows, columns, folds, (2 * p + 2, 2 * p + 2), part)
    values = np.array([[f[c] for c in columns] for f in fill])
    model = Model(values, np.zeros((folds, p)), np.ones((folds, p)), np.zeros((folds, p)), np.zeros(folds))
    products, counts = np.zeros((folds, p + 1, p + 1)), np.zeros(folds)
    for k in range(folds):
        train = sums.sum(axis=0) - sums[k]
        filled = np.zeros((p + 2, 2 * p + 2))
        filled[0, 0] = filled[p + 1, 2 * p + 1] = 1.0
        filled[1 : p + 1, 1 : p + 1] = np.eye(p)
        filled[1 : p + 1, p + 1 : 2 * p + 1] = np.diag((values[k] - shift[:p]) / unit[:p])
        s = filled @ train @ filled.T
        n = s[0, 0]
        mean = s[0, 1:] / n
        around = s[1:, 1:] - n * np.outer(mean, mean)
        variance = np.diag(around)[:p] / n
        sd = np.where(variance > CONSTANT * (np.diag(s)[1 : p + 1] / n + CONSTANT), np.sqrt(np.maximum(variance, 0.0)), 1.0)
        scale = np.append(sd, 1.0)
        products[k], counts[k] = around / np.outer(scale, scale), n
        model.mean[k], model.sd[k] = mean[:p] * unit[:p] + shift[:p], sd * unit[:p]
        model.intercept[k] = mean[p] * unit[p] + shift[p]
    products[:, :p, p] *= unit[p]
    return model, products, counts


def regression(rows: DataFrame, columns: Sequence[str], folds: int, fill: Sequence[dict[str, float]], penalty: float) -> Model:
    """Least squares with a penalty on the squared weights of the scaled columns; without one, the smallest solution."""
    model, products, _ = prepared(rows, columns, folds, fill)
    p = len(columns)
    for k in range(folds):
        inside = products[k, :p, :p]
        model.weights[k] = np.linalg.solve(inside + penalty * np.eye(p), products[k, :p, p]) if penalty else np.linalg.pinv(inside, rcond=1e-10, hermitian=True) @ products[k, :p, p]
    return model


def logistic(rows: DataFrame, columns: Sequence[str], folds: int, fill: Sequence[dict[str, float]]) -> Model:
    """Classes of equal weight, half the squared weights as a penalty, by Newton's method: each step is one pass for all
    folds; a step that doesn't lower the loss is halved."""
    model, _, counts = prepared(rows, columns, folds, fill)
    p = len(columns)
    hits = summed(rows, [], folds, (), lambda x, y, fold: np.bincount(fold, weights=y, minlength=folds).astype(float))
    hits = hits.sum() - hits
    if ((hits == 0) | (hits == counts)).any():
        raise ValueError("training fold has one class only")
    heavy = np.stack([counts / (2 * (counts - hits)), counts / (2 * hits)], axis=1)
    now, step, best = np.zeros((folds, p + 1)), np.zeros((folds, p + 1)), np.full(folds, np.inf)

    def part_at(beta: np.ndarray) -> Callable:
        def part(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
            out = np.zeros((folds, p + 1, p + 3))
            for k in range(folds):
                own, z = y[fold != k], np.concatenate([model.ready(x[fold != k], k), np.ones(((fold != k).sum(), 1))], axis=1)
                line = z @ beta[k]
                chance = np.exp(-np.logaddexp(0.0, -line))
                weight = np.where(own == 1, heavy[k, 1], heavy[k, 0])
                out[k, :, : p + 1] = z.T @ (z * (weight * chance * (1 - chance))[:, None])
                out[k, :, p + 1] = z.T @ (weight * (chance - own))
                out[k, 0, p + 2] = (weight * np.logaddexp(0.0, np.where(own == 1, -line, line))).sum()
            return out

        return part

    for _ in range(MOST_STEPS):
        sums = summed(rows, columns, folds, (p + 1, p + 3), part_at(now))
        moved = 0.0
        for k in range(folds):
            loss = sums[k, 0, p + 2] + now[k, :p] @ now[k, :p] / 2
            if loss > best[k] + 1e-9 * (1 + abs(best[k])):
                step[k] /= 2
                now[k] -= step[k]
            else:
                best[k] = loss
                held = np.append(np.ones(p), 0.0)
                step[k] = -np.linalg.solve(sums[k, :, : p + 1] + np.diag(held), sums[k, :, p + 1] + held * now[k])
                now[k] += step[k]
            moved = max(moved, np.abs(step[k]).max())
        if moved < SMALLEST:
            break
    model.weights, model.intercept = now[:, :p], now[:, p]
    return model


def predicted(rows: DataFrame, columns: Sequence[str], model: Model, classes: bool) -> DataFrame:
    """rows with y_pred and y_score, each by the model of its fold."""
    ensure_importable(rows.sparkSession)
    folds = len(model.intercept)

    @F.pandas_udf("double")
    def line(fold: pd.Series, *values: pd.Series) -> pd.Series:
        x, at = np.column_stack([v.to_numpy(float) for v in values]), fold.to_numpy(int)
        out = np.zeros(len(at))
        for k in range(folds):
            out[at == k] = model.line(x[at == k], k)
        return pd.Series(out)

    lined = rows.withColumn("_line", line(F.col("fold"), *[F.col(c).cast("double") for c in columns]))
    score = 1 / (1 + F.exp(-F.col("_line")))
    made = {"y_pred": (F.col("_line") > 0).cast("double"), "y_score": score} if classes else {"y_pred": F.col("_line"), "y_score": F.lit(None).cast("double")}
    return lined.withColumns(made).drop("_line")
