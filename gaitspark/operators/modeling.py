"""Participant-grouped evaluation of baseline models: folds, fold-local preprocessing, metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ratio, target_column
from ..session import Scratch, materialize
from . import linear
from .fusion import cohort, numeric_columns
from .ranks import average_ranks

#: A group is dealt by itself if it has more than 1 / (SHARES * folds) of the rows of a class; the others share packets.
SHARES = 100


#: Rows of a piece of the table that models are fitted on, at most.
PIECE = 100_000
#: Values of one column that are collected and sorted, when a search for its median has come down to so few.
FEW = 4096
#: Of an approximate percentile: its error is at most one part in so many.
ACCURACY = 1000


def medians(df: DataFrame, columns: Sequence[str], without: Column | None = None, groups: Sequence = (None,)) -> dict | list[dict]:
    """Exact medians of the known values; 0 for a column without any. With groups, a list of them: for each group g the
    medians of the rows whose value of `without` isn't g.

    All columns and groups are searched at once. A round takes two values of each column that lie on either side of the
    median, from a sketch, and counts the values below, at and between them: either one of the two is the median, or the
    search goes on between them, among some thousandths of the values. No task holds a column.
    """
    wanted = [(g, i) for g in groups for i in range(len(columns))]
    known = lambda g, i: F.when(F.isnan(F.col(columns[i]).cast("double")) | (without.eqNullSafe(F.lit(g)) if without is not None else F.lit(False)), None).otherwise(F.col(columns[i]).cast("double"))
    counts = df.agg(*[F.count(known(*w)).alias(f"n{k}") for k, w in enumerate(wanted)]).first()
    #: (place in wanted, rank from 0) -> the open range that holds the rank, and how many values are at or below its start
    open_ = {(k, r): (None, None, 0, counts[k]) for k in range(len(wanted)) if counts[k] for r in {(counts[k] - 1) // 2, counts[k] // 2}}
    found: dict[tuple[int, int], float] = {}

    def inside(k: int, lo: float | None, hi: float | None) -> Column:
        x = known(*wanted[k])
        test = F.lit(True) if lo is None else x > lo
        return F.when(test if hi is None else test & (x < hi), x)

    while open_:
        asked = list(open_.items())
        few = [(key, v) for key, v in asked if v[3] <= FEW]
        if few:
            row = df.agg(*[F.array_sort(F.collect_list(inside(key[0], lo, hi))).alias(f"v{j}") for j, (key, (lo, hi, _, _)) in enumerate(few)]).first()
            for j, (key, v) in enumerate(few):
                found[key] = row[j][key[1] - v[2]]
                del open_[key]
            continue
        sketch = []
        for j, ((k, r), (lo, hi, before, n)) in enumerate(asked):
            at, slack = (r - before) / n, 2 / ACCURACY
            sketch.append(F.percentile_approx(inside(k, lo, hi), [max(0.0, at - slack), min(1.0, at + slack)], ACCURACY).alias(f"p{j}"))
        pivots = [tuple(p) for p in df.agg(*sketch).first()]
        tests = []
        for j, (((k, _), (lo, hi, _, _)), (a, b)) in enumerate(zip(asked, pivots)):
            x = inside(k, lo, hi)
            tests += [F.count_if(t).alias(f"c{j}_{i}") for i, t in enumerate((x < a, x == a, (x > a) & (x < b), (x == b) & (x != a)))]
        row = df.agg(*tests).first()
        for j, ((key, (lo, hi, before, n)), (a, b)) in enumerate(zip(asked, pivots)):
            below, at_a, between, at_b = row[4 * j : 4 * j + 4]
            ends = (before + below, before + below + at_a, before + below + at_a + between, before + below + at_a + between + at_b)
            if key[1] < ends[0]:
                open_[key] = (lo, a, before, below)
            elif key[1] >= ends[3]:
                open_[key] = (b, hi, ends[3], n - (ends[3] - before))
            elif ends[1] <= key[1] < ends[2]:
                open_[key] = (a, b, ends[1], between)
            else:
                found[key] = a if key[1] < ends[1] else b
                del open_[key]
    middle = lambda k: (found[k, (counts[k] - 1) // 2] + found[k, counts[k] // 2]) / 2 if counts[k] else 0.0
    out = [{c: middle(j * len(columns) + i) for i, c in enumerate(columns)} for j in range(len(groups))]
    return out[0] if without is None else out


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})


def scales(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation; a constant column is divided by 1."""
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, values: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in values.items()})


def group_folds(df: DataFrame, group: str, folds: int, label: str | None = None, seed: int | None = None) -> DataFrame:
    """(group, fold): whole groups in folds 0 to folds - 1, the largest to the lightest fold; with a label of few classes,
    each fold's share of every class is kept even. Groups of one size are dealt by name, or shuffled by a seed.

    What is dealt are groups with more than 1 / (SHARES * folds) of the rows of some class, and packets of all smaller
    groups by hash: at most SHARES * folds * (classes + 1) items reach the driver, however many groups there are.
    """
    kind = F.col(label) if label else F.lit(0)
    parts = SHARES * folds
    with Scratch(df.sparkSession) as keep:
        sizes = keep(df.groupBy(F.col(group).alias("who"), kind.alias("kind")).agg(F.count("*").alias("n")), "group-sizes")
        classes = keep(sizes.groupBy("kind").agg(F.sum("n").alias("all")), "classes").withColumnRenamed("kind", "class")
        heavy = sizes.join(classes, F.col("kind").eqNullSafe(F.col("class"))).groupBy("who").agg(F.max(F.col("n") * parts > F.col("all")).alias("heavy"))
        item = F.when(F.col("heavy"), F.concat(F.lit("group "), F.coalesce(F.col("who").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("packet "), F.pmod(F.xxhash64("who") if seed is None else F.xxhash64("who", F.lit(seed)), F.lit(parts)).cast("string")))
        items = keep(heavy.select("who", item.alias("item")), "group-items")
        same = sizes["who"].eqNullSafe(items["who"])
        dealt = deal(sizes.join(items, same).groupBy("item", "kind").agg(F.sum("n").alias("n")).collect(), folds, seed)
        places = df.sparkSession.createDataFrame(dealt, "item string, fold int")
        return materialize(items.join(F.broadcast(places), "item").select(F.col("who").alias(group), "fold"), "group-folds")


def deal(counts: Sequence, folds: int, seed: int | None = None) -> list[tuple[str, int]]:
    """Items (item, kind, n) to folds: the largest first, each to the fold whose fullest class stays the least full."""
    own: dict[str, dict] = {}
    total: dict = {}
    for r in counts:
        own.setdefault(r["item"], {})[r["kind"]] = r["n"]
        total[r["kind"]] = total.get(r["kind"], 0) + r["n"]
    place = (lambda g: g) if seed is None else (lambda g: (hashlib.sha256(f"{seed}:{g}".encode()).hexdigest(), g))
    load = [dict.fromkeys(total, 0) for _ in range(folds)]
    out = []
    for name in sorted(own, key=lambda g: (-max(own[g].values()), -sum(own[g].values()), place(g))):
        at = min(range(folds), key=lambda k: (max((load[k][c] + own[name].get(c, 0)) / total[c] for c in total), sum(load[k].values()), k))
        out.append((name, at))
        for c, n in own[name].items():
            load[at][c] += n
    return out


def split_audit(folded: DataFrame, group: str, folds: int) -> DataFrame:
    """(fold, train_group_count, test_group_count, group_overlap_count): a group in two folds would be on both sides."""
    spread = folded.groupBy(group).agg(F.collect_set("fold").alias("folds"))
    each = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    sides = spread.select("folds", each).select("fold", F.array_contains("folds", F.col("fold")).alias("test"), (F.size("folds") > F.array_contains("folds", F.col("fold")).cast("int")).alias("train"))
    return sides.groupBy("fold").agg(F.count_if("train").alias("train_group_count"), F.count_if("test").alias("test_group_count"), F.count_if(F.col("train") & F.col("test")).alias("group_overlap_count"))


def beside(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of a with the row of b for their group; without groups, b is one row."""
    return a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))


def regression_metrics(df: DataFrame, by: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """MAE, RMSE, R2 and Spearman's correlation; the last two are NULL for a single row or where nothing varies.

    Ranks are those of distinct values, and rows with the same two values are one, so a value of many rows costs nothing;
    a group, or all rows without groups, is ranked by many tasks."""
    t, p = F.col(true), F.col(pred)
    sums = df.groupBy(*by).agg(
        F.avg(F.abs(t - p)).alias("mae"), F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"), F.sum((t - p) * (t - p)).alias("_sse"), F.var_pop(t).alias("_var"), F.count("*").alias("_n"),
    )
    both = materialize(df.groupBy(*by, t.alias("_t"), p.alias("_p")).agg(F.count("*").alias("_k")), "value-pairs")
    ranked = both
    for x in ("_t", "_p"):
        ranks = average_ranks(both, x, by, F.col("_k"), name=f"_r{x}").select(*by, x, f"_r{x}")
        ranked = ranked.join(ranks.hint("merge"), [*by, x])
    centred = beside(ranked, sums.select(*by, ((F.col("_n") + 1) / 2).alias("_middle")), by)
    a, b, k = F.col("_r_t") - F.col("_middle"), F.col("_r_p") - F.col("_middle"), F.col("_k")
    products = centred.groupBy(*by).agg(F.sum(k * a * b).alias("_cov"), F.sqrt(F.sum(k * a * a)).alias("_st"), F.sqrt(F.sum(k * b * b)).alias("_sp"))
    several = F.col("_n") > 1
    joined = sums.join(products, list(by), "left") if by else beside(sums, products, by)
    return joined.select(*by, "mae", "rmse", F.when(several, 1 - ratio(F.col("_sse"), F.col("_var") * F.col("_n"))).alias("r2"), F.when(several, ratio(F.col("_cov"), F.col("_st") * F.col("_sp"))).alias("spearman"))


def classification_metrics(df: DataFrame, by: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred", score: str = "y_score") -> DataFrame:
    """Of 0/1 columns: balanced accuracy (over the classes there are), ROC AUC as a rank statistic (NULL for one class),
    precision, recall, F1, sensitivity, specificity; an undefined ratio is 0. Scores are ranked by distinct values."""
    t, p = F.col(true) == 1, F.col(pred) == 1
    counts = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    ranks = average_ranks(df, score, by, extra=[F.count_if(t).alias("_hits")], name="_rank")
    rank_sums = ranks.groupBy(*by).agg(F.sum(F.when(F.col("_hits") > 0, F.col("_rank") * F.col("_hits"))).alias("_sum"))
    sums = counts.join(rank_sums, list(by), "left") if by else beside(counts, rank_sums, by)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    pos, neg = tp + fn, tn + fp
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    recalls = F.array_compact(F.array(ratio(tp, pos), ratio(tn, neg)))
    return sums.select(
        *by, (F.aggregate(recalls, F.lit(0.0), lambda a, x: a + x) / F.size(recalls)).alias("balanced_accuracy"),
        ratio(F.col("_sum") - pos * (pos + 1) / 2, pos * neg).alias("roc_auc"), zero(tp, tp + fp).alias("precision"), zero(tp, pos).alias("recall"),
        zero(2 * tp, 2 * tp + fp + fn).alias("f1"), zero(tp, pos).alias("sensitivity"), zero(tn, neg).alias("specificity"),
    )


def fold_summary(folds: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(by, metric, mean, sd, valid_folds) of each metric over the folds; NULLs are skipped."""
    long = folds.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(by), list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("valid_folds"))


@dataclass(frozen=True)
class Baseline:
    task_type: str = "regression"
    target: str = "clinical__target"
    group: str = "participant_id"
    folds: int = 5
    seed: int = 42
    models: tuple[str, ...] = ("ridge", "random_forest")
    cohort_modes: tuple[str, ...] = ("all_samples", "complete_modalities")
    positive: object = None
    trees: int = 200


def forest(folded: DataFrame, fold: int, columns: list[str], middle: dict[str, float], how: Baseline) -> DataFrame:
    """The rows of a fold with y_pred and y_score, by a forest of the other folds' rows."""
    names = [f"_x{i}" for i in range(len(columns))]
    assembler = VectorAssembler(inputCols=names, outputCol="_features")
    filled = [F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in columns]
    rows = assembler.transform(folded.withColumns({n: F.coalesce(x, F.lit(middle[c])) for n, c, x in zip(names, columns, filled)}))
    train = rows.where(F.col("fold") != fold)
    common = {"featuresCol": "_features", "labelCol": "_y", "numTrees": how.trees, "seed": how.seed}
    if how.task_type == "classification":
        counts = {r["_y"]: r["count"] for r in train.groupBy("_y").count().collect()}
        if len(counts) < 2:
            raise ValueError("training fold has one class only")
        n = sum(counts.values())
        weight = F.when(F.col("_y") == 1, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0]))
        done = RandomForestClassifier(**common, weightCol="_weight").fit(train.withColumn("_weight", weight))
        score = vector_to_array("probability")[1]
    else:
        done, score = RandomForestRegressor(**common).fit(train), F.lit(None).cast("double")
    out = done.transform(rows.where(F.col("fold") == fold))
    return out.withColumns({"y_pred": F.col("prediction"), "y_score": score}).select(*folded.columns, "y_pred", "y_score")


#: The models of each task.
MODELS = {"regression": ("ridge", "linear_regression", "random_forest"), "classification": ("logistic_regression", "random_forest")}


def all_folds(folded: DataFrame, folds: int, columns: list[str], middles: list[dict[str, float]], model: str, how: Baseline) -> DataFrame:
    """Every row with y_pred and y_score, by a model of the other folds' rows. Filling and scaling are fitted on those rows
    only. Linear models of all folds are fitted together; forests of the folds are grown side by side."""
    if model not in MODELS[how.task_type]:
        raise ValueError(f"unknown {how.task_type} model {model}")
    if model == "logistic_regression":
        return linear.predicted(folded, columns, linear.logistic(folded, columns, folds, middles), True)
    if model != "random_forest":
        return linear.predicted(folded, columns, linear.regression(folded, columns, folds, middles, 1.0 if model == "ridge" else 0.0), False)
    with ThreadPoolExecutor(min(folds, 4)) as pool:
        parts = list(pool.map(inheritable_thread_target(lambda k: forest(folded, k, columns, middles[k], how)), range(folds)))
    return reduce(DataFrame.unionByName, parts)


def evaluate(frame: DataFrame, feature_sets: dict[str, Sequence[str]], how: Baseline, keys: Sequence[str]) -> dict[str, object]:
    """Every feature set, cohort, model and fold: tables predictions, fold_metrics, summary, split_audit, skipped and the
    number of successful evaluations. A cohort or model that can't run is skipped with a reason; its audit stays."""
    spark = frame.sparkSession
    target = target_column(how.target)
    for c in (target, how.group):
        if c not in frame.columns:
            raise ValueError(f"column {c} is absent from the fused features")
    skipped, audits, predictions = [], [], []
    context_of = lambda name, parts, mode: {"task_type": how.task_type, "target_column": target, "feature_set": name, "modalities": "+".join(parts), "cohort": mode}
    for name, parts in feature_sets.items():
        raw = numeric_columns(frame, parts, target)
        columns = raw + [f"availability__{m}" for m in parts if f"availability__{m}" in frame.columns]
        for mode in how.cohort_modes:
            context = context_of(name, parts, mode)
            data = cohort(frame, parts, target, mode)
            reason, k = None, 0
            n = data.count()
            if not n:
                reason = "cohort is empty"
            elif not raw:
                reason = "no numeric feature columns"
            elif not any(data.agg(*[F.count(c) for c in raw]).first()):
                reason = "all selected features are missing"
            else:
                k, reason = fold_count(data, target, how)
            if reason:
                skipped.append({**context, "model": "all", "reason": reason})
                continue
            label = F.col(target).cast("double")
            if how.task_type == "classification":
                positive = how.positive if how.positive is not None else data.agg(F.max(target)).first()[0]
                label = (F.col(target) == positive).cast("double")
            with Scratch(spark) as keep:
                data = keep(data.withColumn("_y", label), "cohort")
                placed = group_folds(data, how.group, k, "_y" if how.task_type == "classification" else None, how.seed)
                # a piece a core at least: models take more time than their few columns' bytes would say
                pieces = max(spark.sparkContext.defaultParallelism, -(-n // PIECE))
                folded = keep(data.join(placed, how.group).repartition(pieces), "folded")
                audit = split_audit(folded, how.group, k).collect()
                if any(r["group_overlap_count"] for r in audit):
                    raise RuntimeError("a participant group is in two folds")
                audits += [{**context, **r.asDict()} for r in audit]
                middles = medians(folded, columns, F.col("fold"), range(k))
                for model in how.models:
                    try:
                        rows = all_folds(folded, k, columns, middles, model, how)
                    except ValueError as e:
                        skipped.append({**context, "model": model, "reason": str(e)})
                        continue
                    rows = rows.select(*keys, *[F.lit(v).alias(c) for c, v in context.items()], F.lit(model).alias("model"), "fold", F.col("_y").alias("y_true"), "y_pred", "y_score", F.lit(n).alias("n_samples"), F.lit(len(columns)).alias("n_features"))
                    predictions.append(materialize(rows, "predictions"))
    by = ["task_type", "target_column", "feature_set", "modalities", "cohort", "model"]
    texts = "task_type string, target_column string, feature_set string, modalities string, cohort string"
    ids = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)
    none = spark.createDataFrame([], f"{ids}, {texts}, model string, fold int, y_true double, y_pred double, y_score double, n_samples int, n_features int")
    made = reduce(DataFrame.unionByName, predictions, none)
    metrics = classification_metrics if how.task_type == "classification" else regression_metrics
    folds = materialize(metrics(made, [*by, "fold"]), "fold-metrics")
    return {
        "predictions": made,
        "fold_metrics": folds,
        "summary": fold_summary(folds, by, [c for c in folds.columns if c not in (*by, "fold")]),
        "split_audit": spark.createDataFrame(audits, f"{texts}, fold int, train_group_count long, test_group_count long, group_overlap_count long"),
        "skipped": spark.createDataFrame(skipped, f"{texts}, model string, reason string"),
        "successful": len(predictions),
    }


def fold_count(data: DataFrame, target: str, how: Baseline) -> tuple[int, str | None]:
    """The number of folds, or why there can't be two."""
    groups = data.agg(F.count_distinct(how.group)).first()[0]
    if how.task_type == "classification":
        per_class = [r[0] for r in data.groupBy(target).agg(F.count_distinct(how.group).alias("g")).select("g").limit(3).collect()]
        if len(per_class) != 2:
            return 0, "classification needs exactly two target classes"
        if how.positive is not None and data.where(F.col(target) == how.positive).isEmpty():
            return 0, "the positive label is not among the classes"
        k = min(how.folds, groups, *per_class)
        return k, None if k >= 2 else "classification needs two participant groups of each class"
    k = min(how.folds, groups)
    return k, None if k >= 2 else "regression needs two participant groups"
