"""Per-trial numeric kernels as Arrow grouped maps: a filter and peaks need a trial's samples in order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numerics
from ..session import ensure_importable, materialize
from .ranks import numbered
from .series import Keys


#: Samples of a trial that are filtered in one task; a longer trial is filtered in blocks of at least this many.
BLOCK = 1 << 16


def refusal(rate: Column, cutoff_hz: float) -> Column:
    """Why a trial of some sampling rate can't be filtered, or NULL."""
    return F.when(rate.isNull() | F.isnan(rate) | (F.abs(rate) == float("inf")), "error: sampling rate is unknown").when(F.lit(cutoff_hz) >= rate / 2, "error: cutoff is at or above half the sampling rate")


def lowpass(df: DataFrame, keys: Keys, time: str, columns: Sequence[str], rate_col: str, cutoff_hz: float, order: int, block: int = BLOCK) -> DataFrame:
    """Zero-phase Butterworth low-pass of the columns of each trial, at its own rate. Adds filter_note: why a trial was
    left as it is (too short), or an error (cutoff at or over half the rate). A column with a NULL stays as it is.

    A trial of more than `block` samples is filtered in blocks that are tasks of their own; the result is the same.
    """
    ensure_importable(df.sparkSession)
    df = df.drop("filter_note").withColumn("filter_note", refusal(F.col(rate_col), cutoff_hz))
    refused, rest = df.where("filter_note is not null"), df.where("filter_note is null")
    long = materialize(rest.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count(c).alias(f"k_{i}") for i, c in enumerate(columns)]).where(F.col("n") > block), "long-trials")
    if long.isEmpty():
        return refused.unionByName(in_one(rest, keys, time, columns, rate_col, cutoff_hz, order))
    ids = long.select(*keys)
    short = in_one(rest.join(ids, list(keys), "left_anti"), keys, time, columns, rate_col, cutoff_hz, order)
    whole = F.array_compact(F.array(*[F.when(F.col(f"k_{i}") == F.col("n"), F.lit(c)) for i, c in enumerate(columns)]))
    return refused.unionByName(short).unionByName(in_blocks(rest.join(long.select(*keys, "n", whole.alias("whole")), list(keys)), keys, time, columns, rate_col, cutoff_hz, order, block))


def in_one(df: DataFrame, keys: Keys, time: str, columns: Sequence[str], rate_col: str, cutoff_hz: float, order: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        own = [c for c in columns if pdf[c].notna().all()]
        if len(pdf) <= numerics.pad_length(order):
            pdf["filter_note"] = "too short to filter"
        elif own:
            pdf[own] = numerics.zero_phase(pdf[own].to_numpy(float), order, cutoff_hz, pdf[rate_col].iloc[0])
        return pdf

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def in_blocks(df: DataFrame, keys: Keys, time: str, columns: Sequence[str], rate_col: str, cutoff_hz: float, order: int, block: int) -> DataFrame:
    """df has each trial's n samples and the columns to filter in `whole`. Three passes over blocks of samples: the state
    in which each block ends if it starts empty; the forward run from the true states, with the backward run's empty
    ends; the backward run from its true states. Between them the states of a trial's blocks are joined by their linear
    maps, a few numbers a block. The reflections at a trial's ends are made in its first and last block."""
    pad, blocks = numerics.pad_length(order), ["_block"]
    names = [c for c in df.columns if c not in ("n", "whole")]
    placed = numbered(df, [*keys, time], "_at")
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    # the last block takes what is left over, so that every block is long enough for a reflection
    place = F.col("_at") - F.col("_first")
    placed = placed.join(first, list(keys)).withColumn("_block", F.least(F.expr(f"div(_at - _first, {block})"), F.expr(f"div(n, {block}) - 1"))).withColumn("_place", place).drop("_at", "_first")
    placed = materialize(placed, "placed")
    last = F.expr(f"_block = div(n, {block}) - 1")
    ids = [df.schema[k] for k in keys]
    state = T.StructType([*ids, T.StructField("_block", T.LongType()), T.StructField("size", T.LongType()), T.StructField("first", T.ArrayType(T.DoubleType())), T.StructField("end", T.ArrayType(T.DoubleType()))])
    started = T.StructType([*ids, T.StructField("_block", T.LongType()), T.StructField("start", T.ArrayType(T.DoubleType()))])

    def made(rate: float) -> numerics.System:
        return numerics.system(numerics.butterworth(order, cutoff_hz, rate))

    def values(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[list(pdf["whole"].iloc[0])].to_numpy(float)

    def padded(pdf: pd.DataFrame, x: np.ndarray) -> np.ndarray:
        x = np.concatenate([numerics.head_pad(x, pad), x]) if pdf["_block"].iloc[0] == 0 else x
        return np.concatenate([x, numerics.tail_pad(x, pad)]) if pdf["_last"].iloc[0] else x

    def row(pdf: pd.DataFrame, size: int, opening: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_block": [pdf["_block"].iloc[0]], "size": [size], "first": [opening.ravel()], "end": [end.ravel()]})

    def forward_end(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        how, x = made(pdf[rate_col].iloc[0]), padded(pdf, values(pdf))
        return row(pdf, len(x), np.outer(how.steady, x[0]), numerics.run(how, x, np.zeros((len(how.a), x.shape[1])))[1])

    def starts(ends: DataFrame, backward: bool) -> DataFrame:
        def scan(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_block", ascending=not backward)
            how = made(pdf[rate_col].iloc[0])
            shape = (len(how.a), -1)
            found = numerics.scanned(np.reshape(pdf["first"].iloc[0], shape), [np.reshape(e, shape) for e in pdf["end"]], pdf["size"].tolist(), how)
            return pdf[[*keys, "_block"]].assign(start=[s.ravel() for s in found])

        rated = ends.join(rates, list(keys))
        return materialize(rated.groupBy(*keys).applyInPandas(scan, started), "starts")

    rates = placed.groupBy(*keys).agg(F.first(rate_col).alias(rate_col))
    marked = placed.withColumn("_last", last)
    begun = starts(materialize(marked.groupBy(*keys, *blocks).applyInPandas(forward_end, state), "forward-ends"), False)
    # a block's first row carries what the next passes need of the block: the backward run's start and empty end, and the
    # reflection's forward run in the last one
    carried = T.StructType([*marked.schema.fields, *[f for f in state.fields if f.name in ("size", "first", "end")], T.StructField("tail", T.ArrayType(T.DoubleType()))])

    def forward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        how, x = made(pdf[rate_col].iloc[0]), padded(pdf, values(pdf))
        y, _ = numerics.run(how, x, np.reshape(pdf["start"].iloc[0], (len(how.a), -1)))
        y = y[pad:] if pdf["_block"].iloc[0] == 0 else y
        end = numerics.run(how, y[::-1], np.zeros((len(how.a), y.shape[1])))[1]
        blank = [None] * (len(pdf) - 1)
        out = pdf.drop(columns="start").assign(size=[len(y), *blank], first=[np.outer(how.steady, y[-1]).ravel(), *blank], end=[end.ravel(), *blank], tail=[y[len(pdf) :].ravel(), *blank])
        out[list(pdf["whole"].iloc[0])] = y[: len(pdf)]
        return out

    there = materialize(marked.join(begun, [*keys, *blocks]).groupBy(*keys, *blocks).applyInPandas(forward, carried), "forward")
    back = starts(there.where("size is not null").select(*keys, *blocks, "size", "first", "end"), True)

    def backward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        how, y = made(pdf[rate_col].iloc[0]), values(pdf)
        y = np.concatenate([y, np.reshape(pdf["tail"].iloc[0], (-1, y.shape[1]))])
        out, _ = numerics.run(how, y[::-1], np.reshape(pdf["start"].iloc[0], (len(how.a), -1)))
        pdf[list(pdf["whole"].iloc[0])] = out[::-1][: len(pdf)]
        return pdf[names]

    slim = there.drop("size", "first", "end", "_last", "n").join(back, [*keys, *blocks])
    return slim.groupBy(*keys, *blocks).applyInPandas(backward, df.select(*names).schema)


def step_events(df: DataFrame, keys: Keys, time: str, signal: str, min_interval: float, prominence: float) -> DataFrame:
    """(keys, time): peaks of the signal in each group of keys, at least min_interval seconds apart."""
    ensure_importable(df.sparkSession)
    slim = df.select(*keys, time, signal)
    schema = T.StructType([*[slim.schema[k] for k in keys], T.StructField(time, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        t = pdf[time].to_numpy(float)
        steps = np.diff(t)
        steps = steps[np.isfinite(steps) & (steps > 0)]
        at = numerics.step_peaks(t, pdf[signal].to_numpy(float), 1 / np.median(steps), min_interval, prominence) if len(steps) else np.empty(0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(at) for k in keys}, time: at})

    return slim.groupBy(*keys).applyInPandas(run, schema)
