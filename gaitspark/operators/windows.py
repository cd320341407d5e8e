"""Trials' phases as windows: half-open slices and the scopes that features are taken over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import WALKING
from .series import Keys


def extents(samples: DataFrame, keys: Keys, time: str) -> DataFrame:
    """(keys, start_time, end_time): a trial's first and last sample."""
    return samples.groupBy(*keys).agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"))


def sliced(rows: DataFrame, windows: DataFrame, keys: Keys, time: str, how: str = "inner") -> DataFrame:
    """rows with the windows (keys, ..., start_time, end_time) that hold them: [start, end), with the end where the
    window has a column `closed` that is true. how="right" keeps windows without rows."""
    w = windows.select(*[F.col(c).alias(f"_w_{c}") for c in windows.columns])
    inside = (F.col(time) >= F.col("_w_start_time")) & (F.col(time) < F.col("_w_end_time"))
    if "closed" in windows.columns:
        inside |= F.col("_w_closed") & (F.col(time) == F.col("_w_end_time"))
    same = [F.col(k) == F.col(f"_w_{k}") for k in keys]
    condition = inside
    for s in same:
        condition = s & condition
    out = rows.join(w, condition, how)
    return out.select(*[F.col(f"_w_{c}").alias(c) for c in windows.columns], *[c for c in rows.columns if c not in windows.columns])


def walking(name: Column) -> Column:
    return name.isin(*WALKING)


def turning(name: Column) -> Column:
    return name.startswith("turn")


def phase_scopes(segments: DataFrame, keys: Keys) -> DataFrame:
    return segments.select(*keys, F.lit("phase").alias("feature_level"), "segment_name", "start_time", "end_time", F.lit(False).alias("closed"))


def full_scopes(bounds: DataFrame, keys: Keys, closed: bool = True, name: str = "full_trial") -> DataFrame:
    return bounds.select(*keys, F.lit("trial").alias("feature_level"), F.lit(name).alias("segment_name"), "start_time", "end_time", F.lit(closed).alias("closed"))


def parts_of_trials(segments: DataFrame, bounds: DataFrame, keys: Keys, chosen, closed: bool) -> DataFrame:
    """The windows that a trial's row sums over: the chosen phases, or the whole trial where it has none."""
    some = segments.where(chosen(F.col("segment_name"))).select(*keys, "segment_name", "start_time", "end_time", F.lit(False).alias("closed"))
    none = bounds.join(some.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit("full_trial").alias("segment_name"), "start_time", "end_time", F.lit(closed).alias("closed"))
    return some.unionByName(none)


def empty_windows(rows: DataFrame, segments: DataFrame, keys: Keys, time: str) -> DataFrame:
    """Segments that hold no row: those are errors of their trial."""
    held = sliced(rows.select(*keys, time), segments.select(*keys, "segment_name", "start_time", "end_time"), keys, time).select(*keys, "segment_name", "start_time").distinct()
    return segments.join(held, [*keys, "segment_name", "start_time"], "left_anti")


def clipped(intervals: DataFrame, windows: DataFrame, keys: Keys) -> DataFrame:
    """Intervals cut to the windows that they overlap: the window's columns, clip_start, clip_end."""
    i = intervals.select(*[F.col(k).alias(f"_i_{k}") for k in keys], F.col("start_time").alias("_s"), F.col("end_time").alias("_e"))
    condition = (F.col("_s") < F.col("end_time")) & (F.col("_e") > F.col("start_time"))
    for k in keys:
        condition = (F.col(f"_i_{k}") == F.col(k)) & condition
    out = windows.join(i, condition)
    out = out.select(*windows.columns, F.greatest("_s", "start_time").alias("clip_start"), F.least("_e", "end_time").alias("clip_end"))
    return out.where("clip_end > clip_start")


def with_all(features: DataFrame, scopes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every scope's row, with its features where it has any."""
    return scopes.select(*on).distinct().join(features, list(on), "left")
