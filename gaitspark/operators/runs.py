"""Runs of equal labels and what is made of them: debouncing, voice activity, contact events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import dbfs, from_dbfs
from .series import Keys, along


def with_runs(df: DataFrame, keys: Keys, order: str, label: str, name: str = "run") -> DataFrame:
    """Adds the run's number in its trial, from 1: a run is a longest stretch of one label."""
    w = along(keys, order)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_new")


def runs(df: DataFrame, keys: Keys, order: str, label: str) -> DataFrame:
    """(keys, run, label, first, last, n): gaps and islands."""
    return with_runs(df, keys, order, label).groupBy(*keys, "run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def relabel(df: DataFrame, keys: Keys, order: str, label: str, change) -> DataFrame:
    """One pass over the runs as they are at its beginning: change(label, n, inner) gives each run's new label."""
    each = Window.partitionBy(*keys, "_run")
    out = with_runs(df, keys, order, label, "_run").withColumns({"_size": F.count("*").over(each), "_runs": F.max("_run").over(Window.partitionBy(*keys))})
    inner = (F.col("_run") > 1) & (F.col("_run") < F.col("_runs"))
    return out.withColumn(label, change(F.col(label), F.col("_size"), inner)).drop("_run", "_size", "_runs")


def debounce(df: DataFrame, keys: Keys, order: str, label: str, rate_hz: Column, min_on: float, min_off: float, passes: int = 2) -> DataFrame:
    """Short contacts go; short gaps between contacts close. Both happen at once in each pass."""

    def change(state: Column, n: Column, inner: Column) -> Column:
        duration = n / rate_hz
        return F.when((state == 1) & (duration < min_on), 0).when((state == 0) & inner & (duration < min_off), 1).otherwise(state)

    for _ in range(passes):
        df = relabel(df, keys, order, label, change)
    return df


def stabilize_speech(df: DataFrame, keys: Keys, order: str, label: str, frame_seconds: Column | float, min_speech: float, min_pause: float) -> DataFrame:
    """Short speech goes first; then short pauses inside close."""
    length = frame_seconds if isinstance(frame_seconds, Column) else F.lit(float(frame_seconds))
    df = relabel(df, keys, order, label, lambda state, n, inner: F.when((state == 1) & (n * length < min_speech), 0).otherwise(state))
    return relabel(df, keys, order, label, lambda state, n, inner: F.when((state == 0) & inner & (n * length < min_pause), 1).otherwise(state))


def transitions(df: DataFrame, keys: Keys, time: str, state: str) -> DataFrame:
    """(keys, time, event): contact where the state rises or a trial starts in it, toe_off where it falls."""
    before = F.coalesce(F.lag(state).over(along(keys, time)), F.lit(0))
    event = F.when((F.col(state) == 1) & (before == 0), "contact").when((F.col(state) == 0) & (before == 1), "toe_off")
    return df.withColumn("event", event).where("event is not null").select(*keys, time, "event")


def speech_frames(audio: DataFrame, keys: Keys, frame_ms: float, threshold_dbfs: float, samples: str = "samples", rate: str = "sampling_rate", first: str = "first_sample", total: str = "n_samples") -> DataFrame:
    """(keys, frame, start_time, end_time, rms, dbfs, is_speech) of waveforms in blocks: frames of frame_ms, the last one
    padded with silence. A block's array is summed by frames, so that samples are never rows; a frame that lies in several
    blocks is the sum of its parts. A block begins with sample `first` of its recording's `total`."""
    size = F.greatest(F.lit(1), F.bround(F.lit(frame_ms / 1000) * F.col(rate)).cast("int"))
    sized = audio.where(F.size(samples) > 0).select(*keys, samples, F.col(rate).alias("_rate"), size.alias("_size"), F.col(total).alias("_total"), F.col(first).alias("_first"), (F.col(first) + F.size(samples)).alias("_end"))

    def part(f: Column) -> Column:
        lo, hi = F.greatest(f * F.col("_size"), F.col("_first")), F.least((f + 1) * F.col("_size"), F.col("_end"))
        return F.aggregate(F.slice(samples, (lo - F.col("_first") + 1).cast("int"), (hi - lo).cast("int")), F.lit(0.0), lambda a, x: a + x * x)

    frame = lambda at: F.call_function("div", at, F.col("_size"))
    found = F.transform(F.sequence(frame(F.col("_first")), frame(F.col("_end") - 1)), lambda f: F.struct(f.alias("frame"), part(f).alias("power")))
    parts = sized.select(*keys, "_rate", "_size", "_total", F.explode(found).alias("f")).select(*keys, "_rate", "_size", "_total", "f.*")
    frames = parts.groupBy(*keys, "frame").agg(F.first("_rate").alias("_rate"), F.first("_size").alias("_size"), F.first("_total").alias("_total"), F.sum("power").alias("power"))
    frames = frames.withColumns({"frame": F.col("frame").cast("int"), "rms": F.sqrt(F.col("power") / F.col("_size"))})
    length = F.col("_size") / F.col("_rate")
    return frames.select(
        *keys, "frame", (F.col("frame") * length).alias("start_time"), F.least((F.col("frame") + 1) * length, F.col("_total") / F.col("_rate")).alias("end_time"),
        length.alias("frame_seconds"), "rms", dbfs(F.col("rms")).alias("dbfs"), (F.col("rms") >= from_dbfs(threshold_dbfs)).cast("int").alias("is_speech"),
    )


def clipping(audio: DataFrame, keys: Keys, threshold: float, samples: str = "samples") -> DataFrame:
    """clipping_ratio: the share of samples, over all blocks, at or over the threshold in size."""
    loud = F.aggregate(samples, F.lit(0).cast("long"), lambda n, x: n + (F.abs(x) >= threshold).cast("long"))
    return audio.groupBy(*keys).agg((F.sum(loud) / F.when(F.sum(F.size(samples)) > 0, F.sum(F.size(samples)))).alias("clipping_ratio"))


def activity(frames: DataFrame, keys: Keys, columns: Sequence[str] = ("start_time", "end_time")) -> DataFrame:
    """(keys, activity, start_time, end_time, duration_s): frames' runs as half-open intervals."""
    start, end = columns
    out = with_runs(frames, keys, "frame", "is_speech").groupBy(*keys, "run", "is_speech").agg(F.min(start).alias("start_time"), F.max(end).alias("end_time"))
    return out.select(*keys, F.when(F.col("is_speech") == 1, "speech").otherwise("silence").alias("activity"), "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration_s"))
