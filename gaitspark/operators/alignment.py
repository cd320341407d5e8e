"""Timelines of modalities and their alignment with the reference clock by declared offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from .series import Keys, along


def timelines(rows: DataFrame, keys: Keys, time: str, ordinal: str) -> DataFrame:
    """(keys, start_time, end_time, error) of a modality's native times in input order. Equal times may follow each
    other; fewer than two, a missing, a falling time or no duration is an error."""
    step = F.col(time) - F.lag(time).over(along(keys, ordinal))
    out = rows.withColumn("_step", step).groupBy(*keys).agg(
        F.min_by(time, ordinal).alias("start_time"),
        F.max_by(time, ordinal).alias("end_time"),
        F.count("*").alias("_n"),
        F.count(time).alias("_known"),
        F.count_if(F.col("_step") < 0).alias("_falling"),
    )
    error = (
        F.when(F.col("_known") < F.col("_n"), "timestamps contain invalid values")
        .when(F.col("_n") < 2, "at least two timestamps are required")
        .when(F.col("_falling") > 0, "timestamps decrease")
        .when(F.col("end_time") <= F.col("start_time"), "duration is zero")
    )
    return out.select(*keys, "start_time", "end_time", error.alias("error"))


def align(
    pairs: DataFrame,
    offset: Column,
    uncertainty: Column,
    minimum_overlap_ratio: float,
    maximum_duration_difference: float,
    reference: tuple[str, str] = ("ref_start", "ref_end"),
    target: tuple[str, str] = ("target_start", "target_end"),
) -> DataFrame:
    """Adds offset_seconds, overlap, overlap_ratio (of the shorter duration), duration_difference_s, qc_status and qc_notes.

    No overlap fails, and then the duration isn't judged; a low ratio, a long difference or an unknown uncertainty warns,
    but never lifts a failure.
    """
    r0, r1, t0, t1 = (F.col(c) for c in (*reference, *target))
    out = pairs.withColumns({"offset_seconds": offset, "uncertainty_seconds": uncertainty})
    shift = F.col("offset_seconds")
    out = out.withColumn("overlap_s", F.greatest(F.lit(0.0), F.least(r1, t1 + shift) - F.greatest(r0, t0 + shift)))
    shorter = F.least(r1 - r0, t1 - t0)
    out = out.withColumn("overlap_ratio", F.coalesce(F.when(shorter > 0, ratio(F.col("overlap_s"), shorter)), F.lit(0.0)))
    out = out.withColumn("duration_difference_s", F.abs((t1 - t0) - (r1 - r0)))
    lost, low = F.col("overlap_s") <= 0, F.col("overlap_ratio") < minimum_overlap_ratio
    far, unknown = F.col("duration_difference_s") > maximum_duration_difference, F.col("uncertainty_seconds").isNull()
    notes = F.array_compact(F.array(
        F.when(lost, "no overlap with the reference"),
        F.when(~lost & low, "overlap ratio below the minimum"),
        F.when(~lost & far, "duration difference above the maximum"),
        F.when(unknown, "uncertainty not provided"),
    ))
    return out.withColumns({"qc_status": F.when(lost, "fail").when(low | far | unknown, "warning").otherwise("pass"), "qc_notes": notes})
