"""Time series of many trials in one table: cleaning, clocks, gaps, grids and gradients.

keys are the trial's columns. Every operator is windows and aggregates keyed by them; order comes from `time` (or from an
ordinal of the input), never from the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.expressions import cv_percent, finite, ratio

Keys = Sequence[str]


def along(keys: Keys, *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def backwards(keys: Keys, time: str) -> WindowSpec:
    """Descending order: a running frame there costs one pass, where a frame to the end of the partition costs many."""
    return Window.partitionBy(*keys).orderBy(F.col(time).desc())


def dedupe_first(df: DataFrame, keys: Keys, time: str, ordinal: str | Column) -> DataFrame:
    """The first row in input order of those with the same time; rows without a time go."""
    rank = F.row_number().over(along([*keys, time], ordinal))
    return df.where(F.col(time).isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def timestamp_quality(df: DataFrame, keys: Keys, time: str, ordinal: str) -> DataFrame:
    """For each trial n_samples, n_duplicates and whether times ever fall in input order."""
    before = df.where(F.col(time).isNotNull()).withColumn("_before", F.lag(time).over(along(keys, ordinal)))
    return before.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        (F.count("*") - F.count_distinct(time)).alias("n_duplicates"),
        F.coalesce(F.max(F.col(time) < F.col("_before")), F.lit(False)).alias("nonmonotonic"),
    )


def missing_ratios(df: DataFrame, keys: Keys, columns: Sequence[str]) -> DataFrame:
    """missing_ratio: column -> share of NULLs."""
    shares = [F.avg(F.col(c).isNull().cast("double")) for c in columns]
    return df.groupBy(*keys).agg(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*shares)).alias("missing_ratio"))


def anomaly_ratios(df: DataFrame, keys: Keys, limits: dict[str, float]) -> DataFrame:
    """anomaly_ratio: column -> share of samples whose size is over the limit; NULLs count as within."""
    shares = [F.avg(F.coalesce(F.abs(finite(c)) > limit, F.lit(False)).cast("double")) for c, limit in limits.items()]
    return df.groupBy(*keys).agg(F.map_from_arrays(F.array(*map(F.lit, limits)), F.array(*shares)).alias("anomaly_ratio"))


def sampling(df: DataFrame, keys: Keys, time: str) -> DataFrame:
    """sampling_rate_hz (1 / the median of positive steps) and interval_cv_pct of each trial; NULL without steps."""
    step = F.col(time) - F.lag(time).over(along(keys, time))
    positive = df.withColumn("_dt", step).withColumn("_dt", F.when(F.col("_dt") > 0, F.col("_dt")))
    return positive.groupBy(*keys).agg(ratio(F.lit(1.0), F.median("_dt")).alias("sampling_rate_hz"), cv_percent(F.col("_dt")).alias("interval_cv_pct"))


def fill_gaps(df: DataFrame, keys: Keys, time: str, columns: Sequence[str]) -> DataFrame:
    """Missing values on a line between the known ones around them, by position in the trial; at the ends the nearest
    one. A column that is all missing stays so."""
    out = df.withColumn("_n", F.row_number().over(along(keys, time)))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(c).alias("v"))) for c in columns}
    for c in columns:
        out = out.withColumn(f"_p_{c}", F.last(known[c], ignorenulls=True).over(along(keys, time)))
    for c in columns:
        out = out.withColumn(f"_q_{c}", F.last(known[c], ignorenulls=True).over(backwards(keys, time)))
    filled = {}
    for c in columns:
        p, q = (lambda f, c=c: F.col(f"_p_{c}.{f}")), (lambda f, c=c: F.col(f"_q_{c}.{f}"))
        line = p("v") + (q("v") - p("v")) * (F.col("_n") - p("n")) / F.when(q("n") > p("n"), q("n") - p("n"))
        filled[c] = F.coalesce(F.col(c), line, p("v"), q("v"))
    return out.withColumns(filled).drop("_n", *[f"_{k}_{c}" for k in "pq" for c in columns])


def gradient(value: Column, time: Column, over: WindowSpec) -> Column:
    """Second-order differences on an uneven grid, first-order ones at the ends; NULL for a single sample."""
    y0, y2, t0, t2 = F.lag(value).over(over), F.lead(value).over(over), F.lag(time).over(over), F.lead(time).over(over)
    s, d = time - t0, t2 - time
    inner = ratio(s * s * y2 + (d * d - s * s) * value - d * d * y0, s * d * (s + d))
    return F.when(t0.isNotNull() & t2.isNotNull(), inner).when(t2.isNotNull(), ratio(y2 - value, d)).when(t0.isNotNull(), ratio(value - y0, s))


def on_grid(df: DataFrame, keys: Keys, time: str, rate_hz: float, needed: Sequence[str]) -> DataFrame:
    """A row for each grid point start + i / rate of a trial, with grid_index, grid_time, and for each needed column the
    structs p_<c> and q_<c> (t, v) of the last known sample at or before the point and the first one after it.

    Each sample makes the points up to the next one, so no range join is needed.
    """
    w, back = along(keys, time), backwards(keys, time)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("t"), F.col(c).alias("v"))) for c in needed}
    out = df.withColumns(
        {"_start": F.min(time).over(Window.partitionBy(*keys)), "_end": F.max(time).over(Window.partitionBy(*keys)), "_next": F.lead(time).over(w)}
        | {f"p_{c}": F.last(known[c], ignorenulls=True).over(w) for c in needed}
    ).withColumns({f"q_{c}": F.last(known[c], ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)) for c in needed})
    place = lambda t: F.ceil((t - F.col("_start")) * rate_hz - 1e-6)
    last = F.floor((F.col("_end") - F.col("_start") + 1e-9) * rate_hz)
    out = out.withColumn("_lo", place(F.col(time))).withColumn("_hi", F.least(F.coalesce(place(F.col("_next")) - 1, last), last))
    out = out.where("_hi >= _lo").withColumn("grid_index", F.explode(F.sequence("_lo", "_hi")))
    return out.withColumn("grid_time", F.col("_start") + F.col("grid_index") / rate_hz).select(*keys, "grid_index", "grid_time", *[f"{k}_{c}" for c in needed for k in "pq"])


def share(c: str) -> Column:
    """How far a grid point is between the samples around it."""
    p, q = F.col(f"p_{c}.t"), F.col(f"q_{c}.t")
    return ratio(F.col("grid_time") - p, q - p)


def resample_linear(df: DataFrame, keys: Keys, time: str, columns: Sequence[str], rate_hz: float) -> DataFrame:
    """An even grid of rate_hz over each trial; values lie on lines between known samples, beyond them on the nearest."""
    grid = on_grid(df, keys, time, rate_hz, columns)
    lines = [F.coalesce(F.col(f"p_{c}.v") + (F.col(f"q_{c}.v") - F.col(f"p_{c}.v")) * share(c), F.col(f"p_{c}.v"), F.col(f"q_{c}.v")).alias(c) for c in columns]
    return grid.select(*keys, "grid_index", F.col("grid_time").alias(time), *lines)


def normalized(parts: Sequence[Column]) -> list[Column]:
    """A quaternion of length one; NULL for one of no length or with a missing part."""
    size = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    return [ratio(p, size) for p in parts]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def continuous_sign(df: DataFrame, keys: Keys, time: str, parts: Sequence[str]) -> DataFrame:
    """Quaternions flipped so that none turns away from the one before. A right angle ends a run of signs: the next one
    starts at +1, for only a negative product flips."""
    own = [F.col(c) for c in parts]
    w = along(keys, time)
    out = df.withColumn("_dot", dot(own, [F.lag(c).over(w) for c in parts])).withColumn("_run", F.sum((F.col("_dot") == 0).cast("int")).over(w))
    flips = F.sum((F.coalesce(F.col("_dot"), F.lit(1.0)) < 0).cast("int")).over(along([*keys, "_run"], time))
    out = out.withColumn("_sign", F.when(F.pmod(flips, F.lit(2)) == 1, -1.0).otherwise(1.0))
    return out.withColumns({c: F.col(c) * F.col("_sign") for c in parts}).drop("_dot", "_run", "_sign")


def resample_slerp(df: DataFrame, keys: Keys, time: str, parts: Sequence[str], rate_hz: float) -> DataFrame:
    """Quaternions on an even grid, on great circles between the valid ones; beyond them the nearest. Both the samples
    and the result have continuous signs; a trial without a valid quaternion gets NULLs."""
    unit = df.withColumns(dict(zip(parts, normalized([F.col(c) for c in parts]))))
    bounds = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    valid = continuous_sign(unit.where(F.col(parts[0]).isNotNull()), keys, time, parts).select(*keys, time, F.array(*parts).alias("quat"))
    # the grid spans the whole trial, not only its valid samples
    ends = bounds.select(*keys, F.explode(F.array_distinct(F.array("_a", "_b"))).alias(time))
    samples = ends.join(valid, [*keys, time], "full")
    grid = on_grid(samples, keys, time, rate_hz, ["quat"])
    p, q, u = F.col("p_quat.v"), F.col("q_quat.v"), share("quat")
    at = [(p[i], q[i]) for i in range(4)]
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot([x for x, _ in at], [y for _, y in at])))
    angle = F.acos(cosine)
    near = F.sin(angle) < 1e-9
    a = F.when(near, 1 - u).otherwise(ratio(F.sin((1 - u) * angle), F.sin(angle)))
    b = F.when(near, u).otherwise(ratio(F.sin(u * angle), F.sin(angle)))
    mixed = [F.coalesce(x * a + y * b, x, y).alias(c) for c, (x, y) in zip(parts, at)]
    return continuous_sign(grid.select(*keys, "grid_index", F.col("grid_time").alias(time), *mixed), keys, time, parts)
