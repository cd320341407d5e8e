"""Contact events: stance and swing, step times, and one-to-one agreement of two event series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from ..session import Scratch, materialize
from .series import Keys, along
from .windows import sliced

SCOPE = ["feature_level", "segment_name"]


def measured(events: DataFrame, windows: DataFrame, keys: Keys) -> DataFrame:
    """Events inside windows (keys, feature_level, segment_name, part, start_time, end_time) with the stance, swing and
    step time that ends at each: only events of the same window are paired."""
    inside = sliced(events, windows, keys, "timestamp")
    window = [*keys, *SCOPE, "part"]
    side = along([*window, "side"], "timestamp")
    gap, before = F.col("timestamp") - F.lag("timestamp").over(side), F.lag("event").over(side)
    out = inside.withColumns({
        "stance": F.when((F.col("event") == "toe_off") & (before == "contact"), gap),
        "swing": F.when((F.col("event") == "contact") & (before == "toe_off"), gap),
    })
    contacts = along([*window, "event"], "timestamp", "side")
    return out.withColumn("step", F.when(F.col("event") == "contact", F.col("timestamp") - F.lag("timestamp").over(contacts)))


def contact_timing(measured_events: DataFrame, keys: Keys, prefix: str = "footswitch__") -> DataFrame:
    """The timing features of each scope, over all of its windows."""
    left, right = F.col("side") == "left", F.col("side") == "right"
    contact = F.col("event") == "contact"
    out = measured_events.groupBy(*keys, *SCOPE).agg(
        F.count_if(contact & left).alias("left_contact_count"),
        F.count_if(contact & right).alias("right_contact_count"),
        F.count_if(contact).alias("step_count"),
        F.avg(F.when(left, F.col("stance"))).alias("mean_left_stance_time_s"),
        F.avg(F.when(right, F.col("stance"))).alias("mean_right_stance_time_s"),
        F.avg(F.when(left, F.col("swing"))).alias("mean_left_swing_time_s"),
        F.avg(F.when(right, F.col("swing"))).alias("mean_right_swing_time_s"),
        F.avg("step").alias("mean_step_time_s"),
        F.stddev_samp("step").alias("step_time_sd_s"),
    )
    l, r = F.col("mean_left_stance_time_s"), F.col("mean_right_stance_time_s")  # noqa: E741
    middle = (l + r) / 2
    out = out.withColumn("stance_time_asymmetry_pct", F.when(middle > 0, ratio(F.abs(l - r), middle) * 100))
    out = out.withColumn("step_time_cv_pct", F.when(F.col("mean_step_time_s") > 0, ratio(F.col("step_time_sd_s"), F.col("mean_step_time_s")) * 100))
    return out.select(*keys, *SCOPE, *[F.col(c).alias(prefix + c) for c in out.columns if c not in (*keys, *SCOPE)])


def matched(found: DataFrame, reference: DataFrame, keys: Keys, time: str, tolerance: float) -> DataFrame:
    """(keys, found_time, reference_time, error, n): pairs of events, each used once, the closest first (ties: the earlier
    found event, then the earlier reference); n pairs of events of the same two times are one row.

    In rounds: a pair of times that are each other's nearest is taken before any other pair of either, so all such pairs
    are taken at once, as many as both times have events; what is left goes to the next round, and a time without a
    partner within the tolerance drops out. The nearest is the last before or the first after, which windows find: rows
    of one window are the events of three stretches as long as the tolerance, never a trial. There are as many rounds as
    the longest row of times has in which each is nearer to the next than to the one before.
    """
    schema = ", ".join(f"{k} {found.schema[k].dataType.simpleString()}" for k in keys)
    with Scratch(found.sparkSession) as keep:
        both = found.select(*keys, F.col(time).alias("t"), F.lit(0).alias("kind")).unionByName(reference.select(*keys, F.col(time).alias("t"), F.lit(1).alias("kind")))
        left = keep(both.where("t is not null").groupBy(*keys, "kind", "t").agg(F.count("*").alias("n")), "events")
        taken = found.sparkSession.createDataFrame([], f"{schema}, found_time double, reference_time double, error double, n long")
        while True:
            near = keep(nearest(left, keys, tolerance), "nearest")
            a = near.where("kind = 0").select(*keys, F.col("t").alias("found_time"), F.col("other").alias("reference_time"), F.col("n").alias("_a"))
            b = near.where("kind = 1").select(*keys, F.col("other").alias("found_time"), F.col("t").alias("reference_time"), F.col("n").alias("_b"))
            pairs = a.join(b, [*keys, "found_time", "reference_time"]).select(*keys, "found_time", "reference_time", F.abs(F.col("found_time") - F.col("reference_time")).alias("error"), F.least("_a", "_b").alias("n"))
            pairs = keep(pairs, "pairs")
            if pairs.isEmpty():
                return materialize(taken, "matched")
            taken = taken.unionByName(pairs)
            used = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("found_time").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("reference_time").alias("t")))).alias("x"), F.col("n").alias("_used")).select(*keys, "x.kind", "x.t", "_used")
            rest = near.select(*keys, "kind", "t", "n").join(used, [*keys, "kind", "t"], "left").withColumn("n", F.col("n") - F.coalesce("_used", F.lit(0))).drop("_used")
            left = rest.where("n > 0")


def nearest(times: DataFrame, keys: Keys, tolerance: float) -> DataFrame:
    """times (keys, kind, t, n) with the nearest time of the other kind (ties: the earlier) that is within the tolerance;
    those without one are left out."""
    place = F.floor(F.col("t") / tolerance) if tolerance > 0 else F.col("t")
    cells = F.explode(F.array(*[place + d for d in (0, -1, 1)])) if tolerance > 0 else place
    spread = times.withColumn("_home", place).withColumn("_cell", cells)
    cell, so_far = Window.partitionBy(*keys, "_cell"), (Window.unboundedPreceding, -1)
    forth, back = cell.orderBy("t", "kind").rowsBetween(*so_far), cell.orderBy(F.desc("t"), F.desc("kind")).rowsBetween(*so_far)
    seen = lambda kind, way: F.last(F.when(F.col("kind") == kind, F.col("t")), ignorenulls=True).over(way)
    other = lambda way: F.when(F.col("kind") == 0, seen(1, way)).otherwise(seen(0, way))
    ends = spread.withColumns({"_before": other(forth), "_after": other(back)}).where("_home = _cell")
    closer = F.when(F.col("_after").isNull() | (F.col("t") - F.col("_before") <= F.col("_after") - F.col("t")), F.col("_before")).otherwise(F.col("_after"))
    return ends.withColumn("other", closer).where(F.abs(F.col("t") - F.col("other")) <= tolerance).select(*keys, "kind", "t", "n", "other")


def agreement(found: DataFrame, reference: DataFrame, scopes: DataFrame, keys: Keys, time: str, tolerance: float, prefix: str = "footswitch__imu_") -> DataFrame:
    """Matched events, precision, recall, F1 and mean absolute error of each scope (a row of keys)."""
    counts = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    pairs = matched(found, reference, keys, time, tolerance).groupBy(*keys).agg(F.sum("n").alias("m"), (F.sum(F.col("error") * F.col("n")) / F.sum("n")).alias("event_mean_abs_error_s"))
    out = scopes.select(*keys).distinct()
    for df in (counts(found, "n_found"), counts(reference, "n_reference"), pairs):
        out = out.join(df, list(keys), "left")
    m = F.coalesce("m", F.lit(0))
    precision, recall = ratio(m, F.col("n_found")), ratio(m, F.col("n_reference"))
    out = out.select(*keys, m.alias("matched_event_count"), precision.alias("event_precision"), recall.alias("event_recall"), "event_mean_abs_error_s")
    p, r = F.col("event_precision"), F.col("event_recall")
    out = out.withColumn("event_agreement_f1", F.when(p + r > 0, ratio(2 * p * r, p + r)))
    return out.select(*keys, *[F.col(c).alias(prefix + c) for c in out.columns if c not in keys])
