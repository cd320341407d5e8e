"""The operators over the driver's tables: a user is a trial, an event's time its clock and its value a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import alignment, events, features, fusion, kernels, modeling, runs, series, windows
from ..session import materialize
from ..sources import manifest as manifests
from ..sources.signals import video_metadata

#: Microseconds of 2024-01-01; times are seconds from there, so that doubles keep the microseconds.
EPOCH = 1_704_067_200_000_000
DAY = 86_400.0
THRESHOLD = 20.0
USER = ["user_id"]
SCOPE = ["feature_level", "segment_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH) / 1e6
    return table(spark, sf_dir, "events").select("user_id", "event_id", t.alias("t"), "event_type", "value")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "smallint") else F.col(c) for c, k in df.dtypes])


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal with errors as gaps."""
    return signal(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("user_id", "t", X.contact(F.col("value"), THRESHOLD).alias("state"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of a trial: walking and turning days by turns, and a longer rest."""
    names = [("outbound_walk", 0, 5), ("turn_1", 5, 8), ("return_walk", 8, 13), ("turn_to_sit", 13, 15), ("final_sitting", 15, 30)]
    phases = F.explode(F.array(*[F.struct(F.lit(n).alias("segment_name"), F.lit(a * DAY).alias("start_time"), F.lit(b * DAY).alias("end_time")) for n, a, b in names]))
    return signal(spark, sf_dir).select("user_id").distinct().select("user_id", phases.alias("p")).select("user_id", "p.*")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    return s.select("user_id", F.col("t").alias("timestamp"), F.col("value").alias("acc_ap"), (F.col("value") - 10).alias("acc_ml"), F.sin("value").alias("acc_vertical"), F.cos("value").alias("gyro_yaw"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz"))]
    return table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").cast("double").alias("t"), *parts)


QUAT = ["qw", "qx", "qy", "qz"]


def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    out = signal(spark, sf_dir).select("event_id", (X.acceleration(v, "g") - 9.80665).alias("acc_vertical"), X.angular(v, "deg/s").alias("gyro_yaw"), X.on_reference_clock("t", 1.5).alias("timestamp"), X.dbfs(v / 100).alias("dbfs"))
    return rounded(out, 9).withColumn("timestamp", F.round("timestamp", 6))


def try_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.get_json_object("props", "$.k"))).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(X.number(text)).alias("n_valid"), F.sum(X.number(text)).alias("total"), F.count_if(X.number(text).isNull()).alias("n_invalid"))


def sort_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return series.dedupe_first(lines, ["l_orderkey"], "l_shipdate", order).select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship"), F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey")


def timestamp_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.timestamp_quality(signal(spark, sf_dir), USER, "value", "event_id")


def missing_anomaly_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gappy(spark, sf_dir)
    lost, odd = series.missing_ratios(s, USER, ["value"]), series.anomaly_ratios(s, USER, {"value": THRESHOLD})
    return rounded(lost.join(odd, "user_id").select("user_id", F.col("missing_ratio")["value"].alias("missing_ratio"), F.col("anomaly_ratio")["value"].alias("anomaly_ratio")))


def positional_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.fill_gaps(gappy(spark, sf_dir), USER, "t", ["value"]).select("event_id", "user_id", "value"))


def sampling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.sampling(signal(spark, sf_dir), USER, "t")
    return rounded(out.withColumn("sampling_rate_hz", F.col("sampling_rate_hz") * 1000))


def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.resample_linear(gappy(spark, sf_dir), USER, "t", ["value"], 1 / 21_600).select("user_id", "grid_index", "value"))


def gradient_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = series.gradient(F.col("value"), F.col("t") / 3600, series.along(USER, "t"))
    return rounded(signal(spark, sf_dir).withColumn("g", g).groupBy("user_id").agg(X.rms(F.col("g")).alias("gradient_rms"), X.rms(F.col("value")).alias("value_rms")))


def quaternion_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(v.select(F.col("t").cast("long").alias("vec_id"), *[q.alias(c) for c, q in zip(QUAT, series.normalized([F.col(c) for c in QUAT]))]))


def sign_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.continuous_sign(vectors(spark, sf_dir), ["label"], "t", QUAT).select(F.col("t").cast("long").alias("vec_id"), *QUAT))


def slerp_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.resample_slerp(vectors(spark, sf_dir), ["label"], "t", QUAT, 0.1).drop("t"))


def butterworth_lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    rated = s.join(series.sampling(s, USER, "t").select("user_id", F.col("sampling_rate_hz").alias("rate")), "user_id")
    cutoff = 1e-5
    return kernels.lowpass(rated, USER, "t", ["value"], "rate", cutoff, 4).select("user_id", "event_id", F.round("value", 6).alias("value"), "filter_note")


def step_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.step_events(signal(spark, sf_dir), USER, "t", "value", 20_000.0, 5.0))


def step_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    parts = windows.full_scopes(windows.extents(s, USER, "t"), USER).withColumn("part", F.lit("all"))
    steps = s.where("event_type = 'purchase'").select("user_id", F.lit("all").alias("part"), F.col("t").alias("timestamp"))
    return rounded(features.step_statistics(steps, parts, USER).drop(*SCOPE), 4)


def value_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.runs(states(spark, sf_dir), USER, "t", "state"))


def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.debounce(states(spark, sf_dir), USER, "t", "state", F.lit(1.0), 2.0, 3.0)
    return rounded(out)


def vad_stabilize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.stabilize_speech(states(spark, sf_dir), USER, "t", "state", 1.0, 2.0, 3.0))


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("click", "view"), "left").otherwise("right")
    return signal(spark, sf_dir).select("user_id", side.alias("side"), F.col("t"), X.contact(F.col("value"), THRESHOLD).alias("state"))


def contact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.transitions(sided(spark, sf_dir), ["user_id", "side"], "t", "state"))


def contact_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.transitions(sided(spark, sf_dir), ["user_id", "side"], "t", "state").withColumnRenamed("t", "timestamp")
    scopes = windows.full_scopes(windows.extents(signal(spark, sf_dir), USER, "t"), USER, closed=False).withColumn("part", F.lit("all"))
    return rounded(events.contact_timing(events.measured(found, scopes, USER), USER, "").drop(*SCOPE), 4)


def waveform(spark: SparkSession, sf_dir: str, block: int = 20) -> DataFrame:
    """Every user's values in order as a waveform of 1000 samples a second, in blocks that frames don't keep to."""
    placed = signal(spark, sf_dir).withColumns({"place": F.row_number().over(series.along(USER, "t")) - 1, "n_samples": F.count("*").over(Window.partitionBy(*USER))})
    s = placed.groupBy("user_id", "n_samples", (F.col("place") - F.col("place") % block).alias("first_sample")).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s"))
    return s.select("user_id", "n_samples", "first_sample", F.transform("s", lambda x: x["value"] / 100).alias("samples"), F.lit(1000).alias("sampling_rate"))


def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.speech_frames(waveform(spark, sf_dir), USER, 8.0, -15.0)
    return rounded(out.select("user_id", "frame", "start_time", "end_time", "rms", "is_speech"))


def clipping_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.clipping(waveform(spark, sf_dir), USER, 0.3))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of large values, from their first sample to a while after their last."""
    found = runs.runs(states(spark, sf_dir), USER, "t", "state").where("state = 1")
    return found.select("user_id", F.col("first").alias("start_time"), (F.col("last") + 600.0).alias("end_time"))


def interval_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.clipped(intervals(spark, sf_dir), days(spark, sf_dir), USER)
    return rounded(out.select("user_id", "segment_name", "clip_start", "clip_end"))


def speech_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = windows.full_scopes(windows.extents(signal(spark, sf_dir), USER, "t"), USER).unionByName(windows.phase_scopes(days(spark, sf_dir), USER))
    out = features.speech_features(intervals(spark, sf_dir), scopes, USER, 3600.0, 10_000.0)
    return rounded(out.drop("audio__response_count", "audio__correct_response_count", "audio__response_accuracy"), 4)


def segment_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = windows.sliced(signal(spark, sf_dir), days(spark, sf_dir), USER, "t")
    return rounded(inside.groupBy("user_id", "segment_name").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.min("t").alias("first_t")))


def phase_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    scopes = windows.full_scopes(windows.extents(s, USER, "timestamp"), USER).unionByName(windows.phase_scopes(days(spark, sf_dir), USER))
    out = features.signal_features(s, scopes, USER)
    scale = {c: F.col(c) * 1e6 for c in ("imu__pelvis_jerk_rms_m_s3", "imu__sampling_rate_hz")}
    return rounded(out.withColumns(scale), 4)


def turn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = windows.phase_scopes(days(spark, sf_dir).where(windows.turning(F.col("segment_name"))), USER)
    both = turns.unionByName(turns.withColumns({"feature_level": F.lit("trial"), "segment_name": F.lit("full_trial")}))
    out = features.turn_statistics(samples(spark, sf_dir), both, USER)
    return rounded(out.withColumn("imu__turn_smoothness_rad_s2", F.col("imu__turn_smoothness_rad_s2") * 1e6), 4)


def event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: signal(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", "t")
    scopes = signal(spark, sf_dir).select("user_id").distinct()
    return rounded(events.agreement(of("click"), of("view"), scopes, USER, "t", 20_000.0, ""))


def alignment_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.datediff(c, F.lit("1990-01-01")).cast("double")
    orders = table(spark, sf_dir, "orders")
    ref = orders.groupBy("o_custkey").agg(F.min(day("o_orderdate")).alias("ref_start"), F.max(day("o_orderdate")).alias("ref_end"))
    lines = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    target = lines.groupBy("o_custkey").agg(F.min(day("l_shipdate")).alias("target_start"), F.max(day("l_shipdate")).alias("target_end"))
    offset = F.when(F.col("o_custkey") % 2 == 0, -1500.0).otherwise(100.0)
    out = alignment.align(ref.join(target, "o_custkey"), offset, F.when(F.col("o_custkey") % 5 != 0, 0.0), 0.9, 200.0)
    return rounded(out.select("o_custkey", "overlap_s", "overlap_ratio", "duration_difference_s", "qc_status", F.size("qc_notes").cast("long").alias("n_notes")))


def timeline_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native timelines in input order; here an order's ship dates by line, of which many fall."""
    day = F.datediff("l_shipdate", F.lit("1990-01-01")).cast("double")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("d"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("place"))
    return rounded(alignment.timelines(lines, ["l_orderkey"], "d", "place"))


#: Places of a vector that stand for a landmark's x and y.
POINTS = {"left_shoulder": 0, "right_shoulder": 2, "left_hip": 4, "right_hip": 6, "left_ankle": 8, "right_ankle": 10}


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("landmark_index"), F.lit(n).alias("landmark_name"), at(i).alias("x"), at(i + 1).alias("y"), F.abs(at(i + 2) * 10).alias("visibility")) for n, i in POINTS.items()]))
    out = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("frame_index"), F.col("vec_id").cast("double").alias("timestamp"), points.alias("p"))
    return out.select("label", "frame_index", "timestamp", "p.*")


def pose_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.pose_metrics(landmarks(spark, sf_dir), ["label"], 0.2).drop("timestamp", "label"))


def pose_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = landmarks(spark, sf_dir)
    frames = points.select("label", "frame_index", "timestamp", (F.col("frame_index") % 7 != 0).alias("pose_detected")).distinct()
    bounds = frames.groupBy("label").agg(F.lit(0.0).alias("start_time"), F.lit(100.0).alias("end_time"))
    rise = bounds.select("label", F.lit("sit_to_stand").alias("segment_name"), F.lit(10.0).alias("start_time"), F.lit(300.0).alias("end_time"))
    scopes = windows.full_scopes(bounds, ["label"], False, "trial").unionByName(windows.phase_scopes(rise, ["label"]))
    return rounded(features.pose_summary(points, frames, features.pose_metrics(points, ["label"], 0.2), scopes, ["label"]))


def probe_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    stream = F.struct(
        F.when(k % 3 == 0, "N/A").otherwise((F.col("p_size") / 2).cast("string")).alias("duration"),
        F.when(k % 4 == 0, "0/0").otherwise("30000/1001").alias("avg_frame_rate"), F.lit("25/1").alias("r_frame_rate"),
        F.when(k % 2 == 0, F.col("p_size").cast("string")).otherwise("N/A").alias("nb_frames"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit("h264").alias("codec_name"),
    )
    probe = F.to_json(F.struct(F.array(stream).alias("streams"), F.struct(F.lit("12.5").alias("duration")).alias("format")))
    out = video_metadata(table(spark, sf_dir, "part").select("p_partkey", probe.alias("probe")))
    return rounded(out.select("p_partkey", "duration_s", "frame_rate_hz", "total_frames", "frames_estimated", "error"))


def fused_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("condition"))
    scoped = lambda df: df.withColumn("feature_level", F.lit("trial")).join(trials.hint("merge"), "id")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("imu__total"), F.count("*").alias("imu__orders"))
    clicks = signal(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("audio__mean_value"))
    clinical = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("clinical__balance"), F.lit(1).alias("availability__clinical"))
    return fusion.fuse(trials, {"imu": scoped(orders), "audio": scoped(clicks)}, ["id", "condition"], clinical, "id")


def fuse_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fused_tables(spark, sf_dir), 2)


def feature_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.inventory(fused_tables(spark, sf_dir)).drop("dtype")


def clinical_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = lambda t, p: table(spark, sf_dir, t).select(F.col(f"{p}_nationkey").cast("string").alias("participant_id"), (F.col(f"{p}_nationkey") % 5).cast("long").alias("group")).distinct()
    return fusion.clinical_table([nations("supplier", "s"), nations("customer", "c")]).withColumn("availability__clinical", F.col("availability__clinical").cast("long"))


def dual_task_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    rows = rows.groupBy(F.col("o_custkey").alias("participant_id"), F.col("o_orderpriority").alias("condition")).agg(
        F.max("o_orderkey").alias("trial_id"), F.avg("o_totalprice").alias("imu__mean_price"), F.count("*").cast("double").alias("audio__orders_pct")
    )
    metrics = {"imu__mean_price": "higher_is_worse", "audio__orders_pct": "higher_is_better"}
    return rounded(fusion.dual_task_costs(rows, ["participant_id"], "1-URGENT", "5-LOW", metrics)[0], 4)


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda test: F.when(test, "file.csv").otherwise("")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        k.alias("row_number"), F.when(k % 50 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("participant_id"), F.date_format("o_orderdate", "yyyy-MM").alias("session_id"),
        F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("trial_id"), path(price > 100_000).alias("imu_path"), path(price > 200_000).alias("video_path"),
        path(price > 300_000).alias("audio_path"), path(price > 400_000).alias("footswitch_path"), path(k % 2 == 0).alias("annotation_path"), path(k % 3 == 0).alias("clinical_path"),
    )


def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifests.issues(manifest_rows(spark, sf_dir), ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"), F.sum("row_number").alias("rows"))


def manifest_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.duplicated(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"])


def modality_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.availability_counts(manifest_rows(spark, sf_dir), ["imu", "video", "audio", "footswitch", "annotation", "clinical"]).withColumn("place", F.col("place").cast("long"))


def cohort_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.cohort(fused_tables(spark, sf_dir), ["imu", "audio"], "clinical__balance", "complete_modalities")
    return out.groupBy("condition").agg(F.count("*").alias("n"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the group (their source) and a score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("score", F.col("n_chars") % 101 / 101)


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modeling.group_folds(labelled(spark, sf_dir), "source", 3, "quality").withColumn("fold", F.col("fold").cast("long"))


def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.pmod(F.col("c_nationkey"), F.lit(4)).alias("fold"))
    return rounded(modeling.split_audit(rows, "c_nationkey", 4))


def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gappy(spark, sf_dir)
    return rounded(modeling.impute(s, modeling.medians(s, ["value"])).select("event_id", "value"))


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), F.lit(3.0).alias("constant"))
    return rounded(modeling.scale(p, modeling.scales(p, ["price", "size", "constant"])))


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").alias("y_true"), (F.col("p_size") * 20.0 + 900).alias("y_pred"))
    return rounded(modeling.regression_metrics(p, ["p_brand"]), 4)


def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("source", F.col("quality").alias("y_true"), (F.col("score") > 0.4).cast("int").alias("y_pred"), F.col("score").alias("y_score"))
    return rounded(modeling.classification_metrics(rows, ["source"]))


def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("mae"), F.max(F.when(F.col("o_orderkey") % 5 > 1, F.col("o_totalprice"))).alias("r2"))
    return rounded(modeling.fold_summary(folds, ["o_orderpriority"], ["mae", "r2"]), 3)


def qc_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", " Pass ").otherwise("warning")
    return fusion.status_counts(table(spark, sf_dir, "orders").withColumn("qc_status", status), ["o_orderpriority"])


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("feature_level", F.when(F.col("o_orderkey") % 8 == 0, "trial").otherwise("phase"))
    distinct = o.agg(F.count_distinct("o_custkey").alias("participants"), F.count_distinct("o_orderpriority").alias("conditions"))
    return fusion.level_counts(o).crossJoin(distinct)  # one row each


def baseline(spark: SparkSession, sf_dir: str, model: str, task: str) -> DataFrame:
    """Grouped cross-validation on the fused customers, of which nations are the groups, over both cohorts."""
    fused = fused_tables(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("participant_id")).hint("merge"), "id")
    target = fused.withColumn("clinical__target", F.col("clinical__balance") if task == "regression" else (F.col("clinical__balance") > 5000).cast("int")).drop("clinical__balance")
    how = modeling.Baseline(task_type=task, folds=3, models=(model,), positive=1 if task == "classification" else None)
    # a table: both cohorts read it, and several times
    target = materialize(target, "fused")
    found = modeling.evaluate(target, {"imu_audio": ("imu", "audio")}, how, ["id"])
    return found["predictions"].select("id", "cohort", "fold", "y_true", F.round("y_pred", 3).alias("y_pred"), F.round("y_score", 4).alias("y_score"))


def fused_user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling quality, steps, gradients and availability of every user in one table: one windowed pass, one aggregate."""
    w = series.along(USER, "t")
    bought = F.when(F.col("event_type") == "purchase", F.col("t"))
    dt = F.col("t") - F.lag("t").over(w)
    timed = signal(spark, sf_dir).withColumns({
        "g": series.gradient(F.col("value"), F.col("t") / 3600, w), "dt": F.when(dt > 0, dt),
        "gap": bought - F.last(bought, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })
    out = timed.groupBy("user_id").agg(
        F.count("*").alias("n_samples"), X.rms(F.col("g")).alias("gradient_rms"), (X.ratio(F.lit(1.0), F.median("dt")) * 1000).alias("sampling_rate_hz"), X.cv_percent(F.col("dt")).alias("interval_cv_pct"),
        F.count_if(F.col("event_type") == "purchase").alias("imu__step_count"), F.avg("gap").alias("imu__mean_step_time_s"), F.max((F.col("event_type") == "error").cast("long")).alias("availability__error"),
    )
    return rounded(out, 4)
