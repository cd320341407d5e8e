"""Trial- and phase-level features of the inertial sensor, foot contacts, audio activity and pose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import cv_percent, distance, finite, lean_degrees, ratio, rms
from ..schemas import ACCELERATION
from .events import agreement, contact_timing, measured
from .kernels import step_events
from .series import Keys, along, gradient
from .windows import clipped, extents, full_scopes, parts_of_trials, phase_scopes, sliced, turning, walking, with_all

SCOPE = ["feature_level", "segment_name"]


def prefixed(df: DataFrame, prefix: str, keys: Keys) -> DataFrame:
    return df.select(*keys, *SCOPE, *[F.col(c).alias(c if c.startswith(prefix) else prefix + c) for c in df.columns if c not in (*keys, *SCOPE)])


def signal_features(samples: DataFrame, scopes: DataFrame, keys: Keys) -> DataFrame:
    """Counts, duration, rate, root mean squares, range and jerk of each scope. The jerk's gradient is the scope's own:
    its ends are the scope's. A sample whose jerk lacks a present axis is left out."""
    scope = [*keys, *SCOPE]
    inside = sliced(samples, scopes, keys, "timestamp")
    axes = [c for c in ACCELERATION if c in samples.columns]
    w = along(scope, "timestamp")
    parts = inside.withColumns({f"_j_{c}": gradient(F.col(c), F.col("timestamp"), w) for c in axes} | {"_dt": F.col("timestamp") - F.lag("timestamp").over(w)})
    signal = lambda c: F.col(c) if c in samples.columns else F.lit(None).cast("double")
    jerk = F.sqrt(sum((F.col(f"_j_{c}") * F.col(f"_j_{c}") for c in axes), F.lit(0.0))) if axes else F.lit(None).cast("double")
    ml = finite(signal("acc_ml"))
    out = parts.groupBy(*scope).agg(
        F.count("*").alias("sample_count"),
        F.first(F.col("end_time") - F.col("start_time")).alias("duration_s"),
        rms(signal("acc_ap")).alias("pelvis_acc_rms_ap_m_s2"),
        rms(signal("acc_ml")).alias("pelvis_acc_rms_ml_m_s2"),
        rms(signal("acc_vertical")).alias("pelvis_acc_rms_vertical_m_s2"),
        (F.max(ml) - F.min(ml)).alias("pelvis_acc_range_ml_m_s2"),
        rms(jerk).alias("pelvis_jerk_rms_m_s3"),
        rms(signal("gyro_yaw")).alias("angular_velocity_rms_rad_s"),
        ratio(F.lit(1.0), F.median(F.when(F.col("_dt") > 0, F.col("_dt")))).alias("sampling_rate_hz"),
    )
    return prefixed(out, "imu__", keys)


def step_statistics(steps: DataFrame, parts: DataFrame, keys: Keys) -> DataFrame:
    """Step features of each scope of parts (keys, feature_level, segment_name, part, start_time, end_time): steps (keys,
    part, timestamp) are spaced within their part; cadence is over the parts' whole time."""
    gaps = steps.withColumn("gap", F.col("timestamp") - F.lag("timestamp").over(along([*keys, "part"], "timestamp")))
    scope = [*keys, *SCOPE]
    time = parts.groupBy(*scope).agg(F.sum(F.col("end_time") - F.col("start_time")).alias("walking_s"))
    own = parts.select(*scope, "part").join(gaps, [*keys, "part"])
    out = own.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("gap").alias("mean_step_time_s"), F.stddev_samp("gap").alias("step_time_sd_s"), cv_percent(F.col("gap")).alias("step_time_cv_pct"))
    out = time.join(out, scope, "left").withColumn("step_count", F.coalesce("n", F.lit(0)))
    out = out.withColumn("cadence_steps_min", F.when(F.col("walking_s") > 0, ratio(F.col("step_count"), F.col("walking_s")) * 60))
    return prefixed(out.drop("n", "walking_s"), "imu__", keys)


def turn_statistics(samples: DataFrame, parts: DataFrame, keys: Keys) -> DataFrame:
    """Turn features of each scope; a trial's turns are one series, so its gradient runs across the gap between them."""
    scope = [*keys, *SCOPE]
    time = parts.groupBy(*scope).agg(F.sum(F.col("end_time") - F.col("start_time")).alias("turn_duration_s"))
    if "gyro_yaw" not in samples.columns:
        none = F.lit(None).cast("double")
        return prefixed(time.withColumns(dict.fromkeys(("peak_yaw_velocity_rad_s", "mean_abs_yaw_velocity_rad_s", "turn_smoothness_rad_s2"), none)), "imu__", keys)
    inside = sliced(samples, parts, keys, "timestamp")
    inside = inside.withColumn("_g", gradient(F.col("gyro_yaw"), F.col("timestamp"), along(scope, "start_time", "timestamp")))
    size = F.abs(finite("gyro_yaw"))
    out = inside.groupBy(*scope).agg(F.max(size).alias("peak_yaw_velocity_rad_s"), F.avg(size).alias("mean_abs_yaw_velocity_rad_s"), rms(F.col("_g")).alias("turn_smoothness_rad_s2"))
    return prefixed(time.join(out, scope, "left"), "imu__", keys)


def walking_parts(segments: DataFrame, bounds: DataFrame, keys: Keys, closed: bool) -> tuple[DataFrame, DataFrame]:
    """(windows to find steps in, scopes over them): a walking phase is a scope of its own and a part of its trial's."""
    windows = parts_of_trials(segments, bounds, keys, walking, closed).withColumn("part", F.concat_ws("@", "segment_name", F.col("start_time").cast("string")))
    trial = windows.withColumns({"feature_level": F.lit("trial"), "segment_name": F.lit("full_trial")})
    phase = windows.where(walking(F.col("segment_name"))).withColumn("feature_level", F.lit("phase"))
    return windows, trial.unionByName(phase)


def imu_features(samples: DataFrame, segments: DataFrame, keys: Keys, min_interval: float, prominence: float, steps: DataFrame | None = None) -> DataFrame:
    """One row a trial and one a phase. Steps are taken in walking phases (else in the whole trial), turns in phases
    whose name begins with turn; elsewhere their features are NULL."""
    bounds = extents(samples, keys, "timestamp")
    scopes = full_scopes(bounds, keys).unionByName(phase_scopes(segments, keys))
    out = with_all(signal_features(samples, scopes, keys), scopes, [*keys, *SCOPE])
    windows, parts = walking_parts(segments, bounds, keys, True)
    if steps is None:
        steps = found_steps(samples, windows, keys, min_interval, prominence)
    turns = phase_scopes(segments.where(turning(F.col("segment_name"))), keys)
    turn_parts = turns.unionByName(turns.withColumns({"feature_level": F.lit("trial"), "segment_name": F.lit("full_trial")}))
    on = [*keys, *SCOPE]
    return out.join(step_statistics(steps, parts, keys), on, "left").join(turn_statistics(samples, turn_parts, keys), on, "left")


def found_steps(samples: DataFrame, windows: DataFrame, keys: Keys, min_interval: float, prominence: float) -> DataFrame:
    """(keys, part, timestamp): steps by peaks of the vertical acceleration in each walking window, found once."""
    return step_events(sliced(samples, windows, keys, "timestamp"), [*keys, "part"], "timestamp", "acc_vertical", min_interval, prominence)


def footswitch_features(
    events: DataFrame, samples: DataFrame, segments: DataFrame, keys: Keys, min_interval: float, prominence: float, tolerance: float, steps: DataFrame | None = None
) -> DataFrame:
    """Contact timing of trials and phases, and agreement of inertial steps with contacts where people walk. A trial
    without walking phases is measured to its last sample, exclusive."""
    bounds = extents(samples, keys, "timestamp")
    scopes = full_scopes(bounds, keys).unionByName(phase_scopes(segments, keys))
    _, trial_parts = walking_parts(segments, bounds, keys, False)
    trial_parts = trial_parts.where("feature_level = 'trial'")
    phases = phase_scopes(segments, keys).withColumn("part", F.concat_ws("@", "segment_name", F.col("start_time").cast("string")))
    of_windows = trial_parts.unionByName(phases)
    parts = measured(events, of_windows, keys)
    on = [*keys, *SCOPE]
    timing = with_all(contact_timing(parts, keys), scopes, on).fillna(0, [f"footswitch__{c}_count" for c in ("left_contact", "right_contact", "step")])
    windows, step_parts = walking_parts(segments, bounds, keys, True)
    if steps is None:
        steps = found_steps(samples, windows, keys, min_interval, prominence)
    found = step_parts.select(*on, "part").join(steps, [*keys, "part"]).select(*on, "timestamp")
    judged = step_parts.select(*on).distinct()
    contacts = parts.where("event = 'contact'").select(*on, "timestamp").join(judged, on, "left_semi")
    return timing.join(agreement(found, contacts, judged, on, "timestamp", tolerance), on, "left")


def speech_features(intervals: DataFrame, scopes: DataFrame, keys: Keys, min_pause: float, task_start: float | None) -> DataFrame:
    """Activity of each scope: intervals are clipped to it first, and pauses lie between clipped ones. The first
    response is taken on trials only; outcomes that need a transcript are NULL."""
    scope = [*keys, *SCOPE]
    cut = clipped(intervals, scopes, keys)
    gap = F.col("clip_start") - F.lag("clip_end").over(along(scope, "clip_start", "clip_end"))
    cut = cut.withColumn("_pause", gap).withColumn("_pause", F.when(F.col("_pause") >= min_pause, F.col("_pause")))
    found = cut.groupBy(*scope).agg(
        F.count("*").alias("speech_segment_count"),
        F.sum(F.col("clip_end") - F.col("clip_start")).alias("speech_duration_s"),
        F.count("_pause").alias("pause_count"),
        F.avg("_pause").alias("mean_pause_duration_s"),
        F.max("_pause").alias("max_pause_duration_s"),
        F.min(F.when(F.col("clip_start") >= F.lit(task_start), F.col("clip_start"))).alias("_first"),
    )
    out = scopes.select(*scope, (F.col("end_time") - F.col("start_time")).alias("_d")).join(found, scope, "left")
    out = out.fillna(0, ["speech_segment_count", "pause_count"]).fillna(0.0, ["speech_duration_s"])
    none = F.lit(None).cast("double")
    return prefixed(
        out.select(
            *scope, "speech_segment_count", "speech_duration_s",
            F.greatest(F.lit(0.0), F.col("_d") - F.col("speech_duration_s")).alias("silence_duration_s"),
            F.when(F.col("_d") > 0, ratio(F.col("speech_duration_s"), F.col("_d"))).alias("speech_ratio"),
            "pause_count", "mean_pause_duration_s", "max_pause_duration_s",
            F.when(F.col("feature_level") == "trial", F.col("_first") - F.lit(task_start)).alias("first_response_latency_s"),
            none.alias("response_count"), none.alias("correct_response_count"), none.alias("response_accuracy"),
        ),
        "audio__",
        keys,
    )


def audio_features(intervals: DataFrame, bounds: DataFrame, segments: DataFrame, keys: Keys, min_pause: float, task_start: float) -> DataFrame:
    scopes = full_scopes(bounds, keys).unionByName(phase_scopes(segments, keys))
    return speech_features(intervals.where("activity = 'speech'"), scopes, keys, min_pause, task_start)


def pose_metrics(landmarks: DataFrame, keys: Keys, min_visibility: float, order: str = "landmark_index") -> DataFrame:
    """Trunk lean, pelvis height, ankle separation and limb symmetry of each frame; a measure needs all of its points to
    be visible enough. Of several landmarks with one name, the first in `order` counts."""

    def point(name: str, axis: str) -> Column:
        return F.col(f"{name}.{axis}")

    names = [f"{side}_{part}" for part in ("shoulder", "hip", "ankle") for side in ("left", "right")]
    first = [F.min_by(F.struct("x", "y", "visibility"), F.when(F.col("landmark_name") == n, F.col(order))).alias(n) for n in names]
    frames = landmarks.groupBy(*keys, "frame_index", "timestamp").agg(*first)
    frames = frames.withColumns({n: F.when(point(n, "visibility") >= min_visibility, F.col(n)) for n in names})
    middle = lambda part, axis: (point(f"left_{part}", axis) + point(f"right_{part}", axis)) / 2
    length = lambda side: distance(point(f"{side}_hip", "x"), point(f"{side}_hip", "y"), point(f"{side}_ankle", "x"), point(f"{side}_ankle", "y"))
    all_hips = middle("hip", "y")
    trunk = middle("shoulder", "x").isNotNull() & all_hips.isNotNull()
    return frames.select(
        *keys, "frame_index", "timestamp",
        lean_degrees(middle("shoulder", "x"), middle("shoulder", "y"), middle("hip", "x"), all_hips).alias("trunk_lean_degrees"),
        F.when(trunk, all_hips).alias("pelvis_center_y"),
        F.abs(point("left_ankle", "x") - point("right_ankle", "x")).alias("left_right_step_length_proxy"),
        ratio(F.abs(length("left") - length("right")), (length("left") + length("right")) / 2).alias("lower_limb_symmetry_proxy"),
    )


def pose_summary(landmarks: DataFrame, frames: DataFrame, metrics: DataFrame, scopes: DataFrame, keys: Keys) -> DataFrame:
    """Frames, detections, confidence and the metrics' means, ranges and flexion in each scope [start, end)."""
    scope = [*keys, *SCOPE]
    spread = lambda c: F.max(c) - F.min(c)
    f = sliced(frames, scopes, keys, "timestamp").groupBy(*scope).agg(F.count("*").alias("processed_frame_count"), F.count_if("pose_detected").alias("detected_frame_count"))
    v = sliced(landmarks, scopes, keys, "timestamp").groupBy(*scope).agg(F.avg(finite("visibility")).alias("mean_landmark_confidence"))
    m = sliced(metrics, scopes, keys, "timestamp").groupBy(*scope).agg(
        F.avg("trunk_lean_degrees").alias("trunk_lean_mean_degrees"),
        spread("trunk_lean_degrees").alias("trunk_lean_range_degrees"),
        spread("pelvis_center_y").alias("pelvis_vertical_displacement_proxy"),
        F.max(F.abs("trunk_lean_degrees")).alias("_flexion"),
        F.avg("left_right_step_length_proxy").alias("left_right_step_length_proxy"),
        F.avg("lower_limb_symmetry_proxy").alias("lower_limb_symmetry_proxy"),
    )
    out = with_all(f, scopes, scope).join(v, scope, "left").join(m, scope, "left").fillna(0, ["processed_frame_count", "detected_frame_count"])
    # a trial's flexion is that of its phase of standing up
    rise = out.where("segment_name = 'sit_to_stand'").groupBy(*keys).agg(F.first("_flexion").alias("_rise"))
    out = out.join(rise, list(keys), "left")
    shown = F.when(F.col("feature_level") == "trial", F.col("_rise")).when(F.col("segment_name") == "sit_to_stand", F.col("_flexion"))
    out = out.withColumn("sit_to_stand_trunk_flexion_degrees", shown).withColumn("pose_detection_rate", ratio(F.col("detected_frame_count"), F.col("processed_frame_count")))
    return prefixed(out.drop("_flexion", "_rise"), "video__", keys)


def video_features(metadata: DataFrame, landmarks: DataFrame, frames: DataFrame, segments: DataFrame, bounds: DataFrame, keys: Keys, min_visibility: float) -> DataFrame:
    """One row a trial (segment_name trial) and one a phase; metadata is (keys, duration_s, frame_rate_hz, total_frames,
    width_pixels, height_pixels). Frame totals belong to trials only."""
    known = metadata.select(*keys)
    own = full_scopes(bounds, keys, closed=False, name="trial").unionByName(phase_scopes(segments, keys)).join(known, list(keys), "left_semi")
    posed = frames.select(*keys).distinct().withColumn("_posed", F.lit(True))
    summary = pose_summary(landmarks, frames, pose_metrics(landmarks, keys, min_visibility), own, keys)
    trial = F.col("feature_level") == "trial"
    out = own.join(metadata, list(keys)).join(posed, list(keys), "left")
    out = out.select(
        *keys, *SCOPE, F.col("start_time").alias("segment_start_time"), F.col("end_time").alias("segment_end_time"),
        F.when(trial, F.col("duration_s")).otherwise(F.col("end_time") - F.col("start_time")).alias("video__duration_s"),
        F.col("frame_rate_hz").alias("video__frame_rate_hz"), F.when(trial, F.col("total_frames")).alias("video__total_frames"),
        F.col("width_pixels").alias("video__width_pixels"), F.col("height_pixels").alias("video__height_pixels"),
        F.coalesce("_posed", F.lit(False)).alias("video__pose_estimation_enabled"),
    )
    return out.join(summary, [*keys, *SCOPE], "left")
