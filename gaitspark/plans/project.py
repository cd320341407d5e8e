"""A study from its manifest to the report: stages as tables keyed by trial, with a status for each trial instead of a failure."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Project
from ..functions.expressions import acceleration, angular, contact, on_reference_clock
from ..operators import alignment, features, fusion, kernels, modeling, runs, series, windows
from ..schemas import ACCELERATION, ANGULAR, FRAMES, LANDMARKS, QUATERNION, SIGNALS, TRIAL_KEYS
from ..session import Scratch, materialize, remove, write_small
from ..sources import manifest as manifests
from ..sources import containers, signals
from .store import Store, digest, fingerprint

KEYS = TRIAL_KEYS
STATUS = [*KEYS, "qc_status", "qc_notes"]


@dataclass
class Study:
    """The tables of a run by name, each below the processed folder. Within a stage they are written aside; when it ends
    they are moved into place together, with a fingerprint of all that the stage read."""

    spark: SparkSession
    project: Project
    tables: dict[str, DataFrame] = field(default_factory=dict)
    prints: dict[str, str] = field(default_factory=dict)
    #: the stages that ran now, in order; the others' tables were current
    ran: list[str] = field(default_factory=list)
    #: the tables that the running stage made the last time, where they are whole
    before: dict[str, DataFrame] = field(default_factory=dict)
    #: the number of successful evaluations, where models were evaluated
    successes: int | None = None

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.project.resolve(self.project.processed_dir))

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.tables[name] = self.store.write(name, df)
        return self.tables[name]

    def export(self, name: str, path: str) -> None:
        """A folder of CSV parts with headers in the output folder: maps and lists as JSON."""
        df = self.tables[name]
        flat = [F.to_json(c).alias(c) if k.startswith(("map", "array")) else F.col(c) for c, k in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{self.project.resolve(self.project.output_dir)}/{path}")


def status(df: DataFrame, note: str) -> DataFrame:
    return df.select(*KEYS, F.lit("fail").alias("qc_status"), F.col(note).alias("qc_notes"))


def preprocess(study: Study) -> None:
    """imu: filtered, resampled signals in SI units, a folder for each trial; imu_qc: one row a trial; imu_trials: what each
    trial was made from. Where only some trials' files have changed, only they are made again, and the files of the
    others stay as they are."""
    spark, store = study.spark, study.store
    settings = fingerprint(asdict(study.project.imu))
    state = F.sha2(F.concat_ws("|", F.lit(settings), "imu_path", F.col("length").cast("string"), F.col("modified").cast("string")), 256)
    files = study.tables["files"].where("modality = 'imu'").select(F.col("path").alias("imu_path"), "length", "modified")
    now = study.keep("imu_trials", study.tables["manifest"].join(files, "imu_path", "left").select(*KEYS, state.alias("state")))
    old = study.before
    stale = now.join(old["imu_trials"].withColumnRenamed("state", "old"), KEYS, "left").where("old is null or old <> state").select(*KEYS) if old else now.select(*KEYS)
    stale = study.keep("imu_changed", stale)
    with Scratch(spark) as keep:
        made, qc = processed(study, study.tables["manifest"].join(stale, KEYS, "left_semi"), keep)
        if old:
            qc = old["imu_qc"].join(stale, KEYS, "left_anti").join(now.select(*KEYS), KEYS, "left_semi").unionByName(qc, allowMissingColumns=True)
        qc = study.keep("imu_qc", qc)
        store.replace_parts("imu", made, KEYS)


def held(imu: DataFrame, qc: DataFrame) -> DataFrame:
    """The signals of trials that passed: folders of trials that are gone or that fail now may still be there."""
    return imu.join(qc.where("qc_status <> 'fail' and n_samples is not null").select(*KEYS), KEYS, "left_semi")


def processed(study: Study, manifest: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(signals, status) of the trials of a manifest."""
    how, spark = study.project.imu, study.spark
    raw = keep(signals.read_imu(spark, manifest, study.project), "imu-raw")
    broken = status(raw.where("error is not null"), "error")
    mapped = [s for s in SIGNALS if s in how.columns]
    quats = list(QUATERNION) if set(QUATERNION) <= set(mapped) else []
    lacks = raw.where("error is null").groupBy(*KEYS).agg(F.first("absent").alias("absent"))
    rows = raw.where("error is null").drop("error", "absent")
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("timestamp", *mapped)})
    few = status(rows.groupBy(*KEYS).agg(F.count("timestamp").alias("n")).where("n < 2").withColumn("e", F.lit("fewer than two valid timestamps")), "e")
    rows = rows.join(few.select(*KEYS), KEYS, "left_anti")
    quality = series.timestamp_quality(rows, KEYS, "timestamp", "ordinal")
    rows = keep(series.dedupe_first(rows, KEYS, "timestamp", "ordinal").select(*KEYS, "timestamp", *mapped), "imu-ordered")
    missing = series.missing_ratios(rows, KEYS, mapped)
    filled = series.fill_gaps(rows, KEYS, "timestamp", [c for c in mapped if c not in quats])
    g = how.gravity_value_m_s2
    units = {c: acceleration(F.col(c), how.input_acceleration_unit, g) for c in mapped if c in ACCELERATION} | {c: angular(F.col(c), how.input_angular_velocity_unit) for c in mapped if c in ANGULAR}
    if how.gravity_removal == "constant" and "acc_vertical" in units:
        units["acc_vertical"] = units["acc_vertical"] - g
    si = keep(filled.withColumns(units) if units else filled, "imu-units")
    limits = {c: how.maximum_abs_acceleration_m_s2 for c in mapped if c in ACCELERATION} | {c: how.maximum_abs_angular_velocity_rad_s for c in mapped if c in ANGULAR}
    odd = series.anomaly_ratios(si, KEYS, limits)
    rates = keep(series.sampling(si, KEYS, "timestamp"), "imu-rates")
    smooth = keep(kernels.lowpass(si.join(rates.select(*KEYS, "sampling_rate_hz"), KEYS), KEYS, "timestamp", list(limits), "sampling_rate_hz", how.lowpass_cutoff_hz, how.filter_order), "imu-smooth")
    notes = smooth.groupBy(*KEYS).agg(F.first("filter_note").alias("filter_note"))
    if how.lowpass_cutoff_hz >= how.target_sampling_rate_hz / 2:
        notes = notes.withColumn("filter_note", F.lit("error: cutoff is at or above half the target rate"))
    bad = notes.where("filter_note like 'error%'").select(*KEYS)
    good = smooth.join(bad, KEYS, "left_anti")
    even = series.resample_linear(good, KEYS, "timestamp", [c for c in mapped if c not in quats], how.target_sampling_rate_hz)
    if quats:
        even = even.join(series.resample_slerp(good.select(*KEYS, "timestamp", *quats), KEYS, "timestamp", quats, how.target_sampling_rate_hz).drop("timestamp"), [*KEYS, "grid_index"], "left")
    even = even.select(*[c for c in even.columns if c not in KEYS], *KEYS)
    qc = quality.join(lacks, KEYS).join(missing, KEYS).join(odd, KEYS).join(rates, KEYS).join(notes, KEYS, "left")
    far = F.abs(F.col("sampling_rate_hz") - how.target_sampling_rate_hz) > 0.01 * how.target_sampling_rate_hz
    warned = F.array_compact(F.array(
        F.when(F.col("nonmonotonic"), "timestamps were not monotonic"), F.when(F.col("n_duplicates") > 0, "duplicate timestamps were dropped"),
        F.when(F.exists(F.map_values("missing_ratio"), lambda x: x > 0), "missing values were interpolated"), F.when(F.exists(F.map_values("anomaly_ratio"), lambda x: x > 0), "values exceed the limits"),
        F.concat(F.lit("mapped columns are absent: "), "absent"), F.col("filter_note"), F.when(far, "sampling rate changed by more than 1 %"),
    ))
    verdict = F.when(F.col("filter_note").startswith("error"), "fail").when(F.size("_w") > 0, "warning").otherwise("pass")
    full = qc.withColumn("_w", warned).withColumns({"qc_status": verdict, "qc_notes": F.array_join("_w", " | ")}).drop("_w", "absent")
    absent = manifest.where("imu_path = ''").select(*KEYS, F.lit("warning").alias("qc_status"), F.lit("IMU absent").alias("qc_notes"))
    return even, full.unionByName(broken.dropDuplicates(KEYS), allowMissingColumns=True).unionByName(few, allowMissingColumns=True).unionByName(absent, allowMissingColumns=True)


def annotate(study: Study) -> None:
    """bounds: each trial's inertial extent; segments: the phases of trials whose annotations keep the rules."""
    bounds = study.keep("bounds", windows.extents(study.tables["imu"], KEYS, "timestamp"))
    read = study.keep("annotations", signals.read_annotations(study.spark, study.tables["manifest"], study.project))
    wrong = study.keep("segment_errors", signals.segment_errors(read, bounds))
    good = read.where("error is null").join(wrong.select(*KEYS), KEYS, "left_anti").join(bounds.select(*KEYS), KEYS, "left_semi")
    study.keep("segments", good.select(*KEYS, "segment_name", "start_time", "end_time", "source", "confidence", "notes"))


def synchronize(study: Study) -> None:
    """synchronization: one row for each attempted alignment. footswitch, audio: on the reference clock."""
    how, spark, manifest = study.project.synchronization, study.spark, study.tables["manifest"]
    audio = study.keep("audio_native", signals.read_audio(spark, manifest, study.project))
    foot = study.keep("footswitch_native", signals.read_footswitch(spark, manifest, study.project))
    foot_times = alignment.timelines(foot.where("error is null"), KEYS, "native_timestamp", "ordinal").unionByName(
        foot.where("error is not null").select(*KEYS, F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"), "error")
    )
    targets = signals.wav_timelines(audio).withColumn("target_modality", F.lit("audio")).unionByName(foot_times.withColumn("target_modality", F.lit("footswitch")))
    bounds = study.tables["bounds"].select(*KEYS, F.col("start_time").alias("ref_start"), F.col("end_time").alias("ref_end"))
    pairs = targets.withColumnsRenamed({"start_time": "target_start", "end_time": "target_end"}).join(bounds, KEYS, "left")
    pairs = pairs.withColumn("error", F.coalesce("error", F.when(F.col("ref_start").isNull(), "no reference timeline"), F.when(~F.col("target_modality").isin(*how.offsets_seconds), "no offset is declared")))
    choose = lambda values: F.coalesce(*[F.when(F.col("target_modality") == m, F.lit(float(v))) for m, v in values.items()], F.lit(None).cast("double"))
    done = alignment.align(pairs, choose(how.offsets_seconds), choose(how.uncertainty_seconds), how.minimum_overlap_ratio, how.maximum_duration_difference_s)
    done = done.withColumns({
        "qc_status": F.when(F.col("error").isNotNull(), "fail").otherwise(F.col("qc_status")), "qc_notes": F.coalesce("error", F.array_join("qc_notes", " | ")),
        "synchronization_method": F.lit(how.method), "operator": F.lit(how.operator),
    })
    study.keep("synchronization", done)
    offsets = lambda m: study.tables["synchronization"].where((F.col("target_modality") == m) & F.col("error").isNull()).select(*KEYS, "offset_seconds")
    study.keep("footswitch", foot.where("error is null").drop("error").join(offsets("footswitch"), KEYS).withColumn("timestamp", on_reference_clock("native_timestamp", F.col("offset_seconds"))))
    study.keep("audio", audio.drop("error").join(offsets("audio"), KEYS))


def listen(study: Study) -> None:
    how = study.project.audio
    audio = study.tables["audio"]
    shift = audio.select(*KEYS, "offset_seconds").distinct()
    frames = runs.speech_frames(audio, KEYS, how.frame_duration_ms, how.energy_threshold_dbfs)
    stable = runs.stabilize_speech(frames, KEYS, "frame", "is_speech", F.col("frame_seconds"), how.minimum_speech_duration_s, how.minimum_pause_duration_s)
    stable = study.keep("audio_frames", stable.join(shift, KEYS).withColumns({c: F.col(c) + F.col("offset_seconds") for c in ("start_time", "end_time")}).drop("offset_seconds"))
    spoken = study.keep("audio_activity", runs.activity(stable, KEYS))
    count = spoken.where("activity = 'speech'").groupBy(*KEYS).agg(F.count("*").alias("speech_segments"))
    qc = runs.clipping(audio, KEYS, how.clipping_threshold).join(count, KEYS, "left").fillna(0, ["speech_segments"])
    odd = (F.col("speech_segments") == 0) | (F.col("clipping_ratio") > 0.01)
    failed = status(study.tables["audio_native"].where("error is not null").groupBy(*KEYS).agg(F.min("error").alias("error")), "error")
    study.keep("audio_qc", qc.withColumns({"qc_status": F.when(odd, "warning").otherwise("pass"), "qc_notes": F.lit("")}).unionByName(failed, allowMissingColumns=True))
    found = features.audio_features(spoken, known(study, "audio", "bounds"), known(study, "audio", "segments"), KEYS, how.minimum_pause_duration_s, how.task_start_seconds)
    study.keep("audio_features", found)


def known(study: Study, modality: str, name: str) -> DataFrame:
    """A table's rows of trials that have the modality."""
    return study.tables[name].join(study.tables[modality].select(*KEYS).distinct(), KEYS, "left_semi")


def step(study: Study) -> None:
    """Contacts, their events and features; inertial features share the steps that are found here once."""
    how, imu = study.project.footswitch, study.project.imu
    foot = study.tables["footswitch"]
    rate = series.sampling(foot, KEYS, "timestamp").select(*KEYS, "sampling_rate_hz")
    sides = foot.join(rate, KEYS).select(*KEYS, "sampling_rate_hz", "ordinal", "timestamp", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), contact(F.col(f"{s}_contact"), how.threshold).alias("raw")) for s in ("left", "right")])).alias("x")).select("*", "x.*").drop("x")
    sides = sides.withColumn("state", F.col("raw"))
    stable = study.keep("footswitch_processed", runs.debounce(sides, [*KEYS, "side"], "ordinal", "state", F.col("sampling_rate_hz"), how.minimum_contact_duration_s, how.minimum_swing_duration_s))
    found = study.keep("footswitch_events", runs.transitions(stable, [*KEYS, "side"], "timestamp", "state"))
    qc = stable.groupBy(*KEYS).agg(F.count_if(F.col("raw") != F.col("state")).alias("changed_samples"), F.avg(F.when(F.col("side") == "left", F.col("state"))).alias("left_contact_ratio"), F.avg(F.when(F.col("side") == "right", F.col("state"))).alias("right_contact_ratio"))
    contacts = found.where("event = 'contact'").groupBy(*KEYS).agg(F.count("*").alias("contacts"))
    qc = qc.join(contacts, KEYS, "left").fillna(0, ["contacts"])
    failed = status(study.tables["footswitch_native"].where("error is not null"), "error")
    study.keep("footswitch_qc", qc.withColumns({"qc_status": F.when(F.col("contacts") == 0, "warning").otherwise("pass"), "qc_notes": F.lit("")}).unionByName(failed, allowMissingColumns=True))
    samples, segments, bounds = (study.tables[k] for k in ("imu", "segments", "bounds"))
    places, _ = features.walking_parts(segments, bounds, KEYS, True)
    steps = study.keep("imu_steps", features.found_steps(samples, places, KEYS, imu.step_min_interval_s, imu.step_prominence))
    at = [c for c in samples.columns if c not in KEYS]
    out = features.footswitch_features(found, known(study, "footswitch", "imu").select(*KEYS, *at), known(study, "footswitch", "segments"), KEYS, imu.step_min_interval_s, imu.step_prominence, how.event_matching_tolerance_s, steps)
    study.keep("footswitch_features", out)
    empty = windows.empty_windows(samples, segments, KEYS, "timestamp").groupBy(*KEYS).agg(F.min_by(F.concat(F.lit("no samples in segment "), "segment_name"), "start_time").alias("error"))
    wrong = study.keep("imu_feature_failures", empty.unionByName(study.tables["segment_errors"].select(*KEYS, "error")))
    whole = lambda df: df.join(wrong.select(*KEYS), KEYS, "left_anti")
    study.keep("imu_features", features.imu_features(whole(samples), whole(segments), KEYS, imu.step_min_interval_s, imu.step_prominence, whole(steps)))


def watch(study: Study, metadata: DataFrame | None = None, landmarks: DataFrame | None = None, frames: DataFrame | None = None) -> None:
    """Video features of probes and of pose tables that other programs made: the tables given, else the Parquet tables that
    the configuration names (a probe is the keys and its JSON text). A video without a probe is read itself, as far as its
    container tells; a trial whose video tells nothing usable fails."""
    spark, how, ids = study.spark, study.project.video, ", ".join(f"{k} string" for k in KEYS)
    stored = lambda path, schema: spark.read.parquet(study.project.resolve(path)) if path else spark.createDataFrame([], schema)
    if metadata is None:
        metadata = signals.video_metadata(stored(how.probe_table, f"{ids}, probe string"))
    landmarks = landmarks if landmarks is not None else stored(how.landmark_table, f"{LANDMARKS}, landmark_index int")
    frames = frames if frames is not None else stored(how.frame_table, FRAMES)
    if "error" not in metadata.columns:
        metadata = metadata.withColumn("error", F.lit(None).cast("string"))
    files = study.tables["files"].where("modality = 'video'").select(F.col("path").alias("video_path"), "uri")
    alone = study.tables["manifest"].join(metadata.select(*KEYS), KEYS, "left_anti").join(files, "video_path").select(*KEYS, "uri")
    metadata = study.keep("video_metadata", metadata.unionByName(containers.video_files(alone).drop("container_s"), allowMissingColumns=True))
    good = metadata.where("error is null").drop("error")
    study.keep("video_features", features.video_features(good, landmarks, frames, study.tables["segments"], study.tables["bounds"], KEYS, how.minimum_visibility))
    filmed = study.tables["manifest"].where("video_path <> ''").select(*KEYS).join(metadata.select(*KEYS, "error", F.lit(True).alias("_probed")), KEYS, "full")
    note = F.coalesce("error", F.when(F.col("_probed").isNull(), "the video isn't there"), F.lit(""))
    study.keep("video_qc", filmed.select(*KEYS, F.when(note == "", "pass").otherwise("fail").alias("qc_status"), note.alias("qc_notes")))


def fuse(study: Study) -> None:
    project = study.project
    chosen = {m: study.tables[f"{m}_features"] for m in ("imu", "audio", "video", "footswitch") if m in project.fusion.modalities}
    clinical = None
    if "clinical" in project.fusion.modalities and (tables := signals.read_clinical(study.spark, study.tables["manifest"], project)):
        clinical = fusion.clinical_table(tables)
    fused = study.keep("multimodal_features", fusion.fuse(study.tables["manifest"], chosen, KEYS, clinical))
    study.keep("feature_inventory", fusion.inventory(fused))
    how = project.dual_task_cost
    if how.enabled:
        costs, skipped = fusion.dual_task_costs(fused, how.group_columns, how.single_condition, how.dual_condition, how.metrics)
        study.keep("dual_task_costs", costs)
        study.keep("dual_task_skipped", skipped)


def model(study: Study) -> None:
    how = study.project.modeling
    setting = modeling.Baseline(how.task_type, how.target_column, how.group_column, how.folds, how.random_seed, how.models, how.cohort_modes, how.positive_label)
    found = modeling.evaluate(study.tables["multimodal_features"], study.project.fusion.feature_sets, setting, KEYS)
    for name in ("predictions", "fold_metrics", "summary", "split_audit", "skipped"):
        study.keep(f"modeling_{name}", found[name])
    study.successes = found["successful"]


def metadata(study: Study) -> str:
    """What the evaluation was asked for and what came of it, as JSON."""
    how = asdict(study.project.modeling) | {"feature_sets": study.project.fusion.feature_sets, "successful_evaluations": study.successes}
    return json.dumps(how, indent=2, sort_keys=True, default=str)


EXPORTS = {
    "imu_qc": "qc/imu_preprocessing", "synchronization": "qc/synchronization", "audio_qc": "qc/audio", "footswitch_qc": "qc/footswitch", "video_qc": "qc/video", "video_metadata": "qc/video_metadata",
    "imu_features": "features/imu_features", "audio_features": "features/audio_features", "footswitch_features": "features/footswitch_features", "video_features": "features/video_features",
    "imu_feature_failures": "features/imu_feature_failures", "segment_errors": "qc/annotation_errors", "multimodal_features": "features/multimodal_features", "feature_inventory": "features/feature_inventory", "dual_task_costs": "features/dual_task_costs",
    "modeling_predictions": "modeling/predictions", "modeling_fold_metrics": "modeling/fold_metrics", "modeling_summary": "modeling/summary", "modeling_split_audit": "modeling/split_audit", "modeling_skipped": "modeling/skipped",
}


#: The rows of a table that are failures; an alignment that is done and misses a limit isn't one.
FAILED = {name: "qc_status = 'fail'" for name in ("imu_qc", "audio_qc", "footswitch_qc", "video_qc")} | dict.fromkeys(("segment_errors", "synchronization", "imu_feature_failures"), "error is not null")


def failures(study: Study, names: tuple[str, ...] = tuple(FAILED)) -> int:
    """How many failures the named tables, where they are there, have recorded."""
    return sum(study.tables[n].where(FAILED[n]).count() for n in names if n in study.tables)


def export(study: Study) -> None:
    """The tables there are; the folder of one that isn't there any more goes. Each trial's alignments are a line of JSON in
    a folder of its own."""
    folder = study.project.resolve(study.project.output_dir)
    if "synchronization" in study.tables:
        done = study.tables["synchronization"]
        told = F.to_json(F.array_sort(F.collect_list(F.struct("target_modality", *[c for c in done.columns if c not in (*KEYS, "target_modality")])))).alias("value")
        done.groupBy(*KEYS).agg(told).write.mode("overwrite").partitionBy(*KEYS).text(f"{folder}/synchronization")
    for name, path in EXPORTS.items():
        if name in study.tables:
            study.export(name, path)
        elif name == "dual_task_costs" and "multimodal_features" in study.tables:
            remove(study.spark, f"{folder}/{path}")
    if "modeling_summary" in study.tables:
        write_small(study.spark, f"{folder}/modeling/metadata.json", metadata(study))


@dataclass(frozen=True)
class Stage:
    """A stage's function, and what it reads: sections of the configuration, files of modalities, and tables of other stages."""

    run: Callable[[Study], object]
    sections: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


STAGES = {
    "preprocess": Stage(preprocess, ("imu",), ("imu",)),
    "annotate": Stage(annotate, (), ("annotation",), ("preprocess",)),
    "synchronize": Stage(synchronize, ("synchronization", "audio", "footswitch"), ("audio", "footswitch"), ("annotate",)),
    "listen": Stage(listen, ("audio",), (), ("annotate", "synchronize")),
    "step": Stage(step, ("footswitch", "imu"), (), ("preprocess", "annotate", "synchronize")),
    "watch": Stage(watch, ("video",), ("video",), ("annotate",)),
    "fuse": Stage(fuse, ("fusion", "dual_task_cost"), ("clinical",), ("listen", "step", "watch")),
    "model": Stage(model, ("modeling", "fusion"), (), ("fuse",)),
}


def wanted(study: Study, name: str) -> str:
    """The fingerprint that a stage's tables have if they are current. Tables that the configuration names count by their
    files; tables that a caller gives make a stage run."""
    stage, t = STAGES[name], study.tables
    read = digest(t["files"].where(F.col("modality").isin(*stage.files)), ["modality", "path", "length", "modified"]) if stage.files else ""
    rows = digest(t["manifest"], [*KEYS, *[f"{m}_path" for m in stage.files]])
    extra = [study.project.resolve(p) for p in (study.project.video.probe_table, study.project.video.landmark_table, study.project.video.frame_table) if p] if name == "watch" else []
    extra = digest(study.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(extra), ["path", "length", "modificationTime"]) if extra else ""
    return fingerprint(name, [asdict(getattr(study.project, s)) for s in stage.sections], rows, read, extra, [study.prints[a] for a in stage.after])


def reuse(study: Study, name: str) -> bool:
    """Takes over a stage's stored tables if they are current."""
    study.prints[name] = wanted(study, name)
    marker = study.store.marker(name)
    if not marker or marker["fingerprint"] != study.prints[name]:
        return False
    take(study, name, study.store.tables(marker["tables"]), marker)
    return True


def take(study: Study, name: str, tables: dict[str, DataFrame], marker: dict) -> None:
    study.tables |= tables
    if name == "preprocess":
        study.tables["imu"] = held(tables["imu"], tables["imu_qc"])
    if "successes" in marker:
        study.successes = marker["successes"]


def perform(study: Study, name: str, function: Callable[[Study], object] | None = None) -> None:
    """Makes a stage's tables, unless they are current and no other function is given."""
    if reuse(study, name) and not function:
        return
    marker = study.store.marker(name)
    study.before = study.store.tables(marker["tables"]) if marker else {}
    study.store.begin(name)
    (function or STAGES[name].run)(study)
    if function:  # what it was given has no fingerprint
        study.prints[name] = uuid.uuid4().hex
    more = {"successes": study.successes} if name == "model" else {}
    take(study, name, study.store.end(name, study.prints[name], marker, **more), more)
    study.ran.append(name)


def load(spark: SparkSession, project: Project, check_files: bool = True) -> Study:
    """A study with its manifest and the listing of its files, or an error that names all that is wrong with it."""
    manifest, issues = manifests.validate(spark, project, check_files)
    wrong = issues.where("severity = 'error'")
    if n := wrong.count():
        raise ValueError("\n".join([f"manifest has {n} errors:", *(f"row {r.row_number}: {r.message}" for r in wrong.orderBy("row_number", "code", "message").toLocalIterator())]))
    study = Study(spark, project)
    study.tables["manifest"] = materialize(manifest, "manifest")
    study.tables["files"] = materialize(manifests.declared_files(spark, manifest, project).where("uri is not null"), "files")
    return study


#: The stages of a whole run but for modelling, in order.
ORDER = ("preprocess", "annotate", "synchronize", "listen", "step", "watch", "fuse")


def run_all(spark: SparkSession, project: Project, metadata: DataFrame | None = None, landmarks: DataFrame | None = None, frames: DataFrame | None = None) -> Study:
    study = load(spark, project)
    given = metadata is not None or landmarks is not None or frames is not None
    for name in ORDER:
        perform(study, name, (lambda s: watch(s, metadata, landmarks, frames)) if given and name == "watch" else None)
    if project.modeling.enabled:
        perform(study, "model")
    export(study)
    return study
