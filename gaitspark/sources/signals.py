"""Trials' files as long tables keyed by trial. A file that can't be read is a row with an error, never a failed job."""

from __future__ import annotations

import dataclasses
import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Project
from ..functions import numerics
from ..functions.expressions import finite, frame_rate, number, usable
from ..schemas import SIGNALS, TRIAL_KEYS
from ..session import ensure_importable
from .containers import opened
from .manifest import declared_files


class UnsupportedFormat(ValueError):
    """The format has no reader here."""


def files(spark: SparkSession, manifest: DataFrame, modality: str, project: Project) -> DataFrame:
    """(trial keys, content): the bytes of each trial's file."""
    found = declared_files(spark, manifest, project).where((F.col("modality") == modality) & F.col("uri").isNotNull()).select("path", "uri")
    uris = [r[0] for r in found.select("uri").distinct().collect()]  # names, for one read of all of them
    keyed = manifest.where(F.col(f"{modality}_path") != "").select(*TRIAL_KEYS, F.col(f"{modality}_path").alias("path")).join(found, "path")
    if not uris:
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in TRIAL_KEYS) + ", content binary")
    data = spark.read.format("binaryFile").load(uris).select(F.col("path").alias("uri"), "content")
    return keyed.join(data, "uri").select(*TRIAL_KEYS, "content")


def parsed(rows: DataFrame, columns: str, parse: Callable[[bytes], pd.DataFrame]) -> DataFrame:
    """(trial keys, ordinal, columns, error): parse makes a frame of a file's bytes; a ValueError becomes the error."""
    ensure_importable(rows.sparkSession)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                keys = {k: getattr(row, k) for k in TRIAL_KEYS}
                try:
                    out = parse(bytes(row.content))
                    out = out.reindex(columns=names).assign(ordinal=np.arange(len(out)), error=None)
                except (ValueError, KeyError, UnicodeError) as e:
                    out = pd.DataFrame([dict.fromkeys(names) | {"ordinal": -1, "error": str(e)}], dtype=object)
                yield out.assign(**keys)[[*TRIAL_KEYS, "ordinal", *names, "error"]]

    return rows.mapInPandas(run, ", ".join(f"{k} string" for k in TRIAL_KEYS) + f", ordinal long, {columns}, error string")


def csv(content: bytes) -> pd.DataFrame:
    out = pd.read_csv(io.BytesIO(content), dtype=str, encoding="utf-8-sig", keep_default_na=False)
    return out.rename(columns=str.strip)


def numbers(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.apply(pd.to_numeric, errors="coerce").astype(float)


def imu_parser(fmt: str, columns: dict[str, str], sensor: str) -> Callable[[bytes], pd.DataFrame]:
    """Wide: a column a signal. Long: rows of several sensors, of which one is kept. The timestamp column must be there;
    other mapped columns may be absent, but not all."""
    if fmt == "mvnx":
        raise UnsupportedFormat("MVNX is not read directly: export the sensor's signals as wide or long CSV")

    def parse(content: bytes) -> pd.DataFrame:
        raw = csv(content)
        if columns["timestamp"] not in raw:
            raise ValueError(f"timestamp column {columns['timestamp']} is missing")
        if fmt == "long_csv":
            name = columns.get("sensor_name", "sensor_name")
            if name not in raw:
                raise ValueError(f"sensor column {name} is missing")
            raw = raw[raw[name].str.strip() == sensor]
            if raw.empty:
                raise ValueError(f"no rows of sensor {sensor}")
        found = {k: v for k, v in columns.items() if k not in ("timestamp", "sensor_name") and v in raw and k in SIGNALS}
        if not found:
            raise ValueError("no mapped signal column is present")
        out = numbers(raw[[columns["timestamp"], *found.values()]])
        out.columns = ["timestamp", *found]
        lacking = sorted(v for k, v in columns.items() if k in SIGNALS and v not in raw)
        return out.assign(absent=", ".join(lacking) if lacking else None)

    return parse


def read_imu(spark: SparkSession, manifest: DataFrame, project: Project) -> DataFrame:
    """(trial keys, ordinal, timestamp, signals, absent, error): absent names the mapped columns that the file lacks."""
    how = project.imu
    rows = parsed(files(spark, manifest, "imu", project), "timestamp double, " + ", ".join(f"{s} double" for s in SIGNALS) + ", absent string", imu_parser(how.format, how.columns, how.target_sensor))
    return rows


def read_footswitch(spark: SparkSession, manifest: DataFrame, project: Project) -> DataFrame:
    how = project.footswitch
    time = project.synchronization.timestamp_columns.get("footswitch", "timestamp")
    wanted = {"native_timestamp": time, "left_contact": how.left_contact_column, "right_contact": how.right_contact_column}

    def parse(content: bytes) -> pd.DataFrame:
        raw = csv(content)
        if missing := [c for c in wanted.values() if c not in raw]:
            raise ValueError(f"footswitch columns are missing: {', '.join(missing)}")
        out = numbers(raw[list(wanted.values())])
        out.columns = list(wanted)
        if out.isna().any(axis=None):
            raise ValueError("footswitch signals have values that aren't numbers")
        if len(out) < 2 or (out["native_timestamp"].diff() < 0).any():
            raise ValueError("footswitch timestamps are too few or decrease")
        return out

    return parsed(files(spark, manifest, "footswitch", project), "native_timestamp double, left_contact double, right_contact double", parse)


def read_annotations(spark: SparkSession, manifest: DataFrame, project: Project) -> DataFrame:
    def parse(content: bytes) -> pd.DataFrame:
        raw = csv(content)
        if missing := [c for c in ("segment_name", "start_time", "end_time") if c not in raw]:
            raise ValueError(f"annotation columns are missing: {', '.join(missing)}")
        out = raw.reindex(columns=["segment_name", "start_time", "end_time", "source", "confidence", "notes"])
        out["segment_name"] = out["segment_name"].str.strip()
        for c in ("start_time", "end_time", "confidence"):
            out[c] = pd.to_numeric(out[c], errors="coerce")
        return out

    rows = parsed(files(spark, manifest, "annotation", project), "segment_name string, start_time double, end_time double, source string, confidence double, notes string", parse)
    return rows.withColumnsRenamed({"ordinal": "segment_ordinal"})


def segment_errors(segments: DataFrame, bounds: DataFrame, keys: list[str] = TRIAL_KEYS, tolerance: float = 1e-6) -> DataFrame:
    """(keys, error) of trials whose phases break a rule: a name, start before end, inside the trial, confidence in 0..1."""
    b = bounds.select(*keys, F.col("start_time").alias("_a"), F.col("end_time").alias("_b"))
    joined = segments.join(b, keys, "left")
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.coalesce("segment_name", F.lit("")) == "", "segment name is blank")
        .when(F.col("start_time").isNull() | F.col("end_time").isNull(), "segment bounds are not numbers")
        .when(F.col("start_time") >= F.col("end_time"), "segment start is not before its end")
        .when((F.col("start_time") < F.col("_a") - tolerance) | (F.col("end_time") > F.col("_b") + tolerance), "segment is outside the trial")
        .when(~F.col("confidence").between(0, 1), "confidence is not between 0 and 1")
    )
    return joined.withColumn("error", error).where("error is not null").groupBy(*keys).agg(F.min_by("error", "segment_ordinal").alias("error"))


#: Samples at the target rate that one row of audio holds.
AUDIO_BLOCK = 1 << 18


def read_audio(spark: SparkSession, manifest: DataFrame, project: Project, block: int = AUDIO_BLOCK) -> DataFrame:
    """(trial keys, sampling_rate, original_rate, n_samples, first_sample, samples, error): mono waveforms at the target
    rate, in blocks. WAV only; other containers need a decoder that isn't here, and get an error.

    Headers are read first. Each block's task then reads its own range of the file, and as much on either side as the
    resampling filter reaches, so that blocks meet without a seam and no row or task holds a recording.
    """
    rate_to = project.audio.target_sampling_rate_hz
    found = declared_files(spark, manifest, project).where("modality = 'audio' and uri is not null").select(F.col("path").alias("audio_path"), "uri")
    rows = manifest.select(*TRIAL_KEYS, "audio_path").join(found, "audio_path").select(*TRIAL_KEYS, "uri")
    ensure_importable(spark)
    fields = [f.name for f in dataclasses.fields(numerics.Wav)]
    ids = ", ".join(f"{k} string" for k in TRIAL_KEYS)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = []
            for uri in pdf["uri"]:
                try:
                    with opened(uri) as f:
                        how = numerics.wav_header(f, f.size())
                    if not how.frames:
                        raise ValueError("audio is empty")
                    told.append({**dataclasses.asdict(how), "n_samples": numerics.resampled_length(how.frames, how.rate, rate_to)})
                except (ValueError, OSError, struct.error) as e:
                    told.append({"error": str(e)})
            made = pd.DataFrame(told, index=pdf.index).reindex(columns=[*fields, "n_samples", "error"])
            yield pd.concat([pdf, made.astype(object).where(made.notna(), None)], axis=1)

    head = rows.mapInPandas(heads, f"{ids}, uri string, rate int, channels int, bits int, floats boolean, at long, frames long, n_samples long, error string")
    starts = F.explode(F.when(F.col("error").isNull(), F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1, F.lit(block).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    spread = head.withColumn("first_sample", starts).repartition("uri", "first_sample")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = {k: [getattr(row, k)] for k in TRIAL_KEYS} | {"sampling_rate": [rate_to], "original_rate": [row.rate], "n_samples": [row.n_samples], "first_sample": [row.first_sample], "samples": [None], "error": [row.error]}
                if row.error is None:
                    how = numerics.Wav(*[t(getattr(row, c)) for c, t in zip(fields, (int, int, int, bool, int, int))])
                    lo, hi = int(row.first_sample), int(min(row.first_sample + block, row.n_samples))
                    a, b = numerics.needed(lo, hi, how.frames, how.rate, rate_to)
                    try:
                        with opened(row.uri) as f:
                            x = numerics.mono(numerics.wav_samples(f, how, a, b))
                        out["samples"] = [numerics.polyphase(x, how.rate, rate_to, lo, hi, a)]
                    except (ValueError, OSError) as e:
                        out["error"] = [str(e)]
                yield pd.DataFrame(out)

    # numbers that an unreadable header leaves out are NULL, never NaN
    spread = spread.fillna(0, ["rate", "channels", "bits", "at", "frames", "n_samples"]).fillna(False, ["floats"])
    blocks = spread.mapInPandas(read, f"{ids}, sampling_rate int, original_rate int, n_samples long, first_sample long, samples array<double>, error string")
    return blocks.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("original_rate", "n_samples")})


def wav_timelines(audio: DataFrame, keys: list[str] = TRIAL_KEYS) -> DataFrame:
    """(keys, start_time, end_time, error) of each recording; an error of any block is one of the recording."""
    return audio.groupBy(*keys).agg(F.lit(0.0).alias("start_time"), F.max(F.col("n_samples") / F.col("sampling_rate")).alias("end_time"), F.min("error").alias("error"))


def read_clinical(spark: SparkSession, manifest: DataFrame, project: Project) -> list[DataFrame]:
    """The distinct clinical tables that trials name, one for each kind of header; numeric columns become numbers, ids stay
    strings. Files are grouped by their first line, so there is one read and one inference a header, not a file."""
    found = declared_files(spark, manifest, project).where("modality = 'clinical' and uri is not null").select("uri").distinct()
    uris = [r[0] for r in found.collect()]
    if not uris:
        return []
    lines = spark.read.text(uris).select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at"))
    heads = lines.where("start = 0").groupBy("uri").agg(F.min_by("value", "at").alias("header"))
    groups = heads.groupBy("header").agg(F.collect_list("uri").alias("uris")).orderBy("header").collect()
    out = []
    for _, members in groups:
        kinds = spark.read.option("header", True).option("inferSchema", True).csv(members).schema
        # read again with ids as text: a number would lose its leading zeros
        named = ", ".join(f"`{f.name}` {'string' if f.name == 'participant_id' else f.dataType.simpleString()}" for f in kinds)
        out.append(spark.read.option("header", True).schema(named).csv(members))
    return out


def video_metadata(probes: DataFrame, text: str = "probe") -> DataFrame:
    """probes with duration_s, frame_rate_hz, total_frames, width_pixels, height_pixels, codec, frames_estimated and error,
    from the JSON text of a media probe. The first stream's duration comes before the container's, its average rate before
    the nominal one; a missing frame count is duration times rate, rounded half to even."""
    stream = ", ".join(f"{c}: string" for c in ("duration", "avg_frame_rate", "r_frame_rate", "nb_frames", "width", "height", "codec_name"))
    j = F.from_json(F.col(text), f"streams array<struct<{stream}>>, format struct<duration: string>")
    out = probes.withColumn("_j", j).withColumn("_s", F.get("_j.streams", F.lit(0)))
    s = lambda c: F.col(f"_s.{c}")
    over_zero = lambda x: F.when(x > 0, x)
    out = out.withColumns({
        "duration_s": over_zero(finite(number(usable(s("duration"), F.col("_j.format.duration"))))),
        "frame_rate_hz": frame_rate(usable(s("avg_frame_rate"), s("r_frame_rate"))),
        "width_pixels": over_zero(number(s("width")).cast("int")),
        "height_pixels": over_zero(number(s("height")).cast("int")),
        "codec": s("codec_name"),
    })
    frames = over_zero(number(usable(s("nb_frames"))).cast("long"))
    out = out.withColumns({"total_frames": F.coalesce(frames, F.bround(F.col("duration_s") * F.col("frame_rate_hz")).cast("long")), "frames_estimated": frames.isNull()})
    error = F.when(F.col("_s").isNull(), "no video stream").when(F.col("duration_s").isNull(), "no positive duration").when(F.col("frame_rate_hz").isNull(), "no positive frame rate").when(F.col("width_pixels").isNull() | F.col("height_pixels").isNull(), "no frame size")
    return out.withColumn("error", error).drop("_j", "_s", text)
