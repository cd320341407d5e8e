"""The made-up study end to end: counts and values that the study must give."""

import json
import struct
import wave

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from gaitspark import cli
from gaitspark.config import ConfigurationError, build, load_config
from gaitspark.operators import runs
from gaitspark.plans import project as stages
from gaitspark.plans.report import report
from gaitspark.session import materialize
from gaitspark.sources import containers, manifest, signals
from gaitspark.sources.synthetic import write_study

CONFIG = {
    "project": {"name": "demo", "root": "."},
    "paths": {"manifest": "study/participants.csv", "processed_dir": "processed", "output_dir": "outputs"},
    "imu": {
        "columns": {
            "timestamp": "timestamp", "acc_ap": "pelvis_acc_ap", "acc_ml": "pelvis_acc_ml", "acc_vertical": "pelvis_acc_vertical", "gyro_yaw": "pelvis_gyro_yaw",
            "quat_w": "quat_w", "quat_x": "quat_x", "quat_y": "quat_y", "quat_z": "quat_z",
        },
        "gravity_removal": "constant",
    },
    "synchronization": {"offsets_seconds": {"audio": 0.0, "footswitch": 0.0}, "uncertainty_seconds": {"audio": 0.0, "footswitch": 0.0}},
    "dual_task_cost": {"enabled": True, "metrics": {"imu__cadence_steps_min": "higher_is_better", "footswitch__mean_step_time_s": "higher_is_worse"}},
}


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("demo")
    write_study(f"{folder}/study")
    (folder / "config.yaml").write_text(yaml.safe_dump(CONFIG))
    return stages.run_all(spark, load_config(str(folder / "config.yaml")))


def test_counts(study):
    n = {k: df.count() for k, df in study.tables.items()}
    assert (n["imu_features"], n["audio_features"], n["footswitch_features"], n["video_features"]) == (16, 16, 16, 0)
    assert (n["multimodal_features"], n["dual_task_costs"], n["synchronization"]) == (2, 1, 4)
    for name in ("imu_qc", "audio_qc", "footswitch_qc", "synchronization"):
        assert {r.qc_status for r in study.tables[name].collect()} == {"pass"}, name


def test_golden_values(study):
    foot = {(r.trial_id, r.segment_name): r for r in study.tables["footswitch_features"].collect()}
    single, dual = foot["T01", "full_trial"], foot["T02", "full_trial"]
    assert (single.footswitch__left_contact_count, single.footswitch__right_contact_count) == (10, 8)
    assert single.footswitch__mean_step_time_s == pytest.approx(0.55625) and dual.footswitch__mean_step_time_s == pytest.approx(0.661429, abs=1e-6)
    assert single.footswitch__stance_time_asymmetry_pct == pytest.approx(0.749064, abs=1e-6)
    assert single.footswitch__imu_event_agreement_f1 == dual.footswitch__imu_event_agreement_f1 == 1.0
    assert single.footswitch__imu_event_mean_abs_error_s < 0.01
    imu = {(r.trial_id, r.segment_name): r for r in study.tables["imu_features"].collect()}
    assert imu["T01", "full_trial"].imu__cadence_steps_min == pytest.approx(108) and imu["T02", "full_trial"].imu__cadence_steps_min == pytest.approx(96)
    assert imu["T01", "turn_1"].imu__turn_duration_s == 2.0 and imu["T01", "baseline_sitting"].imu__step_count is None
    cost = study.tables["dual_task_costs"].first()
    assert cost.dtc__imu_cadence_steps_min_pct == pytest.approx(11.111, abs=1e-3) and cost.dtc__footswitch_mean_step_time_s_pct == pytest.approx(18.909, abs=1e-3)
    speech = study.tables["audio_activity"].where("activity = 'speech'").groupBy("trial_id").count().collect()
    assert {r["count"] for r in speech} == {4}


def test_stages_are_read_again(spark, tmp_path, monkeypatch):
    """A command after run-all reads stored tables, not raw files, and the report shows stored models; a change of a file
    or of a section runs the stages that read it, of one trial only that trial."""
    cost = CONFIG["dual_task_cost"]
    run = made(tmp_path, modeling={"enabled": True, "target_column": "clinical__moca", "folds": 2, "models": ["ridge"]}, people=4)
    raw = []
    read = signals.files
    monkeypatch.setattr(signals, "files", lambda *a: raw.append(a[2]) or read(*a))
    listen = signals.read_audio
    monkeypatch.setattr(signals, "read_audio", lambda *a: raw.append("audio") or listen(*a))
    assert run(spark, "run-all") == 0
    assert set(raw) == {"imu", "annotation", "audio", "footswitch"}
    parts = {p: p.stat().st_mtime_ns for p in (tmp_path / "processed/imu.parquet").rglob("*.parquet")}
    assert len({p.parent for p in parts}) == 8
    raw.clear()
    (tmp_path / "outputs/research_summary.md").unlink()
    assert run(spark, "generate-report") == 0 and raw == []
    text = (tmp_path / "outputs/research_summary.md").read_text()
    assert "evaluations of 1 models" in text and json.loads((tmp_path / "outputs/modeling/metadata.json").read_text())["successful_evaluations"] == 1
    assert run(spark, "run-baselines") == 0 and run(spark, "fuse-features") == 0 and raw == []
    # the cost is switched off: its export goes, and nothing before fusion runs
    assert (tmp_path / "outputs/features/dual_task_costs").exists()
    config = yaml.safe_load((tmp_path / "config.yaml").read_text())
    (tmp_path / "config.yaml").write_text(yaml.safe_dump(config | {"dual_task_cost": cost | {"enabled": False}}))
    assert run(spark, "fuse-features") == 0 and raw == []
    assert not (tmp_path / "outputs/features/dual_task_costs").exists() and not (tmp_path / "processed/dual_task_costs.parquet").exists()
    # one trial's signal changes
    path = tmp_path / "study/P002/S01/T01/imu.csv"
    lines = path.read_text().splitlines()
    path.write_text("\n".join(lines[:-100]) + "\n")
    assert run(spark, "preprocess") == 0 and raw == ["imu"]
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "processed/imu.parquet").rglob("*.parquet")}
    assert {p.parent for p in set(parts.items()) ^ set(now.items()) for p in [p[0]]} == {tmp_path / "processed/imu.parquet/participant_id=P002/session_id=S01/trial_id=T01/condition=single_task"}
    # it breaks, and its old signals aren't taken for current
    path.write_text("nothing\n")
    assert run(spark, "preprocess") == 1
    s = stages.load(spark, load_config(str(tmp_path / "config.yaml")))
    assert stages.reuse(s, "preprocess") and s.tables["imu"].select(*stages.KEYS).distinct().count() == 7
    # a run that breaks leaves no stage that is taken for current
    s.store.begin("preprocess")
    assert not stages.reuse(s, "preprocess")


def test_manifest_in_splits_and_odd_paths(spark, tmp_path):
    """Row numbers of a manifest that is read in several splits; paths spelt in several ways; clinical files by header."""
    folder = tmp_path / "many"
    rows = [f"P{i:04d},S,single_task,T,{'deep/../' if i % 2 else './'}a/{i}.csv,,,,,{'one' if i % 3 else 'two'}{i % 5}.csv" for i in range(3000)]
    (tmp_path / "manifest.csv").write_text("\n".join([",".join(manifest.MANIFEST), *rows]) + "\n")
    (folder / "a").mkdir(parents=True)
    for i in range(0, 3000, 100):
        (folder / f"a/{i}.csv").write_text("x")
    for i in range(4):
        (folder / f"one{i}.csv").write_text(f"participant_id,age\n00{i},{70 + i}\n")
        (folder / f"two{i}.csv").write_text(f"participant_id,moca,sex\n10{i},{i},f\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        read = manifest.read_manifest(spark, str(tmp_path / "manifest.csv"))
        assert read.rdd.getNumPartitions() > 3
        numbers = {r.participant_id: r.row_number for r in read.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbers == {f"P{i:04d}": i + 2 for i in range(3000)}
    project = build(CONFIG | {"project": {"root": "many"}}, base=str(tmp_path))
    found = manifest.declared_files(spark, read, project).groupBy("modality").agg(F.count("uri").alias("there"), F.count("*").alias("n")).collect()
    assert {r.modality: (r.there, r.n) for r in found} == {"imu": (30, 3000), "clinical": (8, 10)}
    tables = signals.read_clinical(spark, read, project)
    assert sorted((sorted(t.columns), t.count()) for t in tables) == [(["age", "participant_id"], 4), (["moca", "participant_id", "sex"], 4)]
    assert {r.participant_id for t in tables for r in t.collect()} == {f"{k}0{i}" for k in (0, 1) for i in range(4)}


def test_audio_in_blocks(spark, tmp_path):
    """Blocks of a recording meet without a seam, whatever their size; frames and clipping don't depend on it; a broken file
    is one error."""
    rng = np.random.default_rng(3)
    for name, rate, channels in (("cd", 44_100, 2), ("same", 16_000, 1), ("low", 8_000, 1)):
        with wave.open(f"{tmp_path}/{name}.wav", "wb") as f:
            f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
            f.writeframes(rng.integers(-32768, 32767, rate * channels, dtype=np.int16).tobytes())
    (tmp_path / "text.wav").write_text("no sound")
    (tmp_path / "song.mp3").write_text("no decoder")
    (tmp_path / "cut.wav").write_bytes((tmp_path / "same.wav").read_bytes()[:20_044])
    with wave.open(f"{tmp_path}/empty.wav", "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000)
    names = ["cd", "same", "low", "text", "song", "cut", "empty", "gone"]
    rows = [("P", "S", n, "c", f"{n}.mp3" if n == "song" else f"{n}.wav") for n in names]
    table = spark.createDataFrame([(*r, "", "", "", "", "") for r in rows], ", ".join(f"{c} string" for c in [*stages.KEYS, "audio_path", "imu_path", "video_path", "footswitch_path", "annotation_path", "clinical_path"]))
    project = build(CONFIG, base=str(tmp_path))
    whole, parts = (materialize(signals.read_audio(spark, table, project, block), "audio") for block in (1 << 18, 777))
    assert parts.agg(F.max(F.size("samples"))).first()[0] == 777 and parts.count() > 50
    join = lambda df: {t: np.concatenate([r.samples for r in sorted(rs, key=lambda r: r.first_sample)]) for t in names if (rs := df.where((F.col("trial_id") == t) & F.col("error").isNull()).collect())}
    a, b = join(whole), join(parts)
    assert set(a) == set(b) == {"cd", "same", "low", "cut"} and all(np.abs(a[t] - b[t]).max() < 1e-12 for t in a) and [len(a[t]) for t in ("cd", "same", "low", "cut")] == [16_000, 16_000, 16_000, 10_000]
    frames = lambda df: [(r.trial_id, r.frame, r.end_time, round(r.rms, 12)) for r in runs.speech_frames(df, stages.KEYS, 30.0, -35.0).orderBy("trial_id", "frame").collect()]
    assert frames(whole) == frames(parts) and len(frames(whole)) == 3 * 34 + 21
    loud = lambda df: {r.trial_id: r.clipping_ratio for r in runs.clipping(df.where("error is null"), stages.KEYS, 0.9).collect()}
    assert loud(whole) == loud(parts) and loud(whole)["same"] == pytest.approx(np.mean(np.abs(a["same"]) >= 0.9))
    times = {r.trial_id: (r.end_time, r.error) for r in signals.wav_timelines(parts).collect()}
    assert times["cd"] == (1.0, None) and times["cut"] == (0.625, None) and times["text"][1] == times["song"][1] == "not a RIFF WAVE file" and times["empty"][1] == "audio is empty" and "gone" not in times


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def mp4(frames=250, delta=512, scale=12800, size=(640, 480), kind=b"vide", late=True, version=0):
    head = lambda units: bytes([version]) + bytes(3) + (struct.pack(">QQIQ", 0, 0, scale, units) if version else struct.pack(">IIII", 0, 0, scale, units)) + bytes(8)
    stsd = box(b"stsd", struct.pack(">II", 0, 1), box(b"avc1", bytes(24), struct.pack(">HH", *size), bytes(50)))
    table = box(b"stbl", stsd, box(b"stts", struct.pack(">IIII", 0, 1, frames, delta)))
    other = box(b"trak", box(b"mdia", box(b"mdhd", head(9)), box(b"hdlr", bytes(8), b"soun", bytes(12))))
    track = box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", size[0] << 16, size[1] << 16)), box(b"mdia", box(b"mdhd", head(frames * delta)), box(b"hdlr", bytes(8), kind, bytes(12)), box(b"minf", table)))
    moov = box(b"moov", box(b"mvhd", head(frames * delta)), other, track)
    media = box(b"mdat", bytes(5000), wide=True)
    return box(b"ftyp", b"isom", bytes(4)) + (media + moov if late else moov + media)


def avi(frames=100, rate=(1, 25), size=(320, 240)):
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    avih = chunk(b"avih", struct.pack("<10I", 40000, 0, 0, 0, frames, 0, 1, 0, *size) + bytes(16))
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", b"vids" + b"MJPG" + struct.pack("<IIIIIIII", 0, 0, 0, *rate, 0, frames, 0) + bytes(16)))
    hdrl = b"hdrl" + avih + strl
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"movi" + bytes(300))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_containers(spark, tmp_path):
    made = {
        "late.mp4": mp4(), "early.MOV": mp4(late=False, version=1), "plain.avi": avi(), "ntsc.mp4": mp4(300, 1001, 30000), "empty.mp4": b"", "cut.mp4": mp4()[:-40], "sound.mp4": mp4(kind=b"soun"), "small.mp4": mp4(size=(0, 0)), "cut.avi": avi()[:60], "text.avi": b"hello" * 20, "clip.mkv": mp4(), "still.mp4": mp4(frames=0),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    rows = spark.createDataFrame([(n, f"file:{tmp_path}/{n}") for n in [*made, "gone.mp4"]], "name string, uri string")
    got = {r.name: r for r in containers.video_files(rows).collect()}
    told = lambda n: (got[n].duration_s, got[n].frame_rate_hz, got[n].total_frames, got[n].width_pixels, got[n].height_pixels, got[n].codec, got[n].error)
    assert told("late.mp4") == told("early.MOV") == (10.0, 25.0, 250, 640, 480, "avc1", None)
    assert told("plain.avi") == (4.0, 25.0, 100, 320, 240, "mjpg", None) and got["ntsc.mp4"].frame_rate_hz == pytest.approx(30000 / 1001)
    errors = {n: r.error for n, r in got.items() if r.error}
    assert set(errors) == set(made) - {"late.mp4", "early.MOV", "plain.avi", "ntsc.mp4"} | {"gone.mp4"}
    assert errors["clip.mkv"].startswith(".mkv is not one of") and errors["sound.mp4"] == errors["still.mp4"] == "no positive duration" and errors["small.mp4"] == "no frame size" and errors["empty.mp4"] == "there is no index"


def test_report_has_no_ids(study):
    text = report(study)
    assert text == report(study) and "P001" not in text and "/study/" not in text
    assert "| Inertial signals | 2 | 2 | 0 | 0 | 2 | 14 |" in text and "| Clock alignment | 4 | 4 | 0 | 0 | – | – |" in text
    assert "| all | 2 | 1 | 2 | 0 | 2 | 2 | 2 | 2 |" in text and "No models were evaluated" in text


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["generate-synthetic", "--output", str(tmp_path / "study")]) == 0
    (tmp_path / "config.yaml").write_text(yaml.safe_dump(CONFIG))
    assert cli.main(["validate-manifest", "--config", str(tmp_path / "config.yaml")], spark) == 0
    assert capsys.readouterr().out.count("video is absent") == 2
    manifest = tmp_path / "study/participants.csv"
    lines = manifest.read_text().splitlines()
    manifest.write_text("\n".join([*lines, lines[1], lines[2].replace("dual_task", "nonsense").replace("T02", "T03"), lines[2].replace("T02", "T04").replace("imu.csv", "gone.csv", 1)]) + "\n")
    assert cli.main(["validate-manifest", "--config", str(tmp_path / "config.yaml")], spark) == 1
    out = capsys.readouterr().out
    assert "already in row" in out and "condition is not allowed" in out and "file does not exist" in out
    assert cli.main(["preprocess", "--config", str(tmp_path / "config.yaml")], spark) == 2
    assert cli.main(["validate-manifest", "--config", str(tmp_path / "none.yaml")], spark) == 2


@pytest.mark.parametrize("change", [{"imu": {"filter_order": True}}, {"imu": {"lowpass_cutoff_hz": float("inf")}}, {"fusion": {"modalities": ["imu", "imu"]}}, {"paths": {}}, {"modeling": {"group_column": "trial_id"}}, {"dual_task_cost": {"enabled": True}}])
def test_bad_configuration(change):
    with pytest.raises(ConfigurationError):
        build(CONFIG | change)


def test_broken_file_fails_its_trial_only(spark, tmp_path):
    write_study(f"{tmp_path}/study")
    (tmp_path / "study/P001/S01/T02/imu.csv").write_text("time,x\n1,2\n")
    s = stages.load(spark, build(CONFIG, base=str(tmp_path)))
    stages.perform(s, "preprocess")
    assert {r.trial_id: r.qc_status for r in s.tables["imu_qc"].collect()} == {"T01": "pass", "T02": "fail"}
    path = tmp_path / "study/P001/S01/T01/imu.csv"
    path.write_text(path.read_text().replace("pelvis_gyro_yaw", "other", 1))
    odd = stages.load(spark, build(CONFIG, base=str(tmp_path)))
    stages.perform(odd, "preprocess")
    told = odd.tables["imu_qc"].where("trial_id = 'T01'").first()
    assert told.qc_status == "warning" and "mapped columns are absent: pelvis_gyro_yaw" in told.qc_notes
    assert s.tables["imu"].select(F.count_distinct("trial_id")).first()[0] == 1


def made(tmp_path, people=1, **change):
    write_study(f"{tmp_path}/study", people)
    (tmp_path / "config.yaml").write_text(yaml.safe_dump(CONFIG | change))
    return lambda spark, command: cli.main([command, "--config", str(tmp_path / "config.yaml")], spark)


def test_failed_synchronization_stops_a_run(spark, tmp_path, capsys):
    run = made(tmp_path, synchronization={"offsets_seconds": {"audio": 0.0}})
    assert run(spark, "synchronize") == 1 and run(spark, "run-all") == 1
    assert "synchronize has failures" in capsys.readouterr().err
    told = [json.loads(p.read_text()) for p in (tmp_path / "outputs/synchronization/participant_id=P001/session_id=S01/trial_id=T02/condition=dual_task").glob("part-*")]
    assert [[x["target_modality"], x["qc_status"]] for x in told[0]] == [["audio", "warning"], ["footswitch", "fail"]] and len(told) == 1
    assert (tmp_path / "outputs/qc/synchronization").exists() and not (tmp_path / "outputs/features").exists()


def test_phase_without_samples_fails_its_trial(spark, tmp_path):
    run = made(tmp_path)
    path = next((tmp_path / "study/P001/S01/T02").glob("*annot*"))
    lines = path.read_text().splitlines()
    first = dict(zip(lines[0].split(","), lines[1].split(",")))
    first |= {"segment_name": "blink", "start_time": "1.001", "end_time": "1.002"}
    path.write_text("\n".join([*lines, ",".join(first.values())]) + "\n")
    assert run(spark, "extract-features") == 1
    rows = spark.read.parquet(f"{tmp_path}/processed/imu_features.parquet")
    wrong = spark.read.parquet(f"{tmp_path}/processed/imu_feature_failures.parquet").collect()
    assert {r.trial_id for r in rows.collect()} == {"T01"} and [(r.trial_id, r.error) for r in wrong] == [("T02", "no samples in segment blink")]
    path.write_text("\n".join([*lines, lines[1].rsplit(",", 2)[0] + ",7,"]) + "\n")
    assert run(spark, "synchronize") == 1


def test_videos_need_probes(spark, tmp_path):
    run = made(tmp_path, video={"probe_table": "probes.parquet"})
    manifest = tmp_path / "study/participants.csv"
    lines = manifest.read_text().splitlines()
    at = lines[0].split(",").index("video_path")
    with_video = [",".join([*line.split(",")[:at], "gait.mp4", *line.split(",")[at + 1 :]]) for line in lines[1:]]
    manifest.write_text("\n".join([lines[0], *with_video]) + "\n")
    (tmp_path / "gait.mp4").write_bytes(bytes(8))
    (tmp_path / "study/gait.mp4").write_bytes(b"video")
    probe = '{"streams": [{"duration": "20", "avg_frame_rate": "25/1", "width": "640", "height": "480"}], "format": {}}'
    keys = [dict(zip(lines[0].split(","), line.split(","))) for line in lines[1:]]
    rows = [(k["participant_id"], k["session_id"], k["trial_id"], k["condition"], probe) for k in keys]
    write = lambda some: spark.createDataFrame(some, "participant_id string, session_id string, trial_id string, condition string, probe string").write.mode("overwrite").parquet(f"{tmp_path}/probes.parquet")
    write(rows)
    assert run(spark, "process-video") == 0
    found = spark.read.parquet(f"{tmp_path}/processed/video_features.parquet").where("feature_level = 'trial'").collect()
    assert len(found) == 2 and {r.video__total_frames for r in found} == {500}
    write(rows[:1])
    assert run(spark, "process-video") == 1
    qc = {r.trial_id: (r.qc_status, r.qc_notes) for r in spark.read.parquet(f"{tmp_path}/processed/video_qc.parquet").collect()}
    assert qc == {rows[0][2]: ("pass", ""), rows[1][2]: ("fail", "there is no index")}
