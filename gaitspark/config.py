"""Typed, validated configuration of a study, from YAML."""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

import yaml


class ConfigurationError(ValueError):
    """The configuration can't be used."""


def positive(x: Any) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x <= 0:
        raise ValueError("must be a positive number")
    return float(x)


def not_negative(x: Any) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x < 0:
        raise ValueError("must be a number of 0 or more")
    return float(x)


def any_number(x: Any) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise ValueError("must be a finite number")
    return float(x)


def count(x: Any) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < 1:
        raise ValueError("must be a positive whole number")
    return x


def whole(x: Any) -> int:
    if isinstance(x, bool) or not isinstance(x, int):
        raise ValueError("must be a whole number")
    return x


def share(x: Any) -> float:
    if not_negative(x) > 1:
        raise ValueError("must be between 0 and 1")
    return float(x)


def flag(x: Any) -> bool:
    if not isinstance(x, bool):
        raise ValueError("must be true or false")
    return x


def text(x: Any) -> str:
    if not isinstance(x, str) or not x.strip():
        raise ValueError("must be a non-empty string")
    return x


def maybe_text(x: Any) -> str | None:
    return None if x is None else text(x)


def anything(x: Any) -> Any:
    return x


def one_of(*choices: str) -> Callable[[Any], str]:
    def check(x: Any) -> str:
        if x not in choices:
            raise ValueError(f"must be one of {', '.join(choices)}")
        return x

    return check


def texts(x: Any, choices: tuple[str, ...] = ()) -> tuple[str, ...]:
    if not isinstance(x, (list, tuple)) or not x:
        raise ValueError("must be a non-empty list")
    out = tuple(text(v) for v in x)
    if len(set(out)) < len(out):
        raise ValueError("has duplicates")
    if bad := [v for v in out if choices and v not in choices]:
        raise ValueError(f"has unknown entries {', '.join(bad)}")
    return out


def texts_of(*choices: str) -> Callable[[Any], tuple[str, ...]]:
    return lambda x: texts(x, choices)


def mapping(value: Callable[[Any], Any]) -> Callable[[Any], dict]:
    def check(x: Any) -> dict:
        if not isinstance(x, dict):
            raise ValueError("must be a mapping")
        return {text(k): value(v) for k, v in x.items()}

    return check


def set_to(default: Any, check: Callable[[Any], Any]) -> Any:
    kept = {"default_factory": lambda: dict(default)} if isinstance(default, dict) else {"default": default}
    return field(metadata={"check": check}, **kept)


@dataclass(frozen=True)
class Imu:
    format: str = set_to("wide_csv", one_of("wide_csv", "long_csv", "mvnx"))
    target_sensor: str = set_to("pelvis", text)
    columns: dict = set_to({"timestamp": "timestamp", "acc_ap": "acc_ap", "acc_ml": "acc_ml", "acc_vertical": "acc_vertical", "gyro_yaw": "gyro_yaw"}, mapping(text))
    target_sampling_rate_hz: float = set_to(100.0, positive)
    lowpass_cutoff_hz: float = set_to(6.0, positive)
    filter_order: int = set_to(4, count)
    input_acceleration_unit: str = set_to("m/s^2", one_of("m/s^2", "g"))
    input_angular_velocity_unit: str = set_to("rad/s", one_of("rad/s", "deg/s"))
    gravity_removal: str = set_to("none", one_of("none", "constant"))
    gravity_value_m_s2: float = set_to(9.80665, positive)
    maximum_abs_acceleration_m_s2: float = set_to(50.0, positive)
    maximum_abs_angular_velocity_rad_s: float = set_to(20.0, positive)
    step_min_interval_s: float = set_to(0.35, positive)
    step_prominence: float = set_to(0.15, positive)
    generate_plots: bool = set_to(True, flag)


@dataclass(frozen=True)
class Synchronization:
    reference_modality: str = set_to("imu", one_of("imu"))
    method: str = set_to("manual_offset", one_of("manual_offset"))
    offsets_seconds: dict = set_to({}, mapping(any_number))
    uncertainty_seconds: dict = set_to({}, mapping(not_negative))
    timestamp_columns: dict = set_to({}, mapping(text))
    operator: str = set_to("unspecified", text)
    notes: str = set_to("", anything)
    maximum_duration_difference_s: float = set_to(0.5, not_negative)
    minimum_overlap_ratio: float = set_to(0.9, share)
    generate_plots: bool = set_to(True, flag)


@dataclass(frozen=True)
class Audio:
    target_sampling_rate_hz: int = set_to(16000, count)
    frame_duration_ms: float = set_to(30.0, positive)
    energy_threshold_dbfs: float = set_to(-35.0, any_number)
    minimum_speech_duration_s: float = set_to(0.2, not_negative)
    minimum_pause_duration_s: float = set_to(0.2, not_negative)
    task_start_seconds: float = set_to(0.0, not_negative)
    clipping_threshold: float = set_to(0.999, share)


@dataclass(frozen=True)
class Footswitch:
    timestamp_column: str = set_to("timestamp", text)
    left_contact_column: str = set_to("left_contact", text)
    right_contact_column: str = set_to("right_contact", text)
    threshold: float = set_to(0.5, any_number)
    minimum_contact_duration_s: float = set_to(0.08, not_negative)
    minimum_swing_duration_s: float = set_to(0.08, not_negative)
    event_matching_tolerance_s: float = set_to(0.15, positive)


@dataclass(frozen=True)
class Video:
    enable_pose_estimation: bool = set_to(False, flag)
    pose_backend: str = set_to("mediapipe", one_of("mediapipe"))
    pose_model_path: str | None = set_to(None, maybe_text)
    frame_step: int = set_to(1, count)
    minimum_visibility: float = set_to(0.5, share)
    minimum_pose_detection_confidence: float = set_to(0.5, share)
    minimum_pose_presence_confidence: float = set_to(0.5, share)
    minimum_tracking_confidence: float = set_to(0.5, share)
    probe_table: str | None = set_to(None, maybe_text)
    landmark_table: str | None = set_to(None, maybe_text)
    frame_table: str | None = set_to(None, maybe_text)


@dataclass(frozen=True)
class Fusion:
    modalities: tuple = set_to(("imu", "audio", "video", "footswitch", "clinical"), texts_of("imu", "audio", "video", "footswitch", "clinical"))
    feature_sets: dict = set_to({"all_available": ("imu", "audio", "video", "footswitch", "clinical")}, mapping(texts))


@dataclass(frozen=True)
class DualTaskCost:
    enabled: bool = set_to(False, flag)
    group_columns: tuple = set_to(("participant_id", "session_id"), texts)
    single_condition: str = set_to("single_task", text)
    dual_condition: str = set_to("dual_task", text)
    metrics: dict = set_to({}, mapping(one_of("higher_is_better", "higher_is_worse")))


@dataclass(frozen=True)
class Modeling:
    enabled: bool = set_to(False, flag)
    target_column: str = set_to("clinical__target", text)
    task_type: str = set_to("regression", one_of("regression", "classification"))
    group_column: str = set_to("participant_id", one_of("participant_id"))
    folds: int = set_to(5, count)
    random_seed: int = set_to(42, whole)
    models: tuple = set_to(("ridge",), texts_of("ridge", "linear_regression", "logistic_regression", "random_forest"))
    cohort_modes: tuple = set_to(("all_samples",), texts_of("all_samples", "complete_modalities"))
    positive_label: Any = set_to(None, anything)


@dataclass(frozen=True)
class Project:
    name: str
    root: str
    manifest: str
    processed_dir: str
    output_dir: str
    source: str
    allowed_conditions: tuple[str, ...]
    imu: Imu
    synchronization: Synchronization
    audio: Audio
    footswitch: Footswitch
    video: Video
    fusion: Fusion
    dual_task_cost: DualTaskCost
    modeling: Modeling

    def resolve(self, path: str) -> str:
        """Absolute paths and URIs stay; others are under the project's root."""
        return path if path.startswith("/") or "://" in path else os.path.join(self.root, path)


SECTIONS = {"imu": Imu, "synchronization": Synchronization, "audio": Audio, "footswitch": Footswitch, "video": Video, "fusion": Fusion, "dual_task_cost": DualTaskCost, "modeling": Modeling}
#: The conditions of a study that names none.
CONDITIONS = ("single_task", "dual_task", "motor_only", "cognitive_only")


def section(kind: type, given: Any, name: str) -> Any:
    if not isinstance(given, dict):
        raise ConfigurationError(f"'{name}' must be a mapping")
    values = {}
    for f in fields(kind):
        if f.name in given:
            try:
                values[f.name] = f.metadata["check"](given[f.name])
            except ValueError as e:
                raise ConfigurationError(f"'{name}.{f.name}' {e}") from e
    return kind(**values)


def build(raw: Any, source: str = "config.yaml", base: str = ".") -> Project:
    """A project from parsed YAML; unknown keys have no effect."""
    if not isinstance(raw, dict):
        raise ConfigurationError("the configuration must be a mapping")
    part = lambda k: raw.get(k) or {}
    paths, project = part("paths"), part("project")
    if not isinstance(paths, dict) or not paths.get("manifest"):
        raise ConfigurationError("'paths.manifest' is required")
    root = os.path.normpath(os.path.join(base, str(project.get("root", "."))))
    try:
        conditions = texts(part("study").get("allowed_conditions", CONDITIONS))
    except ValueError as e:
        raise ConfigurationError(f"'study.allowed_conditions' {e}") from e
    made = {name: section(kind, part(name), name) for name, kind in SECTIONS.items()}
    imu, video, fusion, cost, modeling = (made[k] for k in ("imu", "video", "fusion", "dual_task_cost", "modeling"))
    rules = (
        ("timestamp" not in imu.columns, "'imu.columns' needs a timestamp"),
        (video.enable_pose_estimation and not video.pose_model_path, "'video.pose_model_path' is required for pose estimation"),
        (any(set(s) - set(fusion.modalities) for s in fusion.feature_sets.values()), "'fusion.feature_sets' name modalities that aren't fused"),
        (cost.enabled and not cost.metrics, "'dual_task_cost.metrics' is required"),
        (cost.single_condition == cost.dual_condition, "'dual_task_cost' needs two different conditions"),
        (cost.enabled and not {cost.single_condition, cost.dual_condition} <= set(conditions), "'dual_task_cost' conditions must be allowed ones"),
        ("participant_id" not in cost.group_columns, "'dual_task_cost.group_columns' needs participant_id"),
        (modeling.folds < 2, "'modeling.folds' must be 2 or more"),
        (modeling.task_type == "classification" and bool({"ridge", "linear_regression"} & set(modeling.models)), "'modeling.models' has regression models for a classification"),
        (modeling.task_type == "regression" and "logistic_regression" in modeling.models, "'modeling.models' has a classifier for a regression"),
        (modeling.enabled and modeling.task_type == "classification" and modeling.positive_label is None, "'modeling.positive_label' is required for classification"),
    )
    for broken, message in rules:
        if broken:
            raise ConfigurationError(message)
    return Project(
        name=str(project.get("name", "study")), root=root, manifest=str(paths["manifest"]), processed_dir=str(paths.get("processed_dir", "data/processed")),
        output_dir=str(paths.get("output_dir", "outputs")), source=os.path.basename(source), allowed_conditions=conditions, **made,
    )


def load_config(path: str) -> Project:
    try:
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
    except yaml.YAMLError as e:
        raise ConfigurationError(f"{path}: {e}") from e
    return build(raw, path, os.path.dirname(os.path.abspath(path)))
