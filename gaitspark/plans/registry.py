"""Queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import oracles, queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        queries.fused_user_features, queries.manifest_duplicates, queries.manifest_issues, queries.modality_availability, queries.unit_convert, queries.try_numeric,
        queries.sort_dedupe_first, queries.timestamp_quality, queries.missing_anomaly_ratio, queries.positional_interpolation, queries.sampling_rate, queries.linear_resample,
        queries.gradient_rms, queries.quaternion_normalize, queries.sign_continuity, queries.slerp_resample, queries.butterworth_lowpass, queries.step_peaks,
        queries.step_statistics, queries.value_runs, queries.debounce, queries.vad_stabilize, queries.contact_events, queries.contact_timing, queries.frame_rms,
        queries.clipping_ratio, queries.interval_clip, queries.speech_features, queries.segment_slice, queries.phase_features, queries.turn_features, queries.event_match,
        queries.alignment_qc, queries.timeline_extents, queries.pose_metrics, queries.pose_summary, queries.probe_metadata, queries.fuse_left, queries.feature_inventory,
        queries.clinical_union_dedupe, queries.dual_task_cost, queries.cohort_filter, queries.group_folds, queries.split_audit, queries.median_impute, queries.standard_scale,
        queries.regression_metrics, queries.classification_metrics, queries.fold_summary, queries.qc_status_counts, queries.report_counts,
    )
}
for _model, _task in (("ridge", "regression"), ("random_forest", "regression"), ("logistic_regression", "classification")):
    QUERIES[f"baseline_{_model}"] = partial(queries.baseline, model=_model, task=_task)
ORACLES: dict[str, str] = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
