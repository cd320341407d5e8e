"""The aggregate report of a study in Markdown: counts only, no ids, values or paths of anybody."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..operators import fusion
from ..schemas import MODALITIES
from .project import Study

#: The stages of the report: a name, the table of its checks and the table of its features.
STAGES = (
    ("Inertial signals", "imu_qc", "imu_features"),
    ("Clock alignment", "synchronization", None),
    ("Speech", "audio_qc", "audio_features"),
    ("Foot contacts", "footswitch_qc", "footswitch_features"),
    ("Video and pose", "video_qc", "video_features"),
)


def markdown_table(header: Sequence[str], rows: Sequence[Sequence[object]]) -> list[str]:
    line = lambda cells: "| " + " | ".join("–" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return [line(header), "|" + "---|" * len(header), *map(line, rows), ""]


def recordings(study: Study) -> list[str]:
    """One row a condition: its trials and people, and how many of its trials have each input."""
    manifest = study.tables["manifest"]
    has = [F.count_if(F.col(f"{m}_path") != "").alias(m) for m in MODALITIES]
    of = lambda df: df.agg(F.count("*").alias("trials"), F.count_distinct("participant_id").alias("people"), *has)
    rows = [tuple(r) for r in of(manifest.groupBy("condition")).orderBy("condition").collect()]
    return markdown_table(("Recorded", "n", "people", *MODALITIES), [*rows, ("all", *of(manifest).first())])


def stages(study: Study) -> list[str]:
    """One row a stage: what became of its trials, and how many feature rows it left."""
    t, rows = study.tables, []
    for name, checks, made in STAGES:
        seen = fusion.status_counts(t[checks]).first() if checks in t else (None,) * 4
        left = fusion.level_counts(t[made]).first() if made in t else (None,) * 3
        rows.append((name, *seen, left[1], left[2]))
    return markdown_table(("Processed", "checked", "fine", "doubtful", "failed", "rows by trial", "rows by phase"), rows)


def comparisons(study: Study) -> list[str]:
    t = study.tables
    out = [f"- {t['multimodal_features'].count()} trials have all their features in one table." if "multimodal_features" in t else "- Features were not joined."]
    if "dual_task_costs" in t:
        out.append(f"- {t['dual_task_costs'].count()} pairs of a trial under a second task and one without were compared.")
    elif study.project.dual_task_cost.enabled:
        out.append("- Trials with and without a second task are to be compared, but weren't yet.")
    else:
        out.append("- Trials with and without a second task were not to be compared.")
    if "modeling_summary" in t:
        sets, models, metrics = t["modeling_summary"].agg(*[F.count_distinct(c) for c in ("feature_set", "model", "metric")]).first()
        out.append(f"- {study.successes} evaluations of {models} models on {sets} feature sets, with people kept in one fold, gave {metrics} metrics.")
    else:
        out.append("- No models were evaluated.")
    return [*out, ""]


def report(study: Study) -> str:
    note = f"Counted over whole tables from `{study.project.source}`, all times on the inertial sensor's clock. For research: nothing here describes or judges a single person."
    return "\n".join([f"# {study.project.name} in numbers", "", note, "", *recordings(study), *stages(study), *comparisons(study)])
