"""Trial matrices: missing-aware fusion, inventory, paired cost and counts for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import cost_column, metric_stem, number
from .series import Keys

#: Fixed value: twice the spacing of doubles at 1, under which a denominator is zero.
EPSILON = 2.220446049250313e-16


def duplicated(df: DataFrame, keys: Keys) -> DataFrame:
    """(keys, n) of keys that are there more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Keys, what: str) -> DataFrame:
    """df, or an error that names up to three keys that repeat."""
    bad = duplicated(df, keys).limit(3).collect()
    if bad:
        raise ValueError(f"{what}: more than one row for " + ", ".join("/".join(str(r[k]) for k in keys) for r in bad))
    return df


def trial_features(features: DataFrame, modality: str, keys: Keys) -> DataFrame:
    """A feature table's trial rows with the modality's columns and availability flag."""
    chosen = [c for c in features.columns if c.startswith(f"{modality}__")]
    out = features.where("feature_level = 'trial'").select(*keys, *chosen)
    return require_unique(out, keys, f"{modality} features").withColumn(f"availability__{modality}", F.lit(1))


def clinical_table(tables: Sequence[DataFrame], key: str = "participant_id") -> DataFrame:
    """The union of clinical tables by name, equal rows once; a blank id or two different rows of one id are an error."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out = out.withColumn(key, F.trim(F.col(key).cast("string"))).distinct()
    if not out.where(F.col(key).isNull() | (F.col(key) == "")).isEmpty():
        raise ValueError("clinical table: blank participant id")
    require_unique(out, [key], "clinical table")
    return out.select(key, *[F.col(c).alias(f"clinical__{c}") for c in out.columns if c != key]).withColumn("availability__clinical", F.lit(1))


def fuse(trials: DataFrame, tables: dict[str, DataFrame], keys: Keys, clinical: DataFrame | None = None, key: str = "participant_id") -> DataFrame:
    """Trials with the features of every modality, LEFT from the manifest's trials; flags are 1 where a modality is there.

    All sides grow with the trials, so they meet by sort-merge joins: a broadcast would pass each of them through the driver.
    """
    out = require_unique(trials.select(*keys), keys, "manifest")
    for modality, table in tables.items():
        out = out.join(trial_features(table, modality, keys).hint("merge"), list(keys), "left").fillna(0, [f"availability__{modality}"])
    if clinical is not None:
        out = out.join(clinical.hint("merge"), key, "left").fillna(0, ["availability__clinical"])
    return out.select(*keys, *[c for c in out.columns if c not in keys])


def inventory(fused: DataFrame) -> DataFrame:
    """(column, modality, role, dtype, observed_count, missing_count): one pass over the matrix for all columns."""
    kinds = dict(fused.dtypes)
    columns = [c for c in fused.columns if "__" in c]
    schema = "column string, modality string, role string, dtype string, observed_count long, missing_count long"
    if not columns:
        return fused.sparkSession.createDataFrame([], schema)
    rows = []
    for c in columns:
        prefix, rest = c.split("__", 1)
        flag = prefix == "availability"
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(rest if flag else prefix).alias("modality"), F.lit("availability" if flag else "feature_or_target").alias("role"),
            F.lit(kinds[c]).alias("dtype"), F.count(F.col(f"`{c}`")).alias("observed_count"), (F.count("*") - F.count(F.col(f"`{c}`"))).alias("missing_count"),
        ))
    return fused.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def dual_task_costs(fused: DataFrame, group: Sequence[str], single: str, dual: str, metrics: dict[str, str], condition: str = "condition", trial: str = "trial_id", guard: bool = True) -> tuple[DataFrame, DataFrame]:
    """(costs, skipped): a row for each group with both conditions, positive where the dual task is worse; and a row with
    skipped_groups, those that have one of them only. One aggregation pairs the trials: there is no self-join."""
    missing = [c for c in (*group, trial, condition, *metrics) if c not in fused.columns]
    if missing:
        raise ValueError(f"cost input lacks columns: {', '.join(sorted(missing))}")
    rows = fused.where(F.col(condition).isin(single, dual))
    if guard:
        require_unique(rows, [*group, condition], "paired cost")
    of = {"single": F.col(condition) == single, "dual": F.col(condition) == dual}
    values = [F.max(F.when(test, number(m))).alias(f"{name}__{metric_stem(m)}") for m in metrics for name, test in of.items()]
    paired = rows.groupBy(*group).agg(
        *[F.max(F.when(test, F.col(trial))).alias(f"{name}_trial_id") for name, test in of.items()], *[F.count_if(test).alias(f"_{name}") for name, test in of.items()], *values
    )
    whole = (F.col("_single") == 1) & (F.col("_dual") == 1)
    out, columns = paired.where(whole), []
    for m, direction in metrics.items():
        a, b = F.col(f"single__{metric_stem(m)}"), F.col(f"dual__{metric_stem(m)}")
        worse = b - a if direction == "higher_is_worse" else a - b
        out = out.withColumn(cost_column(m), F.when(F.abs(a) > EPSILON, worse / F.abs(a) * 100))
        columns += [f"single__{metric_stem(m)}", f"dual__{metric_stem(m)}", cost_column(m)]
    valid = sum((F.col(cost_column(m)).isNotNull().cast("int") for m in metrics), F.lit(0))
    skipped = paired.agg(F.count_if(~whole).alias("skipped_groups"))
    return out.select(*group, "single_trial_id", "dual_trial_id", *columns, valid.alias("dtc_valid_metric_count")), skipped


def status_counts(qc: DataFrame, by: Sequence[str] = (), status: str = "qc_status") -> DataFrame:
    """Rows, passes, warnings and failures; the case of a status doesn't matter."""
    low = F.lower(F.trim(status))
    return qc.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.count_if(low == s).alias(f"n_{s}") for s in ("pass", "warning", "fail")])


def level_counts(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("n_rows"), F.count_if(F.col("feature_level") == "trial").alias("n_trial"), F.count_if(F.col("feature_level") == "phase").alias("n_phase"))


def availability_counts(manifest: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """(modality, available, missing): trials that declare a path of the modality."""
    has = lambda m: F.count_if(F.coalesce(F.trim(f"{m}_path"), F.lit("")) != "")
    rows = [F.struct(F.lit(i).alias("place"), F.lit(m).alias("modality"), has(m).alias("available"), (F.count("*") - has(m)).alias("missing")) for i, m in enumerate(modalities)]
    return manifest.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def numeric_columns(df: DataFrame, prefixes: Sequence[str], target: str) -> list[str]:
    """Predictors: numeric columns of the modalities, without the target. A flag of truth isn't numeric."""
    return [f.name for f in df.schema.fields if any(f.name.startswith(f"{p}__") for p in prefixes) and f.name != target and isinstance(f.dataType, T.NumericType)]


def cohort(df: DataFrame, modalities: Sequence[str], target: str, mode: str) -> DataFrame:
    """Rows with a target; for complete_modalities those that have every modality (none, where a flag is missing)."""
    out = df.where(F.col(target).isNotNull())
    if mode == "complete_modalities":
        for m in modalities:
            out = out.where(F.col(f"availability__{m}") == 1 if f"availability__{m}" in df.columns else F.lit(False))
    return out
