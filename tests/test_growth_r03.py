"""What the baselines pass through the driver and how they spread their rows (findings of round 3)."""

from pyspark.sql import functions as F

from gaitspark.operators import fusion, modeling
from gaitspark.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_baselines_read_a_table(spark, monkeypatch):
    """The fused customers are made once, not in each of the evaluation's passes."""
    seen = []
    monkeypatch.setattr(modeling, "evaluate", lambda frame, *_: seen.append(frame) or {"predictions": spark.createDataFrame([], "id long, cohort string, fold int, y_true double, y_pred double, y_score double")})
    for model, task in (("ridge", "regression"), ("random_forest", "regression"), ("logistic_regression", "classification")):
        queries.baseline(spark, SF, model, task)
    assert len(seen) == 3 and all("Join" not in plan(frame) and "Scan parquet" in plan(frame) for frame in seen)


def test_fusion_has_no_broadcast(spark):
    trials = spark.range(20).select(F.col("id").alias("trial"), F.lit("P").alias("who"))
    features = trials.where("trial > 2").select("trial", F.lit("trial").alias("feature_level"), F.col("trial").alias("imu__n"))
    clinical = trials.where("trial > 10").select("trial", F.lit(1).alias("availability__clinical"))
    fused = fusion.fuse(trials, {"imu": features}, ["trial"], clinical, "trial")
    assert "Broadcast" not in plan(fused) and "SortMergeJoin" in plan(fused)
    assert {(r.trial, r.imu__n, r.availability__imu, r.availability__clinical) for r in fused.collect()} == {(i, i if i > 2 else None, int(i > 2), int(i > 10)) for i in range(20)}
    assert "Broadcast" not in plan(queries.fused_tables(spark, SF))


def test_models_are_fitted_in_pieces(spark, monkeypatch):
    """A piece a core or more, though the rows are few bytes."""
    rows = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 10).cast("string").alias("participant_id"), F.rand(1).alias("imu__x"), F.rand(2).alias("clinical__target"))
    pieces = []
    fit = modeling.all_folds
    monkeypatch.setattr(modeling, "all_folds", lambda folded, *a: pieces.append(len(folded.inputFiles())) or fit(folded, *a))
    for most, least in ((100_000, spark.sparkContext.defaultParallelism), (20, 20)):
        monkeypatch.setattr(modeling, "PIECE", most, raising=False)
        out = modeling.evaluate(rows.coalesce(1), {"imu": ("imu",)}, modeling.Baseline(folds=2, models=("ridge",), cohort_modes=("all_samples",)), ["k"])
        assert out["predictions"].count() == 400 and pieces.pop() >= least
