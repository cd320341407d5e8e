"""Operators against analytic results and brute force."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.functions import numerics
from gaitspark.operators import events, fusion, kernels, modeling, ranks, runs, series


def test_filter_gain():
    rate, cutoff = 100.0, 6.0
    for order in (1, 2, 3, 4, 5):
        t = np.arange(4000) / rate
        x = np.stack([np.ones_like(t), np.sin(2 * np.pi * cutoff * t), np.sin(2 * np.pi * 40 * t)], axis=1)
        y = numerics.zero_phase(x, order, cutoff, rate)
        assert np.allclose(y[:, 0], 1) and np.abs(y[1000:3000, 1]).max() == pytest.approx(0.5, abs=0.01)
        assert np.abs(y[1000:3000, 2]).max() < 0.05 and np.abs(y[1000:3000, 1] - 0.5 * x[1000:3000, 1]).max() < 0.01
    with pytest.raises(ValueError):
        numerics.zero_phase(np.ones((15, 1)), 4, cutoff, rate)


def plain_filter(x, order, cutoff, rate):
    """Sample by sample, forward and backward."""
    n = numerics.pad_length(order)
    y = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    for _ in range(2):
        for b, a in numerics.butterworth(order, cutoff, rate):
            s2 = (b[2] - a[2]) * y[0]
            s1, out = (b[1] - a[1]) * y[0] + s2, np.empty_like(y)
            for t, v in enumerate(y):
                out[t] = b[0] * v + s1
                s1, s2 = b[1] * v - a[1] * out[t] + s2, b[2] * v - a[2] * out[t]
            y = out
        y = y[::-1]
    return y[n:-n]


def test_filter_sample_by_sample():
    rng = np.random.default_rng(1)
    for order in (1, 2, 4, 5):
        for n in (17, 64, 129, 1000):
            if n > numerics.pad_length(order):
                x = np.cumsum(rng.normal(size=n))
                assert np.abs(numerics.zero_phase(x[:, None], order, 6.0, 100.0)[:, 0] - plain_filter(x, order, 6.0, 100.0)).max() < 1e-9


def test_long_trials_are_filtered_in_blocks(spark):
    """Trials of one block, of several and of an uneven number of samples; a column with a gap, unknown and low rates."""
    rng = np.random.default_rng(2)
    rows = []
    for k, n, rate in (("one", 90, 100.0), ("two", 100, 100.0), ("some", 257, 50.0), ("many", 1234, 100.0), ("short", 9, 100.0), ("low", 300, 10.0), ("none", 300, None)):
        x, y = np.cumsum(rng.normal(size=n)), rng.normal(size=n)
        rows += [(k, float(t), float(a), float(b) if (k, t) != ("some", 5) else None, rate, f"{k}{t}") for t, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k string, t double, x double, y double, rate double, extra string").repartition(7)
    plain = {r.extra: r for r in kernels.lowpass(df, ["k"], "t", ["x", "y"], "rate", 6.0, 4).collect()}
    got = {r.extra: r for r in kernels.lowpass(df, ["k"], "t", ["x", "y"], "rate", 6.0, 4, block=50).collect()}
    assert set(got) == set(plain) == {r[-1] for r in rows}
    for e, r in plain.items():
        assert r.filter_note == got[e].filter_note and r.x == pytest.approx(got[e].x, abs=1e-9) and (r.y == got[e].y if r.y is None else r.y == pytest.approx(got[e].y, abs=1e-9))
    want = plain_filter(np.array([r[2] for r in rows if r[0] == "many"]), 4, 6.0, 100.0)
    assert [got[f"many{t}"].x for t in range(1234)] == pytest.approx(list(want), abs=1e-9)
    notes = {r.k: r.filter_note for r in plain.values()}
    assert notes == {"one": None, "two": None, "some": None, "many": None, "short": "too short to filter", "low": "error: cutoff is at or above half the sampling rate", "none": "error: sampling rate is unknown"}


def brute_peaks(x, distance, prominence):
    tops, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    keep = set()
    for p in sorted(tops, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in keep):
            keep.add(p)
    out = []
    for p in sorted(keep):
        a = b = p
        lo = hi = x[p]
        while a >= 0 and x[a] <= x[p]:
            lo, a = min(lo, x[a]), a - 1
        while b < len(x) and x[b] <= x[p]:
            hi, b = min(hi, x[b]), b + 1
        if x[p] - max(lo, hi) >= prominence:
            out.append(p)
    return out


def test_peaks_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, 6, rng.integers(3, 60)).astype(float)
        d, p = int(rng.integers(1, 6)), float(rng.integers(0, 4))
        assert numerics.peaks(x, d, p).tolist() == brute_peaks(x, d, p)
    x = np.cumsum(rng.normal(size=5000)).round(1)
    for d, p in ((1, 0.0), (40, 0.5), (700, 2.0)):
        assert numerics.peaks(x, d, p).tolist() == brute_peaks(x, d, p)
    long = np.sin(np.arange(1_000_000) / 7) + rng.normal(size=1_000_000)
    began = time.time()
    assert len(numerics.peaks(long, 30, 0.5)) > 20_000 and time.time() - began < 20


def test_polyphase_keeps_a_tone():
    t = np.arange(8000) / 8000
    y = numerics.polyphase(np.sin(2 * np.pi * 220 * t), 8000, 16000)
    want = np.sin(2 * np.pi * 220 * np.arange(16000) / 16000)
    assert len(y) == 16000 and np.abs(y - want)[200:-200].max() < 0.01
    assert len(numerics.polyphase(np.ones(1001), 44100, 16000)) == math.ceil(1001 * 160 / 441)


def test_fill_gaps_and_dedupe(spark):
    rows = [("a", 0, 0.0, None), ("a", 1, 1.0, 10.0), ("a", 2, 5.0, None), ("a", 3, 6.0, 30.0), ("a", 4, 6.0, 99.0), ("a", 5, 7.0, None), ("b", 0, 0.0, None)]
    df = spark.createDataFrame(rows, "k string, n int, t double, v double")
    got = series.fill_gaps(series.dedupe_first(df, ["k"], "t", "n"), ["k"], "t", ["v"]).orderBy("k", "t").collect()
    assert [r.v for r in got] == [10.0, 10.0, 20.0, 30.0, 30.0, None]
    q = series.timestamp_quality(df, ["k"], "t", "n").where("k = 'a'").first()
    assert (q.n_samples, q.n_duplicates, q.nonmonotonic) == (6, 1, False)


def test_resample_against_numpy(spark):
    rng = random.Random(5)
    t = sorted(rng.uniform(0, 20) for _ in range(60))
    v = [rng.gauss(0, 1) for _ in t]
    df = spark.createDataFrame([("a", x, y) for x, y in zip(t, v)], "k string, t double, v double")
    got = series.resample_linear(df, ["k"], "t", ["v"], 7.0).orderBy("grid_index").collect()
    grid = t[0] + np.arange(math.floor((t[-1] - t[0] + 1e-9) * 7) + 1) / 7
    assert [r.grid_index for r in got] == list(range(len(grid))) and np.allclose([r.v for r in got], np.interp(grid, t, v))
    g = df.withColumn("g", series.gradient(F.col("v"), F.col("t"), series.along(["k"], "t"))).orderBy("t").collect()
    assert np.allclose([r.g for r in g], np.gradient(v, t))


def test_slerp_quarter(spark):
    rows = [("a", 0.0, 1.0, 0.0, 0.0, 0.0), ("a", 1.0, 0.0, 0.0, 0.0, 1.0)]
    q = ["w", "x", "y", "z"]
    got = series.resample_slerp(spark.createDataFrame(rows, "k string, t double, w double, x double, y double, z double"), ["k"], "t", q, 4.0).orderBy("grid_index").collect()
    assert (got[1].w, got[1].z) == pytest.approx((math.cos(math.pi / 8), math.sin(math.pi / 8))) and len(got) == 5
    flipped = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 0.0, 0.0), ("a", 1.0, -1.0, 0.0, 0.0, 0.0), ("a", 2.0, 0.0, 0.0, 0.0, 0.0)], "k string, t double, w double, x double, y double, z double")
    assert {r.w for r in series.resample_slerp(flipped, ["k"], "t", q, 2.0).collect()} == {1.0}


def loop_debounce(s, on, off):
    for _ in range(2):
        cuts = [0, *[i for i in range(1, len(s)) if s[i] != s[i - 1]], len(s)]
        out = list(s)
        for a, b in zip(cuts, cuts[1:]):
            if s[a] == 1 and b - a < on:
                out[a:b] = [0] * (b - a)
            elif s[a] == 0 and b - a < off and a > 0 and b < len(s):
                out[a:b] = [1] * (b - a)
        s = out
    return s


def test_debounce_brute_force(spark):
    rng = random.Random(11)
    seqs = {str(k): [rng.random() < 0.5 for _ in range(rng.randrange(1, 40))] for k in range(150)}
    df = spark.createDataFrame([(k, i, int(v)) for k, s in seqs.items() for i, v in enumerate(s)], "k string, i int, state int")
    got = {}
    for r in runs.debounce(df, ["k"], "i", "state", F.lit(1.0), 2.0, 3.0).orderBy("k", "i").collect():
        got.setdefault(r.k, []).append(r.state)
    assert got == {k: loop_debounce(list(map(int, s)), 2, 3) for k, s in seqs.items()}


def test_contested_match_brute_force(spark):
    rng = random.Random(7)
    times = lambda k: sorted(rng.randrange(-200, 800) / (100 if k % 2 else 25) for _ in range(rng.randrange(16)))
    a, b = {str(k): times(k) for k in range(60)}, {str(k): times(k) for k in range(60)}  # of one k in two, many on the same time
    frame = lambda d: spark.createDataFrame([(k, t) for k, ts in d.items() for t in ts], "k string, t double")
    got = sorted((r.k, r.found_time, r.reference_time) for r in events.matched(frame(a), frame(b), ["k"], "t", 0.4).collect() for _ in range(r.n))
    want = []
    for k in a:
        used_a, used_b = set(), set()
        for _, i, j in sorted((abs(x - y), i, j) for i, x in enumerate(a[k]) for j, y in enumerate(b[k]) if abs(x - y) <= 0.4):
            if i not in used_a and j not in used_b:
                used_a.add(i), used_b.add(j), want.append((k, a[k][i], b[k][j]))
    assert got == sorted(want)
    same = events.matched(frame(a), frame(b), ["k"], "t", 0.0).collect()
    assert {r.error for r in same} == {0.0} and sum(r.n for r in same) == sum(min(a[k].count(t), b[k].count(t)) for k in a for t in set(a[k]))


def test_dense_events_are_spread(spark):
    """One trial whose events never pause: no task's rows grow with the trial, and neighbours are paired."""
    n = 100_000
    found = spark.range(n).select(F.lit("x").alias("k"), F.col("id").cast("double").alias("t"))
    reference = spark.range(n).select(F.lit("x").alias("k"), (F.col("id") + 0.25).alias("t"))
    got = events.matched(found, reference, ["k"], "t", 3.0)
    assert got.agg(F.sum("n"), F.max("error")).first()[:] == (n, 0.25)
    cells = events.nearest(found.select("k", "t", F.lit(0).alias("kind"), F.lit(1).alias("n")), ["k"], 3.0)
    assert "_cell" in cells._jdf.queryExecution().executedPlan().toString()


def test_short_signal_is_left_alone(spark):
    df = spark.createDataFrame([("a", i / 100, float(i), 100.0) for i in range(10)], "k string, t double, v double, rate double")
    out = kernels.lowpass(df, ["k"], "t", ["v"], "rate", 6.0, 4).orderBy("t").collect()
    assert [r.v for r in out] == [float(i) for i in range(10)] and {r.filter_note for r in out} == {"too short to filter"}
    assert "half the sampling rate" in kernels.lowpass(df, ["k"], "t", ["v"], "rate", 60.0, 4).first().filter_note


def test_costs(spark):
    rows = [("A", "1", "s", 100.0, 2.0), ("A", "2", "d", 80.0, 2.5), ("B", "3", "s", 0.0, None), ("B", "4", "d", 1.0, 1.0), ("C", "5", "s", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "who string, trial_id string, condition string, imu__cadence double, imu__turn double")
    how = {"imu__cadence": "higher_is_better", "imu__turn": "higher_is_worse"}
    costs, skipped = fusion.dual_task_costs(df, ["who"], "s", "d", how)
    got = {r.who: r for r in costs.collect()}
    assert (got["A"].dtc__imu_cadence_pct, got["A"].dtc__imu_turn_pct) == (20.0, 25.0) and got["B"].dtc_valid_metric_count == 0 and skipped.first()[0] == 1
    with pytest.raises(ValueError):
        fusion.dual_task_costs(df.union(df.limit(1)), ["who"], "s", "d", how)


def test_medians_by_rank_search(spark, monkeypatch):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    assert modeling.medians(df, ["v"]) == {"v": 2.0}
    monkeypatch.setattr(modeling, "FEW", 20)
    rng = np.random.default_rng(4)
    n = 6000
    columns = {"wide": 10.0 ** rng.uniform(-200, 200, n), "ties": rng.integers(0, 2, n).astype(float), "one": np.full(n, 7.0), "even": rng.normal(size=n), "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)), "none": np.full(n, np.nan)}
    fold = rng.integers(0, 3, n)
    df = spark.createDataFrame([(int(f), *[None if np.isnan(v) else float(v) for v in row]) for f, *row in zip(fold, *columns.values())], "fold int, " + ", ".join(f"{c} double" for c in columns)).repartition(6)
    middle = lambda x: 0.0 if np.isnan(x).all() else float(np.nanmedian(x))
    assert modeling.medians(df, list(columns)) == {c: middle(x) for c, x in columns.items()}
    assert modeling.medians(df, list(columns), F.col("fold"), range(3)) == [{c: middle(x[fold != k]) for c, x in columns.items()} for k in range(3)]


def filled_and_scaled(x, train):
    """Columns with the training rows' medians in gaps, centred and divided as the training rows are."""
    x = np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x)
    sd = x[train].std(0)
    return (x - x[train].mean(0)) / np.where(sd > 1e-9, sd, 1.0)


def test_linear_models_of_all_folds(spark):
    """Ridge, least squares (with a column twice) and logistic regression against direct solutions for each fold."""
    rng = np.random.default_rng(2)
    n = 240
    x = np.column_stack([rng.normal(size=(n, 2)) * [1.0, 50.0] + [0.0, 1e6], np.ones(n)])
    x[rng.random(n) < 0.2, 1] = np.nan
    fold = rng.integers(0, 3, n)
    y = 2 * x[:, 0] + np.nan_to_num(x[:, 1] - 1e6) / 50 + 3 + rng.normal(size=n)
    one = (y > 3).astype(float)
    frame = lambda label: spark.createDataFrame([(i, int(f), float(v), *[None if np.isnan(e) else float(e) for e in row]) for i, (f, v, row) in enumerate(zip(fold, label, x))], "i int, fold int, _y double, a double, b double, c double").withColumn("a2", F.col("a")).repartition(5)
    how = modeling.Baseline()
    middles = modeling.medians(frame(y), ["a", "b", "c"], F.col("fold"), range(3))
    got = {r.i: r.y_pred for r in modeling.all_folds(frame(y), 3, ["a", "b", "c"], middles, "ridge", how).collect()}
    twice = [m | {"a2": m["a"]} for m in middles]
    least = {r.i: r.y_pred for r in modeling.all_folds(frame(y), 3, ["a", "b", "c", "a2"], twice, "linear_regression", how).collect()}
    odds = {r.i: r.y_score for r in modeling.all_folds(frame(one), 3, ["a", "b", "c"], middles, "logistic_regression", modeling.Baseline("classification")).collect()}
    for k in range(3):
        train, test = fold != k, np.flatnonzero(fold == k)
        z = filled_and_scaled(x, train)
        beta = np.linalg.solve(z[train].T @ z[train] + np.eye(3), z[train].T @ (y[train] - y[train].mean()))
        assert [got[i] for i in test] == pytest.approx(list(z[test] @ beta + y[train].mean()), abs=1e-7)
        plain = np.linalg.lstsq(z[train], y[train] - y[train].mean(), rcond=None)[0]
        assert [least[i] for i in test] == pytest.approx(list(z[test] @ plain + y[train].mean()), abs=1e-6)
        z1 = np.column_stack([z, np.ones(n)])
        own, weight = one[train], np.where(one[train] == 1, train.sum() / (2 * one[train].sum()), train.sum() / (2 * (1 - one[train]).sum()))
        w = np.zeros(4)
        for _ in range(40):
            p = 1 / (1 + np.exp(-z1[train] @ w))
            held = np.diag([1.0, 1.0, 1.0, 0.0])
            w -= np.linalg.solve(z1[train].T @ (z1[train] * (weight * p * (1 - p))[:, None]) + held, z1[train].T @ (weight * (p - own)) + held @ w)
        assert [odds[i] for i in test] == pytest.approx(list(1 / (1 + np.exp(-z1[test] @ w))), abs=1e-6)


def test_ranks_of_a_whole_table(spark):
    """Metrics without groups: ranked in ranges, as scores of hot and of few values are."""
    rng = np.random.default_rng(6)
    n = 20_000
    t, p = rng.integers(0, 5000, n), rng.normal(size=n).round(2)
    t[: n // 3] = 17
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, p)], "t long, p double").repartition(8)

    def rank(x):
        values, at, counts = np.unique(x, return_inverse=True, return_counts=True)
        return (np.cumsum(counts) - counts + (counts + 1) / 2)[at]

    got = modeling.regression_metrics(df, (), "t", "p").first()
    assert got.spearman == pytest.approx(np.corrcoef(rank(t), rank(p))[0, 1]) and got.mae == pytest.approx(np.abs(t - p).mean())
    hit = t % 3 == 0
    found = modeling.classification_metrics(df.select((F.col("t") % 3 == 0).cast("int").alias("y"), (F.col("p") > 0).cast("int").alias("g"), "p"), (), "y", "g", "p").first()
    assert found.roc_auc == pytest.approx((rank(p)[hit].sum() - hit.sum() * (hit.sum() + 1) / 2) / (hit.sum() * (~hit).sum()))
    numbered = ranks.numbered(df.select("t"), [F.desc("t")]).orderBy("number").collect()
    assert [r.number for r in numbered] == list(range(1, n + 1)) and [r.t for r in numbered] == sorted(t.tolist(), reverse=True)
    before = ranks.totals_before(spark.range(1000).withColumn("v", F.col("id") % 7), ["id"], "v").collect()
    assert all(r.before == sum(i % 7 for i in range(r.id)) for r in before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ranks.dealt(df.select(F.lit(1).alias("same")), ["same"]).groupBy("_range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < n  # equal rows aren't one range


def test_grouped_evaluation(spark):
    rows = []
    for p in range(10):
        for t in range(2):
            audio = None if p in (2, 7) else 0.1 * p + t
            rows.append((f"P{p:03d}", "S", f"T{t}", "c", p * 2 + t, audio, 1, 0 if audio is None else 1, p % 2))
    df = spark.createDataFrame(rows, "participant_id string, session_id string, trial_id string, condition string, imu__cadence long, audio__ratio double, availability__imu int, availability__audio int, clinical__target long")
    how = modeling.Baseline("classification", folds=3, models=("logistic_regression", "random_forest"), positive=1, trees=5)
    keys = ["participant_id", "session_id", "trial_id", "condition"]
    out = modeling.evaluate(df, {"imu_audio": ("imu", "audio")}, how, keys)
    assert out["successful"] == 4 and out["skipped"].count() == 0
    per = out["predictions"].groupBy("cohort", "model").agg(F.count("*").alias("n"), F.min("y_score").alias("lo"), F.max("y_score").alias("hi")).collect()
    assert {(r.cohort, r.n) for r in per} == {("all_samples", 20), ("complete_modalities", 16)} and all(0 <= r.lo <= r.hi <= 1 for r in per)
    assert {r.group_overlap_count for r in out["split_audit"].collect()} == {0}
    alone = modeling.evaluate(df.where("participant_id = 'P001'"), {"imu": ("imu",)}, how, keys)
    assert alone["successful"] == 0 and alone["skipped"].count() == 2


def test_folds_of_many_groups(spark):
    """More groups than are dealt one by one: whole groups, even folds and classes, the large group's fold gets less else."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 4 == 0, "large").otherwise(F.concat(F.lit("g"), (F.col("id") % 7_001).cast("string"))).alias("who"), (F.xxhash64("id") % 5 == 0).cast("int").alias("y")
    )
    folded = rows.join(modeling.group_folds(rows, "who", 3, "y"), "who")
    assert folded.count() == 40_000 and folded.groupBy("who").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    for r in folded.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect():
        assert r.n == pytest.approx(40_000 / 3, rel=0.02) and r.y == pytest.approx(rows.agg(F.sum("y")).first()[0] / 3, rel=0.03)
    assert modeling.group_folds(rows.where("false"), "who", 3, "y").count() == 0
    even = spark.range(30).select(F.col("id").cast("string").alias("who"))
    dealt = lambda seed: {(r.who, r.fold) for r in modeling.group_folds(even, "who", 3, seed=seed).collect()}
    assert dealt(1) == dealt(1) != dealt(2) and {sum(f == k for _, f in dealt(2)) for k in range(3)} == {10}
