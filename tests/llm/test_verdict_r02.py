"""Cases of a second verdict: repeated rows cost no pairs, chains come from Fenwick trees."""

import random

from pyspark.sql import functions as F

from gaitspark.llm import ngram_join, passages
from gaitspark.llm.passages import Passages


def best_chain(p, q, how):
    """The largest score of a chain, by looking at all pairs of matches."""
    reach, worth = how.max_gap + how.window, 2 * how.gap_cost * how.window + how.kmer
    score = []
    for i in range(len(p)):
        links = [score[j] - how.gap_cost * (p[i] - p[j] + q[i] - q[j]) for j in range(i) if 0 < p[i] - p[j] <= reach and 0 < q[i] - q[j] <= reach]
        score.append(worth + max([0.0, *links]))
    return max(score)


def test_chains_against_all_pairs():
    rng, how = random.Random(1), Passages()
    for _ in range(600):
        size = rng.choice([30, 100, 400, 2000])
        at = lambda: (rng.randrange(size), rng.randrange(size))
        near = lambda x: (x, x + rng.randrange(-5, 6) + 10)
        points = sorted({at() if rng.random() < 0.4 else near(rng.randrange(size)) for _ in range(rng.randrange(1, 60))})
        p, q = [a for a, _ in points], [b for _, b in points]
        found = list(passages.chains(p, q, how))
        assert sorted(x for chain in found for x in chain) == list(range(len(p)))
        gaps = lambda c: sum(p[b] - p[a] + q[b] - q[a] for a, b in zip(c, c[1:]))
        score = len(found[0]) * (2 * how.gap_cost * how.window + how.kmer) - how.gap_cost * gaps(found[0])
        assert abs(score - best_chain(p, q, how)) < 1e-9
        assert all(0 < p[b] - p[a] <= 60 and 0 < q[b] - q[a] <= 60 for c in found for a, b in zip(c, c[1:]))


def copies(spark, n):
    """n equal rows of each of two ids with near copies, and a document of its own."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    texts = {1: " ".join(words), 2: " ".join(words[:299]), 3: " ".join(words[::-1])}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") < 3, n).otherwise(1)))), texts


def test_repeated_rows_are_one_set(spark, monkeypatch):
    seen = []
    similar = ngram_join.similar
    monkeypatch.setattr(ngram_join, "similar", lambda pairs, sets, percent: seen.append((pairs.count(), sets.count())) or similar(pairs, sets, percent))
    docs, _ = copies(spark, 1000)
    got = ngram_join.jaccard_components(docs.repartition(4)).groupBy("doc_id", "component_id").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 1, 1000), (2, 1, 1000), (3, 3, 1)}
    assert seen and all(p <= 1 and s <= 2 for p, s in seen)


def test_repeated_rows_are_one_chain(spark):
    docs, texts = copies(spark, 200)
    got = passages.repeated_passages(docs.repartition(4)).collect()
    assert [(r.doc_id, r.source_doc_id, r.n_equal) for r in got] == [(2, 1, 299)]
