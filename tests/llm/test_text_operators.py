"""The operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from gaitspark.llm import bpe_automaton, importance, passages, sharding, token_counts
from gaitspark.llm.decontamination import contained_items
from gaitspark.llm.line_dedup import drop_common_lines
from gaitspark.llm.ngram_join import jaccard_components
from gaitspark.llm.quality_rules import COLUMNS, RepetitionRules, repetition_coverage
from gaitspark.llm.registry import ORACLES, QUERIES
from gaitspark.llm.url_filters import judge, rules_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents, and awkward ones."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    odd = [None, "", "   \n\t ", "one", "one two", "Ünïcode ſtraße İstanbul K 𝔘𝔫𝔦", "a b c d e f g h " * 4000, "x" * 300_000, "dogs <|endoftext|> don't  \u00a0 stop\r\nnow", "same words here are again the same words here", "same words here are again the same words here"]
    return rows + [(1_000_000 + i, t) for i, t in enumerate(odd)]


@pytest.fixture(scope="module")
def frame(spark, docs):
    """With columns whose names clash with the operators' own."""
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    return df.select("doc_id", "text", F.lit("x").alias("n"), F.lit(1).alias("id"), F.lit(2).alias("line"), F.lit(3).alias("shard"), F.lit(4).alias("TEXT"), F.lit(5).alias("key"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_quality(frame, docs, empty):
    rules = RepetitionRules()
    got = {r.doc_id: [r[c] for c in COLUMNS] + [r.base_failed, r.kept] for r in repetition_coverage(frame).collect()}
    assert got == {d: brute.quality(t, rules) for d, t in docs} and repetition_coverage(empty).count() == 0


def test_lines(frame, docs, empty):
    got = {r.doc_id: r.text for r in drop_common_lines(frame).collect()}
    assert got == brute.line_dedup(docs) and drop_common_lines(empty).count() == 0


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, size, percent):
    rng = random.Random(size)
    base = [f"w{rng.randrange(500)}" for _ in range(98)]
    near = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 1, 2, 2, 3])):
            w[rng.randrange(98)] = f"u{rng.randrange(10**6)}"
        near.append((2_000_000 + k, " ".join(w)))
    df = spark.createDataFrame(docs + near, "doc_id long, text string").repartition(6).select("*", F.lit("x").alias("n"), F.lit(1).alias("rep"), F.lit(2).alias("TEXT"))
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(df, size, percent).collect()}
    assert got == brute.components(docs + near, size, percent)


def test_jaccard_null_ids_and_empty(spark, empty):
    rows = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[2] or 0) for r in jaccard_components(rows, 3, 90).collect()) == [(0, 0), (3, 3), (5, 3), (5, 3)]
    assert jaccard_components(empty).count() == 0


def test_contained(spark, frame, docs, empty):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(9_001, None), (9_002, "one"), (9_003, ""), (9_004, "one two"), (9_005, "the same words here are")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in contained_items(frame, items).collect()}
    assert got == brute.contained(docs, bench) and len(got) > 3
    assert contained_items(frame, empty.withColumnRenamed("doc_id", "item_id")).count() == 0 and contained_items(empty, items).count() == 0


def test_bpe_as_library(frame, docs, empty):
    path = brute.VOCABULARY
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_automaton.digests(bpe_automaton.decode(bpe_automaton.encode(frame, path), path)).collect()}
    assert got == brute.bpe(docs) and bpe_automaton.encode(empty, path).count() == 0


def test_token_counts_and_cache(spark, frame, docs, empty, tmp_path):
    cache, path = f"{tmp_path}/cache", brute.VOCABULARY
    want = {d: n for d, (n, _, _) in brute.bpe(docs).items()}
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(frame, path, cache).collect()}
        assert got == {d: (len((t or "").encode()), want[d], want[d] > 1024) for d, t in docs}
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in docs})
    assert token_counts.token_counts(empty, path, cache).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no host"), (3, "http://A.Example.ORG/en/12?x"), (4, "ftp://example.org/es/"), (5, "x://com/de/a://b"), (6, "http://notexample.org/es/"), (7, "http://a.com"), (8, "http://ünï.com/fr/é#x"), (8, "http://ünï.com/fr/é#x")]
    got = sorted(tuple(r) for r in judge(spark.createDataFrame(rows, "page_id long, url string"), rules_table(spark)).collect())
    assert [(r[0], r[3], r[4]) for r in got] == [(1, None, "allow"), (2, None, "allow"), (3, "example.org/en/1", "block"), (4, "example.org/es/", "block"), (5, "com/de/", "block"), (6, "org/", "allow"), (7, None, "allow"), (8, "com/fr/", "allow"), (8, "com/fr/", "allow")]
    assert judge(spark.createDataFrame([], "page_id long, url string"), rules_table(spark)).count() == 0


def test_passages(spark, empty):
    rng = random.Random(4)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    shared = text(80)
    fuzzy = [w if rng.random() > 0.06 else "zz" for w in shared]
    docs = [(1, text(100) + shared + text(50)), (2, text(30) + shared), (3, fuzzy + text(200)), (4, text(300)), (5, []), (6, text(60) + shared[:30] + text(60))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs] + [(7, None), (None, " ".join(shared))], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert set(got) == {2, 3} and (got[2].start_word, got[2].end_word, got[2].source_doc_id, got[2].source_start_word) == (30, 110, 1, 100)
    assert got[3].n_equal == sum(a == b for a, b in zip(fuzzy, shared)) or abs(got[3].end_word - 80) <= 6
    assert passages.repeated_passages(empty).count() == 0


def test_resampling(spark, empty):
    rng = random.Random(9)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(60))) for i in range(400)] + [(500, None), (501, "")]
    df, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id long")
    got = [r.doc_id for r in importance.resample(df, target, 0.4).collect()]
    assert len(got) == 161 and sum(d % 2 and d < 400 for d in got) > 155
    assert got and sorted(got) == sorted(r.doc_id for r in importance.resample(df.repartition(5), target, 0.4).collect())
    assert importance.resample(empty, target, 0.5).count() == 0


def test_shards(spark, frame, docs, empty):
    dims = ["n", "id"]
    got = sharding.kd_shards(frame, dims, shards=8).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)
    text = dict(docs)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy of a text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"), (F.col("id") % 7).alias("d"))
    sizes = Counter()
    for r in sharding.kd_shards(same, ["d"], shards=8).collect():
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(8)) and max(sizes.values()) <= 1.1 * min(sizes.values())
    assert sharding.kd_shards(empty, [], shards=8).count() == 0


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    df = QUERIES[name](spark, SF)
    names, want = sorted(df.columns), con.execute(ORACLES[name])
    have = [d[0] for d in want.description]
    assert sorted(have) == names
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == sorted((tuple(plain(r[have.index(c)]) for c in names) for r in want.fetchall()), key=repr)
