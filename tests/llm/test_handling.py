"""Nulls, ties, repeated rows, clashing columns and long texts of operators 1, 2, 5, 7, 8 and 10."""

import math
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gaitspark.llm import importance, passages, sharding, token_counts
from gaitspark.llm.decontamination import contained_items
from gaitspark.llm.importance import Resampling
from gaitspark.llm.shingles import hashed_words, rolled
from gaitspark.llm.url_filters import judge


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_passages_in_awkward_texts(spark):
    """A passage in the middle of a very long text, periodic texts, clashing columns, nulls and an empty table."""
    rng = random.Random(2)
    shared = fresh(rng, 70)
    texts = {1: " ".join(shared), 2: " ".join([*fresh(rng, 30_000), *shared, *fresh(rng, 30_000)]), 3: "la " * 400, 4: "la " * 300, 5: "", 6: None}
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()] + [(None, texts[1], "y")], "doc_id long, text string, TEXT string")
    got = {(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(docs).collect()}
    assert (2, 1) in got and got <= {(2, 1), (4, 3)}
    assert passages.repeated_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_vocabularies(spark, tmp_path, name):
    """A sentencepiece model and a vocabulary that isn't in merge order; null and repeated ids and texts."""
    path = public_tokenizers.path(name)
    texts = ["Hello, world! ", "", None, "naïve café 語", "a b  c\n", "Hello, world! ", "x" * 3000]
    rows = [(None if i % 3 == 0 else i // 2, t) for i, t in enumerate(texts)]
    got = sorted((str(r[0]), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path, f"{tmp_path}/cache").collect())
    if name.endswith(".model"):
        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        count = lambda t: len(brute.Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    assert got == sorted((str(d), len((t or "").encode()), count(t or "")) for d, t in rows)


def test_urls_with_ties_and_null_ids(spark):
    rules = spark.createDataFrame([("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("allow", "org", "/x/long"), (None, None, None)], "verdict string, host string, path string")
    pages = [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://b.a.org/x/long?q"), (2, None), (3, "no host"), (4, "http://b.org/x/longer")]
    got = sorted(map(str, (tuple(r) for r in judge(spark.createDataFrame([(*p, "u") for p in pages], "page_id long, url string, URL string"), rules).collect())))
    want = [(1, "a.org", "/x", "a.org/x", "block")] * 2 + [(None, "b.a.org", "/x/long", "org/x/long", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "b.org", "/x/longer", "org/x/long", "allow")]
    assert got == sorted(map(str, want))


def test_importance_against_a_plain_version(spark):
    """Weights from counts of hashed n-grams, the target's rows by labels; nulls, repeated rows, ties and a long text."""
    rng = random.Random(6)
    say = lambda vocabulary, n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, say("abcdef" if i % 3 else "abwxyz", rng.randrange(1, 30))) for i in range(90)] + [(3, "a b"), (3, "a b"), (None, "w x"), (None, None), (95, ""), (96, None), (97, say("abcd", 30_000))]
    target = [i for i in range(0, 90, 3)]
    how = Resampling(buckets=64)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Doc_Id long").repartition(3)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target + target[:3]], "doc_id long"), 0.4, how).collect()
    grams = [np.concatenate([rolled(h, n) for n in how.orders]).astype(np.uint64) % np.uint64(64) for h in hashed_words([t for _, t in rows])]
    raw, wanted = Counter(), Counter()
    for (d, _), g in zip(rows, grams):
        raw.update(g.tolist())
        if d in target:
            wanted.update(g.tolist())
    log = [math.log((wanted[b] + 1) / (wanted.total() + 64)) - math.log((raw[b] + 1) / (raw.total() + 64)) for b in range(64)]
    weights = sorted(((d, len(g), round(sum(log[b] for b in g.tolist()), 6)) for (d, _), g in zip(rows, grams)), key=repr)
    whole = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "doc_id long"), 1.0, how).collect()
    assert sorted(((r.doc_id, r.n_ngrams, round(r.log_weight, 6)) for r in whole), key=repr) == weights
    keys = sorted((r.key for r in whole), reverse=True)
    k = math.ceil(0.4 * len(rows))
    assert sorted(r.key for r in got) == sorted(x for x in keys if x >= keys[k - 1] - 1e-9)


def test_benchmark_items_with_odd_columns(spark):
    rng = random.Random(1)
    item = " ".join(fresh(rng, 10))
    items = spark.createDataFrame([(7, item, "t", None), (7, item, "t", None), (None, " ".join(fresh(rng, 9)), "", ""), (8, None, "", ""), (9, "", "", "")], "item_id long, text string, TEXT string, doc_id string")
    docs = spark.createDataFrame([(1, f"x {item} y", 3), (1, "other", 3), (None, item, 3), (2, None, 3)], "doc_id long, text string, item_id long")
    assert sorted((str(r.doc_id), r.item_id, r.n_shingles, r.n_found) for r in contained_items(docs, items).collect()) == [("1", 7, 6, 6), ("None", 7, 6, 6)]


def test_shards_of_repeated_rows_and_ties(spark):
    """Rows that repeat, ids that tie, one value in every dimension: all are placed, sizes are near equal, slots have no gaps."""
    rows = [(i % 40 if i % 7 else None, "same text" if i % 3 else f"text {i % 50}", 5) for i in range(600)] + [(1, "same text", 5)] * 200
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, d int, D int").repartition(5)
    for shards in (3, 50):
        got = sharding.kd_shards(docs, ["d"], shards=shards).collect()
        assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(t) + 1) for d, t, _ in rows)
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    sizes = Counter()
    for r in sharding.kd_shards(docs.dropDuplicates(["doc_id", "text"]), ["d"], shards=4).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 0.25 * sum(sizes.values()) / 4


def test_plans_dont_grow_with_shards(spark, monkeypatch):
    """The plan of a level is as long for many nodes as for a few."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), (F.xxhash64("id") % 1000).alias("d"))
    plans = []
    descended = sharding.descended

    def seen(rows, cuts, paths):
        out = descended(rows, cuts, paths)
        plans.append((len(cuts), len(out._jdf.queryExecution().analyzed().toString())))
        return out

    monkeypatch.setattr(sharding, "descended", seen)
    got = sharding.kd_shards(docs, ["d"], shards=100).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(got) == 100 and max(r.n for r in got) < 1.3 * 3000 * 65 / 100
    assert plans[-1][0] > 16 and plans[-1][1] < 1.5 * plans[0][1]
