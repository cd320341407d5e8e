"""Cases of a verdict: awkward rows of the operators and the pipeline's stages, and methods that must be what does the work."""

import json
import random
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

from gaitspark.llm import bpe_automaton, ngram_join, passages, sharding, token_counts
from gaitspark.llm.decontamination import contained_items, decontamination_stage
from gaitspark.llm.line_dedup import line_stage
from gaitspark.llm.ngram_join import jaccard_components, jaccard_stage
from gaitspark.llm.quality_rules import quality_stage
from gaitspark.llm.url_filters import judge, rules_table


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with null and repeated ids, null, empty and long texts, repeated rows and a clashing column; a benchmark."""
    rng = random.Random(8)
    at = tmp_path_factory.mktemp("odd")
    item = " ".join(fresh(rng, 12))
    text = [" ".join(fresh(rng, 60)) for _ in range(4)]
    rows = [(1, text[0], "a"), (1, text[0], "a"), (1, text[1], "b"), (2, text[0], "c"), (None, text[2], "d"), (None, None, "e"), (3, "", "f"), (4, None, "g"), (5, " ".join(fresh(rng, 60_000)), "h"), (6, f"{text[3]} {item}", "i")]
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT string").withColumn("n_chars", F.length(F.col("doc_id").cast("string")).cast("int")), str(at)


@pytest.mark.parametrize("stage, kept", [(quality_stage, "aabcdhi"), (line_stage, "aabcdhi"), (jaccard_stage, "aabdefghi"), (decontamination_stage, "aabcdefgh")])
def test_stages(spark, odd, stage, kept):
    docs, at = odd
    got = stage(spark, docs, at)
    assert got.columns == docs.columns and "".join(sorted(r[2] for r in got.collect())) == kept
    assert stage(spark, docs.limit(0), at).count() == 0


def test_bpe_stage(spark, odd):
    docs, at = odd
    rows = [r[:2] for r in docs.collect()]
    want = sorted((str(d), *list(brute.bpe([(0, t)]).values())[0]) for d, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in bpe_automaton.bpe_stage(spark, docs, at).collect()) == want
    assert bpe_automaton.bpe_stage(spark, docs.limit(0), at).count() == 0


def test_vocabularies_that_are_refused(tmp_path):
    spec = json.loads(Path(brute.VOCABULARY).read_text())
    cases = {"two merges": lambda s: s["model"]["merges"].append(s["model"]["merges"][-1]), "ignore_merges": lambda s: s["model"].update(ignore_merges=True), "prefix": lambda s: s["pre_tokenizer"].update(add_prefix_space=True), "regex": lambda s: s["pre_tokenizer"].update(use_regex=False)}
    for name, spoil in cases.items():
        changed = json.loads(json.dumps(spec))
        spoil(changed)
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(changed))
        with pytest.raises(ValueError):
            bpe_automaton.TokenAutomaton(str(path))


def test_decoding_bytes_that_are_not_text(spark):
    tokens = bpe_automaton.automaton(brute.VOCABULARY)
    ids = tokens.encode(["é"]).to_pylist()[0]
    from tokenizers import Tokenizer

    cases = [ids, [*ids, 50256], None, []] + [[i] for i in range(256)]
    got = [r.text for r in bpe_automaton.decode(spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "doc_id long, ids array<int>").coalesce(1), brute.VOCABULARY).orderBy("doc_id").collect()]
    assert got == [Tokenizer.from_file(brute.VOCABULARY).decode(x or [], skip_special_tokens=False) for x in cases]


def test_items_of_one_id_with_other_windows(spark):
    items = spark.createDataFrame([(7, "a b"), (7, "c d e f g h"), (8, "x y z u v w"), (8, "x y z u v w")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "q a b c d e f g h"), (2, "q c d e f g h"), (3, "a b q"), (4, "x y z u v w"), (4, "x y z u v w")], "doc_id long, text string")
    got = sorted(tuple(r) for r in contained_items(docs, items, percent=60).collect())
    assert got == [(1, 7, 3, 3), (2, 7, 3, 2), (4, 8, 2, 2)]


def test_long_hosts(spark):
    host = ".".join(["a"] * 20_000) + ".example.org"
    got = judge(spark.createDataFrame([(1, f"http://{host}/es/x")], "page_id long, url string").select("*", F.lit(1).alias("HOST"), F.lit(2).alias("URL")), rules_table(spark)).collect()
    assert [(r.rule, r.verdict) for r in got] == [("example.org/es/", "block")]


def test_shards_of_string_and_null_ids(spark):
    rows = [(f"doc {i}", f"text {i % 7} " * (1 + i % 5), i % 3) for i in range(200)] + [(None, "none", 1), (None, None, None)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id string, text string, d int"), ["d"], target_bytes=700).collect()
    total = sum(r.size for r in got)
    shards = {r.shard for r in got}
    assert len(got) == 202 and shards == set(range(-(-total // 700)))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in shards)
    assert max(sum(r.size for r in got if r.shard == s) for s in shards) <= 2 * 700


def test_cache_answers_and_only_misses_are_added(spark, tmp_path):
    cache = f"{tmp_path}/cache"
    first = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None)], "doc_id long, text string")
    token_counts.token_counts(first, brute.VOCABULARY, cache).collect()
    more = spark.createDataFrame([(1, "one two"), (4, "four four"), (5, "four four")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, brute.VOCABULARY, cache).collect()}
    assert got == {d: n for d, (n, _, _) in brute.bpe([(1, "one two"), (4, "four four"), (5, "four four")]).items()}
    assert spark.read.parquet(cache).count() == 4


def test_alignment_grows_beyond_its_margin(spark):
    """Every other k-mer is spoilt but in the middle, so that the chain is short and the alignment long."""
    rng = random.Random(6)
    shared = fresh(rng, 2400)
    other = [w if 1150 <= k < 1250 or k % 6 else "zz" for k, w in enumerate(shared)]
    df = spark.createDataFrame([(1, " ".join(shared)), (2, " ".join(other))], "doc_id long, text string")
    (row,) = passages.repeated_passages(df).collect()
    assert (row.start_word, row.end_word) == (1, 2400) and row.n_equal == sum(a == b for a, b in zip(shared, other))


def test_links_come_from_groups(spark, monkeypatch):
    rng = random.Random(2)
    docs = []
    for f in range(40):
        base = fresh(rng, 80)
        docs += [(100 * f + k, " ".join(base[:k] + fresh(rng, 1) + base[k + 1 :])) for k in range(0, 80, 2)]
    found = []
    real = ngram_join.group_links

    def counted(*a, **b):
        out = real(*a, **b)
        found.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "group_links", counted)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute.components(docs, 3, 90)
    assert sum(found) >= len(docs) - len({c for _, c in got.values()}) > 1000
