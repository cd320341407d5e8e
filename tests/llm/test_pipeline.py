"""The pipeline's rows against its stages by brute force."""

import random

import brute
import corpus_pipeline

from gaitspark.llm.quality_rules import RepetitionRules

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if brute.quality(t, RepetitionRules())[-1]]
    docs = [(d, t) for d, t in brute.line_dedup(docs).items() if brute.words(t)]
    same = brute.components(docs, 5, 80)
    docs = [(d, t) for d, t in docs if same[d][1] == d]
    hit = {d for d, _ in brute.contained(docs, items)}
    want = brute.bpe([(d, t) for d, t in docs if d not in hit])
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < 200


def test_awkward_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, a column named as one of the stages' own, a benchmark item, near copies and an empty table, through all stages."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    item, base = fresh(12), fresh(80)
    near, held = [*base[:-1], "other"], [*fresh(60), *item]
    texts = [(1, " ".join(base)), (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(held)), (None, " ".join(fresh(40))), (None, None), (4, ""), (5, None), (6, "too few"), (7, " ".join(fresh(50_000))), (8, " ".join(fresh(30))), (8, " ".join(fresh(31)))]
    rows = [(*r, "en", "s", len(r[1] or ""), "x") for r in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")
    for name, some in (("full", docs), ("none", docs.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(9, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "7", "8", "8", "None"]
    want = {r: brute.bpe([(0, t)])[0] for r, t in enumerate(t for d, t in texts if d in (1, 7, 8) or d is None and t)}
    assert sorted((r.n_tokens, r.ids_sha256) for r in got) == sorted(v[:2] for v in want.values())
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
