"""Cases of a review in which operators did less than the whole job."""

import random

import pytest

from gaitspark.llm import passages
from gaitspark.llm.importance import op7_importance_resampling
from gaitspark.llm.line_dedup import line_stage
from gaitspark.llm.ngram_join import jaccard_stage


def found_passages(spark, docs):
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    return {(r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(df).collect()}


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_second_passage_after_a_long_one(spark):
    rng = random.Random(1)
    long, second = fresh(rng, 1000), fresh(rng, 90)
    a = long + fresh(rng, 120) + second
    b = long + fresh(rng, 120) + second[:30] + ["new"] + second[30:60] + ["new"] + second[60:]
    assert found_passages(spark, [(1, a), (2, b)]) == {(2, 1, 0, 1000), (2, 1, 1120, 1212)}


def test_passage_whose_parts_have_other_first_holders(spark):
    rng = random.Random(2)
    docs, want = [], set()
    for i in range(0, 400, 4):
        # parts that overlap, are next to each other, or cover nearly all
        shared, (x, y) = fresh(rng, 60), [(30, 30), (40, 20), (45, 12)][i // 4 % 3]
        docs += [(i, fresh(rng, 40) + shared[:x] + fresh(rng, 40)), (i + 1, fresh(rng, 50) + shared[y:] + fresh(rng, 40))]
        docs += [(i + 2, fresh(rng, 70) + shared + fresh(rng, 20)), (i + 3, fresh(rng, 30) + shared + fresh(rng, 60))]
        want.add((i + 3, i + 2, 30, 90))
    got = found_passages(spark, docs)
    assert want <= {(d, s, lo, hi) for d, s, lo, hi in got if hi - lo == 60} and {d % 4 for d, *_ in got} == {3}


def test_passage_counts_by_its_length(spark):
    rng = random.Random(3)
    shared = fresh(rng, 56)
    other = [w if k not in (10, 18, 26, 34, 42, 50, 51) else "zz" for k, w in enumerate(shared)]  # 49 equal words of 56
    got = found_passages(spark, [(1, fresh(rng, 40) + shared + fresh(rng, 40)), (2, fresh(rng, 40) + other + fresh(rng, 40))])
    assert [(d, s) for d, s, *_ in got] == [(2, 1)]


def test_stages_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    line = "a line that most of the documents hold"
    rows = [(1, f"first text of one\n{line}"), (1, f"second text of one\n{line}"), (1, f"third text of one\n{line}"), (2, f"text of two\n{line}"), (9, f"text of nine\n{line}"), (None, f"no id\n{line}"), (None, "no id either")]
    df = spark.createDataFrame([(d, t, f"source {k}", len(t)) for k, (d, t) in enumerate(rows)], "doc_id long, text string, source string, n_chars long")
    got = line_stage(spark, df, "")
    assert got.columns == df.columns
    want = [(d, t if d in (None, 9) else t.split("\n")[0], f"source {k}") for k, (d, t) in enumerate(rows)]
    assert sorted(map(str, ((r.doc_id, r.text, r.source) for r in got.collect()))) == sorted(map(str, want))
    assert all(r.n_chars == len(r.text) for r in got.collect())
    text = " ".join(fresh(rng, 40))
    near = spark.createDataFrame([(3, text), (3, " ".join(fresh(rng, 40))), (5, text), (None, text), (None, "alone")], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in jaccard_stage(spark, near, "").collect()]
    assert sorted(str(d) for d, _ in kept) == ["3", "3", "None", "None"]
    assert jaccard_stage(spark, near, "").columns == near.columns


@pytest.mark.parametrize("labels, kept", [([(0, 1, 0), (1, 1, 1), (2, 0, 0), (3, 0, 1)], 10), ([(0, 0, 0), (1, 0, 1)], 0), ([(0, 1, 1)], 0), ([], 40)])
def test_sample_is_the_share_of_the_target(spark, tmp_path, labels, kept):
    rng = random.Random(5)
    spark.createDataFrame([(i, " ".join(fresh(rng, 30))) for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert op7_importance_resampling(spark, str(tmp_path)).count() == kept
