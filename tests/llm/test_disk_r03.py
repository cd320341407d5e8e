"""Tables that a step of the Jaccard join needs no longer go before the join ends (findings of round 3)."""

import os

from gaitspark.llm import ngram_join
from gaitspark.session import Scratch, materialize


def test_tables_go_early(spark, monkeypatch):
    with Scratch(spark) as keep:
        left, gone = keep(spark.range(3), "sized-members"), keep(spark.range(3), "sized")
        keep.drop("sized")
        assert left.count() == 3 and not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))
        assert len(keep.paths) == 1
    made, at_end = [], []

    class Watched(Scratch):
        def __exit__(self, *a):
            at_end.append({p.rpartition("/")[2].rpartition("-")[0] for p in self.paths})
            super().__exit__(*a)

    monkeypatch.setattr(ngram_join, "Scratch", Watched)
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: made.append((name, df.columns)) or materialize(df, name))
    texts = [" ".join(f"w{i}" for i in range(60)) + (f" end{k}" if k % 2 else "") for k in range(4)] + ["other words " * 30, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 3, 90).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5}
    assert not set().union(*at_end) & {"matrix", "placed", "open-tokens", "marks", "unions", "group-bands", "groups"}
    assert "prefix" not in dict(made)["classes"]


def test_tables_of_all_rows_are_narrow(spark, monkeypatch):
    """What stays for all rounds has no list that grows with a text: marks are made for the classes that a round asks for
    only, and the first round takes the shared tokens as they are."""
    stays, passing = {}, []

    class Watched(Scratch):
        def __call__(self, df, name):
            out = super().__call__(df, name)
            passing.append((name, out.count()))
            return out

    monkeypatch.setattr(ngram_join, "Scratch", Watched)
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: stays.update({name: df.dtypes}) or materialize(df, name))
    texts = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(100)]
    # near copies of each of the first ten, one of them twice, and the same id with another text
    rows = list(enumerate(texts)) + [(1000 + 10 * j + k, f"{t} end{j}") for j in range(2) for k, t in enumerate(texts[:10])]
    docs = spark.createDataFrame(rows + [rows[-1], (5000, texts[50]), (5000, texts[9] + " last")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs, 3, 90).collect())
    near = [(1000 + 10 * j + k, k) for j in range(2) for k in range(10)]
    assert got == [*((k, k) for k in range(100)), *near, (1019, 9), (5000, 9), (5000, 50)]
    assert {n for cols in stays.values() for n, kind in cols if kind.startswith("array")} == {"bands"}
    asked = [n for name, n in passing if name == "wanted-marks"]
    assert asked and 0 < max(asked) <= 31
    assert sum(name == "bridges" for name, _ in passing) == ngram_join.ROUNDS - 1
