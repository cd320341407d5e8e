"""Operator 11: source divergence audit by joint count histograms.

How far do the sources of a language differ in their words, and which words make a source stand out? A pair of sources
is compared over all kept terms, but most terms have the same two counts as many others, and most have none in one of
the two. So terms are tallied by their combination of counts first, and the divergence is evaluated once for each
combination, times how many terms have it. The zero cells aren't made term by term: they follow from each source's own
histogram less the terms that both hold.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, materialize
from .common import arrow_map, batch, pick, slices, table

#: Bytes of a term (ASCII letters lower-cased, and all of other scripts); the others separate terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct (language, source, term) that a task counts before it hands them on.
HELD = 400_000
UNIT = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs (lang, source, text), partial sums; a row without a term for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> pa.RecordBatch:
            terms, n, docs, sizes = [], [], [], []
            for all_, seen in held.values():
                terms += [b"", *all_]
                n += [0, *all_.values()]
                docs += [0, *map(seen.__getitem__, all_)]
                sizes.append(len(all_) + 1)
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            lang, source = (pa.array(names, pa.string()).take(at) for names in zip(*held))
            held.clear()
            return batch(lang=lang, source=source, term=pa.array(terms, pa.binary()).cast(pa.string()), n=pa.array(n, pa.int64()), docs=pa.array(docs, pa.int64()))

        for part in slices(batches, 2, most_rows=1 << 14):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                own = text.translate(TERM_BYTES).split()
                all_, seen = held[lang, source]
                all_.update(own)
                seen.update(set(own))
            if sum(len(seen) for _, seen in held.values()) > HELD:
                yield flush()
        if held:
            yield flush()

    return arrow_map(docs, count, "lang string, source string, term string, n long, docs long")


def whole_counts(partial: DataFrame) -> DataFrame:
    """The sums of term_counts. Rows are dealt first: tasks have summed what they can, so that partial sums before the
    shuffle would take time and save no rows."""
    key = ("lang", "source", "term")
    return partial.repartition(*key).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exact for counts of any size."""
    big = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * big(count + 2), big(total + 2 * kept))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so longs hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def joint_histograms(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, na, nb, terms): how many kept terms occur na times in source a and nb times in source b.

    cells: (lang, source, term, n) with n > 0; pairs: (lang, a, b, kept), each two sources once. Terms of both sources are
    tallied from a join; a cell with a zero is the source's own histogram less its terms that the other holds too, and
    the terms of neither are all kept terms less both, plus those of both. All of it is one sum of signed tallies.
    """
    left = cells.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("na"))
    right = cells.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("nb"))
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count("*").alias("terms"))
    cell = lambda na, nb, terms: F.struct(na.cast("long").alias("na"), nb.cast("long").alias("nb"), terms.cast("long").alias("terms"))
    na, nb, n, zero = F.col("na"), F.col("nb"), F.col("terms"), F.lit(0)
    signed = lambda rows, *made: rows.select("lang", "a", "b", F.explode(F.array(*made)).alias("x")).select("lang", "a", "b", "x.*")
    own = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    of = lambda side, name: pairs.join(own.select("lang", F.col("source").alias(side), F.col("n").alias(name), "terms"), ["lang", side])
    parts = (
        signed(both, cell(na, nb, n), cell(na, zero, -n), cell(zero, nb, -n), cell(zero, zero, n)),
        signed(of("a", "na"), cell(na, zero, n), cell(zero, zero, -n)),
        signed(of("b", "nb"), cell(zero, nb, n), cell(zero, zero, -n)),
        signed(pairs, cell(zero, zero, F.col("kept"))),
    )
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("terms").alias("terms")).where("terms <> 0")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the divergence of a source from each other source of its
    language, part `term` its `top` terms that are more frequent in it than in the language.

    Terms are runs of ASCII letters, lower-cased, and other scripts' characters; each language keeps those in min_docs of
    its rows or more. A null language, source or text is the empty string; each row is a document, repeated ones too. A
    group without terms has smoothed shares like any other; a language without kept terms has pairs of value 0. Ties
    of values are ranked by item. An empty table gives an empty one; other columns aren't read.

    Texts are read once: tasks count terms for each group and pass partial sums on, so that a source with a third of all
    rows is spread. Terms of all sources meet by (language, term); what is made of them grows with pairs of sources, as
    the result does, and is summed by counts before it moves.
    """
    known = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    with Scratch(docs.sparkSession) as keep:
        partial = term_counts(pick(docs, lang_col, source_col, text_col).select(*known))
        counts = keep(whole_counts(partial), "term-counts")
        kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        cells = keep(counts.join(kept.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"), "cells")
        langs = kept.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("kept"))
        sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        found = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = keep(found.fillna(0, ["total", "lang_total", "kept"]), "groups")
        side = lambda name: groups.select("lang", "kept", F.col("source").alias(name), F.col("total").alias(f"total_{name}"))
        pairs = side("a").join(side("b"), ["lang", "kept"]).where("a < b")
        tallies = keep(joint_histograms(cells, pairs.select("lang", "a", "b", "kept")), "joint-histograms")
        f = apart(share(F.col("na"), F.col("total_a"), F.col("kept")), share(F.col("nb"), F.col("total_b"), F.col("kept")))
        values = tallies.join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(f * F.col("terms")).alias("value"))
        values = pairs.select("lang", "a", "b").join(values, ["lang", "a", "b"], "left")
        both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        by_pair = values.select("lang", both, F.coalesce("value", F.lit(0)).alias("value")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))
        p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
        more = cells.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
        by_term = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return materialize(by_pair.unionByName(by_term), "divergence")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents: terms in at least 10 documents of their language, the 10 first terms of each group."""
    return audit(table(spark, sf_dir, "documents"))
