"""Operator 6: line dedup.

Lines are exploded, normalised and hashed; documents are counted for each hash, and a line whose key enough documents
hold goes from all of them but the one with the largest id. What is left is joined again in its old order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACE, arrow_map, batch, pick, table, with_ids


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """A digest of each line's key, None where the key is shorter than min_chars code points."""
    out: list[bytes | None] = []
    strip = SPACE.encode()
    for line in (text or "").encode().lower().split(b"\n"):
        key = line.strip(strip)
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return out


def drop_common_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, text (kept lines joined by a line feed), n_lines, n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. Lines whose key has min_chars code points
    or more and is in min_docs documents or more go, except in the largest id that holds the key, where all of them stay.
    A null or empty text is one empty line. Rows with the same id are one document for the counts; rows with a null id
    don't count and keep all their lines. Only the id and text are read.

    Two passes over the texts: the first makes 24 bytes a distinct line, which are counted with partial aggregates (so
    that a line of a third of all documents is spread) and joined back; the second joins each document with the digests
    that it loses, at most one for each of its own lines.
    """
    out = rejoined(pick(docs, id_col, text_col), min_chars, min_docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_dropped")


def rejoined(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str, carried: Sequence[str] = ()) -> DataFrame:
    """id, text, n_lines, n_dropped and `row`, a struct of the carried columns, of each row of docs."""
    slim = pick(docs, id_col, text_col)
    kind = slim.schema[0].dataType.simpleString()
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("boolean")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                at, keys = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    own = {k for k in line_keys(t, min_chars) if k}
                    at += [i] * len(own)
                    keys += own
                yield batch(id=part.column(0).take(pa.array(at, pa.int32())), line=pa.array(keys, pa.binary()))

    lines = materialize(arrow_map(slim.where(F.col(id_col).isNotNull()), explode, f"id {kind}, line binary"), "lines")
    counted = lines.groupBy("line").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    common = materialize(counted, "common-lines")  # a table, so that the join below may split a line that most documents hold
    lost = with_ids(lines, common, "line").where(F.col("id") != F.col("keeper")).groupBy("id").agg(F.collect_set("line").alias("lost"))

    def rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts, n_lines, n_dropped = [], [], []
                for t, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    own = (t or "").split("\n")
                    n_lines.append(len(own))
                    if gone:
                        gone = set(gone)
                        own = [x for x, k in zip(own, line_keys(t, min_chars)) if k not in gone]
                    n_dropped.append(n_lines[-1] - len(own))
                    texts.append("\n".join(own))
                yield batch(id=part.column(0), row=part.column(3), text=pa.array(texts, pa.string()), n_lines=pa.array(n_lines, pa.int64()), n_dropped=pa.array(n_dropped, pa.int64()))

    whole = pick(docs, id_col, text_col, *carried)
    whole = whole.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row.alias("row"))
    joined = whole.join(lost, "id", "left").select("id", "text", "lost", "row")
    return arrow_map(joined, rejoin, f"id {kind}, row {whole.schema['row'].dataType.simpleString()}, text string, n_lines long, n_dropped long")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of 20 code points or more that 3 documents or more hold."""
    out = drop_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without their common lines; n_chars, where there is one, follows the text; rows left without words go. The
    other columns are carried through, so that null and repeated ids keep their own rows. Rows of one id are one document
    for the counts, rows with a null id don't count; an empty table stays empty."""
    names = docs.columns
    plain = [f"_{i}" for i in range(len(names))]  # whatever the columns' names
    ident, text, size = (plain[names.index(c)] if c in names else None for c in ("doc_id", "text", "n_chars"))
    carried = [c for c in plain if c not in (ident, text, size)]
    out = rejoined(docs.toDF(*plain), 20, 3, ident, text, carried)
    made = {ident: F.col("id"), text: F.col("text")} | {c: F.col(f"row.{c}") for c in carried}
    if size:
        made[size] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*[made[c].alias(c) for c in plain]).toDF(*names)
