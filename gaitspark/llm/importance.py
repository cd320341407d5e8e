"""Operator 7: quality classifier by importance resampling.

Two generative models of hashed n-grams, of target text and of raw text, give each document the logarithm of its
importance weight: the sum over its n-grams of log p_target - log p_raw. Documents are sampled without replacement in
proportion to their weights by Gumbel top-k: the k largest of weight + Gumbel noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_importable, materialize
from .common import arrow_map, batch, pick, table
from .shingles import hashed_words, rolled

#: Ranges in which the k-th largest key is looked for in one round.
BINS = 2048
#: Keys are compared in units of 2^-30.
UNIT = 1 << 30


@dataclass(frozen=True)
class Resampling:
    """buckets: of n-gram hashes. max_target_rows: the target model is fitted on no more labelled documents than this
    (those whose ids have the smallest hashes). passage: None for the plain sum; else a document of n n-grams competes as a
    passage of so many of its kind, passage * sum / (n + shrink), so that long documents' weights aren't extreme."""

    buckets: int = 10_000
    orders: tuple[int, ...] = (1, 2)
    max_target_rows: int = 20_000
    passage: int | None = None
    shrink: int = 16
    seed: int = 7


def ngram_buckets(texts: list[str | None], how: Resampling) -> list[np.ndarray]:
    return [
        (np.concatenate([rolled(h, n) for n in how.orders]) % np.uint64(how.buckets)).astype(np.int64)
        for h in hashed_words(texts)
    ]


def fit(docs: DataFrame, target: DataFrame, how: Resampling) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with one added to all counts. docs: (id, text); target: (id)."""
    chosen = target.where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(how.max_target_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, how.buckets), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found, wanted = ngram_buckets(part.column(0).to_pylist(), how), part.column(1).to_pylist()
                for k, own in enumerate((found, [x for x, w in zip(found, wanted) if w])):
                    if own:
                        total[k] += np.bincount(np.concatenate(own), minlength=how.buckets)
        yield batch(bucket=pa.array(np.arange(how.buckets), pa.int64()), raw=pa.array(total[0]), target=pa.array(total[1]))

    marked = docs.join(F.broadcast(chosen.withColumn("wanted", F.lit(True))), "id", "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    rows = arrow_map(marked, count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    counts = np.ones((2, how.buckets))
    for bucket, raw, wanted in rows:
        counts[:, bucket] += raw, wanted
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return logs[1] - logs[0]


def log_weights(docs: DataFrame, model: np.ndarray, how: Resampling) -> DataFrame:
    """(id, n_ngrams, log_weight) for each row of docs (id, text)."""
    ensure_importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found = ngram_buckets(part.column(1).to_pylist(), how)
                weights = [float(shared.value[f].sum()) for f in found]
                if how.passage:
                    weights = [how.passage * w / (len(f) + how.shrink) for w, f in zip(weights, found)]
                yield batch(id=part.column(0), n_ngrams=pa.array(list(map(len, found)), pa.int64()), log_weight=pa.array(weights, pa.float64()))

    return arrow_map(docs, score, f"id {docs.schema['id'].dataType.simpleString()}, n_ngrams long, log_weight double")


def gumbel(ident: Column, seed: int) -> Column:
    """Noise that depends on the id and seed only."""
    uniform = (F.shiftrightunsigned(F.xxhash64(ident, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, key: str, k: int) -> int:
    """The k-th largest of an integer column, from counts in BINS ranges a round."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    while lo < hi:
        step = -(-(hi - lo + 1) // BINS)
        counts = rows.where(F.col(key).between(lo, hi)).groupBy(F.floor((F.col(key) - lo) / step).cast("long").alias("bin")).count().collect()
        for b, n in sorted(((r["bin"], r["count"]) for r in counts), reverse=True):
            if k <= n:
                break
            k -= n
        lo, hi = lo + b * step, min(lo + (b + 1) * step - 1, hi)
    return lo


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: float,
    how: Resampling = Resampling(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_ngrams, log_weight, key): the ceil(share * rows) rows of docs with the largest log_weight + Gumbel noise.

    target has the ids of documents of the target kind in the column id_col. A null or empty text has weight 0. The noise
    follows from the id, so a run can be repeated; rows of one id and text have one key, and rows that share the last key
    stay together, so that there may be more than k. An empty table gives an empty one; without target rows all weights
    come from the smoothing. Extra columns aren't read.
    """
    slim = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(slim, pick(target, id_col).select(F.col(id_col).alias("id")), how)
    keyed = log_weights(slim, model, how).withColumn("key", F.col("log_weight") + gumbel(F.col("id"), how.seed))
    rows = materialize(keyed.withColumn("rank_key", F.round(F.col("key") * UNIT).cast("long")), "weights")
    k = math.ceil(share * rows.count() - 1e-9)
    out = rows.where(F.col("rank_key") >= kth_largest(rows, "rank_key", k)) if k else rows.limit(0)
    return out.select(F.col("id").alias(id_col), "n_ngrams", "log_weight", "key")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample of documents like those labelled good and not toxic, as large as the labels' share of these; without labels,
    all documents."""
    labels, wanted = table(spark, sf_dir, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0)
    share = labels.agg(F.avg(wanted.cast("double"))).first()[0]
    return resample(table(spark, sf_dir, "documents"), labels.where(wanted), 1.0 if share is None else share).withColumn("kept", F.lit(True))
