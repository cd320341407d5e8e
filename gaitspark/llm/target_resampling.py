"""Operator 12: resampling of documents towards the distribution of a target, with n-grams from suffix arrays.

The words of a batch become numbers, and their places are sorted by the words that follow: equal n-grams lie side by
side, and the common prefixes of neighbours (LCP) tell where a run of them ends. Each run is hashed once, whatever its
length; the buckets are then dealt back to the places for the documents' scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from ..session import ensure_importable, materialize
from .common import arrow_map, batch, pick, slices, table
from .importance import kth_largest

#: Bytes of a word (ASCII digits and letters, lower-cased, and all of other scripts); the others separate words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of texts that share one suffix array; a longer text has its own.
TOGETHER = 2 << 20


@dataclass(frozen=True)
class Towards:
    """buckets: of n-gram hashes. longest: words of the longest n-gram. percent: of the rows with min_words or more."""

    buckets: int = 10_000
    longest: int = 2
    min_words: int = 20
    percent: int = 25
    seed: int = 7


@dataclass
class Numbered:
    """The words of some texts: a number each, their places in `joined` (all words, a space between), how many words their
    text has from there, and the number of words of each text."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    joined: bytes
    left: np.ndarray
    counts: np.ndarray


def numbered_words(texts: list[bytes | None]) -> Numbered:
    own = [(t or b"").translate(WORD_BYTES).split() for t in texts]
    flat = pa.array(list(chain.from_iterable(own)), pa.binary())
    counts = np.fromiter(map(len, own), np.int64, len(own))
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1) - 1
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(flat))
    return Numbered(ids, ends - sizes, ends, b" ".join(flat.to_pylist()), left, counts)


def suffix_array(w: Numbered, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): all places sorted by up to `depth` words of their text from there, by prefix doubling, and how many
    words each shares with the place before it in that order."""
    n = len(w.ids)
    rank, have = w.ids + 1, 1
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(n, np.int64)  # 0: the text has ended
        there = np.flatnonzero(w.left > step)
        after[there] = rank[there + step]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1
        have += step
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    same = np.ones(max(0, n - 1), bool)
    for k in range(depth):
        a, b = order[:-1], order[1:]
        same &= (w.left[a] > k) & (w.left[b] > k)
        at = np.flatnonzero(same)
        same[at] = w.ids[a[at] + k] == w.ids[b[at] + k]
        lcp[1:] += same
    return order, lcp


def bucket_runs(texts: list[bytes | None], how: Towards) -> Iterator[tuple[Numbered, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the words, the places that begin an n-gram, run by run, each run's length and each run's bucket."""
    w = numbered_words(texts)
    order, lcp = suffix_array(w, how.longest)
    view = memoryview(w.joined)
    for n in range(1, how.longest + 1):
        whole = w.left[order] >= n  # a place too near its text's end is a run of its own, for nothing shares n words with it
        heads = np.flatnonzero((lcp < n) & whole)
        places = order[whole]
        lengths = np.diff(np.append(np.flatnonzero((lcp < n)[whole]), len(places)))
        first = order[heads]
        hashed = [zlib.crc32(view[a:b]) % how.buckets for a, b in zip(w.starts[first].tolist(), w.ends[first + n - 1].tolist())]
        yield w, places, lengths, np.array(hashed, np.int64)


def bucket_counts(texts: DataFrame, how: Towards) -> np.ndarray:
    """How many n-grams of the texts (a column) fall in each bucket: at most `buckets` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for part in slices(batches, 0, TOGETHER, 1 << 14):
            for _, _, lengths, hashed in bucket_runs(part.column(0).cast(pa.binary()).to_pylist(), how):
                np.add.at(total, hashed, lengths)
        at = np.flatnonzero(total)
        yield batch(bucket=pa.array(at, pa.int64()), n=pa.array(total[at]))

    out = np.zeros(how.buckets, np.int64)
    for bucket, n in arrow_map(texts, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the smoothed ratio of target to raw frequency, rounded down."""
    k, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, how: Towards) -> DataFrame:
    """(id, n_words, n_features, weight) of docs (id, text): the mean gain of a document's n-grams, rounded down."""
    ensure_importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, TOGETHER, 1 << 14):
            sums = n_features = 0
            for w, places, lengths, hashed in bucket_runs(part.column(1).cast(pa.binary()).to_pylist(), how):
                at_place = np.zeros(len(w.ids) + 1, np.int64)
                at_place[places + 1] = np.repeat(shared.value[hashed], lengths)
                until, ends = np.cumsum(at_place), np.cumsum(w.counts)
                sums = sums + until[ends] - until[ends - w.counts]
                begun = np.zeros(len(w.ids) + 1, np.int64)
                begun[places + 1] = 1
                upto = np.cumsum(begun)
                n_features = n_features + upto[ends] - upto[ends - w.counts]
            yield batch(id=part.column(0), n_words=pa.array(w.counts), n_features=pa.array(n_features), weight=pa.array(np.floor_divide(sums, np.maximum(n_features, 1))))

    return arrow_map(docs, score, f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(ident: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the id and the seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def resample_towards(docs: DataFrame, target: DataFrame, how: Towards = Towards(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of docs: the `percent` of the rows with min_words or more that
    have the largest weight + Gumbel noise are drawn, and ranked from 1; the others' rank is null.

    Features are all runs of 1 to `longest` words, repeats counted. A null or empty text has no features and weight 0. A
    null id has the noise of an empty one and comes last in a tie; equal scores are ranked by id, and repeated rows compete
    each for itself. Without target texts all weights come from the smoothing; an empty table gives an empty one. Other
    columns aren't read.

    Texts are read twice, for counts and for weights, and never moved. The smallest drawn score is found from counts in
    ranges of scores; the drawn rows are ranked in ranges, so that no task has them all.
    """
    slim = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gains = bucket_gains(bucket_counts(slim.select("text"), how), bucket_counts(pick(target, target_text_col), how))
    rows = materialize(weighted(slim, gains, how).withColumn("score", F.col("weight") + noise(F.col("id"), how.seed)), "scores")
    able = rows.where(F.col("n_words") >= how.min_words)
    k = how.percent * able.count() // 100
    if not k:
        return rows.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    near = (F.col("n_words") >= how.min_words) & (F.col("score") >= kth_largest(able, "score", k))
    placed = numbered(rows.where(near), [F.desc("score"), F.asc_nulls_last("id")], "rank").withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    out = placed.unionByName(rows.where(~near).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the texts of the benchmark."""
    return resample_towards(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
