"""Operator 1: substring dedup by collinear chaining.

Documents are sampled by minimizers: of each few consecutive k-mers of words, the one with the smallest hash. Seeds that
several documents share are joined with the first of these documents (a link for each occurrence, never all pairs): the
n-th occurrence of a seed in a document with the n-th in its source, or with the first where no source has so many. Where
a passage's seeds have first holders that each hold a part of it only, windows as long as a whole passage are linked, too.
The matches of two documents are chained in order with gap costs, and each chain is aligned
on the words of both sides: seeds are filled and extended word by word. Alignments that are long and alike enough are
the repeated passages.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, materialize
from .common import arrow_map, batch, pick, table, with_ids
from .shingles import hashed_words, mixed, rolled


@dataclass(frozen=True)
class Passages:
    """k-mers of `kmer` words, one of `window` consecutive ones sampled; gaps cost gap_cost a word and break a chain over
    max_gap words; an alignment grows beyond its chain until it has lost `drop` points (an equal word is one, another costs
    two), and counts with min_words words on both sides and with equal words that are min_identity of its longer side.
    margin: words beyond a chain that are compared first; where these don't do, more are."""

    kmer: int = 6
    window: int = 12
    gap_cost: float = 0.25
    max_gap: int = 48
    margin: int = 64
    drop: int = 32
    min_words: int = 50
    min_identity: float = 0.8


def minimizers(hashes: np.ndarray, kmer: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the sampled k-mers of one document's words."""
    mers = rolled(hashes, kmer)
    if not len(mers):
        return mers, np.empty(0, np.int64)
    views = sliding_window_view(mers, min(window, len(mers)))
    at = np.unique(np.arange(len(views)) + views.argmin(axis=1))
    if (again := mers[at[1:]] == mers[at[:-1]]).any():
        # in periodic text each place is a minimum: one in `window` is enough
        keep, last = [int(at[0])], 0
        for k, same in enumerate(again.tolist(), 1):
            if not same or at[k] - at[last] >= window:
                keep.append(int(at[k]))
                last = k
        at = np.array(keep)
    return mers[at], at


def occurrences(seeds: np.ndarray) -> np.ndarray:
    """For each seed of a document how often the document had it before."""
    order = np.argsort(seeds, kind="stable")
    ranked = seeds[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(seeds) else np.empty(0, np.int64)
    out = np.empty(len(seeds), np.int32)
    out[order] = np.arange(len(seeds)) - np.repeat(starts, np.diff(np.append(starts, len(seeds))))
    return out


#: Matches of a stretch that are compared with all of the stretch before, until trees are made of it.
FEW_ASKED = 4


def chains(p: list[int], q: list[int], how: Passages) -> Iterator[list[int]]:
    """Chains of distinct matches (p[i], q[i]), which come sorted by p and then q, as lists of indices; the best first.

    A link from j to i costs gap_cost * (p_i - p_j + q_i - q_j); it exists where both coordinates grow, by no more than
    max_gap. So i's best predecessor has the largest score + gap_cost * (p + q) among the matches before it in both, which
    Fenwick trees over the ranks of q give. To keep to max_gap, both coordinates are cut into stretches as long as the
    gap: a predecessor is in the match's own stretch or the one before. In the own stretch of q it is among the first
    ranks, in the one before among the last. In the own stretch of p matches are put in as p grows; those of the one
    before are put in as p falls from the end, so that none is too far. Where a chain goes on, only the first match of a
    stretch can gain from the stretch before, so the first few that may are answered by a look at its matches, and trees
    are made for the others. All in n log n. A match is worth its k-mer and the
    gaps that two sampled k-mers may have between them.
    """
    n, cost, reach = len(p), how.gap_cost, how.max_gap + how.window
    worth = 2 * cost * how.window + how.kmer
    stretches_: dict[int, list[int]] = {}
    for v in sorted(set(q)):
        stretches_.setdefault(v // reach, []).append(v)
    place = {v: i for values in stretches_.values() for i, v in enumerate(values)}
    base = [cost * (a + b) for a, b in zip(p, q)]
    back, key = [-1] * n, [0.0] * n + [-math.inf]  # key: score + cost * (p + q); an empty node of a tree is match n
    # trees of a stretch of q: low[k][i] and high[k][i] are the best of the i & -i places up to place i, from either end
    low: dict[int, list[int]] = {}
    high: dict[int, list[int]] = {}

    def put(j: int) -> None:
        v, mine = q[j], key[j]
        k, at = v // reach, place[v]
        size = len(stretches_[k])
        tree = low.get(k)
        if tree is None:
            tree, low[k], high[k] = (new := [n] * (size + 1)), new, [n] * (size + 1)
        i = at + 1
        while i <= size and key[tree[i]] < mine:  # a larger one covers all above it, too
            tree[i] = j
            i += i & -i
        tree, i = high[k], size - at
        while i <= size and key[tree[i]] < mine:
            tree[i] = j
            i += i & -i

    def get(j: int, best: float, who: int) -> tuple[float, int]:
        v = q[j]
        k = v // reach
        if (tree := low.get(k)) is not None:
            i = place[v]
            while i:
                if key[tree[i]] > best:
                    who = tree[i]
                    best = key[who]
                i &= i - 1
        if (tree := high.get(k - 1)) is not None:
            values = stretches_[k - 1]
            i = len(values) - bisect_left(values, v - reach)
            while i:
                if key[tree[i]] > best:
                    who = tree[i]
                    best = key[who]
                i &= i - 1
        return best, who

    def from_before(lo: int, hi: int, first: int) -> list[tuple[float, int]]:
        """For each of the matches lo to hi the best predecessor among those from `first` on, a stretch of p earlier."""
        nonlocal low, high
        kept, low, high = (low, high), {}, {}
        out, j = [(0.0, -1)] * (hi - lo), begin_of[first] - 1
        for i in range(hi - 1, lo - 1, -1):
            nearest = p[i] - reach
            while j >= first and p[j] >= nearest:
                put(j)
                j -= 1
            out[i - lo] = get(i, base[i], -1)
        low, high = kept
        return out

    begin = [0, *[i for i in range(1, n) if p[i] // reach != p[i - 1] // reach], n]
    begin_of = dict(zip(begin, begin[1:]))
    for b, (lo, hi) in enumerate(zip(begin, begin[1:])):
        first, most, asked, earlier = lo, -math.inf, 0, None
        if b and p[lo - 1] // reach == p[lo] // reach - 1:
            first = begin[b - 1]
            most = max(key[first:lo])
        low.clear()
        high.clear()
        i = lo
        while i < hi:
            j = i
            while j < hi and p[j] == p[i]:
                best, who = get(j, base[j], -1)
                if best < most:  # else none of the stretch before is better
                    if asked < FEW_ASKED:
                        asked += 1
                        for x in range(first, lo):
                            if key[x] > best and p[x] >= p[j] - reach and 0 < q[j] - q[x] <= reach:
                                best, who = key[x], x
                    else:
                        if earlier is None:
                            at, earlier = j, from_before(j, hi, first)
                        if earlier[j - at][0] > best:
                            best, who = earlier[j - at]
                key[j], back[j] = worth + best, who
                j += 1
            if j < hi:
                for x in range(i, j):
                    put(x)
            i = j
    score = [k - x for k, x in zip(key, base)]
    used = [False] * len(p)
    for end in sorted(range(len(p)), key=lambda x: (-score[x], x)):
        chain, x = [], end
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(x)
            x = back[x]
        if chain:
            yield chain[::-1]


def segments(p: list[int], q: list[int], chain: list[int], kmer: int) -> list[list[int]]:
    """A chain as stretches [p, q, length] of equal words; matches of one diagonal that touch are one."""
    out: list[list[int]] = []
    for x in chain:
        if out:
            last = out[-1]
            if p[x] - q[x] == last[0] - last[1] and p[x] <= last[0] + last[2]:
                last[2] = max(last[2], p[x] + kmer - last[0])
                continue
            over = max(last[0] + last[2] - p[x], last[1] + last[2] - q[x], 0)
            if over >= kmer:
                continue
            out.append([p[x] + over, q[x] + over, kmer - over])
        else:
            out.append([p[x], q[x], kmer])
    return out


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two short gaps have in common, in order."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.maximum.accumulate(row)
    return int(row[-1])


def grown(a: np.ndarray, b: np.ndarray, drop: int) -> tuple[int, int, bool]:
    """How far two sides go on from their beginnings, word by word: +1 for an equal word, -2 for another, to the best sum
    before it falls by more than drop. Also the equal words, and whether the words ended before it fell."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0, True
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    fell = np.maximum(np.maximum.accumulate(total), 0) - total > drop
    ended = not fell.any()
    total = total if ended else total[: int(fell.argmax())]
    best = int(total.argmax())
    return (best + 1, int(same[: best + 1].sum()), ended) if total[best] > 0 else (0, 0, ended)


def align(a: np.ndarray, b: np.ndarray, parts: list[list[int]], drop: int) -> tuple[int, int, int, int, int, bool, bool]:
    """Spans [lo, hi) of the alignment on both sides, its equal words, and whether words ran out on the left and right."""
    equal = sum(n for _, _, n in parts)
    for (p, q, n), (p2, q2, _) in zip(parts, parts[1:]):
        equal += lcs(a[p + n : p2], b[q + n : q2])
    p, q, _ = parts[0]
    left, more, left_out = grown(a[:p][::-1], b[:q][::-1], drop)
    lo_a, lo_b, equal = p - left, q - left, equal + more
    p, q, n = parts[-1]
    right, more, right_out = grown(a[p + n :], b[q + n :], drop)
    return lo_a, p + n + right, lo_b, q + n + right, equal + more, left_out, right_out


def stretches(at: np.ndarray, known: list[tuple[int, int]], how: Passages) -> list[int]:
    """Ranges lo, hi, lo, hi... of the first words of windows of min_words words that may be in an earlier document: their
    seeds, of which `at` has the places, have other first holders. Windows inside `known` spans are left out."""
    at = np.unique(at)
    wanted = np.zeros(int(at[-1]) + 2 * how.window + how.kmer + 2, np.int8)
    # two sampled k-mers are at most `window` apart, in periodic text twice that
    for run in np.split(at, np.flatnonzero(np.diff(at) > 2 * how.window) + 1):
        wanted[max(int(run[0]) - how.window + 1, 0) : max(int(run[-1]) + how.kmer + 2 * how.window - how.min_words + 1, 0)] = 1
    for start, end in known:
        wanted[start : max(end - how.min_words + 1, start)] = 0
    return np.flatnonzero(np.diff(wanted, prepend=0, append=0)).tolist()


def repeated_passages(docs: DataFrame, how: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, source_id, source_start_word, source_end_word, n_equal, identity) for each passage of a
    document that is also in one with a smaller id, fuzzily or exactly; words count from 0, ends are exclusive.

    Words lie between white space, A-Z lower-cased. The source is the first document that holds the passage's seeds, so a
    passage that m documents share gives m - 1 rows, not m^2, or a few more where copies lack different seeds. Windows of
    min_words words that no such source explains are linked with the first document that holds the whole window. So an
    exact passage of min_words words is found in each document but the first, unless its words recur within a document
    (the n-th occurrence may then meet another one); a fuzzy one is found where some seed of `kmer` equal words is linked
    with a source of the passage. Null or empty texts and those under `kmer` words have no passage. Rows with a null id are left out; of rows with the same id,
    the one with the longest text stands for the id. Extra columns aren't read.

    Each document gives about 2 / (window + 1) seeds a word. Seeds are counted by partial aggregates and joined with
    their first holder; the matches of one pair of documents, bounded by their lengths, are chained together.
    """
    with Scratch(docs.sparkSession) as keep:
        kind = dict(docs.dtypes)[id_col]
        slim = pick(docs, id_col, text_col).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null")

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    rows, seeds, places, turns = [], [], [], []
                    for i, h in enumerate(hashed_words(part.column(1).to_pylist())):
                        seed, at = minimizers(h, how.kmer, how.window)
                        rows.append(np.full(len(seed), i, np.int32))
                        seeds.append(seed.view(np.int64))
                        places.append(at.astype(np.int32))
                        turns.append(occurrences(seed))
                    yield batch(doc=part.column(0).take(pa.array(np.concatenate(rows))), seed=pa.array(np.concatenate(seeds)), pos=pa.array(np.concatenate(places)), turn=pa.array(np.concatenate(turns)))

        seeds = keep(arrow_map(slim, sample, f"doc {kind}, seed long, pos int, turn int"), "seeds")
        holders = seeds.groupBy("seed", "turn").agg(F.min("doc").alias("source"), F.max("doc").alias("hi"), F.min_by("pos", "doc").alias("source_pos"))
        # a seed's later occurrences are in documents that have its first one, too
        holders = keep(holders.where("source <> hi or turn > 0"), "holders")
        shared = holders.where("source <> hi").drop("hi")
        matches = seeds.join(shared, ["seed", "turn"]).where("doc <> source").select("doc", "source", "pos", "source_pos")
        # the first holders of later occurrences, with the first holder of the first one
        firsts = shared.where("turn = 0").select("seed", F.col("source").alias("origin"), F.col("source_pos").alias("origin_pos"))
        later = holders.where("turn > 0").join(firsts, "seed").where("origin <> source")
        matches = keep(matches.union(later.select("source", "origin", "source_pos", "origin_pos")), "matches")

        def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by pair; the last pair of a batch may go on in the next."""
            rest: pa.Table | None = None

            def run(t: pa.Table) -> pa.RecordBatch:
                docs_, sources = t.column("doc").to_numpy(zero_copy_only=False), t.column("source").to_numpy(zero_copy_only=False)
                p, q = t.column("pos").to_numpy(), t.column("source_pos").to_numpy()
                # rows of one id repeat their matches: each counts once
                new = np.concatenate(([True], (docs_[1:] != docs_[:-1]) | (sources[1:] != sources[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
                if not new.all():
                    t, docs_, sources, p, q = t.filter(pa.array(new)), docs_[new], sources[new], p[new], q[new]
                cuts = np.flatnonzero((docs_[1:] != docs_[:-1]) | (sources[1:] != sources[:-1])) + 1
                at, parts = [], []
                for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(docs_)]):
                    ps, qs = p[x:y].tolist(), q[x:y].tolist()
                    for found in chains(ps, qs, how):
                        at.append(x)
                        parts.append(segments(ps, qs, found, how.kmer))
                take = pa.array(at, pa.int64())
                pick_ = lambda c: t.column(c).take(take).combine_chunks()
                return batch(doc=pick_("doc"), source=pick_("source"), parts=pa.array([[v for s in x for v in s] for x in parts], pa.list_(pa.int32())))

            for b in batches:
                t = pa.table(b) if not isinstance(b, pa.RecordBatch) else pa.Table.from_batches([b])
                t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
                if not t.num_rows:
                    continue
                docs_, sources = t.column("doc").to_numpy(zero_copy_only=False), t.column("source").to_numpy(zero_copy_only=False)
                differs = np.flatnonzero((docs_ != docs_[-1]) | (sources != sources[-1]))
                whole = int(differs[-1]) + 1 if len(differs) else 0
                rest = t.slice(whole)
                if whole:
                    yield run(t.slice(0, whole))
            if rest is not None and rest.num_rows:
                yield run(rest)

        dealt = matches.repartition("doc", "source").sortWithinPartitions("doc", "source", "pos", "source_pos")
        found = keep(arrow_map(dealt, chain, f"doc {kind}, source {kind}, parts array<int>"), "chains")

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    own = [h.astype(np.uint32).view(np.int32) for h in hashed_words(part.column(1).to_pylist())]
                    ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
                    yield batch(id=part.column(0), words=pa.ListArray.from_arrays(ends, np.concatenate(own)))

        involved = keep(found.select(F.col("doc")).union(found.select("source")).distinct(), "involved")
        texts = arrow_map(with_ids(slim, involved, "doc").select("doc", "text"), words, f"id {kind}, words array<int>")
        texts = keep(texts, "passage-words")
        # of rows with one id, the longest: texts of a repeated id would otherwise be joined with each other
        if texts.groupBy("id").count().where("count > 1").limit(1).count():
            texts = keep(texts.groupBy("id").agg(F.max_by("words", F.struct(F.size("words"), F.xxhash64("words"))).alias("words")), "passage-words")
        out = keep(aligned(found, texts, kind, how, keep), "passages")

        # second round: whole windows that other first holders hold in parts
        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ranges = [stretches(np.array(at), known or [], how) for at, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield batch(doc=b.column(0), ranges=pa.array(ranges, pa.list_(pa.int32())))

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    rows, keys, places = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
                    for i in range(part.num_rows):
                        ranges = part.column(2)[i].values.to_numpy()
                        own = rolled(mixed(part.column(1)[i].values.to_numpy().view(np.uint32).astype(np.uint64) + np.uint64(1)), how.min_words)
                        at = np.concatenate([np.arange(x, min(y, len(own)), dtype=np.int32) for x, y in ranges.reshape(-1, 2)])
                        rows.append(np.full(len(at), i, np.int32))
                        keys.append(own[at].view(np.int64))
                        places.append(at)
                    yield batch(doc=part.column(0).take(pa.array(np.concatenate(rows))), key=pa.array(np.concatenate(keys)), pos=pa.array(np.concatenate(places)))

        exact = out.where("identity = 1").groupBy("doc").agg(F.collect_list(F.array("start", "end")).alias("known"))
        places = matches.groupBy("doc").agg(F.collect_list("pos").alias("at")).join(exact, "doc", "left")
        wanted = keep(arrow_map(places.select("doc", "at", "known"), spans, f"doc {kind}, ranges array<int>").where("size(ranges) > 0"), "spans")
        whole = with_ids(texts.withColumnRenamed("id", "doc"), wanted, "doc").select("doc", "words", "ranges")
        whole = keep(arrow_map(whole, windows, f"doc {kind}, key long, pos int"), "windows")
        firsts = whole.groupBy("key").agg(F.min("doc").alias("source"), F.max("doc").alias("hi"), F.min(F.struct("doc", "pos"))["pos"].alias("source_pos"))
        firsts = keep(firsts.where("source <> hi").drop("hi"), "window-holders")  # a table, so that the join below may split a window of many documents
        links = whole.join(firsts, "key").where("doc <> source").select("doc", "source", "pos", (F.col("pos") - F.col("source_pos")).alias("shift"))
        # windows in a row of one diagonal are one stretch of equal words
        turn = F.row_number().over(Window.partitionBy("doc", "source", "shift").orderBy("pos"))
        runs = links.withColumn("run", F.col("pos") - turn).groupBy("doc", "source", "shift", "run").agg(F.min("pos").alias("p"), (F.max("pos") + how.min_words).alias("p_end"))
        inside = out.select(F.col("doc").alias("d"), "start", "end")
        runs = runs.join(inside, (F.col("doc") == F.col("d")) & (F.col("p") >= F.col("start")) & (F.col("p_end") <= F.col("end")), "left_anti")
        more = runs.select("doc", "source", F.array("p", F.col("p") - F.col("shift"), F.col("p_end") - F.col("p")).cast("array<int>").alias("parts"))
        out = out.union(aligned(keep(more, "window-chains"), texts, kind, how, keep))
        out = out.select(
            F.col("doc").alias(id_col), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("source").alias(f"source_{id_col}"),
            F.col("s_start").alias("source_start_word"), F.col("s_end").alias("source_end_word"), "n_equal", "identity",
        )
        return materialize(out, "repeated-passages")


def aligned(found: DataFrame, texts: DataFrame, kind: str, how: Passages, keep: Scratch) -> DataFrame:
    """(doc, start, end, source, s_start, s_end, n_equal, identity) of the chains (doc, source, parts) that align well enough.
    Chains whose alignment may go on beyond the words that were compared are compared with more, until none is left."""
    done, margin = None, how.margin
    while True:
        tried = keep(compared(found, texts, kind, how, margin), "alignments")
        whole = tried.where("not short").drop("short", "parts")
        done = whole if done is None else done.union(whole)
        found, margin = tried.where("short").select("doc", "source", "parts"), margin * 8
        if found.isEmpty():
            # chains of one pair may grow into the same alignment
            return done.groupBy("doc", "start", "end", "source", "s_start", "s_end").agg(F.max("n_equal").alias("n_equal"), F.max("identity").alias("identity"))


def compared(found: DataFrame, texts: DataFrame, kind: str, how: Passages, margin: int) -> DataFrame:
    """The alignments of chains with `margin` words more on each side; short: these words didn't do, parts are the chain."""
    n = F.size("parts")
    ends = lambda k: (F.greatest(F.get("parts", F.lit(k)) - margin, F.lit(0)), F.get("parts", n - 3 + k) + F.get("parts", n - 1) + margin)
    (a_lo, a_hi), (b_lo, b_hi) = ends(0), ends(1)
    left = found.join(texts.select(F.col("id").alias("doc"), F.col("words").alias("w")), "doc").select("doc", "source", "parts", a_lo.alias("a_lo"), F.slice("w", a_lo + 1, a_hi - a_lo).alias("a"), (a_hi < F.size("w")).alias("a_more"))
    both = left.join(texts.select(F.col("id").alias("source"), F.col("words").alias("w")), "source").select("doc", "source", "parts", "a_lo", "a", "a_more", b_lo.alias("b_lo"), F.slice("w", b_lo + 1, b_hi - b_lo).alias("b"), (b_hi < F.size("w")).alias("b_more"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            a_side, b_side, parts = b.column("a"), b.column("b"), b.column("parts")
            a_lo_, b_lo_ = b.column("a_lo").to_pylist(), b.column("b_lo").to_pylist()
            more = [x and y for x, y in zip(b.column("a_more").to_pylist(), b.column("b_more").to_pylist())]
            for i in range(b.num_rows):
                flat = parts[i].values.to_numpy().reshape(-1, 3) - np.array([a_lo_[i], b_lo_[i], 0])
                x, y = a_side[i].values.to_numpy(), b_side[i].values.to_numpy()
                if flat[-1, 0] + flat[-1, 2] > len(x) or flat[-1, 1] + flat[-1, 2] > len(y):
                    continue  # seeds of another row with the same id
                lo, hi, s_lo, s_hi, equal, left_out, right_out = align(x, y, flat.tolist(), how.drop)
                short = (left_out and a_lo_[i] > 0 and b_lo_[i] > 0) or (right_out and more[i])
                alike = equal / max(hi - lo, s_hi - s_lo)
                if short or (min(hi - lo, s_hi - s_lo) >= how.min_words and alike >= how.min_identity):
                    at.append(i)
                    rows.append((lo + a_lo_[i], hi + a_lo_[i], s_lo + b_lo_[i], s_hi + b_lo_[i], equal, alike, short))
            take = pa.array(at, pa.int32())
            cols = list(zip(*rows)) or [[]] * 7
            chain = parts.take(take)
            yield batch(
                doc=b.column("doc").take(take), start=pa.array(cols[0], pa.int64()), end=pa.array(cols[1], pa.int64()), source=b.column("source").take(take), s_start=pa.array(cols[2], pa.int64()), s_end=pa.array(cols[3], pa.int64()),
                n_equal=pa.array(cols[4], pa.int64()), identity=pa.array(cols[5], pa.float64()), short=pa.array(cols[6], pa.bool_()), parts=chain,
            )

    return arrow_map(both, compare, f"doc {kind}, start long, end long, source {kind}, s_start long, s_end long, n_equal long, identity double, short boolean, parts array<int>")


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: passages of 50 words or more that an earlier one holds, at 0.8 of equal words or more."""
    return repeated_passages(table(spark, sf_dir, "documents"))
