"""Operator 10: sharding by k-d tree partitioning.

A node that must give k shards is split along its widest metadata dimension at a weighted median (for odd k at the
matching share), until every leaf is one shard. Medians are found from histograms: Spark sums the bytes in at most BINS
ranges of each node, the driver picks the range in which the wanted share falls, and the next round looks into that
range only. What is known of the nodes is a small table that rows are joined with, one level at a time; the driver gets at
most MOST_COUNTS counts at once (16 a node, where nodes are very many), and keeps a few numbers for each leaf.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, materialize
from .common import pick, table, utf8_size

BINS = 2048
#: Counts that the driver gets in one round: with many nodes each has fewer bins, and rounds are more.
MOST_COUNTS = 1 << 17
#: The last two dimensions of the order in a node: equal texts lie together, and rows of one text by their id.
TIES = ("t_text", "t_id")


@dataclass
class Node:
    """Rows of a node that is being cut: `want` bytes are to go left; `order` are the places of its dimensions in a row's key, most significant first."""

    name: int
    shards: int
    total: int
    order: list[int]
    lo: list[int]
    hi: list[int]
    want: float
    before: int = 0
    level: int = 0
    cut: list[int] = field(default_factory=list)


WHOLE = ("tinyint", "smallint", "int", "bigint")


def dimension(column: Column, kind: str) -> Column:
    """A metadata column as a number: numbers as they are (rounded), others by a hash of 31 bits; null comes first."""
    if kind in WHOLE:
        return F.coalesce(column.cast("long"), F.lit(-(1 << 62)))
    if kind in ("float", "double"):
        return F.coalesce(F.when(F.isnan(column), None).otherwise(F.round(column).cast("long")), F.lit(-(1 << 62)))
    return F.coalesce((F.xxhash64(column.cast("string")).bitwiseAND(0x7FFFFFFF)).cast("long"), F.lit(-1))


def kd_shards(
    docs: DataFrame,
    dims: Sequence[str],
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    slack: float = 0.05,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of docs.

    size is the text's UTF-8 bytes (null: none) plus 1. Give the number of shards, or target_bytes for ceil(total / target)
    shards. Rows of equal texts are one point and stay in one shard, unless a cut that keeps them together would miss its
    share by more than `slack` of a shard; then it goes through them by id, so that a text with a third of all rows is
    spread. slot counts a shard's rows from 0 without gaps. Repeated rows share the order and count each; null ids come
    before others, ids that aren't whole numbers are ordered by their hash; an empty table gives an empty one; columns not
    named in dims aren't read.
    """
    kinds = dict(docs.dtypes)
    slim = pick(docs, id_col, text_col, *[d for d in dims if d not in (id_col, text_col)])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = slim.select(
        F.col(id_col).alias("id"),
        (utf8_size(F.col(text_col)) + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("t_text"),
        F.coalesce(F.col(id_col).cast("long") if kinds[id_col] in WHOLE else F.xxhash64(F.col(id_col)), F.lit(-1)).alias("t_id"),
        *[dimension(F.col(d), kinds[d]).alias(f"d_{i}") for i, d in enumerate(dims)],
    )
    names = [f"d_{i}" for i in range(len(dims))]
    # copies of a text take the metadata of the one with the smallest id, so that they lie at one point
    point = rows.groupBy("t_text").agg(F.min(F.struct("t_id", *names)).alias("at")).select("t_text", *[F.col(f"at.{c}").alias(c) for c in names])
    with Scratch(docs.sparkSession) as keep:
        points = keep(point, "points")  # tables, so that the join may split a text's rows
        key = F.array(*[F.col(c) for c in (*names, *TIES)])
        rows = keep(rows.drop(*names).join(points, "t_text").select("id", "size", "text_crc32", key.alias("key"), F.lit(0).cast("long").alias("node")), "shard-rows")
        total = rows.agg(F.sum("size")).first()[0] or 0
        leaves = shards or max(1, math.ceil(total / target_bytes))
        share = total / leaves
        open_nodes, paths, fresh = {0: leaves}, {}, 1
        ends = lambda f, name: [f(F.get("key", F.lit(i))).alias(f"{name}_{i}") for i in range(len(names) + 2)]
        root: list[int] = []
        while any(k > 1 for k in open_nodes.values()):
            nodes = [n for n, k in open_nodes.items() if k > 1]
            current = rows.join(small(rows, [(n,) for n in nodes], "node long"), "node")
            stats = current.groupBy("node").agg(F.sum("size").alias("total"), *ends(F.min, "lo"), *ends(F.max, "hi"), *ends(lambda c: F.stddev_pop(c.cast("double")), "sd")).collect()
            cuts = []
            for n in set(nodes) - {s["node"] for s in stats}:
                open_nodes[n] = 1  # without rows there is nothing to cut
            for s in stats:
                k = open_nodes[s["node"]]
                # the widest dimension: the largest spread in units of the whole table's range, so that scales don't matter
                root = root or [max(1, s[f"hi_{i}"] - s[f"lo_{i}"]) for i in range(len(names))]
                widest = max(range(len(names)), key=lambda i: ((s[f"sd_{i}"] or 0) / root[i], i)) if names else None
                order = [*([widest] if names else []), len(names), len(names) + 1]
                cuts.append(Node(s["node"], k, s["total"], order, [s[f"lo_{i}"] for i in order], [s[f"hi_{i}"] for i in order], s["total"] * ((k + 1) // 2) / k))
            find_cuts(current, cuts, slack * share)
            for c in cuts:
                paths[c.name] = (fresh, fresh + 1)
                k = open_nodes.pop(c.name)
                open_nodes[fresh], open_nodes[fresh + 1] = (k + 1) // 2, k // 2
                fresh += 2
            rows = keep(descended(rows, cuts, paths), "shard-rows")
        numbers = [(leaf, i) for i, leaf in enumerate(in_order(paths))]
        placed = rows.join(small(rows, numbers, "node long, shard int"), "node")
        out = materialize(slots(placed.withColumns({"t_text": F.get("key", F.lit(len(names))), "t_id": F.get("key", F.lit(len(names) + 1))})), "shards")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def small(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A table of a row for each node: it grows with the number of leaves, and is broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def in_order(paths: dict[int, tuple[int, int]]) -> list[int]:
    """The leaves from left to right."""
    out, todo = [], [0]
    while todo:
        node = todo.pop()
        if node in paths:
            todo += [paths[node][1], paths[node][0]]
        else:
            out.append(node)
    return out


def ordered(order: Column) -> Column:
    """A row's key by a node's order of dimensions."""
    return F.transform(order, lambda i: F.get("key", i))


def descended(rows: DataFrame, cuts: list[Node], paths: dict[int, tuple[int, int]]) -> DataFrame:
    """rows one level down: each row of a node that was cut goes left if its key is at most the cut, by the cut's parts."""
    table_ = small(rows, [(c.name, c.order, c.cut, *paths[c.name]) for c in cuts], "node long, order array<int>, cut array<long>, left long, right long")
    joined = rows.join(table_, "node", "left")
    goes_left = (F.size("cut") > 0) & (F.slice(ordered(F.col("order")), F.lit(1), F.greatest(F.size("cut"), F.lit(0))) <= F.col("cut"))
    return joined.select("id", "size", "text_crc32", "key", F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right")).alias("node"))


def width_bits(c: Node, bins: int) -> int:
    """The width of a node's bins as a power of two: whole numbers that are shifted, so that ends of 64 bits don't overflow."""
    return max(0, (c.hi[c.level] - c.lo[c.level]).bit_length() - bins.bit_length() + 2)


def find_cuts(rows: DataFrame, cuts: list[Node], slack: float) -> None:
    """Sets each node's cut: the key up to which rows go left, so that their bytes come closest to what is wanted. All nodes
    are searched at once: what is known of each is a row of a small table, so plans don't grow with nodes."""
    todo = [c for c in cuts if c.want < c.total]
    while todo:
        bins = max(16, min(BINS, MOST_COUNTS // len(todo)))
        shifts = {c.name: width_bits(c, bins) for c in todo}
        asked = small(rows, [(c.name, c.order, c.lo[: c.level], c.level, c.lo[c.level], c.hi[c.level], shifts[c.name]) for c in todo], "node long, order array<int>, fixed array<long>, level int, lo long, hi long, shift int")
        keyed = rows.join(asked, "node").withColumn("by", ordered(F.col("order"))).withColumn("at", F.get("by", F.col("level")))
        inside = (F.slice("by", F.lit(1), F.col("level")) == F.col("fixed")) & F.col("at").between(F.col("lo"), F.col("hi"))
        found = keyed.where(inside).groupBy("node", F.call_function("shiftright", F.col("at"), F.col("shift")).alias("bin")).agg(F.sum("size").alias("size")).collect()
        of: dict[int, list[tuple[int, int]]] = {}
        for r in found:
            of.setdefault(r["node"], []).append((r["bin"], r["size"]))
        for c in todo:
            at = c.level
            shift = shifts[c.name]
            before, mine = c.before, sorted(of[c.name])
            for b, size in mine:
                if before + size >= c.want or b == mine[-1][0]:
                    break
                before += size
            lo = max(b << shift, c.lo[at])
            c.before = before
            if shift:
                c.lo[at], c.hi[at] = lo, min((b << shift) + (1 << shift) - 1, c.hi[at])
                continue
            # one value of this part of the key holds the wanted share
            c.lo[at] = c.hi[at] = lo
            after = before + size
            near_after = after - c.want <= c.want - before
            miss = min(after - c.want, c.want - before)
            last = at == len(c.lo) - 1
            if last or at >= len(c.lo) - 2 and miss <= slack:
                end = lo if near_after or (before == 0 and at == 0) else lo - 1
                c.cut = [*c.lo[:at], end]
            else:
                c.level += 1
                c.lo[c.level], c.hi[c.level] = -(1 << 63), (1 << 63) - 1
        todo = [c for c in todo if not c.cut]


def slots(placed: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0: rows are dealt into buckets, numbered there, and shifted by the buckets before."""
    placed = materialize(placed, "placed")
    rows_in_bucket = 20_000
    n = max(1, placed.count() // rows_in_bucket)
    bucketed = placed.withColumn("bucket", F.pmod(F.xxhash64("t_id", "t_text"), F.lit(n)))
    sizes = bucketed.groupBy("shard", "bucket").count()
    ahead = sizes.withColumn("ahead", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = bucketed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("t_id", "t_text", "size")))
    return numbered.join(ahead.select("shard", "bucket", F.coalesce("ahead", F.lit(0)).alias("ahead")), ["shard", "bucket"]).withColumn("slot", (F.col("ahead") + F.col("at") - 1).cast("long"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of nearly equal bytes, cut by language, source and length."""
    out = kd_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
