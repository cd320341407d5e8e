"""Operator 3: n-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one class. In each round, classes that may still be linked are partitioned into
groups of bounded size: similar classes share their most common open shingle, which names their family, and a family
with many classes is split into several groups. The token-group matrix has a row for each shingle of a group's union
(of the classes' first shingles, in an order from rare to common: a pair that is similar enough shares one among the
first n - ceil(t n) + 1) with the sizes that the group has there and the room that is left after the shingle.

A query class meets a group through the matrix only. Its overlap with the group's union is then bounded: first by the
sizes, the room and the group's largest counts of shingles by hash range, then by the group's stored union of all its
members' shingles, as marks of 16 bits. Only groups that qualify are opened, and only then their members are compared with the query one by one.

What is wanted are the components of the links. So in the first round only the leaders of families are queries and meet
the groups of their family, and in the second all classes meet one leader of each component: many near copies take a
comparison or two each, not one a pair. In the last round every class that has
an open shingle is a query, and classes that are already connected aren't compared again: no link between components is
lost, whatever the first rounds found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, ensure_importable, materialize, sweep
from .common import arrow_map, batch, pick, table, with_ids
from .graph import components
from .shingles import distinct, shingle_sets

#: Ranges of hashes whose frequencies order the shingles. The order steers the costs only, never the result.
RANGES = 1 << 16
#: Ranges of hashes in which a set's shingles are counted: the sum of the smaller counts bounds an overlap from above.
BANDS = 128
#: Bits of a shingle's mark in a group's stored union. Marks of different shingles may be equal, which only raises a bound.
MARK_BITS = 16
#: Classes in a group, and shingles of all its classes, about. They steer the costs only, too.
CAPACITY, CAPACITY_SHINGLES = 32, 1 << 16
#: Rounds: leaders ask their families, all ask the leaders of components, all ask all.
ROUNDS = 3
#: Sizes from one size class of the matrix to the next.
SIZE_STEP = 2.0


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles fall into each of RANGES ranges, over all documents: an array of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RANGES, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                sets = shingle_sets(b.column(0).slice(lo, 512).to_pylist(), size)
                if sets:
                    total += np.bincount((np.concatenate(sets) & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES)
        at = np.flatnonzero(total)
        yield batch(range=pa.array(at, pa.int64()), n=pa.array(total[at], pa.int64()))

    rows = arrow_map(docs.select("text"), count, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(RANGES, np.int64)
    for r in rows:
        out[r["range"]] = r["n"]
    return out


def signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, kind: str, size: int, percent: int) -> DataFrame:
    """(id, n, sig, prefix, bands) for each row: the set's size and digest, its first shingles from rare to common, and its
    counts by hash range."""
    spark = docs.sparkSession
    ensure_importable(spark)
    common = spark.sparkContext.broadcast(frequencies(docs, size).astype(np.int32))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = shingle_sets(part.column(1).to_pylist(), size)
                first, bands = [], np.zeros((len(sets), BANDS), np.int32)
                for i, s in enumerate(sets):
                    bands[i] = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BANDS)
                    take = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    rank = common.value[(s & np.uint64(RANGES - 1)).astype(np.int64)]
                    first.append(s[np.argsort(rank, kind="stable")[:take]].view(np.int64))
                ends = np.cumsum([0, *map(len, first)], dtype=np.int32)
                yield batch(
                    id=part.column(0),
                    n=pa.array([len(s) for s in sets], pa.int64()),
                    sig=pa.array([signature(s) for s in sets], pa.binary()),
                    prefix=pa.ListArray.from_arrays(ends, np.concatenate(first)),
                    bands=pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, bands.reshape(-1)),
                )

    return arrow_map(docs, profile, f"id {kind}, n long, sig binary, prefix array<long>, bands array<int>")


def marks_of(shingles: np.ndarray) -> np.ndarray:
    """The distinct marks of a set's shingles."""
    return distinct((shingles >> np.uint64(64 - 7 - MARK_BITS)).astype(np.uint16)).view(np.int16)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int, name: str, keep: Scratch, of: Callable[[np.ndarray], np.ndarray] = lambda s: s.view(np.int64), kind_of: str = "long") -> DataFrame:
    """(rep, n, s): the whole shingle sets of the wanted classes (rep, sig, one row each), or what `of` makes of them. Other
    columns of `wanted` are carried. Sets are built from the texts when they are wanted: a table of all is larger than the texts."""
    kind, carried = docs.schema["id"].dataType.simpleString(), wanted.drop("rep", "sig").columns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = shingle_sets(part.column(1).to_pylist(), size)
                right = [i for i, (s, sig) in enumerate(zip(sets, part.column(2).to_pylist())) if signature(s) == sig]
                at, flat = pa.array(right, pa.int32()), [of(sets[i]) for i in right]
                ends = np.cumsum([0, *map(len, flat)], dtype=np.int32)
                yield batch(
                    rep=part.column(0).take(at),
                    n=pa.array([len(sets[i]) for i in right], pa.int64()),
                    s=pa.ListArray.from_arrays(ends, np.concatenate([of(np.empty(0, np.uint64)), *flat])),
                    **{c: part.column(3 + k).take(at) for k, c in enumerate(carried)},
                )

    wanted = keep(wanted.withColumnRenamed("rep", "id"), f"wanted-{name}")
    chosen = with_ids(docs, wanted, "id").select("id", "text", "sig", *carried)
    schema = [f"rep {kind}, n long, s array<{kind_of}>", *[f"{c} {wanted.schema[c].dataType.simpleString()}" for c in carried]]
    sets = keep(arrow_map(chosen, build, ", ".join(schema)), name)
    # rows that repeat an id and text give its set again: one each, for sets are joined in pairs
    return sets if sets.count() == wanted.count() else keep(sets.dropDuplicates(["rep"]), f"distinct-{name}")


def fits(a: str, b: str, percent: int):
    """Whether sets of these sizes can be similar enough."""
    return F.col(a) * 100 >= F.col(b) * percent


def reaches(shared, a: str, b: str, percent: int):
    """Whether an overlap is enough for sets of these sizes."""
    return shared * 100 >= percent * (F.col(a) + F.col(b) - shared)


def leaves_room(room, a, b, percent: int):
    """Whether sets of these sizes can be similar enough with an overlap of at most `room`."""
    return room * (100 + percent) >= percent * (a + b)


def common_room(a: Column, b: Column) -> Column:
    """The sum of the smaller counts by hash range: no overlap is larger."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y).cast("long")


def possible(pairs: DataFrame, classes: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """Those of the pairs (x, y) whose sizes and counts by hash range leave room for the overlap."""
    paired = keep(pairs.select("x").union(pairs.select("y")).toDF("rep").distinct(), "paired")
    own = with_ids(classes.select("rep", "n", "bands"), paired, "rep")
    for k in ("x", "y"):
        pairs = pairs.join(own.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("bands").alias(f"b_{k}")), k)
    return pairs.where(reaches(common_room(F.col("b_x"), F.col("b_y")), "n_x", "n_y", percent)).select("x", "y")


def with_sig(reps: DataFrame, classes: DataFrame) -> DataFrame:
    return reps.toDF("rep").distinct().join(classes.select("rep", "sig"), "rep")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (x, y) whose sets are similar enough."""
    left, right = (sets.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("s").alias(f"s_{k}")) for k in ("x", "y"))
    near = pairs.join(left, "x").join(right, "y").withColumn("shared", F.size(F.array_intersect("s_x", "s_y")).cast("long"))
    return near.where(reaches(F.col("shared"), "n_x", "n_y", percent)).select("x", "y")


def bridging(tokens: DataFrame, comp: DataFrame, keep: Scratch) -> DataFrame:
    """tokens with their classes' components, without those whose classes are all in one component."""
    # a table, for it is read twice
    placed = keep(tokens.join(comp, "rep"), "tokens-in-components")
    several = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi"))
    # a table, so that the join may split a shingle that most classes share
    open_tokens = keep(placed.join(keep(several.select("token"), "bridges"), "token"), "open-tokens")
    keep.drop("tokens-in-components", "bridges")
    return open_tokens


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after links (x, y) between classes."""
    of = lambda k: comp.select(F.col("rep").alias(k), F.col("comp").alias(f"c_{k}"))
    between = links.join(of("x"), "x").join(of("y"), "y").select(F.col("c_x").alias("a"), F.col("c_y").alias("b")).where("a <> b").distinct()
    labels = components(between)
    return materialize(comp.join(labels.select(F.col("node").alias("comp"), "label"), "comp", "left").select("rep", F.coalesce("label", "comp").alias("comp")), "components")


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP) + 1e-9).cast("int")


def partitioned(open_tokens: DataFrame, step: int, keep: Scratch) -> DataFrame:
    """(rep, comp, n, leader, grp) of each open class; grp is null for classes that no query is to meet. In the first round
    groups are parts of families without their leader, in the second the leaders of components with several classes, and in
    the last parts of components. A leader is the class with most open shingles."""
    own = open_tokens.groupBy("rep").agg(F.max(F.struct("df", "token")).alias("key"), F.count("*").alias("n_open"), F.first("comp").alias("comp"), F.first("n").alias("n"))
    own = keep(own.select("rep", "comp", "n", "n_open", F.xxhash64(F.col("comp") if step else F.col("key.token")).alias("family")), "families")
    sizes = own.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.max(F.struct("n_open", "rep"))["rep"].alias("leader"))
    parts = F.ceil(F.greatest(F.col("size") / CAPACITY, F.col("total") / CAPACITY_SHINGLES))
    grp = F.xxhash64("family", F.pmod(F.xxhash64("rep"), parts))
    members = own.join(keep(sizes, "family-sizes"), "family")
    wanted = [F.col("rep") != F.col("leader"), (F.col("rep") == F.col("leader")) & (F.col("size") > 1), F.lit(True)][step]
    groups = keep(members.select("rep", "comp", "n", "leader", F.when(wanted, grp).alias("grp")), "groups")
    keep.drop("families", "family-sizes")
    return groups


def matrix_candidates(open_tokens: DataFrame, members: DataFrame, percent: int, smaller: bool, keep: Scratch) -> DataFrame:
    """(x, c_x, n_x, g): queries and groups that meet in the matrix with enough room for a member that isn't smaller than the
    query, or for any member."""
    placed = open_tokens.select("token", "rep", "room").join(members.drop("leader"), "rep")
    placed = keep(placed.withColumn("class", size_class(F.col("n"))), "placed")
    matrix = placed.where("grp is not null").groupBy("token", "class", F.col("grp").alias("g")).agg(
        F.first("comp").alias("g_comp"), F.min("n").alias("g_lo"), F.max("n").alias("g_hi"), F.max("room").alias("g_room"),
    )
    matrix = keep(matrix, "matrix")
    # the classes of all sizes that are similar enough, from the query's own or the smallest on
    reach = F.explode(F.sequence(size_class(F.col("n") * percent / 100) if smaller else F.col("class"), size_class(F.col("n") * 100 / percent)))
    queries = placed.select("token", reach.alias("class"), "rep", "comp", "n", "room")
    # of a similar pair, all that is shared follows its first shared shingle: some shingle of the pair passes this
    room = leaves_room(F.least("room", "g_room"), F.col("n"), F.col("g_lo") if smaller else F.greatest("n", "g_lo"), percent)
    maybe = queries.join(matrix, ["token", "class"]).where((F.col("comp") != F.col("g_comp")) & fits("g_hi", "n", percent) & fits("n", "g_lo", percent) & room)
    maybe = maybe if smaller else maybe.where("g_hi >= n")
    return maybe.select(F.col("rep").alias("x"), F.col("comp").alias("c_x"), F.col("n").alias("n_x"), "g").distinct()


def group_links(open_tokens: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, step: int, keep: Scratch) -> DataFrame:
    """Links (x, y) between components that the groups give. In the first round queries are the families' leaders, which meet
    the groups of their family; then all classes, which meet the groups that the matrix names, in the last round only
    members that aren't smaller, for each pair is to be compared once."""
    first, last = step == 0, step == ROUNDS - 1
    members = partitioned(open_tokens, step, keep)
    if first:
        leaders = members.where("rep = leader").select(F.col("rep").alias("x"), F.col("comp").alias("c_x"), F.col("n").alias("n_x"))
        maybe = members.where("grp is not null").select(F.col("leader").alias("x"), F.col("grp").alias("g")).distinct().join(leaders, "x")
    else:
        maybe = matrix_candidates(open_tokens, members, percent, not last, keep)
    inside = members.where("grp is not null").select(F.col("grp").alias("g"), F.col("rep").alias("y"), F.col("n").alias("n_y"), F.col("comp").alias("c_y"))
    sizes = inside.groupBy("g").agg(F.min("n_y").alias("g_lo"), F.max("n_y").alias("g_hi"), F.min("c_y").alias("g_comp_lo"), F.max("c_y").alias("g_comp_hi"))
    other = (F.col("c_x") != F.col("g_comp_lo")) | (F.col("c_x") != F.col("g_comp_hi"))
    sized = maybe.join(keep(sizes, "group-sizes"), "g").where(other & fits("n_x", "g_lo", percent) & fits("g_hi", "n_x", percent))
    sized = keep(sized.select("x", "c_x", "n_x", "g", (F.greatest("g_lo", "n_x") if last else F.col("g_lo")).alias("least")), "sized")
    keep.drop("open-tokens", "placed", "matrix", "group-sizes")
    sweep(docs.sparkSession)
    # the largest counts by hash range of the groups' members
    bands = classes.select(F.col("rep").alias("y"), "bands")
    listed = keep(inside.join(sized.select("g").distinct(), "g", "left_semi").select("y", "g"), "sized-members")
    largest = F.aggregate(F.collect_list("bands"), F.array_repeat(F.lit(0), BANDS), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    of_groups = keep(with_ids(bands, listed, "y").groupBy("g").agg(largest.alias("b_g")), "group-bands")
    of_queries = with_ids(bands.toDF("x", "b_x"), keep(sized.select("x").distinct(), "queries"), "x")
    bounded = sized.join(of_queries, "x").join(of_groups, "g").where(leaves_room(common_room(F.col("b_x"), F.col("b_g")), F.col("n_x"), F.col("least"), percent))
    bounded = keep(bounded.select("x", "c_x", "n_x", "g", "least"), "bounded")
    keep.drop("sized", "sized-members", "group-bands", "queries")
    inside = keep(inside.join(bounded.select("g").distinct(), "g", "left_semi"), "candidate-members")
    keep.drop("groups")
    # the groups' stored unions, as marks: n - size(marks) shingles of the query may hide behind another's mark. A class is in
    # one group at most, so its marks come with the group's name and move once
    named = bounded.select(F.col("x").alias("rep"), F.lit(None).cast("long").alias("g"), F.lit(True).alias("asks")).union(inside.select("y", "g", F.lit(False)))
    named = named.groupBy("rep").agg(F.max("g").alias("g"), F.max("asks").alias("asks")).join(classes.select("rep", "sig"), "rep")
    marks = sets_of(docs, named, size, "marks", keep, marks_of, "smallint")
    unions = keep(marks.where("g is not null").groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("u")), "unions")
    sweep(docs.sparkSession)
    asked = bounded.join(marks.where("asks").select(F.col("rep").alias("x"), F.col("s").alias("m")), "x").join(unions, "g")
    most = (F.size(F.array_intersect("m", "u")) + F.col("n_x") - F.size("m")).cast("long")
    opened = keep(asked.where(leaves_room(most, F.col("n_x"), F.col("least"), percent)).select("x", "c_x", "n_x", "g"), "opened")
    keep.drop("bounded", "wanted-marks", "marks", "distinct-marks", "unions")
    sweep(docs.sparkSession)
    pairs = opened.join(inside, "g").where((F.col("c_x") != F.col("c_y")) & fits("n_x", "n_y", percent) & fits("n_y", "n_x", percent))
    if last:
        pairs = pairs.where((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y"))))
    sized_pairs = keep(pairs.select("x", "y"), "sized-pairs")
    keep.drop("opened", "candidate-members")
    pairs = keep(possible(sized_pairs, classes, percent, keep), "opened-pairs")
    keep.drop("sized-pairs", "paired")
    sets = sets_of(docs, with_sig(pairs.select("x").union(pairs.select("y")), classes), size, "shingle-sets", keep)
    return similar(pairs, sets, percent)


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs.

    Words lie between white space, A-Z lower-cased; a set is a text's distinct shingles of `size` words, of fewer words
    the whole sequence as one. Texts link when 100 * intersection >= percent * union; component_id is the smallest id that
    links reach. A null or empty text has no shingles and its own id; a null id stays null, and isn't a component's
    smallest. Rows with equal sets are compared once, so repeated rows and ids cost nothing. Extra columns aren't read.
    """
    kind = dict(docs.dtypes)[id_col]
    slim = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as keep:
        made = keep(profiles(slim, kind, size, percent), "profiles")
        whole = made.where("n > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bands").alias("bands"))
        whole = keep(whole, "whole-classes")
        seen = materialize(made.select("id", "n", "sig"), "seen")
        keep.drop("profiles")
        sweep(docs.sparkSession)
        # the first shingles are needed for the tokens only
        classes = materialize(whole.drop("prefix"), "classes")
        tokens = whole.select("rep", "n", F.posexplode("prefix").alias("pos", "token")).select("rep", "n", "token", (F.col("n") - F.col("pos")).alias("room"))
        shared = keep(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared-tokens")
        sweep(docs.sparkSession)
        tokens = materialize(tokens.join(shared, "token"), "tokens")
    sweep(docs.sparkSession)
    reps = tokens.select("rep").distinct()
    comp = materialize(reps.select("rep", F.col("rep").alias("comp")), "components")
    for step in range(ROUNDS):
        with Scratch(docs.sparkSession) as keep:
            # at first each class is a component, and all tokens are shared by several
            open_tokens = bridging(tokens, comp, keep) if step else tokens.withColumn("comp", F.col("rep"))
            links = keep(group_links(open_tokens, slim, classes, size, percent, step, keep), "similar")
            if not links.isEmpty():
                comp = merged(comp, links)
        sweep(docs.sparkSession)
    # a table, so that the join may split a component with most classes
    least = materialize(comp.groupBy("comp").agg(F.min("rep").alias("least")), "component-ids")
    known = classes.select("sig", "rep").join(comp, "rep", "left").join(least, "comp", "left").select("sig", F.coalesce("least", "rep").alias("component"))
    out = seen.select("id", "n", "sig").join(known, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def op3_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by shingles of three words, linked at 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Shingles of five words, 0.8 or more.

    A document is an id and a text: rows that repeat both stay together, and rows of one id with different texts are
    documents of their own (of these, the one with the smallest hash of its text comes first). Rows with a null id are in
    no group and stay, as do texts without words. An empty table stays empty; all columns are kept, whatever their names.
    """
    names = docs.columns
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    ident, text = F.col(f"_{names.index('doc_id')}"), F.col(f"_{names.index('text')}")
    rows = rows.withColumn("document", F.when(ident.isNotNull(), F.struct(ident.alias("id"), F.xxhash64(text).alias("hash"))))
    found = jaccard_components(rows.select("document", text.alias("text")), id_col="document")
    gone = found.where(F.col("document") != F.col("component_id")).select("document").distinct()
    return rows.join(gone, "document", "left_anti").drop("document").toDF(*names)
