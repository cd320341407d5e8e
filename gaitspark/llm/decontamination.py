"""Operator 8 [native]: benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, and each item is sketched by its shingles of smallest hash (bottom-k
MinHash), with k set by the largest size of the partition. k is the number of shingles that an item of that size may
lack, plus one: by the pigeonhole principle each document that contains enough of the item holds one of the sketch,
so the search finds all of them, and its candidates are verified by exact shingle containment. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import pick, table

#: Broadcast a sketch of no more rows than this (24 bytes each); beyond it, the search joins by shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased words between white space; no words: one empty string, of which no shingle is made."""
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def parts(size: int) -> list[Column]:
    return [F.get(F.col("words"), F.col("pos") + k) for k in range(size)]


def shingled(rows: DataFrame, size: int) -> DataFrame:
    """A row for each window of `size` words; `words` stays, so that the hash is taken in generated code."""
    first = F.get(F.col("words"), F.lit(0))
    return rows.where(first != "").select("*", F.posexplode("words").alias("pos", "word")).where(F.col("pos") <= F.size("words") - size)


def item_shingles(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item, window, n, n_window, shingle, h) for each distinct shingle of an item: its shingles in all, and of this window.
    A row of fewer words than `size` is a single shingle of them all; rows of one item may have different windows."""
    base = pick(items, id_col, text_col).select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("words")).where(F.get("words", F.lit(0)) != "")
    window = F.least(F.size("words"), F.lit(size))
    each = base.select("item", "words", window.alias("window"), F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("pos"))
    hashed = F.lit(0).cast("long")
    for k in range(1, size + 1):
        hashed = F.when(F.col("window") == k, F.xxhash64(*parts(k))).otherwise(hashed)
    one = each.select("item", "window", F.array_join(F.slice("words", F.col("pos") + 1, F.col("window")), " ").alias("shingle"), hashed.alias("h")).distinct()
    return one.withColumn("n", F.count("*").over(Window.partitionBy("item"))).withColumn("n_window", F.count("*").over(Window.partitionBy("item", "window")))


def needed(n: Column, percent: int) -> Column:
    """How many of n shingles make the containment."""
    return F.ceil(n * percent / 100.0 - 1e-9).cast("long")


def sketches(shingles: DataFrame, percent: int) -> DataFrame:
    """(item, window, h, need, hits): an item's bottom-k sketch, how many shingles of the window a containing document holds
    at least, and how many of the sketch."""
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n"))) + 1) - 1  # the largest size of the item's partition
    k = (F.floor(top * (100 - percent) / 100.0 + 1e-9) + 1).cast("long")
    ranked = shingles.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("h", "window", "shingle")))
    need = needed(F.col("n"), percent)
    hits = F.least(k, F.col("n")) - (F.col("n") - need)
    here = F.greatest(need - (F.col("n") - F.col("n_window")), F.lit(1))
    return ranked.where(F.col("rank") <= k).select("item", "window", "h", here.alias("need"), F.greatest(hits, F.lit(1)).alias("hits"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): every pair where the document holds `percent` of the item's distinct shingles.

    Shingles are `size` consecutive lower-cased words. A null or empty text holds nothing and an item without words is in
    nothing; an item of fewer words than `size` is one shingle of all of them. Rows with the same id (null is one, too)
    are one document or item: their shingles are united. Extra columns aren't read. Either table may be empty.

    The documents' windows meet the sketches, not all shingles of items; the sketches are broadcast after their rows were
    counted, and joined by shuffle if there are more than BROADCAST_ROWS. Only candidates' texts are shuffled by id.
    """
    spark = docs.sparkSession
    shingles = materialize(item_shingles(items, size, item_col, item_text_col), "item-shingles")
    sketch = materialize(sketches(shingles, percent), "item-sketches")
    small = sketch.count() <= BROADCAST_ROWS
    base = pick(docs, id_col, text_col).select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("words"))
    met = None
    for window in sorted(r[0] for r in sketch.select("window").distinct().collect()):
        own = sketch.where(F.col("window") == window)
        hashed = shingled(base, window).select("doc", (F.size("words") - window + 1).alias("m"), F.xxhash64(*parts(window)).alias("h"))
        some = hashed.join(F.broadcast(own) if small else own, "h").where(F.col("m") >= F.col("need")).select("doc", "item", "window", "h", "hits")
        met = some if met is None else met.union(some)
    out = "{} {}, {} {}, n_shingles long, n_found long".format(id_col, dict(docs.dtypes)[id_col], item_col, dict(items.dtypes)[item_col])
    if met is None:
        return spark.createDataFrame([], out)
    found = met.groupBy("doc", "item").agg(F.count_distinct("window", "h").alias("met"), F.max("hits").alias("hits")).where(F.col("met") >= F.col("hits"))
    windows = shingles.select(F.col("item").alias("i"), "window").distinct()
    found = materialize(found.join(windows, F.col("item").eqNullSafe(F.col("i"))).select("doc", "item", "window"), "contained-candidates")
    texts = pick(docs, id_col, text_col).select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    near = found.join(texts, F.col("doc").eqNullSafe(F.col("d"))).select("doc", "item", "window", words(F.col("t")).alias("words"))
    at = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("window")))
    held = near.where(F.size("words") >= F.col("window")).select("doc", "item", "window", "words", at.alias("pos"))
    held = held.select("doc", "item", "window", F.array_join(F.slice("words", F.col("pos") + 1, F.col("window")), " ").alias("shingle"))
    truth = shingles.select(F.col("item").alias("i"), F.col("window").alias("w"), F.col("shingle").alias("s"), "n")
    exact = (
        held.join(truth, F.col("item").eqNullSafe(F.col("i")) & (F.col("window") == F.col("w")) & (F.col("shingle") == F.col("s")))
        .groupBy("doc", "item")
        .agg(F.max("n").alias("n_shingles"), F.count_distinct("w", "s").alias("n_found"))
        .where(F.col("n_found") >= needed(F.col("n_shingles"), percent))
    )
    return exact.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_shingles", "n_found")


def op8_contained_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds to 80 % or more."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns, whatever their names. Rows of one id are one document;
    rows with a null id are one document, too: all go if they hold an item together. Null texts hold nothing and stay."""
    names = docs.columns
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    hit = contained_items(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("hit")).distinct()
    return rows.join(hit, F.col(f"_{names.index('doc_id')}").eqNullSafe(F.col("hit")), "left_anti").toDF(*names)
