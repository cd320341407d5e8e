"""Operator 5: URL filters.

Rules are (verdict, host, path). Each URL is expanded into expressions host suffix + path prefix, of the numbers of
labels and the path lengths that rules have; expressions are joined with the rules on the first bytes of their digests, confirmed by the full
digests, and the longest rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import pick, table

#: The rules of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages; rules has the columns verdict, host, path.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest expression wins, of equal ones
    (a rule given twice) a block does; without one, rule is null and the verdict is `default`. A null url or one without
    :// has an empty host and path and fits no rule, except one for an empty host. Equal urls are judged once, and every
    row gets its verdict back; extra columns aren't read. An empty rule table leaves all to the default.

    The rules' path lengths and numbers of labels are gathered on the driver: sets of numbers no larger than the longest rule. The
    rules themselves are joined, and Spark broadcasts them only while they are under its own threshold.
    """
    host, path = host_and_path(F.col("url"))
    urls = pick(pages, id_col, url_col).select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    rules = pick(rules, "verdict", "host", "path")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).where("path is not null").distinct().collect())
    counts = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\.", -1))).where("host is not null").distinct().collect())
    keyed = rules.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path"), digest(F.col("host"), F.col("path")).alias("full")).withColumn("short", F.substring("full", 1, 8))
    labels = F.split("host", r"\.", -1)
    # suffixes of as many labels as rules have, so that a long host costs no more than its own length for each
    suffix = lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, F.lit(n)), ".")
    suffixes = F.array_compact(F.array(*[F.when(F.size(labels) >= n, suffix(n)) for n in counts])) if counts else F.array().cast("array<string>")
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    expanded = (
        urls.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
        .withColumn("own", digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("own", 1, 8))
    )
    fits = expanded.join(keyed, "short").where(F.col("own") == F.col("full"))
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("r_host") + F.length("r_path"), F.col("verdict") == "block", F.concat("r_host", "r_path"), "verdict")).alias("best")
    )
    # a table, so that the join may split the rows of one url (or of none) that most pages have
    out = urls.join(materialize(best, "url-verdicts"), ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.col3").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the five rules; others are allowed."""
    return judge(table(spark, sf_dir, "pages"), rules_table(spark))
