"""The trial manifest: reading, rules, and the files that it names."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Project
from ..schemas import MANIFEST, MODALITIES, TRIAL
from ..operators.ranks import PLACE_BITS
from ..session import hadoop_file

ISSUES = "row_number long, severity string, code string, message string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows as trimmed strings with their row number; columns that the header lacks are an error."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    if missing := [c for c in MANIFEST if c not in raw.columns]:
        raise ValueError(f"manifest lacks columns: {', '.join(missing)}")
    rows = row_numbers(raw.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in MANIFEST]))
    return rows.withColumn("row_number", F.col("row_number") + 1).select("row_number", *MANIFEST)


def row_numbers(rows: DataFrame) -> DataFrame:
    """rows with row_number from 1 in the order of the input's splits: a first pass counts the rows of each split, a second
    adds the counts of those before it. Splits are read in the order of the file, as a single file's are."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    split, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = placed.groupBy(split.alias("_split")).count().collect()
    before, offsets = 0, []
    for r in sorted(counts):
        offsets.append((r["_split"], before))
        before += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_split long, _before long"))
    return placed.withColumn("_split", split).join(starts, "_split").withColumn("row_number", F.col("_before") + place + 1).drop("_at", "_split", "_before")


def issues(manifest: DataFrame, conditions: Sequence[str], absent: DataFrame | None = None) -> DataFrame:
    """(row_number, severity, code, message). A row without ids is only that. The first of several rows with one key is
    no error; the others name it. absent: (path) of files that aren't there."""
    blank = F.lit(False)
    for k in (*TRIAL, "condition"):
        blank |= F.col(k) == ""
    rows = manifest.withColumn("_blank", blank)
    ok = rows.where(~F.col("_blank"))
    issue = lambda df, severity, code, message: df.select("row_number", F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))
    out = issue(rows.where("_blank"), "error", "blank_id", F.lit("participant, session, condition and trial are required"))
    out = out.union(issue(ok.where(~F.col("condition").isin(*conditions)), "error", "condition", F.concat(F.lit("condition is not allowed: "), F.col("condition"))))
    sensors = [f"{m}_path" for m in MODALITIES if m != "clinical"]
    none = F.lit(True)
    for c in sensors:
        none &= F.col(c) == ""
    out = out.union(issue(ok.where(none), "error", "no_modality", F.lit("at least one modality path is required")))
    first = ok.withColumn("_first", F.first("row_number").over(Window.partitionBy(*TRIAL).orderBy("row_number")))
    again = first.where("row_number > _first")
    out = out.union(issue(again, "error", "duplicate", F.concat(F.lit("trial is already in row "), F.col("_first").cast("string"))))
    long = ok.select("row_number", F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"{m}_path").alias("path")) for m in MODALITIES])).alias("x")).select("row_number", "x.*")
    out = out.union(issue(long.where("path = ''"), "warning", "absent", F.concat(F.col("modality"), F.lit(" is absent"))))
    if absent is not None:
        lost = long.join(absent.select("path").distinct(), "path", "left_semi")
        out = out.union(issue(lost, "error", "missing_file", F.concat(F.lit("file does not exist: "), F.col("path"))))
    return out


def plain(uri: Column) -> Column:
    """A file's name without the ways in which one local name can be spelt: file:/x, file:///x, //, /./ and a/../."""

    def short(name: str) -> str:
        store, mark, path = name.rpartition("://")
        host, slash, path = path.partition("/") if mark else ("", "", path)
        return store + mark + host + slash + posixpath.normpath(slash + path).removeprefix(slash)

    @F.pandas_udf("string")
    def normal(names: pd.Series) -> pd.Series:
        return names.map(short, na_action="ignore")

    return normal(F.regexp_replace(uri, "^file:/+", "/"))


def listed(spark: SparkSession, names: DataFrame) -> DataFrame:
    """(name, uri, length, modified) of the files below the folders that hold the given names (a column `name`).

    Names are grouped by the first levels of their folders; each group's common folder is listed with all below it, which
    Spark does in tasks where there are many folders. So the driver asks for groups, never for single files."""
    top = F.regexp_extract("name", "^([a-z0-9]+://[^/]*/|/)?(?:[^/]*/){0,3}", 0)
    groups = names.groupBy(top.alias("top")).agg(F.min("name").alias("a"), F.max("name").alias("b")).collect()
    folders = []
    for r in groups:  # what the first and the last name have in common, all have
        folder = posixpath.commonprefix([r["a"], r["b"]]).rpartition("/")[0] or "/"
        fs, at = hadoop_file(spark, folder)
        while not fs.exists(at) and at.getParent() is not None and at.getParent().depth() > 1:
            at = at.getParent()
        if fs.exists(at):
            folders.append(at.toString())
    if not folders:
        return spark.createDataFrame([], "name string, uri string, length long, modified timestamp")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sorted(set(folders)))
    return found.select(plain(F.col("path")).alias("name"), F.col("path").alias("uri"), "length", F.col("modificationTime").alias("modified")).dropDuplicates(["name"])


def declared_files(spark: SparkSession, manifest: DataFrame, project: Project) -> DataFrame:
    """(modality, path, uri, length, modified): each modality's declared paths with the files they name; uri is NULL for
    files that aren't there."""
    long = manifest.select(F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"{m}_path").alias("path")) for m in MODALITIES])).alias("x")).select("x.*").where("path <> ''").distinct()
    root = project.root if "://" in project.root else os.path.abspath(project.root)
    whole = F.when(F.col("path").startswith("/") | F.col("path").contains("://"), F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "path"))
    fs, _ = hadoop_file(spark, "/")
    store = fs.getUri().toString().rstrip("/")
    names = long.withColumn("name", plain(F.when(whole.contains("://"), whole).otherwise(F.concat(F.lit("" if store.startswith("file:") else store), whole))))
    return names.join(listed(spark, names), "name", "left").drop("name")


def validate(spark: SparkSession, project: Project, check_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """(manifest, issues) of a project."""
    manifest = read_manifest(spark, project.resolve(project.manifest))
    absent = declared_files(spark, manifest, project).where("uri is null").select("path") if check_files else None
    found = issues(manifest, project.allowed_conditions, absent)
    if manifest.isEmpty():
        found = spark.createDataFrame([(0, "error", "empty", "the manifest has no rows")], ISSUES)
    return manifest, found
