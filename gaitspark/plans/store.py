"""A study's stage tables on disk: what a stage has made is read again as long as what it was made from is the same.

A stage's tables are written aside and moved into place together when it ends; its marker, with the fingerprint of
everything the stage read, goes first and comes back last. So a run that breaks leaves no table that is taken for current.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import move, read_small, remove, write_small

#: Goes into every fingerprint: raise it when a stage's meaning changes.
LAYOUT = 1


def fingerprint(*parts: object) -> str:
    return hashlib.sha256(json.dumps([LAYOUT, *parts], sort_keys=True, default=str).encode()).hexdigest()


def digest(df: DataFrame, columns: Sequence[str]) -> str:
    """What the rows are, in any order: their number and the sum of their hashes, which aggregates make in one job."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.written: dict[str, dict] = {}
        self.partitioned: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A table of the running stage, read back from where it lies until the stage ends."""
        aside = f"{self.folder}/_making/{name}.parquet"
        df.write.mode("overwrite").parquet(aside)
        self.written[name] = json.loads(df.schema.json())
        return self.spark.read.schema(df.schema).parquet(aside)

    def replace_parts(self, name: str, df: DataFrame, by: Sequence[str]) -> None:
        """Writes the folders of those keys that df has, in place; the files of all other keys stay as they are. Whoever
        reads the table asks the stage's own list of keys which of them are current."""
        df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self.path(name))
        self.written[name] = json.loads(df.schema.json())
        self.partitioned.add(name)

    def marker(self, stage: str) -> dict | None:
        text = read_small(self.spark, f"{self.folder}/_stages/{stage}.json")
        return json.loads(text) if text else None

    def begin(self, stage: str) -> None:
        self.written, self.partitioned = {}, set()
        remove(self.spark, f"{self.folder}/_stages/{stage}.json")

    def end(self, stage: str, print_: str, before: dict | None, **more: object) -> dict[str, DataFrame]:
        """Moves the stage's tables into place, removes those that it made the last time and not now, and marks it."""
        for name in self.written:
            if name not in self.partitioned:
                move(self.spark, f"{self.folder}/_making/{name}.parquet", self.path(name))
        for name in set((before or {}).get("tables", {})) - set(self.written):
            remove(self.spark, self.path(name))
        write_small(self.spark, f"{self.folder}/_stages/{stage}.json", json.dumps({"fingerprint": print_, "tables": self.written, **more}, sort_keys=True))
        return self.tables(self.written)

    def tables(self, schemas: dict[str, dict]) -> dict[str, DataFrame]:
        return {name: self.read(name, StructType.fromJson(schema)) for name, schema in schemas.items()}
