"""The record store: an append-only log of versions in Parquet, and the views, imports and exports of it.

A write appends a batch of versions; the current state is the latest version of each id that isn't a tombstone. Each batch has a
name of its own; one that is given (a stream's and a micro-batch's number) is replaced when it is written again, and no other is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.config import DEFAULTS, Config
from memlake.functions.vectors import clamp01
from memlake.schema import COLUMNS, KINDS, RECORD_DDL, make_records

VERSION_DDL = f"{RECORD_DDL}, version bigint, deleted boolean"
#: What the log's folder is called while compact() replaces it.
ASIDE = ".aside"


class Store:
    """A folder of versions (`records`), usage events (`usage`), rejected fingerprints (`rejected`) and marks (`marks`)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, ddl: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._path(name)
        if not fs.exists(path) and fs.exists(path.suffix(ASIDE)):  # compact() was broken off between its renames
            fs.rename(path.suffix(ASIDE), path)
        return fs.exists(path)

    def versions(self) -> DataFrame:
        """Every version, partition column `batch` included."""
        return self._read("records", f"{VERSION_DDL}, batch string")

    def records(self, without: str | None = None) -> DataFrame:
        """The latest version of each record: a partial aggregate, so that no record's history meets in one task unreduced.

        without: a batch that doesn't count, as it is about to be written again.
        """
        rows = self.versions()
        rows = rows if without is None else rows.where(F.col("batch") != without)
        latest = rows.groupBy("id").agg(F.max_by(F.struct(*COLUMNS, "deleted"), F.struct("version", "batch")).alias("r"))
        return latest.select("r.*").where(~F.coalesce("deleted", F.lit(False))).select(*COLUMNS)

    def with_usage(self) -> DataFrame:
        """Records with the usage events that were written behind added up."""
        used = self._read("usage", "id string, at bigint").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
        rows = self.records().join(used, "id", "left")
        rows = rows.withColumn("useCount", F.col("useCount") + F.coalesce("n", F.lit(0))).withColumn("lastUsedAt", F.greatest("lastUsedAt", "last"))
        return rows.select(*COLUMNS)

    def next_version(self) -> int:
        return int(self.versions().agg(F.max("version")).first()[0] or 0) + 1

    def append(self, rows: DataFrame, batch: str | None = None, deleted: bool = False) -> str:
        """Append versions of some records as one batch, newer than all there are; returns its name.

        Names of batches are unique unless given, so that writers at the same time don't meet; where both write a record, the
        larger name wins.
        """
        version = self.next_version()
        batch = f"{version:012d}-{uuid.uuid4().hex}" if batch is None else str(batch)
        out = rows.select(*COLUMNS).withColumn("version", F.lit(version).cast("long")).withColumn("deleted", F.lit(deleted)).withColumn("batch", F.lit(batch))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/records")
        return batch

    def delete(self, rows: DataFrame) -> str:
        return self.append(rows, deleted=True)

    def mark_used(self, ids: DataFrame, at: int) -> None:
        ids.select("id", F.lit(at).cast("long").alias("at")).write.mode("append").parquet(f"{self.path}/usage")

    def reject(self, hashes: DataFrame) -> None:
        hashes.select("hash").distinct().write.mode("append").parquet(f"{self.path}/rejected")

    def rejected(self) -> DataFrame:
        return self._read("rejected", "hash string").distinct()

    def table(self, name: str, ddl: str) -> DataFrame:
        """A table of state beside the records; empty where there is none yet. One that was replaced has a folder for each state."""
        if self._exists(f"{name}.states"):
            return self._read(f"{name}.states/{self.mark('state:' + name)}", ddl)
        return self._read(name, ddl)

    def add(self, name: str, rows: DataFrame) -> None:
        """Append rows to a table of state."""
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """A table's new state: written beside the old one, which goes once the new one counts."""
        old = self.mark(f"state:{name}")
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}.states/{old + 1}")
        self.set_mark(f"state:{name}", old + 1)
        fs, path = self._path(f"{name}.states/{old}")
        fs.delete(path, True)

    def set_mark(self, name: str, value: int) -> None:
        self.spark.createDataFrame([(name, value, self.mark_version() + 1)], "name string, value bigint, version bigint").write.mode("append").parquet(f"{self.path}/marks")

    def _marks(self) -> DataFrame:
        return self._read("marks", "name string, value bigint, version bigint")

    def mark_version(self) -> int:
        return int(self._marks().agg(F.max("version")).first()[0] or 0)

    def mark(self, name: str) -> int:
        """A mark's value, 0 if there is none."""
        row = self._marks().where(F.col("name") == name).agg(F.max_by("value", "version")).first()
        return int(row[0] or 0)

    def compact(self) -> None:
        """Put the current state, as one batch, in the place of the log; there must be no other writer meanwhile.

        The log is moved aside and goes only when the new one stands; a store that finds it aside moves it back.
        """
        if not self._exists("records"):
            return
        fresh = Store(self.spark, f"{self.path}/compacted-{uuid.uuid4().hex}")
        fresh.append(self.records())
        fs, old = self._path("records")
        _, new = fresh._path("records")
        if not fs.rename(old, old.suffix(ASIDE)) or not fs.rename(new, old):
            raise OSError(f"{self.path}: the log could not be moved")
        fs.delete(old.suffix(ASIDE), True)
        fs.delete(fresh._path("")[1], True)
        self.spark.catalog.clearCache()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Records from a folder of JSON documents {version, record}; broken documents are skipped."""
    rows = spark.read.schema(f"version bigint, record struct<{_struct(RECORD_DDL)}>").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("multiLine", "true").json(path)
    return rows.where(F.col("record.id").isNotNull()).select("record.*")


def _struct(ddl: str) -> str:
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    out.append(part.strip())
    return ", ".join(f"`{p.split(' ', 1)[0]}`: {p.split(' ', 1)[1]}" for p in out)


def write_documents(records: DataFrame, path: str) -> None:
    records.select(F.lit(1).alias("version"), F.struct(*records.columns).alias("record")).write.mode("overwrite").json(path)


def export(records: DataFrame, path: str, now: int, domain: str = "memory") -> None:
    """An envelope {schemaVersion, exportedAt, domain} and the records beside it, in parts; deleted ones are no records."""
    spark = records.sparkSession
    records.write.mode("overwrite").json(f"{path}/items")
    spark.createDataFrame([(1, now, domain)], "schemaVersion int, exportedAt bigint, domain string").coalesce(1).write.mode("overwrite").json(f"{path}/envelope")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_DDL).json(f"{path}/items")


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """Records of single-file envelopes {items: [...]}; other documents, bare arrays too, give none."""
    rows = spark.read.schema(f"items array<struct<{_struct(RECORD_DDL)}>>").option("multiLine", "true").json(path)
    return rows.where("items is not null").select(F.explode("items").alias("r")).select("r.*")


def import_records(rows: DataFrame, now: int, cfg: Config = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Imported rows as records, and a count of what became of them.

    Rows without a known kind or a text are invalid. Imported records count as observed, are never pinned, and their numbers are
    brought into range.
    """
    text = F.coalesce(F.trim("text"), F.lit(""))
    reason = F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind").when(text == "", "text").otherwise("imported")
    judged = rows.withColumn("_outcome", reason)
    good = judged.where(F.col("_outcome") == "imported").drop("_outcome", "hash", "status")
    good = good.withColumn("origin", F.lit("observed")).withColumn("pinned", F.lit(False))
    for name in ("confidence", "importance"):
        if name in good.columns:
            good = good.withColumn(name, F.when(F.col(name).isNotNull(), clamp01(F.col(name).cast("double"))))
    return make_records(good, now), judged.groupBy(F.col("_outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
