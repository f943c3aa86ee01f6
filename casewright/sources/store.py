"""Tables that jobs write for themselves, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where the setting is unset in local mode."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def file_system(spark: SparkSession, name: str):
    """A path and its file system, as Spark's own readers reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder; what is written there goes when the application ends."""
    name = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path, system = file_system(spark, name)
    system.deleteOnExit(path)
    return name


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: its lineage ends there, and all its readers see the same rows."""
    name = scratch_folder(df.sparkSession)
    df.write.parquet(name)
    return df.sparkSession.read.schema(df.schema).parquet(name)


def write_version(df: DataFrame, folder: str, about: dict[str, str] | None = None, keep: int = 2) -> str:
    """Write df as a new version of the table in `folder` and return its name.

    The rows are written beside the current version; one small pointer file, put in place by a rename, then names the
    new one together with what is said `about` it. So a reader has the whole old or the whole new version, and a write
    that fails leaves the old one. The `keep` newest versions stay for readers that have begun; older ones go.
    """
    spark = df.sparkSession
    name = f"v{len(versions(spark, folder)):09d}-{uuid.uuid4().hex}"
    before = current_version(spark, folder) or {"kept": []}
    df.write.parquet(f"{folder}/versions/{name}")
    kept = [*before["kept"], name][-keep:]
    _replace(spark, f"{folder}/current.json", json.dumps({"version": name, "kept": kept, "about": about or {}}))
    for old in versions(spark, folder):
        if old < kept[0]:  # an empty folder stays, so that names go on ascending
            path, system = file_system(spark, f"{folder}/versions/{old}")
            for entry in system.listStatus(path):
                system.delete(entry.getPath(), True)
    return name


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The names of all versions that were begun, in order."""
    path, system = file_system(spark, f"{folder}/versions")
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def current_version(spark: SparkSession, folder: str) -> dict | None:
    """The pointer of the table in `folder`: version and what was said about it; None before the first write."""
    path, system = file_system(spark, f"{folder}/current.json")
    if not system.exists(path):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/current.json").collect()))


def read_version(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """The current version of the table in `folder`, or the one named."""
    name = version or (current_version(spark, folder) or {}).get("version")
    if name is None:
        raise FileNotFoundError(f"no version was written in {folder}")
    return spark.read.parquet(f"{folder}/versions/{name}")


def _replace(spark: SparkSession, name: str, text: str) -> None:
    """Write a small file beside `name` and rename it over it."""
    jvm = spark._jvm
    target, _ = file_system(spark, name)
    beside = jvm.org.apache.hadoop.fs.Path(f"{name}.{uuid.uuid4().hex}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, options)


class KeyedTable:
    """A table by one key, in parts by the key's hash, that takes upserts which rewrite only the parts they touch.

    A pointer names the folder of each part and the number of the last batch. An upsert writes new folders for the parts
    that it touches and then replaces the pointer, so it is applied in whole or not at all, whenever it stops; a batch
    whose number isn't above the last one was applied before and changes nothing. Other parts keep their files.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, parts: int = 32):
        self.spark, self.folder, self.key, self.parts = spark, folder, key, parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int").alias("part")

    def pointer(self) -> dict:
        path, system = file_system(self.spark, f"{self.folder}/current.json")
        if not system.exists(path):
            return {"batch": -1, "parts": {}, "schema": None}
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.folder}/current.json").collect()))

    def _write(self, rows: DataFrame, batch: int, before: dict) -> None:
        """Folders for the parts of `rows` (which has `part`), and the pointer to them."""
        name = f"rows/b{batch}-{uuid.uuid4().hex}"
        rows.repartition("part").write.partitionBy("part").parquet(f"{self.folder}/{name}")
        path, system = file_system(self.spark, f"{self.folder}/{name}")
        found = [s.getPath().getName() for s in system.listStatus(path)]
        parts = {p.removeprefix("part="): f"{name}/{p}" for p in found if p.startswith("part=")}
        schema = before["schema"] or rows.drop("part").schema.json()
        _replace(self.spark, f"{self.folder}/current.json", json.dumps({"batch": batch, "parts": before["parts"] | parts, "schema": schema}))

    def create(self, rows: DataFrame) -> None:
        """The first rows; keys are unique and not null."""
        self._write(rows.withColumn("part", self._part()), 0, self.pointer())

    def _read(self, before: dict, parts: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(before["schema"]))
        folders = [f"{self.folder}/{f}" for p, f in sorted(before["parts"].items()) if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read(self.pointer())

    def read_audit(self) -> DataFrame:
        """(batch, key, column, before, after) of every changed value of the batches that were applied."""
        path, system = file_system(self.spark, f"{self.folder}/audit")
        kind = f"`{self.key}` {StructType.fromJson(json.loads(self.pointer()['schema']))[self.key].dataType.simpleString()}, column string, before string, after string, batch int"
        if not system.exists(path):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.folder}/audit").where(F.col("batch") <= self.pointer()["batch"])

    def apply(self, changes: DataFrame, batch: int, columns: list[str]) -> bool:
        """Upsert `columns` of the keys in `changes`, each once; False if this batch was applied before.

        Columns that changes don't have stay, and are null in new rows. Rows with a null key are left out.
        """
        before = self.pointer()
        if batch <= before["batch"]:
            return False
        changed = stored(changes.where(F.col(self.key).isNotNull()).select(self.key, F.struct(*columns).alias("new_values")).withColumn("part", self._part()))
        touched = [r["part"] for r in changed.select("part").distinct().collect()]  # `parts` numbers at most
        base = self._read(before, touched)
        met = stored(base.join(changed.drop("part"), self.key, "full_outer"))
        value = lambda c: F.when(F.col("new_values").isNotNull(), F.col(f"new_values.{c}")).otherwise(F.col(c)).alias(c)
        told = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("before"), F.col(f"new_values.{c}").cast("string").alias("after")) for c in columns)))
        audit = met.where("new_values is not null").select(self.key, told).where("not (before <=> after)")
        audit.write.mode("overwrite").parquet(f"{self.folder}/audit/batch={batch}")
        self._write(met.select(*(value(c) if c in columns else F.col(c) for c in base.columns), self._part()), batch, before)
        return True

    def clean(self) -> None:
        """Delete the folders of parts that the pointer doesn't name; only while nobody reads an older state."""
        named = {f.rsplit("/", 1)[0] for f in self.pointer()["parts"].values()}
        path, system = file_system(self.spark, f"{self.folder}/rows")
        for entry in system.listStatus(path):
            if f"rows/{entry.getPath().getName()}" not in named:
                system.delete(entry.getPath(), True)


def upsert_sink(table: KeyedTable, columns: list[str], newest):
    """A function for foreachBatch: of each key in a micro-batch the newest row by `newest` is upserted, once per batch.

    A stream's first batch has the number 0, as the table's first rows have; batches are counted from 1 here.
    """
    def write(batch: DataFrame, number: int) -> None:
        latest = batch.where(F.col(table.key).isNotNull()).groupBy(table.key).agg(F.max_by(F.struct(*columns), newest).alias("row"))
        table.apply(latest.select(table.key, "row.*"), number + 1, columns)

    return write
