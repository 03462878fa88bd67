"""Sinks for tables kept as Parquet; K1 to K3, K9 to K11.

Plain Parquet has no transactions. A version of a table is a numbered pointer file that lists the
version's folders; folders are written first, the pointer is renamed into place last, and nothing
that a pointer names is changed. Readers take the pointer with the largest number, so they see one
version or the next. One writer per table: a number that is taken already is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.crypto import name_hmac
from quillspark.operators.consent import latest_by

#: Versions that stay for readers under way, and the folders of a version above which it is written anew as one.
KEPT, MOST_FOLDERS = 3, 32


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are there, in order."""
    fs, at = _fs(spark, path)
    home = at(f"{path}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
    return sorted(int(n) for n in names if n.isdigit())


def _folders(spark: SparkSession, path: str, version: int) -> list[str]:
    return [r[0] for r in spark.read.text(f"{path}/_versions/{version:09d}").collect() if r[0]]


def _publish(spark: SparkSession, path: str, folders: list[str]) -> None:
    """Make the next version of these folders, then forget versions that are no longer kept."""
    fs, at = _fs(spark, path)
    there = versions(spark, path)
    number = there[-1] + 1 if there else 1
    fresh, final = at(f"{path}/_versions/next-{uuid.uuid4().hex}"), at(f"{path}/_versions/{number:09d}")
    stream = fs.create(fresh, False)
    stream.write(bytearray("\n".join(folders).encode()))
    stream.close()
    if fs.exists(final) or not fs.rename(fresh, final):
        raise RuntimeError(f"{path}: version {number} was written by another writer")
    live = {f for v in [*there, number][-KEPT:] for f in _folders(spark, path, v)}
    for old in there[: -KEPT + 1] if len(there) >= KEPT else []:
        for folder in _folders(spark, path, old):
            if folder not in live:
                fs.delete(at(f"{path}/{folder}"), True)
        fs.delete(at(f"{path}/_versions/{old:09d}"), False)


def current(spark: SparkSession, path: str) -> list[str]:
    """The folders of a table's present version."""
    there = versions(spark, path)
    return [f"{path}/{f}" for f in _folders(spark, path, there[-1])] if there else []


def read(spark: SparkSession, path: str) -> DataFrame | None:
    found = current(spark, path)
    return spark.read.option("mergeSchema", len(found) > 1).parquet(*found) if found else None


def _written(df: DataFrame, path: str) -> str:
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder


def replace(df: DataFrame, path: str) -> None:
    """K1: write a whole new version; the pointer comes last."""
    _publish(df.sparkSession, path, [_written(df, path)])


def append(df: DataFrame, path: str) -> None:
    """Append-only receipts."""
    df.write.mode("append").parquet(path)


def insert_ignore(new: DataFrame, path: str, keys: list[str]) -> None:
    """K2: rows whose keys are not there yet; running twice changes nothing. Only the keys of the old rows are read, and only new rows are written."""
    spark, fresh = new.sparkSession, new.dropDuplicates(keys)
    old, folders = read(spark, path), [f.rpartition("/")[2] for f in current(spark, path)]
    if old is not None:
        fresh = fresh.join(old.select(*keys), keys, "left_anti").select(*new.columns)
    folders.append(_written(fresh, path))
    _publish(spark, path, folders)
    if len(folders) > MOST_FOLDERS:
        replace(read(spark, path), path)


def upsert(new: DataFrame, path: str, keys: list[str], order: str) -> None:
    """K3: the last row of each key by `order`. Rows of other keys are copied, so gather small batches first."""
    old = read(new.sparkSession, path)
    replace(latest_by(new if old is None else old.unionByName(new, allowMissingColumns=True), keys, [order]), path)


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """K9: the rows of the partitions that `df` has are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def export_text(df: DataFrame, path: str, body: str = "body") -> None:
    """One text file per run of a small report table."""
    df.select(F.col(body)).coalesce(1).write.mode("overwrite").text(path)


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose commit mark is there, in order."""
    fs, at = _fs(spark, path)
    home = at(f"{path}/commits")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(home) if s.getPath().getName().isdigit()) if fs.exists(home) else []


def commit(spark: SparkSession, path: str, batch_id: int) -> None:
    """The mark of a batch, written when all of its tables are."""
    fs, at = _fs(spark, path)
    fs.create(at(f"{path}/commits/{batch_id}")).close()


def export_reports(lines: DataFrame, path: str, report: str, order: str, body: str = "body") -> None:
    """One text file for each value of `report`, in a folder of its own, its lines (without line ends) in `order`; reports are written side by side."""
    rows = lines.select(report, order, body).repartition(report).sortWithinPartitions(report, order)
    rows.select(report, body).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(report).text(path)


#: How long the raw bytes of a document that is held wait for another drain.
RETRY_WINDOW = "7 days"


def ingest_batch(drained: DataFrame, path: str, batch_id: int, secret: str, now: Column | None = None) -> None:
    """Documents, mirror and entity index of one batch, and the batch's commit mark last; a batch that is marked is skipped.

    `drained` is computed once, names only as keyed hashes; the three tables are made from what that wrote. What is
    settled has no raw bytes any more (`raw_key` is null); what is held keeps them until `retry_after`. `Batches` reads it.
    """
    spark = drained.sparkSession
    mark, staged = f"{path}/commits/{batch_id}", f"{path}/staged/batch={batch_id}"
    fs, at = _fs(spark, path)
    if fs.exists(at(mark)):
        return
    held = F.col("status") == "held"
    entities = F.transform("hits", lambda h: F.struct(h["label"].alias("label"), name_hmac(secret, h["name"]).alias("name_hmac")))
    waits = F.when(held, (F.current_timestamp() if now is None else now) + F.expr(f"INTERVAL {RETRY_WINDOW}"))
    rows = drained.withColumn("entities", entities).drop("hits").withColumn("raw_key", F.when(held, F.col("path"))).withColumn("retry_after", waits)
    rows.write.mode("overwrite").parquet(staged)
    own = spark.read.parquet(staged)
    tables = {
        "docs": own.select("path", "name", "lane", "status", "reason", "verdict", "tier", "raw_key", "retry_after"),
        "mirror": own.where("text is not null").select("path", "text"),
        "entities": own.select("path", F.explode("entities").alias("e")).select("path", "e.label", "e.name_hmac").distinct(),
    }
    for name, table in tables.items():
        table.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    commit(spark, path, batch_id)
    fs.delete(at(staged), True)


class Batches:
    """One consistent view of the tables of an ingest: the batches that are marked when it is made, whole, and no other.

    A batch is a folder of each table, so a view reads the folders of its batches alone; later batches don't change it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ids = spark, path, committed(spark, path)

    def table(self, name: str) -> DataFrame:
        if not self.ids:
            raise ValueError(f"{self.path}: no batch is committed")
        return self.spark.read.parquet(*(f"{self.path}/{name}/batch={b}" for b in self.ids))

    def docs(self) -> DataFrame:
        """The last state of each document: a later batch drains again what an earlier one held."""
        return latest_by(self.table("docs"), ["path"], ["batch_id"])

    def mirror(self) -> DataFrame:
        return self.table("mirror")

    def entities(self) -> DataFrame:
        return self.table("entities")
