"""Bounded uploads as a data source that writes; K12.

    bounded.upload(chunks, path, most_bytes)

Chunks (object, part, content) are copied one after another into a file per object; one that would grow beyond the cap is
given up at once and its file deleted, so it is never held as a whole, and is reported instead. Each task attempt
writes below a folder of its own in the upload's staging folder. The commit drops the folders of attempts that didn't win and
renames the rest into place, so an upload is there as a whole or not at all; an abort deletes the staging folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillspark.sources.leads import opened

#: Bytes of objects that a reading task hands on together.
READ_BYTES = 8 << 20
REPORT = "object string, status string, n_bytes long, file string"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    stored: int
    refused: int


def file_name(name: str | None) -> str:
    """A name that every file system takes, one for each object."""
    return "null" if name is None else f"o-{hashlib.sha256(name.encode()).hexdigest()}"


class BoundedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, most_bytes: int):
        self.path, self.most_bytes, self.job = path.rstrip("/"), most_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, home = opened(self.path)
        context = TaskContext.get()
        name = f"{context.partitionId()}-{context.taskAttemptId()}"
        folder = f"{home}/_staging/{self.job}/{name}"
        where.create_dir(f"{folder}/objects", recursive=True)
        try:
            report = self._copy(where, folder, iterator)
            pq.write_table(pa.Table.from_pylist(report, pa.schema([("object", pa.string()), ("status", pa.string()), ("n_bytes", pa.int64()), ("file", pa.string())])), f"{folder}/report.parquet", filesystem=where)
        except BaseException:
            where.delete_dir(folder)
            raise
        refused = sum(r["status"] == "refused" for r in report)
        return Written(name, len(report) - refused, refused)

    def _copy(self, where: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch]) -> list[dict]:
        """What became of each object of this task; chunks of an object stand together, in order."""
        report: list[dict] = []
        now, out = None, None

        def end() -> None:
            if out is not None:
                out.close()

        for batch in batches:
            for name, content in zip(batch.column("object").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not report or name != now:
                    end()
                    now, file = name, file_name(name)
                    report.append({"object": name, "status": "stored", "n_bytes": 0, "file": file})
                    out = where.open_output_stream(f"{folder}/objects/{file}")
                row = report[-1]
                if row["status"] == "refused":
                    continue
                row["n_bytes"] += len(content or b"")
                if row["n_bytes"] > self.most_bytes:
                    end()
                    where.delete_file(f"{folder}/objects/{row['file']}")
                    row["status"], row["file"], out = "refused", None, None
                else:
                    out.write(content or b"")
        end()
        return report

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, home = opened(self.path)
        staged, won = f"{home}/_staging/{self.job}", {m.folder for m in messages if m is not None}
        for info in where.get_file_info(fs.FileSelector(staged, allow_not_found=True)):
            if info.base_name not in won:
                where.delete_dir(info.path)
        if won:
            where.move(staged, f"{home}/upload-{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, home = opened(self.path)
        if where.get_file_info(f"{home}/_staging/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{home}/_staging/{self.job}")


class BoundedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bounded"

    def writer(self, schema, overwrite: bool) -> BoundedWriter:
        if overwrite or not {"object", "part", "content"} <= set(schema.names):
            raise ValueError("an upload appends rows of object, part and content")
        return BoundedWriter(self.options["path"], int(self.options["most_bytes"]))


def upload(chunks: DataFrame, path: str, most_bytes: int) -> None:
    """Store objects of at most `most_bytes` from their chunks (object string, part, content binary), in the order of `part`.

    Chunks of an object meet in one task, sorted by Spark; the task holds a batch of them at a time.
    """
    spark = chunks.sparkSession
    spark.dataSource.register(BoundedSink)
    rows = chunks.select("object", "part", "content").repartition("object").sortWithinPartitions("object", "part")
    rows.write.format("bounded").option("path", path).option("most_bytes", most_bytes).mode("append").save()


def report(spark: SparkSession, path: str) -> DataFrame:
    """object, status (stored, refused), n_bytes (of a refused one, up to where it was given up) and file of all committed uploads."""
    # Their paths are spelled out down to the tasks' folders, so that no objects are listed.
    return spark.read.schema(REPORT).parquet(f"{path}/upload-*/*/report.parquet")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """object and content of what committed uploads have stored.

    Tasks open the files that their reports name: the driver lists no objects, and no join looks for them.
    """
    part = lambda k: F.element_at(F.split(F.input_file_name(), "/"), k)  # noqa: E731  the folders tell the same name in two uploads apart
    told = report(spark, path).where("status = 'stored'").select("object", "n_bytes", F.concat_ws("/", part(-3), part(-2), F.lit("objects"), "file").alias("file"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, home = opened(path)
        for batch in batches:
            held, size = [], 0
            for name, n, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with where.open_input_file(f"{home}/{file}") as f:
                    content = f.read()
                if len(content) != n:
                    raise OSError(f"{file}: {len(content)} bytes of {n}")
                held.append({"object": name, "content": content})
                size += n
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    schema = pa.schema([("object", pa.string()), ("content", pa.binary())])
    return told.mapInArrow(read, "object string, content binary")
