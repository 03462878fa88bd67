"""Cuts of lineage by tables in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh one in local mode where it is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="quillspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Characters of a plan that the driver keeps as text for each of the last thousand queries, where the session sets no limit of its own.
PLAN_CHARS = 8192


def short_plans(spark: SparkSession) -> None:
    """Bound what the driver remembers of plans: those of long joins take megabytes each, and adaptive execution writes them anew at every step."""
    name = "spark.sql.maxPlanStringLength"
    if int(spark.conf.get(name).rstrip("bB") or 0) > 1 << 30:
        spark.conf.set(name, str(PLAN_CHARS))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    The table outlives lost executors, and what follows neither recomputes nor
    re-plans what came before.
    """
    short_plans(df.sparkSession)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place in a total order, from 1: ranges are sorted each in its task, and begin behind the rows of the ranges before.

    The ranges are written first, since their bounds come from a sample. What reaches the driver is a number a range.
    """
    ranged = cut(df.orderBy(*order).select(F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"), *df.columns), "ranges")
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    begins, at = {}, 0
    for k in sorted(sizes):
        begins[k], at = at, at + sizes[k]
    begin = F.create_map(*[F.lit(int(x)) for pair in begins.items() for x in pair])[F.col("_range")] if begins else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_at")) + begin
    return ranged.withColumn(name, place.cast("long")).select(*df.columns, name)


def release(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote. Only for tables that nothing still to be computed reads; others are left alone.

    Plans of queries that are done are garbage by now; once the driver collects it, Spark's cleaner
    deletes their shuffle files too.
    """
    for df in tables:
        spark, home = df.sparkSession, shared_dir(df.sparkSession).rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().toUri().getPath() == jvm.org.apache.hadoop.fs.Path(home).toUri().getPath():
                path.getFileSystem(conf).delete(path, True)
    if tables:
        jvm.System.gc()
