"""Consent: latest decisions, coverage, gaps; A7, W1, J11, J12, K14."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.crypto import category_hmac


def latest(captures: DataFrame) -> DataFrame:
    """The last decision of each submission and category. `captures` has submission_id, id, created_at, decisions (category, granted)."""
    each = captures.select("submission_id", "id", "created_at", F.posexplode("decisions").alias("pos", "d")).select("submission_id", "id", "created_at", "pos", "d.category", "d.granted")
    best = each.groupBy("submission_id", "category").agg(F.max_by("granted", F.struct("created_at", "id", "pos")).alias("granted"))
    return best


def coverage(captures: DataFrame, present: DataFrame, categories: list[str]) -> DataFrame:
    """Per category the submissions that granted, refused, have not decided (of those with a capture), and hold answers."""
    every = captures.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    total = captures.agg(F.countDistinct("submission_id").alias("captured"))
    decided = latest(captures).groupBy("category").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("refused"))
    stored = present.groupBy("category").agg(F.countDistinct("submission_id").alias("stored"))
    met = every.join(decided, "category", "left").join(stored, "category", "left").join(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return met.select("category", zero("granted"), zero("refused"), (F.col("captured") - F.coalesce("granted", F.lit(0)) - F.coalesce("refused", F.lit(0))).alias("undecided"), zero("stored"))


def by_version(captures: DataFrame) -> DataFrame:
    """Captures per wording version, ascending."""
    return captures.groupBy("wording_version").agg(F.count(F.lit(1)).alias("captures")).orderBy("wording_version")


def gaps(captures: DataFrame, present: DataFrame) -> DataFrame:
    """Answers whose category is not granted by the latest decision."""
    return present.select("submission_id", "category").distinct().join(latest(captures).where("granted"), ["submission_id", "category"], "left_anti")


def accepted(answers: DataFrame, captures: DataFrame) -> DataFrame:
    """Answers (submission_id, answer_id, categories) all of whose categories are granted; untagged answers are."""
    tagged = answers.select("submission_id", "answer_id", F.explode("categories").alias("category"))
    refused = tagged.join(latest(captures).where("granted"), ["submission_id", "category"], "left_anti").select("answer_id").distinct()
    return answers.join(refused, "answer_id", "left_anti")


def inherit(captures: DataFrame, children: DataFrame) -> DataFrame:
    """A parent's captures copied to its addenda."""
    return children.join(captures.withColumnRenamed("submission_id", "parent_id"), "parent_id").drop("parent_id")


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """W2 and others: the last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order]))).where("_n = 1").drop("_n")


def named_categories(stored: DataFrame, categories: list[str], secret: str) -> DataFrame:
    """Stored rows (category_hmac) with their category's name, null for hashes of no category. The dictionary has a row a category."""
    known = stored.sparkSession.createDataFrame([(c,) for c in categories], "category string").withColumn("category_hmac", category_hmac(secret, F.col("category")))
    return stored.join(F.broadcast(known), "category_hmac", "left")
