"""Retention: expiry, sweeps with verified deletion, overdue counts; P14, A9, A10, K13, T3."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.policy import expiry


def expired(rows: DataFrame, windows: DataFrame, now: Column) -> DataFrame:
    """Raw bytes (category, id, raw_key, retry_after, created_at) with their expiry and whether it is past."""
    met = rows.where("raw_key is not null").join(windows, "category", "left")
    when = expiry(F.col("retry_after"), F.col("created_at"), F.coalesce("window_ms", F.lit(86_400_000)))
    return met.withColumn("expires", when).withColumn("expired", when <= now)


def receipt(outcomes: DataFrame, windows: DataFrame) -> DataFrame:
    """Expired, deleted, verified, unverified and failed per category and in total; every category is listed.

    `outcomes` has category, expired, deleted, verified.
    """
    counts = [
        F.count_if("expired").alias("expired"), F.count_if(F.col("expired") & F.col("deleted")).alias("deleted"), F.count_if(F.col("expired") & F.col("deleted") & F.col("verified")).alias("verified"),
        F.count_if(F.col("expired") & F.col("deleted") & ~F.col("verified")).alias("unverified"), F.count_if(F.col("expired") & ~F.col("deleted")).alias("failed"),
    ]
    every = windows.select("category").join(outcomes, "category", "left")
    return every.rollup("category").agg(*counts).select(F.coalesce("category", F.lit("total")).alias("category"), "expired", "deleted", "verified", "unverified", "failed")


def overdue(rows: DataFrame, windows: DataFrame, now: Column) -> DataFrame:
    """A10: expired raw bytes per category, zero where none."""
    counts = expired(rows, windows, now).groupBy("category").agg(F.count_if("expired").alias("overdue"))
    return windows.select("category").join(counts, "category", "left").select("category", F.coalesce("overdue", F.lit(0).cast("long")).alias("overdue"))


def sweep(rows: DataFrame, windows: DataFrame, now: Column, remove: Callable[[str], None], exists: Callable[[str], bool]) -> DataFrame:
    """Delete the raw bytes of expired rows where they lie and look whether they are gone; one outcome a row.

    `remove` and `exists` run in the tasks. Unverified rows keep their key, so the next sweep
    tries them again; running twice does no harm.
    """
    due = expired(rows, windows, now).where("expired").select("category", "id", "raw_key")

    def run(frames):
        for frame in frames:
            deleted, verified = [], []
            for k in frame["raw_key"]:
                try:
                    remove(k)
                    deleted.append(True)
                    verified.append(not exists(k))
                except Exception:  # noqa: BLE001  a failed delete is an outcome
                    deleted.append(False)
                    verified.append(False)
            yield frame.assign(expired=True, deleted=deleted, verified=verified)

    return due.mapInPandas(run, "category string, id string, raw_key string, expired boolean, deleted boolean, verified boolean")


def windows_in_hours(catalogue: DataFrame, stored: DataFrame) -> DataFrame:
    """Every category of the catalogue (category, default_ms, min_ms, max_ms) with its window in force, its default and its bounds, in hours."""
    met = catalogue.join(stored.select("category", "window_ms"), "category", "left")
    hours = lambda c: (c / 3_600_000).cast("double")
    window = F.when((F.col("window_ms") > 0) & ~F.isnan(F.col("window_ms").cast("double")), F.col("window_ms")).otherwise(F.col("default_ms"))
    return met.select("category", hours(window).alias("window_hours"), *(hours(F.col(f"{k}_ms")).alias(f"{k}_hours") for k in ("default", "min", "max")))
