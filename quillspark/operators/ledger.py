"""Order-dependent admission and version numbers; K4 to K8, W3."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_spend(calls: DataFrame) -> DataFrame:
    """Calls (line_id, ord, amount, cap) with the spend after each and whether the line is held: the call that crosses the cap is still recorded."""
    after = F.sum("amount").over(Window.partitionBy("line_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return calls.withColumn("used", after).withColumn("recorded", F.col("used") - F.col("amount") <= F.col("cap")).withColumn("held", F.col("used") > F.col("cap"))


def admit(requests: DataFrame, key: str, order: str, amount: str, limit: str) -> DataFrame:
    """K4 to K6: first come, first served up to `limit` per key; a refused request uses nothing.

    Admission depends on all earlier admissions, so a key is walked in order, batch by batch,
    holding one number for it. Rows of a key are sorted by Spark, never gathered.
    """
    columns = requests.columns

    def run(frames):
        now, used = None, 0
        for frame in frames:
            flags, totals = [], []
            for k, a, top in zip(frame[key].tolist(), frame[amount].tolist(), frame[limit].tolist(), strict=True):
                if k != now:
                    now, used = k, 0
                ok = used + a <= top
                used += a * ok
                flags.append(bool(ok))
                totals.append(used)
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame({"admitted": flags, "used": totals})], axis=1)

    kind = dict(requests.dtypes)[amount]
    schema = ", ".join(f"`{c}` {t}" for c, t in requests.dtypes) + f", admitted boolean, used {kind}"
    return requests.repartition(key).sortWithinPartitions(key, order).select(*columns).mapInPandas(run, schema)


def next_versions(existing: DataFrame, new: DataFrame, key: str, order: str, first: int = 1) -> DataFrame:
    """K7, K8: numbers for new rows behind the highest of their key."""
    last = existing.groupBy(key).agg(F.max("version").alias("_last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.withColumn("_place", place).join(last, key, "left").withColumn("version", (F.coalesce("_last", F.lit(first - 1)) + F.col("_place")).cast("long")).drop("_place", "_last")


def session_state(steps: DataFrame, rounds_max: int = 3) -> DataFrame:
    """T6 in batch: the state of each submission from its steps; it completes once, at its first completion."""
    ordered = steps.groupBy("submission_id").agg(
        F.count_if(F.col("kind") == "round").alias("rounds"), F.min(F.when(F.col("kind") == "complete", F.col("at"))).alias("completed_at"), F.max("at").alias("last_activity")
    )
    return ordered.withColumn("status", F.when(F.col("completed_at").isNotNull(), "complete").when(F.col("rounds") >= rounds_max, "awaiting").otherwise("open"))


def forward_steps(steps: DataFrame, key: str, order: list[str], wants: str, leaves: str, copy: str) -> DataFrame:
    """Steps of each key in order, with the phase they find (`at`), whether they are `accepted`, and the `version` of their copy.

    A step asks for a phase (`wants`) and leaves one (`leaves`, not above the next); earlier phases may be skipped, and none is gone back to. What a
    refused step leaves isn't above the phase it found, so the phase is a running maximum. The version starts at 1 and grows only when
    an accepted step's copy differs from the last accepted one; steps without a copy (null) keep it.
    """
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = steps.withColumn("at", F.coalesce(F.max(leaves).over(before), F.lit(0))).withColumn("accepted", F.col(wants) >= F.col("at"))
    kept = F.when(F.col("accepted"), F.col(copy))
    last = F.last(kept, ignorenulls=True).over(before)
    changed = F.when(kept.isNotNull() & last.isNotNull() & (kept != last), 1).otherwise(0)
    return out.withColumn("_changed", changed).withColumn("version", (F.sum("_changed").over(upto) + 1).cast("int")).drop("_changed")
