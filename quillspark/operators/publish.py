"""Publication: gates, due reports, versions; P12, J9, J10, J17, E15, E16, E20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import policy
from quillspark.operators.ledger import next_versions


def legal_gate(releases: DataFrame, records: DataFrame, replies: DataFrame) -> DataFrame:
    """Releases (report_type, version) with what the legal review still lacks."""
    answered = replies.groupBy("report_type", "version").agg(F.count(F.lit(1)).alias("attempts"))
    met = releases.join(records, ["report_type", "version"], "left").join(answered, ["report_type", "version"], "left")
    unmet = F.array_compact(F.array(
        F.when(F.col("reply_required").isNull(), "legal-review"), F.when(F.col("reply_required") & (F.coalesce("attempts", F.lit(0)) == 0), "right-of-reply")
    ))
    return met.select("report_type", "version", (F.size(unmet) == 0).alias("ok"), unmet.alias("unmet"))


def recording_gate(cited: DataFrame, documents: DataFrame, provenance: DataFrame, reviews: DataFrame) -> DataFrame:
    """Releases that cite recordings without provenance or review, with those documents. `cited` has report_type, version, doc_id."""
    recordings = documents.where(policy.is_recording(F.col("lane"))).select("doc_id")
    used = cited.select("report_type", "version", "doc_id").distinct().join(recordings, "doc_id", "left_semi")
    known = provenance.select("doc_id", "consent_status")
    seen = reviews.select("report_type", "version", "doc_id").distinct().withColumn("reviewed", F.lit(True))
    met = used.join(known, "doc_id", "left").join(seen, ["report_type", "version", "doc_id"], "left")
    lacking = met.where(F.col("consent_status").isNull() | ((F.col("consent_status") != "all-party") & F.col("reviewed").isNull()))
    releases = cited.select("report_type", "version").distinct()
    bad = lacking.groupBy("report_type", "version").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))
    out = releases.join(bad, ["report_type", "version"], "left")
    return out.select("report_type", "version", F.col("doc_ids").isNull().alias("ok"), F.coalesce("doc_ids", F.array().cast(dict(cited.dtypes)["doc_id"].join(("array<", ">")))).alias("doc_ids"))


def evaluate(reports: DataFrame, now_ms: Column, submissions: Column) -> DataFrame:
    """A receipt for every enabled report: rendered or skipped, why, and whether it is a dangerous frequency."""
    verdict = policy.due(F.col("frequency"), F.col("last_ms"), now_ms, F.col("cadence_ms"), submissions, F.col("last_count"), F.col("threshold_n"))
    return reports.where("enabled").withColumn("v", verdict).select("report_type", F.when(F.col("v.due"), "rendered").otherwise("skipped").alias("action"), F.col("v.reason").alias("reason"), F.col("v.danger").alias("danger"))


def publish(bodies: DataFrame, versions: DataFrame, gates: DataFrame) -> DataFrame:
    """New versions of the bodies (report_type, body, ord) whose gates are all met; others with what is unmet."""
    met = bodies.join(gates.select("report_type", "unmet"), "report_type", "left")
    free = met.where(F.coalesce(F.size("unmet"), F.lit(0)) == 0).select("report_type", "body", "ord")
    numbered = next_versions(versions, free, "report_type", "ord").withColumn("unmet", F.array().cast("array<string>"))
    refused = met.where(F.size("unmet") > 0).select("report_type", "body", "ord", F.lit(None).cast("long").alias("version"), "unmet")
    return numbered.unionByName(refused)


def current(reports: DataFrame, versions: DataFrame) -> DataFrame:
    """The body of each report's current version."""
    return reports.join(versions.withColumnRenamed("version", "current_version"), ["report_type", "current_version"])


def report_index(types: DataFrame, reports: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """Every report type (report_type, ord) with its state, its next version and the gates that are not met.

    `reports` has report_type, enabled, current_version, approved, manual_required, min_submissions, min_evidence, publish_after;
    a type without a row is disabled, at version 0 and gated by nothing but approval. `counts` is one row of submissions and evidence.
    """
    met = types.join(reports, "report_type", "left").join(F.broadcast(counts))  # one row
    flag = lambda c, other: F.coalesce(c, F.lit(other))
    unmet = policy.unmet_gates(flag("manual_required", True), flag("approved", False), flag("min_submissions", 0), flag("min_evidence", 0), F.coalesce("publish_after", now), F.col("submissions"), F.col("evidence"), now)
    version = flag("current_version", 0).cast("long")
    return met.select("report_type", "ord", flag("enabled", False).alias("enabled"), version.alias("current_version"), (version + 1).alias("pending_version"), unmet.alias("unmet"), (F.size(unmet) == 0).alias("ok"))
