"""Person entities joined by keyed hashes only; J3, J4, A1, E18, E26, W5, W6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.functions.crypto import is_hmac, seal, unseal
from quillspark.functions.text import entity_markers
from quillspark.lineage import cut


def index(gated: DataFrame, sealed: DataFrame) -> DataFrame:
    """(submission_id, label, name_hmac) for the markers that a submission's texts show."""
    shown = gated.select("submission_id", F.explode(entity_markers(F.col("text"))).alias("label"))
    return shown.join(sealed.select("submission_id", "label", "name_hmac"), ["submission_id", "label"]).dropDuplicates(["submission_id", "label", "name_hmac"])


def links(entity_index: DataFrame, entities: DataFrame, hmac: str | None = None) -> DataFrame:
    """Index rows with the number of sealed entities of the same name."""
    counts = entities.groupBy("name_hmac").agg(F.count(F.lit(1)).alias("sealed"))
    rows = entity_index if hmac is None else entity_index.where(F.col("name_hmac") == hmac)
    return rows.join(counts, "name_hmac", "left").withColumn("sealed", F.coalesce("sealed", F.lit(0).cast("long"))).select("submission_id", "label", "name_hmac", "sealed")


def corroboration(entity_index: DataFrame) -> DataFrame:
    """Mentions and submissions per name."""
    return entity_index.groupBy("name_hmac").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("submission_id").alias("submissions"))


def reveal(entity_index: DataFrame, requests: DataFrame) -> DataFrame:
    """For each requested hash the links to record, or why it is refused."""
    grouped = entity_index.groupBy("name_hmac").agg(F.sort_array(F.collect_set(F.struct("submission_id", "label"))).alias("links"))
    met = requests.join(grouped, "name_hmac", "left")
    return met.withColumn("error", F.when(~is_hmac(F.col("name_hmac")), "invalid_hmac").when(F.col("links").isNull(), "not_found"))


def open_names(entities: DataFrame, requests: DataFrame, key: Column, audit: str, now: Column | None = None) -> DataFrame:
    """The names behind requested hashes (request_id, name_hmac, revealed_by, reason), each with its audit record, or why there is none.

    The records are written and committed first, and a name is opened only for a request that is read back from them: no
    record, no name. A request that comes again finds its record and leaves no second one; one whose id stands for another hash opens nothing.

    A name's links, as they are then, are stored once below the audit (`links_id`, a row a link), whatever number of requests opens it;
    records hold the set's id and size. `n_links` is the size of `links`, which meet the requests last and aren't made where nobody reads them.
    """
    names = requests.select("name_hmac").distinct()
    pair = ("submission_id", "label")
    held = cut(entities.join(names, "name_hmac", "left_semi").groupBy("name_hmac", *pair).agg(F.min("name_envelope").alias("name_envelope")), "held")
    half = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.to_json(F.struct(*pair))).cast("decimal(20,0)"))  # noqa: E731  in any order
    sums = held.groupBy("name_hmac").agg(F.count(F.lit(1)).alias("n_links"), half(1).alias("_a"), half(2).alias("_b"), F.min_by("name_envelope", F.struct(*pair)).alias("_envelope"))
    sums = cut(sums.select("name_hmac", "n_links", "_envelope", F.sha2(F.concat_ws(" ", "name_hmac", "n_links", "_a", "_b"), 256).alias("links_id")), "names")
    refused = F.when(~is_hmac(F.col("name_hmac")), "invalid_hmac").when(F.col("links_id").isNull(), "not_found")
    judged = requests.join(sums, "name_hmac", "left").withColumn("error", refused)
    record = seal(F.to_json(F.struct("revealed_by", "reason")), key)
    rows = judged.where("error is null").select("request_id", "name_hmac", "links_id", "n_links", record.alias("record_envelope"), (F.current_timestamp() if now is None else now).alias("revealed_at"))
    sinks.insert_ignore(held.join(sums.where(is_hmac(F.col("name_hmac"))).select("name_hmac", "links_id"), "name_hmac").select("links_id", *pair), f"{audit}/links", ["links_id", *pair])
    sinks.insert_ignore(rows, audit, ["request_id"])
    kept = sinks.read(requests.sparkSession, audit).select("request_id", "name_hmac", F.lit(True).alias("_kept"))
    met = judged.join(kept, ["request_id", "name_hmac"], "left")
    name = F.when(F.col("_kept"), unseal(F.col("_envelope"), key))
    error = F.when(F.col("error").isNull() & F.col("_kept").isNull(), "not_recorded").when(F.col("error").isNull() & name.isNull(), "unreadable").otherwise(F.col("error"))
    grouped = held.groupBy("name_hmac").agg(F.sort_array(F.collect_list(F.struct(*pair))).alias("links"))
    told = met.select("request_id", "name_hmac", name.alias("name"), F.when(F.col("_kept"), F.col("n_links")).alias("n_links"), error.alias("error"), "_kept")
    return told.join(grouped, "name_hmac", "left").select("request_id", "name_hmac", "name", "n_links", F.when(F.col("_kept"), F.col("links")).alias("links"), "error")


def reveals(spark: SparkSession, audit: str, key: Column) -> DataFrame:
    """The audit for its readers: who opened which hash and why; names are no part of it."""
    opened = F.from_json(unseal(F.col("record_envelope"), key), "revealed_by string, reason string")
    link = F.struct(F.col("submission_id").cast("string").alias("submission_id"), "label")
    links_ = sinks.read(spark, f"{audit}/links").groupBy("links_id").agg(F.sort_array(F.collect_list(link)).alias("links"))
    return records(spark, audit).withColumn("o", opened).join(links_, "links_id", "left").select("request_id", "name_hmac", "links", "o.revealed_by", "o.reason", "revealed_at")


def records(spark: SparkSession, audit: str) -> DataFrame:
    """The stored records as they are: request_id, name_hmac, links_id, n_links, record_envelope, revealed_at."""
    return sinks.read(spark, audit)
