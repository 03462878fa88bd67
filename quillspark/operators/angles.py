"""Angles: proposals grounded in documents, ranking, and the ledger of settled topics; J7, J8, O2, E1, E3 to E5, U1 to U3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.lineage import numbered
from quillspark.operators.mirror import holders
from quillspark.operators.search_index import first_of


def propose(topics: DataFrame, mirror: DataFrame, exhibits: int = 3) -> DataFrame:
    """For each topic (topic, topic_ord) up to three exhibits, the first documents by `ord` that contain one of its seeds.

    Distinct seeds are looked for in each text once. A topic's first documents are among the first ones of its seeds,
    so each seed keeps three, partly before the shuffle, and texts come back for the chosen exhibits alone.
    """
    seeded = topics.select("topic", "topic_ord", text.topic_seeds(F.col("topic")).alias("seeds"))
    seeds = seeded.select("topic", "topic_ord", F.explode("seeds").alias("seed")).where("seed <> ''")
    named = seeds.select(F.col("seed").alias("snippet")).distinct().withColumn("snippet_id", F.xxhash64("snippet"))
    low = mirror.where(F.trim("text") != "").select("doc_id", F.lower("text").alias("text"))
    hits = holders(named, low).join(mirror.select("doc_id", "ord"), "doc_id")
    first = first_of(hits, ["snippet_id"], ["ord", "doc_id"], exhibits).drop("place")
    met = seeds.withColumn("snippet_id", F.xxhash64("seed")).join(first, "snippet_id").where("seed is not null").select("topic_ord", "topic", "doc_id", "ord").distinct()
    kept = first_of(met, ["topic_ord", "topic"], ["ord", "doc_id"], exhibits).drop("ord").join(mirror.select("doc_id", "text"), "doc_id").join(seeded, ["topic_ord", "topic"])
    kept = kept.withColumn("snippet", text.snippet_for(F.col("text"), text.first_hit(F.col("text"), F.col("seeds"))))
    rows = kept.groupBy("topic_ord", "topic").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "snippet"))).alias("found"))
    listed = F.transform("found", lambda e: F.struct(e["doc_id"].alias("doc_id"), e["snippet"].alias("snippet")))
    rationale = F.format_string('Grounded in %d exhibit(s) sharing vocabulary with "%s".', F.size("found"), F.col("topic"))
    return rows.select("topic_ord", "topic", F.concat(F.lit("Angle: "), "topic").alias("title"), rationale.alias("rationale"), listed.alias("exhibits"))


def rank(angles: DataFrame) -> DataFrame:
    """O2: one angle per normalised title (the first by `ord`), most exhibits first, ties by `ord`."""
    first = F.row_number().over(Window.partitionBy(text.normalise_title(F.col("title"))).orderBy("ord"))
    unique = angles.withColumn("_first", first).where("_first = 1").drop("_first")
    return numbered(unique, [F.desc(F.size("exhibits")), F.col("ord")], "rank")


def fresh_topics(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates (topic, ord) whose normal form isn't settled; duplicates and spelling stay."""
    settled = ledger.select(text.normalise_topic(F.col("topic")).alias("_form")).distinct()
    return candidates.withColumn("_form", text.normalise_topic(F.col("topic"))).join(settled, "_form", "left_anti").drop("_form")


def narrowed(live: DataFrame, floor: DataFrame) -> DataFrame:
    """A live judge may only narrow the floor's choice."""
    return live.join(floor.select("topic").distinct(), "topic", "left_semi")


def retrigger(completed: DataFrame, topics: DataFrame, ledger: DataFrame, most: int = 5) -> DataFrame:
    """Topics of a completed submission's family, the first five by name, and of those the fresh ones."""
    family = completed.select("submission_id", F.col("submission_id").alias("member")).union(completed.where("parent_id is not null").select("submission_id", F.col("parent_id").alias("member")))
    own = family.join(topics.withColumnRenamed("submission_id", "member"), "member").select("submission_id", "topic").distinct()
    place = F.row_number().over(Window.partitionBy("submission_id").orderBy("topic"))
    return fresh_topics(own.withColumn("ord", place).where(F.col("ord") <= most), ledger)


def grounded(proposed: DataFrame, mirror: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A model's angles (ord, title, rationale, exhibits of doc_id and snippet) with only the exhibits that stand verbatim in their document, ranked, and the number dropped.

    An angle left without exhibits is dropped, and counts once more. Where none is left, the floor proposes.
    """
    each = proposed.select("ord", F.posexplode("exhibits").alias("pos", "e")).select("ord", "pos", "e.doc_id", "e.snippet")
    good = each.join(mirror.select("doc_id", "text"), "doc_id").where(F.contains("text", "snippet"))
    kept = good.groupBy("ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "snippet"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["snippet"].alias("snippet"))).alias("kept"))
    met = proposed.join(kept, "ord", "left")
    lost = F.size("exhibits") - F.coalesce(F.size("kept"), F.lit(0)) + F.col("kept").isNull().cast("int")
    dropped = met.agg(F.coalesce(F.sum(lost), F.lit(0)).cast("long").alias("dropped"))
    some = met.where("kept is not null").select("ord", "title", "rationale", F.col("kept").alias("exhibits"))
    if some.isEmpty():
        some = propose(topics, mirror).select(F.col("topic_ord").alias("ord"), "title", "rationale", "exhibits")
    return rank(some), dropped


def store(angles: DataFrame, call_topics: DataFrame, ledger: DataFrame) -> DataFrame:
    """A call's ranked angles (rank, title, rationale, exhibits) with suspicion flags, status, place and the topics of the call.

    An angle lists all topics of its call, in normal form. The call is a repetition, and stores nothing, if it has topics and all of them are settled.
    """
    forms = call_topics.select(text.normalise_topic(F.col("topic")).alias("form")).where("form <> ''").distinct()
    settled = ledger.select(text.normalise_topic(F.col("topic")).alias("form")).distinct().withColumn("settled", F.lit(True))
    call = forms.join(settled, "form", "left").agg(F.sort_array(F.collect_set("form")).alias("topics"), F.coalesce(F.bool_and(F.coalesce("settled", F.lit(False))), F.lit(False)).alias("repeated"))  # one row
    flags = text.suspicion_flags(F.col("title"), F.transform("exhibits", lambda e: e["snippet"]))
    out = angles.join(F.broadcast(call)).where("not repeated").drop("repeated").withColumn("flags", flags).withColumn("status", F.when(F.size("flags") > 0, "held").otherwise("queued"))
    return out.withColumn("place", F.col("rank") - 1)


def review(status: Column, flags: Column, action: Column) -> Column:
    """The new status of an angle or line, or the refusal, of approve, review and reject."""
    return (
        F.when(action == "reject", F.when(status == "rejected", "bad_state").otherwise("rejected"))
        .when(action == "approve", F.when(status != "queued", "bad_state").when(F.size(flags) > 0, "needs_review").otherwise("approved"))
        .when(action == "review", F.when((F.size(flags) > 0) & (status != "rejected"), "approved").otherwise("bad_state"))
        .otherwise("bad_action")
    )
