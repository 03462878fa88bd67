"""Threads and submissions: reply trees, ordered messages, rollups; J14, J16, J18, A5, A8, E21, E25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.lineage import cut, release


def reply_parents(messages: DataFrame) -> DataFrame:
    """The last reference of each message (message_id, ord, refs) that names another message, as `parent` and `parent_ord`.

    `ord` tells messages apart. An id that several have means the last of them.
    """
    known = messages.groupBy(F.col("message_id").alias("ref")).agg(F.max("ord").alias("parent_ord"))
    refs = messages.select(F.col("ord").alias("child"), F.posexplode("refs").alias("pos", "ref"))
    found = refs.join(known, "ref").where("parent_ord <> child").groupBy("child").agg(F.max_by(F.struct("ref", "parent_ord"), "pos").alias("p"))
    met = messages.join(found, messages["ord"] == found["child"], "left")
    return met.select(*[messages[c] for c in messages.columns], F.col("p.ref").alias("parent"), F.col("p.parent_ord").alias("parent_ord"))


def thread_roots(messages: DataFrame) -> DataFrame:
    """Each message (message_id, ord, refs; `ord` is its own) with the root of its thread, by pointer doubling.

    A message without a parent is a root. A cycle of references, and what leads into it, is one thread, whose root is
    the cycle's first message. No path is longer than the messages are many, which bounds the rounds; they end when
    every pointer rests. Along with its pointer a message keeps the first message that it has passed. Lineage is cut after every round.
    """
    up = cut(reply_parents(messages).select("ord", "message_id", "parent_ord"), "parents")
    top = F.col("parent_ord").isNull()
    now = up.select("ord", F.coalesce("parent_ord", "ord").alias("at"), F.col("ord").alias("low"), top.alias("rests"))
    step, most = 1, up.count()
    moving = now.where("not rests").count()
    while moving and step < 2 * most:
        hop = now.select(F.col("ord").alias("at"), F.col("at").alias("further"), F.col("low").alias("later"), F.col("rests").alias("there"))
        last = now
        now = cut(now.join(hop, "at").select("ord", F.col("further").alias("at"), F.least("low", "later").alias("low"), F.col("there").alias("rests")), "roots")
        if step > 1:
            release(last)
        moving, step = now.where("not rests").count(), 2 * step
    # A pointer that never rests points into a cycle by now; what that message has passed is the whole cycle.
    around = now.where("not rests").select(F.col("ord").alias("at"), F.col("low").alias("first")).distinct()
    met = now.join(around, "at", "left").select("ord", F.when(F.col("rests"), F.col("at")).otherwise(F.col("first")).alias("root_ord"))
    roots = up.select(F.col("ord").alias("root_ord"), F.col("message_id").alias("root"))
    return met.join(roots, "root_ord").join(up.select("ord", "message_id"), "ord").select("message_id", "ord", "root", "root_ord")


def messages_in_order(messages: DataFrame, key: str = "submission_id") -> DataFrame:
    """One row a thread, its messages by seq."""
    return messages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "role", "body"))).alias("messages"))


def submission_index(submissions: DataFrame, attachments: DataFrame, consents: DataFrame) -> DataFrame:
    """Attachments by state and the last activity of each submission."""
    files = attachments.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("attachments"), F.count_if(F.col("status") != "held").alias("settled"), F.count_if(F.col("status") == "held").alias("held"),
        F.count_if(F.col("raw_key").isNotNull()).alias("raw_retained"), F.max("created_at").alias("_last"),
    )
    said = consents.groupBy("submission_id").agg(F.count(F.lit(1)).alias("consents"))
    met = submissions.join(files, "submission_id", "left").join(said, "submission_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return met.select("submission_id", zero("attachments"), zero("settled"), zero("held"), zero("raw_retained"), zero("consents"), F.greatest("created_at", "_last").alias("last_activity"))


def line_titles(lines: DataFrame, angles: DataFrame) -> DataFrame:
    """Lines with their angle's title."""
    return lines.join(angles.select("angle_id", "title"), "angle_id", "left").withColumn("title", F.coalesce("title", F.lit("Untitled angle")))


def submission_detail(submissions: DataFrame, messages: DataFrame, attachments: DataFrame, entity_links: DataFrame, topics: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row a submission: messages by seq, attachments, person links, topics and latest consent decisions, each as a list, and the last activity."""

    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy("submission_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    last = attachments.groupBy("submission_id").agg(F.max("created_at").alias("_last"))
    out = submissions.join(last, "submission_id", "left")
    for part in (
        listed(messages, "messages", "seq", "role", "body"), listed(attachments, "attachments", "created_at", "attachment_id", "status"),
        listed(entity_links, "entities", "label", "name_hmac", "sealed"), listed(topics, "topics", "topic", "source"), listed(decisions, "consent", "category", "granted"),
    ):
        out = out.join(part, "submission_id", "left")
    names = ("messages", "attachments", "entities", "topics", "consent")
    kinds = dict(out.dtypes)
    return out.select(*submissions.columns, F.greatest("created_at", "_last").alias("last_activity"), *(F.coalesce(n, F.array().cast(kinds[n])).alias(n) for n in names))


def attachment_bytes(submissions: DataFrame, attachments: DataFrame) -> DataFrame:
    """A5: bytes of each submission's attachments, 0 where it has none."""
    total = attachments.groupBy("submission_id").agg(F.sum("size_bytes").alias("_bytes"))
    return submissions.select("submission_id").join(total, "submission_id", "left").select("submission_id", F.coalesce("_bytes", F.lit(0)).alias("bytes"))
