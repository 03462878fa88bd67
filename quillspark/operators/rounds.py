"""Rounds of follow-up questions: E10, P18, and gates of answers, P24."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import policy
from quillspark.operators.search_index import first_of

PER_ROUND = 3

# The questions of rounds without a model, in the order in which they are asked.
STATIC_QUESTIONS = (
    ("roster", "How are rosters set, and what happens when you push back?"),
    ("safety", "Describe a time safety and speed were in conflict."),
    ("pay", "How does pay actually work — penalties, overtime, allowances?"),
    ("hours", "What do your hours do to sleep, family, and health?"),
    ("management", "How does management respond to complaints?"),
    ("bullying", "Have you seen bullying or intimidation? What happened?"),
    ("breaks", "Do you reliably get your breaks? What interferes?"),
    ("equipment", "Is the equipment fit for purpose? What fails?"),
    ("training", "Was your training adequate for the real job?"),
    ("union", "What role does the union play day to day?"),
    ("injury", "Have you been injured, or seen injuries handled badly?"),
    ("culture", "What is the one thing outsiders don't understand?"),
)


def static_questions(submissions: DataFrame, covered: DataFrame, pool=STATIC_QUESTIONS, count: int = PER_ROUND) -> DataFrame:
    """E10 without a model: for each submission the first questions of the pool whose topic it hasn't covered. `covered` has submission_id, topic."""
    asked = F.array(*(F.struct(F.lit(t).alias("topic"), F.lit(q).alias("question")) for t, q in pool))
    done = covered.groupBy("submission_id").agg(F.collect_set("topic").alias("_done"))
    met = submissions.select("submission_id").join(done, "submission_id", "left")
    fresh = F.slice(F.filter(asked, lambda q: ~F.array_contains(F.coalesce("_done", F.array().cast("array<string>")), q["topic"])), 1, count)
    return met.select("submission_id", F.posexplode(fresh).alias("place", "q")).select("submission_id", "place", "q.topic", "q.question")


def round_questions(submissions: DataFrame, proposed: DataFrame, covered: DataFrame, pool=STATIC_QUESTIONS) -> DataFrame:
    """A model's questions (submission_id, ord, topic, question) that repeat no topic and hold no marker; the static ones where none is left.

    `tier` is model, static-fallback (nothing of the model's was left) or static (it proposed nothing), `dropped` counts what went.
    """
    safe = proposed.where(policy.safe_question(F.col("question"))).join(covered.select("submission_id", "topic"), ["submission_id", "topic"], "left_anti")
    kept = first_of(safe, ["submission_id", "topic"], ["ord"], 1).drop("place")
    counts = proposed.groupBy("submission_id").agg(F.count(F.lit(1)).alias("proposed"))
    left = kept.groupBy("submission_id").agg(F.count(F.lit(1)).alias("left"))
    tiers = submissions.select("submission_id").join(counts, "submission_id", "left").join(left, "submission_id", "left").select(
        "submission_id", F.when(F.col("left") > 0, "model").when(F.col("proposed") > 0, "static-fallback").otherwise("static").alias("tier"),
        (F.coalesce("proposed", F.lit(0)) - F.coalesce("left", F.lit(0))).alias("dropped"),
    )
    asked = kept.select("submission_id", F.col("ord").cast("long").alias("place"), "topic", "question")
    asked = asked.union(static_questions(tiers.where("tier <> 'model'"), covered, pool).select("submission_id", F.col("place").cast("long"), "topic", "question"))
    return asked.join(tiers, "submission_id")


def hits_kept(hits: Column, most: int = 32) -> Column:
    """The name hits of an answer that are sealed; its text is scrubbed of all of them."""
    return F.slice(hits, 1, most)


def file_labels(names: Column, kind: str) -> Column:
    """`[kind-name 1]`, `[kind-name 2]`, ... for the names of a file, in order."""
    return F.transform(names, lambda n, i: F.struct(F.concat(F.lit(f"[{kind}-name "), (i + 1).cast("string"), F.lit("]")).alias("label"), n.alias("name")))
