"""Exact de-duplication through content-defined chunk recipes (native: DataFrame functions only).

A text is cut where its content says so, each chunk gets an identifier that is verified
against the chunk's SHA-256, and two texts are equal when their ordered identifier lists
are. Only identifiers are shuffled; a long document is read once, in its own scan task.

Defined cases: null text counts as empty, and the empty text has the empty recipe. Of equal
texts the row with the largest doc_id stays; rows that repeat the same doc_id count in
group_size and share `kept`. Null doc_ids take part in groups and never stay when another
doc_id is there. An empty table gives an empty table. Columns other than those named are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, met_by_key, text_of

#: Chunk sizes in characters: no cut before MIN_CHUNK, none later than MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Where a cut may fall: in a gap between words, by the letters on its two sides. Such gaps are rare
#: against an edit's length, so cuts before and after an edit soon coincide.
CUT = r"(?:[n-z][a-m.,][ \n](?=[a-d]))"


def chunks(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """Content-defined chunks of a text, in order; their concatenation is the text.

    Cuts depend on nearby characters and on the last cut only, so after an edit the cuts fall
    into step again within a chunk or two.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{low},{high - 3}}}?{CUT}|.{{1,{high}}}"), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_sha256, ids (ordered chunk identifiers), digests (their SHA-256)."""
    text = text_of(docs)
    parts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), chunks(text).alias("parts"))
    return parts.select(
        "doc_id", "text_sha256",
        F.transform("parts", lambda c: F.xxhash64(c, F.length(c))).alias("ids"),
        F.transform("parts", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )


def colliding(listed: DataFrame) -> DataFrame:
    """Chunk identifiers that stand for more than one content, by the chunk dictionary of the whole corpus."""
    pairs = listed.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests")
    return pairs.groupBy("ids").agg(F.min("digests").alias("a"), F.max("digests").alias("b")).where("a <> b").select("ids")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Documents with their group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    The chunk dictionary is de-duplicated first (a hot chunk is pre-aggregated in each task)
    and proves that no identifier stands for two contents; if one does, recipes are spelled
    with the chunks' SHA-256 instead. Groups come from equal recipes; their decisions go back to the
    documents on the recipe, those of large groups to every task.
    """
    listed = cut(recipes(docs), "recipes")
    verified = colliding(listed).isEmpty()
    recipe = F.col("ids") if verified else F.col("digests")
    listed = listed.select("doc_id", "text_sha256", recipe.alias("recipe"))
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    met = met_by_key(listed, groups, "recipe", "group_size", listed.count())
    return met.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: the largest doc_id of each group of equal texts.

    Rows that repeat both doc_id and text collapse to one. The decision table has ids only;
    texts move once, to meet it by doc_id.
    """
    key = lambda doc, sha: F.concat_ws(":", sha, doc.cast("string"))  # noqa: E731  without an end where there is no doc_id
    found = exact_groups(docs).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    mine = docs.select(F.struct("*").alias("_row"), key(docs["doc_id"].cast("long"), F.sha2(text_of(docs), 256)).alias("_key"))
    # One partitioning serves the join and the repetitions.
    return mine.join(found, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


SQL = """
SELECT d.doc_id, max(d.doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       d.doc_id = max(d.doc_id) OVER g AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d WINDOW g AS (PARTITION BY coalesce(d.text, ''))
"""
