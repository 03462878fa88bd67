"""The searchable mirror: token table, prefix search, grounded citations; F19, F20, J5, J6, E6, E8."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import policy, text
from quillspark.functions.crypto import sha256_hex
from quillspark.operators import search_index

#: Bytes of snippets that may be sent to every task; more are joined by word n-grams.
PATTERN_BYTES = 8 << 20


def search(mirror: DataFrame, queries: DataFrame, limit: int = 4, index: str | None = None) -> DataFrame:
    """for each query (query_id, terms) the first `limit` documents, in `ord`, that hold a word starting with one of its words, and how they begin.

    `index` is where `search_index.extend` has stored the mirror's postings; without it every text is read.
    """
    found = search_index.search(queries, index, limit) if index else search_index.search_unstored(queries, mirror, limit)
    return found.join(mirror.select("doc_id", F.substring("text", 1, 400).alias("snippet")), "doc_id").select("query_id", "place", "doc_id", "snippet")


def ground(citations: DataFrame, mirror: DataFrame) -> DataFrame:
    """J5 with a document id: every citation with `grounded`, whether its snippet stands verbatim in that document."""
    docs = mirror.select("doc_id", "text")
    return citations.join(docs, "doc_id", "left").withColumn("grounded", F.coalesce(F.contains("text", "snippet"), F.lit(False))).drop("text")


def ground_anywhere(snippets: DataFrame, mirror: DataFrame, id_column: str = "item_id") -> DataFrame:
    """J5 without one: pairs of a snippet and a document that holds it verbatim."""
    named = snippets.select(F.col(id_column).alias("snippet_id"), F.col("text").alias("snippet"))
    return holders(named, mirror).withColumnRenamed("snippet_id", id_column)


def holders(named: DataFrame, mirror: DataFrame, most_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Pairs (snippet_id, doc_id) of a snippet that isn't empty and a text (doc_id, text) that contains it.

    Few snippets go to every task as one multi-pattern automaton, so each text is read once;
    their size is measured first. More of them meet documents on a run of words or characters.
    """
    named = named.select("snippet_id", "snippet").where("snippet is not null and snippet <> ''")
    size = named.agg(F.sum(F.octet_length("snippet"))).first()[0] or 0
    if size <= most_bytes:
        return _by_automaton([(r[0], r[1]) for r in named.collect()], mirror)
    return ground_by_words(named, mirror)


def _by_automaton(patterns: list[tuple[int, str]], mirror: DataFrame) -> DataFrame:
    by_text: dict[str, list[int]] = {}
    for who, pattern in patterns:
        by_text.setdefault(pattern, []).append(who)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pattern, ids in by_text.items():
            machine.add_word(pattern, ids)
        if by_text:
            machine.make_automaton()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part, found = batch.slice(lo, 1024), []
                for doc, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if content and by_text:
                        # One list of ids a pattern, so that a text full of one pattern holds it once.
                        met = {id(ids): ids for _, ids in machine.iter(content)}
                        found += [(who, doc) for who in sorted({w for ids in met.values() for w in ids})]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["snippet_id", "doc_id"])

    return mirror.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "snippet_id long, doc_id long")


def ground_by_words(named: DataFrame, mirror: DataFrame, run: int = 3) -> DataFrame:
    """Pairs as of `holders`, whose candidates share an inner run of whole words; for shorter snippets a run of characters."""
    space = r"\s+"

    def grams(words):
        return F.transform(F.sequence(F.lit(1), F.size(words) - run + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, run), " ")))

    parts = named.where("snippet is not null and snippet <> ''").withColumn("words", F.split("snippet", space))
    inner = F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))  # the outer words may be cut
    long = parts.where(F.size("words") >= run + 2).select("snippet_id", "snippet", F.array_min(grams(inner)).alias("gram"))
    words = F.split("text", space)
    posts = mirror.select("doc_id", words.alias("words")).where(F.size("words") >= run).select("doc_id", F.explode(F.array_distinct(grams(F.col("words")))).alias("gram"))
    short = parts.where(F.size("words") < run + 2).select("snippet_id", "snippet")
    return _verified(posts.join(long, "gram"), mirror).union(ground_by_characters(short, mirror)).distinct()


def ground_by_characters(named: DataFrame, mirror: DataFrame, run: int = 4) -> DataFrame:
    """Pairs as of `holders`, whose candidates share a run of characters, one of the snippet's; in snippets of fewer characters, all of them."""

    def grams(c, size: int):
        return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))

    chosen = named.withColumn("size", F.least(F.lit(run), F.length("snippet")))
    found = None
    for size in range(1, run + 1):
        # Of a snippet's runs the least by hash, so that common ones are not chosen more often than others.
        mine = chosen.where(F.col("size") == size).withColumn("gram", F.array_min(F.transform(grams(F.col("snippet"), size), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"])
        met = mirror.select("doc_id", F.explode(grams(F.col("text"), size)).alias("gram")).join(mine, "gram").select("snippet_id", "snippet", "doc_id")
        found = met if found is None else found.union(met)
    return _verified(found, mirror)


def _verified(candidates: DataFrame, mirror: DataFrame) -> DataFrame:
    pairs = candidates.select("snippet_id", "snippet", "doc_id").distinct()
    return pairs.join(mirror.select("doc_id", "text"), "doc_id").where(F.contains("text", "snippet")).select("snippet_id", "doc_id")


def check_web(citations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Web citations against snapshots: ok, and else why not (unknown, tampered, absent)."""
    met = citations.join(snapshots.select("snapshot_id", "text", "content_sha256"), "snapshot_id", "left")
    error = (
        F.when(F.col("content_sha256").isNull(), "unknown_snapshot").when(sha256_hex(F.col("text")) != F.col("content_sha256"), "tampered_snapshot")
        .when(~F.contains("text", "snippet"), "invalid_citation")
    )
    return met.withColumn("error", error).withColumn("ok", error.isNull()).drop("text", "content_sha256")


def finish_lines(lines: DataFrame, citations: DataFrame, mirror: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For each line (line_id, status, spend_cap, spend_used, findings) whether its citations complete it.

    The first reason holds: bad_state, citations_required, over_cap, then the first bad
    citation by `pos`. Lines that pass are complete, or held if anything is flagged.
    """
    web = check_web(citations.where("snapshot_id is not null and doc_id is null"), snapshots).select("line_id", "pos", "snippet", F.col("error"))
    own = ground(citations.where("doc_id is not null and snapshot_id is null"), mirror.select("doc_id", "text"))
    own = own.join(mirror.select("doc_id").distinct().withColumn("there", F.lit(True)), "doc_id", "left")
    own = own.select("line_id", "pos", "snippet", F.when(F.col("there").isNull(), "unknown_citation").when(~F.col("grounded"), "invalid_citation").alias("error"))
    odd = citations.where("(doc_id is null) = (snapshot_id is null)").select("line_id", "pos", "snippet", F.lit("invalid_citation").alias("error"))
    checked = own.unionByName(web).unionByName(odd)
    per_line = checked.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("cited"), F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "error"))).alias("bad"), F.sort_array(F.collect_list(F.struct("pos", "snippet"))).alias("refs")
    )
    met = lines.join(per_line, "line_id", "left")
    error = (
        F.when(F.col("status") != "running", "bad_state").when(F.coalesce("cited", F.lit(0)) == 0, "citations_required")
        .when(F.col("spend_used") > F.col("spend_cap"), "over_cap").otherwise(F.col("bad.error"))
    )
    flags = text.suspicion_flags(F.col("findings"), F.coalesce(F.transform("refs", lambda r: r["snippet"]), F.array().cast("array<string>")))
    out = met.withColumn("error", error).withColumn("flags", F.when(error.isNull(), flags))
    done = F.when(F.col("error").isNull(), F.when(F.size("flags") > 0, "held").otherwise("complete")).otherwise(F.col("status"))
    return out.select("line_id", F.col("error").isNull().alias("ok"), "error", done.alias("status"), "flags")


def floor_research(angles: DataFrame, mirror: DataFrame, index: str | None = None) -> DataFrame:
    """Excerpts of the first three documents found for each angle (angle_id, title, topics, exhibits); its exhibits where none is, and held without either."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    terms = F.concat(words(F.col("title")), F.flatten(F.transform("topics", words)))
    asked = angles.select(F.col("angle_id").alias("query_id"), terms.alias("terms"))
    titled = angles.select(F.col("angle_id").alias("query_id"), F.concat(F.array("title"), "topics").alias("terms"))
    hits = (search_index.search(titled, index) if index else search_index.search_unstored(titled, mirror)).where("place <= 3")
    full = hits.join(mirror.select("doc_id", "text"), "doc_id").join(asked, "query_id")
    found = full.withColumn("snippet", text.excerpt(F.col("text"), F.col("terms"))).where("snippet <> ''")
    cites = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id", "snippet"))), lambda c: F.struct(c["doc_id"].cast("string").alias("doc_id"), c["snippet"].alias("snippet"))).alias("cites"))
    met = angles.join(cites, angles["angle_id"] == cites["query_id"], "left")
    chosen = F.coalesce("cites", F.slice("exhibits", 1, 3))
    none = F.size(chosen) == 0
    return met.select(
        "angle_id", F.when(none, "held").otherwise("findings").alias("kind"), chosen.alias("citations"),
        F.when(none, F.array(F.lit("ungrounded"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.when(none, "no mirrored document matched the angle").alias("reason"),
    )


def mirror_counts(documents: DataFrame) -> DataFrame:
    """A2: mirrored and held documents in one pass."""
    return documents.agg(F.count_if(policy.mirrored(F.col("status"))).alias("mirrored"), F.count_if(F.col("status") == "held").alias("held"))
