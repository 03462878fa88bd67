"""Evidence bundle and report renderers; E11 to E13, E17, the breach statement of E19, O5, O6, A3, A6."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import policy, text
from quillspark.lineage import cut, numbered

MAX_LINES, MAX_TITLE, MAX_SNIPPET = 50, 200, 500


def evidence_counts(submissions: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """A2, A3: one row: submissions, addenda, corpus_docs, held_docs, started_at."""
    subs = submissions.agg(F.count_if(F.col("kind") == "original").alias("submissions"), F.count_if(F.col("kind") == "addendum").alias("addenda"), F.min("created_at").alias("_first"))
    docs = documents.agg(F.count_if(policy.mirrored(F.col("status"))).alias("corpus_docs"), F.count_if(F.col("status") == "held").alias("held_docs"))
    return subs.join(F.broadcast(docs)).select("submissions", "addenda", "corpus_docs", "held_docs", F.coalesce("_first", now).alias("started_at"))


def evidence_lines(angles: DataFrame, lines: DataFrame) -> DataFrame:
    """Complete lines of approved angles with the angle's title."""
    good = angles.where("status = 'approved'").select("angle_id", "title")
    return lines.where("status = 'complete'").join(good, "angle_id").select("line_id", "title", "citations", "flags", "created_at", "ord")


def cited(citations: Column, flags: Column) -> Column:
    """A line's citations as text, with its flags."""
    each = F.transform(F.slice(citations, 1, MAX_LINES), lambda c: F.concat(F.lit("["), text.capped(c["doc_id"], MAX_TITLE), F.lit(": "), text.capped(c["snippet"], MAX_SNIPPET), F.lit("]")))
    marks = F.when(F.size(flags) > 0, F.concat(F.lit(" [flagged: "), F.array_join(F.transform(flags, lambda f: text.capped(f, 64)), ", "), F.lit("]"))).otherwise("")
    return F.concat(F.array_join(each, " "), marks)


def _first(lines: DataFrame, *order) -> DataFrame:
    """The first MAX_LINES lines: the report's own cap."""
    return lines.orderBy(*order).limit(MAX_LINES)


def _joined(lines: DataFrame, order: list, entry: Column, between: str, nothing: str) -> DataFrame:
    """One row `block` of entries in order."""
    rows = lines.select(F.struct(*order, F.monotonically_increasing_id().alias("_k")).alias("_o"), entry.alias("_e"))
    block = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_e"))), lambda r: r["_e"]), between)
    return rows.agg(F.when(block == "", nothing).otherwise(block).alias("block"))


def render(report_type: str, counts: DataFrame, lines: DataFrame, angles: DataFrame) -> DataFrame:
    """(report_type, body) of one of the five reports."""
    title = text.capped(F.col("title"), MAX_TITLE)
    marks = cited(F.col("citations"), F.col("flags"))
    if report_type == "briefing":
        rows = _joined(_first(lines, "ord"), ["ord"], F.concat(F.lit("- "), title, F.format_string(" (%d citations)", F.size("citations"))), "\n", "No research lines complete yet.")
        body = F.concat(F.format_string("Live briefing — %d submissions, %d corpus documents.\n", "submissions", "corpus_docs"), "block")
    elif report_type == "dossier":
        rows = _joined(_first(lines, "ord"), ["ord"], F.concat(F.lit("## "), title, F.lit("\n"), marks), "\n\n", "No cited claims yet.")
        body = F.concat(F.lit("# Evidence dossier\n\n"), "block")
    elif report_type == "timeline":
        rows = _joined(_first(lines, "created_at", "ord"), ["created_at", "ord"], F.concat(F.lit("- "), text.iso_day(F.col("created_at")), F.lit(": "), title), "\n", "Nothing dated yet.")
        body = F.concat(F.lit("# Timeline (investigation opened "), text.iso_day(F.col("started_at")), F.lit(")\n\n"), "block")
    elif report_type == "snapshot":
        rows = lines.agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(F.size("citations")), F.lit(0)).alias("n_cites")).join(F.broadcast(angles.where("status = 'approved'").agg(F.count(F.lit(1)).alias("n_angles"))))
        body = F.format_string(
            "# Data snapshot\n\n- Submissions: %d (+%d addenda)\n- Corpus documents: %d parsed, %d held\n- Angles: %d\n- Research lines: %d\n- Citations: %d",
            "submissions", "addenda", "corpus_docs", "held_docs", "n_angles", "n_lines", "n_cites",
        )
    elif report_type == "longform":
        rows = _joined(_first(lines, "ord"), ["ord"], F.concat(F.lit("## "), title, F.lit("\n\n[Exhibit-backed draft pending journalist pass.]\n"), marks), "\n\n", "No sections yet.")
        body = F.concat(F.lit("# Investigation (scaffold draft — prose pass pending)\n\n"), "block")
    else:
        raise ValueError(report_type)
    return counts.join(F.broadcast(rows)).select(F.lit(report_type).alias("report_type"), body.alias("body"))


def assemble(blocks: DataFrame, mirror: DataFrame, strict: bool) -> DataFrame:
    """Blocks (report_type, ord, heading, text, citations) with only grounded citations; without any they are dropped (strict) or marked."""
    each = blocks.select("report_type", "ord", F.posexplode("citations").alias("pos", "c")).select("report_type", "ord", "pos", "c.doc_id", "c.snippet")
    good = each.join(mirror.select("doc_id", "text"), "doc_id").where(F.contains("text", "snippet"))
    kept = good.groupBy("report_type", "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "snippet"))), lambda c: F.concat(F.lit("["), c["doc_id"].cast("string"), F.lit(": "), c["snippet"], F.lit("]"))).alias("marks"))
    met = blocks.join(kept, ["report_type", "ord"], "left").withColumn("uncited", F.col("marks").isNull())
    if strict:
        met = met.where("not uncited")
    line = F.concat(F.when(F.col("heading").isNotNull(), F.concat(F.lit("## "), "heading", F.lit("\n\n"))).otherwise(""), "text", F.when(F.col("uncited"), " [uncited]").otherwise(F.concat(F.lit(" "), F.array_join("marks", " "))))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda r: r["line"]), "\n\n")
    return met.groupBy("report_type").agg(body.alias("body"), F.count_if("uncited").alias("uncited"))


def timeline_lines(entries: DataFrame, strict: bool) -> DataFrame:
    """A line (report_type, position, line) for each stored entry (report_type, position, date, label, paragraph, citations); with `strict` only for cited ones."""
    rows = entries.where(F.size("citations") > 0) if strict else entries
    marks = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c["doc_id"].cast("string"), F.lit(": "), c["snippet"], F.lit("]"))), " ")
    head = F.concat(F.lit("- "), text.capped(F.col("date"), 64), F.lit(": **"), text.capped(F.col("label"), 200), F.lit("** — "), "paragraph")
    line = F.concat(head, F.when(F.size("citations") > 0, F.concat(F.lit("\n  "), marks)).otherwise(F.lit(" [uncited]")))
    return rows.select("report_type", "position", line.alias("line"))


def stored_timeline(entries: DataFrame, strict: bool) -> DataFrame:
    """A body per report_type from its stored entries, in order. For reports that are read as one value; of long ones there are `timeline_parts`.

    A report without entries has no row: its evidence render stands.
    """
    listed = timeline_lines(entries, strict).groupBy("report_type").agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("lines"))
    return listed.select("report_type", F.array_join(F.transform("lines", lambda r: r["line"]), "\n").alias("body"))


#: Characters of a part of a body, behind which the next one begins; Arrow batches hold thousands of parts.
PART_CHARS = 1 << 13


def timeline_parts(entries: DataFrame, strict: bool, most: int = PART_CHARS) -> DataFrame:
    """The same bodies in parts (report_type, range, part, body): those of a report, joined by line ends in the order of range and part, are its body.

    Entries are sorted in ranges over reports and positions, and a part has the lines of one range, so no task holds a report.
    """
    ranged = timeline_lines(entries, strict).repartitionByRange("report_type", "position").sortWithinPartitions("report_type", "position", "line").select("report_type", F.spark_partition_id().alias("range"), "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, of = [], 0, 0, None
        row = lambda: pa.RecordBatch.from_pylist([{"report_type": of[0], "range": of[1], "part": part, "body": "\n".join(held) if held else None}], schema)
        for batch in batches:
            for *mine, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of is not None and (mine != of or size >= most):
                    yield row()
                    held, size, part = [], 0, part + 1
                of = mine
                if line is not None:
                    held.append(line)
                    size += len(line) + 1
        if of is not None:
            yield row()

    schema = pa.schema([("report_type", pa.string()), ("range", pa.int32()), ("part", pa.int32()), ("body", pa.string())])
    return ranged.mapInArrow(run, "report_type string, range int, part int, body string")


def body_digests(parts: DataFrame) -> DataFrame:
    """SHA-256 (report_type, digest) of each body from its parts, which pass through its hash one after another; a part at a time is held."""
    # The parts are stored first: ranges come from a sample, and are to be computed once.
    rows = cut(parts, "parts").repartition("report_type").sortWithinPartitions("report_type", "range", "part").select("report_type", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda: pa.RecordBatch.from_pylist([{"report_type": of, "digest": digest.hexdigest()}], schema)
        of, digest, begun = None, None, False
        for batch in batches:
            for k in range(batch.num_rows):
                report, body = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if digest is None or report != of:
                    if digest is not None:
                        yield row()
                    of, digest, begun = report, hashlib.sha256(), False
                if body is not None:
                    digest.update(b"\n" * begun + body.encode())
                    begun = True
        if digest is not None:
            yield row()

    schema = pa.schema([("report_type", pa.string()), ("digest", pa.string())])
    return rows.mapInArrow(run, "report_type string, digest string")


def case_dossier(angles: DataFrame, lines: DataFrame) -> DataFrame:
    """Per angle its lines, in order, as one text."""
    line = F.concat(F.lit("### "), text.line_anchor(F.col("line_id").cast("string")), F.lit("\n"), cited(F.col("citations"), F.col("flags")))
    own = lines.groupBy("angle_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("t")))), lambda r: r["t"]), "\n\n").alias("block"))
    return angles.join(own, "angle_id", "left").select("angle_id", F.concat(F.lit("## "), "title", F.lit("\n\n"), F.coalesce("block", F.lit("No lines yet."))).alias("section"))


def breach_statement(breaches: DataFrame, now: Column) -> DataFrame:
    """A statement per breach from its clock."""
    clock = policy.breach_clock(F.col("aware_at"), now)
    state = F.when(F.col("clock.overdue"), F.format_string("overdue by %d day(s)", F.col("clock.days_overdue"))).otherwise(F.format_string("%d day(s) left", F.col("clock.days_remaining")))
    return breaches.withColumn("clock", clock).select("breach_id", F.format_string("Breach %s, aware since %s: %s.", F.col("breach_id").cast("string"), F.date_format("aware_at", "yyyy-MM-dd"), state).alias("statement"), F.col("clock.overdue").alias("overdue"))


def timeline_place(lines: DataFrame) -> DataFrame:
    """Lines with their place in time, before the cap."""
    return numbered(lines, [F.col("created_at"), F.col("ord")], "place")
