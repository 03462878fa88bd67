"""Registered queries of files, sinks and the functions round them.

Files are made from the texts of the tables by small writers, read back by the parsers, and held
against SQL that knows the text. Sinks write a table, change it and read it back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.functions import crypto, policy, text
from quillspark.lineage import cut
from quillspark.operators import angles, audit, consent, publish
from quillspark.plans import fixtures
from quillspark.plans.registry import Tables, now, place, query
from quillspark.sources import bounded, files, leads
from quillspark.streaming import jobs, lifecycle

# What stands on a line of these files: the text with single blanks, which all formats keep.
_FLAT = "trim(regexp_replace(text, '[\\s\\x1c-\\x1f]+', ' ', 'g'))"
_WORDS = "trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))"


def flat():
    return F.trim(F.regexp_replace("text", r"[\s\x1c-\x1f]+", " "))


def read_back(t: Tables, name: str, content) -> DataFrame:
    """doc_id and the digest of the text that the lane's native parser finds in a file of each document."""
    lane = policy.classify_lane(F.lit(name), F.lit(""), F.octet_length("content").cast("long"))["lane"]
    made = t.documents.select("doc_id", content.alias("content")).withColumn("lane", lane)
    out = made.select("doc_id", files.parsed("lane", F.lit(name), "content").alias("out"))
    return out.select("doc_id", F.sha2(F.coalesce("out", F.lit("")), 256).alias("digest"))


#: What a file of each format holds, by its name, and the SQL of its text.
CONTENTS: dict[str, Callable[[], Column]] = {}
TEXTS: dict[str, str] = {}


def scanned(name: str, sql: str):
    """Register a query that reads a file of each document, with this name and the content that the function makes."""

    def register(content: Callable[[], Column]):
        CONTENTS[name], TEXTS[name] = content, sql

        def run(t: Tables) -> DataFrame:
            return read_back(t, name, content())

        run.__name__ = content.__name__
        query(sql)(run)
        return content

    return register


@scanned("a.md", "SELECT doc_id, sha256(CASE WHEN trim(text, ' ' || chr(10) || chr(9)) = '' THEN '' ELSE text END) AS digest FROM documents")
def scan_text() -> Column:
    return F.encode("text", "UTF-8")


@scanned("a.csv", f"SELECT doc_id, sha256('id | text' || chr(10) || doc_id || CASE WHEN {_FLAT} = '' THEN ' | ' ELSE ' | ' || {_FLAT} END) AS digest FROM documents")
def scan_csv() -> Column:
    quoted = F.concat(F.lit('id,text\r\n\r\n'), F.col("doc_id").cast("string"), F.lit(',"'), F.replace(flat(), F.lit('"'), F.lit('""')), F.lit('"\r\n'))
    return F.encode(quoted, "UTF-8")


@scanned("a.tsv", f"SELECT doc_id, sha256('id | text' || chr(10) || doc_id || ' | ' || {_FLAT}) AS digest FROM documents")
def scan_tsv() -> Column:
    return F.encode(F.concat(F.lit("id\ttext\n"), F.col("doc_id").cast("string"), F.lit('\t"'), F.replace(flat(), F.lit('"'), F.lit('""')), F.lit('"')), "UTF-8")


@scanned("a.docx", f"SELECT doc_id, sha256('Head' || CASE WHEN {_FLAT} = '' THEN '' ELSE chr(10) || {_FLAT} END) AS digest FROM documents")
def scan_docx() -> Column:
    return fixtures.docx(F.array(F.lit("Head"), F.lit(""), flat()))


@scanned("a.xlsx", f"SELECT doc_id, sha256('# Sheet: First' || chr(10) || doc_id || CASE WHEN {_FLAT} = '' THEN '' ELSE ' | ' || {_FLAT} END || ' | 7') AS digest FROM documents")
def scan_xlsx() -> Column:
    return fixtures.xlsx(F.array(F.col("doc_id").cast("string"), flat()))


@scanned("a.pptx", f"SELECT doc_id, sha256('# Slide 1' || chr(10) || 'Title' || chr(10) || chr(10) || '# Slide 2' || CASE WHEN {_FLAT} = '' THEN '' ELSE chr(10) || {_FLAT} END) AS digest FROM documents")
def scan_pptx() -> Column:
    return fixtures.pptx(F.array(F.lit("Title"), flat()))


@scanned("a.mbox", f"""SELECT doc_id, sha256(trim(array_to_string(['# Email thread: Çase', '## Message 1', 'From: a@b', '', {_FLAT}, '', '## Message 2', 'From: a@b', '', 'answer ' || doc_id], chr(10)))) AS digest FROM documents""")
def scan_mail() -> Column:
    return fixtures.mbox(F.array(flat(), F.concat(F.lit("answer "), F.col("doc_id").cast("string"))))


@scanned("a.zip", f"""WITH f AS (SELECT doc_id, {_FLAT} AS x FROM documents),
 m AS (SELECT *, CASE WHEN x = '' THEN '(refused: empty document)' ELSE '(native)' || chr(10) || x END AS shown FROM f)
SELECT doc_id, sha256(array_to_string(['# Archive: 4 members', '## Member: m0.txt (native)', doc_id::VARCHAR, '## Member: m1.txt ' || shown, '## Member: ../out.txt (refused: unsafe path)', '# Archive: 1 member', '## Member: deep.txt ' || shown], chr(10))) AS digest FROM m""")
def scan_zip() -> Column:
    return fixtures.archive(F.array(F.col("doc_id").cast("string"), flat()))


@scanned("a.pdf", f"SELECT doc_id, sha256(CASE WHEN {_WORDS} = '' THEN 'Page ' || doc_id ELSE 'Page ' || doc_id || chr(10) || {_WORDS} END) AS digest FROM documents")
def scan_pdf() -> Column:
    words = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    return fixtures.pdf(F.array(F.concat(F.lit("Page "), F.col("doc_id").cast("string")), words))


# Spark reads no empty files, which only empty texts in the first format make.
_EACH = " UNION ALL ".join(f"SELECT doc_id, digest FROM ({sql}) WHERE doc_id % {len(TEXTS)} = {k}" for k, sql in enumerate(TEXTS.values()))
_EACH = f"SELECT e.* FROM ({_EACH}) e JOIN documents d USING (doc_id) WHERE d.text <> '' OR doc_id % {len(TEXTS)} > 0"


@query(_EACH)
def scan_files(t: Tables) -> DataFrame:
    """All documents as real files, one in each of the formats in turn, in a folder that is scanned; large files are spread before they are parsed."""
    at, kinds = place(t), list(CONTENTS)
    k = F.col("doc_id") % len(kinds)
    named = lambda n: F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(n[1:])).alias("name")
    made = [t.documents.where(k == i).select(named(n), CONTENTS[n]().alias("content")) for i, n in enumerate(kinds)]
    files.write_files(reduce(DataFrame.unionByName, made), at)
    found = files.spread(files.scan(t.spark, at)).select("name", files.parsed("lane", "name", "content").alias("out"))
    doc = F.regexp_extract("name", r"^d(-?\d+)", 1).cast("long")
    return found.select(doc.alias("doc_id"), F.sha2(F.coalesce("out", F.lit("")), 256).alias("digest"))


def drained(t: Tables) -> DataFrame:
    """Files of four lanes through the drain, one of them with a model's handler."""
    kind = F.pmod("doc_id", F.lit(4))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(kind == 0, ".txt").when(kind == 1, ".png").when(kind == 2, ".docx").otherwise(".exe"))
    raw = t.documents.select(F.col("doc_id").cast("string").alias("path"), name.alias("name"), F.encode(F.lower(F.regexp_replace("text", "[^a-z ]", "x")), "UTF-8").alias("content")).where(F.octet_length("content") > 0)
    c = policy.classify_lane(F.col("name"), F.lit(""), F.octet_length("content").cast("long"))
    found = raw.withColumn("c", c).select("path", "name", "c.lane", "c.reason", "content")
    return files.drain(found, {"held-ocr": lambda name, content: F.concat(F.lit("seen "), name)})


_DRAINED = """d AS (SELECT doc_id, lower(regexp_replace(text, '[^a-z ]', 'x', 'g')) AS x FROM documents WHERE length(text) > 0),
 r AS (SELECT doc_id::VARCHAR AS path, CASE doc_id % 4 WHEN 0 THEN CASE WHEN trim(x) = '' THEN 'held' ELSE 'parsed' END WHEN 1 THEN 'OCRed' WHEN 2 THEN 'held' ELSE 'rejected' END AS status,
  CASE doc_id % 4 WHEN 0 THEN CASE WHEN trim(x) = '' THEN NULL ELSE x END WHEN 1 THEN 'seen f' || doc_id || '.png' END AS text FROM d)"""


@query(f"WITH {_DRAINED} SELECT path, status, sha256(text) AS digest FROM r")
def drain_files(t: Tables) -> DataFrame:
    return drained(t).select("path", "status", F.sha2("text", 256).alias("digest"))


@query(f"WITH {_DRAINED} SELECT status, count(*) AS n, status IN ('parsed', 'OCRed', 'rescued', 'transcribed') AS settled FROM r GROUP BY 1")
def drain_summary(t: Tables) -> DataFrame:
    """What a drain settled."""
    return drained(t).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("settled", policy.mirrored(F.col("status")))


@query(f"WITH {_DRAINED} SELECT 'docs' AS part, path, sha256(status) AS digest FROM r UNION ALL SELECT 'mirror', path, sha256(text) FROM r WHERE text IS NOT NULL")
def sink_ingest(t: Tables) -> DataFrame:
    at = place(t)
    for _ in range(2):  # the second run finds the batch's mark
        sinks.ingest_batch(drained(t), at, 1, "key")
    seen = sinks.Batches(t.spark, at)
    docs = seen.docs().select(F.lit("docs").alias("part"), "path", F.sha2("status", 256).alias("digest"))
    return docs.union(seen.mirror().select(F.lit("mirror"), "path", F.sha2("text", 256)))


@query(f"""WITH {_DRAINED} SELECT path, CASE WHEN status = 'held' AND path::BIGINT % 4 = 2 THEN 'parsed' ELSE status END AS status, CASE WHEN status = 'held' AND path::BIGINT % 4 <> 2 THEN path END AS raw_key,
 CASE WHEN status = 'held' AND path::BIGINT % 4 <> 2 THEN '2024-01-27' END AS retry_after, CASE WHEN status = 'held' AND path::BIGINT % 4 = 2 THEN 2 ELSE 1 END AS batch_id FROM r""")
def ingest_retries(t: Tables) -> DataFrame:
    """A second batch drains again the documents of one lane that the first one held, this time with a handler; a third has no mark and isn't seen."""
    at, rows = place(t), cut(drained(t), "drained")
    sinks.ingest_batch(rows, at, 1, "key", now())
    again = sinks.Batches(t.spark, at).docs().where("status = 'held' and lane = 'held-docx'").select("path", "name", "lane", "verdict", F.lit("seen").alias("text"), F.lit("model").alias("tier"))
    again = again.select("path", "name", "lane", F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("reason"), "text", "verdict", F.array().cast("array<struct<label:string,name:string>>").alias("hits"), "tier")
    sinks.ingest_batch(again, at, 2, "key", now())
    rows.limit(5).withColumn("batch_id", F.lit(3)).select("path", "name", "lane", "status", "reason", "verdict", "tier", "batch_id").write.parquet(f"{at}/docs/batch=3")
    return sinks.Batches(t.spark, at).docs().select("path", "status", "raw_key", F.date_format("retry_after", "yyyy-MM-dd").alias("retry_after"), "batch_id")


@query("""WITH d AS (SELECT doc_id::VARCHAR AS object, octet_length(encode(text)) AS n, sha256(text) AS digest FROM documents)
SELECT object, CASE WHEN n > 4000 THEN 'refused' ELSE 'stored' END AS status, CASE WHEN n > 4000 THEN NULL ELSE n END AS n_bytes, CASE WHEN n > 4000 THEN NULL ELSE digest END AS digest FROM d""")
def bounded_uploads(t: Tables) -> DataFrame:
    """Every document is uploaded in chunks of 1,000 bytes; those over 4,000 bytes are reported and leave nothing."""
    at, data = place(t), F.encode("text", "UTF-8")
    begins = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / 1000).cast("int"))
    chunks = t.documents.withColumn("data", data).select(F.col("doc_id").cast("string").alias("object"), F.explode(begins).alias("part"), "data").select("object", "part", F.expr("substring(data, part * 1000 + 1, 1000)").alias("content"))
    bounded.upload(chunks, at, 4000)
    told, kept = bounded.report(t.spark, at), bounded.stored(t.spark, at).select("object", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("n_bytes"))
    return told.select("object", "status").join(kept, "object", "left").select("object", "status", "n_bytes", "digest")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 2 = 0) = 0")
def sink_insert_ignore(t: Tables) -> DataFrame:
    at = place(t)
    least = lambda df: df.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    sinks.insert_ignore(least(t.orders.where("o_orderkey % 2 = 0")), at, ["o_custkey"])
    for _ in range(2):
        sinks.insert_ignore(least(t.orders), at, ["o_custkey"])
    return sinks.read(t.spark, at)


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def sink_upsert(t: Tables) -> DataFrame:
    at, rows = place(t), t.orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    for part in range(3):
        sinks.upsert(rows.where(F.col("o_orderkey") % 3 == part), at, ["o_custkey"], "o_orderkey")
    return sinks.read(t.spark, at)


@query("SELECT n_regionkey, count(*) AS n, sum(CASE WHEN n_regionkey = 1 THEN n_nationkey * 2 ELSE n_nationkey END)::BIGINT AS total FROM nation GROUP BY 1")
def sink_replace_partition(t: Tables) -> DataFrame:
    at, rows = place(t), t.nation.select("n_regionkey", "n_nationkey")
    sinks.replace_partition(rows, at, "n_regionkey")
    sinks.replace_partition(rows.where("n_regionkey = 1").withColumn("n_nationkey", F.col("n_nationkey") * 2), at, "n_regionkey")
    return t.spark.read.parquet(at).groupBy(F.col("n_regionkey").cast("int").alias("n_regionkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("total"))


@query("SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def sink_append(t: Tables) -> DataFrame:
    at = place(t)
    for _ in range(2):
        sinks.append(t.events.select("event_id", "event_type"), at)
    return t.spark.read.parquet(at).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '# ' || n_name AS line FROM nation")
def sink_export(t: Tables) -> DataFrame:
    at = place(t)
    sinks.export_text(t.nation.select(F.concat(F.lit("# "), "n_name").alias("body")), at)
    return t.spark.read.text(at).select(F.col("value").alias("line"))


@query("SELECT user_id, min(ts)::VARCHAR AS completed_at FROM events WHERE event_type = 'purchase' GROUP BY 1")
def stream_completions(t: Tables) -> DataFrame:
    """A stream over the event files; completions are inserted once, also when it runs again."""
    at, marks = place(t), place(t)
    first = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("at"))
    landing = place(t)
    first.select(F.col("user_id").alias("submission_id"), F.lit("complete").alias("kind"), "at").write.parquet(landing)
    for _ in range(2):
        steps = t.spark.readStream.schema(t.spark.read.parquet(landing).schema).parquet(landing)
        jobs.completions(steps, at, marks).awaitTermination()
    return sinks.read(t.spark, at).select(F.col("submission_id").alias("user_id"), F.col("completed_at").cast("string").alias("completed_at"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, ts, event_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'settle' ELSE 'round' END AS kind FROM events),
 w AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM events),
 seen AS (SELECT e.*, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM e, w WHERE epoch_ms(ts) <= mark),
 s AS (SELECT *, min(CASE WHEN kind = 'settle' THEN rn END) OVER a AS settle_rn, min(CASE WHEN kind = 'settle' THEN ts END) OVER a AS settle_ts FROM seen
       WINDOW a AS (PARTITION BY key ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 f AS (SELECT * FROM s WHERE kind = 'fail'),
 g AS (SELECT f.key, f.rn, min(n.rn) AS next_rn FROM f JOIN f n ON n.key = f.key AND n.rn > f.rn AND (n.rn > f.settle_rn OR n.ts >= f.ts + INTERVAL 90 MINUTE) GROUP BY ALL),
 h AS (SELECT key, min(rn) AS rn FROM f GROUP BY key UNION ALL SELECT g.key, g.next_rn FROM h JOIN g ON g.key = h.key AND g.rn = h.rn),
 r AS (SELECT f.key, f.ts + k * INTERVAL 30 MINUTE AS due, k AS number, settle_ts FROM h JOIN f ON f.key = h.key AND f.rn = h.rn, (SELECT unnest([1, 2, 3]) AS k)),
 c AS (SELECT key, ts AS due, row_number() OVER (PARTITION BY key ORDER BY rn) AS n FROM seen WHERE kind = 'round')
SELECT key, strftime(due, '%Y-%m-%d %H:%M:%S.%f') AS "at", 'retry' AS event, number FROM r, w WHERE (settle_ts IS NULL OR due <= settle_ts) AND epoch_ms(due) <= mark
UNION ALL SELECT key, strftime(due, '%Y-%m-%d %H:%M:%S.%f'), 'completed', 7 FROM c WHERE n = 7""")
def submission_lifecycle(t: Tables) -> DataFrame:
    """Events arrive in three parts by time, each streamed from where the last run stopped; a fourth run finds nothing new."""
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "settle").otherwise("round")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = t.events.agg(F.min(us), F.max(us)).first()
    third = F.floor((us - F.lit(low or 0)) * 3 / F.lit((high or 0) - (low or 0) + 1))
    steps = t.events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), third.alias("third"))
    landing, out, marks = place(t), place(t), place(t)
    for part in range(4):
        steps.where(F.col("third") == part).drop("third").write.mode("append").parquet(landing)
        arriving = t.spark.readStream.schema(steps.drop("third").schema).parquet(landing)
        lifecycle.run(arriving, out, marks, rounds_max=7, window="30 minutes", retries=3, late="10 minutes").awaitTermination()
    return t.spark.read.parquet(out).select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event", "number")


@query("SELECT doc_id, CEIL(length(text) / 4.0)::INT AS tokens FROM documents")
def approx_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256('&<>\"''é😀&nbsp;&#xD800; ' || text) AS digest FROM documents")
def xml_entities(t: Tables) -> DataFrame:
    marked = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    return t.documents.select("doc_id", F.sha2(text.decode_xml_entities(F.concat(F.lit("&amp;&lt;&gt;&quot;&apos;&#233;&#x1F600;&amp;nbsp;&#xD800; "), marked)), 256).alias("digest"))


@query("SELECT conv_id, turn, '<<<untrusted answer>>>' || chr(10) || text || chr(10) || '<<<end answer>>>' AS fenced FROM conversations")
def untrusted_fence(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.fenced("answer", F.col("text")).alias("fenced"))


@query("""SELECT conv_id, turn, NOT (contains(x, 'ignore previous instructions') OR contains(x, 'ignore all instructions') OR contains(x, 'system prompt') OR contains(x, 'jailbreak') OR contains(x, '[system]')) AS safe
FROM (SELECT conv_id, turn, lower(text || CASE WHEN turn % 3 = 0 THEN ' JailBreak' WHEN turn % 3 = 1 THEN ' [system' ELSE '' END) AS x FROM conversations)""")
def safe_questions(t: Tables) -> DataFrame:
    asked = F.concat("text", F.when(F.col("turn") % 3 == 0, " JailBreak").when(F.col("turn") % 3 == 1, " [system").otherwise(""))
    return t.conversations.select("conv_id", "turn", text_safe(asked).alias("safe"))


def text_safe(c):
    return policy.safe_question(c)


@query("""SELECT doc_id, CASE WHEN m LIKE 'image/%' THEN 'held-ocr' WHEN m = 'application/pdf' OR e = '.pdf' THEN 'held-pdf' WHEN e IN ('.docx', '.xlsx', '.pptx') THEN 'held-' || substring(e, 2) WHEN m = 'text/plain' THEN 'native' END AS lane
FROM (SELECT doc_id, ['image/PNG', 'application/pdf', 'text/plain', '', 'audio/mp3'][doc_id % 5 + 1] AS mime, lower(mime) AS m, ['.pdf', '.docx', '.XLSX', '.pptx', '.txt', ''][doc_id % 6 + 1] AS x, lower(x) AS e FROM documents)""")
def attachment_lanes(t: Tables) -> DataFrame:
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values)).cast("int"))
    name = F.concat("source", pick([".pdf", ".docx", ".XLSX", ".pptx", ".txt", ""]))
    return t.documents.select("doc_id", policy.attachment_lane(pick(["image/PNG", "application/pdf", "text/plain", "", "audio/mp3"]), name).alias("lane"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'category is retained by rule' WHEN h <> floor(h) THEN 'window must be whole hours' WHEN h < 1 THEN 'window is under one hour' WHEN h > 720 THEN 'window is over thirty days' END AS refusal,
 CASE WHEN h * 1000 > 0 THEN h * 1000 ELSE 86400000 END AS window_ms FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN floor(value) * 5 ELSE value END - CASE WHEN event_id % 5 = 0 THEN 40 ELSE 0 END AS h FROM events)""")
def retention_windows(t: Tables) -> DataFrame:
    h = F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("double") * 5).otherwise(F.col("value")) - F.when(F.col("event_id") % 5 == 0, 40).otherwise(0)
    return t.events.select("event_id", policy.window_refusal(h, F.col("event_type") == "view").alias("refusal"), policy.window_or_default(h * 1000).cast("double").alias("window_ms"))


@query("SELECT o_orderpriority AS report_type, o_orderstatus AS status, max(o_orderkey) AS version FROM orders GROUP BY ALL")
def latest_versions(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("report_type"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("version"))
    return consent.latest_by(rows, ["report_type", "status"], ["version"])


@query("""WITH v AS (SELECT o_orderpriority AS report_type, o_orderkey AS version, o_orderstatus AS body FROM orders), r AS (SELECT report_type, max(version) AS current_version FROM v GROUP BY 1)
SELECT r.report_type, r.current_version, v.body FROM r JOIN v ON v.report_type = r.report_type AND v.version = r.current_version""")
def current_reports(t: Tables) -> DataFrame:
    versions = t.orders.select(F.col("o_orderpriority").alias("report_type"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("body"))
    return publish.current(versions.groupBy("report_type").agg(F.max("version").alias("current_version")), versions)


@query("""WITH b AS (SELECT p_brand AS report_type, p_partkey AS ord, p_name AS body FROM part), g AS (SELECT report_type, CASE WHEN max(ord) % 3 = 0 THEN ['min-evidence'] ELSE [] END AS unmet FROM b GROUP BY 1),
 v AS (SELECT DISTINCT report_type, length(report_type) AS version FROM b WHERE ord % 2 = 0)
SELECT b.report_type, b.ord, b.body, CASE WHEN len(unmet) = 0 THEN coalesce(v.version, 0) + row_number() OVER (PARTITION BY b.report_type ORDER BY b.ord) END AS version, array_to_string(unmet, ',') AS unmet FROM b JOIN g USING (report_type) LEFT JOIN v USING (report_type)""")
def publish_versions(t: Tables) -> DataFrame:
    bodies = t.part.select(F.col("p_brand").alias("report_type"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("body"))
    gates = bodies.groupBy("report_type").agg(F.max("ord").alias("m")).select("report_type", F.when(F.col("m") % 3 == 0, F.array(F.lit("min-evidence"))).otherwise(F.array().cast("array<string>")).alias("unmet"))
    versions = bodies.where("ord % 2 = 0").select("report_type", F.length("report_type").cast("long").alias("version")).distinct()
    return publish.publish(bodies, versions, gates).select("report_type", "ord", "body", "version", F.array_join("unmet", ",").alias("unmet"))


@query("SELECT p_partkey, p_name AS topic FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 25)")
def narrowed_topics(t: Tables) -> DataFrame:
    live = t.part.select("p_partkey", F.col("p_name").alias("topic"))
    return angles.narrowed(live, t.part.where("p_size > 25").select(F.col("p_name").alias("topic")))


@query("SELECT count(*) FILTER (event_type = 'view') AS pass, count(*) FILTER (event_type = 'click') AS fail, count(*) FILTER (event_type NOT IN ('view', 'click')) AS skip FROM events")
def smoke_receipts(t: Tables) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "pass").when(F.col("event_type") == "click", "fail").otherwise("skip")
    return audit.smoke_summary(t.events.select(outcome.alias("outcome")))


@query("SELECT count(*) FILTER (doc_id % 7 = 0) AS malformed, count(*) FILTER (doc_id % 7 = 0 AND (contains(text, 'the') OR contains(text, 'secret'))) AS leaks FROM documents")
def envelope_leaks(t: Tables) -> DataFrame:
    stored = t.documents.select(F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.concat(F.lit("v1.AAAA."), F.sha2("text", 256))).alias("body_envelope"))
    return audit.leak_check(stored, "body_envelope", ["the", "secret"])


@query("SELECT 'documents' AS table_name, 'text_envelope' AS column_name UNION ALL SELECT 'pages', 'filename'")
def uncovered_columns(t: Tables) -> DataFrame:
    tables = {"documents": t.documents.withColumnRenamed("text", "text_envelope"), "pages": t.pages.withColumnRenamed("url", "filename").withColumnRenamed("html", "html_envelope")}
    return t.rows(audit.uncovered(tables, {("pages", "html_envelope")}), "table_name string, column_name string")


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def wording_digests(t: Tables) -> DataFrame:
    copy = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("copy"))
    return copy.select("conv_id", crypto.sha256_hex(F.col("copy")).alias("digest"))


@query("""SELECT event_id, attempts, status FROM (SELECT event_id, (event_id % 5)::INT AS attempts, CASE WHEN event_id % 2 = 0 THEN 'held' ELSE 'parsed' END AS status, ts FROM events)
 WHERE status = 'held' AND attempts < 3 AND ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def retries_due(t: Tables) -> DataFrame:
    held = t.events.select("event_id", (F.col("event_id") % 5).cast("int").alias("attempts"), F.when(F.col("event_id") % 2 == 0, "held").otherwise("parsed").alias("status"), F.col("ts").cast("string").alias("retry_after"))
    return jobs.retry_due(held, now()).select("event_id", "attempts", "status")


@query("""SELECT snapshot_id, error, CASE WHEN error IS NULL THEN n END AS n FROM (SELECT page_id AS snapshot_id, CASE WHEN page_id % 5 = 0 THEN 'destination refused' WHEN page_id % 3 = 0 THEN 'content type refused' END AS error, length(html) AS n FROM pages)""")
def web_snapshot_errors(t: Tables) -> DataFrame:
    url = F.when(F.col("page_id") % 5 == 0, F.lit("https://localhost/x")).otherwise(F.lit("https://example.com/x"))
    kind = F.when(F.col("page_id") % 3 == 0, "image/png").otherwise("text/plain; charset=utf-8")
    seen = files.web_snapshots(t.pages.select(F.col("page_id").alias("snapshot_id"), url.alias("url"), kind.alias("content_type"), "html"))
    return seen.select("snapshot_id", "error", F.when(F.col("error").isNull(), F.length("text").cast("long")).alias("n"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{1,5}') AS ws FROM documents)
SELECT doc_id AS media_id, sha256(array_to_string(list_transform(ws, lambda w, i: w || i), ' ')) AS digest FROM w WHERE len(ws) > 0""")
def media_transcripts(t: Tables) -> DataFrame:
    """All documents as recordings of numbered words, in chunks of 200 bytes that share 32; the model says the words that a chunk surely holds whole."""
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{1,5})"), F.lit(1)), lambda w, i: F.concat(w, (i + 1).cast("string")))
    media = t.documents.select(F.col("doc_id").alias("media_id"), words.alias("w")).where(F.size("w") > 0).select("media_id", F.encode(F.concat(F.lit("^ "), F.array_join("w", " "), F.lit(" $")), "UTF-8").alias("content"))
    whole = lambda index, part: F.regexp_replace(F.decode(part, "UTF-8"), r"^[^ ]* ?|[^ ]*$", "")
    said = files.transcribe(media, whole, 200, 32, 1 << 20)
    return said.select("media_id", F.sha2("text", 256).alias("digest"))


@query("SELECT c_custkey, c_mktsegment, ARRAY_TO_STRING(list_sort(list(o_orderkey))[1:3], ',') AS first_three FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def inherited_captures(t: Tables) -> DataFrame:
    """A parent's captures copied to its children, here the first three of each."""
    captures = t.orders.select(F.col("o_custkey").alias("submission_id"), "o_orderkey")
    children = t.customer.select(F.col("c_custkey").alias("parent_id"), "c_custkey", "c_mktsegment")
    place = F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderkey"))
    first = consent.inherit(captures, children).withColumn("place", place).where("place <= 3")
    return first.groupBy("c_custkey", "c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("first_three"))




_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(f"""WITH q AS (SELECT DISTINCT 'extract' AS kind, url AS request FROM pages UNION SELECT 'extract', 'http://nowhere.example.com/' UNION SELECT DISTINCT 'search', {_HOST} FROM pages),
 s AS (SELECT *, {_HOST} AS key, page_id % 3 = 0 AS first FROM pages WHERE html <> ''),
 n AS (SELECT kind, request, kind = 'extract' AND contains(request, '/fr/') AS down1, kind = 'extract' AND contains(request, '=2') AS down2,
   CASE kind WHEN 'extract' THEN (SELECT min(sha256(url || html)) FROM s WHERE s.url = q.request AND first AND html = (SELECT min(html) FROM s x WHERE x.url = s.url AND x.first)) END AS own1,
   CASE kind WHEN 'extract' THEN (SELECT min(sha256(url || html)) FROM s WHERE s.url = q.request AND NOT first AND html = (SELECT min(html) FROM s x WHERE x.url = s.url AND NOT x.first)) END AS own2,
   (SELECT least(count(*), 10) FROM s WHERE s.key = q.request AND first) AS hits FROM q)
SELECT kind, request, CASE WHEN kind = 'search' THEN 'one' WHEN NOT down1 AND own1 IS NOT NULL THEN 'one' WHEN NOT down2 AND own2 IS NOT NULL THEN 'two' END AS provider,
 CASE WHEN kind = 'search' THEN CASE WHEN hits > 0 THEN 'found' ELSE 'empty' END WHEN (NOT down1 AND own1 IS NOT NULL) OR (NOT down2 AND own2 IS NOT NULL) THEN 'found' WHEN down1 AND down2 THEN 'failed' ELSE 'missed' END AS outcome,
 CASE WHEN kind = 'search' THEN hits WHEN (NOT down1 AND own1 IS NOT NULL) OR (NOT down2 AND own2 IS NOT NULL) THEN 1 ELSE 0 END AS n_leads,
 CASE WHEN kind = 'extract' THEN CASE WHEN NOT down1 AND own1 IS NOT NULL THEN own1 WHEN NOT down2 AND own2 IS NOT NULL THEN own2 END END AS digest FROM n""")
def search_leads(t: Tables) -> DataFrame:
    """Every page's URL and host asked of three providers, whose stores Spark writes from the pages: one lacks its secret, the others fail on some URLs and share the pages."""
    key = F.regexp_extract("url", "^https?://([^/]+)", 1)
    at, own = place(t), t.pages.select("page_id", key.alias("key"), "url", F.lit("").alias("title"), F.col("html").alias("text"))
    for name, part in (("one", own.where("page_id % 3 = 0")), ("two", own.where("page_id % 3 <> 0"))):
        # Small row groups, for a provider reads whole ones.
        part.drop("page_id").repartitionByRange("url").sortWithinPartitions("url").write.option("parquet.block.size", 4 << 20).parquet(f"{at}/{name}")
    asked = t.pages.select(F.lit("extract").alias("kind"), F.col("url").alias("request")).union(t.pages.select(F.lit("search"), key)).union(t.pages.limit(1).select(F.lit("extract"), F.lit("http://nowhere.example.com/")))
    asked.distinct().repartitionByRange("kind", "request").sortWithinPartitions("kind", "request").write.parquet(f"{at}/requests")
    chain = [
        {"kind": "http", "label": "none", "at": "http://127.0.0.1:9", "secret": "A_SECRET_THAT_IS_NOT_SET"},
        {"kind": "store", "label": "one", "at": f"{at}/one", "refuses": "/fr/"}, {"kind": "store", "label": "two", "at": f"{at}/two", "refuses": "=2"},
    ]
    found = leads.leads(t.spark, f"{at}/requests", chain)
    return found.groupBy("kind", "request", "provider", "outcome").agg(F.count("place").alias("n_leads"), F.min(F.when(F.col("kind") == "extract", F.sha2(F.concat("url", "text"), 256))).alias("digest"))


@query("SELECT doc_id, substring(text || '+', 1, 256) AS decoded, substring('%zz' || text, 1, 256) AS raw FROM documents")
def header_names(t: Tables) -> DataFrame:
    """F37 over all texts as names: encoded ones, and ones whose encoding is broken."""
    encoded = F.concat(F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20")), F.lit("+"))
    return t.documents.select("doc_id", text.file_name(encoded).alias("decoded"), text.file_name(F.concat(F.lit("%zz"), "text")).alias("raw"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN false ELSE true END AS unsafe FROM pages""")
def unsafe_paths(t: Tables) -> DataFrame:
    """P20 over all pages' URLs as members of an archive, three in four with what leads out of it."""
    inner = F.regexp_replace("url", "^https?://", "")
    path = F.when(F.col("page_id") % 4 == 0, inner).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/"), inner)).when(F.col("page_id") % 4 == 2, F.concat(inner, F.lit("/../x"))).otherwise(F.concat(F.lit("C:"), inner))
    return t.pages.select("page_id", policy.unsafe_path(path).alias("unsafe"))


@query("SELECT conv_id, turn, sha256('sensitive-consent-v1' || chr(10) || text) AS digest FROM conversations")
def consent_wording_digests(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", crypto.consent_wording_digest(F.col("text")).alias("digest"))


@query("""SELECT conv_id, count(*) AS lines, sha256(string_agg(turn || ' ' || trim(regexp_replace(text, '[\\s\\x1c-\\x1f]+', ' ', 'g')), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def report_exports(t: Tables) -> DataFrame:
    """A text file for each conversation, read back."""
    at = place(t)
    sinks.export_reports(t.conversations.select("conv_id", "turn", F.concat(F.col("turn").cast("string"), F.lit(" "), flat()).alias("body")), at, "conv_id", "turn")
    lines = t.spark.read.schema("value string, conv_id long").text(at).select("conv_id", F.struct(F.substring_index("value", " ", 1).cast("int").alias("turn"), "value").alias("l"))
    return lines.groupBy("conv_id").agg(F.count(F.lit(1)).alias("lines"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda l: l["value"]), "\n"), 256).alias("digest"))


def ddl_of(t: Tables) -> DataFrame:
    """A statement for each document, with its text in comments, in a string and in names."""
    quoted = lambda c, mark: F.replace(c, F.lit(mark), F.lit(mark * 2))
    k = (F.col("doc_id") % 5).cast("string")
    ddl = F.concat(
        F.lit("-- CREATE TABLE none (a_envelope TEXT)\nCREATE TABLE IF NOT EXISTS main.\"t"), F.col("doc_id").cast("string"), F.lit('" (\n id INTEGER PRIMARY KEY, -- '), F.regexp_replace("text", r"[\r\n]", " "),
        F.lit("\n w"), k, F.lit("_envelope TEXT NOT NULL DEFAULT '"), quoted(F.col("text"), "'"), F.lit("',\n filename TEXT /* "), F.replace("text", F.lit("*/"), F.lit("")), F.lit(" */,\n note TEXT CHECK (length(note) IN (1, 2), 'x, y_envelope TEXT'), \""),
        quoted(F.substring("text", 1, 40), '"'), F.lit('_envelope" BLOB,\n FOREIGN KEY (id) REFERENCES other(b_envelope), UNIQUE (filename, note)\n);'),
    )
    return t.documents.select("doc_id", ddl.alias("ddl"))


_SEALED = """s AS (SELECT 't' || doc_id AS table_name, unnest(['w' || (doc_id % 5) || '_envelope', 'filename', substring(text, 1, 40) || '_envelope']) AS column_name, doc_id FROM documents)"""


@query(f"WITH {_SEALED} SELECT DISTINCT table_name, column_name FROM s")
def sealed_by_ddl(t: Tables) -> DataFrame:
    return audit.sealed_by_ddl(ddl_of(t))


@query(f"WITH {_SEALED} SELECT DISTINCT table_name, column_name FROM s WHERE NOT (column_name = 'filename' OR doc_id % 2 = 0)")
def uncovered_by_ddl(t: Tables) -> DataFrame:
    """The audit has rows of all file names, and of every column of every second table."""
    sealed = audit.sealed_by_ddl(ddl_of(t))
    audited = sealed.where((F.col("column_name") == "filename") | (F.substring("table_name", 2, 20).cast("long") % 2 == 0))
    return audit.uncovered_by(ddl_of(t), audited)
