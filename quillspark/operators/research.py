"""The live research loop and line runs with telemetry; E7, E9.

A dataflow that is iterated over the lines still running: one stored table a step, in which every active
line has asked the model once. Tools are joins: searches with the stored index, fetches with the mirror and
with web snapshots. Caps of steps, tokens and the line's own spend are folded before and after each call.
A stored step is not computed again, so a run that was stopped goes on behind its last step and no call is
paid for twice. Each step leaves one receipt, from metrics observed while its table was written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.functions import text
from quillspark.lineage import cut
from quillspark.operators import mirror as corpus
from quillspark.operators import search_index
from quillspark.streaming.jobs import memoised

#: Reply of a model to a prompt: `raw`, null where the call failed, and `tokens` as the provider reports them, null or 0 where it doesn't.
Model = Callable[[Column], Column]

ACTION = "tool string, query string, doc_id string, url string, findings string, citations array<struct<doc_id: string, snapshot_id: string, snippet: string>>"
#: Characters of a fetched document and of a fetched page that the transcript shows.
SHOWN_DOC, SHOWN_PAGE = 2000, 4000
STATE = ("line_id", "transcript", "fetched", "steps", "tokens", "spend_used", "spend_cap")


@dataclass(frozen=True)
class Caps:
    steps: int = 8
    tokens: int = 20_000
    spend: int = 20_000


def header(title: Column, rationale: Column) -> Column:
    return F.concat(
        F.lit('Research the angle "'), title, F.lit('" with the tools below, which only read. Rationale: '), F.coalesce(rationale, F.lit("")),
        F.lit('\nAnswer with one JSON object: {"tool":"search","query":""}, {"tool":"fetch","doc_id":""}, {"tool":"web_fetch","url":""} or {"tool":"final","findings":"","citations":[{"doc_id":"","snippet":""}]}. Every snippet stands word for word in what was fetched.'),
    )


def _within(c: Column, most: int) -> Column:
    return F.coalesce(F.length(c).between(1, most), F.lit(False))


def _valid(a: Column) -> Column:
    """Whether an action has a known tool and what that tool needs."""
    cited = F.forall(a["citations"], lambda c: _within(c["snippet"], 2000) & (c["doc_id"].isNull() | _within(c["doc_id"], 128)) & (c["snapshot_id"].isNull() | _within(c["snapshot_id"], 128)))
    needs = (
        F.when(a["tool"].isin("search", "web_search"), _within(a["query"], 512)).when(a["tool"] == "fetch", _within(a["doc_id"], 128))
        .when(a["tool"] == "web_fetch", _within(a["url"], 2048)).when(a["tool"] == "final", _within(a["findings"], 50_000) & F.coalesce(cited & (F.size(a["citations"]) <= 64), F.lit(False)))
    )
    return F.coalesce(needs, F.lit(False))


def _spent(used: Column, cap: Column) -> Column:
    return F.format_string("spend cap reached (%d of %d tokens)", used, cap)


def _asked(active: DataFrame, heads: DataFrame, model: Model, caps: Caps) -> DataFrame:
    """Every active line asked once, unless a cap stops it: its state after the call, the action, and `stop` with its reason."""
    ended = F.when((F.col("steps") >= caps.steps) | (F.col("tokens") >= caps.tokens), F.format_string("caps exhausted after %d step(s)", "steps")).when(F.col("spend_used") >= F.col("spend_cap"), _spent(F.col("spend_used"), F.col("spend_cap")))
    judged = active.withColumn("reason", F.when(F.col("stop").isNull(), ended).otherwise(F.col("reason"))).withColumn("stop", F.when(F.col("stop").isNull() & ended.isNotNull(), "capped").otherwise(F.col("stop")))
    nothing = F.lit(None).cast(f"struct<{ACTION}>")
    idle = judged.where("stop is not null").select(*STATE, "flags", nothing.alias("action"), "stop", "reason")
    # The model sees those only that are to call it.
    prompt = F.concat_ws("\n", F.col("head"), F.col("transcript"))
    told = judged.where("stop is null").join(heads, "line_id").withColumn("prompt", prompt).withColumn("reply", model(F.col("prompt")))
    raw, reported = F.col("reply")["raw"], F.coalesce(F.col("reply")["tokens"].cast("long"), F.lit(0).cast("long"))
    answered = raw.isNotNull()
    used = F.when(reported > 0, reported).otherwise((text.approx_tokens(F.col("prompt")) + text.approx_tokens(raw)).cast("long"))
    after = told.select(
        "line_id", "transcript", "fetched", (F.col("steps") + answered.cast("int")).alias("steps"), (F.col("tokens") + F.when(answered, used).otherwise(0)).alias("tokens"),
        (F.col("spend_used") + F.when(answered, reported).otherwise(0)).alias("spend_used"), "spend_cap", "flags", F.from_json(raw, ACTION).alias("action"), answered.alias("answered"),
    )
    over = F.col("answered") & (F.col("spend_used") >= F.col("spend_cap"))
    stop = F.when(~F.col("answered"), "failed").when(over, "capped").when(~_valid(F.col("action")), "failed").when(F.col("action.tool") == "final", "final")
    called = after.select(*STATE, "flags", "action", stop.alias("stop"), F.when(over, _spent(F.col("spend_used"), F.col("spend_cap"))).alias("reason"))
    return idle.unionByName(called)


def _acted(called: DataFrame, tools: set[str], docs: DataFrame, index: str | None, snapshots: DataFrame | None) -> DataFrame:
    """The lines that go on, with what their tool (one of `tools`) found in the transcript; a page with flags stops its line."""
    on = called.where("stop is null").select(*STATE, "flags", "action", "stop", "reason")
    tool, a = F.col("action.tool"), F.col("action")
    add = lambda df, entry, key=None: df.select(
        "line_id", F.concat("transcript", F.array(entry)).alias("transcript"), (F.array_union("fetched", F.array_compact(F.array(key))) if key is not None else F.col("fetched")).alias("fetched"),
        "steps", "tokens", "spend_used", "spend_cap", "flags", "stop", "reason",
    )

    def searched() -> DataFrame:
        asking = on.where(tool == "search")
        queries = asking.select(F.col("line_id").alias("query_id"), F.array(a["query"]).alias("terms"))
        # Stored: what goes on is read twice, by those that stop and by those that ask again.
        found = cut(search_index.search(queries, index) if index else search_index.search_unstored(queries, docs), "hits")
        shown = found.join(docs.select("doc_id", F.substring("text", 1, 400).alias("snippet")), "doc_id")
        hit = F.struct(F.col("doc_id").cast("string").alias("doc_id"), "snippet")
        hits = shown.groupBy(F.col("query_id").alias("line_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", hit.alias("hit")))), lambda h: h["hit"]).alias("hits"))
        return add(asking.join(hits, "line_id", "left"), F.concat(F.lit('search "'), a["query"], F.lit('" -> '), F.coalesce(F.to_json("hits"), F.lit("[]"))))

    def fetched() -> DataFrame:
        read = on.where(tool == "fetch").withColumn("_doc", a["doc_id"]).join(docs.select(F.col("doc_id").cast("string").alias("_doc"), "text"), "_doc", "left")
        return add(read, F.concat(F.lit("fetch "), F.col("_doc"), F.lit(" -> "), F.coalesce(F.substring("text", 1, SHOWN_DOC), F.lit("not found"))), F.when(F.col("text").isNotNull(), F.col("_doc")))

    def web_searched() -> DataFrame:
        return add(on.where(tool == "web_search"), F.concat(F.lit('web_search "'), a["query"], F.lit('" -> unavailable (no search provider configured)')))

    def web_fetched() -> DataFrame:
        web = on.where(tool == "web_fetch")
        if snapshots is None:
            return add(web, F.concat(F.lit("web_fetch "), a["url"], F.lit(" -> unavailable")))
        pages = snapshots.where("error is null").select(F.col("url").alias("_url"), F.col("snapshot_id").cast("string").alias("snapshot_id"), F.col("text").alias("page"), F.col("flags").alias("page_flags"))
        seen = web.withColumn("_url", a["url"]).join(pages, "_url", "left").withColumn("bad", F.coalesce(F.size("page_flags") > 0, F.lit(False)))
        seen = seen.withColumn("flags", F.when(F.col("bad"), F.col("page_flags")).otherwise(F.col("flags"))).withColumn("stop", F.when(F.col("bad"), "flagged"))
        seen = seen.withColumn("reason", F.when(F.col("bad"), F.concat(F.lit("fetched page carries injection markers (snapshot "), F.col("snapshot_id"), F.lit(")"))))
        body = F.concat(F.lit(" -> snapshot "), F.col("snapshot_id"), F.lit("\n"), text.fenced("web page", F.substring("page", 1, SHOWN_PAGE)))
        key = F.when(F.col("page").isNotNull(), F.concat(F.lit("snapshot:"), F.col("snapshot_id")))
        return add(seen, F.concat(F.lit("web_fetch "), a["url"], F.coalesce(body, F.lit(" -> unavailable"))), key)

    made = {"search": searched, "fetch": fetched, "web_search": web_searched, "web_fetch": web_fetched}
    return reduce(DataFrame.unionByName, [make() for name, make in made.items() if name in tools])


def live_loop(lines: DataFrame, docs: DataFrame, model: Model, folder: str, caps: Caps = Caps(), index: str | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """Outcome of each line (line_id, title, topics, rationale, exhibits, spend_cap, spend_used): kind, findings, citations, flags, reason, tier, steps, tokens, spend_used.

    `docs` is the mirror (doc_id, text, ord), `folder` a shared one that holds the steps of this run. A failed or unreadable
    reply, and findings whose snippets weren't fetched, fall back to excerpts.
    """
    spark = lines.sparkSession
    heads = lines.select("line_id", header(F.col("title"), F.col("rationale")).alias("head"))
    cap = F.when(F.col("spend_cap") > 0, F.col("spend_cap")).otherwise(caps.spend).cast("long")
    nothing = F.array().cast("array<string>")
    active = lines.select(
        "line_id", nothing.alias("transcript"), nothing.alias("fetched"), F.lit(0).alias("steps"), F.lit(0).cast("long").alias("tokens"), F.col("spend_used").cast("long").alias("spend_used"),
        cap.alias("spend_cap"), nothing.alias("flags"), F.lit(None).cast("string").alias("stop"), F.lit(None).cast("string").alias("reason"),
    )
    done = []
    for k in range(caps.steps + 1):
        called = step(spark, folder, k, lambda: _asked(active, heads, model, caps))  # noqa: B023  used at once
        done.append(called.where("stop is not null"))
        tools = {r[0] for r in called.where("stop is null").select("action.tool").distinct().collect()}  # of four
        if not tools:
            break
        active = _acted(called, tools, docs, index, snapshots)
    return _outcomes(reduce(DataFrame.unionByName, done), lines, docs, index, snapshots)


def _counted() -> list[Column]:
    """What a step's receipt says, from the step's rows."""
    of = lambda what: F.count_if(F.col("stop") == what).alias(what)
    called = F.count_if(F.col("action").isNotNull() | (F.col("stop") == "failed")).alias("called")
    return [F.count(F.lit(1)).alias("lines"), called, F.count_if(F.col("stop").isNull()).alias("going_on"), *map(of, ("capped", "failed", "final", "flagged")), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")]


RECEIPT = "lines long, called long, going_on long, capped long, failed long, final long, flagged long, tokens long"


def step(spark: SparkSession, folder: str, k: int, compute: Callable[[], DataFrame]) -> DataFrame:
    """A stored step, computed if it isn't there, and its receipt; one that lacks its receipt is counted again."""
    seen, there = Observation(), sinks.read(spark, f"{folder}/step-{k}") is not None
    found = memoised(spark, folder, f"step-{k}", lambda: compute().observe(seen, *_counted()))
    if sinks.read(spark, f"{folder}/receipts-{k}") is None:
        row = tuple(found.agg(*_counted()).first() if there else seen.get.values())
        sinks.replace(spark.createDataFrame([row], RECEIPT), f"{folder}/receipts-{k}")
    return found


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts of the steps of a run: step, and what was counted."""
    out, k = None, 0
    while (part := sinks.read(spark, f"{folder}/receipts-{k}")) is not None:
        part = part.withColumn("step", F.lit(k))
        out, k = part if out is None else out.unionByName(part), k + 1
    if out is None:
        raise ValueError(f"{folder}: no step has run")
    return out


def _outcomes(ended: DataFrame, lines: DataFrame, docs: DataFrame, index: str | None, snapshots: DataFrame | None) -> DataFrame:
    finals = ended.where("stop = 'final'")
    cited = finals.select("line_id", "fetched", F.posexplode("action.citations").alias("pos", "c")).select("line_id", "fetched", "pos", "c.*")
    own = cited.where("doc_id is not null and snapshot_id is null and array_contains(fetched, doc_id)").join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id").where(F.contains("text", "snippet"))
    held = own.select("line_id", "pos", "doc_id", F.lit(None).cast("string").alias("snapshot_id"), "snippet")
    if snapshots is not None:
        pages = snapshots.select(F.col("snapshot_id").cast("string").alias("snapshot_id"), "text")
        web = cited.where("snapshot_id is not null and doc_id is null and array_contains(fetched, concat('snapshot:', snapshot_id))").join(pages, "snapshot_id").where(F.contains("text", "snippet"))
        held = held.unionByName(web.select("line_id", "pos", F.lit(None).cast("string").alias("doc_id"), "snapshot_id", "snippet"))
    good = held.groupBy("line_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct("doc_id", "snapshot_id", "snippet").alias("c")))), lambda x: x["c"]).alias("citations"))
    met = ended.join(good, "line_id", "left").withColumn("back", (F.col("stop") == "failed") | ((F.col("stop") == "final") & F.col("citations").isNull()))
    fallen = met.where("back").select("line_id").join(lines, "line_id").select(F.col("line_id").alias("angle_id"), "title", "topics", "exhibits")
    floor = corpus.floor_research(fallen, docs, index).select(F.col("angle_id").alias("line_id"), F.col("kind").alias("_kind"), F.col("citations").alias("_citations"), F.col("flags").alias("_flags"), F.col("reason").alias("_reason"))
    own = met.join(floor, "line_id", "left")
    drafted = F.concat(F.format_string("%d exhibit(s) found: ", F.size("_citations")), F.array_join(F.transform("_citations", lambda c: F.concat(c["doc_id"], F.lit(": "), c["snippet"])), "; "))
    lifted = F.transform("_citations", lambda c: F.struct(c["doc_id"].alias("doc_id"), F.lit(None).cast("string").alias("snapshot_id"), c["snippet"].alias("snippet")))
    kind = F.when(F.col("back"), F.col("_kind")).when(F.col("stop") == "final", "findings").otherwise("held")
    none = F.array().cast("array<struct<doc_id: string, snapshot_id: string, snippet: string>>")
    return own.select(
        "line_id", kind.alias("kind"), F.when(F.col("back") & (F.col("_kind") == "findings"), drafted).when(F.col("stop") == "final", F.col("action.findings")).alias("findings"),
        F.when(F.col("back"), lifted).otherwise(F.coalesce("citations", none)).alias("citations"),
        F.when(F.col("back"), F.col("_flags")).when(F.col("stop") == "capped", F.array(F.lit("cap-exceeded"))).otherwise(F.col("flags")).alias("flags"),
        F.when(F.col("back"), F.col("_reason")).otherwise(F.col("reason")).alias("reason"), F.when(F.col("back"), "extractive-fallback").otherwise("live").alias("tier"), "steps", "tokens", "spend_used",
    )


def run_lines(lines: DataFrame, docs: DataFrame, model: Model, folder: str, **options) -> DataFrame:
    """One receipt per line (with `status`): running ones go through the loop, and what they found is checked as any finding is; others are skipped.

    Columns: line_id, status, tier, steps, n_citations, flags, reason, spend_used, outcome (what telemetry records).
    """
    running = lines.where("status = 'running'")
    out = cut(live_loop(running, docs, model, folder, **options), "outcomes")  # read three times below
    found = out.where("kind = 'findings'")
    cites = found.select("line_id", F.posexplode("citations").alias("pos", "c")).select("line_id", "pos", F.col("c.doc_id").alias("doc_id"), F.col("c.snapshot_id").alias("snapshot_id"), F.col("c.snippet").alias("snippet"))
    empty = "snapshot_id string, text string, content_sha256 string"
    snapshots = options.get("snapshots")
    snapshots = lines.sparkSession.createDataFrame([], empty) if snapshots is None else snapshots.select(F.col("snapshot_id").cast("string").alias("snapshot_id"), "text", "content_sha256")
    judged = corpus.finish_lines(
        found.join(running.select("line_id", "status", "spend_cap"), "line_id").select("line_id", "status", F.when(F.col("spend_cap") > 0, F.col("spend_cap")).otherwise(options.get("caps", Caps()).spend).alias("spend_cap"), "spend_used", "findings"),
        cites, docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), snapshots,
    ).select("line_id", "ok", "error", F.col("status").alias("_status"), F.col("flags").alias("_flags"))
    own = out.join(judged, "line_id", "left")
    status = F.when(F.col("kind") == "held", "held").when(F.col("ok"), F.col("_status")).otherwise("skipped")
    flags = F.when(F.col("kind") == "held", F.col("flags")).when(F.col("ok"), F.col("_flags")).otherwise(F.array().cast("array<string>"))
    told = F.when(F.array_contains("flags", "cap-exceeded"), "capped").when(F.col("kind") == "held", "held").otherwise(F.coalesce("error", "_status"))
    ran = own.select("line_id", status.alias("status"), "tier", "steps", F.size("citations").alias("n_citations"), flags.alias("flags"), F.coalesce("error", "reason").alias("reason"), "spend_used", told.alias("outcome"))
    skipped = lines.where("status <> 'running'").select(
        "line_id", F.lit("skipped").alias("status"), F.lit("none").alias("tier"), F.lit(0).alias("steps"), F.lit(0).alias("n_citations"), F.array().cast("array<string>").alias("flags"),
        F.concat(F.lit("line "), F.col("status")).alias("reason"), F.col("spend_used").cast("long").alias("spend_used"), F.lit(None).cast("string").alias("outcome"),
    )
    return ran.unionByName(skipped)
