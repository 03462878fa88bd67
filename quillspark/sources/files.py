"""Files by lane: scan, classify, parse, drain; S1 to S12, D8 to D11."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.functions import names, policy, text
from quillspark.lineage import cut
from quillspark.sources import parsers, pdf
from quillspark.sources.leads import opened


def scan(spark: SparkSession, path: str, most_bytes: int = policy.MAX_DOC_BYTES) -> DataFrame:
    """Files with their lane. Lane columns come from path and length alone, so a plan that drops `content` doesn't read it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    lane = policy.classify_lane(name, F.lit(""), F.col("length"))
    return raw.withColumn("name", name).withColumn("c", lane).select("path", "name", "length", "c.lane", "c.reason", F.col("c.table").alias("table_kind"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))


def write_files(rows: DataFrame, path: str) -> None:
    """Each row (name, content) as a file below `path`, a folder that tasks can open; each file is renamed into place when it is whole."""

    def write(batches):
        where, home = opened(path)
        where.create_dir(home, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{home}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(content or b"")
                where.move(part, f"{home}/{name}")
            yield batch.select([0]).slice(0, 0)

    rows.select("name", "content").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def spread(files: DataFrame, large: int = 8 << 20) -> DataFrame:
    """Files for parsers, so that large ones don't share a task with others of the same split: they are dealt anew by path, small ones stay where they are read."""
    big = F.col("length") > large
    return files.where(~big).unionByName(files.where(big).repartition("path"))


def native_text(lane: str, name: str, data: bytes) -> str | None:
    """Text of a file by a native parser; None means that the lane needs a model, or that there is no text."""
    if lane == "native":
        raw = parsers.strict_text(data)
        kind = name.lower().rpartition(".")[2]
        out = raw if raw is None or kind not in ("csv", "tsv") else parsers.delimited_text(raw, "," if kind == "csv" else "\t")
    elif lane == "held-archive":
        out = parsers.archive_text(data, member_lane, native_text)
    else:
        read = {"held-pdf": pdf.pdf_text, "held-docx": parsers.docx_text, "held-xlsx": parsers.xlsx_text, "held-pptx": parsers.pptx_text, "held-email": parsers.email_text}.get(lane)
        out = read(data) if read else None
    return out if out and out.strip() else None


def member_lane(name: str, size: int) -> tuple[str, str | None]:
    """P2 for a member of an archive, whose name and size are all that is known."""
    dot = name.lower().rfind(".")
    ext = name.lower()[dot:] if dot >= 0 else ""
    if size <= 0 or size > policy.MAX_DOC_BYTES:
        return "rejected", "empty document" if size <= 0 else f"size {size} exceeds cap {policy.MAX_DOC_BYTES}"
    lane = next((lane for lane, known in policy.EXTENSIONS.items() if ext in known), "rejected")
    return lane, policy.NEEDS.get(lane, f"unsupported type {ext}" if lane == "rejected" else None)


@F.pandas_udf(StringType())
def parsed(lane: pd.Series, name: pd.Series, content: pd.Series) -> pd.Series:
    """D1 to D6 as a column."""
    return pd.Series([native_text(a, b, bytes(c)) if c is not None else None for a, b, c in zip(lane, name, content, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def pdf_page_texts(content: pd.Series) -> pd.Series:
    """S11."""
    return content.map(lambda c: None if c is None else pdf.pdf_pages(bytes(c)))


@F.pandas_udf(StringType())
def stitched(parts: pd.Series) -> pd.Series:
    """F29."""
    return parts.map(lambda p: None if p is None else parsers.stitch([x or "" for x in p]))


Handler = Callable[[Column, Column], Column]


def drain(files: DataFrame, handlers: dict[str, Handler] | None = None, gate_options: dict | None = None) -> DataFrame:
    """Text, gate verdict and status of each file.

    Native parsers see all files; a lane's handler (name, content to text), such as a model's, sees only those left
    without text, as a stage of its own, for Spark doesn't promise to skip a function inside a condition. The gate
    stands before anything may be searched. What gives no text is held with its reason.
    """
    names_ = ("path", "name", "lane", "reason", "text", "tier")
    read = files.repartition(F.col("path")).select("path", "name", "lane", "reason", "content", parsed("lane", "name", "content").alias("text"))
    # Stored, so that each file is parsed once, behind the shuffle; of files, what a handler will see.
    wanted = F.col("text").isNull() & F.col("lane").isin(list(handlers or {}))
    read = cut(read.withColumn("content", F.when(wanted, F.col("content"))), "parsed").withColumn("tier", F.when(F.col("text").isNotNull(), "native"))
    done = read.where("text is not null or lane = 'rejected'").select(*names_)
    rest = read.where("text is null and lane <> 'rejected'")
    for lane, handle in (handlers or {}).items():
        done = done.unionByName(rest.where(F.col("lane") == lane).withColumn("text", handle(F.col("name"), F.col("content"))).withColumn("tier", F.lit("model")).select(*names_))
        rest = rest.where(F.col("lane") != lane)
    every = done.unionByName(rest.select(*names_)).withColumn("gate", names.gate(F.coalesce("text", F.lit("")), **(gate_options or {})))
    settled = F.when(F.col("tier") == "native", "parsed").when(F.col("lane") == "held-ocr", "OCRed").when(policy.is_recording(F.col("lane")), "transcribed").otherwise("rescued")
    outcome = policy.drain_outcome(F.col("text"), F.when((F.col("lane") == "native") & F.col("text").isNull(), "not valid UTF-8 text"), settled)
    out = every.withColumn("o", F.when(F.col("lane") == "rejected", F.struct(F.lit("rejected").alias("status"), F.col("reason").alias("reason"))).otherwise(outcome))
    return out.select("path", "name", "lane", "o.status", "o.reason", F.when(policy.mirrored(F.col("o.status")), F.col("gate.text")).alias("text"), F.col("gate.verdict").alias("verdict"), F.col("gate.hits").alias("hits"), "tier")


def transcribe(media: DataFrame, model: Handler, chunk: int = 1 << 20, overlap: int = 64 << 10, most: int = 32) -> DataFrame:
    """Recordings (media_id, content) cut into overlapping chunks, each transcribed, stitched in order; never a part of one."""
    part = lambda c: F.struct(c["index"].alias("index"), F.substring(F.col("content"), c["start"].cast("int") + 1, (c["end"] - c["start"]).cast("int")).alias("part"))
    ranges = policy.media_chunks(F.octet_length("content").cast("long"), chunk, overlap, most)
    cuts = media.select("media_id", F.explode_outer(F.transform(ranges, part)).alias("c")).select("media_id", "c.index", "c.part")
    return stitch_chunks(cuts.select("media_id", "index", model(F.col("index"), F.col("part")).alias("words")))


def stitch_chunks(said: DataFrame, most: int = 16) -> DataFrame:
    """one text for the chunks of each recording (media_id, index, words): at each seam the longest run of up to `most` words that ends one chunk and begins the next is said once.

    A seam depends on the last words before it, so chunks meet their neighbours by a join and seams are found side by side,
    also those of one long recording. Where a chunk has fewer words than a seam looks at, the recording is folded in order.
    A recording of which a chunk has no words (null) has no text.
    """
    said = cut(said.select("media_id", "index", F.when(F.col("words").isNotNull(), F.filter(F.split("words", r"\s+"), lambda w: w != "")).alias("words")), "said")
    sizes = said.groupBy("media_id").agg(F.max("index").alias("last"), F.bool_or(F.col("words").isNull()).alias("lacking"))
    few = (F.col("index") < F.col("last")) & (F.coalesce(F.size("words"), F.lit(0)) < most)
    odd = said.join(sizes, "media_id").groupBy("media_id").agg(F.bool_or(few).alias("odd"), F.bool_or("lacking").alias("lacking"))
    ends = said.select("media_id", (F.col("index") + 1).alias("index"), F.transform(F.slice("words", F.greatest(F.size("words") - most + 1, F.lit(1)), F.lit(most)), F.lower).alias("before"))
    head = F.transform(F.slice("words", 1, most), F.lower)
    met = said.join(ends, ["media_id", "index"], "left").withColumn("head", head)
    widths = F.reverse(F.sequence(F.lit(0), F.least(F.size("before"), F.size("head"))))
    seam = F.filter(widths, lambda k: (k == 0) | (F.slice("before", F.size("before") - k + 1, k) == F.slice("head", F.lit(1), k)))[0]
    kept = F.when(F.col("before").isNull(), F.col("words")).otherwise(F.slice("words", seam + 1, F.size("words")))
    parts = met.select("media_id", "index", F.array_join(kept, " ").alias("part")).groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("index", "part"))).alias("parts"))
    joined = F.array_join(F.filter(F.transform("parts", lambda p: p["part"]), lambda p: p != ""), " ")
    quick = parts.join(odd.where("not odd and not lacking"), "media_id").select("media_id", joined.alias("text"))
    walked = said.join(odd.where("odd and not lacking").select("media_id"), "media_id").groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("index", F.array_join("words", " ").alias("words")))).alias("parts"))
    slow = walked.select("media_id", stitched(F.transform("parts", lambda p: p["words"])).alias("text"))
    return quick.unionByName(slow).unionByName(odd.where("lacking").select("media_id", F.lit(None).cast("string").alias("text")))


def web_snapshots(captures: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """Captured pages (snapshot_id, url, content_type, html) with text, digest, flags, or why one is refused."""
    body = F.when(F.col("content_type").startswith("text/plain"), F.col("html")).otherwise(text.strip_html(F.col("html")))
    error = (
        F.when(~policy.destination_allowed(F.col("url")), "destination refused").when(~F.lower("content_type").rlike(r"^(text/html|application/xhtml\+xml|text/plain)"), "content type refused")
        .when(F.octet_length("html") > most_bytes, "over the size cap").when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text")
    )
    out = captures.withColumn("text", body).withColumn("error", error)
    return out.select("snapshot_id", "url", "error", "text", F.sha2("text", 256).alias("content_sha256"), F.octet_length("text").alias("byte_length"), text.injection_flags(F.col("text")).alias("flags"))


def recordings_listed(documents: DataFrame, provenance: DataFrame) -> DataFrame:
    """The recordings of the corpus with what is known of their consent, nulls where nothing is."""
    own = documents.where(policy.is_recording(F.col("lane")))
    return own.join(provenance.select("doc_id", "consent_status", "recorded_by"), "doc_id", "left")


def search_chain(providers: list[Callable[[str], list | None]], query: str) -> tuple[list, int | None]:
    """The first provider that answers, an empty answer included; an error only if all fail."""
    errors = []
    for k, ask in enumerate(providers):
        try:
            answer = ask(query)
        except Exception as e:  # noqa: BLE001  any failure falls through
            errors.append(e)
            continue
        if answer is not None:
            return answer, k
    if errors and len(errors) == len(providers):
        raise errors[-1]
    return [], None
