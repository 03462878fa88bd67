"""Lane, gate, schedule, retention and destination policies as Column expressions; P1 to P7, P10 to P16, P18 to P20, P26, F26, F28."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
MAX_DOC_BYTES = 25 << 20
# Statuses whose text is in the mirror, lanes by file extension, and what a lane waits for.
MIRRORED = ("parsed", "OCRed", "rescued", "transcribed")
EXTENSIONS = {
    "native": (".txt", ".md", ".markdown", ".csv", ".tsv"), "held-pdf": (".pdf",), "held-docx": (".docx",), "held-xlsx": (".xlsx",), "held-pptx": (".pptx",),
    "held-email": (".eml", ".mbox", ".mbx"), "held-archive": (".zip",), "held-ocr": (".png", ".jpg", ".jpeg"),
    "held-audio": (".mp3", ".mpga", ".m4a", ".wav", ".aac", ".flac", ".ogg", ".oga", ".opus"), "held-video": (".mp4", ".mov", ".webm", ".mkv", ".avi", ".mpeg", ".mpg"),
}
NEEDS = {
    "held-pdf": "page render needs the model pass", "held-docx": "document parse needs the model pass", "held-xlsx": "sheet parse needs the model pass", "held-pptx": "slide walk needs the model pass",
    "held-email": "email parses natively on drain; the model pass is the fallback", "held-archive": "members parse natively on drain; the model pass is the fallback",
    "held-ocr": "vision OCR needs the model pass", "held-audio": "transcription needs the Workers AI model pass", "held-video": "transcription needs the Workers AI model pass",
}
TYPES = {"held-pdf": ("application/pdf",), "held-email": ("message/rfc822", "application/mbox"), "held-archive": ("application/zip", "application/x-zip-compressed")}
PREFIXES = {"held-ocr": "image/", "held-audio": "audio/", "held-video": "video/"}


def mirrored(status: Column) -> Column:
    """P1."""
    return status.isin(*MIRRORED)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^.]*)$", 1))


def classify_lane(name: Column, content_type: Column, size: Column) -> Column:
    """Struct of lane, why it is rejected or held, and the kind of table."""
    ext, mime = extension(name), F.lower(F.coalesce(content_type, F.lit("")))
    lane = F.when(size.isNull() | (size <= 0) | (size > MAX_DOC_BYTES), "rejected")
    for k, names in EXTENSIONS.items():
        fits = ext.isin(*names)
        if k in TYPES:
            fits = fits | mime.isin(*TYPES[k])
        if k in PREFIXES:
            fits = fits | mime.startswith(PREFIXES[k])
        lane = lane.when(fits, k)
    lane = lane.otherwise("rejected")
    reason = F.when(size.isNull() | (size <= 0), "empty document").when(size > MAX_DOC_BYTES, F.format_string(f"size %d exceeds cap {MAX_DOC_BYTES}", size)).when(
        lane == "rejected", F.concat(F.lit("unsupported type "), F.when(ext != "", ext).otherwise(mime))
    )
    for k, why in NEEDS.items():
        reason = reason.when(lane == k, why)
    return F.struct(lane.alias("lane"), reason.alias("reason"), F.when((lane == "native") & ext.isin(".csv", ".tsv"), F.substr(ext, F.lit(2))).alias("table"))


def lane_status(lane: Column) -> Column:
    """P3."""
    return F.when(lane == "native", "parsed").when(lane == "rejected", "rejected").otherwise("held")


def attachment_lane(media_type: Column, name: Column) -> Column:
    """Images, PDF and office files, and plain text."""
    ext, mime = extension(name), F.lower(F.coalesce(media_type, F.lit("")))
    return (
        F.when(mime.startswith("image/"), "held-ocr").when((mime == "application/pdf") | (ext == ".pdf"), "held-pdf").when(ext == ".docx", "held-docx")
        .when(ext == ".xlsx", "held-xlsx").when(ext == ".pptx", "held-pptx").when(mime == "text/plain", "native")
    )


def is_recording(lane: Column) -> Column:
    """P5."""
    return lane.isin("held-audio", "held-video")


def drain_handler(status: Column, lane: Column) -> Column:
    """The handler of a held document, null for others."""
    known = [k for k in EXTENSIONS if k != "native"]
    return F.when((status == "held") & lane.isin(*known), F.substr(lane, F.lit(6)))


def _private_v4(a: Column, b: Column) -> Column:
    return (
        a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & b.isin(0, 168)) | ((a == 198) & b.isin(18, 19)) | (a >= 224)
    )


def destination_allowed(url: Column) -> Column:
    """Https, no user, a public host. IPv6 literals are allowed only in the global range 2000::/3."""
    u = F.trim(url)
    secure = u.rlike(r"(?i)^https://[^/?#\s]+")
    authority = F.regexp_extract(u, r"(?i)^https://([^/?#\s]*)", 1)
    host = F.lower(F.regexp_replace(authority, r":\d*$", ""))
    six = host.rlike(r"^\[2[0-9a-f]{3}:[0-9a-f:.]*\]$|^\[3[0-9a-f]{3}:[0-9a-f:.]*\]$")
    four = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    part = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int") for k in range(1, 5)]
    good_four = four & (F.greatest(*part) <= 255)
    name = (host != "localhost") & ~host.rlike(r"\.(localhost|local|internal)$") & F.contains(host, F.lit("."))
    return F.coalesce(
        secure & ~F.contains(authority, F.lit("@"))
        & F.when(host.startswith("["), six).when(good_four, ~_private_v4(part[0], part[1])).otherwise(name & (host != "")), F.lit(False)
    )


# Literal markers that a follow-up question must not hold.
QUESTION_MARKERS = ("ignore previous instructions", "ignore all instructions", "system prompt", "jailbreak", "[system]")


def safe_question(c: Column) -> Column:
    """P18."""
    return ~F.exists(F.array(*map(F.lit, QUESTION_MARKERS)), lambda m: F.contains(F.lower(c), m))


def consented(categories: Column, decisions: Column) -> Column:
    """Every tagged category was granted; a missing decision refuses."""
    return F.forall(categories, lambda c: F.coalesce(F.try_element_at(decisions, c), F.lit(False)))


def unsafe_path(path: Column) -> Column:
    """P20."""
    return path.rlike(r"\x00|^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def flagged_status(status: Column, flags: Column) -> Column:
    """P11."""
    return F.when(F.size(flags) > 0, "held").otherwise(status)


def pages_route(has_text: Column, has_image: Column) -> Column:
    """P26, over the pages of a document (aggregates)."""
    return F.when(F.bool_and(has_text & ~has_image), "text").when(~F.bool_or(has_text), "raster").otherwise("mixed")


def unmet_gates(manual: Column, approved: Column, min_submissions: Column, min_evidence: Column, publish_after: Column, submissions: Column, evidence: Column, now: Column) -> Column:
    """Names of the gates that are not met, in their order."""
    return F.array_compact(F.array(
        F.when(manual & ~approved, "manual-approval"), F.when(submissions < min_submissions, "min-submissions"),
        F.when(evidence < min_evidence, "min-evidence"), F.when(now < publish_after, "publish-after"),
    ))


def due(frequency: Column, last_ms: Column, now_ms: Column, cadence_ms: Column, count: Column, last_count: Column, threshold: Column) -> Column:
    """Struct of due, reason and danger."""
    more = count - last_count
    lapsed = now_ms - F.coalesce(last_ms, F.lit(0)) >= cadence_ms
    reason = (
        F.when(frequency == "manual", "manual frequency never auto-fires")
        .when(frequency == "scheduled", F.when(lapsed, "cadence lapsed").otherwise("within cadence"))
        .when(frequency == "per-n", F.when(more >= threshold, F.format_string("threshold reached (+%d)", more)).otherwise("below threshold"))
        .otherwise(F.when(count != last_count, "new evidence since last render").otherwise("no change"))
    )
    fires = F.when(frequency == "manual", False).when(frequency == "scheduled", lapsed).when(frequency == "per-n", more >= threshold).otherwise(count != last_count)
    return F.struct(fires.alias("due"), reason.alias("reason"), ((frequency == "full-dynamic") & fires).alias("danger"))


def expiry(retry_after: Column, created_at: Column, window_ms: Column) -> Column:
    """When raw bytes expire; unreadable times count as long past."""
    made = F.try_to_timestamp(created_at)
    return F.coalesce(F.try_to_timestamp(retry_after), F.timestamp_millis(F.unix_millis(made) + window_ms), F.timestamp_millis(F.lit(0)))


def window_refusal(hours: Column, retained: Column) -> Column:
    """Why a retention window is refused, or null."""
    return (
        F.when(retained, "category is retained by rule").when(hours.isNull() | (hours != F.floor(hours)), "window must be whole hours")
        .when(hours < 1, "window is under one hour").when(hours > 720, "window is over thirty days")
    )


def window_or_default(ms: Column, default_ms: int = DAY_MS) -> Column:
    """P16."""
    return F.when(ms.isNotNull() & ~F.isnan(ms.cast("double")) & (ms > 0), ms).otherwise(F.lit(default_ms))


def breach_clock(aware: Column, now: Column, days: int = 30) -> Column:
    """deadline, days remaining (rounded up), overdue and days overdue (rounded down)."""
    deadline = aware + F.make_interval(days=F.lit(days))
    left = F.unix_millis(deadline) - F.unix_millis(now)
    over = left <= 0
    return F.struct(
        deadline.alias("deadline"), F.when(over, 0).otherwise(F.ceil(left / DAY_MS)).cast("int").alias("days_remaining"), over.alias("overdue"),
        F.when(over, F.floor(-left / DAY_MS)).otherwise(0).cast("int").alias("days_overdue"),
    )


def media_chunks(size: Column, chunk: int = 1 << 20, overlap: int = 64 << 10, most: int = 32) -> Column:
    """overlapping byte ranges that cover a recording; null where it needs more than `most`."""
    if not 0 <= overlap < chunk:
        raise ValueError("overlap must be smaller than chunk")
    step = chunk - overlap
    count = F.when(size <= 0, 0).when(size <= chunk, 1).otherwise(F.ceil((size - chunk) / step) + 1).cast("int")
    ranges = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.struct(i.alias("index"), (i.cast("long") * step).alias("start"), F.least(size, i.cast("long") * step + chunk).alias("end")))
    return F.when(count > most, None).when(count == 0, F.slice(ranges, 1, 0)).otherwise(ranges)


def drain_outcome(text: Column, error: Column, tier_status: Column) -> Column:
    """Settled status, or held with its reason."""
    failed = error.isNotNull() | (F.trim(F.coalesce(text, F.lit(""))) == "")
    return F.struct(F.when(failed, "held").otherwise(tier_status).alias("status"), F.when(error.isNotNull(), error).when(failed, "extraction produced no text").alias("reason"))
