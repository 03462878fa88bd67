"""Text functions as Column expressions; survey IDs F1 and F6 to F20, F31 to F34, F37, F38."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no topic.
STOP_WORDS = (
    "the a an and or of to in on for with are is was were be been by at from as it its this that these those what when how about into than then there their they you your we our us have has had do "
    "does did not no yes but all any each other some such only own same so too very can will just should now late"
).split()
# Invisible characters, and injection phrases on normalised text.
INVISIBLE = r"[­᠎​-‏ - ⁠-⁤﻿︀-️\x{e0000}-\x{e007f}]"
INJECTION_PATTERNS = (
    r"\bignore\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)?\s*instructions?\b",
    r"\bdisregard\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)?\s*instructions?\b",
    r"\b(?:system|developer)\s+prompt\b",
    r"\bjailbreak\b",
    r"\[\s*system\s*\]",
)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _where_needed(normal, c: Column) -> Column:
    """A normal form, with only those texts sent to Python that aren't ASCII, where all forms are the same."""
    return F.coalesce(normal(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def canonical(c: Column) -> Column:
    """NFC without format characters."""
    return F.regexp_replace(_where_needed(_nfc, c), r"\p{Cf}", "")


def entity_markers(c: Column) -> Column:
    """distinct person markers in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\[person [A-Za-z0-9]+\])"), F.lit(1)))


def keywords(c: Column) -> Column:
    """Words of a-z longer than three letters that aren't stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))


def topic_seeds(topic: Column) -> Column:
    """Distinct keywords of a topic, or the topic itself."""
    own = F.array_distinct(keywords(topic))
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.lower(topic)))


def snippet_for(text: Column, term: Column, before: int = 40, size: int = 120) -> Column:
    """the window round the first place of `term`, or the first `size` characters."""
    at = F.position(term, F.lower(text))
    return F.when(at == 0, F.substring(text, 1, size)).otherwise(F.substr(text, F.greatest(F.lit(1), at - before), F.lit(size)))


def first_hit(text: Column, terms: Column) -> Column:
    """The first of `terms` that the lower-cased text contains."""
    return F.get(F.filter(terms, lambda t: F.contains(F.lower(text), t)), F.lit(0))


def excerpt(text: Column, terms: Column, before: int = 60, size: int = 300) -> Column:
    """F8: the window round the first term of over three letters that occurs; trimmed."""
    # Bound by arrays of one: the text is lower-cased once, not for each term, and the terms are looked for once.
    first = lambda low: F.get(F.filter(terms, lambda t: (F.length(t) > 3) & F.contains(low, t)), F.lit(0))
    at = F.get(F.transform(F.array(F.lower(text)), lambda low: F.get(F.transform(F.array(first(low)), lambda hit: F.position(hit, low)), F.lit(0))), F.lit(0))
    return F.when(at.isNull(), F.substring(F.trim(text), 1, size)).otherwise(F.trim(F.substr(text, F.greatest(F.lit(1), at - before), F.lit(size))))


def normalise_title(c: Column) -> Column:
    """F9."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalise_topic(c: Column) -> Column:
    """compatibility form, invisible characters and white space to single spaces, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(_where_needed(_nfkc, c), INVISIBLE, " "), r"\s+", " ")), " +", " "))


def matching_form(c: Column) -> Column:
    """Lower case, invisible characters deleted, all but a-z, 0-9 and brackets to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), INVISIBLE, ""), r"[^a-z0-9\[\]]+", " "))


def injection_flags(c: Column) -> Column:
    """a flag for the first match of each injection pattern."""
    form = matching_form(c)
    found = [F.regexp_extract(form, f"({p})", 1) for p in INJECTION_PATTERNS]
    return F.array_compact(F.array(*(F.when(m != "", F.concat(F.lit("injection-marker:"), m)) for m in found)))


def suspicion_flags(claim: Column, snippets: Column) -> Column:
    """injection flags of the claim and its snippets, and `ungrounded` without any."""
    own = F.flatten(F.transform(F.concat(F.array(claim), snippets), injection_flags))
    return F.array_distinct(F.concat(own, F.when(F.size(snippets) == 0, F.array(F.lit("ungrounded"))).otherwise(F.array().cast("array<string>"))))


def approx_tokens(c: Column) -> Column:
    """F13."""
    return F.ceil(F.length(c) / 4).cast("int")


def capped(c: Column, size: int) -> Column:
    """at most `size` characters, with an ellipsis where cut."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def strip_html(c: Column) -> Column:
    """text of simple HTML."""
    out = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.regexp_replace(out, f"(?i)&{name};", char)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


@F.pandas_udf(StringType())
def decode_xml_entities(s: pd.Series) -> pd.Series:
    """F16: the five named entities and numeric references up to U+10FFFF; others stay."""
    pattern = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|amp|lt|gt|quot|apos);")

    def one(m: re.Match) -> str:
        if m[1][0] != "#":
            return html.unescape(m[0]) if m[1] != "apos" else "'"
        code = int(m[1][2:], 16) if m[1][1] in "xX" else int(m[1][1:])
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return s.map(lambda t: None if t is None else pattern.sub(one, t))


def thread_subject(c: Column) -> Column:
    """a subject without reply and forward marks."""
    bare = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*((re|fw|fwd)\s*:\s*)+", ""))
    return F.when(bare == "", F.lit("(no subject)")).otherwise(bare)


#: Characters that are a letter with marks, by their canonical decomposition, and that letter.
ACCENTED = {c: d[0] for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.category(m) == "Mn" for m in d[1:])}


def unaccented(c: Column) -> Column:
    """Letters without their marks, in lower case: what a search takes for the same."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{M}", ""), "".join(ACCENTED), "".join(ACCENTED.values()))


def query_words(terms: Column, most: int = 8) -> Column:
    """search words of some terms: a-z and 0-9 without accents, over two characters, the first `most`."""
    plain = lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), unaccented(t)).otherwise(F.lower(t))
    words = F.flatten(F.transform(terms, lambda t: F.regexp_extract_all(plain(t), F.lit("([a-z0-9]+)"), F.lit(1))))
    return F.slice(F.filter(words, lambda w: F.length(w) > 2), 1, most)


def body_citations(c: Column) -> Column:
    """`[doc: snippet]` citations in a body, but for flags."""
    marks = F.regexp_extract_all(c, F.lit(r"(\[[a-z0-9-]+: [^\[\]]+\])"), F.lit(1))
    parsed = F.transform(
        marks, lambda m: F.struct(F.regexp_extract(m, r"^\[([a-z0-9-]+): ", 1).alias("doc_id"), F.regexp_extract(m, r"^\[[a-z0-9-]+: (.*)\]$", 1).alias("snippet"))
    )
    return F.filter(parsed, lambda p: p["doc_id"] != "flagged")


def fenced(label: str, c: Column) -> Column:
    """F32: untrusted text between marks that name it."""
    return F.format_string(f"<<<untrusted {label}>>>\n%s\n<<<end {label}>>>", c)


def line_anchor(line_id: Column) -> Column:
    """F33."""
    return F.concat(F.lit("line-"), line_id)


def version_anchor(report_type: Column, version: Column) -> Column:
    """F33."""
    return F.concat(F.lit("report-"), report_type, F.lit("-v"), version.cast("string"))


def file_name(header: Column) -> Column:
    """a percent-decoded file name of at most 256 characters."""
    # A plus sign is itself in a header.
    return F.substring(F.coalesce(F.try_url_decode(F.replace(header, F.lit("+"), F.lit("%2B"))), header, F.lit("attachment")), 1, 256)


def iso_day(c: Column) -> Column:
    """F38."""
    return F.substring(c, 1, 10)
