"""The name gate, F2 to F5: capitalised names become stable pseudonyms before text is searchable.

One Arrow function per document, since labels are dealt in order of first sight. A text is cut into
name-shaped words once; labels then go to runs of them, to single ones, and to later mentions in
other case, which are looked for only where a set of the text's own words says that there are any.
Word boundaries are ASCII by default, as the gate's patterns have always had; `unicode_boundaries`
is stricter. Beyond 26 names labels go on as AA, AB, ...; markers already made are never
scrubbed again.
"""

from __future__ import annotations

import calendar
import re
import unicodedata
from collections.abc import Iterable
from itertools import pairwise

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: This library's own default list of capitalised words that are not names, by kinds of words. Deployments
#: pass their own list as `allowed`, a set of lower-case words, for instance from `allow_list`.
OWN_LIST = {
    "determiners": "a an the this that these those all any both each either every few many most neither no other some such",
    "pronouns": "i you he she it we they me him her us them my your his its our their who whom what which anyone everyone nobody someone",
    "prepositions": "about above after against at before below between by during for from in into of on onto over since through to under until with without",
    "conjunctions": "and as because but if nor or so than though when where while how why also however therefore otherwise",
    "verbs": "am are be been being can could did do does had has have is may might must shall should was were will would",
    "ordinals": "first second third fourth fifth last next previous one two three four five six seven eight nine ten",
    "headings": "abstract annex appendix article attachment chapter contents date dear draft email figure file introduction item letter list message minutes note notice page paragraph part "
    "question answer re report reply row section sheet slide source statement subject summary survey table title topic total update version",
    "adverbs": "again even here just now only please same still then there today tomorrow too very well yes yesterday not",
}
ALLOWED = frozenset(w for line in OWN_LIST.values() for w in line.split()) | frozenset(w.lower() for w in (*calendar.day_name, *(f"{d}s" for d in calendar.day_name), *calendar.month_name[1:]))

# Fixed value: the shape of a name.
WORD = r"\p{Lu}\p{Ll}*(?:['’\-]\p{L}+)+|\p{Lu}\p{Ll}+|\p{Lu}{2,}"
_ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
GATE_SCHEMA = "scrubbed string, hits array<struct<label:string,name:string>>"

#: Characters below which the classes are spelled out for the faster engine, and what else may stand in such texts.
_NEAR = 0x250
_FAR = re.compile(r"[^\u0000-\u024F\u2000-\u206F]")


def allow_list(lines: Iterable[str]) -> frozenset[str]:
    """A list of words that are not names from the lines of a deployment's file, words apart by spaces or commas."""
    return frozenset(w.lower() for line in lines for w in re.split(r"[\s,]+", line) if w)


#: A word is ordinary if it makes up this share of all words in lower case, so that there are not more than 1 / share of
#: them, and stands in lower case so many times as often as with a capital.
ORDINARY_SHARE, ORDINARY_TIMES = 1 / 200_000, 3


def ordinary_words(texts: DataFrame, column: str = "text", share: float = ORDINARY_SHARE, times: int = ORDINARY_TIMES) -> DataFrame:
    """F3 by counting: words that a corpus itself mostly writes in lower case are no names at the start of a sentence: word, lower_n, upper_n.

    Words are summed in each task before they meet. A rare word stays a candidate, so the gate errs towards labels.
    """
    words = texts.select(F.explode(F.regexp_extract_all(column, F.lit(r"(\p{Lu}?\p{Ll}+)"), F.lit(1))).alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("word", F.lower("w"))
    both = counts.groupBy("word").agg(F.sum(F.when(F.col("w") == F.col("word"), F.col("n")).otherwise(0)).alias("lower_n"), F.sum(F.when(F.col("w") != F.col("word"), F.col("n")).otherwise(0)).alias("upper_n"))
    least = counts.agg((F.sum("n") * share).alias("_least"))  # one row
    found = both.crossJoin(F.broadcast(least)).where((F.col("lower_n") >= F.greatest(F.lit(2), "_least")) & (F.col("lower_n") >= F.col("upper_n") * times))
    return found.select("word", "lower_n", "upper_n")


def allow_list_of(texts: DataFrame, column: str = "text", **options) -> frozenset[str]:
    """The own list with a corpus' ordinary words, for `allowed`; at most 1 / share words reach the driver and the tasks."""
    return ALLOWED | {r[0] for r in ordinary_words(texts, column, **options).select("word").collect()}


def label(k: int) -> str:
    """A, B, ..., Z, AA, AB, ..."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return f"[person {out}]"


def _spelled(pattern: str) -> str:
    """The pattern with its classes as lists of the characters below _NEAR."""
    near = [chr(c) for c in range(_NEAR)]
    for kind, fits in (("Lu", lambda g: g == "Lu"), ("Ll", lambda g: g == "Ll"), ("L", lambda g: g[0] == "L")):
        pattern = pattern.replace(f"\\p{{{kind}}}", "[" + "".join(c for c in near if fits(unicodedata.category(c))) + "]")
    return pattern


class Gate:
    def __init__(self, allowed=ALLOWED, unicode_boundaries: bool = False):
        self.edge, self.allowed = r"\b" if unicode_boundaries else _ASCII_EDGE, frozenset(allowed)
        quick = r"\b" if unicode_boundaries else r"(?a:\b)"
        self.word = re.compile(r"\w+" if unicode_boundaries else r"[A-Za-z0-9_]+")
        self.marked = re.compile(rf"\[person [A-Z]+\]|{self.word.pattern}")
        shape = "(?={first}){edge}(?:{word})(?:\\s+(?:{word}))*{edge}"
        self.marker = regex.compile(r"(\[person [A-Z]+\])")
        self.run, self.single = (regex.compile(rf"(?=\p{{Lu}}){self.edge}(?:{WORD}){more}{self.edge}") for more in (rf"(?:\s+(?:{WORD}))+", ""))
        self.shaped = regex.compile(shape.format(first=r"\p{Lu}", edge=self.edge, word=WORD))
        self.quick = re.compile(_spelled(shape.format(first=r"\p{Lu}", edge=quick, word=WORD)))

    def __call__(self, raw: str) -> tuple[str, list[tuple[str, str]]]:
        text = raw if raw.isascii() else regex.sub(r"\p{Cf}", "", unicodedata.normalize("NFC", raw))
        names: dict[str, str] = {}
        hits: list[tuple[str, str]] = []

        def claim(name: str) -> str:
            key = name.lower()
            if key in self.allowed:
                return name
            if key not in names:
                names[key] = label(len(names))
                hits.append((names[key], name))
            return names[key]

        def claim_run(run: str) -> str:
            return run if all(w.lower() in self.allowed for w in run.split()) else claim(run)

        # Runs of words have their labels before single words.
        found = [m.span() for m in (self.shaped if _FAR.search(text) else self.quick).finditer(text)]
        if any(a[1] == b[0] for a, b in pairwise(found)):  # what a label stands beside changes where words end
            parts = self.marker.split(self.run.sub(lambda m: claim_run(m[0]), text))
            parts[::2] = [self.single.sub(lambda m: claim(m[0]), p) for p in parts[::2]]
            return self._again(self.marker.split("".join(parts)), names, hits), hits
        runs = {k: claim_run(text[a:b]) for k, (a, b) in enumerate(found) if len(text[a:b].split()) > 1}
        parts, at = [], 0
        for k, (a, b) in enumerate(found):
            parts += (text[at:a], runs[k] if k in runs else claim(text[a:b]))
            at = b
        return self._again([*parts, text[at:]], names, hits), hits

    def _again(self, parts: list[str], names: dict[str, str], hits: list[tuple[str, str]]) -> str:
        """Later mentions in any case, longest names first. Parts are text and markers."""
        if not hits:
            return "".join(parts)
        low = "\n".join(p for p in parts if not p.startswith("[person ")).lower()
        words, out = set(self.word.findall(low)), "".join(parts)
        for name in sorted((n for _, n in hits if not self.word.fullmatch(n) and n.lower() in low), key=len, reverse=True):
            # What a marker is made of stays.
            pattern = regex.compile(rf"\[person [A-Z]+\]|{self.edge}{regex.escape(name, literal_spaces=True)}{self.edge}", regex.I)
            out = pattern.sub(lambda m: m[0] if m[0][0] == "[" else names[name.lower()], out)  # noqa: B023  used at once
        # A name that is one word lies whole inside or outside of any longer one.
        if not words.isdisjoint(names):
            out = self.marked.sub(lambda m: m[0] if m[0][0] == "[" else names.get(m[0].lower(), m[0]), out)
        return out


def quarantine(c: Column, allowed=ALLOWED, unicode_boundaries: bool = False) -> Column:
    """struct of scrubbed text and hits (label, name)."""

    @F.pandas_udf(GATE_SCHEMA)
    def run(s: pd.Series) -> pd.DataFrame:
        gate = Gate(allowed, unicode_boundaries)
        rows = [gate(t) if t is not None else (None, []) for t in s]
        return pd.DataFrame({"scrubbed": [r[0] for r in rows], "hits": [[{"label": a, "name": b} for a, b in r[1]] for r in rows]})

    return run(c)


def gate(c: Column, **options) -> Column:
    """text, verdict (clean or gated), names and hits."""
    q = quarantine(c, **options)
    return F.struct(q["scrubbed"].alias("text"), F.when(F.size(q["hits"]) > 0, "gated").otherwise("clean").alias("verdict"), F.size(q["hits"]).alias("names"), q["hits"].alias("hits"))


#: The same candidate shapes for Java's regular expressions.
JAVA_TOKEN = rf"(?=\p{{Lu}}){_ASCII_EDGE}(?:{WORD}){_ASCII_EDGE}"


def name_candidates(c: Column) -> Column:
    """all name-shaped tokens of a text, without Python."""
    return F.regexp_extract_all(c, F.lit(f"({JAVA_TOKEN})"), F.lit(1))
