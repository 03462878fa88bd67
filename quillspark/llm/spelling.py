"""Spelling variants: words that differ by one edit, grouped under the form that is far more frequent.

Two words are near if one inserted, deleted or replaced character turns one into the other. Such an edit
leaves one half of the shorter word intact, so near words stand together in a dictionary sorted forward
or in one sorted by reversed words, in the range that shares the half. Each range is a block. Blocks with
too many words are counted first and divided: what they don't share yet is halved again, and the edit
leaves one of these halves intact too. Blocks are scanned in sorted order and candidates are compared.

Defined cases: null text counts as none, a null doc_id as "". Rows that repeat count each. A text of any
length is read whole. Ties between near words go to the smallest word in code-point order. An empty table
gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, release

#: Runs of letters, once A-Z are lower case; shorter runs give no words.
LETTERS, LEAST_CHARS, LEAST_TIMES = "a-zÀ-ÿ", 7, 2
#: One run in so many loses a character.
LOSES = 31
#: How many times more frequent a form is.
TIMES_MORE = 10
#: Different words that a task holds before it hands on their counts.
HELD_WORDS = 200_000
#: Words of a block that a task reads at once; larger blocks are divided before.
BLOCK_WORDS = 4096
#: Words that are compared with each other without dividing further.
FEW = 6


def counted_runs(docs: DataFrame) -> DataFrame:
    """Distinct words with their occurrences, `word` and `n`: runs of letters, every 31st short of a character by its hash."""
    runs = re.compile(f"[{LETTERS}]{{{LEAST_CHARS},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, times = list(held.keys()), list(held.values())
            for lo in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 20_000], pa.string()), pa.array(times[lo : lo + 20_000], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # bytes.lower() touches A-Z only
                for run, times in Counter(runs.findall((text.as_py() or "").encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), begun)
                    if h % LOSES == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_CHARS:
                            continue
                    held[run] += times
                if len(held) > HELD_WORDS:
                    yield from out()
        yield from out()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def _entry(m: Column, head: Column, tail: Column, apart: Column) -> Column:
    """A place in a block: words of m or m + 1 characters that share `head` characters in front and `tail` behind; pairs that share `apart` characters in front belong to another block."""
    word = F.col("word")
    shared = F.concat(F.substring(word, F.lit(1), head), F.lit("|"), F.substring(word, F.length(word) - tail + 1, tail))
    return F.struct(*[c.cast("int").alias(name) for c, name in ((m, "m"), (head, "head"), (tail, "tail"), (apart, "apart"))], shared.alias("shared"))


BLOCK = ("m", "head", "tail", "apart", "shared")


def blocks(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """Words with the blocks in which they meet near ones; no block has more than `most` words, unless its words differ in one place only."""
    never, size = F.lit(2**30), F.length("word")
    own = []
    for m in (size, size - 1):
        half = F.floor(m / 2)
        own += [_entry(m, half, F.lit(0), never), _entry(m, F.lit(0), half, half)]
    listed = words.select("word", "n", F.explode(F.array(*own)).alias("b")).select("word", "n", "b.*").where(F.col("m") >= F.lit(LEAST_CHARS))
    done = None
    while True:
        listed = cut(listed, "spelling-blocks")
        open_ = F.col("m") - F.col("head") - F.col("tail") >= 2
        large = cut(listed.where(open_).groupBy(*BLOCK).count().where(F.col("count") > most).drop("count"), "spelling-large")
        if large.isEmpty():
            return listed if done is None else done.unionByName(listed)
        fit = listed.join(large, list(BLOCK), "left_anti")
        done = fit if done is None else done.unionByName(fit)
        half = F.floor((F.col("m") - F.col("head") - F.col("tail")) / 2)
        front = _entry(F.col("m"), F.col("head") + half, F.col("tail"), F.col("apart"))
        back = _entry(F.col("m"), F.col("head"), F.col("tail") + half, F.least(F.col("apart"), F.col("head") + half))
        listed = listed.join(large, list(BLOCK), "left_semi").select("word", "n", F.explode(F.array(front, back)).alias("b")).select("word", "n", "b.*")


def _pairs(words: list[tuple[str, int]], m: int, head: int, tail: int, apart: int) -> Iterator[tuple[str, int, str, int]]:
    """Near words of a block, each pair once."""
    half = (m - head - tail) // 2
    if len(words) <= FEW or half == 0:
        for k, (a, n_a) in enumerate(words):
            for b, n_b in words[:k]:
                short, long = (a, b) if len(a) <= len(b) else (b, a)
                if len(short) > m:  # both are the longer ones: another block has them
                    continue
                at, end = head, len(short)
                while at < end and short[at] == long[at]:
                    at += 1
                if at < apart and (short[at + 1 :] if len(short) == len(long) else short[at:]) == long[at + 1 :]:
                    yield a, n_a, b, n_b
        return
    front: dict[str, list] = {}
    back: dict[str, list] = {}
    for x in words:
        word = x[0]
        end = len(word) - tail
        front.setdefault(word[head : head + half], []).append(x)
        back.setdefault(word[end - half : end], []).append(x)
    for group in front.values():
        if len(group) > 1:
            yield from _pairs(group, m, head + half, tail, apart)
    for group in back.values():
        if len(group) > 1:
            yield from _pairs(group, m, head, tail + half, min(apart, head + half))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of every near pair, from sorted rows of blocks."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "other", "other_n"])

    found: list[tuple] = []
    for (m, head, tail, apart, _), group in groupby(rows(), key=lambda r: r[:5]):
        words = [r[5:] for r in group]
        if len(words) > 1:
            for a, n_a, b, n_b in _pairs(words, m, head, tail, apart):
                found += ((a, b, n_b), (b, a, n_a))
                if len(found) >= 20_000:
                    yield out(found)
                    found = []
    if found:
        yield out(found)


def near_words(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """Ordered pairs of near words: word, other, other_n. Each block is scanned by one task; no pair comes from two blocks."""
    listed = blocks(words, most).select(*BLOCK, "word", "n")
    return listed.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "word").mapInArrow(_scan, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root, from word and form: pointers double until none moves. A form is several times more frequent than its word, so there are no cycles."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = cut(now.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "roots")
        still = moved.where("_moved").isEmpty()
        release(now)
        now = moved.drop("_moved")
        if still:
            return now


def variants(docs: DataFrame, times_more: int = TIMES_MORE, most: int = BLOCK_WORDS) -> DataFrame:
    """word, n, n_near, form (the most frequent near word, if `times_more` as frequent at least), form_n, root (the end of the chain of forms)."""
    words = cut(counted_runs(docs), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best")
    near = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = -F.col("best.n") >= F.col("n") * times_more
    met = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "near-words")
    ends = roots(met.where("form is not null"))
    return met.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 is spelled out: a table by its rule, then one step a byte.
SQL = r"""
WITH tables AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce([k::UBIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM range(256) r(k))
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(h) // 2), lambda k: ('0x' || h[2 * k + 1 : 2 * k + 2])::UBIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a & 255, x) + 1)::BIGINT]))) AS crc
  FROM (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs), tables
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), gaps AS (
  SELECT word, n, p, substr(word, 1, p::INT - 1) AS a, substr(word, p::INT + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), fewer AS (
  SELECT DISTINCT g.word AS long, g.n AS long_n, w.word AS short, w.n AS short_n FROM gaps g JOIN words w ON w.word = g.a || g.b
), pairs AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM gaps x JOIN gaps y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT long, short, short_n FROM fewer UNION ALL SELECT short, long, long_n FROM fewer
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  WITH RECURSIVE up AS (
    SELECT word, word AS top, 0 AS step FROM formed
    UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN formed f ON f.word = up.top WHERE f.form IS NOT NULL)
  SELECT word, arg_max(top, step) AS root FROM up GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
"""
