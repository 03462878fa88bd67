"""Token groups of two tokenizers over one text, and how often their tokens end together.

A byte-level tokenizer (A) and a piece tokenizer (B) spell the same bytes. Each byte gets a label:
no token ends there, one of A, one of B, or both; a regular expression scans the labels and takes spans up
to each both-label, and the counts of labels in a span say which tokens make up a group. The last tokens of
a group end together and are linked; links are counted over the whole corpus by pairs of ids.

Defined cases: null and empty texts have no tokens, and neither has a text whose tokens don't spell a
space and the text (B may write a text's own U+2581 as a space). Rows repeat as they come, each counted.
Very long texts are aligned whole. An empty table gives an empty table. Other columns are ignored,
whatever their names. Strings of special tokens inside texts are plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, met_by_key
from quillspark.llm.token_counts import byte_symbols

#: Characters of texts whose words are looked up together, and words whose pieces a task remembers beyond them.
CALL_CHARS, MOST_WORDS = 1_000_000, 400_000
#: Spans whose counts are remembered, and the longest of them.
MOST_SPANS, LONG_SPAN = 200_000, 64
#: Pairs of ids that go to every task as one table: 16 bytes each, some hundred MB as Spark holds them.
MOST_PAIRS = 2_000_000

NONE, A_END, B_END, BOTH = b"\0", b"\1", b"\2", b"\3"
WORDS = re.compile(" +[^ ]*")
SPANS = re.compile(rb"[^\x03]*\x03")


class _Counts(dict):
    """Tokens of A and of B in a labelled span, as one number."""

    def __missing__(self, span: bytes) -> int:
        found = (span.count(A_END) + 1) << 32 | (span.count(B_END) + 1)
        if len(span) <= LONG_SPAN and len(self) < MOST_SPANS:
            self[span] = found
        return found


class Aligner:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(bytes_path, encoding="utf-8") as f:
            described = json.load(f)
        symbol, special = byte_symbols(), {t["content"] for t in described.get("added_tokens") or []}
        vocab = {bytes(symbol[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        # A merge of lower rank makes a token of lower id, so the ids serve as ranks.
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.spelled_a = [b""] * (max(vocab.values()) + 1)
        for data, i in vocab.items():
            self.spelled_a[i] = data
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spelled_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.asarray([len(x) for x in s], np.int64) for s in (self.spelled_a, self.spelled_b))
        self.counts, self.words = _Counts(), {}
        # Decimal ids with the sign that follows: inside a side of a group, and at its end.
        self.written = np.asarray([f"{i}{sign}" for n, end in ((len(self.spelled_a), "|"), (len(pieces), ";")) for i in range(n) for sign in (",", end)], object)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each text, None where it has no tokens."""
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= CALL_CHARS):
                chars += len(texts[hi] or "")
                hi += 1
            for text, b in zip(texts[lo:hi], self.pieces(texts[lo:hi]), strict=True):
                # A always spells what it is given.
                yield None if b is None else (np.asarray(self.a.encode_ordinary(" " + text), np.int64), np.asarray(b, np.int64))
            lo = hi

    def pieces(self, texts: list[str | None]) -> Iterator[list[int] | None]:
        """Ids of B of each text, None if they don't spell it.

        No piece goes on behind the end of a word, so words with the spaces before them are encoded by themselves,
        those that aren't remembered in one call. Where a word's pieces don't spell it the text is encoded as a whole.
        """
        words = [WORDS.findall(" " + t) if t and "▁" not in t else [] for t in texts]
        known, new = self.words, set()
        for w in words:
            new.update(w)
        if len(known) + len(new) > MOST_WORDS:
            known.clear()
        new = [w for w in new if w not in known]
        for word, ids in zip(new, self.b.encode([w[1:] for w in new], num_threads=1), strict=True):  # the library adds a space of its own
            known[word] = ids if b"".join(map(self.spelled_b.__getitem__, ids)) == word.encode() else None
        for text, own in zip(texts, words, strict=True):
            found = list(map(known.__getitem__, own))
            if not text:
                yield None
            elif own and None not in found:
                yield list(chain.from_iterable(found))
            else:
                ids = self.b.encode(text)
                yield ids if b"".join(map(self.spelled_b.__getitem__, ids)) == b" " + text.encode() else None

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A and of B each group has."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        labels = np.zeros(int(ends_a[-1]), np.uint8)
        labels[ends_a - 1] |= A_END[0]
        labels[ends_b - 1] |= B_END[0]
        found = np.fromiter(map(self.counts.__getitem__, SPANS.findall(labels.tobytes())), np.int64)
        return found >> 32, found & 0xFFFFFFFF

    def write(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> str:
        """The groups as `a1,a2|b1;a3|b2,b3`."""
        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        place_a = np.arange(len(a)) + np.repeat(upto_b - n_b, n_a)
        place_b = np.arange(len(b)) + np.repeat(upto_a, n_b)
        at = np.empty(len(a) + len(b), np.int64)
        at[place_a], at[place_b] = 2 * a, 2 * (b + len(self.spelled_a))
        at[place_a[upto_a - 1]] += 1
        at[place_b[upto_b - 1]] += 1
        return "".join(self.written[at].tolist())[:-1]


def align_documents(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """doc_id, a and b (ids), groups (how many ids of each make up a group and the bytes it spans), in scan tasks without a shuffle."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(bytes_path, pieces_path)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n_bytes", pa.int32())]))
        for batch in batches:
            for doc, ids in zip(batch.column(0), aligner.encode(batch.column(1).to_pylist()), strict=True):
                a, b, groups = [], [], []
                if ids is not None:
                    n_a, n_b = aligner.groups(*ids)
                    size = np.add.reduceat(aligner.sizes_a[ids[0]], np.cumsum(n_a) - n_a)
                    a, b, groups = ids[0], ids[1], [{"a": x, "b": y, "n_bytes": z} for x, y, z in zip(n_a.tolist(), n_b.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([a], pa.list_(pa.int32())), pa.array([b], pa.list_(pa.int32())), pa.array([groups], kind)], ["doc_id", "a", "b", "groups"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(aligned, "doc_id long, a array<int>, b array<int>, groups array<struct<a: int, b: int, n_bytes: int>>")


def linked_documents(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """A row per document with its counts, the digest of its groups, and its links: pairs (A id * size of B + B id) and how often each."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(bytes_path, pieces_path), TaskContext.get().partitionId() << 33
        width = len(aligner.spelled_b)
        for batch in batches:
            out, pairs, times = [], [], []
            for ids in aligner.encode(batch.column(1).to_pylist()):
                if ids is None:
                    out.append((row, 0, 0, 0, ""))
                    pairs.append(None)
                    times.append(None)
                else:
                    n_a, n_b = aligner.groups(*ids)
                    digest = hashlib.sha256(aligner.write(*ids, n_a, n_b).encode()).hexdigest()
                    found, many = np.unique(ids[0][np.cumsum(n_a) - 1] * width + ids[1][np.cumsum(n_b) - 1], return_counts=True)
                    out.append((row, len(ids[0]), len(ids[1]), len(n_a), digest))
                    pairs.append(found.astype(np.int32))
                    times.append(many.astype(np.int32))
                row += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int64()] * 4 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(pairs, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(linked, "doc_id long, row long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>")


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """pair, n (links of the corpus that hold it) and best (whether no pair with its B id has more)."""
    links = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    most = counts.groupBy((F.col("pair") % width).alias("_b")).agg(F.max("n").alias("_most"))
    return counts.join(most, F.col("pair") % width == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def alignment(docs: DataFrame, bytes_path: str, pieces_path: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Documents with their groups and links: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are tokenized once; a document's links are written as its different pairs. Counts of pairs are
    summed in each task before they meet. They go back to the documents as a table in every task, if it is
    counted to be small, else by a join on the pair, whose frequent pairs go to every task.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=pieces_path).get_piece_size()
    linked = cut(linked_documents(docs, bytes_path, pieces_path), "linked")
    counts = cut(pair_counts(linked, width), "pair-counts")
    links = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    found = counts.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")).first()
    if found["pairs"] <= most_pairs:
        met = links.join(F.broadcast(counts), "pair")
    else:
        met = met_by_key(links, counts, "pair", "n", found["links"])
    sums = met.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return linked.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
