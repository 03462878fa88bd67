"""Masked pseudo-likelihood scores from a bidirectional window network, trained in numpy.

For every place of a text the network sees the tokens on both sides and predicts the one between:
log-probabilities of all places add up to a document's score.

A token is a leaf: one of the words that the corpus has at least LEAST times (the MOST_WORDS most
frequent ones at most), or for all other words a bucket of their last characters. Leaves stand in
clusters, about as many as a cluster has leaves; the network gives a cluster, and a leaf in its
cluster, so that a place costs the root of the vocabulary. Within a bucket a word has the share of
its corpus count, so that words of one bucket aren't interchangeable; these counts grow with the corpus.

The vocabulary counts every word of the corpus, summed per task before the shuffle. Training
reads every place of every document. Documents are dealt by hash, whatever files they come from,
into shards of about SHARD tokens; each shard runs Adagrad from the same start, as often over its
places as STEPS steps need, and the weights are averaged by places read, part by part.
Only the vocabulary, the HELD most frequent words and the averaged weights, all of bounded size,
reach the driver. Other words of each document meet their counts in a join.

Defined cases: null, empty or white-space text has 0 tokens, score 0 and null per token. Rows
repeat as they come, with the same score; of words with the same count the lesser bytes come first.
An empty table gives an empty table. Without any text the network is untrained. Other columns are
ignored. Scores depend on the texts and ids of the table, not on its files or partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut

#: Occurrences that give a word a leaf of its own, leaves of words at most, buckets, and the width of the network.
LEAST, MOST_WORDS, BUCKETS, WIDTH = 400, 1000, 256, 16
SIDES = (-2, -1, 1, 2)
#: Tokens a shard, shards at most (beyond, they grow), places a step, and the steps a shard takes at least.
SHARD, SHARDS, BATCH, RATE, STEPS = 4_000_000, 4096, 8192, 0.15, 450
_SLICE = 1024  # rows of logits that stay in the processor's cache
#: Words whose shares go to the tasks.
HELD = 100_000
_PART = 512
#: Rows and bytes of text whose words are counted at once; Spark sums the counts of a task before the shuffle.
_COUNTED_ROWS, _COUNTED_BYTES = 10_000, 32 << 20
SCORE_SCHEMA = "doc_id long, n_tokens long, pll double, pll_per_token double, perplexity double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of some texts: how many each text has, the places of all in an array of the different ones, and that array."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten()
    some = pc.not_equal(words, "")  # white space at either end leaves an empty one
    lengths = np.bincount(pc.list_parent_indices(lists).filter(some).to_numpy(), minlength=len(texts))
    found = words.filter(some).dictionary_encode()
    return lengths, found.indices.to_numpy(), found.dictionary.cast(pa.binary())


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def buckets_of(words: pa.Array) -> np.ndarray:
    """The bucket of each word: CRC-32 of its last bytes, a byte of all words at a time."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in (3, 2, 1):
        has = np.diff(ends) >= k
        crc[has] = (crc[has] >> np.uint32(8)) ^ _CRC[(crc[has] ^ data[ends[1:][has] - k]) & np.uint32(255)]
    return ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int64)


class Reader:
    """Numbers of words: a held word's place in the list, and ~bucket for others."""

    def __init__(self, held: list[bytes]):
        self.held = pa.array(held, pa.binary())

    def __call__(self, words: pa.Array | list[bytes]) -> np.ndarray:
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        if not len(words):
            return np.zeros(0, np.int64)
        place = pc.index_in(words, value_set=self.held).fill_null(-1).to_numpy().astype(np.int64)
        return np.where(place >= 0, place, ~buckets_of(words))


def leaves_of(numbers: np.ndarray, vocabulary: int) -> np.ndarray:
    """Leaves of a reader's numbers, where its list is the vocabulary."""
    return np.where(numbers >= 0, numbers, vocabulary + ~numbers)


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of one place of each column; the columns are used up."""
    logits -= logits.max(0)
    own = logits[at, np.arange(len(at))]
    return own - np.log(np.exp(logits, out=logits).sum(0))


def _by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the places by small numbers, where each number begins in it, and the numbers."""
    order = np.argsort(values.astype(np.int16), kind="stable")  # of 16 bits: by counting
    ranked = values[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return order, begin, ranked[begin]


@dataclass
class Network:
    """h = tanh(sum of embeddings by side + shift); logits of clusters = top @ h + top_bias, and of a cluster's leaves = out @ h + bias."""

    sides: np.ndarray  # len(SIDES) x (leaves + 1) x WIDTH; the last token is the edge of the text
    shift: np.ndarray
    top: np.ndarray  # clusters x WIDTH
    top_bias: np.ndarray
    out: np.ndarray  # clusters x leaves of a cluster x WIDTH
    bias: np.ndarray

    @staticmethod
    def new(counts: np.ndarray, seed: int = 0) -> Network:
        """Clusters of neighbouring leaves; the biases begin as the logarithms of shares of the counts."""
        size = max(1, int(np.ceil(np.sqrt(len(counts)))))
        clusters = -(-len(counts) // size)
        full = np.full(clusters * size, 1e-6)
        full[: len(counts)] = counts + 1.0
        share, draw, f = full.reshape(clusters, size), np.random.default_rng(seed), np.float32
        of_cluster = share.sum(1)
        return Network(
            draw.normal(0, 0.1, (len(SIDES), clusters * size + 1, WIDTH)).astype(f), np.zeros(WIDTH, f), draw.normal(0, 0.1, (clusters, WIDTH)).astype(f),
            np.log(of_cluster / of_cluster.sum()).astype(f), draw.normal(0, 0.1, (clusters, size, WIDTH)).astype(f), np.log(share / of_cluster[:, None]).astype(f),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.sides, self.shift, self.top, self.top_bias, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for a in self.arrays():
            parts.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*parts)

    @property
    def edge(self) -> int:
        return self.sides.shape[1] - 1

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.shift + self.sides[0][context[:, 0]]
        for k in range(1, len(SIDES)):
            total += self.sides[k][context[:, k]]
        return np.tanh(total, out=total)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        h, out = self.hidden(context), np.empty(len(target), np.float32)
        cluster, leaf = np.divmod(target, self.bias.shape[1])
        for k in range(0, len(target), _SLICE):
            logits = self.top @ h[k : k + _SLICE].T
            logits += self.top_bias[:, None]
            out[k : k + _SLICE] = _log_share(logits, cluster[k : k + _SLICE])
        order, begin, found = _by_value(cluster)
        h, leaf, more = h[order], leaf[order], np.empty(len(target), np.float32)
        for c, a, b in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
            for k in range(a, b, _SLICE):
                mine = slice(k, min(k + _SLICE, b))
                logits = self.out[c] @ h[mine].T
                logits += self.bias[c][:, None]
                more[mine] = _log_share(logits, leaf[mine])
        out[order] += more
        return out


class Adagrad:
    def __init__(self, net: Network):
        self.net = net
        self.seen = [np.full(a.shape, 1e-3, np.float32) for a in net.arrays()]

    @staticmethod
    def _move(value: np.ndarray, seen: np.ndarray, gradient: np.ndarray) -> None:
        seen += gradient * gradient
        value -= np.float32(RATE) * gradient / np.sqrt(seen)

    @staticmethod
    def _errors(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Derivatives of the mean loss by the logits, a column a place: sums over logits then run along rows."""
        p = weights @ h.T
        p += bias[:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0) * np.float32(n)
        p[of, np.arange(len(of))] -= np.float32(1 / n)
        return p

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, len(target)
        cluster, leaf = np.divmod(target, net.bias.shape[1])
        order, begin, found = _by_value(cluster)
        context, cluster, leaf = context[order], cluster[order], leaf[order]
        h = net.hidden(context)
        back, top, top_bias = np.empty_like(h), np.zeros_like(net.top), np.zeros_like(net.top_bias)
        for k in range(0, n, _SLICE):
            p = self._errors(h[k : k + _SLICE], net.top, net.top_bias, cluster[k : k + _SLICE], n)
            back[k : k + _SLICE] = p.T @ net.top
            top += p @ h[k : k + _SLICE]
            top_bias += p.sum(1)
        for c, a, b in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), n], strict=True):
            part = h[a:b]
            p = self._errors(part, net.out[c], net.bias[c], leaf[a:b], n)
            back[a:b] += p.T @ net.out[c]
            self._move(net.out[c], self.seen[4][c], p @ part)
            self._move(net.bias[c], self.seen[5][c], p.sum(1))
        back *= 1 - h * h
        for k in range(len(SIDES)):
            # Tokens that aren't there have no derivative: only the others' rows move.
            order, begin, found = _by_value(context[:, k])
            value, seen = net.sides[k][found], self.seen[0][k][found]
            self._move(value, seen, np.add.reduceat(back[order], begin, axis=0))
            net.sides[k][found], self.seen[0][k][found] = value, seen
        for value, seen, gradient in zip((net.shift, net.top, net.top_bias), self.seen[1:4], (back.sum(0), top, top_bias), strict=True):
            self._move(value, seen, gradient)


def windows(ids: np.ndarray, edge: int) -> np.ndarray:
    """The tokens on both sides of each place."""
    reach = max(SIDES)
    padded = np.concatenate([np.full(reach, edge), ids, np.full(reach, edge)])
    return np.stack([padded[reach + s : reach + s + len(ids)] for s in SIDES], 1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows and bytes of text at most, or one longer row."""
    for batch in batches:
        ends, lo = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), dtype=np.int64), 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right"))
            hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary) and count over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, _COUNTED_ROWS, _COUNTED_BYTES):
            _, places, words = words_in(batch.column(1))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(places, minlength=len(words)), pa.int64())], ["word", "count"])

    return _texts(docs).mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def shards_of(tokens: int) -> tuple[int, int]:
    """Shards of a corpus of so many tokens, and how often each reads its places."""
    shards = min(SHARDS, max(1, -(-tokens // SHARD)))
    return shards, max(1, -(-STEPS * BATCH * shards // max(1, tokens)))


def _trained(docs: DataFrame, vocabulary: list[bytes], net: Network, tokens: int) -> tuple[Network, int]:
    """Every shard trains from `net` on all places of its documents; the average comes back, with the places read in one pass."""
    shards, passes = shards_of(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, mine = Reader(vocabulary), Network(*(a.copy() for a in net.arrays()))
        learner, held, kept, places, waiting = Adagrad(mine), [], [], 0, 0

        def learn(context: np.ndarray, target: np.ndarray) -> None:
            for k in range(0, len(target), BATCH):
                learner.step(context[k : k + BATCH], target[k : k + BATCH])
                if passes > 1:
                    kept.append((context[k : k + BATCH].astype(np.int16), target[k : k + BATCH].astype(np.int16)))

        def drain(rest: bool) -> None:
            nonlocal waiting
            context, target = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = len(target) if rest else len(target) // BATCH * BATCH
            learn(context[:whole], target[:whole])
            held[:] = [(context[whole:], target[whole:])]
            waiting = len(target) - whole

        for batch in _small(batches):
            lengths, at, words = words_in(batch.column(1))
            numbers = leaves_of(read(words), len(vocabulary))[at]
            for ids in np.split(numbers, np.cumsum(lengths)[:-1]):
                if len(ids):
                    held.append((windows(ids, mine.edge), ids))
                    waiting, places = waiting + len(ids), places + len(ids)
                    if waiting >= 8 * BATCH:
                        drain(False)
        if waiting:
            drain(True)
        for _ in range(passes - 1):
            for context, target in kept:
                learner.step(context.astype(np.int64), target.astype(np.int64))
        if places:
            flat = mine.flat().astype(np.float64)
            for k in range(0, len(flat), _PART):
                part = flat[k : k + _PART]
                yield pa.RecordBatch.from_arrays([pa.array([k // _PART], pa.int32()), pa.array([part * places], pa.list_(pa.float64())), pa.array([places], pa.int64())], ["part", "sums", "places"])

    deal = F.xxhash64("doc_id", "text")
    dealt = _texts(docs).withColumn("_at", deal).repartition(shards, "_at").sortWithinPartitions("_at", "doc_id").drop("_at")
    parts = dealt.mapInArrow(run, "part int, sums array<double>, places long").groupBy("part").applyInPandas(_averaged, "part int, means array<double>, places long")
    found = parts.toArrow().to_pylist()  # the network's weights
    if not found:
        return net, 0
    return net.filled(np.concatenate([r["means"] for r in sorted(found, key=lambda r: r["part"])])), found[0]["places"]


def _averaged(frame: pd.DataFrame) -> pd.DataFrame:
    """The mean of one part of the weights over all shards, of which there are at most SHARDS: 16 MB."""
    frame = frame.sort_values("places", kind="stable")
    places = int(frame["places"].sum())
    return pd.DataFrame({"part": frame["part"].iloc[:1], "means": [np.sum(np.stack(frame["sums"]), 0) / places], "places": [places]})


@dataclass
class Model:
    vocabulary: list[bytes]
    net: Network
    counts: DataFrame | None = None  # word and count of words in buckets
    buckets: tuple[int, ...] = ()  # occurrences by bucket


def _bucket(word: str) -> Column:
    return F.pmod(F.crc32(F.expr(f"substring({word}, greatest(1, length({word}) - 2))")), F.lit(BUCKETS)).cast("int")


def fit(docs: DataFrame) -> Model:
    """The vocabulary, the network and the counts, from the whole corpus."""
    counts = cut(count_words(docs), "words")
    top = counts.where(F.col("count") >= LEAST).orderBy(F.desc("count"), "word").limit(MOST_WORDS).collect()  # at most MOST_WORDS rows
    vocabulary = [bytes(r["word"]) for r in top]
    rest = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(bytearray(w),) for w in vocabulary], "word binary")), "word", "left_anti")
    tails = rest.groupBy(_bucket("word").alias("bucket")).agg(F.sum("count").alias("count")).collect()  # BUCKETS rows
    amounts = np.zeros(len(vocabulary) + BUCKETS)
    amounts[: len(top)] = [r["count"] for r in top]
    for r in tails:
        amounts[len(top) + r["bucket"]] = r["count"]
    net = _trained(docs, vocabulary, Network.new(amounts), int(amounts.sum()))[0]
    return Model(vocabulary, net, rest, tuple(int(x) for x in amounts[len(top) :]))


def class_scores(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Sums of log-probabilities of the leaves of some texts, some documents at a time."""
    lengths = [len(t) for t in texts]
    sums, lo = np.zeros(len(texts)), 0
    while lo < len(texts):
        hi, tokens = lo, 0
        while hi < len(texts) and (hi == lo or tokens + lengths[hi] <= 8 * BATCH):
            tokens += lengths[hi]
            hi += 1
        if tokens:
            context, target = np.concatenate([windows(t, net.edge) for t in texts[lo:hi]]), np.concatenate(texts[lo:hi])
            logp = np.concatenate([net.log_probabilities(context[k : k + 8 * BATCH], target[k : k + 8 * BATCH]) for k in range(0, len(target), 8 * BATCH)])
            sums[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), lengths[lo:hi]), logp, hi - lo)
        lo = hi
    return sums


def _within(docs: DataFrame, model: Model, held: int) -> DataFrame:
    """doc_id, n_tokens, pll of leaves, and of the words of buckets: the sum of the held ones' log shares, and the others."""
    net, vocabulary = model.net, model.vocabulary
    top = model.counts.orderBy(F.desc("count"), "word").limit(held).collect()  # `held` rows
    words = vocabulary + [bytes(r["word"]) for r in top]
    bucket = np.asarray([bucket_of(w) for w in words[len(vocabulary) :]], np.int64)
    leaf = np.concatenate([np.arange(len(vocabulary)), len(vocabulary) + bucket, [0]])  # the last one is for words not held, whose leaf isn't taken from here
    share = np.concatenate([np.zeros(len(vocabulary)), np.log(np.asarray([r["count"] for r in top], float) / np.asarray(model.buckets, float)[bucket])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(words)
        for batch in _small(batches):
            lengths, at, mine = words_in(batch.column(1))
            numbers = read(mine)
            leaves = np.where(numbers < 0, len(vocabulary) + ~numbers, leaf[np.where(numbers < 0, -1, numbers)])
            shares = np.where(numbers < 0, 0.0, share[np.where(numbers < 0, 0, numbers)]) if len(share) else np.zeros(len(numbers))
            row, ends = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths)
            near, unknown = np.bincount(row, shares[at], len(lengths)), numbers[at] < 0
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[unknown], minlength=len(lengths)))])
            far = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), mine.take(pa.array(at[unknown])))
            scores = class_scores(net, np.split(leaves[at], ends[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(scores), pa.array(near, pa.float64()), far], ["doc_id", "n_tokens", "pll", "near", "far"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, pll double, near double, far array<binary>")


def score_documents(docs: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id, n_tokens, pll, pll_per_token and perplexity of every document."""
    model = fit(docs)
    scored = cut(_within(docs, model, held).withColumn("_row", F.monotonically_increasing_id()), "scores")
    far = scored.select("_row", F.explode("far").alias("word")).groupBy("_row", "word").agg(F.count(F.lit(1)).alias("times"))
    totals = F.array(*(F.lit(float(x)) for x in model.buckets))
    terms = model.counts.select("word", F.log(F.col("count") / F.get(totals, _bucket("word"))).alias("share"))
    sums = far.join(terms, "word").groupBy("_row").agg(F.sum(F.col("times") * F.col("share")).alias("_far"))
    pll = F.col("pll") + F.col("near") + F.coalesce("_far", F.lit(0.0))
    met = scored.drop("far").join(sums, "_row", "left").select("doc_id", "n_tokens", pll.alias("pll"))
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))
    return met.select("doc_id", "n_tokens", "pll", mean.alias("pll_per_token"), F.exp(-mean).alias("perplexity"))
