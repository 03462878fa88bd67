"""N-gram Jaccard join by prefix filters under several global token orders.

Tokens are 64-bit hashes of word shingles. Two sets with Jaccard similarity >= t share a
token among their first n - ceil(t n) + 1 under any total order of tokens. Three orders are
used: classes of the token's hash, then document frequency (exact, or as a power of 2 or 4),
then a hash of its own for each order; behind them come frequent tokens, those of more than
FREQUENT sets. A pair is verified only if it shares a prefix token under all three, and if its
histograms, the tokens of each set counted by PARTS ranges of the hash, have enough in common: no
two sets share more tokens than the sum of the lesser counts. Tokens of the
first class are counted for all sets; those of the next only for sets whose prefix isn't full of
rare ones yet, so that a passage which many documents share brings none of them together as
long as enough of their text is their own. A token that no other set has is never joined.

Equal sets are one node, the smallest doc_id of them. Nodes meet in buckets, one for each
token of the first order's prefixes; buckets with the same members are one. A bucket of more
than BLOCK members is dealt into blocks. First each block is linked in itself. Then the members
outside the bucket's largest component, dealt into blocks of their own, meet all other blocks,
two blocks at a time, so that no task holds more than two. A result is a spanning forest of the
links in it, so groups of copies never expand into pairs.

Joins of sides that both grow with the corpus are told to be merge joins, so that plans are alike
at every size.

Shingles are compared by hash: two different ones of a pair of documents coincide with
probability below 1e-12 for documents of 1,000 words.

Defined cases: null or white-space text has an empty set, linked with nothing; its component
is its own doc_id. Text of fewer words than a shingle is one shingle. Repeated rows are equal
sets; rows with one doc_id and different texts share a node. Rows with a null doc_id are
listed and not linked. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import components, cut, met_by_key, release

#: Members of a block and the tokens of their sets (one set more at most); a task compares two blocks at most.
BLOCK, BLOCK_TOKENS = 512, 250_000
#: Bytes of places or row numbers that may go to every task.
BROADCAST_BYTES = 64 << 20
#: Blocks' worth of members whose order is settled together when a bucket is dealt.
DEAL = 16
#: Class bounds as multiples of the prefix share 1 - t.
CLASS_BOUNDS = (1.4, 2.8)
#: Sets with a token, above which it comes last in all orders.
FREQUENT = 256
#: Ranges of the hash by which the tokens of a set are counted; a power of 2.
PARTS = 64
#: Entries of a worker's cache of word hashes, and rows of text read at once.
_WORDS, _ROWS = 200_000, 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Sorted, distinct 64-bit shingle hashes of texts; ASCII letters lower-cased, words cut at ASCII white space."""

    def __init__(self, words: int):
        self.words = words
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > _WORDS:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        width = min(self.words, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(words) - width + 1, width, np.uint64)
            for k in range(width):
                out = (out ^ hashes[k : k + len(out)]) * _MIX
                out ^= out >> np.uint64(29)
            out *= _MIX2
            out ^= out >> np.uint64(32)
        return np.unique(out)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, _ROWS at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            yield batch.slice(lo, _ROWS)


def prefix_length(n, percent: int):
    """n - ceil(t n) + 1, for t in hundredths."""
    return n - -(-percent * n // 100) + 1


def class_limits(percent: int) -> list[int]:
    """Upper bounds of the first classes among the 2^64 hashes."""
    share = (100 - percent) / 100
    return [min(2**64 - 1, int(b * share * 2**64)) for b in CLASS_BOUNDS]


def histogram(h: np.ndarray) -> bytes:
    """The tokens of a set by range of their hash, as 16-bit counts; empty where one is too large for that."""
    counts = np.bincount((h.view(np.uint64) >> np.uint64(65 - PARTS.bit_length())).astype(np.int64), minlength=PARTS)
    return counts.astype("<u2").tobytes() if counts.max(initial=0) < 2**16 else b""


def shingle_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, n (set size), sig (digest of the set), m (tokens in each class), hist and toks (tokens of the first two classes, or of all where its prefix needs more)."""
    limits = [np.uint64(x) for x in class_limits(percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(words)
        for batch in _small(batches):
            n, sig, m, hist, toks = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                h = of(text)
                size, upto = len(h), [int(np.searchsorted(h, x, "right")) for x in limits]
                need = prefix_length(size, percent)
                taken = upto[1] if upto[1] >= need else size
                n.append(size)
                sig.append(xxhash.xxh3_128_digest(h.tobytes()) if size else None)
                m.append([upto[0], upto[1] - upto[0], size - upto[1]])
                hist.append(histogram(h))
                toks.append(h[:taken].view(np.int64) if size else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in toks])]).astype(np.int32)
            flat = np.concatenate(toks) if toks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(m, pa.list_(pa.int64())), pa.array(hist, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "n", "sig", "m", "hist", "toks"],
            )

    return _columns(docs).mapInArrow(run, "doc_id long, n long, sig binary, m array<long>, hist binary, toks array<long>")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _mixed(tokens: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (tokens.view(np.uint64) ^ np.uint64(seed)) * _MIX
        return (h ^ (h >> np.uint64(31))) * _MIX2


def choose_prefixes(tokens: np.ndarray, df: np.ndarray, m: np.ndarray, n: int, percent: int, frequent: int) -> list[np.ndarray]:
    """The shared tokens in the prefixes of the three orders. `tokens` are those that other sets have too, `m` all tokens by class."""
    limits = [np.uint64(x) for x in class_limits(percent)]
    kind = np.searchsorted(np.asarray(limits), tokens.view(np.uint64), "left")
    # Rare tokens of the first two classes, then frequent ones, then all of the third class.
    group = np.where(kind == 2, 4, kind + 2 * (df > frequent))
    alone = [int(m[c]) - int((kind == c).sum()) for c in range(3)]
    need = int(prefix_length(n, percent))
    room = []  # shared tokens of each group that still fit in the prefix, behind those no other set has
    for g, unshared in enumerate((alone[0], alone[1], 0, 0, alone[2])):
        shared = int((group == g).sum())
        need = max(0, need - unshared)
        room.append(min(need, shared))
        need -= room[-1]
    log = np.floor(np.log2(df)).astype(np.int64)
    orders = (df, _mixed(tokens, 1)), (log, _mixed(tokens, 2)), (log // 2, _mixed(tokens, 3))
    first = np.cumsum([0] + [int((group == g).sum()) for g in range(5)])
    out = []
    for key, salt in orders:
        ranked = np.lexsort((salt, key, group))
        out.append(tokens[np.concatenate([ranked[first[g] : first[g] + room[g]] for g in range(5)])])
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block's sets, through the products of incidence matrices."""
    count = len(sets)
    if count == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.asarray([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    place = np.cumsum(common) - 1
    kept = common[token]
    token, owner, total = place[token[kept]], owner[kept], int(common.sum())
    out = np.zeros((count, count), np.float32)
    step = max(256, min(8192, 4_000_000 // count))
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for lo in range(0, total, step):
        a, b = np.searchsorted(token, [lo, lo + step])
        matrix = np.zeros((count, min(step, total - lo)), np.float32)
        matrix[owner[a:b], token[a:b] - lo] = 1
        out += matrix @ matrix.T
    out = np.rint(out, out=out).astype(np.int64)
    out[np.arange(count), np.arange(count)] = [len(s) for s in sets]
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix: stars round the first of each tree."""
    free, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not free[root]:
            continue
        free[root], queue = False, [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & free)
            free[new] = False
            edges += [(root, k) for k in new.tolist()]
            queue += new.tolist()
    return edges


def alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, counts: np.ndarray, percent: int, step: int = 4096) -> np.ndarray:
    """Whether sets a[k] and b[k] can be similar enough by their `counts` (a row a set), which bound what they share."""
    out = np.empty(len(a), bool)
    for lo in range(0, len(a), step):
        i, j = a[lo : lo + step], b[lo : lo + step]
        out[lo : lo + step] = (100 + percent) * np.minimum(counts[i], counts[j]).sum(1, np.int64) >= percent * (n[i] + n[j])
    return out


def candidates(n: np.ndarray, prefixes: list[list[np.ndarray]], percent: int, hist: list[bytes] | None = None) -> np.ndarray:
    """Pairs of a block that pass the size filter, share a prefix token under every other order too, and have histograms that allow it."""
    maybe = 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
    np.fill_diagonal(maybe, False)
    for other in prefixes:
        if maybe.any():
            maybe &= overlaps(other) > 0
    if hist is not None and maybe.any():
        known = np.asarray([len(x) > 0 for x in hist])
        counts = np.frombuffer(b"".join(x or bytes(2 * PARTS) for x in hist), "<u2").reshape(len(hist), PARTS)
        a, b = np.nonzero(np.triu(maybe & np.logical_and.outer(known, known)))
        bad = ~alike(a, b, n, counts, percent)
        maybe[a[bad], b[bad]] = maybe[b[bad], a[bad]] = False
    return maybe


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of a block's links, on the whole sets."""
    n = np.asarray([len(s) for s in sets])
    both = overlaps(sets)
    linked = (100 + percent) * both >= percent * np.add.outer(n, n)
    np.fill_diagonal(linked, False)
    return forest(linked)


def _lists(column) -> list[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0], strict=False)]


def _by_block(rows: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """`work(block key, columns)` for each (token, block), which come sorted, one block in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in columns]
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            arrays = [c for c in batch.columns[2:]]
            values = [_lists(c) if pa.types.is_list(c.type) else c.to_pylist() for c in arrays]
            for k, mine in enumerate(keys):
                if mine != key:
                    if len(held[0]) > 1 and (out := work(key, *held)) is not None:
                        yield out
                    key, held = mine, [[] for _ in columns]
                for to, v in zip(held, values, strict=True):
                    to.append(v[k])
        if len(held[0]) > 1 and (out := work(key, *held)) is not None:
            yield out

    return rows.repartition("token", "block").sortWithinPartitions("token", "block").select("token", "block", *columns).mapInArrow(run, schema)


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (a, b) of each block's candidate pairs."""

    def work(key, docs, n, second, third, hist):
        return _edges(docs, forest(candidates(np.asarray(n), [second, third], percent, hist)))

    return _by_block(members, ["doc_id", "n", "second", "third", "hist"], work, "a long, b long")


def _edges(docs: list, edges: list[tuple[int, int]]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array([docs[a] for a, _ in edges], pa.int64()), pa.array([docs[b] for _, b in edges], pa.int64())], ["a", "b"]) if edges else None


def _links(places: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning links (a, b) of all blocks of `places` (token, block, doc_id), on whole sets made of the texts (doc_id, text).

    A text meets the list of its places once, and its set moves once to each. Where the counted places
    are few, they go to the texts, so that no text moves.
    """

    def work(key, docs, sets):
        return _edges(docs, links(sets, percent))

    places = cut(places, "places")
    per_node = places.groupBy("doc_id").agg(F.collect_set(F.struct("token", "block")).alias("at"))
    small = places.count() * 64 <= BROADCAST_BYTES  # a place takes 16 bytes, a node 8 and what holds them
    met = shingle_sets(texts.join(F.broadcast(per_node) if small else per_node.hint("merge"), "doc_id").select("doc_id", "text", "at"), words)
    return _by_block(met.withColumn("at", F.explode("at")).select("at.token", "at.block", "doc_id", "toks"), ["doc_id", "toks"], work, "a long, b long")


def _carried(places: DataFrame, payload: DataFrame) -> DataFrame:
    """Places (token, block, doc_id) with the payload of their node, which is shuffled once per node before it spreads."""
    per_node = places.groupBy("doc_id").agg(F.collect_set(F.struct("token", "block")).alias("at"))
    met = payload.join(per_node.hint("merge"), "doc_id").withColumn("at", F.explode("at"))
    return met.select("at.token", "at.block", *payload.columns)


def weight_of(n: Column) -> Column:
    """What a member of n tokens takes of a block."""
    return F.greatest(n, F.lit(-(-BLOCK_TOKENS // BLOCK)).cast("long"))


def dealt(places: DataFrame, by: list[str]) -> DataFrame:
    """`places` (`by` columns, doc_id, n: tokens, total: weight of all members of the bucket) with their `block`, and whether the bucket is `hot`.

    A block has at most BLOCK members, and but for its last one fewer than BLOCK_TOKENS tokens. A large bucket is dealt
    by hash into parts of some DEAL blocks, and each part into blocks by a running sum, so no window holds a bucket.
    """
    small = places.where(F.col("total") <= BLOCK_TOKENS).select(*by, "doc_id", F.lit(0).cast("long").alias("block"), F.lit(False).alias("hot"))
    if places.where(F.col("total") > BLOCK_TOKENS).isEmpty():
        return small
    parts = F.floor(F.col("total") / (DEAL * BLOCK_TOKENS)) + 1
    large = places.where(F.col("total") > BLOCK_TOKENS).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "doc_id"), parts)).withColumn("weight", weight_of(F.col("n")))
    before = F.sum("weight").over(Window.partitionBy(*by, "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    block = F.col("part") * F.lit(2**32) + F.floor(F.coalesce(before, F.lit(0)) / BLOCK_TOKENS)
    return small.union(large.select(*by, "doc_id", block.cast("long").alias("block"), F.lit(True).alias("hot")))


def totalled(places: DataFrame, by: list[str]) -> DataFrame:
    return places.join(places.groupBy(*by).agg(F.sum(weight_of(F.col("n"))).alias("total")), by)


def paired_blocks(known: DataFrame) -> DataFrame:
    """(token, block, doc_id) of the pairs of blocks that are still to be compared, of `known` (token, doc_id, n, component).

    Members outside the largest component of their bucket meet each other and the members in it; the latter are linked already.
    """
    sizes = known.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    sided = known.join(main, "token").select("token", "doc_id", "n", (F.col("component") != F.col("main")).alias("rest"))
    open_ones = sided.where("rest").select("token").distinct()
    sides = cut(totalled(sided.join(open_ones, "token", "left_semi"), ["token", "rest"]), "sides")
    placed = dealt(sides, ["token", "rest"]).select("token", "doc_id", F.struct("rest", "block").alias("mine"))
    blocks = placed.groupBy("token").agg(F.collect_set("mine").alias("all"))
    met = placed.join(blocks, "token")
    # A pair is named by its blocks in order; of two blocks one at least is of the rest.
    others = F.when(F.col("mine.rest"), F.col("all")).otherwise(F.filter("all", lambda b: b["rest"]))
    pair = F.explode(F.transform(others, lambda b: F.xxhash64(F.least(F.col("mine"), b), F.greatest(F.col("mine"), b))))
    return met.select("token", pair.alias("block"), "doc_id")


def _joined_in_blocks(buckets: DataFrame, label: str, compare) -> DataFrame:
    """Edges of all buckets (token, doc_id, n, total), compared by `compare(places)`, places being (token, block, doc_id).

    Blocks are compared in themselves first, then two at a time as far as their members aren't linked yet.
    """
    placed = dealt(buckets, ["token"])
    edges = cut(compare(placed.select("token", "block", "doc_id")), label)
    hot = placed.where("hot")
    if hot.isEmpty():
        return edges
    joined = components(edges)
    known = hot.select("token", "doc_id").join(buckets, ["token", "doc_id"]).join(joined, F.col("doc_id") == joined["node"], "left").select("token", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    return edges.union(cut(compare(paired_blocks(cut(known, "known"))), label))


def _of_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `table` whose number is in `rows`. Few numbers, by their count, go to every task, so that no token moves."""
    few = rows.count() * 16 <= BROADCAST_BYTES
    return table.join(F.broadcast(rows) if few else rows, "row", "left_semi")


def _shared(spread: DataFrame) -> DataFrame:
    """row and the tokens of its set that others have too, with the number of sets; of `spread` (row, token)."""
    frequency = spread.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")
    return spread.join(frequency.hint("shuffle_hash"), "token").groupBy("row").agg(F.collect_list(F.struct("token", "df")).alias("shared"))


def counted_tokens(nodes: DataFrame, percent: int, frequent: int) -> DataFrame:
    """doc_id, tag, n, m, hist and shared tokens with their frequency: of the first class, and of all in `toks` where rare ones of that don't fill a prefix."""
    of_first = F.element_at("m", 1).cast("int")
    none = F.array().cast("array<struct<token:bigint,df:int>>")
    shared = F.coalesce("shared", none)
    first = _shared(nodes.select("row", F.explode(F.slice("toks", 1, of_first)).alias("token")))
    full = of_first - F.size(F.filter(shared, lambda t: t["df"] > frequent)) >= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    met = nodes.select("row", "doc_id", "tag", "n", "m", "hist").join(first.hint("merge"), "row", "left").withColumn("shared", shared).withColumn("full", full)
    met = cut(met.where("not full or size(shared) > 0"), "counted")
    rest = _of_rows(nodes, met.where("not full").select("row")).select("row", F.explode(F.slice("toks", of_first + 1, F.size("toks"))).alias("token"))
    more = _shared(rest).withColumnRenamed("shared", "more")
    return met.join(more.hint("merge"), "row", "left").select("doc_id", "tag", "n", "m", "hist", F.concat("shared", F.coalesce("more", none)).alias("shared"))


def similarity_classes(docs: DataFrame, words: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; components of the links with similarity >= percent / 100."""
    table = shingle_table(docs, words, percent).withColumn("tag", F.hash("sig")).withColumn("row", F.monotonically_increasing_id())
    table = cut(table, "shingles")
    light = cut(table.select("row", "doc_id", "n", "sig"), "sizes")
    classes = light.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("size"))
    classes = cut(classes.select("sig", F.col("first.doc_id").alias("node"), F.col("first.row").alias("row"), "size"), "classes")
    # A node is a doc_id and a tag of its set, for a doc_id may have several texts.
    nodes = _of_rows(table.drop("sig"), classes.select("row"))
    prefixed = cut(_prefixes(counted_tokens(nodes, percent, frequent), percent, frequent).where("size(first) > 0"), "prefixes")
    release(table)

    # Buckets of the first order; of those with the same members one is enough.
    posts = prefixed.select("doc_id", (F.size("second") + F.size("third")).alias("n"), F.explode("first").alias("token")).groupBy("doc_id", "token").agg(F.sum("n").alias("n"))
    marks = posts.groupBy("token").agg(
        F.count(F.lit(1)).alias("members"), F.sum(weight_of(F.col("n"))).alias("total"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.sum(F.xxhash64(F.lit(7), "doc_id").bitwiseAND(F.lit(2**40 - 1))).alias("s")
    ).where("members > 1")
    placed = cut(posts.join(marks.groupBy("members", "total", "x", "s").agg(F.min("token").alias("token")).select("token", "total").hint("merge"), "token"), "buckets")

    # Candidates share prefix tokens under all three orders. Their components are small, and every link is
    # inside one, so that each whole set moves once, to its component.
    payload = prefixed.select("doc_id", "n", "second", "third", "hist")
    grouped = components(_joined_in_blocks(placed, "candidates", lambda places: _candidates(_carried(places, payload), percent)))
    grouped = grouped.union(grouped.select(F.col("component").alias("node"), "component").distinct())
    groups = cut(grouped.select(F.col("component").alias("token"), F.col("node").alias("doc_id")), "groups")
    release(placed, prefixed)
    texts = _columns(docs)
    repeated = light.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("n"))
    if not repeated.where("doc_id is not null and times > 1").isEmpty():  # rows that repeat would repeat their links
        texts = texts.dropDuplicates()
    sized = cut(totalled(groups.join(repeated.select("doc_id", "n"), "doc_id"), ["token"]), "groups")
    release(groups)
    joined = components(_joined_in_blocks(sized, "links", lambda places: _links(places, texts, words, percent)))
    of_class = cut(classes.join(joined, "node", "left").select("sig", "size", F.coalesce("component", "node").alias("component")), "components")
    release(sized, classes)
    alone = light.where("n = 0 or doc_id is null").select("doc_id", "n", "sig", F.lit(None).cast("long").alias("component"))
    some = light.where("n > 0 and doc_id is not null").select("doc_id", "n", "sig")
    out = met_by_key(some, of_class, "sig", "size", some.count()).select("doc_id", "n", "sig", "component").union(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _prefixes(shared: DataFrame, percent: int, frequent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())
        for batch in _small(batches):
            pairs = batch.column(5)
            flat, offsets = pairs.flatten(), pairs.offsets.to_numpy()
            tokens, df = (c.to_numpy() for c in flat.flatten())
            at = offsets - offsets[0]
            out = [choose_prefixes(tokens[a:b], df[a:b], m, n, percent, frequent) for a, b, n, m in zip(at, at[1:], batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=False)]
            # Of the second and third prefixes half of each hash is enough: what coincides is verified.
            short = [(a, *(np.unique(x.view(np.int32)[::2]) for x in (b, c))) for a, b, c in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([o[k] for o in short], kinds[k]) for k in range(3)), batch.column(4)], ["doc_id", "tag", "n", "first", "second", "third", "hist"])

    return shared.select("doc_id", "tag", "n", "m", "hist", "shared").mapInArrow(run, "doc_id long, tag int, n long, first array<long>, second array<int>, third array<int>, hist binary")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """`texts` (doc_id, text, at) as doc_id, at and the whole set of each row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(words)
        for batch in _small(batches):
            sets = [of(t) for t in batch.column(1).to_pylist()]
            some = pa.array([len(h) > 0 for h in sets])
            kept = [batch.column(k).filter(some) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([h.view(np.int64) for h in sets if len(h)], pa.list_(pa.int64()))], ["doc_id", "at", "toks"])

    return texts.mapInArrow(run, f"doc_id long, at {dict(texts.dtypes)['at']}, toks array<long>")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose doc_id is the smallest of their component, and those that aren't linked; all columns."""
    found = similarity_classes(docs, words, percent).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("_keep")).distinct()
    mine = docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("_id"))
    return mine.join(found, mine["_id"].eqNullSafe(found["_keep"]), "left_semi").select("_row.*")


#: Oracle for small tables: pairs over an inverted index, then reachability.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [list_aggregate(ws, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
cls AS (SELECT min(doc_id) AS node, any_value(sh) AS sh FROM (SELECT doc_id, sh, list_sort(sh) AS k FROM s WHERE len(sh) > 0) GROUP BY k),
e AS (SELECT node, len(sh) AS n, unnest(sh) AS g FROM cls),
g AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
f AS (SELECT e.* FROM e JOIN g USING (g)),
l AS (SELECT a.node AS a, b.node AS b FROM f a JOIN f b ON a.g = b.g AND a.node <> b.node AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
      GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT node, node FROM cls UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a),
m AS (SELECT s.doc_id, len(s.sh) AS n_shingles, cls.node FROM s LEFT JOIN cls ON len(s.sh) > 0 AND list_sort(s.sh) = list_sort(cls.sh))
SELECT m.doc_id, m.n_shingles::BIGINT AS n_shingles, coalesce(c.component, m.doc_id) AS component_id FROM m LEFT JOIN c ON m.node = c.node
"""
