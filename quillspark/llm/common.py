"""Helpers shared by the training-data operators: column hygiene, lineage cuts, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.lineage import cut, release, shared_dir  # noqa: F401

#: What `split` and byte-level `bytes.split()` both treat as white space.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def small_enough(df: DataFrame, columns: list[str], limit: int) -> bool:
    """Whether the bytes of these string/array columns (plus 64 a row) stay under `limit`; one aggregate."""
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(64))
    return (df.agg(F.sum(size)).first()[0] or 0) < limit


def met_by_key(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, most: int = 2000) -> DataFrame:
    """`rows` with the columns of their group, equi-joined on `key`; `groups` has a row a key, with its number of rows in `size`.

    Keys with more than the most-th part of all `total` rows, of which there are fewer than `most`, go to every
    task, so that no large group meets in one.
    """
    least = max(1, total // most)
    names = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.where(F.col(size) > least).withColumn("_hot", F.lit(True)))
    cold = groups.where(F.col(size) <= least)
    met = rows.join(hot, key, "left")
    warm = met.where("_hot").select(*rows.columns, *names)
    return warm.union(met.where("_hot is null").select(*rows.columns).join(cold, key).select(*rows.columns, *names))


#: Edges that one task may join: two numbers each.
LOCAL_EDGES = 1_000_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) of all edges of a task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for lo in range(0, len(nodes), 10_000):
        part = nodes[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["node", "component"])


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and sums of two hashes of them: what tells two edge sets apart without joining them."""
    half = lambda seed, shift: F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "a", "b"), shift).bitwiseAND(F.lit(2**32 - 1)))
    return tuple(edges.agg(F.count(F.lit(1)), half(1, 0), half(1, 32), half(2, 0), half(2, 32)).first())


def components(edges: DataFrame, rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of `edges(a long, b long)` as `(node, component)`, component = smallest node.

    A node that is its component's smallest has no row of its own.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each step is a
    distinct and a grouped minimum, so a hot node is pre-aggregated before the shuffle
    and no component is ever gathered in one place. Converges in O(log^2 n) steps in
    practice; lineage is cut after every step. Where the counted edges are few, so that
    rounds would cost more than their work, one task joins them instead.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = _mark(now)
    if last[0] <= local_edges:
        return now.coalesce(1).mapInArrow(_union, "node long, component long")
    for _ in range(rounds):
        # Large star: every larger neighbour of u moves to the smallest of u and its neighbours.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        before, now = now, cut(small, "edges")
        release(before)
        if (mark := _mark(now)) == last:  # the same edges, or 128 bits of their hashes coincide
            break
        last = mark
    else:
        raise RuntimeError("connected components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).groupBy("node").agg(F.min("component").alias("component"))
