"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0 and 1, normalised.
The exponent is found by repeated section (each round evaluates a grid of exponents in one
aggregate over the source table): the largest whose weights have the target entropy, raised
where a source would be repeated more often than the limit allows. A source's budget is its
weight of the total budget: whole epochs over its blocks, each a new permutation of them, and
then a part of an epoch: blocks in the order of that epoch's permutation, and documents of the
block that meets the budget in the order of theirs.

Blocks are dealt by a hash of doc_id. A decision needs a document's own hashes and a row per
source, so texts never move; hot sources are summed per block and task before any shuffle, and
the only ordered walks are over ranges of a source's blocks, the blocks of one range, and the documents of one block.

Defined cases: a null source counts as "". Null or empty text has no tokens; a source without
tokens has weight 0 and one epoch if everything is to be kept, else none. Documents with the same
doc_id go the same way. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE, cut, small_enough, text_of

BLOCK_TOKENS = 1_000_000
#: Exponents tried in one round and rounds, so an exponent is found to SECTIONS ** -ROUNDS.
SECTIONS, ROUNDS = 32, 4
BROADCAST_BYTES = 8 << 20


def n_tokens(text: Column) -> Column:
    """Words cut at ASCII white space."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def _moments(sources: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: the sum of powers of the shares, and the entropy of the weights."""
    share = F.col("tokens") / F.lit(float(total))
    power = [F.pow(share, F.lit(a)) for a in exponents]
    row = sources.where("tokens > 0").agg(*(F.sum(p).alias(f"z{k}") for k, p in enumerate(power)), *(F.sum(p * F.log(share)).alias(f"s{k}") for k, p in enumerate(power))).first()
    out = []
    for k, a in enumerate(exponents):
        z, s = row[f"z{k}"] or 1.0, row[f"s{k}"] or 0.0
        out.append((z, math.log(z) - a * s / z))
    return out


def _largest(sources: DataFrame, total: int, low: float, high: float, fits) -> float:
    """The largest exponent in [low, high] for which `fits(exponent, z, entropy)`, which holds up to some exponent."""
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        good = [k for k, (a, m) in enumerate(zip(grid, _moments(sources, total, grid), strict=True)) if fits(a, *m)]
        if not good:
            return low
        at = max(good)
        if at == SECTIONS:
            return high
        low, high = grid[at], grid[at + 1]
    return low


def exponent_for(sources: DataFrame, entropy_share: float | None, repeat_limit: float | None, budget: float, keep_all: bool) -> float:
    """The exponent for a table of `tokens` per source. Without a target it is 0 (even weights) unless repeats forbid it."""
    total, count, least, most = sources.where("tokens > 0").agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    if not count:
        return 1.0
    found = 0.0
    if entropy_share is not None:
        goal = entropy_share * math.log(count)
        found = _largest(sources, total, 0.0, 1.0, lambda a, z, h: h >= goal - 1e-12)
    if repeat_limit is not None:

        def repeats(a: float, z: float) -> float:
            if keep_all:  # the source with the smallest ratio of weight to tokens has one epoch
                return (least / most) ** (a - 1)
            return budget / total * (least / total) ** (a - 1) / z

        def too_often(a: float, z: float, h: float) -> bool:
            return repeats(a, z) > repeat_limit

        z0, _ = _moments(sources, total, [found])[0]
        if repeats(found, z0) > repeat_limit:
            found = min(1.0, _largest(sources, total, found, 1.0, too_often) + SECTIONS**-ROUNDS)
    return found


def plan_sources(keys: DataFrame, entropy_share: float | None = 0.9, repeat_limit: float | None = 4.0, budget_tokens: int | None = None, keep_all: bool = False, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """A row per source: weight, budget, n_blocks, epochs, and where its last part of an epoch ends (cut_order, cut_doc). `keys` has source, doc_id, tokens."""
    sources = cut(keys.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = float(budget_tokens if budget_tokens is not None else total)
    a = exponent_for(sources, entropy_share, repeat_limit, budget, keep_all)
    z = _moments(sources, max(total, 1), [a])[0][0]
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    weighted = sources.withColumn("weight", weight)
    if keep_all:
        budget = weighted.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    goal = F.floor(F.col("weight") * F.lit(budget) + F.lit(1e-6)).cast("long")
    if keep_all:
        goal = F.greatest(goal, F.col("tokens"))
    plan = weighted.withColumn("budget", goal).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long"))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1 if keep_all else 0)).cast("int")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = cut(plan, "plan")

    # The last part of an epoch: blocks in the order of its permutation while they fit, then documents of the next one.
    met = keys.join(_sided(plan.select("source", "n_blocks", "epochs", "rest")), "source").where("rest > 0")
    met = met.withColumn("block", block_of(F.col("doc_id"), F.col("n_blocks"), seed))
    blocks = met.groupBy("source", "block", "epochs", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("order", block_order(F.col("source"), F.col("block"), F.col("epochs"), seed))
    edge = cut(_first_over(blocks), "edges")
    inside = met.where("tokens > 0").join(_sided(edge.select("source", F.col("block").alias("edge_block"), "left")), "source").where("block = edge_block").withColumn("doc_order", doc_order(F.col("doc_id"), F.col("epochs"), seed))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_order").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    taken = inside.withColumn("upto", upto).where("upto <= left").groupBy("source").agg(F.max("doc_order").alias("cut_doc"))
    edge = edge.select("source", F.col("order").alias("cut_order"))
    return cut(plan.join(edge, "source", "left").join(taken, "source", "left"), "plan")


def _first_over(blocks: DataFrame) -> DataFrame:
    """For each source the first block, by `order`, with which its running sum of tokens is more than `rest`: order, block and what is `left` for it.

    Sums over 4,096 ranges of the order come first, so that only the blocks of one range of a source are sorted together.
    """
    upto = lambda order: F.sum("tokens").over(Window.partitionBy("source").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    parts = blocks.withColumn("part", F.shiftright("order", 52))
    runs = parts.groupBy("source", "part", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("run", upto("part")).where("run > rest")
    at = runs.groupBy("source").agg(F.min_by(F.struct("part", (F.col("run") - F.col("tokens")).alias("before")), "part").alias("p"))
    near = parts.join(_sided(at.select("source", "p.part", "p.before")), ["source", "part"]).withColumn("run", F.col("before") + upto("order")).where("run > rest")
    left = (F.col("rest") - F.col("run") + F.col("tokens")).alias("left")
    return near.groupBy("source").agg(F.min_by(F.struct("order", "block", left), "order").alias("e")).select("source", "e.order", "e.block", "e.left")


def _sided(small: DataFrame) -> DataFrame:
    """Broadcast a per-source table if its measured size is small; beyond that the join shuffles."""
    return F.broadcast(small) if small_enough(small, ["source"], BROADCAST_BYTES) else small


def block_of(doc_id: Column, n_blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), doc_id), n_blocks)


def block_order(source: Column, block: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), source, block, epoch)


def doc_order(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("doc"), doc_id, epoch)


def mix(docs: DataFrame, seed: int = 0, **target) -> DataFrame:
    """All occurrences of documents in the mix: _row (their columns), doc_id, source, tokens, weight, epoch, block, block_order, doc_order.

    A source's stream is its occurrences by (epoch, block_order, doc_order).
    """
    wide = docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"), n_tokens(text_of(docs)).alias("tokens"))
    keys = cut(wide.select("doc_id", "source", "tokens"), "keys")
    plan = plan_sources(keys, seed=seed, **target)
    met = wide.join(_sided(plan.drop("tokens")), "source")
    block = block_of(F.col("doc_id"), F.col("n_blocks"), seed)
    last = block_order(F.col("source"), block, F.col("epochs"), seed)
    more = F.when(F.col("rest") > 0, F.when(F.col("cut_order").isNull() | (last < F.col("cut_order")), 1).when((last == F.col("cut_order")) & (doc_order(F.col("doc_id"), F.col("epochs"), seed) <= F.col("cut_doc")), 1))
    times = F.col("epochs") + F.coalesce(more, F.lit(0))
    each = met.withColumn("block", block).withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    return each.select(
        "_row", "doc_id", "source", "tokens", "weight", "epoch", "block",
        block_order(F.col("source"), F.col("block"), F.col("epoch"), seed).alias("block_order"), doc_order(F.col("doc_id"), F.col("epoch"), seed).alias("doc_order"),
    )


def mixed_documents(docs: DataFrame, **target) -> DataFrame:
    """The documents of the mix with their own columns, once for each occurrence."""
    return mix(docs, **target).select("_row.*")
