"""Quality classifier by a sparse rule ensemble, compiled into Spark column expressions.

Statistics of a text are column expressions. Small trees are boosted on a bounded sample of
labelled rows; every path from a root to a node is a rule, a conjunction of threshold tests;
lasso logistic regression over the rules (and over the statistics themselves, standardised)
keeps few of them; those become one column expression, so scoring stays inside Spark.

The sample: of the labelled rows outside the held-out fold, the SAMPLE_ROWS with the smallest
hash of doc_id. Everything else runs over all rows.

Defined cases: null text counts as empty; the empty text has a score like any other. Rows
repeat as they come; rows with a null doc_id are scored and are not held out. With no labels,
or labels of one class only, every score is the share of label 1 (0.5 without labels). An
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE, text_of

SAMPLE_ROWS = 10_000
THRESHOLD = 0.7
TREES, DEPTH, BINS = 40, 3, 32
PENALTY, STEPS = 2e-4, 400


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; all finite, 0 for the empty text."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n, w = F.length(text), F.size(words)
    per = lambda c, by: F.when(by > 0, c / by).otherwise(F.lit(0.0))
    lost = lambda chars: n - F.length(F.translate(text, chars, ""))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(w.cast("double")),
        "chars_per_word": per(n, w),
        "distinct_words": per(F.size(F.array_distinct(words)), w),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_per_line": F.log1p(per(w, F.size(lines))),
        "upper": per(n - left(r"\p{Lu}"), n),
        "letters": per(n - left(r"\p{L}"), n),
        "digits": per(lost("0123456789"), n),
        "stops": per(lost(".?"), w),
        "commas": per(lost(",;:"), w),
        "shouts": per(lost("!"), w),
        "bars": per(lost("|"), w),
        "symbols": per(lost("#$%&*<>{}[]\\^~=_@"), w),
    }


NAMES = (
    "log_chars", "log_words", "chars_per_word", "distinct_words", "distinct_lines", "words_per_line", "upper", "letters", "digits", "stops", "commas", "shouts", "bars", "symbols",
)


@dataclass
class RuleModel:
    """logit = bias + sum of weights of the rules that hold + linear terms of clipped statistics."""

    bias: float = 0.0
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)
    linear: list[tuple[int, float, float, float]] = field(default_factory=list)

    def column(self, x: Column) -> Column:
        """The score as a Spark expression of the array of statistics, a column of its own.

        Rules are a table in arrays, walked by one lambda: a term for each of them is code
        that the driver, and each executor, would compile in hundreds of megabytes.
        """
        logit = F.lit(self.bias)
        if self.rules:
            depth = max(len(tests) for tests, _ in self.rules)
            filled = [(*tests, *[(0, True, -math.inf)] * (depth - len(tests))) for tests, _ in self.rules]
            parts = {"weight": [w for _, w in self.rules]}
            for d in range(depth):
                parts |= {f"{name}{d}": [t[d][k] for t in filled] for k, name in enumerate(("k", "above", "at"))}
            table = F.arrays_zip(*(_listed(values).alias(name) for name, values in parts.items()))

            def add(total: Column, rule: Column) -> Column:
                holds = F.lit(True)
                for d in range(depth):
                    holds = holds & ((F.get(x, rule[f"k{d}"]) > rule[f"at{d}"]) == rule[f"above{d}"])
                return total + F.when(holds, rule["weight"]).otherwise(F.lit(0.0))

            logit = F.aggregate(table, logit, add)
        for k, low, high, weight in self.linear:
            logit = logit + F.least(F.greatest(F.get(x, F.lit(k)), F.lit(low)), F.lit(high)) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy."""
        logit = np.full(len(x), self.bias)
        for tests, weight in self.rules:
            logit += weight * holds(x, tests)
        for k, low, high, weight in self.linear:
            logit += weight * np.clip(x[:, k], low, high)
        return 1 / (1 + np.exp(-logit))


def _listed(values: list) -> Column:
    """A constant array, one literal of text: it is folded when planned."""
    kind = {bool: "boolean", int: "int", float: "double"}[type(values[0])]
    return F.split(F.lit(",".join("-Infinity" if v == -math.inf else repr(v) for v in values)), ",").cast(f"array<{kind}>")


def holds(x: np.ndarray, tests: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, at in tests:
        out &= x[:, k] > at if above else x[:, k] <= at
    return out


def _grow(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: tuple, depth: int, rules: list) -> np.ndarray:
    """Grow a tree of Newton steps; adds its paths to `rules` and returns the step of each of `rows`."""
    total_g, total_h = gradient[rows].sum(), weight[rows].sum()
    step = np.full(len(rows), total_g / (total_h + 1.0))
    if depth == 0 or len(rows) < 40:
        return step
    best, split = 1e-3, None
    for k in range(binned.shape[1]):
        b = binned[rows, k]
        g, h = np.bincount(b, gradient[rows], BINS + 1).cumsum(), np.bincount(b, weight[rows], BINS + 1).cumsum()
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[len(cuts[k]) :] = 0
        at = int(gain.argmax())
        if gain[at] > best:
            best, split = float(gain[at]), (k, at)
    if split is None:
        return step
    k, at = split
    low = binned[rows, k] <= at
    for side, above in ((low, False), (~low, True)):
        if side.any():
            tests = (*path, (k, above, float(cuts[k][at])))
            rules.append(tests)
            step[side] = _grow(binned, cuts, gradient, weight, rows[side], tests, depth - 1, rules)
    return step


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> RuleModel:
    """Boost trees, take their paths as rules, and weigh rules and statistics by lasso logistic regression."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return RuleModel(math.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    draw, logit, rules = np.random.default_rng(seed), np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        rows = np.flatnonzero(draw.random(len(y)) < 0.5)
        found: list = []
        _grow(binned, cuts, y - p, p * (1 - p), rows, (), DEPTH, found)
        # The step holds for all rows: the deepest matching paths tell it.
        for tests in found:
            if len(tests) == DEPTH or not any(len(t) > len(tests) and t[: len(tests)] == tests for t in found):
                mine = holds(x, tests)
                g, h = (y - p)[mine].sum(), (p * (1 - p))[mine].sum()
                logit[mine] += 0.3 * g / (h + 1)
        rules += found
    unique, seen = [], set()
    for tests in rules:
        column = holds(x, tests)
        key = column.tobytes()
        if column.any() and not column.all() and key not in seen:
            seen.add(key)
            unique.append((tests, column))
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    spread = clipped.std(0)
    usable = np.flatnonzero(spread > 1e-9)
    # Features on a common scale, made in place; a rule's is its support's spread.
    r = len(unique)
    scale = np.concatenate([[max(1e-3, c.std()) for _, c in unique], spread[usable] / 0.4])
    z = np.empty((len(x), len(scale)), np.float32)
    for k, (_, column) in enumerate(unique):
        z[:, k] = column
    z[:, r:] = clipped[:, usable]
    middle = z.mean(0, dtype=np.float64)
    z -= middle.astype(np.float32)
    z /= scale.astype(np.float32)
    weights, bias = _lasso(z, y)
    weights = weights / scale
    bias = float(bias - (weights * middle).sum())
    return RuleModel(
        bias,
        [(tests, float(w)) for (tests, _), w in zip(unique, weights[:r], strict=True) if w],
        [(int(k), float(low[k]), float(high[k]), float(w)) for k, w in zip(usable, weights[r:], strict=True) if w],
    )


def _lasso(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic loss with an L1 penalty, by accelerated proximal steps."""
    n, k = z.shape
    vector = np.random.default_rng(1).normal(size=k).astype(z.dtype)
    for _ in range(30):
        vector = z.T @ (z @ vector)
        vector /= np.linalg.norm(vector) or 1
    size = 1 / (0.25 * (float(np.linalg.norm(z @ vector)) ** 2 / n + 1) + 1e-9)
    w, b, v, vb, t = np.zeros(k), math.log(y.mean() / (1 - y.mean())), np.zeros(k), 0.0, 1.0
    vb = b
    for _ in range(STEPS):
        residual = 1 / (1 + np.exp(-((z @ v.astype(z.dtype)).astype(np.float64) + vb))) - y
        new = v - size * (z.T @ residual.astype(z.dtype)).astype(np.float64) / n
        new = np.sign(new) * np.maximum(np.abs(new) - size * PENALTY, 0)
        nb = vb - size * residual.mean()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on the bounded sample; only its statistics reach the driver."""
    ids = labels["doc_id"].cast("long")
    known = labels.select(ids.alias("_id"), labels["quality"].cast("int").alias("_quality")).where("_id is not null and _quality in (0, 1)")
    known = known.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "_quality").limit(sample_rows)
    mine = docs.select(docs["doc_id"].cast("long").alias("_id"), text_of(docs).alias("_text"))
    stats = statistics(F.col("_text"))
    rows = mine.join(F.broadcast(known), "_id").select("_id", "_quality", *(stats[k].cast("double").alias(k) for k in NAMES)).collect()
    rows.sort(key=lambda r: (r["_id"], *r[1:]))
    x = np.asarray([[r[k] for k in NAMES] for r in rows], np.float64).reshape(-1, len(NAMES))
    return fit(x, np.asarray([r["_quality"] for r in rows], np.float64))


def with_score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(_row struct of all columns, _id, _score, _place): statistics first, as a column, then the rules over them.

    A filter on the score names _place too: that keeps it above the statistics, which would else be
    made anew for each of the rules.
    """
    stats = statistics(text_of(docs))
    wide = docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("_id"), F.monotonically_increasing_id().alias("_place"), F.array(*(stats[k].cast("double") for k in NAMES)).alias("_x"))
    return wide.select("_row", "_id", model.column(F.col("_x")).alias("_score"), "_place")


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, sample_rows)
    narrow = docs.select("doc_id", "text")
    return with_score(narrow, model).select(
        F.col("_id").alias("doc_id"), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored at least `threshold`, with all their columns; all of them where no label tells anything."""
    model = train(docs, labels, sample_rows)
    if model == RuleModel(0.0):
        return docs
    return with_score(docs, model).where((F.col("_score") >= threshold) & (F.col("_place") >= 0)).select("_row.*")
