import collections
import hashlib
import random

import numpy as np
import pytest
from compare import oracle, same

from quillspark.llm import exact_dedup, ngram_join, queries
from quillspark.llm.common import components


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), *oracle(sf, queries.ORACLE_SQL[name]))


def test_exact_edges(edge, empty):
    rows = exact_dedup.exact_groups(edge).collect()
    assert len(rows) == edge.count() and exact_dedup.exact_groups(empty).count() == 0
    by = {(r["doc_id"], r["text_sha256"]): r for r in rows}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[(1, sha("a b c d e f g"))]["keep_id"] == 2 and by[(1, sha("a b c d e f g"))]["group_size"] == 4
    assert by[(4, sha(""))]["keep_id"] == 10 and by[(10, sha(""))]["kept"]
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [2, 5, 7, 8, 9, 10, 11]
    assert exact_dedup.drop_copies(empty).count() == 0


def test_chunks_rejoin_and_resynchronise(spark, docs):
    from pyspark.sql import functions as F

    both = docs.select("text", exact_dedup.chunks(F.col("text")).alias("a"), exact_dedup.chunks(F.concat(F.lit("inserted words "), "text")).alias("b")).collect()
    assert all("".join(r["a"]) == r["text"] and max(map(len, r["a"]), default=0) <= exact_dedup.MAX_CHUNK for r in both)
    long = [r for r in both if len(r["a"]) > 8]
    assert len(long) > 5 and sum(bool(set(r["a"][3:]) & set(r["b"])) for r in long) >= 0.9 * len(long)


def test_collision_of_identifiers_is_found(spark):
    bad = spark.createDataFrame([([1, 2], [b"a", b"b"]), ([1], [b"c"])], "ids array<long>, digests array<binary>")
    assert [r[0] for r in exact_dedup.colliding(bad).collect()] == [1]


def brute(rows, words, percent):
    of = ngram_join.Shingler(words)
    sets = [(d, of(t)) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    posts = collections.defaultdict(list)
    for d, s in sets:
        if d is None:
            continue
        counts = collections.Counter(k for t in s.tolist() for k in posts[t])
        for (e, m), c in counts.items():
            if 100 * c >= percent * (len(s) + m - c):
                a, b = sorted((find(d), find(e)))
                up[b] = a
        for t in s.tolist():
            posts[t].append((d, len(s)))
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_join_against_brute_force_in_small_blocks(spark, sf, monkeypatch, words, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 2000)
    base = " ".join(f"w{k % 97}x{k % 89}" for k in range(140)).split()
    family = [(1000 + k, " ".join(base[: 40 + k % 7] + [f"new{k}"] + base[40 + k % 7 :])) for k in range(60)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(family, "doc_id long, text string"))
    want = brute([tuple(r) for r in docs.collect()], words, percent)
    for frequent in (2, 256):
        assert sorted((tuple(r) for r in ngram_join.similarity_classes(docs, words, percent, frequent).collect()), key=repr) == want


def test_histograms_rule_out_what_only_shares_prefixes():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 400, np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - lost], rng.integers(0, 2**64, lost, np.uint64)])) for lost in (0, 5, 12, 19, 20, 150, 160, 170)]
    n, prefix = np.asarray([len(s) for s in sets]), [base[:9].view(np.int64)] * len(sets)
    linked = {(i, j) for i in range(8) for j in range(8) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    hist = [ngram_join.histogram(s) for s in sets]
    found = set(zip(*map(np.ndarray.tolist, np.nonzero(ngram_join.candidates(n, [prefix, prefix], 90, hist))), strict=True))
    assert linked <= found and {k for pair in found for k in pair} <= set(range(5))  # before, every pair was one
    # A set without a histogram is ruled out by nothing.
    assert ngram_join.histogram(np.arange(2**16, dtype=np.uint64)) == b"" and ngram_join.candidates(n, [prefix, prefix], 90, [b"", *hist[1:]])[0].sum() == 7


def test_components_in_rounds_and_in_one_task(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(50)]
    df = spark.createDataFrame(edges, "a long, b long")
    near, seen = collections.defaultdict(set), {}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for root in sorted(near):
        todo = [root] if root not in seen else []
        while todo:
            at = todo.pop()
            if at not in seen:
                seen[at] = root
                todo += near[at]
    want = {(n, c) for n, c in seen.items() if n != c}
    for most in (0, 1_000_000):
        assert {tuple(r) for r in components(df, local_edges=most).collect()} == want


def test_blocks_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 2000)
    # 400 members that aren't linked, 300 that are, some of them with large sets, and two small buckets.
    rows = [(1, d, 900 if d % 50 == 0 else 40, d if d < 400 else 400) for d in range(700)] + [(2, 1, 5, 1), (2, 2, 5, 2), (3, 7, 9000, 7), (3, 8, 10, 8)]
    known = spark.createDataFrame(rows, "token long, doc_id long, n long, component long")
    first = ngram_join.dealt(ngram_join.totalled(known.select("token", "doc_id", "n"), ["token"]), ["token"]).collect()
    sizes = {(r[0], r[1]): r[2] for r in rows}
    assert len(first) == len(rows) and {r["hot"] for r in first if r["token"] == 2} == {False}

    def blocks(found):
        out = collections.defaultdict(list)
        for r in found:
            out[r["token"], r["block"]].append(r["doc_id"])
        return out

    for (token, _), members in blocks(first).items():
        assert len(members) <= 10 and sum(sizes[token, d] for d in members) < 2000 + max(sizes[token, d] for d in members)
    pairs = blocks(ngram_join.paired_blocks(known.where("token = 1")).collect())
    assert max(map(len, pairs.values())) <= 20 and max(sum(sizes[1, d] for d in m) for m in pairs.values()) < 2 * 2900
    met = {(a, b) for m in pairs.values() for a in m for b in m if a < b}
    assert all((a, b) in met for a in range(400) for b in range(a + 1, 700))
    assert sum(map(len, pairs.values())) < 700 * 100
    alone = blocks(ngram_join.paired_blocks(known.where("token = 2")).collect())
    assert any({1, 2} <= set(m) for m in alone.values())


def test_unlinked_members_of_a_hot_bucket(spark, monkeypatch):
    """Texts that share half of their words, with links over all blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 600)
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join(common + [f"d{k % 40}x{j}" for j in range(45)] + [f"e{k}"]) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.similarity_classes(docs, 1, 70).collect()), key=repr)
    assert got == brute(list(enumerate(texts)), 1, 70) and len({c for _, _, c in got}) == 40


def test_join_edges(edge, empty):
    rows = ngram_join.similarity_classes(edge, 3, 90).collect()
    assert len(rows) == edge.count() and ngram_join.similarity_classes(empty, 3, 90).count() == 0
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert by[(2, 5)] == 1 and by[(3, 0)] == 3 and by[(5, 0)] == 5 and by[(7, 2)] == 6 and by[(8, 1)] == 8 and by[(9, 1)] == 9 and by[(None, 5)] is None
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns and {1, 3, 4, 5, 6, 8, 9, 10, 11} == {r["doc_id"] for r in kept.collect()} - {None}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert all(found.get(k, k) == 0 for k in range(61)) and found[101] == 100
