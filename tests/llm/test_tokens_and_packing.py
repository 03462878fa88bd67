import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "'", "s", "ll", "re", "'s", "'ve", "é", "中", "0", "12", "!", "?!", " ", "　", "😀", "a", "the", "\x1c", "́", "٣", "ß", "x'd", "<|endoftext|>", "<|", "THE", "İ"]


def texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 50))) for _ in range(n)] + ["", "a" * 4000, "é" * 999, " " * 2000, "'s" * 900]


def test_transducer_is_the_library(monkeypatch):
    library, machine = Tokenizer.from_file(BYTES), token_counts.Transducer(BYTES)
    cases = texts(3000, 1)
    want = [len(e.ids) for e in library.encode_batch(cases, add_special_tokens=False)]
    for chunk in (512, 5):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        sizes, got = machine.count(cases)
        assert got.tolist() == want and sizes.tolist() == [len(t.encode()) for t in cases]
    monkeypatch.setattr(token_counts, "MOST_STATES", 600)  # the table is emptied time and again
    assert token_counts.Transducer(BYTES).count(cases[:400])[1].tolist() == want[:400]


def test_counts_over_a_table(spark, docs, edge, empty):
    library = Tokenizer.from_file(BYTES)
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BYTES).collect()} == want
    rows = token_counts.token_counts(edge, BYTES).collect()
    assert len(rows) == edge.count() and all(r["n_tokens"] == 0 for r in rows if r["n_bytes"] == 0) and token_counts.token_counts(empty, BYTES).count() == 0


def spelled(speller, cases):
    out = [[] for _ in cases]
    for k, ids in speller.texts(pa.array(cases, pa.string())):
        out[k] += ids.tolist()
    return out


def test_speller_is_the_library(monkeypatch):
    library, speller = Tokenizer.from_file(WORDS), packing.WordSpeller(WORDS)
    cases = texts(2000, 2)
    cases += [f"a{c}B x{c} {c} '{c}s 9{c}'S" for c in map(chr, range(0x20, 0x2500))]  # every character that is spelled here, and some that aren't
    want = [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
    for size in (1_000_000, 7):
        monkeypatch.setattr(packing, "SLICE_WORDS", size)
        assert spelled(speller, cases) == want
    assert spelled(speller, ["", " \n"]) == [[], []] and spelled(speller, []) == []


def test_slices_cover_all_rows(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 10)
    cases = pa.array(["", "abc", "d" * 40, "", "ef", "g" * 9, "h"])
    assert list(packing.slices(cases)) == [(0, 2), (2, 3), (3, 5), (5, 7)]


def check_packing(rows, lengths, limit):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= limit
    assert sum(r["length"] for r in rows) == sum(lengths)
    return len(bins)


def test_packing_round_trip_and_density(spark, docs):
    library = Tokenizer.from_file(WORDS)
    want = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.best_fit_pack(docs, WORDS).collect()
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.asarray(ids, "<u4").tobytes()) == r["ids_crc32"] and r["start"] == 4096 * r["piece"]
    used = check_packing(rows, [len(v) for v in want.values()], 4096)
    assert used <= -(-sum(len(v) for v in want.values()) // 4096) + 2
    small = packing.best_fit_pack(docs, WORDS, group_tokens=20_000, open_bins=4).collect()
    check_packing(small, [len(v) for v in want.values()], 4096)


def plain_best_fit(lengths, capacity, most):
    """Open bins in a list, as (free, time of its last piece, bin)."""
    held, bins, out = [], 0, []
    for time, n in enumerate(lengths):
        fits = [b for b in held if b[0] >= n]
        if fits:
            best = min(fits, key=lambda b: (b[0], -b[1]))
            held.remove(best)
        else:
            if len(held) >= most and n < capacity:
                held.remove(min(held, key=lambda b: (b[0], -b[1])))
            best, bins = (capacity, time, bins), bins + 1
        out.append((best[2], capacity - best[0]))
        if best[0] > n:
            held.append((best[0] - n, time, best[2]))
    return out


def test_best_fit_with_few_open_bins():
    draw, closed = random.Random(5), 0
    for case in range(300):
        lengths, most = [draw.randint(1, 40) for _ in range(draw.randint(0, 80))], draw.choice((1, 2, 4, 100))
        if case % 2:
            lengths.sort(reverse=True)
        fit = packing.BestFit(40, most)
        assert [fit.put(n) for n in lengths] == plain_best_fit(lengths, 40, most)
        assert fit.open <= most
        closed += plain_best_fit(lengths, 40, most) != plain_best_fit(lengths, 40, 1000)
    assert closed > 50


def test_groups_are_packed_as_plainly(spark, docs):
    pieces = packing.tokenised_pieces(docs, WORDS, limit=256)
    rows = packing.pack(pieces, 256, group_tokens=20_000, open_bins=8).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["sequence_id"] >> 40, []).append(r)
    assert len(groups) > 2
    arrival = {(r["doc_id"], r["piece"]): r["arrival"] for r in packing.dealt(pieces, len(groups)).collect()}
    for found in groups.values():
        found.sort(key=lambda r: (arrival[r["doc_id"], r["piece"]], r["doc_id"], r["piece"], r["ids_crc32"]))
        assert [(r["sequence_id"] & (1 << 40) - 1, r["offset"]) for r in found] == plain_best_fit([r["length"] for r in found], 256, 8)


def test_repeated_rows_spread_over_groups(spark):
    rows = packing.pack(spark.range(4000).selectExpr("7L as doc_id", "0 as piece", "0L as start", "10L as length", "5L as ids_crc32"), 100, group_tokens=4000, open_bins=8).collect()
    sizes = {}
    for r in rows:
        sizes[r["sequence_id"] >> 40] = sizes.get(r["sequence_id"] >> 40, 0) + 1
    assert len(sizes) == 10 and max(sizes.values()) < 600


def test_packing_edges(edge, empty):
    rows = packing.best_fit_pack(edge, WORDS).collect()
    check_packing(rows, [r["length"] for r in rows], 4096)
    assert sum(r["length"] for r in rows if r["doc_id"] in (3, 4, 5)) == 3 and packing.best_fit_pack(empty, WORDS).count() == 0


def test_bins_close_in_groups_of_full_size():
    """The bound acts: pieces come in no order, and the fullest bin closes when another is to be opened."""
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6.3, 1.2, 4400).astype(int) + 1, packing.LIMIT).tolist()
    assert sum(lengths) > packing.GROUP_TOKENS
    fit, used = packing.BestFit(packing.LIMIT, packing.OPEN_BINS), {}
    for n in lengths:
        b, offset = fit.put(n)
        assert offset == used.get(b, 0)
        used[b] = offset + n
        assert fit.open <= packing.OPEN_BINS and used[b] <= packing.LIMIT
    assert fit.closed > 0 and fit.bins <= 1.03 * -(-sum(lengths) // packing.LIMIT)
