import hashlib
import json
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import chat_format, spelling, token_align
from quillspark.llm.token_counts import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = "said string, formatted string, loss long, turns string, raw long"


# Chat formatting.


def said(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2) for r in rows], f"conv_id long, turn long, role string, text string, {CLASH}")


def plain_format(turns, t):
    """One turn after another, with the places of the assistant's texts."""
    esc = lambda s: plain_escape(s, t)
    out, spans, last = t.begin, [], None
    for k, (role, text) in enumerate(turns):
        if k and role == last:
            out += t.between
        else:
            out += (t.end if k else "") + t.role_open + esc(role) + t.role_close
        if role == t.loss_role:
            spans.append((len(out), len(esc(text))))
        out, last = out + esc(text), role
    return out + t.end, spans


def plain_escape(s, t):
    out, k = "", 0
    while k < len(s):
        out += s[k]
        k += 1
        if any(s[k - 1] == m[0] for m in t.marks):
            n = len(s[k:]) - len(s[k:].lstrip("\\"))
            if any(s[k + n :].startswith(m[1:]) for m in t.marks):
                out += "\\" * (n + 1)
                k += n
    return out


def test_formatting_against_a_plain_walk(spark):
    hard = ["", None, "<s>", "</s>", "<\\s>", "<\\\\/s>[TURN]", "[[INST]", "a\\", "<", "[", "/s>", "[\\TURN][/INST]<<s>", "é😀 </s>\n", "$1\\1"]
    roles = ["user", "assistant", "assistant", "tool[INST]", None, "system"]
    rows = [(c, i, roles[(c * i + i) % 6], hard[(c * 5 + i * 3) % len(hard)]) for c in range(8) for i in range(3 + c)]
    rows += [(100, i, "assistant" if i % 3 else "user", f"{i} </s>") for i in range(700)]
    rows += [(200, 0, "user", "same"), (200, 0, "user", "same"), (200, None, "assistant", "first"), (None, 1, "user", "no id"), (300, 5, "assistant", "x" * 200_000)]
    t = chat_format.Template()
    want = defaultdict(list)
    for c, i, role, text in rows:
        want[c].append((-1 if i is None else i, role or "", text or ""))
    df = chat_format.format_conversations(said(spark, rows).repartition(3))
    got = {r["conv_id"]: (r["formatted"], [tuple(x) for x in r["loss"]]) for r in df.collect()}
    assert got == {c: plain_format([x[1:] for x in sorted(turns)], t) for c, turns in want.items()}
    for r in chat_format.read_back(df).collect():
        turns = [x[1:] for x in sorted(want[r["conv_id"]])]
        assert [tuple(x) for x in r["turns"]] == turns and r["learned"] == [x for role, x in turns if role == "assistant"]


def test_digests_of_no_and_of_marked_conversations(spark):
    assert chat_format.digests(chat_format.format_conversations(said(spark, []))).count() == 0
    r = chat_format.digests(chat_format.format_conversations(chat_format.probe(spark))).first()
    text = "</s>[INST] ok [/INST]"
    assert (r["conv_id"], r["n_turns"], r["loss_chars"]) == (-7, 2, len(text)) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_templates(spark):
    own = chat_format.Template("{begin}", "{role=", "{is}", "{next}", "{end}", "user")
    df = chat_format.format_conversations(said(spark, [(1, 0, "user", "{end}"), (1, 1, "user", "b"), (1, 2, "bot", "c")]), own)
    assert df.first()["formatted"] == "{begin}{role=user{is}{\\end}{next}b{end}{role=bot{is}c{end}"
    assert chat_format.read_back(df, own).first()["learned"] == ["{end}", "b"]
    for marks in ({"end": "x"}, {"end": "<\\s>"}, {"end": "a<s>"}, {"between": "[a[b"}):
        with pytest.raises(ValueError):
            chat_format.Template(**marks)


# Cross-tokenizer alignment.


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp, sym = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_symbols()
    tok.encode_special_tokens = True
    with open(A, encoding="utf-8") as f:
        spelled = {i: bytes(sym[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items() if t != "<|endoftext|>"}
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    out, links = [], Counter()
    for doc, text in rows:
        text = text or ""
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        whole = (" " + text).encode()
        if not text or b"".join(spelled[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            out.append((doc, 0, 0, [], ""))
            continue
        groups, mine, ga, gb, at_a, at_b, kb = [], [], [], [], 0, 0, 0
        for i in a:
            ga.append(i)
            at_a += len(spelled[i])
            while at_b < at_a:
                gb.append(b[kb])
                at_b += len(piece(b[kb]))
                kb += 1
            if at_a == at_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                mine.append((ga[-1], gb[-1]))
                ga, gb = [], []
        links.update(mine)
        out.append((doc, len(a), len(b), mine, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    return sorted((doc, n_a, n_b, len(m), len(m), sum(links[x] == most[x[1]] for x in m), sum(links[x] for x in m), sha) for doc, n_a, n_b, m, sha in out)


def test_alignment_against_the_libraries(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()]
    rows += [(-1, None), (-2, ""), (-3, " "), (-4, "a▁b"), (-5, "<|endoftext|></s><s> <unk>"), (-6, "中文😀\x00\x1c\r\n  é"), (-7, "word " * 20_000), (1, "same"), (1, "same"), (-8, "ﬁ ① ｆｕｌｌ"), (-9, "   lead"), (-10, "x" * 3000)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, pairs long, row string").repartition(3)
    want = plain_alignment(rows)
    for most in (token_align.MOST_PAIRS, 0):
        got = token_align.alignment(df, A, B, most).collect()
        assert sorted(map(tuple, got)) == want
    assert token_align.alignment(df.limit(0), A, B).count() == 0
    r = {x["doc_id"]: x for x in token_align.align_documents(df, A, B).collect()}
    assert sum(g["n_bytes"] for g in r[-7]["groups"]) == 100_001 and sum(g["a"] for g in r[-7]["groups"]) == len(r[-7]["a"]) and r[-4]["a"] == []


def test_null_ids_and_edge_rows_are_aligned(spark, edge, empty):
    assert token_align.alignment(edge, A, B).count() == edge.count() and token_align.alignment(empty, A, B).count() == 0


# Spelling variants.


def near(a, b):
    short, long = sorted((a, b), key=len)
    if a == b or len(long) - len(short) > 1:
        return False
    return any(long[:k] + long[k + 1 :] == (short if len(short) < len(long) else short[:k] + short[k + 1 :]) and long[:k] == short[:k] for k in range(len(long)))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", min_size=7, max_size=10), min_size=2, max_size=40))
def test_each_near_pair_comes_from_one_block(words):
    """Blocks, in plain Python, with no limit on what is divided."""
    words, found = sorted(words), []
    for m in range(7, 11):
        mine = [(w, 1) for w in words if len(w) in (m, m + 1)]
        for key, apart, head, tail in ((lambda w: w[: m // 2], 2**30, m // 2, 0), (lambda w: w[len(w) - m // 2 :], m // 2, 0, m // 2)):
            ranges = defaultdict(list)
            for x in mine:
                ranges[key(x[0])].append(x)
            for block in ranges.values():
                found += [tuple(sorted((a, b))) for a, _, b, _ in spelling._pairs(block, m, head, tail, apart)]
    assert sorted(found) == [(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b)]


def test_blocks_are_divided_without_losing_pairs(spark):
    """All words share a long front, so one block holds everything until it is divided."""
    words = {"prefixed" + "".join("abcdefg"[(k >> (2 * j)) & 3] for j in range(4)) for k in range(256)} | {"prefixed" + x for x in ("aaa", "aab", "abcde")} | {"zebraaa", "zebraab"}
    df = spark.createDataFrame([(w, 2 + len(w)) for w in sorted(words)], "word string, n long")
    want = sorted((a, b, 2 + len(b)) for a in words for b in words if near(a, b))
    for most in (5000, 20, 2):
        assert sorted(map(tuple, spelling.near_words(df, most).collect())) == want
        sizes = spelling.blocks(df, most).where("m - head - tail >= 2").groupBy(*spelling.BLOCK).count().agg(F.max("count")).first()[0]
        assert sizes is None or sizes <= most


def test_forms_follow_to_the_root(spark):
    text = " ".join(["Variant"] * 4000 + ["varyant"] * 100 + ["varyent"] * 3 + ["Übermaß"] * 3 + ["short"] * 9)
    rows = [(k, text) for k in range(3)] + [(9, None), (10, ""), (None, "a1b Straßenbahn straßenBAHN")]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame([(*r, "n", "w", 1) for r in rows], "doc_id long, text string, n string, word string, m long")).collect()}
    assert (got["variant"]["form"], got["varyant"]["form"], got["varyent"]["form"]) == (None, "variant", "varyant")
    assert got["varyent"]["root"] == "variant" and got["varyant"]["form_n"] == got["variant"]["n"]
    assert "Übermaß" in got and got["straßenbahn"]["n"] == 2 and "short" not in got
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_and_ties(spark, edge):
    rows = [(1, "abcdefg " * 50_000 + "abcdefh " * 3 + "abcdefi " * 3)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["abcdefh"]["form"] == "abcdefg" and got["abcdefg"]["n_near"] == 2 and got["abcdefg"]["form"] is None
    assert spelling.variants(edge).count() == 0
