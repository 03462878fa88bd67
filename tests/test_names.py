import random
import time

import regex

from quillspark.functions import names


def plain(raw, allowed=names.ALLOWED, unicode_boundaries=False):
    """The gate as passes over the whole text, one after the other."""
    edge = r"\b" if unicode_boundaries else names._ASCII_EDGE
    text = names.regex.sub(r"\p{Cf}", "", names.unicodedata.normalize("NFC", raw))
    known, hits = {}, []

    def claim(name):
        key = name.lower()
        if key in allowed:
            return name
        if key not in known:
            known[key] = names.label(len(known))
            hits.append((known[key], name))
        return known[key]

    def outside(out, change):
        return "".join(p if k % 2 else change(p) for k, p in enumerate(regex.split(r"(\[person [A-Z]+\])", out)))

    run = rf"{edge}(?:{names.WORD})(?:\s+(?:{names.WORD}))+{edge}"
    out = regex.sub(run, lambda m: m[0] if all(w.lower() in allowed for w in m[0].split()) else claim(m[0]), text)
    out = outside(out, lambda p: regex.sub(rf"{edge}(?:{names.WORD}){edge}", lambda m: claim(m[0]), p))
    for marker, name in sorted(hits, key=lambda h: len(h[1]), reverse=True):
        out = outside(out, lambda p: regex.sub(rf"{edge}{regex.escape(name, literal_spaces=True)}{edge}", marker, p, flags=regex.I))  # noqa: B023
    return out, hits


PARTS = [
    "Ann", "ann", "ANN", "Bell", "bell", "Sandra Bell", "sandra bell", "The", "the", "Monday", "May", "O'Brien", "o'brien", "Anne-Marie", "Jean-", "É", "Élan", "élan", "Zoë", "zoë", "ÄÖ", "Ж", "Жан", "жан",
    "McDonald", "ABc", "A", "B2", "X-ray", "x-RAY", "person", "Person", "a_B", "Al", "Al Bo", "Bo", "al bo", "İ", "中文", ".", ",", "'", "-", "3", "(", "ann\u200bie", "e\u0301",
]


def test_gate_against_plain_passes():
    draw, gates = random.Random(7), {u: names.Gate(unicode_boundaries=u) for u in (False, True)}
    for case in range(6000):
        text = "".join(draw.choice(PARTS) + draw.choice([" ", " ", " ", "", "\n", "  ", ". "]) for _ in range(draw.randint(0, 14)))
        u = case % 4 == 0
        assert gates[u](text) == plain(text, unicode_boundaries=u), repr(text)


def test_gate_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    gate = names.Gate()
    for r in docs:
        assert gate(r["text"]) == plain(r["text"])


def test_allow_list_is_a_parameter():
    own = names.allow_list(["Report,reports Sydney", "PDF"])
    assert own == {"report", "reports", "sydney", "pdf"}
    assert names.Gate(own)("Report from Sydney to Kim in a PDF")[0] == "Report from Sydney to [person A] in a PDF"


def test_long_texts_with_many_names_take_linear_time():
    text = " ".join(f"Na{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} said so to ab{k}." for k in range(15_000))
    began = time.time()
    scrubbed, hits = names.Gate()(text)
    assert len(hits) == 15_000 and time.time() - began < 5 and scrubbed.startswith("[person A] said")


def test_ordinary_words_of_a_corpus_are_no_names(spark, sf):
    rows = [("Nurses came. The nurses left, nurses stay. Ann met nurses.",), ("ann is rare; Ann, Ann and Ann aren't. Éclair éclair éclair éclair",), (None,), ("",)]
    df = spark.createDataFrame(rows, "text string")
    found = {r["word"]: (r["lower_n"], r["upper_n"]) for r in names.ordinary_words(df).collect()}
    assert found["nurses"] == (3, 1) and found["éclair"] == (3, 1) and "ann" not in found and "rare" not in found
    assert names.ordinary_words(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    allowed = names.allow_list_of(docs)
    few = docs.limit(40)
    got = {r["doc_id"]: (r["g"]["text"], r["g"]["names"]) for r in few.select("doc_id", names.gate("text", allowed=allowed).alias("g")).collect()}
    want = {r["doc_id"]: plain(r["text"], allowed) for r in few.collect()}
    assert got == {k: (out, len(hits)) for k, (out, hits) in want.items()}
    labels = lambda a: sum(len(names.Gate(a)(r["text"])[1]) for r in few.collect())
    assert labels(allowed) < labels(names.ALLOWED)
