import hmac
import io
import sys
import zipfile
import zlib

from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.sources import files, parsers, pdf
from quillspark.streaming import jobs


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def simple_pdf(content: bytes, filters: bytes = b"") -> bytes:
    return (
        b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n"
        b"3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>endobj\n"
        b"4 0 obj<<" + filters + b"/Length " + str(len(content)).encode() + b">>stream\n" + content + b"\nendstream endobj\n5 0 obj<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>endobj\n%%EOF"
    )


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>First</w:t><w:tab/><w:t>x &amp; y</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>".encode()})
XLSX = zipped({
    "xl/workbook.xml": b'<workbook><sheets><sheet name="Pay"/></sheets></workbook>', "xl/sharedStrings.xml": b"<sst><si><t>Name</t></si><si><r><t>Rich</t></r><r><t> text</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": b'<worksheet><sheetData><row><c t="s"><v>0</v></c><c/><c t="s"><v>1</v></c></row><row><c><v>3.5</v></c><c t="b"><v>1</v></c><c t="e"><v>#REF!</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
})
PPTX = zipped({f"ppt/slides/slide{k}.xml": f"<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>Slide {k}</a:t></a:r></a:p></p:sld>".encode() for k in (10, 2, 1)})


def test_delimited():
    assert parsers.delimited('﻿a,"b,""q"" \r\n z",c\r1,,3\n', ",") == [["a", 'b,"q" \r\n z', "c"], ["1", "", "3"]]
    assert parsers.delimited("", ",") == [] and parsers.delimited('"open,', ",") == [["open,"]]
    assert parsers.delimited_text(" a , b \n,\n c", ",") == "a | b\nc"
    assert "[truncated after 5000 rows]" in parsers.delimited_text("x\n" * 5002, ",")


def test_office_files():
    assert parsers.docx_text(DOCX) == "First\tx & y\na | b"
    assert parsers.xlsx_text(XLSX) == "# Sheet: Pay\nName | Rich text\n3.5 | TRUE | in"
    assert [x for x in parsers.pptx_text(PPTX).split("\n") if x.startswith("Slide")] == ["Slide 1", "Slide 2", "Slide 10"]
    assert parsers.docx_text(b"junk") == parsers.xlsx_text(b"") == parsers.pptx_text(zipped({"a": b"b"})) == ""


def test_pdf():
    body = b"BT /F1 12 Tf 72 700 Td (Hello \\(World\\)) Tj 0 -20 Td [(A) -300 (B)] TJ ET"
    want = "Hello (World)\nA B"
    assert pdf.pdf_text(simple_pdf(body)) == want
    assert pdf.pdf_text(simple_pdf(zlib.compress(body), b"/Filter/FlateDecode")) == want
    assert pdf.pdf_text(simple_pdf(body.hex().encode() + b">", b"/Filter/ASCIIHexDecode")) == want
    assert pdf.pdf_text(simple_pdf(body) + b"trailer<</Encrypt 9 0 R>>") == "" and pdf.pdf_text(b"junk") == ""
    assert pdf.pdf_text(simple_pdf(zlib.compress(body)[:20], b"/Filter/FlateDecode")) in ("", "Hello (World)")


def test_pdf_literals_are_read_in_runs():
    """Not a step of Python for each byte; escapes, brackets and comments stay what they are."""
    words, lines = "word " * 20_000, 0

    def traced(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return traced

    sys.settrace(traced)
    try:
        out = pdf.pdf_text(simple_pdf(b"BT /F1 9 Tf % a comment (\n (" + words.encode() + rb"\(\101\)) Tj T* ((x) y) Tj ET"))
    finally:
        sys.settrace(None)
    assert out.split() == [*words.split(), "(A)(x)", "y"] and lines < 20_000  # before, several lines a byte


def test_pdf_unicode_map_and_lzw():
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <00E9> endbfchar 1 beginbfrange <02> <04> <0061> endbfrange"
    text, width = pdf.to_unicode(cmap)
    assert width == 1 and text == {1: "é", 2: "a", 3: "b", 4: "c"}
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"


def test_mail_threads():
    def mail(who, refs="", subject="=?utf-8?q?Caf=C3=A9?=", body="hello=20there", kind="quoted-printable"):
        return f"From x\nMessage-ID: <{who}>\nReferences: {refs}\nFrom: a@b\nSubject: {subject}\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: {kind}\n\n{body}\n".encode()

    box = mail("2", "<1>", "Re: =?utf-8?q?Caf=C3=A9?=") + mail("1") + mail("3", "<9> <2>") + mail("4", "", "Other", "aGk=", "base64")
    out = parsers.email_text(box)
    assert out.count("# Email thread: Café") == 1 and "# Email thread: Other\n## Message 1\nFrom: a@b\n\nhi" in out and "hello there" in out and out.endswith("hi")
    html = b"Subject: s\nContent-Type: text/html\n\n<p>a&amp;b<script>x</script></p>"
    assert "a&b" in parsers.email_text(html) and parsers.email_text(b"no mail at all") == ""
    def places(*rows):
        return [[m["ord"] for m in t] for t in parsers.thread_order([{"message_id": i, "refs": r, "ord": k} for k, (i, r) in enumerate(rows)])]

    assert places(("a", ["b"]), ("b", ["a"])) == [[0, 1]]  # a cycle is one thread
    assert places(("c", ["a"]), ("a", ["b"]), ("b", ["a"])) == [[1, 0, 2]]
    assert places(("r", []), ("x", ["r"]), ("y", ["r"]), ("z", ["x", "gone"])) == [[0, 1, 3, 2]]  # depth first
    assert places(("r", []), ("r", []), ("x", ["r"]), (None, []), ("s", ["s"])) == [[0], [1, 2], [3], [4]]  # equal ids: none is lost, the last is meant
    both = mail("1", body="first") + mail("1", body="second")
    assert "first" in parsers.email_text(both) and "second" in parsers.email_text(both)


def test_archive(monkeypatch):
    inner = zipped({"deep.txt": b"deep", "again.zip": zipped({"x.txt": b"x"})})
    read = lambda members: parsers.archive_text(zipped(members), files.member_lane, files.native_text)
    out = read({"a.txt": b"alpha", "../evil.txt": b"no", "n.zip": inner, "b.bin": b"\xff", "c.md": b" ", "p.png": b"x", "e.txt": b"", "d.docx": b"bad"})
    assert out.split("\n") == [
        "# Archive: 8 members", "## Member: a.txt (native)", "alpha", "## Member: ../evil.txt (refused: unsafe path)", "# Archive: 2 members", "## Member: deep.txt (native)", "deep",
        "## Member: again.zip (refused: nesting limit 1)", "## Member: b.bin (refused: unsupported type .bin)", "## Member: c.md (native, skipped: extracted no text)",
        "## Member: p.png (held-ocr, skipped: vision OCR needs the model pass)", "## Member: e.txt (refused: empty document)", "## Member: d.docx (held-docx, skipped: native parse failed)",
    ]
    assert parsers.archive_text(b"no zip", files.member_lane, files.native_text) == ""
    monkeypatch.setattr(parsers, "MAX_INFLATED", 400)  # one budget for the whole tree
    many = read({f"{k}.zip": zipped({"t.txt": b"x" * 250}) for k in range(3)})
    assert many.count("(native)") == 1 and many.count("(refused: archive byte budget exhausted)") == 2
    monkeypatch.setattr(parsers, "MAX_CHARS", 60)
    assert read({"a.txt": b"a" * 50, "b.txt": b"b"}).endswith("[archive truncated at 60 characters]")


def test_stitch():
    assert parsers.stitch(["the train was late", "Was late again", "", "end"]) == "the train was late again end" and parsers.stitch([]) == ""


def test_drain_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name, data in {"a.txt": b"Ann Lee came", "b.csv": b"x,y\n1,2\n", "c.docx": DOCX, "d.txt": b"\xff\xfe", "e.exe": b"MZ", "f.png": b"PNG", "g.pdf": simple_pdf(b"BT /F1 9 Tf (in a pdf) Tj ET")}.items():
        (src / name).write_bytes(data)
    rows = {r["name"]: r for r in files.drain(files.scan(spark, str(src)), {"held-ocr": lambda name, content: F.lit("seen by model")}).collect()}
    assert rows["a.txt"]["text"] == "[person A] came" and rows["a.txt"]["status"] == "parsed" and rows["b.csv"]["text"] == "x | y\n1 | 2"
    assert rows["d.txt"]["status"] == "held" and rows["d.txt"]["reason"] == "not valid UTF-8 text" and rows["e.exe"]["status"] == "rejected"
    assert rows["f.png"]["status"] == "OCRed" and rows["g.pdf"]["text"] == "in a pdf" and rows["c.docx"]["tier"] == "native"
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        jobs.drain_stream(spark, str(src), out, str(tmp_path / "cp"), "s3cret").awaitTermination()
    streamed = {r["path"].rpartition("/")[2]: r["status"] for r in spark.read.parquet(f"{out}/docs").collect()}
    assert {k: v for k, v in streamed.items() if k != "f.png"} == {k: r["status"] for k, r in rows.items() if k != "f.png"} and streamed["f.png"] == "held"
    found = {r["path"].rpartition("/")[2]: r["name_hmac"] for r in spark.read.parquet(f"{out}/entities").where("label = '[person A]'").collect()}
    assert set(found) == {"a.txt"}  # the First of c.docx is no name
    assert found["a.txt"] == hmac.new(b"name:s3cret", b"ann lee", "sha256").hexdigest()


def test_sinks_are_idempotent(spark, tmp_path):
    at = str(tmp_path / "t")
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, at long, v string")
    for _ in range(2):
        sinks.insert_ignore(first, at, ["id"])
    sinks.upsert(spark.createDataFrame([(2, 2, "c"), (3, 1, "d"), (1, 0, "old")], "id long, at long, v string"), at, ["id"], "at")
    assert sorted(map(tuple, sinks.read(spark, at).collect())) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    assert jobs.memoised(spark, str(tmp_path), "step", lambda: first).count() == 2
    assert jobs.memoised(spark, str(tmp_path), "step", lambda: 1 / 0).count() == 2


def test_versions_survive_a_crash_and_readers(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = lambda *ids: spark.createDataFrame([(k,) for k in ids], "id long")
    assert sinks.read(spark, at) is None
    sinks.replace(rows(1, 2), at)
    reader = sinks.read(spark, at)
    sinks._written(rows(7), at)  # a crash before the pointer
    (tmp_path / "t" / "_versions" / "next-0").write_text("v-nothing")  # and one before its rename
    sinks.insert_ignore(rows(2, 3), at, ["id"])
    assert sorted(r[0] for r in sinks.read(spark, at).collect()) == [1, 2, 3] and sorted(r[0] for r in reader.collect()) == [1, 2]
    for k in range(4, 12):
        sinks.insert_ignore(rows(k), at, ["id"])
        assert sorted(r[0] for r in sinks.read(spark, at).collect()) == list(range(1, k + 1))
    assert len(sinks.versions(spark, at)) == sinks.KEPT


def test_old_folders_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_FOLDERS", 2)
    at = str(tmp_path / "t")
    for k in range(8):
        sinks.insert_ignore(spark.createDataFrame([(k,)], "id long"), at, ["id"])
    assert sinks.read(spark, at).count() == 8 and len(sinks.current(spark, at)) <= 2
    assert sum(p.name.startswith("v-") for p in (tmp_path / "t").iterdir()) <= 8


def test_a_batch_is_drained_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        calls.add(1)
        return "some text"

    raw = spark.range(3).select(F.col("id").cast("string").alias("path"))
    drained = raw.select("path", F.col("path").alias("name"), F.lit("held-ocr").alias("lane"), F.lit("OCRed").alias("status"), F.lit(None).cast("string").alias("reason"), seen("path").alias("text"), F.lit("clean").alias("verdict"), F.array().cast("array<struct<label:string,name:string>>").alias("hits"), F.lit("model").alias("tier"))
    for _ in range(2):
        sinks.ingest_batch(drained, str(tmp_path), 0, "k")
    assert calls.value == 3 and spark.read.parquet(f"{tmp_path}/mirror").count() == 3


def test_web_and_transcripts(spark):
    caps = spark.createDataFrame([(1, "https://example.com/a", "text/html; x", "<p>jailbreak me</p>"), (2, "http://example.com", "text/html", "x"), (3, "https://example.com", "image/png", "x"), (4, "https://example.com", "text/plain", " ")], "snapshot_id long, url string, content_type string, html string")
    rows = {r["snapshot_id"]: r for r in files.web_snapshots(caps).collect()}
    assert rows[1]["error"] is None and rows[1]["flags"] == ["injection-marker:jailbreak"] and [rows[k]["error"] for k in (2, 3, 4)] == ["destination refused", "content type refused", "no text"]
    media = spark.createDataFrame([(1, bytearray(b"x" * 25))], "media_id long, content binary")
    said = files.transcribe(media, lambda index, part: F.concat(F.lit("shared words then "), index.cast("string")), 10, 2).first()
    assert said["text"] == "shared words then 0 shared words then 1 shared words then 2" or said["text"].startswith("shared words")

    def broken(q):
        raise OSError

    assert files.search_chain([broken, lambda q: None, lambda q: []], "q") == ([], 2)


def test_stream_windows(spark, sf):
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(f"{sf}/events*.parquet")
    q = jobs.windowed_counts(events).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").count()
    assert spark.table("w").count() == batch.count() and spark.table("w").agg(F.sum("n")).first()[0] == 1000
