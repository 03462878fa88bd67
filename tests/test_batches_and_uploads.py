"""Uploads that are bounded and whole, and readers that see whole batches only."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.sources import bounded, files


def chunked(spark, objects, size=7):
    rows = [(name, k, bytearray(data[k * size : (k + 1) * size])) for name, data in objects for k in range(max(1, -(-len(data) // size)))]
    return spark.createDataFrame(rows, "object string, part int, content binary").repartition(5)


def test_uploads_are_equal_or_absent(spark, tmp_path):
    at = str(tmp_path / "up")
    objects = [(f"a/{k} %é", bytes(range(k % 256)) * 3) for k in range(60)] + [("empty", b""), ("edge", b"x" * 300), ("over", b"x" * 301), ("long " * 100, b"1"), (None, b"no name")]
    bounded.upload(chunked(spark, objects), at, 300)
    told = {r["object"]: r for r in bounded.report(spark, at).collect()}
    kept = {r["object"]: bytes(r["content"]) for r in bounded.stored(spark, at).where("object is not null").collect()}
    small = {n: d for n, d in objects if len(d) <= 300 and n is not None}
    assert kept == small and set(told) == {n for n, _ in objects} and told["over"]["status"] == "refused" and 300 < told["over"]["n_bytes"] <= 307
    assert not list((tmp_path / "up").glob("_staging/*")) and len(list((tmp_path / "up").rglob("o-*"))) == len(small)
    bounded.upload(chunked(spark, [("empty", b"again")]), at, 300)  # a second upload of the same name is another one
    assert sorted(bytes(r["content"]) for r in bounded.stored(spark, at).where("object = 'empty'").collect()) == [b"", b"again"]


def test_objects_are_read_from_reports_without_being_listed(spark, tmp_path):
    at = str(tmp_path / "up")
    bounded.upload(chunked(spark, [(f"o{k}", b"data %d" % k) for k in range(30)]), at, 100)
    files_ = bounded.report(spark, at).inputFiles() + bounded.stored(spark, at).inputFiles()
    assert files_ and all(f.endswith("report.parquet") for f in files_)  # before, every object's file was one too
    plan = bounded.stored(spark, at)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    next((tmp_path / "up").rglob("o-*")).write_bytes(b"")  # a file that lost its bytes is no object
    with pytest.raises(Exception, match="0 bytes of"):
        bounded.stored(spark, at).collect()


def test_a_failing_task_leaves_no_part(spark, tmp_path):
    at = str(tmp_path / "up")
    broken = chunked(spark, [(f"o{k}", b"0123456789") for k in range(40)]).withColumn("content", F.when(F.col("object") == "o17", F.raise_error(F.lit("broken source"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken source"):
        bounded.upload(broken, at, 100)
    assert not list((tmp_path / "up").rglob("o-*")) and not list((tmp_path / "up").glob("upload-*"))


def test_only_winning_attempts_are_committed(tmp_path):
    w = bounded.BoundedWriter(str(tmp_path), 10)
    for folder in ("0-1", "0-2"):
        (tmp_path / "_staging" / w.job / folder / "objects").mkdir(parents=True)
        (tmp_path / "_staging" / w.job / folder / "objects" / "o-x").write_bytes(folder.encode())
    w.commit([bounded.Written("0-2", 1, 0)])
    assert [p.read_bytes() for p in tmp_path.rglob("o-x")] == [b"0-2"] and len(list(tmp_path.glob("upload-*"))) == 1


def drained(spark, rows):
    schema = "path string, name string, lane string, status string, reason string, text string, verdict string, hits array<struct<label string, name string>>, tier string"
    return spark.createDataFrame([(p, p, "native", s, None if s != "held" else "no model", t, "gated" if h else "clean", h, "native") for p, s, t, h in rows], schema)


def test_a_reader_sees_whole_batches(spark, tmp_path, monkeypatch):
    at, hit = str(tmp_path / "in"), [("[person A]", "Ann Lee")]
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    sinks.ingest_batch(drained(spark, [("a", "parsed", "[person A] came", hit), ("b", "held", None, [])]), at, 1, "key", now)
    seen = sinks.Batches(spark, at)
    # The second batch stops between two tables: the mirror is written, the entities aren't.
    with monkeypatch.context() as m:
        m.setattr(sinks, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            sinks.ingest_batch(drained(spark, [("b", "OCRed", "[person A] left", hit)]), at, 2, "key", now)
    assert (tmp_path / "in" / "mirror" / "batch=2").exists()
    for view in (seen, sinks.Batches(spark, at)):
        assert view.ids == [1] and view.mirror().count() == 1 and view.entities().count() == 1
        assert {r["path"]: (r["status"], r["raw_key"], str(r["retry_after"])) for r in view.docs().collect()} == {"a": ("parsed", None, "None"), "b": ("held", "b", "2024-05-08 00:00:00")}
    sinks.ingest_batch(drained(spark, [("b", "OCRed", "[person A] left", hit)]), at, 2, "key", now)  # taken up again
    after = sinks.Batches(spark, at)
    assert {r["path"]: (r["status"], r["raw_key"], r["retry_after"]) for r in after.docs().collect()} == {"a": ("parsed", None, None), "b": ("OCRed", None, None)}
    assert after.mirror().count() == 2 and seen.mirror().count() == 1  # the older view stays as it was
    with pytest.raises(ValueError):
        sinks.Batches(spark, str(tmp_path / "none")).docs()


def test_a_drain_parses_each_file_once(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [(f"/in/{k}.txt", f"{k}.txt", "native", None, bytearray(f"text {k}".encode())) for k in range(20)] + [("/in/p.png", "p.png", "held-ocr", "needs OCR", bytearray(b"png"))]
    raw = spark.createDataFrame(rows, "path string, name string, lane string, reason string, content binary").repartition(3)

    @F.udf("binary")
    def counted(content):  # what stands before the parsers runs as often as they do
        with open(log, "a") as f:
            f.write(hashlib.sha256(bytes(content)).hexdigest() + "\n")
        return content

    out = files.drain(raw.withColumn("content", counted("content")), {"held-ocr": lambda name, content: F.concat(F.lit("seen "), F.decode(content, "UTF-8")), "held-pdf": lambda name, content: F.lit("pdf")})
    got = {r["name"]: (r["status"], r["text"]) for r in out.collect()}
    assert got["3.txt"] == ("parsed", "text 3") and got["p.png"] == ("OCRed", "seen png")
    assert len(open(log).read().split()) == 21 and "parsed(" not in out._jdf.queryExecution().executedPlan().toString()
