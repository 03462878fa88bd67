import random

from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.functions import ddl, text
from quillspark.operators import audit
from quillspark.sources import files, parsers


def test_ddl_tokens_hide_what_is_in_them():
    found = ddl.scan("""
    -- CREATE TABLE a (x_envelope TEXT);
    /* CREATE TABLE b (y_envelope TEXT); */
    INSERT INTO t VALUES ('CREATE TABLE c (z TEXT)');
    create temp table if not exists "my ""table" (id INTEGER, `back tick` TEXT, [bracketed] TEXT DEFAULT 'a,b)(',
      n NUMERIC(10, 2) CHECK (n > 0 AND f(n, 1)), CONSTRAINT c UNIQUE (id, n), PRIMARY KEY (id), foreign key (n) references o(p),
      "unique" TEXT, last_envelope TEXT -- trailing, comment
    );
    CREATE TABLE db.main.t2(filename TEXT,x TEXT);CREATE INDEX i ON t2 (x, filename);
    CREATE TABLE t3 AS SELECT 1; CREATE TABLE""")
    assert found == [('my "table', c) for c in ("id", "back tick", "bracketed", "n", "unique", "last_envelope")] + [("t2", "filename"), ("t2", "x")]
    assert ddl.scan("") == [] and ddl.scan("CREATE TABLE t (a TEXT, 'open") == [("t", "a"), ("t", "'open")] and ddl.scan("CREATE TABLE t (a") == [("t", "a")]


def test_sealed_and_uncovered_columns(spark):
    df = spark.createDataFrame([("CREATE TABLE a (x_envelope TEXT, filename TEXT, y TEXT)",), ("CREATE TABLE b (z_envelope TEXT)",), (None,), ("",)], "ddl string")
    assert {tuple(r) for r in audit.sealed_by_ddl(df).collect()} == {("a", "x_envelope"), ("a", "filename"), ("b", "z_envelope")}
    audited = spark.createDataFrame([("a", "x_envelope"), ("b", "filename")], "table_name string, column_name string")
    assert {tuple(r) for r in audit.uncovered_by(df, audited).collect()} == {("a", "filename"), ("b", "z_envelope")}


def test_stitching_against_the_fold(spark):
    rng, rows = random.Random(3), []
    for media in range(60):
        words = [rng.choice(["a", "B", "b", "c", "dd"] if media % 2 else [f"w{k}" for k in range(300)]) for _ in range(rng.randrange(1, 200))]
        at, index = 0, 0
        while at < len(words):
            size, share = (rng.randrange(17, 40), rng.randrange(0, 16)) if media % 3 else (rng.randrange(1, 20), rng.randrange(0, 3))
            part = [w.upper() if rng.random() < 0.2 else w for w in words[max(0, at - share) : at + size]]
            rows.append((media, index, "  ".join(part)))
            at, index = at + size, index + 1
    rows += [(100, 0, "only one"), (101, 0, ""), (101, 1, ""), (102, 0, "one " * 20), (102, 1, None), (103, 0, "x " * 40), (103, 1, "x " * 40)]
    want = {}
    for media in {r[0] for r in rows}:
        parts = [r[2] for r in sorted(r for r in rows if r[0] == media)]
        want[media] = None if None in parts else parsers.stitch(parts)
    df = spark.createDataFrame(rows, "media_id long, index int, words string").repartition(7)
    assert {r["media_id"]: r["text"] for r in files.stitch_chunks(df).collect()} == want
    assert files.stitch_chunks(df.limit(0)).count() == 0


def test_reports_are_files_of_their_own(spark, tmp_path):
    at = str(tmp_path / "out")
    df = spark.createDataFrame([(k % 3, k, f"line {k}") for k in range(30)], "report long, place long, body string").repartition(5)
    for _ in range(2):
        sinks.export_reports(df, at, "report", "place")
    got = {p.name: [f.read_text().split("\n")[:-1] for f in p.glob("*.txt")] for p in (tmp_path / "out").glob("report=*")}
    assert got == {f"report={r}": [[f"line {k}" for k in range(r, 30, 3)]] for r in range(3)}


def test_a_plus_sign_in_a_header_is_itself(spark):
    rows = spark.createDataFrame([("a+b%20c",), ("%zz+",), (None,), ("x" * 300,)], "h string").select(text.file_name(F.col("h")).alias("n")).collect()
    assert [r["n"] for r in rows] == ["a+b c", "%zz+", "attachment", "x" * 256]
