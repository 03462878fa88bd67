"""The stored index: folders of the asked prefixes only, batch by batch, accents and ids."""

import shutil

import pytest
from compare import same
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.functions import text
from quillspark.operators import mirror, search_index

ROWS = [
    (1, 1, "El café está cerrado"), (2, 2, "cafeteria 12 ab"), (3, 3, None), (4, 4, ""), (5, 5, "CAFÉ ñandú 42nd"),
    (777, 6, "nothing here"), (8, 7, "the " * 3000 + "therapy"), (9, 8, "中文 straße O'Neil x_y"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(ROWS, "doc_id long, ord long, text string")
    search_index.extend(df.where("ord <= 4"), at, 0)
    search_index.extend(df.where("ord > 4"), at, 1, start=2)
    return at


def asked(spark, *terms):
    return spark.createDataFrame([(k, [t]) for k, t in enumerate(terms)], "query_id long, terms array<string>")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "place").collect():
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


def test_accents_ids_and_prefixes(spark, index):
    df = spark.createDataFrame(ROWS, "doc_id long, ord long, text string")
    queries = asked(spark, "cafe", "café", "CAFÉ!", "777", "ther", "strasse", "straße", "nand", "ab 12", "neil", "42n", "zzz")
    want = {0: [1, 2, 5], 1: [1, 2, 5], 2: [1, 2, 5], 3: [777], 4: [8], 6: [9], 7: [5], 9: [9], 10: [5]}
    # ß isn't s with a mark: "straße" asks for "stra", which is all that is a-z of it
    assert found(search_index.search(queries, index)) == want
    assert found(search_index.search_unstored(queries, df)) == want
    assert found(mirror.search(df, queries, index=index)) == want
    assert found(search_index.search(asked(spark, "cafe"), index, limit=2)) == {0: [1, 2]}


def test_vocabulary_counts_documents_of_all_batches(spark, index):
    words = spark.createDataFrame([("caf",), ("the",)], "word string")
    rows = {(r["word"], r["token"]): r["docs"] for r in search_index.vocabulary(spark, index, words).collect()}
    assert rows == {("caf", "cafe"): 2, ("caf", "cafeteria"): 1, ("the", "the"): 1, ("the", "therapy"): 1}


def test_a_search_reads_the_folders_of_its_prefixes(spark, index):
    plan = search_index.postings(spark, index, spark.createDataFrame([("cafe",)], "word string"))
    assert {f.rpartition("/start=")[2].split("/")[0] for f in plan.inputFiles()} >= {"c", "ca"}
    text_of_plan = plan._jdf.queryExecution().executedPlan().toString()
    filters = text_of_plan[text_of_plan.index("PartitionFilters") :].split("]")[0]
    assert "start" in filters and "ca" in filters
    assert "GreaterThanOrEqual(token,cafe)" in text_of_plan
    assert plan.count() == 3


def test_a_batch_reads_no_other_and_comes_once(spark, index, tmp_path):
    at = str(tmp_path / "i")
    shutil.copytree(index, at)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    for p in (tmp_path / "i" / "postings" / "batch=0").rglob("*.parquet"):
        p.write_bytes(b"not parquet")  # reading it would fail
    df = spark.createDataFrame([(50, 50, "cafezinho")], "doc_id long, ord long, text string")
    search_index.extend(df, at, 2)
    search_index.extend(df.withColumn("text", F.lit("never")), at, 2)
    assert sinks.committed(spark, at) == [0, 1, 2]
    assert {p for p in before if "batch=0" not in str(p)} <= {p for p in (tmp_path / "i").rglob("*.parquet") if before.get(p) == p.stat().st_mtime_ns}


def test_a_batch_without_its_mark_is_not_seen(spark, index, tmp_path):
    at = str(tmp_path / "i")
    shutil.copytree(index, at)
    next((tmp_path / "i" / "commits").glob("1")).unlink()
    assert found(search_index.search(asked(spark, "cafe"), at)) == {0: [1, 2]}
    df = spark.createDataFrame([(60, 60, "cafe latte")], "doc_id long, ord long, text string")
    search_index.extend(df, at, 1)  # what was left of the batch is written anew
    assert found(search_index.search(asked(spark, "cafe"), at)) == {0: [1, 2, 60]}


def test_empty_batches_and_queries(spark, tmp_path):
    at = str(tmp_path / "none")
    with pytest.raises(ValueError):
        search_index.search(asked(spark, "cafe"), at)
    search_index.extend(spark.createDataFrame([], "doc_id long, ord long, text string"), at, 0)
    assert search_index.search(asked(spark, "cafe", "x"), at).count() == 0


def test_unaccented_agrees_with_sql(spark):
    import duckdb

    letters = "".join(text.ACCENTED) + "ßøłđæ plain é"
    mine = spark.createDataFrame([(letters,)], "t string").select(text.unaccented(F.col("t")).alias("t"))
    theirs = duckdb.sql("SELECT lower(strip_accents(?)) AS t", params=[letters]).fetchall()
    same(mine, ["t"], theirs)


def test_a_word_meets_its_tokens_once_for_all_queries(spark, tmp_path):
    """Queries with the same word don't each meet all tokens that begin with it; long words are told apart behind their first characters."""
    many = [(k, k, f"common{k} deinstitutionalisation{k}") for k in range(40)]
    at = str(tmp_path / "index")
    search_index.extend(spark.createDataFrame(many, "doc_id long, ord long, text string"), at, 0)
    queries = spark.createDataFrame([(k, ["common"]) for k in range(50)] + [(50, ["deinstitutionalisation7"]), (51, ["deinstitutionalisatiom"])], "query_id long, terms array<string>")
    out = search_index.search(queries, at)
    got = found(out)
    assert got == {k: [0, 1, 2, 3] for k in range(50)} | {50: [7]}
    ran = out._jdf.queryExecution().executedPlan()
    out._jdf.queryExecution().executedPlan().executeCollect()
    rows = []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage") or node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            walk(node.plan())
        metrics = node.metrics()
        if "Join" in node.nodeName() and metrics.contains("numOutputRows"):
            rows.append(metrics.apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(ran)
    assert rows and max(rows) <= 4 * 50 + 100  # before, 50 queries met 40 tokens each
