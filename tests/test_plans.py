"""Searches and proposals join on keys: with broadcasts off no plan compares everything with everything."""

import pytest
from pyspark.sql import functions as F

from quillspark.lineage import numbered
from quillspark.operators import angles, mirror
from quillspark.plans.registry import Tables, topics_of


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loops(spark, sf, no_broadcast):
    t = Tables(spark, sf)
    docs = t.documents.withColumn("ord", F.col("doc_id"))
    named = t.benchmark.select(F.col("item_id").alias("snippet_id"), F.col("text").alias("snippet"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.array("text").alias("terms"))
    for df in (mirror.search(docs, asked), mirror.ground_by_words(named, docs), mirror.ground_by_characters(named, docs), angles.propose(topics_of(t), docs.select("doc_id", "text", "ord"))):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_snippets_of_all_lengths_have_the_same_holders(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    words = ["a", "is", "the", "tion", "the ", " th", "thing", "e the", "\n", "zzzz", "Ä", "of the", ""]
    some = [(k, w) for k, w in enumerate(words)] + [(100 + r["doc_id"], r["text"][7:60]) for r in docs.limit(10).collect()]
    named = spark.createDataFrame(some, "snippet_id long, snippet string")
    want = sorted((k, r["doc_id"]) for r in docs.collect() for k, w in some if w and w in r["text"])
    for most in (1 << 20, 0):
        assert sorted(map(tuple, mirror.holders(named, docs, most_bytes=most).collect())) == want


def test_numbered_is_a_total_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
    rows = numbered(df, [F.col("k")], "place").collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["place"])] == sorted(r["k"] for r in rows) and {r["place"] for r in rows} == set(range(1, 5001))
    assert numbered(df.limit(0), [F.col("k")], "place").count() == 0
