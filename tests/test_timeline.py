"""Bodies in parts are the bodies."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.plans import reports


@pytest.mark.parametrize("strict", [False, True])
def test_parts_and_digests_are_those_of_whole_bodies(spark, strict):
    cite = [("d1", "said")]
    rows = [("a", k % 90, "2024-01-01", f"label {k} é" * 30, f"text {k}", cite if k % 3 else []) for k in range(200)] + [("b", 1, "x", "y", None, cite), ("c", None, "x", "y", "z", []), ("c", 2, None, "y", "z", cite), ("c", 3, "x", "y", "last", cite)]
    entries = spark.createDataFrame(rows, "report_type string, position int, date string, label string, paragraph string, citations array<struct<doc_id string, snippet string>>").repartition(4)
    want = {r["report_type"]: r["body"] for r in reports.stored_timeline(entries, strict).collect()}
    parts = reports.timeline_parts(entries, strict, most=1000)
    got = {}
    for r in parts.orderBy("range", "part").collect():
        got.setdefault(r["report_type"], []).append(r["body"])
    assert {k: "\n".join(x for x in v if x is not None) for k, v in got.items()} == want and len(got["a"]) > 20
    assert parts.agg(F.max(F.length("body"))).first()[0] < 1500  # no task holds a report
    assert {r["report_type"]: r["digest"] for r in reports.body_digests(parts).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
