import random

import pytest
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.functions import crypto
from quillspark.operators import entities, ledger

H = {n: format(k, "x") * 64 for k, n in enumerate(("ann", "bob", "lost"), 10)}


@pytest.fixture()
def names(spark):
    rows = [("s2", "[person A]", "Ann Lee", H["ann"]), ("s1", "[person B]", "Ann Lee", H["ann"]), ("s1", "[person B]", "Ann Lee", H["ann"]), ("s3", "[person A]", "Bob", H["bob"])]
    df = spark.createDataFrame(rows, "submission_id string, label string, name string, name_hmac string")
    sealed = df.select("submission_id", "label", crypto.seal(F.col("name"), F.lit("k" * 32)).alias("name_envelope"), "name_hmac")
    return sealed.union(spark.createDataFrame([("s4", "[person A]", "v1.broken.x", "d" * 64)], sealed.schema))


def asked(spark, *rows):
    return spark.createDataFrame([(*r, "editor", "court order") for r in rows], "request_id string, name_hmac string, revealed_by string, reason string")


def test_no_name_without_its_record(spark, names, tmp_path, monkeypatch):
    at, key, now = str(tmp_path / "audit"), F.lit("k" * 32), F.lit("2024-05-01 00:00:00").cast("timestamp")
    requests = asked(spark, ("r1", H["ann"]), ("r2", H["lost"]), ("r3", "no hash"), ("r4", "d" * 64), ("r5", H["ann"]))
    with monkeypatch.context() as m:  # the record can't be written
        m.setattr(sinks, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("full")))
        with pytest.raises(RuntimeError):
            entities.open_names(names, requests, key, at, now)
    assert sinks.read(spark, at) is None
    for _ in range(2):
        out = {r["request_id"]: r for r in entities.open_names(names, requests, key, at, now).collect()}
        assert out["r1"]["name"] == out["r5"]["name"] == "Ann Lee" and [tuple(x) for x in out["r1"]["links"]] == [("s1", "[person B]"), ("s2", "[person A]")]
        assert {k: r["error"] for k, r in out.items()} == {"r1": None, "r2": "not_found", "r3": "invalid_hmac", "r4": "unreadable", "r5": None} and all(out[k]["name"] is None for k in ("r2", "r3", "r4"))
    kept = entities.reveals(spark, at, key).collect()
    assert sorted(r["request_id"] for r in kept) == ["r1", "r4", "r5"] and {(r["revealed_by"], r["reason"]) for r in kept} == {("editor", "court order")}
    assert "Ann" not in str(sinks.read(spark, at).collect())
    # An id that stands for another hash opens nothing.
    stolen = entities.open_names(names, asked(spark, ("r1", H["bob"])), key, at, now).first()
    assert stolen["name"] is None and stolen["error"] == "not_recorded" and entities.reveals(spark, at, key).count() == 3


def test_links_of_a_name_are_stored_once(spark, tmp_path):
    at, key = str(tmp_path / "audit"), F.lit("k" * 32)
    rows = [(f"s{k}", "[person A]", "v1.broken.x", H["ann"]) for k in range(50)]
    held = spark.createDataFrame(rows, "submission_id string, label string, name_envelope string, name_hmac string")
    requests = asked(spark, *((f"r{k}", H["ann"]) for k in range(40)))
    for _ in range(2):
        out = entities.open_names(held, requests, key, at).collect()
        assert {r["n_links"] for r in out} == {50} and {len(r["links"]) for r in out} == {50}
    assert entities.records(spark, at).count() == 40 and sinks.read(spark, f"{at}/links").count() == 50  # before, each of the 40 records held all 50
    # A later request finds one link more; records that are there keep theirs.
    more = held.union(spark.createDataFrame([("s99", "[person B]", "v1.broken.x", H["ann"])], held.schema))
    entities.open_names(more, asked(spark, ("r99", H["ann"])), key, at)
    told = {r["request_id"]: [x["submission_id"] for x in r["links"]] for r in entities.reveals(spark, at, key).collect()}
    assert told["r0"] == sorted(f"s{k}" for k in range(50)) and told["r99"] == [*told["r0"], "s99"]
    assert not [c for c in entities.records(spark, at).columns if c == "links"]


def test_steps_go_forward_only(spark):
    rng = random.Random(2)
    rows = [(k, n, rng.randrange(5), rng.random() < 0.5, rng.choice([None, "a", "b"])) for k in range(12) for n in range(rng.randrange(1, 15))]
    rows = [(k, n, w, min(4, w + up), c) for k, n, w, up, c in rows]
    want = {}
    for k in {r[0] for r in rows}:
        at, version, last = 0, 1, None
        for _, n, wants, leaves, copy in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            ok = wants >= at
            if ok and copy is not None:
                version += last is not None and copy != last
                last = copy
            want[k, n] = (at, ok, version)
            at = leaves if ok and leaves > at else at
    df = spark.createDataFrame(rows, "who int, n int, wants int, leaves int, copy string").repartition(5)
    got = {(r["who"], r["n"]): (r["at"], r["accepted"], r["version"]) for r in ledger.forward_steps(df, "who", ["n"], "wants", "leaves", "copy").collect()}
    assert got == want
