"""Keyed state: what comes out depends on the steps, not on batches, their order or restarts."""

import datetime as dt
import random

import pytest

from quillspark.streaming import lifecycle

T0, MINUTE = 1_700_000_000_000_000, 60_000_000


def walk(steps, mark, rounds_max=3, window=10 * MINUTE, retries=3):
    """Plain Python: (key, at, event, number) of all steps up to the mark."""
    out = []
    for key in {s[0] for s in steps}:
        rounds, attempts, due = 0, 0, None
        for _, at, _, kind in [*sorted(s for s in steps if s[0] == key and s[1] <= mark), (key, mark, 0, "")]:
            while due is not None and due <= at:
                attempts += 1
                out.append((key, due, "retry", attempts))
                due = due + window if attempts < retries else None
            if kind == "round":
                rounds += 1
                if rounds == rounds_max:
                    out.append((key, at, "completed", rounds))
            elif kind == "fail" and due is None:
                attempts, due = 0, at + window
            elif kind == "settle":
                due = None
    return sorted(out)


def streamed(spark, steps, batches, at, **options):
    """The events of steps that arrive in these batches, each in a run of its own."""
    when = lambda us: dt.datetime.fromtimestamp(us / 1e6, dt.UTC).replace(tzinfo=None)
    for part in batches:
        if part:
            rows = [(k, when(us), n, kind) for k, us, n, kind in part]
            spark.createDataFrame(rows, "key long, at timestamp, seq long, kind string").coalesce(1).write.mode("append").parquet(f"{at}/in")
        arriving = spark.readStream.schema("key long, at timestamp, seq long, kind string").parquet(f"{at}/in")
        lifecycle.run(arriving, f"{at}/out", f"{at}/cp", rounds_max=3, window="10 minutes", late="5 minutes", **options).awaitTermination()
    found = spark.read.schema("key long, at timestamp, event string, number int").parquet(f"{at}/out")
    return sorted(tuple(r) for r in found.selectExpr("key", "unix_micros(at)", "event", "number").collect())


@pytest.fixture()
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_batches_and_lateness_change_nothing(few, tmp_path):
    rng = random.Random(5)
    steps = [(rng.randrange(4), T0 + rng.randrange(120 * 60) * 1_000_000 + rng.randrange(1000), n, rng.choice(["round", "fail", "fail", "settle"])) for n in range(120)]
    steps += [(1, steps[0][1], 900, "fail"), (1, steps[0][1], 901, "settle"), (9, T0, 902, "fail")]  # ties; a key with one step
    mark = (max(s[1] for s in steps) // 1000 - 5 * 60_000) * 1000 + 999
    want = walk(steps, mark)
    assert {e for _, _, e, _ in want} == {"retry", "completed"} and sum(e == "retry" for _, _, e, _ in want) > 20
    by_time = sorted(steps, key=lambda s: s[1])
    # Neighbours swap places within the lateness, across batches too.
    shuffled = sorted(steps, key=lambda s: s[1] + rng.randrange(4 * MINUTE))
    for k, batches in enumerate(([by_time], [shuffled[:50], shuffled[50:100], [], shuffled[100:]])):
        assert streamed(few, steps, batches, str(tmp_path / str(k))) == want


def test_a_timer_at_the_watermark_fires_and_a_second_run_adds_nothing(few, tmp_path):
    steps = [(1, T0, 1, "fail"), (2, T0 + 15 * MINUTE, 2, "round")]  # the watermark ends at T0 + 10 minutes, when the retry is due
    got = streamed(few, steps, [steps, []], str(tmp_path))
    assert got == [(1, T0 + 10 * MINUTE, "retry", 1)]
    # What comes too late is dropped, what is due since then comes out.
    got = streamed(few, steps, [[(1, T0 + 1, 3, "settle"), (2, T0 + 60 * MINUTE, 4, "round")]], str(tmp_path))
    assert got == [(1, T0 + 10 * MINUTE * k, "retry", k) for k in (1, 2, 3)]
