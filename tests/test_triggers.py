"""Debounce with flush: the batch operator against a plain version, the stream against the batch operator."""

import random
from datetime import datetime, timedelta

import pytest

from srcatlas.operators import incremental
from srcatlas.streaming import triggers

START = datetime(2024, 1, 1)
SCHEMA = "path string, op string, ts timestamp"


def at(ms):
    return START + timedelta(milliseconds=ms)


def plain(rows, quiet):
    """What fires, event by event: one pending trigger a path, replaced by each later event, cancelled by a flush."""
    out = []
    for path in {r[0] for r in rows}:
        pending = None
        for ts, op in sorted((ts, op == "flush") for p, op, ts in rows if p == path):
            if pending is not None and ts - pending >= quiet:
                out.append((path, "trigger", pending))
            pending = None if op else ts
            if op:
                out.append((path, "flush", ts))
        if pending is not None:
            out.append((path, "trigger", pending))
    return sorted(out)


def mixed(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice("abc"), rng.choice(["trigger"] * 5 + ["flush"]), at(rng.randrange(0, 9000, 50))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_batch(spark, seed):
    rows = mixed(seed)
    odd = [(None, "flush", at(1)), ("a", "flush", None), ("q", None, at(5))]
    got = incremental.debounced_with_flush(spark.createDataFrame(rows + odd, SCHEMA), 0.15)
    assert sorted((r.path, r.op, r.ts) for r in got.collect()) == sorted([*plain(rows, timedelta(milliseconds=150)), ("q", "trigger", at(5))])
    assert got.filter("fired_at <> ts + case when op = 'flush' then interval 0 seconds else interval 150 milliseconds end").isEmpty()
    assert incremental.debounced_with_flush(spark.createDataFrame([], SCHEMA), 0.15).isEmpty()


def run(spark, folder, name, table):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / name))
    writer = triggers.debounced_with_flush(stream, 150, "10 seconds").writeStream.outputMode("append").format("parquet").option("path", str(folder / table))
    q = writer.option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(150) and q.exception() is None
    return [(r.path, r.op, r.ts) for r in spark.read.schema(triggers.FIRED).parquet(str(folder / table)).collect()]


def test_stream_with_flush_late_rows_and_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    try:
        rows = mixed(7)  # in no order of time, all within the watermark's delay
        put(rows[:60])
        got = run(spark, tmp_path, "in", "out")
        assert {x for x in got if x[1] == "flush"} == {x for x in plain(rows[:60], timedelta(milliseconds=150)) if x[1] == "flush"}  # at once
        assert not [x for x in got if x[1] == "trigger"]  # none is sure yet
        put(rows[60:])  # a new query goes on from the checkpoint
        run(spark, tmp_path, "in", "out")
        put([("end", "trigger", at(60_000))])  # the watermark passes all of them
        run(spark, tmp_path, "in", "out")
        put([("a", "flush", at(100)), ("end", "trigger", at(61_000))])  # too late
        got = run(spark, tmp_path, "in", "out")
        assert sorted(x for x in got if x[0] != "end") == plain(rows, timedelta(milliseconds=150))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
