"""Frames that a busy detector takes: by hand, against SQL's way of counting, and as a stream that stops and goes on."""

import random

import pytest

from tessera.streaming import cameras

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "camera string, at timestamp, frame long"


def table(spark, rows):
    return spark.createDataFrame([(c, t / 1e6, f) for c, t, f in rows], "camera string, seconds double, frame long").selectExpr("camera", "timestamp_micros(cast(round(seconds * 1000000) as bigint)) AS at", "frame")


def loops(rows, busy, n):
    """All at once: at each start, the latest of what has come."""
    out = []
    for c in sorted({r[0] for r in rows if r[0] is not None}):
        left = sorted((t, f) for k, t, f in rows if k == c and t is not None and f is not None)
        free, dropped, starts = None, 0, []
        while left:
            if free is None or left[0][0] >= free:
                frame, at = left.pop(0), None
                at = frame[0]
                if free is not None and frame[0] == free:  # others of that instant have come as well
                    pass
            else:
                come = [x for x in left if x[0] <= free]
                dropped += len(come) - 1
                frame, at = come[-1], free
                left = left[len(come) :]
            starts.append(at)
            free = at + busy
            last = starts[-n:]
            out.append((c, frame[1], frame[0], at, dropped, (n - 1) * 1e6 / (at - last[0]) if len(last) == n and at > last[0] else None))
    return out


def test_by_hand(spark):
    rows = [("a", 0, 1), ("a", 3, 2), ("a", 5, 3), ("a", 10, 4), ("a", 11, 5), ("a", 40, 6), ("b", 7, 7)]
    got = sorted(map(tuple, cameras.taken(table(spark, rows), "camera", "at", "frame", 10, 2).collect()))
    # 2 and 3 give way to 4, which comes at the moment when the detector is free; 5 waits for 20.
    assert [(c, f, s, d) for c, f, _, s, d, _ in got] == [("a", 1, 0, 0), ("a", 4, 10, 2), ("a", 5, 20, 2), ("a", 6, 40, 2), ("b", 7, 7, 0)]
    assert got[1][5] == pytest.approx(1e5)


@pytest.mark.parametrize("busy", [1, 7, 40])
def test_random_frames_equal_loops(spark, busy):
    rng = random.Random(busy)
    rows = [(rng.choice("abcd"), rng.randrange(400), i) for i in range(200)] + [(None, 1, 900), ("a", 5, None)]
    got = sorted(map(tuple, cameras.taken(table(spark, rows).repartition(5), "camera", "at", "frame", busy, 4).collect()))
    assert got == sorted(loops(rows, busy, 4))
    assert cameras.taken(table(spark, rows).limit(0), "camera", "at", "frame", busy, 4).count() == 0


def test_stream_that_goes_on_from_its_checkpoint(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((t, rng.choice("abc"), i) for i, t in enumerate(rng.sample(range(1000), 120)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        got = []
        for part in range(3):  # three runs, each of a few files; the state is in the checkpoint
            for k in range(2):
                own = rows[40 * part + 20 * k : 40 * part + 20 * k + 20]
                table(spark, [(c, t, i) for t, c, i in own]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = cameras.taken_live(stream, "camera", "at", "frame", 15, 3)
            query = out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("camera", "frame", "arrived", "started", "dropped", "rate").collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    whole = loops([(c, t, i) for t, c, i in rows], 15, 3)
    waiting = {c: [r for r in whole if r[0] == c][-1] for c in "abc"}  # one that waits at the end hasn't come out yet
    assert set(got) <= set(whole) and set(whole) - set(got) <= set(waiting.values())
