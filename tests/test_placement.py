"""Multi-probe slots in a stream and by lines, against slow tables."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillon.operators import remap, transformers
from quillon.streaming import streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def slow(homes, rows, room, probe, ttl, dispatch):
    """Every bucket as two dictionaries."""
    owner, until, out = {}, {}, []
    for hour, i in sorted(set(rows)):
        b, home = homes[i]
        places = [(b, (home + j) % room) for j in range(min(probe, room))]
        mine, free = [p for p in places if owner.get(p) == i], [p for p in places if p not in owner]
        old = [p for p in places if until.get(p, 0) < hour] if dispatch == "threshold" else sorted(places, key=lambda p: until.get(p, 0))
        kind, found = next(((k, f[0]) for k, f in (("hit", mine), ("inserted", free), ("evicted", old)) if f), ("collided", (b, home)))
        if kind != "collided":
            owner[found], until[found] = i, hour + ttl
        out.append((i, hour, b * room + found[1], kind))
    return sorted(out)


def made(seed, n=300, hours=60):
    rng = random.Random(seed)
    hour = lambda: int(rng.random() * hours)
    return [(rng.randrange(40) if rng.random() > 0.3 else 5, hour(), rng.randrange(3600)) for _ in range(n)]


def homes_of(spark, buckets, room):
    bucket, home = remap.probe_home(F.col("id"), buckets, room)
    return {r[0]: (r[1], r[2]) for r in spark.range(200).select("id", bucket, home).collect()}


@pytest.mark.parametrize("dispatch", remap.ProbeTable.DISPATCH)
@pytest.mark.parametrize("size, buckets, probe", [(16, 2, 3), (64, 16, 4), (8, 1, 20)])
def test_probed_equals_a_slow_table(spark, dispatch, size, buckets, probe):
    rows, start = made(size), 1_000
    df = spark.createDataFrame([(i, start + h) for i, h, _ in rows], "id long, hour long").repartition(5)
    got = sorted(map(tuple, remap.probed(df, size, buckets, probe, 4, dispatch).collect()))
    assert got == slow(homes_of(spark, buckets, size // buckets), [(start + h, i) for i, h, _ in rows], size // buckets, probe, 4, dispatch)
    assert dispatch == "threshold" or not [r for r in got if r[3] == "collided"]


@pytest.mark.parametrize("seed, cuts, dispatch", [(1, 1, "threshold"), (2, 5, "threshold"), (3, 4, "oldest")])
def test_stream_equals_the_table_however_it_is_cut(spark, tmp_path, seed, cuts, dispatch):
    rng = random.Random(seed)
    rows = sorted(made(seed), key=lambda r: r[1] * 3600 + r[2] + rng.randrange(3000))  # out of order within the watermark
    rows = [(i, START + timedelta(hours=h, seconds=s)) for i, h, s in rows]
    ends = sorted(rng.sample(range(1, len(rows)), cuts - 1))
    for n, (a, b) in enumerate(zip([0, *ends], [*ends, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b] + ([(None, START)] if n == 0 else []), "id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(150, START + timedelta(hours=500))], "id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # ends all hours
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    for n, f in enumerate(files):
        import os

        os.utime(f, (1_700_000_000 + n * 10, 1_700_000_000 + n * 10))
    source = streams.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "id long, ts timestamp").schema)
    out = streams.run_available(streams.probe_stream(streams.event_time(source, late="1 hour"), 16, 2, 3, 4, dispatch), f"probes{seed}", checkpoint=str(tmp_path / "c"))
    base = int(START.timestamp()) // 3600
    want = slow(homes_of(spark, 2, 8), [(base + int((t - START).total_seconds()) // 3600, i) for i, t in rows], 8, 3, 4, dispatch)
    assert sorted(map(tuple, out.filter("id <> 150").collect())) == want


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = [(n % 30, START + timedelta(minutes=17 * n)) for n in range(200)]
    schema = spark.createDataFrame([], "id long, ts timestamp").schema
    for n, part in enumerate((rows[:90], rows[90:] + [(150, START + timedelta(hours=500))])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = streams.file_stream(spark, str(tmp_path / "in"), schema)
        q = streams.probe_stream(streams.event_time(source, late="1 hour"), 16, 2, 3, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    base = int(START.timestamp()) // 3600
    want = slow(homes_of(spark, 2, 8), [(base + int((t - START).total_seconds()) // 3600, i) for i, t in rows], 8, 3, 4, "threshold")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).filter("id <> 150").select("id", "hour", "slot", "kind").collect())) == want


def test_lines_equal_a_slow_table(spark):
    lines, width, rng = 3, 4, random.Random(4)
    where = {r[0]: (r[1], r[2]) for r in spark.range(60).select("id", *transformers._line(F.col("id"), lines, width)).collect()}
    state, want = spark.createDataFrame([], transformers.STATE), {}
    for time in range(4):
        rows = [(rng.randrange(60) if rng.random() < 0.7 else 1, n) for n in range(12)]
        ids = spark.createDataFrame(rows + [(None, 0)], "id long, at long").repartition(3)
        done, state = transformers.lined(state, ids, lines, width, time, "at")
        state = spark.createDataFrame(state.collect(), transformers.STATE)
        for i, _ in sorted(rows, key=lambda r: r[1]):
            line, home = where[i]
            if i not in want:
                free = [line * width + (home + j) % width for j in range(width) if line * width + (home + j) % width not in want.values()]
                if free:
                    want[i] = free[0]
        assert {r["id"]: r["slot"] for r in state.collect()} == want
        assert sorted(((r["id"], r["slot"]) for r in done.collect()), key=str) == sorted([(i, want.get(i)) for i, _ in rows] + [(None, None)], key=str)
        records = {r["id"]: r["record"] for r in state.collect()}
        assert all(transformers_time(records[i]) == time for i, _ in rows if i in want)
        if time == 1:
            gone = transformers.least_used_of_lines(state, width, 1)
            dropped = [r["id"] for r in gone.collect()]
            assert len({want[i] // width for i in dropped}) == len(dropped) == len({s // width for s in want.values()})
            assert all(records[i] == min(records[j] for j in want if want[j] // width == want[i] // width) for i in dropped)
            state = spark.createDataFrame(state.join(gone.select("id"), "id", "left_anti").collect(), transformers.STATE)
            want = {i: s for i, s in want.items() if i not in dropped}


def transformers_time(record):
    return record & ((1 << transformers.TIME_BITS) - 1)
