"""Streams that are replayed to their end agree with batches; late and repeated rows are handled."""

from pyspark.sql import functions as F

from emberfold.streaming import detections as streams
from emberfold.streaming.progress import Progress


def feed(spark, folder):
    rows = [(i % 7, f"2026-08-05 {10 + i // 6:02d}:{i % 6 * 10:02d}:00", float(i)) for i in range(36)]
    for k in range(3):
        spark.createDataFrame(rows[k * 12 : k * 12 + 12], "key long, at string, frp double").selectExpr("key", "CAST(at AS TIMESTAMP) AS detected_at", "frp").coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def test_windows(spark, tmp_path):
    batch = feed(spark, str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), batch.schema)
    streams.replay(streams.windowed(stream, "1 hour"), str(tmp_path / "w"), "complete")
    last = max((tmp_path / "w/out").glob("batch=*"), key=lambda p: int(p.name[6:]))
    got = {str(r["start"]): r["n"] for r in spark.read.parquet(str(last)).collect()}
    want = {str(r["s"]): r["n"] for r in batch.groupBy(F.date_trunc("hour", "detected_at").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_dedupe_and_restart(spark, tmp_path):
    batch = feed(spark, str(tmp_path / "in"))
    make = lambda: streams.dedupe(streams.read_files(spark, str(tmp_path / "in"), batch.schema), ["key"])
    streams.replay(make(), str(tmp_path / "d"))
    streams.replay(make(), str(tmp_path / "d"))  # nothing new: nothing twice
    assert spark.read.parquet(str(tmp_path / "d/out")).count() == batch.select("key").distinct().count()


def test_sessions(spark, tmp_path):
    batch = feed(spark, str(tmp_path / "in"))
    got = streams.sessions(batch, "2 hours", "key")
    assert got.agg(F.sum("n")).first()[0] == 36


def hours(spark, rows):
    return spark.createDataFrame(rows, "key long, at string, frp double").selectExpr("key", "CAST(at AS TIMESTAMP) AS detected_at", "frp")


def test_late_rows_and_state(spark, tmp_path):
    """Three files, one late: what is too late is dropped and counted, closed windows are given out once, and their state goes."""
    day = lambda d, h, k: (k, f"2026-08-{d:02d} {h:02d}:10:00", float(h))
    first, second = [day(1, h, h % 3) for h in range(12)], [day(2, h, h % 3) for h in range(12)]
    late = [day(1, 3, 0), day(1, 3, 0), day(1, 5, 1), day(2, 10, 2)]
    ahead = hours(spark, [(-1, "2030-01-01 00:00:00", 0.0)])
    with Progress(spark) as told:
        got = streams.arrivals([hours(spark, x).repartition(2) for x in (first, second, late)], str(tmp_path / "s"), lambda s: streams.windowed(s, "1 hour", late="2 hours"), ahead).collect()
    want = {}
    for k, at, frp in [*first, *second, late[3]]:
        want.setdefault(at[:13], []).append(frp)
    assert {str(r["start"])[:13]: (r["n"], r["max_frp"]) for r in got} == {k: (len(v), max(v)) for k, v in want.items()} and len(got) == len(want)
    rows = told.table().collect()
    assert [r["rows_in"] for r in rows if r["rows_in"]] == [12, 12, 4, 1]
    assert [r["dropped"] for r in rows if r["rows_in"]] == [0, 0, 2, 0]  # two windows of late rows
    assert max(r["state_rows"] for r in rows) < 24 and rows[-1]["state_rows"] == 1  # the row that lies ahead
    assert not told.open


def test_sessions_in_parts(spark, tmp_path):
    rows = [[(1, "2026-08-01 00:00:00", 1.0), (2, "2026-08-01 01:00:00", 1.0)], [(1, "2026-08-01 01:00:00", 5.0), (1, "2026-08-01 09:00:00", 2.0)], [(2, "2026-08-01 01:30:00", 9.0)]]
    ahead = hours(spark, [(-1, "2030-01-01 00:00:00", 0.0)])
    got = streams.arrivals([hours(spark, x) for x in rows], str(tmp_path / "s"), lambda s: streams.sessions(s, "2 hours", "key", late="1 hour"), ahead).collect()
    # the late row's run had been given out and is closed: 1:30 and two hours lie before the watermark of 8:00
    assert sorted((r["key"], str(r["start"])[11:13], r["n"], r["max_frp"]) for r in got) == [(1, "00", 2, 5.0), (1, "09", 1, 2.0), (2, "01", 1, 1.0)]
