"""Feeds and assets over small files and tables."""

import json

import pytest
from pyspark.sql import functions as F

from emberfold.operators import assets
from emberfold.sources import feeds

BOX = (((28.0, 36.0), (31.0, 36.0), (31.0, 41.0), (28.0, 41.0)),)


def test_archive(spark, tmp_path):
    row = "{},{},330.1,1.1,0.6,2026-08-05,{},N,VIIRS,{},2.0NRT,290.0,{},D"
    lines = [",".join(feeds.ARCHIVE), row.format(40.0, 29.0, 935, "high", 45.0), row.format(40.0, 29.0, 935, "high", 55.0), row.format(40.0, 50.0, 935, "low", 5), row.format("x", 29.0, 935, "low", 5)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    load = lambda p: lambda: feeds.load_archive(spark, str(tmp_path / "a.csv"), p, "TR", BOX)
    assert load("VIIRS_NOAA20_NRT")().count() == 2

    def down():
        raise OSError("down")

    out, failed, status = feeds.load_all({"a": load("VIIRS_NOAA20_NRT"), "b": load("VIIRS_SNPP_NRT"), "c": down})
    got = {r["product"]: r for r in out.collect()}
    assert set(got) == {"VIIRS_NOAA20_NRT", "VIIRS_SNPP_NRT"} and all(r["frp"] == 55.0 for r in got.values())
    assert failed == {"c": "down"} and status == "warn"
    assert feeds.load_all({"c": down}) == (None, {"c": "down"}, "error")
    counts = feeds.load_counts(load("P")()).first()
    assert (counts["valid"], counts["deduplicated"]) == (2, 1)


def test_fire_power(spark, tmp_path):
    f = lambda i, **p: {"type": "Feature", "id": i, "geometry": {"type": "Point", "coordinates": [29.0, 40.0]}, "properties": {"time": "2026-08-05T10:00:00Z", **p}}
    for k, fs in enumerate(([f("a", FRP=22.5, Satellite="S3A"), f("b", FRP=61.2, Satellite="S3B")], [f("b", FRP=61.2, Satellite="S3B"), {**f("c", FRP=1), "geometry": None}])):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    got = feeds.load_fire_power(spark, str(tmp_path), "sentinel3a-slstr", "SLSTR L2P FRP", "TR", BOX)
    assert sorted((r["satellite"], r["frp"]) for r in got.collect()) == [("S3A", 22.5), ("S3B", 61.2)]
    assert {r["source_id"] for r in feeds.by_satellite(got).collect()} == {"sentinel3a-slstr", "sentinel3b-slstr"}


def test_requests():
    assert feeds.request("29,37,30,38", 9, (26, 36, 45, 42)) == ((29.0, 37.0, 30.0, 38.0), 5)
    for bad in ("29,37,50,38", "30,37,29,38", "1,2,3"):
        with pytest.raises(ValueError):
            feeds.request(bad, 1, (26, 36, 45, 42))


def test_states(spark):
    states = spark.createDataFrame([("a", 3, "ok"), ("b", 1, "loading"), ("c", 9, "ok"), ("d", 1, "ok")], "source_id string, seq long, status string")
    loads = spark.createDataFrame([("a", 4, True, 0), ("b", 2, False, 0), ("c", 5, True, 0)], "source_id string, seq long, failed boolean, n long")
    assert {r["source_id"]: r["status"] for r in feeds.update_states(states, loads).collect()} == {"a": "stale", "b": "empty", "c": "ok", "d": "ok"}


def test_assets(spark):
    lines = spark.createDataFrame([("x", [[[1.0, 1.0], [2.0, 2.0]], [[3.0, 3.0], [3.0, 3.0]]]), ("y", [[[1.0, 1.0], [2.0, 2.0]], [[5.0, 5.0], [6.0, 6.0]]])], "asset_id string, parts array<array<array<double>>>")
    assert sorted(r["asset_id"] for r in assets.line_parts(lines).collect()) == ["x", "y-1", "y-2"]
    pts = spark.createDataFrame([([[50.0, 50.0], [29.0, 40.0]],), ([[50.0, 50.0]],)], "p array<array<double>>")
    assert [r["i"] for r in pts.select(assets.any_vertex_inside(F.col("p"), BOX).alias("i")).collect()] == [True, False]
    keys = spark.createDataFrame([("id", "1", "n", 400.0, "o"), ("", "7", "n", 400.0, "o"), (None, None, "n", 400.0, "o"), (None, "", "", 400.0, "o")], "a string, o string, n string, kv double, op string")
    got = [r["k"] for r in keys.select(assets.asset_key(*map(F.col, ("a", "o", "n", "kv", "op"))).alias("k")).collect()]
    assert got == ["id", "line:7", "line:n", 'line:["400.0","o"]']
    det = spark.createDataFrame([(" ", "N", 40.0, 29.0), ("d1", "N", 40.0, 29.0)], "native_id string, satellite string, lat double, lon double")
    assert [r["i"] for r in det.select(assets.detection_id(det).alias("i")).collect()] == ["N||||40.0|29.0", "d1"]


def test_impacts_shown(spark):
    impacts = spark.createDataFrame([(1, 80, 10.0, 0.5, "l1", 5, 0.5), (2, 90, None, 1.0, "l1", 6, 1.0), (3, 40, 12.0, 2.0, "l2", None, None), (4, 10, 12.0, 2.0, "l2", 7, 1.0)], "event long, risk int, corridor_km double, min_km double, line_asset_key string, evidence_det long, evidence_km double")
    lines = spark.createDataFrame([(e, f"k{i}", float(i)) for e in (1, 2, 3, 4) for i in range(6)], "event long, asset_key string, km double")
    got = assets.shown_corridors(impacts, lines)
    assert sorted((r["event"], r["asset_key"]) for r in got.collect()) == [(e, f"k{i}") for e in (1, 3) for i in range(4)]
    assert assets.evidence_of(impacts, "l1").first()["evidence_det"] == 6


def test_published_layers(spark):
    good = ("a", "TR", "400", 380.0, 40.0, 29.0, "osm-name")
    bad = [("a", "ES", "154", 380.0, 50.0, 29.0, "odd"), (None, "TR", "154", None, 40.0, 29.0, "osm-ref")]
    df = lambda rows: spark.createDataFrame(rows, "asset_id string, country string, grid_class string, kv double, lat double, lon double, label_source string")
    assert set(assets.violations(df([good]), "TR", BOX).first()) == {0}
    assert tuple(assets.violations(df([good, *bad]), "TR", BOX).first()) == (1, 1, 1, 2, 1, 1)


def test_pages_of_fire_power_are_bounded(spark, monkeypatch):
    """A page holds no more features than it may; all pages together hold every detection."""
    from emberfold.plans import extras

    monkeypatch.setattr(extras, "PAGE", 10)
    folders = []
    plain = extras.feeds.load_fire_power
    monkeypatch.setattr(extras.feeds, "load_fire_power", lambda spark, folder, *rest: folders.append(folder) or plain(spark, folder, *rest))
    assert extras.fire_power(spark, "/root/testdata/sf0.001").count() == 39
    sizes = [r["value"].count('"Feature"') for r in spark.read.text(folders[0]).collect()]
    assert max(sizes) <= 10 and sum(sizes) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
