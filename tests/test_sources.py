"""Readers, the paged source, the registry and sinks, over files written here."""

import json

import pytest
from pyspark.sql import functions as F

from emberfold.operators import detections
from emberfold.sources import files, pages, registry, sinks


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('latitude , longitude,note\r\n1,2,"a ""q"", b\nc"\r\n,,\r\n3,4\r\n')
    got = files.read_csv(spark, str(tmp_path / "a.csv"), ["latitude ", " longitude", "note"]).collect()
    assert [(r["latitude"], r["longitude"], r["note"]) for r in got] == [("1", "2", 'a "q", b\nc'), ("3", "4", "")]


def feature(i, **props):
    return {"type": "Feature", "id": f"f{i}", "geometry": {"type": "Point", "coordinates": [29.0 + i / 10, 40.0]}, "properties": props}


def write_pages(folder):
    one = [feature(0, FRP=22.5, SZA=30, time="2026-08-05T10:00:00Z", UsedChannel="F1"), feature(1, FRP=61.2, Lat=40.5, Lon=30.0, Datetime="2026-08-05T11:00:00")]
    two = [feature(1, FRP=61.2, Lat=40.5, Lon=30.0, Datetime="2026-08-05T11:00:00")]
    for start, fs in ((0, one), (2, two), (4, [feature(9)])):
        (folder / f"page-{start}.json").write_text(json.dumps({"type": "FeatureCollection", "features": fs}))


def test_features(spark, tmp_path):
    write_pages(tmp_path)
    (tmp_path / "odd.json").write_text(json.dumps({"type": "ExceptionReport"}))
    rows = files.feature_id(files.read_features(spark, str(tmp_path)))
    assert rows.count() == 4
    raw = files.fire_power_raw(detections.first_by(rows, F.col("fid"), F.col("file"), rows.columns)).withColumn("seq", F.col("fid"))
    got = {r["seq"]: r for r in detections.normalize(raw).collect()}
    assert (got["f0"]["lat"], got["f0"]["frp"], got["f0"]["day_night"]) == (40.0, 22.5, "day")
    assert (got["f1"]["lat"], got["f1"]["lon"], str(got["f1"]["detected_at"])) == (40.5, 30.0, "2026-08-05 11:00:00")
    with pytest.raises(Exception, match="not a feature collection"):
        files.read_features(spark, str(tmp_path), strict=True).collect()


def test_paged_source(spark, tmp_path):
    write_pages(tmp_path)
    spark.dataSource.register(pages.FeaturePages)
    read = lambda **o: spark.read.format("feature_pages").options(folder=str(tmp_path), **o).load()
    # the second page is short, so that the third is not read
    assert sorted(r["id"] for r in read(pagesize=2).collect()) == ["f0", "f1", "f1"]
    assert [r["id"] for r in read(pagesize=2, bbox="28.9,39,29.05,41").collect()] == ["f0"]
    with pytest.raises(Exception, match="more than 1 pages"):
        read(pagesize=2, maxpages=1).collect()


def test_filter_text():
    assert pages.filter_text((26, 36, 45, 42), "2026-08-04", "2026-08-05") == "BBOX(geom,36,26,42,45) AND time >= '2026-08-04' AND time <= '2026-08-05'"
    with pytest.raises(ValueError):
        pages.bbox_text(5, 1, 4, 2)


def test_registry(spark):
    r = registry.Registry()
    r.register("nasa-firms", lambda: spark.range(2).withColumnRenamed("id", "a"))
    r.register("mtg-fci-frp", lambda: spark.range(1).withColumnRenamed("id", "b"))

    def broken():
        raise OSError("down")

    r.register("sentinel3a-slstr", broken)
    r.register("msg-seviri-frp", lambda: spark.range(9))
    assert r.plan("FIRMS_ONLY") == ["nasa-firms"] and r.plan("MULTI_SOURCE") == ["nasa-firms", "mtg-fci-frp", "sentinel3a-slstr"]
    df, failed = r.load("MULTI_SOURCE")
    assert df.count() == 3 and failed == {"sentinel3a-slstr": "down"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x", 29.5, 40.0), (2, 'a,"b"', 29.6, 41.0)], "n long, name string, lon double, lat double")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"), ("n", "name"))
    body = next((tmp_path / "csv").glob("part-*")).read_bytes().decode("utf-8")
    assert body == "﻿n,name\r\n1,'=x\r\n2,\"a,\"\"b\"\"\"\r\n"
    point = json.loads(sinks.point_features(df, "fire", ("n",)).orderBy("feature").first()["feature"])
    assert point["geometry"] == {"type": "Point", "coordinates": [29.5, 40.0]} and point["properties"] == {"kind": "fire", "n": 1}
    assert json.loads(sinks.json_lines(df, {"v": "1"}).first()["line"])["meta"] == {"v": "1"}
    sinks.write_layers(df.withColumns({"country": F.lit("TR"), "layer": F.lit("400")}), str(tmp_path / "layers"))
    assert spark.read.parquet(str(tmp_path / "layers")).where("country = 'TR' and layer = '400'").count() == 2
