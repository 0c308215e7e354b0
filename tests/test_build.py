"""The offline build: every feature is in one counter, and errors stop it."""

import pytest
from pyspark.sql import functions as F

from emberfold.operators import boundary, build

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
SCHEMA = (
    "seq long, valid boolean, key string, power string, shape string, geometry string, kv double, raw_country string, osm_version string, osm_id string, osm_id2 string, osmId string, osm_type string, name string, ref string, operator string, "
    "`from` string, `to` string, voltage string, frequency string, cables string, wires string, osm_timestamp string, provider string, a_lon double, a_lat double, b_lon double, b_lat double, lon double, lat double, points array<array<double>>"
)


@pytest.fixture(scope="module")
def area(spark):
    return boundary.area(boundary.edges_of(spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(SQUARE)], "ring int, seq int, lon double, lat double")))


def feature(seq, power="line", shape="LineString", kv=400.0, key=None, ends=(1.0, 1.0, 2.0, 2.0), at=(None, None), ring=None, country="TR", valid=True, osm_id=None, name=None, version="1"):
    text = [None] * 6
    return (seq, valid, key or f"k{seq}", power, shape, f"g{seq}", kv, country, version, osm_id or f"{seq}", None, None, None, name, *text, None, None, None, "P1" if seq % 2 else None, *ends, *at, ring)


def features():
    box = lambda x, y, z: [[x, y], [x + z, y], [x + z, y + z], [x, y + z], [x, y]]
    none = (None,) * 4
    return [
        feature(1, name="a"), feature(2, kv=154.0), feature(3, ends=(-1.0, 5.0, 11.0, 5.0)), feature(4, ends=(20.0, 20.0, 21.0, 21.0)), feature(5, valid=False), feature(6, kv=30.0), feature(7, kv=700.0), feature(8, kv=None), feature(9, power="tower", shape="Point"),
        feature(10, key="same", version="1"), feature(11, key="same", version="3"), feature(12, "substation", "Point", None, ends=none, at=(5.0, 5.0)), feature(13, "substation", "Point", 400.0, ends=none, at=(50.0, 5.0)),
        feature(14, "substation", "Polygon", 154.0, ends=none, ring=box(4.0, 4.0, 1.0)), feature(15, "substation", "Polygon", 154.0, ends=none, ring=box(-0.9, 4.0, 1.0)), feature(16, "substation", "Polygon", 154.0, ends=none, ring=box(30.0, 4.0, 1.0)),
    ]


def test_every_feature_is_counted(spark, area, tmp_path):
    made = build.build(spark.createDataFrame(features(), SCHEMA), area, "TR")
    got = {r["counter"]: r["n"] for r in build.publish(made, str(tmp_path)).collect()}
    assert got == {
        "raw": 16, "invalid": 1, "duplicates": 1, "unsupported": 1, "below-50": 1, "above-550": 1, "unclassified": 1, "outside": 3, "clipped-lines": 1, "representative-points": 2, "lines": 4, "substations": 3,
        "grid-400": 3, "grid-154": 1, "named-lines": 1, "referenced-lines": 0, "operator-lines": 0, "source:P1": 4, "source:OpenStreetMap": 3,
    }
    assert got["raw"] == sum(got[c] for c in ("invalid", "duplicates", "unsupported", "below-50", "above-550", "unclassified", "outside")) + 7
    rows = {r["seq"]: r for r in made.assets.collect()}
    assert (rows[3]["a_lon"], rows[3]["b_lon"]) == (0.0, 10.0) and rows[11]["layer"] == "400" and 10 not in rows
    assert -0.9 < rows[15]["a_lon"] and 0 <= rows[15]["a_lon"] <= 0.1001 and rows[12]["grid_class"] is None
    assert made.assets.select(F.count_distinct("asset_id")).first()[0] == len(rows)


def test_errors(spark, area, tmp_path):
    with pytest.raises(build.BuildError, match="another country"):
        build.build(spark.createDataFrame([*features(), feature(99, country="GR")], SCHEMA), area, "TR")
    with pytest.raises(build.BuildError, match="one id"):
        build.build(spark.createDataFrame([feature(1, osm_id="7"), feature(2, osm_id="7")], SCHEMA), area, "TR")
    made = build.build(spark.createDataFrame(features(), SCHEMA), area, "TR")
    with pytest.raises(build.BuildError, match="manifest"):
        build.publish(build.Build(made.assets.where("seq <> 1"), made.manifest), str(tmp_path))
    empty = build.build(spark.createDataFrame([], SCHEMA), area, "TR")
    assert empty.assets.count() == 0 and empty.manifest.where("n <> 0").count() == 0
    other = build.build(spark.createDataFrame([feature(1, "substation", "Point", None, ends=(None,) * 4, at=(5.0, 5.0), country=None)], SCHEMA), area, "GR")
    assert {r["counter"]: r["n"] for r in other.manifest.collect()}["unclassified"] == 1
