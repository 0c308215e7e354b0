"""Scalar functions on single values, at boundaries and on awkward input."""

import math

import pytest
from pyspark.sql import functions as F

from emberfold.functions import geo, risk, text, voltage
from emberfold.functions.numbers import confidence_weight, num_or_null, round_up, str_or_null, to_num


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("85", 0.85), ("high", 1.0), ("H", 1.0), ("nominal", 0.75), ("l", 0.45), ("odd", 0.6), (None, 0.0), ("", 0.0), ("250", 1.0), ("-3", 0.0)])
def test_confidence(spark, given, want):
    assert one(spark, confidence_weight(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize("given, want", [("35xN", None), ("nan", None), ("NaN", None), ("Infinity", None), ("1d", None), ("", None), (None, None), (" 12.5 ", 12.5), ("-7e2", -700.0), (".5", 0.5), ("1e999", None)])
def test_numbers(spark, given, want):
    assert one(spark, num_or_null(F.lit(given).cast("string"))) == want
    assert one(spark, to_num(F.lit(None).cast("string"))) == 0.0


def test_rounding_and_text(spark):
    assert one(spark, round_up(F.lit(-2.5), 0)) == -2.0 and one(spark, round_up(F.lit(2.5), 0)) == 3.0
    assert one(spark, str_or_null(F.lit("  "))) is None and one(spark, str_or_null(F.lit(" a "))) == "a"


@pytest.mark.parametrize("given, want", [("935", "09:35:00Z"), ("25", "00:25:00Z"), ("1200", "12:00:00Z"), (None, "00:00:00Z"), ("12345", "12:345:00Z")])
def test_acquisition_time(spark, given, want):
    assert one(spark, text.hhmm(F.lit("2026-08-05"), F.lit(given).cast("string"))) == f"2026-08-05T{want}"


@pytest.mark.parametrize("tag, want", [("400", [0.4]), ("20000;400", [0.4, 20.0]), ("400000;225000", [225.0, 400.0]), ("63 kV", [0.063]), ("", []), (None, []), ("380000,5", [380.0005]), ("-5;x9", [])])
def test_voltages(spark, tag, want):
    assert one(spark, voltage.kv_of_tag(F.lit(tag).cast("string"))) == want


@pytest.mark.parametrize("kv, want", [(49.0, None), (50.0, "154"), (299.999, "154"), (300.0, "400"), (550.0, "400"), (551.0, None)])
def test_voltage_classes(spark, kv, want):
    assert one(spark, voltage.voltage_class(F.lit(kv))) == want


def test_raw_tag_wins(spark):
    assert one(spark, voltage.kv_of_feature(F.lit("400"), F.lit(None).cast("string"), F.lit("400"))) == [0.4]
    assert one(spark, voltage.kv_of_feature(F.lit(""), F.lit(None).cast("string"), F.lit("154"), F.lit("66"))) == [66.0, 154.0]
    assert one(spark, voltage.shown_voltage(F.lit("154000;30"))) == "154 kV"


@pytest.mark.parametrize("frp, wind, want", [(0.0, 0.0, 10.0), (300.0, 35.0, 30.0), (1000.0, 90.0, 30.0), (None, None, 14.0)])
def test_corridor(spark, frp, wind, want):
    assert one(spark, risk.corridor_km(F.lit(frp).cast("double"), F.lit(wind).cast("double"))) == want


@pytest.mark.parametrize("score, want", [(80, "critical"), (75, "critical"), (60, "high"), (40, "medium"), (10, "watch")])
def test_risk_bands(spark, score, want):
    assert one(spark, risk.risk_band(F.lit(score))) == want


@pytest.mark.parametrize("km, want", [(0.4, "critical"), (0.5, "critical"), (1.5, "high"), (3.0, "medium"), (5.0, "watch"), (5.01, "low"), (None, None)])
def test_impact_bands(spark, km, want):
    assert one(spark, risk.impact_band(F.lit(km).cast("double"))) == want


@pytest.mark.parametrize("given, want", [("=1+1", "'=1+1"), ("+x", "'+x"), ("@x", "'@x"), ("-x", "'-x"), ("-9.5", "-9.5"), ('a "b", c', '"a ""b"", c"'), (None, ""), ("plain", "plain")])
def test_csv_cells(spark, given, want):
    assert one(spark, text.csv_cell(F.lit(given).cast("string"))) == want


def test_geometry(spark):
    lit = F.lit
    on = geo.segment_nearest(lit(39.0), lit(29.5), lit(39.0), lit(29.0), lit(39.0), lit(30.0))
    assert one(spark, on[0]) < 1e-9
    past = geo.segment_nearest(lit(39.0), lit(31.0), lit(39.0), lit(29.0), lit(39.0), lit(30.0))
    assert one(spark, past[2]) == pytest.approx(30.0)
    same = geo.segment_nearest(lit(39.0), lit(31.0), lit(39.0), lit(30.0), lit(39.0), lit(30.0))
    assert one(spark, same[0]) == pytest.approx(111.32 * math.cos(math.radians(39.0)))
    lat, lon = geo.destination(lit(39.0), lit(30.0), lit(90.0), lit(100.0))
    assert one(spark, geo.haversine_km(lit(39.0), lit(30.0), lat, lon)) == pytest.approx(100.0)
    assert one(spark, geo.bearing_deg(lit(39.0), lit(30.0), lat, lon)) == pytest.approx(90.0)
    assert one(spark, geo.angle_diff(lit(350.0), lit(10.0))) == 20.0
    square = ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)), ((1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0))
    inside = lambda la, lo: one(spark, geo.in_region(lit(la).cast("double"), lit(lo).cast("double"), square))
    assert inside(3.0, 3.0) and not inside(1.5, 1.5) and not inside(5.0, 1.0) and inside(None, 1.0) is False


def test_ages(spark):
    assert [one(spark, text.age_text(F.lit(m))) for m in (0.5, 59.0, 61.0, 120.0, 1500.0)] == ["<1min", "59min", "1h 1min", "2h", "1d 1h"]
    assert one(spark, risk.age_hours(F.lit(None).cast("double"), F.lit(0.0))) == 24.0
    assert one(spark, risk.cardinal(F.lit(337.5))) == "N" and one(spark, risk.cardinal(F.lit(-90.0))) == "W"


def test_smoke_of_nothing(spark):
    """The curve, as SQL has it, ends at 0.16; nothing is drawn where there is no smoke."""
    row = spark.range(1).select(risk.smoke_curve(F.lit(0.0)).alias("curve"), risk.smoke_alpha(F.lit(0.0)).alias("drawn"), risk.smoke_alpha(F.lit(9.0)).alias("some"), risk.smoke_curve(F.lit(9.0)).alias("same")).first()
    assert (row["curve"], row["drawn"]) == (0.16, 0.0) and row["some"] == row["same"]
