"""Positions of GeoJSON coordinates of any type, by variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lists inside lists: a position stands in none, one, two or three.
DEPTH = 3
_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def _at(v: Column, i: int) -> Column:
    return F.try_variant_get(v, f"$[{i}]", "variant")


def _is_number(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(_NUMBER), F.lit(False))


def positions(coordinates: Column) -> Column:
    """Array of (lon, lat) of a text of JSON coordinates, in order: of a point, a line, a polygon, or several of these.

    A position is a list that begins with two numbers; further numbers (heights) are left out. Lists are looked into as deep
    as coordinates go, what is neither a list nor a number is passed over. Null, or a text that is no JSON, has no positions.
    """
    none = F.array().cast("array<variant>")
    position = lambda v: _is_number(_at(v, 0)) & _is_number(_at(v, 1))
    inner = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)
    found = F.array(F.try_parse_json(coordinates))
    for _ in range(DEPTH):
        found = F.flatten(F.transform(found, lambda v: F.when(position(v), F.array(v)).otherwise(inner(v))))
    point = lambda v: F.struct(F.try_variant_get(v, "$[0]", "double").alias("lon"), F.try_variant_get(v, "$[1]", "double").alias("lat"))
    return F.coalesce(F.transform(F.filter(found, position), point), F.array().cast("array<struct<lon:double,lat:double>>"))


def box(points: Column) -> Column:
    """(west, south, east, north) of ``positions``, null without any."""
    value = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return F.when(F.size(points) > 0, F.struct(value(F.array_min, "lon").alias("west"), value(F.array_min, "lat").alias("south"), value(F.array_max, "lon").alias("east"), value(F.array_max, "lat").alias("north")))
