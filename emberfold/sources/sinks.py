"""Exports: guarded CSV lines, JSON snapshots, GeoJSON features, and partitioned layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.functions.text import csv_cell

BOM = "﻿"


def csv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line): the cells of each row, guarded and quoted; doubles in their shortest form."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line"))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Text files of guarded lines that end in CR LF; each begins with a byte order mark and the header."""
    lines = csv_lines(df, columns).mapInPandas(_with_header(",".join(columns)), "line string")
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def _with_header(header: str):
    def rows(batches):
        first = True
        for b in batches:
            if first and len(b):
                b = b.copy()
                b.iloc[0, 0] = f"{BOM}{header}\r\n{b.iloc[0, 0]}"
                first = False
            yield b

    return rows


def json_lines(df: DataFrame, meta: dict[str, str] | None = None) -> DataFrame:
    """(line): each row as JSON, with ``meta`` under its own name."""
    extra = [F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]).alias("meta")] if meta else []
    return df.select(F.to_json(F.struct(*df.columns, *extra)).alias("line"))


def point_features(df: DataFrame, kind: str, properties: Sequence[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(kind, feature): a GeoJSON point of each row."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return _features(df, kind, geometry, properties)


def line_features(df: DataFrame, kind: str, properties: Sequence[str]) -> DataFrame:
    """(kind, feature): a GeoJSON line of two points of each row (a_lon, a_lat, b_lon, b_lat)."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(F.array("a_lon", "a_lat"), F.array("b_lon", "b_lat")).alias("coordinates"))
    return _features(df, kind, geometry, properties)


def _features(df: DataFrame, kind: str, geometry: Column, properties: Sequence[str]) -> DataFrame:
    props = F.struct(F.lit(kind).alias("kind"), *properties)
    return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))


def write_layers(df: DataFrame, path: str) -> None:
    """Parquet by country and layer, so that readers prune to one of each."""
    df.repartition("country", "layer").write.mode("overwrite").partitionBy("country", "layer").parquet(path)
