"""Readers of archive CSV and GeoJSON files. Everything is read as text and coerced by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GEOMETRY = "type string, coordinates string"
#: The properties of fire-power features that are read.
FRP_PROPERTIES = ("Lat", "Lon", "FRP", "FRPerr", "UsedChannel", "Hotspot", "Confidence", "BT", "BT_mir_k", "BT_tir_k", "SZA", "AcrossSize", "AlongSize", "Satellite", "Datetime", "time")


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """A CSV with a header as text columns; quotes are doubled, fields may span lines, short rows are filled with ''.

    ``columns`` is the header, so that files are not read twice; names are trimmed. Rows of only empty cells go.
    """
    schema = T.StructType([T.StructField(c.strip(), T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    df = df.na.fill("")
    filled = F.greatest(*[(F.col(c) != "").cast("int") for c in df.columns]) if len(df.columns) > 1 else (F.col(df.columns[0]) != "").cast("int")
    return df.where(filled == 1)


def read_features(spark: SparkSession, path: str | list[str], properties: Sequence[str] = FRP_PROPERTIES, strict: bool = False) -> DataFrame:
    """Features of GeoJSON collections: (file, at, id, shape, coordinates as JSON text, properties as text).

    Other documents have no features; ``strict`` makes them an error.
    """
    props = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    feature = T.StructType([T.StructField("id", T.StringType()), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])), T.StructField("properties", props)])
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(feature))])
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    good = (F.col("type") == "FeatureCollection") & F.col("features").isNotNull()
    if strict:
        docs = docs.withColumn("features", F.when(good, F.col("features")).otherwise(F.raise_error(F.concat(F.lit("not a feature collection: "), F.col("file")))))
    else:
        docs = docs.where(good)
    rows = docs.select("file", F.posexplode("features").alias("at", "f"))
    return rows.select("file", "at", F.col("f.id").alias("id"), F.col("f.geometry.type").alias("shape"), F.col("f.geometry.coordinates").alias("coordinates"), *[F.col(f"f.properties.{p}").alias(p) for p in properties])


def feature_id(df: DataFrame) -> DataFrame:
    """Adds ``fid``: the feature's id, or a digest of geometry and properties."""
    text = F.to_json(F.struct(*[c for c in df.columns if c not in ("file", "at")]))
    return df.withColumn("fid", F.coalesce("id", F.sha2(text, 256)))


def fire_power_raw(features: DataFrame) -> DataFrame:
    """Raw detections of fire-power features, of polar and geostationary products alike; missing numbers stay null."""
    lonlat = F.from_json("coordinates", "array<double>")
    place = lambda p, i: F.coalesce(F.col(p), F.get(lonlat, F.lit(i)).cast("string"))
    sun = F.col("SZA").try_cast("double")
    return features.select(
        "fid",
        place("Lat", 1).alias("lat"),
        place("Lon", 0).alias("lon"),
        F.coalesce("time", "Datetime").alias("detectedAt"),
        F.col("Datetime").alias("receivedAt"),
        F.col("FRP").alias("frp"),
        F.col("FRPerr").alias("frpUncertaintyMw"),
        F.coalesce("BT", "BT_mir_k", "BT_tir_k").alias("brightnessTemperatureK"),
        F.coalesce("BT_mir_k", "BT_tir_k").alias("brightTi4K"),
        F.col("Confidence").alias("confidenceRaw"),
        F.col("AcrossSize").alias("scan"),
        F.col("AlongSize").alias("track"),
        F.concat(F.lit("UsedChannel="), F.col("UsedChannel")).alias("qualityFlags"),
        F.col("Hotspot").alias("hotspotClass"),
        F.when(sun > 90, "night").when(sun.isNotNull(), "day").alias("dayNight"),
        F.col("Satellite").alias("satellite"),
        F.col("id"),
    )
