"""Grid layers and boundaries: partitioned tables, raw collections and side files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("400", "154", "substations")
#: Codes that the boundary source spells otherwise, and the mainland's limits (west, south) where islands go.
CODES = {"EL": "GR"}
MAINLAND = {"PT": (-10.5, 35.5)}


def read_layer(spark: SparkSession, path: str, country: str, layers: Sequence[str] = LAYERS) -> DataFrame:
    """Layers of one country; partition columns are pruned, so that no other country's files are read."""
    # names of layers that are all digits are read as numbers
    df = spark.read.parquet(path).withColumn("layer", F.col("layer").cast("string"))
    return df.where((F.col("country") == country) & F.col("layer").isin(*layers))


def layer_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def with_power(df: DataFrame, country: str) -> DataFrame:
    """Raw collections of places alone lack the power tag where a country's source leaves it out."""
    return df.withColumn("power", F.coalesce("power", F.lit("substation"))) if country == "TR" else df


def boundaries(parts: DataFrame) -> DataFrame:
    """(country, part, ring) with codes as used here, and only mainland parts where a country has limits."""
    code = F.col("code")
    for a, b in CODES.items():
        code = F.when(code == a, b).otherwise(code)
    lon, lat = F.array_min(F.transform("ring", lambda p: F.get(p, F.lit(0)))), F.array_min(F.transform("ring", lambda p: F.get(p, F.lit(1))))
    keep = F.lit(True)
    for c, (west, south) in MAINLAND.items():
        keep = keep & ((F.col("country") != c) | ((F.col("_w") > west) & (F.col("_s") > south)))
    return parts.withColumns({"country": code, "_w": lon, "_s": lat}).where(keep).select("country", "part", "ring")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(country, files, bytes) of published files in folders by country; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return rows.groupBy(F.regexp_extract("path", r"/([A-Z]{2})/[^/]*$", 1).alias("country")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def markdown(metrics: DataFrame) -> str:
    """A one-row table of metrics as a Markdown table."""
    row = metrics.limit(1).collect()
    cells = row[0].asDict() if row else {}
    return "\n".join(["| Metric | Value |", "| --- | --- |", *[f"| {k} | {'—' if v is None else v} |" for k, v in cells.items()]])
