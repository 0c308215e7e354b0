"""Tiles that are split until what they hold is little enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfold.operators.grid_etl import suspicious_empty
from emberfold.runtime import settle, small


def refined(features: DataFrame, step: float, limit: int, depth: int = 3) -> DataFrame:
    """(depth, x, y, n, state) of the tiles that cover ``features`` (lon, lat), of ``step`` degrees at first.

    A tile of more than ``limit`` features is split in four, and so is an empty one that its neighbours make doubtful
    (``suspicious_empty``), until none is left or ``depth`` is reached. Tiles that are not split are whole (state final),
    or hold more than ``limit`` at the last depth (exceeded); an empty tile that was split and is empty still is unresolved.
    Features without a place are in no tile. Features are counted once, by the smallest tiles; the rounds add up these counts.
    """
    fine = step / 2**depth
    counts = settle(features.where("lon is not null and lat is not null").groupBy(F.floor(F.col("lon") / fine).alias("x"), F.floor(F.col("lat") / fine).alias("y")).agg(F.count(F.lit(1)).alias("n")))
    spark = features.sparkSession
    up = lambda c, d: F.floor(F.col(c) / 2 ** (depth - d))
    of_depth = lambda d: counts.groupBy(up("x", d).alias("x"), up("y", d).alias("y")).agg(F.sum("n").alias("n"))
    ends = counts.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None:
        return spark.createDataFrame([], "depth int, x long, y long, n long, state string")
    west, east, south, north = (int(v) >> depth for v in ends)
    open_ = spark.range(west, east + 1).select(F.col("id").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(south).cast("long"), F.lit(north).cast("long")))).withColumn("doubted", F.lit(False))
    out = None
    for d in range(depth + 1):
        told = settle(open_.join(of_depth(d), ["x", "y"], "left").select(F.lit(d).alias("depth"), "x", "y", F.coalesce("n", F.lit(0)).alias("n"), "doubted"))
        again = told.where(F.col("n") > limit).select("x", "y", F.lit(False).alias("doubts")) if d < depth else told.where(F.lit(False)).select("x", "y", F.lit(False).alias("doubts"))
        if d == 0 < depth:
            line = told.select(F.lit("line").alias("kind"), "depth", "x", "y", "n", F.lit(None).cast("double").alias("inside"))
            again = again.unionByName(suspicious_empty(line).select("x", "y", F.lit(True).alias("doubts")))
        again = settle(again)
        state = F.when(F.col("n") > limit, "exceeded").when(F.col("doubted") & (F.col("n") == 0), "unresolved").otherwise("final")
        rest = told.join(small(again.select("x", "y")), ["x", "y"], "left_anti").select("depth", "x", "y", "n", state.alias("state"))
        out = rest if out is None else out.unionByName(rest)
        if again.isEmpty():
            break
        kids = F.explode(F.array(*[F.struct((F.col("x") * 2 + i).alias("x"), (F.col("y") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)])).alias("k")
        open_ = again.select(F.col("doubts").alias("doubted"), kids).select("k.x", "k.y", "doubted")
    return out
