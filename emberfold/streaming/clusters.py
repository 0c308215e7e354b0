"""Clusters of detections as a state that grows and merges batch by batch.

The key of a cluster is not known before its detections have met, so that the state is not kept by key but as three tables
in a folder that all executors share, a version for each batch: the detections that later ones can still reach (active),
which clusters have become part of which (merged), and the detections of the batch with the cluster that they joined. A
batch reads the version before it and writes its own, so that one that runs again after a failure leaves the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfold.functions.geo import haversine_km
from emberfold.operators.clusters import cluster
from emberfold.operators.graph import components
from emberfold.operators.spatial import around, place_cells
from emberfold.runtime import settle, small, wide
from emberfold.streaming.detections import read_files, replay

ACTIVE = "det long, lat double, lon double, ms double, cluster long"
MERGED = "label long, cluster long"


def touching(new: DataFrame, old: DataFrame, km: float, hours: float) -> DataFrame:
    """(u, v): the clusters of ``new`` and of ``old`` (det, lat, lon, ms, cluster) that a link joins."""
    size, step = km / 110.574, hours * 3_600_000
    left = around(new.select("lat", "lon", "ms", "cluster"), km, size)
    left = left.withColumn("slot", F.explode(F.sequence(F.floor(F.col("ms") / step) - 1, F.floor(F.col("ms") / step) + 1)))
    right = place_cells(old, size).select("cx", "cy", F.floor(F.col("ms") / step).alias("slot"), F.col("cluster").alias("v"), F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"), F.col("ms").alias("v_ms"))
    near = haversine_km(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon")) <= km
    both = wide(left).join(right, ["cx", "cy", "slot"]).where((F.abs(F.col("ms") - F.col("v_ms")) <= step) & near)
    return both.select(F.col("cluster").alias("u"), "v").distinct()


class ClusterState:
    """The state in ``folder``; ``add`` is for ``foreachBatch``. Detections more than ``late`` hours before the newest one are
    given back: what comes later than that (and their hours apart) starts clusters of its own. None keeps all."""

    def __init__(self, folder: str, km: float = 5.0, hours: float = 6.0, late: float | None = None) -> None:
        self.folder, self.km, self.hours, self.late = folder, km, hours, late

    def _table(self, df: DataFrame, name: str, schema: str, version: int | None) -> DataFrame:
        spark = df.sparkSession
        return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{self.folder}/{name}/version={version}")

    def _versions(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.read.parquet(f"{self.folder}/done").select("version")

    def before(self, df: DataFrame, batch: int) -> int | None:
        """The newest finished version before ``batch``: the first one has none, and reads nothing."""
        if batch == 0:
            return None
        return self._versions(df).where(F.col("version") < batch).agg(F.max("version")).first()[0]

    def add(self, df: DataFrame, batch: int) -> None:
        """One batch of detections (det, lat, lon, ms); rows without a place or a time are clusters of their own."""
        last = self.before(df, batch)
        active, merged = self._table(df, "active", ACTIVE, last), self._table(df, "merged", MERGED, last)
        fresh = settle(cluster(df.select("det", "lat", "lon", "ms").dropDuplicates(["det"]), self.km, self.hours).select("det", "lat", "lon", "ms", F.col("cluster").cast("long").alias("cluster")))
        placed = fresh.where("ms is not null and lat is not null and lon is not null")
        joined = small(settle(components(touching(placed, active, self.km, self.hours)).where("node <> component").select("node", "component")))

        def moved(rows: DataFrame) -> DataFrame:
            at = rows.join(joined, rows["cluster"] == F.col("node"), "left")
            return at.select(*[F.coalesce("component", "cluster").alias(c) if c == "cluster" else F.col(c) for c in rows.columns])

        now = joined.select(F.col("node").alias("label"), F.col("component").alias("cluster"))
        members, reach = moved(fresh), moved(active).unionByName(moved(placed))
        if self.late is not None:
            newest = reach.agg(F.max("ms")).first()[0]
            if newest is not None:
                reach = reach.where(F.col("ms") >= newest - (self.late + self.hours) * 3_600_000)
        for name, rows in (("members", members), ("active", reach), ("merged", moved(merged).unionByName(now))):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={batch}")
        df.sparkSession.range(1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{self.folder}/done/version={batch}")

    def clusters(self, df: DataFrame) -> DataFrame:
        """(det, cluster) of all detections so far: the cluster that each joined, or what has become of it. ``df`` gives the session."""
        last = self._versions(df).agg(F.max("version")).first()[0]
        members = df.sparkSession.read.parquet(f"{self.folder}/members").select("det", F.col("cluster").alias("label"))
        merged = self._table(df, "merged", MERGED, last)
        return members.join(small(merged), "label", "left").select("det", F.coalesce("cluster", "label").alias("cluster"))


def clusters_of_arrivals(parts: list[DataFrame], folder: str, state: ClusterState) -> DataFrame:
    """(det, cluster) after ``parts`` of detections have arrived one after the other."""
    for part in parts:
        part.select("det", "lat", "lon", "ms").write.mode("append").parquet(f"{folder}/in")
        replay(read_files(part.sparkSession, f"{folder}/in", part.select("det", "lat", "lon", "ms").schema, 1 << 30), folder, each=state.add)
    return state.clusters(parts[0])
