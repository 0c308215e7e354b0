"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfold.runtime import settle

#: Edges of a node up to which it is joined as one key, and nodes above it that are broadcast as a table of hubs.
DEGREE, HUBS = 1_000, 100_000
#: Edges that a task holds beside the forest of those before.
HELD = 1_000_000


def _with_least(edges: DataFrame, sides: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v) with the least neighbour m of u by ``sides`` (u, v), and the table (u, m).

    A node with many edges is joined in several shares, which its neighbours' hashes deal out. Of ``count`` edges with two
    ends each, at most HUBS nodes have more than the degree from which a node is split.
    """
    most = max(DEGREE, 2 * count // HUBS)
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    shares = F.expr(f"cast((n + {most - 1}) div {most} as int)")
    hubs = least.where(F.col("n") > most).select("u", shares.alias("shares"))
    dealt = edges.join(F.broadcast(hubs), "u", "left").select("u", "v", F.pmod(F.hash("v"), F.coalesce("shares", F.lit(1))).alias("share"))
    spread = least.select("u", "m", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    return dealt.join(spread, ["u", "share"]).select("u", "v", "m"), least.select("u", "m")


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # what lies above u goes to the least of u and its neighbours
    far, _ = _with_least(both.where("v > u"), both, count)
    return far.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near, least = _with_least(down, down, count)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _sign(edges: DataFrame) -> tuple:
    key = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(key)).first())


def _labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the component of each: each node takes the least label beside it, again and again."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return nodes, nodes[label]


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of all edges of a task; of what has come so far, a forest is kept."""
    u = v = np.empty(0, np.int64)
    parts, n = [], 0
    for b in batches:
        parts.append((b["u"].to_numpy(), b["v"].to_numpy()))
        n += len(b)
        if n > HELD:
            u, v = _labels(*(np.concatenate([own, *[p[i] for p in parts]]) for i, own in enumerate((u, v))))
            parts, n = [], 0
    if n or len(u):
        nodes, component = _labels(*(np.concatenate([own, *[p[i] for p in parts]]) for i, own in enumerate((u, v))))
        yield pd.DataFrame({"node": nodes, "component": component})


def components_nearby(edges: DataFrame, near: str, alone: int = 0) -> DataFrame:
    """(node, component) as ``components`` of ``edges`` (u, v: long), of which those with one value of ``near`` mostly belong together.

    Tasks join the edges of such values first, so that only what their components have in common is left for the rounds.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = edges.where("u <> v").repartition(n, near).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    local = settle(own.mapInPandas(_joined, "node long, component long"))
    root = settle(local.groupBy("node").agg(F.min("component").alias("root"), (F.count(F.lit(1)) > 1).alias("shared")))
    links = local.join(root.where("shared"), "node").select(F.col("component").alias("u"), F.col("root").alias("v"))
    found = components(links, alone=alone).select(F.col("node").alias("root"), "component")
    return root.select("node", "root").join(found, "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def components(edges: DataFrame, rounds: int = 60, alone: int = 0) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the component is its smallest node.

    A node's neighbours are never gathered: minima are aggregated (combined before the shuffle) and joined back, a node with
    many neighbours in shares. Loops and repeated edges are ignored, an empty table gives an empty table. The loop ends when
    a pair of rounds changes nothing. ``alone`` is a number of edges up to which one task joins them all, with the same result
    and without the jobs of the rounds.
    """
    now = settle(edges.select("u", "v").where("u <> v").distinct())
    last = _sign(now)
    if last[0] <= alone:
        return now.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).coalesce(1).mapInPandas(_joined, "node long, component long")
    for _ in range(rounds):
        if not last[0]:
            break
        now = settle(_large_star(now, last[0]))
        now = settle(_small_star(now, last[0]))
        sign = _sign(now)
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
