"""Elements of a map database to features: nodes, closed ways, and relations whose ways form rings end to end.

A ring is a cycle in the graph of way ends. Every way can be walked in two directions; where exactly two ways of one relation
and role meet, walking one leads on to the other. How the walks go on is a table, and pointers in it are doubled by joins:
in as many rounds as the logarithm of the ways of the longest ring, every walk knows the least one of its cycle, and then
how far it is from that one. Walks that end somewhere close nothing. Both directions of a ring are found, and the one with
the forward walk of its smallest way is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.operators.geometry import inside, ring_edges, simple_ring
from emberfold.runtime import settle, small


def _walks(ways: DataFrame) -> DataFrame:
    """(relation, inner, walk, to): 2 * way walks a way forward, 2 * way + 1 backward; ``to`` is where the walk goes on."""
    end = lambda side, p: ways.select("relation", "inner", "way", F.lit(side).alias("side"), p.alias("node"))
    ends = end(0, F.get("points", F.lit(0))).unionByName(end(1, F.element_at("points", -1)))
    one = F.struct("way", "side")
    met = ends.groupBy("relation", "inner", "node").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("a"), F.max(one).alias("b")).where("n = 2")
    # a walk arrives at a way's first point backward and at its last one forward
    arrives = lambda x: F.col(f"{x}.way") * 2 + (1 - F.col(f"{x}.side"))
    leaves = lambda x: F.col(f"{x}.way") * 2 + F.col(f"{x}.side")
    on = lambda x, y: met.select("relation", "inner", arrives(x).alias("walk"), leaves(y).alias("to"))
    return on("a", "b").unionByName(on("b", "a"))


def _cycles(walks: DataFrame) -> DataFrame:
    """(relation, inner, walk, to, ring): the walks on cycles, with the least walk of each."""
    key = ["relation", "inner"]
    now = settle(walks.select(*key, "walk", F.col("to").alias("next"), "to", F.least("walk", "to").alias("ring")))
    while True:
        there = now.select(*key, F.col("walk").alias("to"), F.col("to").alias("further"), F.col("ring").alias("least"))
        # walks that come to an end have no pointer there, and leave
        step = settle(now.join(there, [*key, "to"]).select(*key, "walk", "next", F.col("further").alias("to"), F.least("ring", "least").alias("ring"), (F.col("least") < F.col("ring")).alias("changed")))
        same = step.where("changed").isEmpty() and step.count() == now.count()
        now = step.drop("changed")
        if same:
            return now.select(*key, "walk", F.col("next").alias("to"), "ring")


def _ranked(cycles: DataFrame) -> DataFrame:
    """(relation, inner, ring, walk, left): how many walks of the ring come after ``walk``, from the ring's least walk on."""
    key = ["relation", "inner"]
    now = settle(cycles.select(*key, "ring", "walk", F.when(F.col("to") != F.col("ring"), F.col("to")).alias("to"), F.when(F.col("to") != F.col("ring"), 1).otherwise(0).cast("long").alias("left")))
    while not now.where("to is not null").isEmpty():
        there = now.select(*key, F.col("walk").alias("to"), F.col("to").alias("further"), F.col("left").alias("more"))
        now = settle(now.join(there, [*key, "to"], "left").select(*key, "ring", "walk", F.col("further").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    return now.drop("to")


def rings(members: DataFrame) -> DataFrame:
    """(relation, inner, ring, points): the closed rings of the ways in ``members`` (relation, way, role, points: array of lon and lat).

    ``way`` is unique in a relation, and at least 0; ``ring`` is twice the ring's smallest way, and the ring is walked from
    the start of that way on. Ways of fewer than two points are left out; so are rings of fewer than four points, and what
    meets where more than two ways of one relation and role end. Inner is the role ``inner`` and no other.
    """
    ways = settle(members.where(F.size("points") >= 2).select("relation", (F.coalesce("role", F.lit("")) == "inner").alias("inner"), F.col("way").cast("long").alias("way"), "points"))
    closed = F.get("points", F.lit(0)) == F.element_at("points", -1)
    alone = ways.where(closed).select("relation", "inner", (F.col("way") * 2).alias("ring"), "points")
    parts = ways.where(~closed)
    found = _ranked(_cycles(_walks(parts)).where("ring % 2 = 0"))
    found = found.withColumn("way", F.expr("walk div 2")).join(parts, ["relation", "inner", "way"])
    forward = F.when(F.col("walk") % 2 == 0, F.col("points")).otherwise(F.reverse("points"))
    # each way without its last point, which is the first of the next one
    found = found.groupBy("relation", "inner", "ring").agg(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("place"), F.slice(forward, F.lit(1), F.size("points") - 1).alias("points")))).alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: p["points"]))
    joined = found.select("relation", "inner", "ring", F.concat(flat, F.slice(flat, 1, 1)).alias("points"))
    return alone.unionByName(joined).where(F.size("points") >= 4)


def ring_area(points: Column) -> Column:
    """The area of a closed ring, in squares of degrees; measured from its first point."""
    x0, y0 = F.get(F.get(points, F.lit(0)), F.lit(0)), F.get(F.get(points, F.lit(0)), F.lit(1))
    part = lambda e: (e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0)
    return F.abs(F.aggregate(ring_edges(points), F.lit(0.0), lambda a, e: a + part(e))) / 2


def polygons(members: DataFrame) -> DataFrame:
    """(relation, polygons): of each relation with a closed outer ring, its polygons by ring, each a list of rings: the outer one and its holes.

    A hole belongs to the smallest outer ring of its relation that its first point lies in; one that lies in none is left
    out. Outer rings whose edges cross are left out.
    """
    found = settle(rings(members))
    value = lambda f, k: f(F.transform("points", lambda p: F.get(p, F.lit(k))))
    box = [value(F.array_min, 0).alias("w"), value(F.array_min, 1).alias("s"), value(F.array_max, 0).alias("e"), value(F.array_max, 1).alias("n")]
    outer = settle(found.where("not inner").where(simple_ring(F.col("points"))).select("relation", "ring", "points", ring_area(F.col("points")).alias("area"), *box))
    first = F.get("points", F.lit(0))
    holes = found.where("inner").select("relation", F.col("ring").alias("hole"), F.col("points").alias("own"), F.get(first, F.lit(0)).alias("x"), F.get(first, F.lit(1)).alias("y"))
    pairs = holes.join(outer, "relation").where("x between w and e and y between s and n").where(inside(F.col("x"), F.col("y"), ring_edges(F.col("points"))))
    given = pairs.groupBy("relation", "hole").agg(F.min(F.struct("area", "ring")).alias("o"), F.first("own").alias("own"))
    given = given.groupBy("relation", F.col("o.ring").alias("ring")).agg(F.sort_array(F.collect_list(F.struct("hole", "own"))).alias("holes"))
    none = F.array().cast("array<array<array<double>>>")
    each = outer.join(given, ["relation", "ring"], "left").select("relation", "ring", F.concat(F.array("points"), F.coalesce(F.transform("holes", lambda h: h["own"]), none)).alias("rings"))
    return each.groupBy("relation").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "rings"))), lambda p: p["rings"]).alias("polygons"))


def features(elements: DataFrame, members: DataFrame) -> DataFrame:
    """(type, id, shape, lon, lat, polygons) of ``elements`` (type, id, lon, lat, points) that are features; ``members`` has the ways of relations by id.

    A node with both coordinates is a Point; a closed way whose edges don't cross is a Polygon; a relation with closed outer
    rings is a Polygon, or a MultiPolygon if there are several. Open ways, and all else, are none.
    """
    node = elements.where("type = 'node' and lon is not null and lat is not null").select("type", "id", F.lit("Point").alias("shape"), "lon", "lat", F.lit(None).cast("array<array<array<array<double>>>>").alias("polygons"))
    closed = (F.size("points") >= 4) & (F.get("points", F.lit(0)) == F.element_at("points", -1))
    nothing = F.lit(None).cast("double")
    way = elements.where("type = 'way'").where(closed).where(simple_ring(F.col("points"))).select("type", "id", F.lit("Polygon").alias("shape"), nothing.alias("lon"), nothing.alias("lat"), F.array(F.array("points")).alias("polygons"))
    made = settle(polygons(members)).withColumnRenamed("relation", "id")
    relation = elements.where("type = 'relation'").select("type", "id").join(small(made, weigh=F.size(F.flatten(F.flatten("polygons"))) * 40 + 64), "id")
    relation = relation.select("type", "id", F.when(F.size("polygons") > 1, "MultiPolygon").otherwise("Polygon").alias("shape"), nothing.alias("lon"), nothing.alias("lat"), "polygons")
    return node.unionByName(way).unionByName(relation)
