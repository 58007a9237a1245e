"""Polygons as arrays of corners: order, area, angles, similarity. Array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corner_angle(corner: Column, cx: Column, cy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(corner["y"] - cy, corner["x"] - cx)), F.lit(360.0))


def sorted_rings(rings: DataFrame) -> DataFrame:
    """rings(id, corners) with corners (x, y) counter-clockwise about their mean; ties keep their order. Array functions: no shuffle."""
    n = F.size("corners")
    mean = lambda k: F.aggregate("corners", F.lit(0.0), lambda s, p: s + p[k]) / n
    with_mean = rings.withColumns({"cx": mean("x"), "cy": mean("y")})
    keyed = F.transform("corners", lambda p, i: F.struct(corner_angle(p, F.col("cx"), F.col("cy")).alias("angle"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))
    return with_mean.withColumn("corners", F.transform(F.array_sort(keyed), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["angle"].alias("angle"))))


def _each(fn) -> Column:
    """fn(corner, corner before, corner after) for each corner of the ring; the ring itself is computed once a row."""
    def around(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(ring, lambda p, i: fn(p, F.get(ring, F.pmod(i - 1, n)), F.get(ring, F.pmod(i + 1, n))))

    return F.transform(F.array("corners"), around)[0]


def polygon_area(rings: DataFrame) -> DataFrame:
    """id, area, centroid (x, y) by the shoelace formula with its sign, so either direction is right."""
    def shares(p, _, a):
        k = p["x"] * a["y"] - a["x"] * p["y"]
        return F.struct(k.alias("k"), ((p["x"] + a["x"]) * k).alias("mx"), ((p["y"] + a["y"]) * k).alias("my"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("k", "mx", "my")])
    total = F.aggregate(_each(shares), zero, lambda s, e: F.struct(*[(s[c] + e[c]).alias(c) for c in ("k", "mx", "my")]))
    r = rings.select("id", total.alias("t"))
    return r.select("id", (F.abs("t.k") / 2).alias("area"), F.try_divide("t.mx", 3 * F.col("t.k")).alias("x"), F.try_divide("t.my", 3 * F.col("t.k")).alias("y"))


def _angles(rings: DataFrame, fn) -> DataFrame:
    return rings.select("id", F.posexplode(_each(fn)).alias("n", "angle"))


def inner_angles(rings: DataFrame) -> DataFrame:
    """id, n, angle: at each corner the inner angle from the headings of its edges, in degrees from 0 to 360."""
    def at(p, b, a):
        one = F.atan2(p["y"] - b["y"], p["x"] - b["x"])
        two = F.atan2(a["y"] - p["y"], a["x"] - p["x"])
        return F.pmod(F.lit(180.0) - F.degrees(two - one), F.lit(360.0))

    return _angles(rings, at)


def exterior_angles(rings: DataFrame) -> DataFrame:
    """id, n, angle: signed exterior angle atan2(cross, dot) at each corner, in radians."""
    def at(p, b, a):
        ux, uy, vx, vy = p["x"] - b["x"], p["y"] - b["y"], a["x"] - p["x"], a["y"] - p["y"]
        return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)

    return _angles(rings, at)


def turning_function(rings: DataFrame) -> DataFrame:
    """id, n, angle: at each corner the angle between its two edges, in degrees."""
    def at(p, b, a):
        ux, uy, vx, vy = b["x"] - p["x"], b["y"] - p["y"], a["x"] - p["x"], a["y"] - p["y"]
        size = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ux * vx + uy * vy, size)))))

    return _angles(rings, at)


def polygon_similarity(angles: DataFrame, reference: DataFrame) -> DataFrame:
    """id, distance: sum of |angle - reference angle| over the corners in order; reference(n, angle) is one polygon."""
    ref = F.broadcast(reference.select("n", F.col("angle").alias("ref")))
    return angles.join(ref, "n").groupBy("id").agg(F.sum(F.abs(F.col("angle") - F.col("ref"))).alias("distance"))
