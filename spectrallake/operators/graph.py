"""Polygons, tessellations, components and cluster trees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import connected_components, settled
from .points import radius_pairs
from .rings import _each, exterior_angles, inner_angles, polygon_area, polygon_similarity, sorted_rings, turning_function  # noqa: F401
from .space import finite
from .tessellation import delaunay, hull_volumes, voronoi_volumes, with_spheres  # noqa: F401
from .trees import rolled_up


def circumcentre(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """x, y and radius of the circle through three points; null where they lie on a line."""
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    x = F.try_divide(sa * (by - cy) + sb * (cy - ay) + sc * (ay - by), d)
    y = F.try_divide(sa * (cx - bx) + sb * (ax - cx) + sc * (bx - ax), d)
    return x, y, F.sqrt((ax - x) ** 2 + (ay - y) ** 2)


def circumcentre_3d(p: np.ndarray, tol: float = 1e-3) -> np.ndarray:
    """Centres and radii (n, 4) of the spheres through n tetrahedra (n, 4, 3); zeros where they are nearly flat."""
    e = p[:, 1:] - p[:, :1]
    det = np.linalg.det(e)
    flat = np.abs(det) < tol
    e = np.where(flat[:, None, None], np.eye(3), e)
    at = np.linalg.solve(e, (e**2).sum(2)[..., None] / 2)[..., 0]
    out = np.concatenate([p[:, 0] + at, np.sqrt((at**2).sum(1))[:, None]], 1)
    return np.where(flat[:, None], 0.0, out)


def with_circles(triangles: DataFrame, points: DataFrame) -> DataFrame:
    """triangles with ux, uy, radius of their circumcircles."""
    out = triangles
    for k in "abc":
        out = out.join(points.select("g", F.col("id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), ["g", k])
    x, y, r = circumcentre(*[(F.col(f"x{k}"), F.col(f"y{k}")) for k in "abc"])
    return out.select("g", "a", "b", "c", x.alias("ux"), y.alias("uy"), r.alias("radius"))


def interstitials(circles: DataFrame, r_a: float, extent: tuple[float, float]) -> DataFrame:
    """Voronoi vertices inside the image with radius over 0.01, and the room that they leave beside atoms of radius r_a."""
    inside = (F.col("ux") >= 0) & (F.col("uy") >= 0) & (F.col("ux") < extent[0]) & (F.col("uy") < extent[1])
    return circles.where(inside & (F.col("radius") > 0.01)).withColumn("room", F.col("radius") - r_a)


def voronoi_areas(circles: DataFrame, points: DataFrame, hull: DataFrame) -> DataFrame:
    """id, area of each point's Voronoi cell: the circumcentres of its triangles in order; infinity for points on the hull, 0 without triangles."""
    corners = circles.select(F.explode(F.array("a", "b", "c")).alias("id"), F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")).alias("p"))
    rings = corners.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("corners"))
    areas = polygon_area(sorted_rings(rings)).select(F.col("id").alias("of"), "area")
    open_cells = hull.select(F.explode(F.array("i", "j")).alias("on_hull")).distinct()
    out = points.select("id").join(areas, F.col("id") == F.col("of"), "left").join(open_cells, F.col("id") == F.col("on_hull"), "left")
    return out.select("id", F.when(F.col("on_hull").isNotNull(), F.lit(float("inf"))).otherwise(F.coalesce("area", F.lit(0.0))).alias("area"))


def _hull(p: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull in their order, points on its edges left out; of equal points the smallest id counts."""
    order = np.lexsort((ids, p[:, 1], p[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (p[order[1:]] != p[order[:-1]]).any(1)
    order = order[new]

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (p[out[-1], 0] - p[out[-2], 0]) * (p[q, 1] - p[out[-2], 1]) - (p[out[-1], 1] - p[out[-2], 1]) * (p[q, 0] - p[out[-2], 0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(order)[:-1] + half(order[::-1])[:-1] if len(order) > 1 else order, int)


def hull_edges(points: DataFrame) -> DataFrame:
    """g, i, j (i < j): edges of the convex hull of each group's points, collinear points left out.

    Tasks keep the corners of their own points' hulls first, so that few points of a large group meet in one task.
    """
    kind = dict(points.dtypes)["g"]

    def partial(batches):
        for pdf in batches:
            for _, part in pdf.groupby("g"):
                yield part.iloc[_hull(part[["x", "y"]].to_numpy(), part["id"].to_numpy())]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        ring = ids[_hull(pdf[["x", "y"]].to_numpy(), ids)]
        ends = np.unique(np.sort(np.column_stack([ring, np.roll(ring, -1)]), 1), axis=0) if len(ring) > 1 else np.empty((0, 2), np.int64)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "i": ends[:, 0], "j": ends[:, 1]})

    p = finite(points.select("g", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "x", "y").where("g is not null")
    return p.mapInPandas(partial, p.schema).groupBy("g").applyInPandas(run, f"g {kind}, i long, j long")


#: Most edges that one task joins up; more take rounds over all tasks.
FEW = 50_000


def components(pairs: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component): components of the edges (i, j), named by their smallest node. Up to `few` edges are joined up in one task, without rounds."""
    edges = settled(pairs.where("i <> j").select(F.col("i").cast("long").alias("u"), F.col("j").cast("long").alias("v")), "pairs")
    if edges.count() > few:
        return connected_components(edges)

    def run(batches):
        ends = pd.concat([pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)}), *batches])
        ids, at = np.unique(ends[["u", "v"]].to_numpy(np.int64), return_inverse=True)
        u, v = at.reshape(-1, 2).T
        least, before = np.arange(len(ids)), None
        while before is None or (least != before).any():
            before = least.copy()
            np.minimum.at(least, u, least[v])
            np.minimum.at(least, v, least[u])
            least = least[least]
        yield pd.DataFrame({"node": ids, "component": ids[least]})

    return edges.coalesce(1).mapInPandas(run, "node long, component long")


def overlapping(sites: DataFrame, r_a: float, cheat: float = 1.0) -> DataFrame:
    """Pairs i < j of sites(g, tri_id, ux, uy, room) of one g that overlap: less than 2 r_a apart, and less than cheat times the sum of their rooms."""
    near = radius_pairs(sites.select(F.col("tri_id").alias("id"), F.col("ux").alias("x"), F.col("uy").alias("y")), 2 * r_a)
    one, other = (sites.select(F.col("tri_id").alias(k), F.col("g").alias(f"g{k}"), F.col("room").alias(f"room{k}")) for k in "ij")
    both = near.join(one, "i").join(other, "j")
    return both.where((F.col("gi") == F.col("gj")) & (F.col("d") < (F.col("roomi") + F.col("roomj")) * cheat)).select("i", "j", "d")


def by_vertices(units: DataFrame, points: DataFrame, visible: tuple[int, int] = (4, 99), z_limits: tuple[float, float] = (0.0, 100.0)) -> DataFrame:
    """unit_id, length, z of units(unit_id, atom_ids) with a number of corners within visible and the mean of their corners' z strictly within z_limits; points(id, z)."""
    corners = units.where(F.size("atom_ids").between(*visible)).select("unit_id", F.explode("atom_ids").alias("id")).join(points.select("id", "z"), "id")
    got = corners.groupBy("unit_id").agg(F.count("*").alias("length"), F.avg("z").alias("z"))
    return got.where((F.col("z") > z_limits[0]) & (F.col("z") < z_limits[1]))


def structural_units(circles: DataFrame, unit_of: DataFrame) -> DataFrame:
    """circles(tri_id, a, b, c, ux, uy) merged by unit_of(node, component): unit_id, atom_ids (distinct, ascending), n_cells, site_x, site_y. Cells without partner are units of their own."""
    tagged = circles.join(unit_of, circles.tri_id == unit_of.node, "left").withColumn("unit_id", F.coalesce("component", "tri_id"))
    return tagged.groupBy("unit_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b", "c"))))).alias("atom_ids"), F.count("*").alias("n_cells"), F.avg("ux").alias("site_x"), F.avg("uy").alias("site_y")
    )


def polygons(units: DataFrame, points: DataFrame) -> DataFrame:
    """unit_id, cyclicity, cx, cy, area, angle_gaps of units with more than two corners; gaps are taken modulo pi."""
    corners = units.where(F.size("atom_ids") > 2).select("unit_id", F.explode("atom_ids").alias("id")).join(points.select("id", "x", "y"), "id")
    rings = corners.groupBy(F.col("unit_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("corners"))
    rings = sorted_rings(rings)
    area = polygon_area(rings).select(F.col("id").alias("aid"), "area")
    gap = _each(lambda p, _, a: F.pmod(F.radians(a["angle"] - p["angle"]), F.lit(math.pi)))
    return rings.join(area, rings.id == area.aid).select(F.col("id").alias("unit_id"), F.size("corners").alias("cyclicity"), "cx", "cy", "area", gap.alias("angle_gaps"))


def cluster_tree(linkage, leaves: DataFrame) -> DataFrame:
    """leaves(label, n, x, y) and joins -> node, left, right, level, n_leaves, n, x, y; row j of the joins makes node (number of leaves) + j.

    linkage: a table (j, left, right), or a short list of pairs. Means are sums rolled up from the leaves.
    """
    if not isinstance(linkage, DataFrame):
        linkage = leaves.sparkSession.createDataFrame([(j, a, b) for j, (a, b) in enumerate(linkage)], "j long, left long, right long")
    size = leaves.count()
    joins = linkage.select((F.col("j") + size).cast("long").alias("node"), F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))
    parents = joins.select(F.col("node").alias("parent"), F.explode(F.array("left", "right")).alias("node"))
    zero = [F.lit(0).cast(k).alias(c) for c, k in (("n", "long"), ("sx", "double"), ("sy", "double"), ("n_leaves", "long"))]
    ends = leaves.select(F.col("label").cast("long").alias("node"), F.col("n").cast("long").alias("n"), (F.col("x") * F.col("n")).alias("sx"), (F.col("y") * F.col("n")).alias("sy"), F.lit(1).cast("long").alias("n_leaves"))
    nodes = ends.unionByName(joins.select("node", *zero)).join(parents, "node", "left")
    totals = rolled_up(nodes, ["n", "sx", "sy", "n_leaves"])
    full = totals.join(joins, "node", "left")
    as_int = [F.col(c).cast("int").alias(c) for c in ("node", "left", "right", "level", "n_leaves")]
    return full.select(*as_int, "n", (F.col("sx") / F.col("n")).alias("x"), (F.col("sy") / F.col("n")).alias("y"))
