"""Delaunay simplices (triangles, tetrahedra) of point sets of any size, tile by tile, and what is made of them.

Tiles are cells of about equal counts over (group, coordinates), so a large group lies in many tiles and a tile holds many
small groups. A tile triangulates its own points and a halo. A simplex at an own point is settled when no point of another
tile lies in its sphere; a face of the tile's hull is settled when no point lies beyond it. Whatever reaches outside the
halo is asked of the tiles that it reaches; points that they name join the tile, which is triangulated again. Each round
works on the points whose simplices or faces were refuted, so rounds go on for few points, and the result is that of one
triangulation: a point of which all spheres are empty and all outer faces have nothing beyond them has its true simplices.

Below, "circle" and "edge" stand for sphere and face where there are three coordinates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import space
from .iterate import forget, settled
from .rings import polygon_area, sorted_rings
from .stars import AT_ONCE, tetrahedra_at

#: Points of a tile, about, and width of the halo in mean distances of points, by the number of coordinates.
TILE, HALO = {2: 1024, 3: 512}, {2: 2.5, 3: 1.5}
#: Most tasks of a round, and tiles of a task. Tiles are few bytes and much work, so they are not left to be put together by their bytes.
TASKS, TILES = 1024, {2: 1, 3: 8}
#: Points are moved by up to this share of the middle half's extent, by a hash of their place, so that no four (five) lie on
#: one circle; and simplices flatter than FLAT are left out.
JOG, FLAT = {2: 1e-10, 3: 1e-7}, 1e-9
#: Corners of a far simplex around all points.
_FAR = {2: np.array([[0, 2.0], [-2, -1.5], [2, -1.5]]), 3: 4 * np.array([[1.0, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]])}


def jogged(at: np.ndarray, span: float) -> np.ndarray:
    """Places moved a hair; the same place always alike."""
    bits = np.ascontiguousarray(at + 0.0).view(np.uint64)
    out, mixed = np.empty(at.shape), np.full(len(at), 0x632BE59BD9B4E019, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(2 * at.shape[1]):
            mixed = (mixed ^ bits[:, k % at.shape[1]] ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            out[:, k % at.shape[1]] = (mixed >> np.uint64(11)).astype(float) / 2**52 - 1
    return at + out * (JOG[at.shape[1]] * span)


def determinants(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Signed volumes, times 2 or 6, of the simplices t of points p."""
    e = p[t[:, 1:]] - p[t[:, :1]]
    if p.shape[1] == 2:
        return e[:, 0, 0] * e[:, 1, 1] - e[:, 0, 1] * e[:, 1, 0]
    return (e[:, 0] * np.cross(e[:, 1], e[:, 2])).sum(1)


def circles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of the circles through the simplices t of points p."""
    e = p[t[:, 1:]] - p[t[:, :1]]
    d = 2 * determinants(p, t)
    d = np.where(d == 0, 1e-300, d)[:, None]
    s = (e * e).sum(2)
    if p.shape[1] == 2:
        u, v = e[:, 0], e[:, 1]
        at = np.stack([v[:, 1] * s[:, 0] - u[:, 1] * s[:, 1], u[:, 0] * s[:, 1] - v[:, 0] * s[:, 0]], 1) / d
    else:
        u, v, w = e[:, 0], e[:, 1], e[:, 2]
        at = (s[:, :1] * np.cross(v, w) + s[:, 1:2] * np.cross(w, u) + s[:, 2:] * np.cross(u, v)) / d
    return p[t[:, 0]] + at, (at * at).sum(1)


def _faces(t: np.ndarray) -> np.ndarray:
    """All faces of simplices, without one corner after the other: first all without the last corner, then without the one before."""
    d = t.shape[1]
    return np.concatenate([np.delete(t, k, 1) for k in range(d - 1, -1, -1)])


def triangulated(p: np.ndarray, middle: np.ndarray, size: float) -> np.ndarray:
    """Simplices (sorted indices) of distinct points in general position, by Bowyer-Watson; middle and size are those of the whole set."""
    n, d = p.shape
    if n <= d:
        return np.empty((0, d + 1), int)
    # A far simplex around all points; far enough that hull edges come out right for well-conditioned inputs.
    p = np.concatenate([p, middle + size * 1e5 * _FAR[d]])
    tri = np.arange(n, n + d + 1)[None]
    centre, r2 = circles(p, tri)
    for i in np.random.default_rng(0).permutation(n):
        hit = ((p[i] - centre) ** 2).sum(1) < r2
        # Each face as one number; those of a single bad simplex bound the hole.
        faces = _faces(np.sort(tri[hit], 1))
        key = faces[:, 0]
        for k in range(1, d):
            key = key * (n + d + 1) + faces[:, k]
        order = np.argsort(key)
        key = key[order]
        once = np.ones(len(key), bool)
        once[1:] &= key[1:] != key[:-1]
        once[:-1] &= key[1:] != key[:-1]
        rim = faces[order[once]]
        new = np.sort(np.column_stack([rim, np.full(len(rim), i)]), 1)
        c, r = circles(p, new)
        good = ~hit
        tri, centre, r2 = np.concatenate([tri[good], new]), np.concatenate([centre[good], c]), np.concatenate([r2[good], r])
    return np.sort(tri[(tri < n).all(1)], 1)


def hull_rim(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges of one simplex only, that simplex's other corner)."""
    edges, third = _faces(t), np.concatenate([t[:, k] for k in range(t.shape[1] - 1, -1, -1)])
    order = np.lexsort(edges.T[::-1])
    same = (edges[order[1:]] == edges[order[:-1]]).all(1)
    alone = np.ones(len(order), bool)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    once = order[alone]
    return edges[once], third[once]


def normals(q: np.ndarray, edge: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Normals of edges, away from points other."""
    e = q[edge[:, 1:]] - q[edge[:, :1]]
    out = np.column_stack([-e[:, 0, 1], e[:, 0, 0]]) if q.shape[1] == 2 else np.cross(e[:, 0], e[:, 1])
    return out * -np.sign(((other - q[edge[:, 0]]) * out).sum(1))[:, None]


def hull_volume(p: np.ndarray) -> float:
    """Area or volume of the convex hull of a few points; 0 where they lie in a line or plane."""
    p = np.unique(p[np.isfinite(p).all(1)], axis=0)
    if len(p) <= p.shape[1]:
        return 0.0
    size = max(np.ptp(p, 0).max(), 1e-300)
    q = jogged((p - p.mean(0)) / size, 1.0)
    t = triangulated(q, np.zeros(p.shape[1]), 1.0)
    # Signs are those of the moved points: on flat sides the parts of the true ones cancel.
    return float(abs((determinants((p - p.mean(0)) / size, t) * np.sign(determinants(q, t))).sum()) * size ** p.shape[1] / (2 if p.shape[1] == 2 else 6))


def _beyond(boxes: space.Boxes, g: float, known: tuple[np.ndarray, np.ndarray], margin: np.ndarray, slack: float, at: np.ndarray, r: np.ndarray, normal: np.ndarray, lies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): cells of group g that a circle (at, r) or, where r is infinite, the half plane normal * p > lies reaches outside what is known.

    What is known of a cell lies in the box `known`, grown by the cell's margin; margin has one for each node, the least of
    its cells. Boxes are those of the points before they were moved by up to slack.
    """
    flat = np.isinf(r)

    def meets(rows, nodes):
        low, high = boxes.low[nodes], boxes.high[nodes]
        mine = (low[:, 0] <= g) & (high[:, 0] >= g)
        low, high = low[:, 1:] - slack, high[:, 1:] + slack
        gap = np.maximum(np.maximum(low - at[rows], at[rows] - high), 0)
        with np.errstate(invalid="ignore"):
            far = (np.where(normal[rows] > 0, high, low) * normal[rows]).sum(1)
            reached = np.where(flat[rows], far > lies[rows], (gap**2).sum(1) < r[rows] ** 2)
        # What a circle's box cuts out of the cell's box may be known already.
        a = np.maximum(low, np.where(flat[rows][:, None], low, at[rows] - r[rows][:, None]))
        b = np.minimum(high, np.where(flat[rows][:, None], high, at[rows] + r[rows][:, None]))
        grown = margin[nodes][:, None] - slack
        seen = ((a >= known[0] - grown) & (b <= known[1] + grown)).all(1)
        return mine & reached & ~seen

    return boxes._crossed(meets, len(at))


def delaunay(points: DataFrame, tile: int | None = None, coordinates: tuple[str, ...] = ("x", "y"), flat: bool = False) -> DataFrame:
    """points(g, id, x, y) -> g, a, b, c (ids in ascending order) of the triangles of each group; with x, y, z also d, of tetrahedra.

    flat: also simplices without content, between points on one circle, so that every inner side has two simplices.

    Of points in one place the smallest id counts. Four points on a circle are settled as if all were moved by JOG of the
    middle half's extent, by a hash of their place, so any tiling gives the same simplices. Points without finite coordinates or
    without a group have none.
    """
    spark, kind, axes = points.sparkSession, dict(points.dtypes)["g"], list(coordinates)
    dim, names = len(axes), list("abcd"[: len(axes) + 1])
    tile = tile or TILE[dim]
    p = space.finite(points.select(F.col("g").cast("long").alias("g"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in axes]), *axes)
    p = p.where("g is not null").groupBy("g", *axes).agg(F.min("id").alias("id"))
    out = "g long, " + ", ".join(f"{c} long" for c in names)
    n, *ends = p.agg(F.count("*"), *[f(c) for f in (F.min, F.max) for c in axes], *[F.percentile_approx(c, [0.25, 0.75]) for c in axes]).first()
    if not n:
        return spark.createDataFrame([], out).withColumn("g", F.col("g").cast(kind))
    low, high = np.array(ends[:dim]), np.array(ends[dim : 2 * dim])
    size, middle = max((high - low).max(), 1e-9), (low + high) / 2
    half = max(b - a for a, b in ends[2 * dim :]) or size
    span = 2.0 ** np.floor(np.log2(half))  # a power of two, as quartiles of large tables are not exact
    # Groups are cut apart before anything else: the axis of groups is by far the widest where there is more than one.
    apart = 4 * float(size)
    at = p.withColumn("gg", F.col("g") * F.lit(apart))
    cells = space.cells_of(at, n, ("gg", *axes), tile)

    def simplices(pdf: pd.DataFrame, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(simplices, whether they are not flat, moved points) of one group's points; all simplices at own points, if not more."""
        xy = pdf[axes].to_numpy()
        q = jogged(xy, span)
        # In the order of their places, so that a circle is rounded alike in every tile.
        order = np.lexsort(q.T[::-1])
        t = tetrahedra_at(q[order], own[order]) if dim == 3 else None
        t = order[triangulated(q[order], middle, size) if t is None else t]
        e = xy[t[:, 1:]] - xy[t[:, :1]]
        longest = np.maximum((e * e).sum(2).max(1), ((e - e[:, ::-1]) ** 2).sum(2).max(1)) if len(t) else np.empty(0)
        return t, (np.abs(determinants(xy, t)) > FLAT * longest ** (dim / 2)) | flat, q

    def rows(g, ids: np.ndarray, t: np.ndarray) -> pd.DataFrame:
        named = np.sort(ids[t], 1) if len(t) else np.empty((0, dim + 1), np.int64)
        return pd.DataFrame({"g": g} | {c: named[:, k] for k, c in enumerate(names)})

    if not cells.depth:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            t, solid, _ = simplices(pdf, np.ones(len(pdf), bool))
            return rows(pdf["g"].iloc[0], pdf["id"].to_numpy(), t[solid])

        return p.groupBy("g").applyInPandas(whole, out).withColumn("g", F.col("g").cast(kind))

    def tasks(tiles: int) -> int:
        """A task for each core at least, if there are as many tiles."""
        return min(tiles, TASKS, max(4 * spark.sparkContext.defaultParallelism, -(-tiles // TILES[dim])))

    placed = settled(at.withColumn("cell", cells.column("gg", *axes)), "points")
    boxes = space.boxes_of(placed, cells, ("gg", *axes))
    sides = np.maximum(boxes.leaf_high[:, 1:] - boxes.leaf_low[:, 1:], 0)
    margin = HALO[dim] * (np.where(boxes.count > 0, sides.prod(1), 0) / np.maximum(boxes.count, 1)) ** (1 / dim) + 1e-9 * size
    levels = [np.where(boxes.count > 0, margin, np.inf)]
    while len(levels[0]) > 1:
        levels.insert(0, np.minimum(levels[0][::2], levels[0][1::2]))
    margins = np.concatenate(levels)
    kept = ["g", "id", *axes, "cell", "own"]
    member = "g long, id long, " + ", ".join(f"{c} double" for c in axes) + ", cell int, own boolean"
    asked_for = ["cell", "origin", "g", *[f"c{k}" for k in range(dim)], "r", *[f"n{k}" for k in range(dim)], "lies"]
    ask = "cell int, origin int, g long, " + ", ".join(f"{c} double" for c in asked_for[3:])
    # Own corners of what an ask is about, the first of them in place of others: they are stale if a point is named.
    stands = [f"s{k}" for k in range(dim + 1)]
    ask, asked_for = ask + "".join(f", {c} long" for c in stands), [*asked_for, *stands]

    def halo(batches):
        """Points within the lesser of their own and the other tile's margin, so that a sparse tile beside dense ones has no wide halo in these."""
        for pdf in batches:
            here, cell = pdf[["gg", *axes]].to_numpy(), pdf["cell"].to_numpy()
            reach = np.column_stack([np.zeros(len(here)), *[margin[cell]] * dim])
            row, to = boxes.overlapping(here - reach, here + reach)
            at = here[row, 1:]
            near = ((at >= boxes.leaf_low[to, 1:] - margin[to, None]) & (at <= boxes.leaf_high[to, 1:] + margin[to, None])).all(1)
            other = near & (to != cell[row])
            yield pdf.iloc[row[other]][["g", "id", *axes]].assign(cell=to[other].astype(np.int32), own=False)

    around = placed.select("gg", "g", "id", *axes, "cell").mapInPandas(halo, member)
    members = settled(placed.select("g", "id", *axes, "cell", F.lit(True).alias("own")).unionByName(around), "tiles")

    def tiled(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, parts = int(pdf["cell"].iloc[0]), []
        known, near_by = (boxes.leaf_low[cell, 1:], boxes.leaf_high[cell, 1:]), np.minimum(margins, margin[cell])
        for g, part in pdf.groupby("g"):
            part = part.sort_values("own", ascending=False).drop_duplicates("id")
            own, ids = part["own"].to_numpy(bool), part["id"].to_numpy()
            if not own.any():
                continue
            t, solid, q = simplices(part, own)
            # A simplex is told by the tile that owns its corner of the smallest id.
            first = t[np.arange(len(t)), np.argmin(ids[t], 1)] if len(t) else np.empty(0, int)
            parts.append(rows(g, ids, t[solid & own[first]]).assign(cell=-1, origin=cell))
            mine = t[own[t].any(1)]
            centre, r2 = circles(q, mine)
            reach = np.sqrt(r2)
            if len(t):
                edge, third = hull_rim(t)
                touched = own[edge].any(1)
                edge = edge[touched]
                normal = normals(q, edge, q[third[touched]])
                lies, near = (normal * q[edge[:, 0]]).sum(1), q[edge[:, 0]]
            else:  # too few points for a simplex: they ask all of their group
                normal, lies, near, edge = np.empty((0, dim)), np.empty(0), np.empty((0, dim)), np.empty((0, dim), int)
                mine, centre, reach = np.flatnonzero(own)[:, None], q[own], np.full(own.sum(), 2 * apart)
            corners = np.concatenate([mine[:, np.arange(dim + 1) % mine.shape[1]], edge[:, np.arange(dim + 1) % dim]])
            corners = ids[np.where(own[corners], corners, corners[np.arange(len(corners)), own[corners].argmax(1)][:, None])]
            # How many points a circle wants: one, or as many more than are known already.
            wanted = np.full(len(centre), 1.0 if len(t) else len(q) + dim)
            at = np.concatenate([centre, near]), np.concatenate([reach, np.full(len(near), np.inf)])
            normal, lies = np.concatenate([np.zeros_like(centre), normal]), np.concatenate([wanted, lies])
            row, to = _beyond(boxes, g * apart, known, near_by, 2 * JOG[dim] * span, *at, normal, lies)
            row, to = row[to != cell], to[to != cell]
            columns = {"g": g} | dict.fromkeys(names, -1) | {"cell": to, "origin": cell, "r": at[1][row], "lies": lies[row]}
            columns |= {f"c{k}": at[0][row, k] for k in range(dim)} | {f"n{k}": normal[row, k] for k in range(dim)}
            parts.append(pd.DataFrame(columns | {c: corners[row, k] for k, c in enumerate(stands)}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in (*names, *asked_for)})

    def answered(asks: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        """Of this cell's points: those nearest to a circle's middle, the nearest and the farthest beyond an edge."""
        got = []
        for g, part in asks.groupby("g"):
            points = here[here["g"] == g]
            q = jogged(points[axes].to_numpy(), span)
            step = max(1, AT_ONCE // max(len(q), 1))
            for a in range(0, len(part) if len(q) else 0, step):
                some = part.iloc[a : a + step]
                centre, normal = some[[f"c{k}" for k in range(dim)]].to_numpy(), some[[f"n{k}" for k in range(dim)]].to_numpy()
                r, lies = some["r"].to_numpy()[:, None], some["lies"].to_numpy()[:, None]
                d = sum((q[:, k] - centre[:, k, None]) ** 2 for k in range(dim))
                out = sum(q[:, k] * normal[:, k, None] for k in range(dim))
                flat = np.isinf(r)
                inside = np.where(flat, out > lies, d < r * r)
                hit = inside.any(1)
                d, beyond, many = np.where(inside, d, np.inf), hit & flat[:, 0], hit & ~flat[:, 0] & (lies[:, 0] > 1)
                pairs = [(np.flatnonzero(hit), d[hit].argmin(1)), (np.flatnonzero(beyond), np.where(inside, out, -np.inf)[beyond].argmax(1))]
                for n in np.flatnonzero(many):
                    chosen = np.argsort(d[n])[: min(int(lies[n, 0]), int(inside[n].sum()))]
                    pairs.append((np.full(len(chosen), n), chosen))
                row, k = (np.concatenate(x) for x in zip(*pairs, strict=True))
                got.append(pd.DataFrame({c: points[c].to_numpy()[k] for c in ("g", "id", *axes)} | {"cell": some["origin"].to_numpy()[row]} | {c: some[c].to_numpy()[row] for c in stands}))
        return pd.concat(got).drop_duplicates() if got else pd.DataFrame({c: [] for c in ("g", "id", *axes, "cell", *stands)})

    named = "g long, id long, " + ", ".join(f"{c} double" for c in axes) + ", cell int" + "".join(f", {c} long" for c in stands)
    done: list[DataFrame] = []
    alive, spent, tiles = members, [], cells.size
    while True:
        made = settled(alive.repartition(tasks(tiles), "cell").groupBy("cell").applyInPandas(tiled, ", ".join(f"{c} long" for c in names) + ", " + ask), "simplices")
        spent.append(made)
        told = made.where("cell < 0").select("origin", "g", *names)
        asks = made.where("cell >= 0").select(*asked_for)
        busy = asks.select("cell").distinct().count()
        if not busy:
            done.append(told.select("g", *names))
            break
        here = placed.select("g", "id", *axes, "cell").join(F.broadcast(asks.select("cell").distinct()), "cell", "left_semi")
        asked, here = space.dealt(asks, here, 16 * tile, "c0")
        asked, here = (t.repartition(tasks(busy), "cell", "part").groupBy("cell", "part") for t in (asked, here))
        # A point inside a circle is new to its tile, but for rounding.
        news = settled(asked.cogroup(here).applyInPandas(answered, named).join(alive.select("cell", "g", "id"), ["cell", "g", "id"], "left_anti").select("g", "id", *axes, "cell", *stands), "told")
        stale = settled(news.select("cell", "g", F.explode(F.array(*stands)).alias("id")).distinct(), "stale")
        spent += [news, stale]
        # A simplex is its smallest corner's.
        done.append(told.join(stale.select(F.col("cell").alias("origin"), "g", F.col("id").alias(names[0])), ["origin", "g", names[0]], "left_anti").select("g", *names))
        tiles = stale.select("cell").distinct().count()
        if not tiles:
            break
        known = alive.join(F.broadcast(stale.select("cell").distinct()), "cell", "left_semi").drop("own").unionByName(news.select("g", "id", *axes, "cell").distinct())
        alive = settled(known.join(stale.withColumn("own", F.lit(True)), ["cell", "g", "id"], "left").select(*kept[:-1], F.coalesce("own", F.lit(False)).alias("own")), "tiles")
        spent.append(alive)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    result = settled(result, "delaunay")
    forget(placed, members, *spent)
    return result.withColumn("g", F.col("g").cast(kind))


def with_spheres(tetrahedra: DataFrame, points: DataFrame) -> DataFrame:
    """tetrahedra(g, a, b, c, d) with ux, uy, uz, radius of the spheres through their corners, null for flat ones; points(g, id, x, y, z)."""
    out = tetrahedra
    for k in "abcd":
        out = out.join(points.select("g", F.col("id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), ["g", k])
    u, v, w = ([F.col(f"{c}{k}") - F.col(f"{c}a") for c in "xyz"] for k in "bcd")
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    vw, wu, uv = cross(v, w), cross(w, u), cross(u, v)
    solid = F.abs(dot(u, vw)) > FLAT * F.pow(F.greatest(dot(u, u), dot(v, v), dot(w, w)), F.lit(1.5))
    at = [F.when(solid, F.try_divide(dot(u, u) * vw[k] + dot(v, v) * wu[k] + dot(w, w) * uv[k], 2 * dot(u, vw))) for k in range(3)]
    return out.select("g", *"abcd", *[(F.col(f"{c}a") + at[k]).alias(f"u{c}") for k, c in enumerate("xyz")], F.sqrt(dot(at, at)).alias("radius"))


def voronoi_volumes(spheres: DataFrame, points: DataFrame) -> DataFrame:
    """id, volume of each point's Voronoi cell in space: infinity for points on the hull, 0 without tetrahedra.

    spheres as `with_spheres` gives them, flat tetrahedra among them.

    Each edge between two points has a plane side, whose corners are the centres of the tetrahedra around it; the cell is
    made of cones over its sides, half an edge high. All of it is joins on edges and sums.
    """
    pairs = [(p, q) for n, p in enumerate("abcd") for q in "abcd"[n + 1 :]]
    edges = spheres.select("g", F.explode(F.array(*[F.struct(F.col(p).alias("i"), F.col(q).alias("j")) for p, q in pairs])).alias("e"), "ux", "uy", "uz").where("ux is not null").select("g", "e.i", "e.j", "ux", "uy", "uz")
    for k in "ij":
        edges = edges.join(points.select("g", F.col("id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), ["g", k])
    e = [F.col(f"{c}j") - F.col(f"{c}i") for c in "xyz"]
    length = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
    # Two directions at right angles to the edge; the first lies in the plane of the two axes that it follows least.
    least = F.least(*[F.abs(c) for c in e])
    pick = lambda x, y, z: F.when(F.abs(e[0]) == least, x).when(F.abs(e[1]) == least, y).otherwise(z)
    zero = F.lit(0.0)
    p = [pick(zero, e[2], -e[1]), pick(-e[2], zero, e[0]), pick(e[1], -e[0], zero)]
    norm = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
    edges = edges.select("g", "i", "j", length.alias("length"), *[F.try_divide(c, norm).alias(f"p{k}") for k, c in enumerate(p)], *[F.try_divide(c, length).alias(f"e{k}") for k, c in enumerate(e)], *[(F.col(f"u{c}") - F.col(f"{c}i")).alias(f"w{k}") for k, c in enumerate("xyz")])
    q = [F.col("e1") * F.col("p2") - F.col("e2") * F.col("p1"), F.col("e2") * F.col("p0") - F.col("e0") * F.col("p2"), F.col("e0") * F.col("p1") - F.col("e1") * F.col("p0")]
    x = sum((F.col(f"w{k}") * F.col(f"p{k}") for k in range(1, 3)), F.col("w0") * F.col("p0"))
    y = F.col("w0") * q[0] + F.col("w1") * q[1] + F.col("w2") * q[2]
    sides = edges.groupBy("g", "i", "j").agg(F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct(x.alias("x"), y.alias("y")))).alias("corners"))
    sides = sides.withColumn("id", F.struct("g", "i", "j", "length"))
    areas = polygon_area(sorted_rings(sides.select("id", "corners"))).select("id.*", "area")
    cones = areas.select(F.explode(F.array("i", "j")).alias("of"), (F.col("area") * F.col("length") / 6).alias("volume")).groupBy("of").agg(F.sum("volume").alias("volume"))
    outer = _outer_faces(spheres).select(F.explode("face").alias("on_hull")).distinct()
    full = points.select("id").join(cones, F.col("id") == F.col("of"), "left").join(outer, F.col("id") == F.col("on_hull"), "left")
    return full.select("id", F.when(F.col("on_hull").isNotNull(), F.lit(float("inf"))).otherwise(F.coalesce("volume", F.lit(0.0))).alias("volume"))


def _outer_faces(spheres: DataFrame) -> DataFrame:
    """g, face: faces with nothing beyond them. What lies behind a flat tetrahedron with an outer face is outer as well, layer by layer."""
    sides = F.array(*[F.array(*[F.col(c) for c in "abcd" if c != k]) for k in "abcd"])
    faces = spheres.select("g", F.explode(sides).alias("face"))
    outer = settled(faces.groupBy("g", "face").count().where("count = 1").select("g", "face"), "faces")
    flats = settled(spheres.where("ux is null").select("g", sides.alias("faces")), "flat")
    if flats.isEmpty():
        return outer
    of_flats, known = flats.select("g", "faces", F.explode("faces").alias("face")), -1
    while (size := outer.count()) != known:
        behind = of_flats.join(outer, ["g", "face"], "left_semi").select("g", F.explode("faces").alias("face"))
        known, outer = size, settled(outer.unionByName(behind).distinct(), "faces")
    return outer


def hull_volumes(solids: DataFrame, coordinates: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """solids(id, corners) with corners an array of structs of coordinates -> id, volume of the convex hull (an area with two coordinates)."""
    packed = solids.select("id", *[F.col(f"corners.{c}").cast("array<double>").alias(c) for c in coordinates])

    def run(batches):
        for pdf in batches:
            at = zip(*[pdf[c] for c in coordinates], strict=True)
            yield pd.DataFrame({"id": pdf["id"], "volume": [hull_volume(np.column_stack([np.asarray(c, float) for c in one])) for one in at]})

    return packed.mapInPandas(run, f"id {dict(solids.dtypes)['id']}, volume double")
