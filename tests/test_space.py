"""Neighbours and tessellations over uneven points: small cells give what one cell, or brute force, gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectrallake.operators import graph, points, space, stars, tessellation

XYZ = ("x", "y", "z")


def frame(spark, parts):
    """A group for each array of points; ids rise through all groups."""
    start, out = 0, []
    for g, p in enumerate(parts):
        out.append(pd.DataFrame({"g": g, "id": np.arange(start, start + len(p))} | {c: p[:, k] for k, c in enumerate("xyz"[: p.shape[1]])}))
        start += len(p)
    return spark.createDataFrame(pd.concat(out))


def uneven():
    rng = np.random.default_rng(4)
    outlier = rng.random((900, 2))
    outlier[0] = (1e5, -1e5)
    dense = rng.random((900, 2))
    dense[:450] = 0.5 + 1e-5 * rng.random((450, 2))
    same = rng.random((900, 2))
    same[:400] = 0.25
    lattice = np.stack(np.meshgrid(np.arange(30.0), np.arange(30.0)), -1).reshape(-1, 2)
    return {"uniform": rng.random((900, 2)), "outlier": outlier, "dense": dense, "same": same, "lattice": lattice}


@pytest.mark.parametrize("name", list(uneven()))
def test_neighbours_like_brute_force(spark, name):
    xy = uneven()[name]
    d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
    df = frame(spark, [xy])
    for include in (False, True):
        if not include:
            np.fill_diagonal(d, np.inf)
        else:
            np.fill_diagonal(d, 0)
        want = np.lexsort((np.broadcast_to(np.arange(len(xy)), d.shape), d), axis=1)[:, :6]
        got = points.knn(df, df, 6, include_self=include, cell=64).toPandas().sort_values(["i", "rank"])
        assert len(got) == 6 * len(xy) and (got["rank"].to_numpy().reshape(-1, 6) == np.arange(6)).all()
        assert (got["j"].to_numpy().reshape(-1, 6) == want).all()
        assert (got["d"].to_numpy().reshape(-1, 6) == np.take_along_axis(d, want, 1)).all()


def test_neighbours_with_many_questions_in_one_place_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    xy = rng.random((300, 2))
    p = frame(spark, [xy])
    q = spark.range(5000).select("id", F.lit(0.3).alias("x"), F.lit(0.3).alias("y"))
    odd = spark.createDataFrame([(9001, None, 0.1), (9002, float("nan"), 0.1), (9003, float("inf"), 0.0), (9004, -1e9, 1e9)], "id long, x double, y double")
    got = points.knn(q.unionByName(odd), p.select("id", "x", "y").unionByName(odd.limit(3)), 4, cell=32).toPandas()
    d = np.sqrt((xy[:, 0] - 0.3) ** 2 + (xy[:, 1] - 0.3) ** 2)
    want = np.lexsort((np.arange(300), d))[:4]
    of = got[got["i"] < 5000].sort_values(["i", "rank"])
    assert len(of) == 20_000 and (of["j"].to_numpy().reshape(-1, 4) == want).all()
    assert set(got["i"]) - set(range(5000)) == {9004} and (got["i"] == 9004).sum() == 4
    with pytest.raises(ValueError):
        points.knn(q, p, 0)


def test_cells_hold_about_equal_counts(spark):
    xy = uneven()["dense"]
    df = frame(spark, [xy])
    cells = space.cells_of(df, len(xy), cell=64)
    counts = space.boxes_of(df.withColumn("cell", cells.column("x", "y")), cells).count
    assert cells.size == 16 and counts.sum() == len(xy) and counts.max() < 4 * 64


def test_cut_where_most_lie_at_the_least_place():
    """Two places, more than half at the lesser: each gets its own cells, and no cell has all."""
    rng = np.random.default_rng(4)
    sample = np.column_stack([np.where(np.arange(1000) < 600, 0.0, 50.0), rng.random(1000)])
    cells = space.cut(sample, 3)
    cell = cells.place(sample)
    assert not set(cell[:600]) & set(cell[600:])
    assert np.bincount(cell, minlength=8).min() > 0 and np.bincount(cell).max() < 200


def test_radius_pairs_like_brute_force(spark):
    xy = uneven()["uniform"]
    got = {(r.i, r.j) for r in points.radius_pairs(frame(spark, [xy]), 0.05).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    assert got == {(i, j) for i, j in zip(*np.nonzero(d < 0.05), strict=True) if i < j}


def triangles(df, **how):
    rows = [tuple(r) for r in graph.delaunay(df, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("name", ["uniform", "outlier", "dense", "lattice"])
def test_tiles_give_the_triangles_of_one_task(spark, name):
    df = frame(spark, [uneven()[name]])
    whole = triangles(df, tile=1 << 20)
    assert triangles(df, tile=100) == whole
    if name == "lattice":
        assert len(whole) == 2 * 29 * 29  # every square in two


def test_tiles_of_many_groups(spark):
    rng = np.random.default_rng(8)
    parts = [rng.random((n, 2)) * s for n, s in ((3, 1), (1, 1), (2, 1), (400, 1), (40, 2), (200, 0.1), (5, 1))]
    ring = rng.random(200) * 2 * np.pi
    parts.append(np.column_stack([np.cos(ring), np.sin(ring)]))
    df = frame(spark, parts)
    whole = triangles(df, tile=1 << 20)
    assert {t[0] for t in whole} == {0, 3, 4, 5, 6, 7}
    for tile in (64, 40):
        assert triangles(df, tile=tile) == whole
    odd = spark.createDataFrame([(0, 1, None, 0.0), (0, 2, float("nan"), 1.0), (None, 3, 0.0, 0.0)], "g int, id long, x double, y double")
    assert graph.delaunay(odd).count() == 0
    twice = df.where("g = 0").unionByName(df.where("g = 0").withColumn("id", F.col("id") + 1000))
    assert triangles(twice) == triangles(df.where("g = 0"))


def test_hull_of_many_tasks(spark):
    rng = np.random.default_rng(3)
    square = np.concatenate([rng.random((500, 2)), [[0, 0], [0, 1], [1, 0], [1, 1], [0.5, 0], [0, 0]]])
    got = {(r.g, r.i, r.j) for r in graph.hull_edges(frame(spark, [square, square[:1], square[:2]]).repartition(7)).collect()}
    assert got == {(0, 500, 501), (0, 500, 502), (0, 501, 503), (0, 502, 503), (2, 507, 508)}


def test_tetrahedra_in_tiles_fill_the_hull(spark):
    rng = np.random.default_rng(5)
    parts = [rng.random((150, 3)), rng.random((4, 3)), rng.random((3, 3))]
    df = frame(spark, parts)
    whole = triangles(df, tile=1 << 20, coordinates=XYZ)
    assert triangles(df, tile=40, coordinates=XYZ) == whole
    t = np.array([r[1:] for r in whole if r[0] == 0])
    assert np.isclose(np.abs(tessellation.determinants(parts[0], t)).sum() / 6, tessellation.hull_volume(parts[0]))
    for a, b, c, e in t[:40]:
        (at,), (r2,) = tessellation.circles(parts[0], np.array([[a, b, c, e]]))
        assert (((parts[0] - at) ** 2).sum(1) > r2 - 1e-9 * max(r2, 1)).all()


def test_tetrahedra_at_chosen_points():
    """Those of the whole set with a chosen corner, by another way; None where rounding decides."""
    rng = np.random.default_rng(9)
    for n, some in ((4, 4), (30, 7), (400, 150), (700, 700)):
        p = rng.normal(size=(n, 3)) * np.exp(rng.normal(size=(n, 1)))
        own = rng.permutation(n) < some
        whole = tessellation.triangulated(p, p.mean(0), np.ptp(p, 0).max())
        got = stars.tetrahedra_at(p, own)
        assert len(got) and {tuple(t) for t in got} == {tuple(t) for t in whole[own[whole].any(1)]}
    lattice = np.stack(np.meshgrid(*[np.arange(3.0)] * 3), -1).reshape(-1, 3)
    assert stars.tetrahedra_at(lattice, np.ones(27, bool)) is None
    assert len(stars.tetrahedra_at(p[:3], np.ones(3, bool))) == 0


def test_later_rounds_work_on_stale_points_only(spark, monkeypatch):
    """A round after the first tells of points whose simplices were refuted, not of whole tiles again."""
    told, keep = [], tessellation.settled

    def seen(df, name="round"):
        out = keep(df, name)
        if name == "simplices":
            told.append(out.where("cell < 0").count())
        return out

    monkeypatch.setattr(tessellation, "settled", seen)
    df = frame(spark, [np.random.default_rng(2).random((1500, 3)), np.random.default_rng(3).random((900, 3))])
    tiled = triangles(df, tile=100, coordinates=XYZ)
    assert len(told) > 1 and sum(told[1:]) < told[0] / 2
    assert tiled == triangles(df, tile=1 << 20, coordinates=XYZ)


def test_cells_in_space(spark):
    lattice = np.stack(np.meshgrid(*[np.arange(4.0)] * 3), -1).reshape(-1, 3)
    for tile in (1 << 20, 30):
        df = frame(spark, [lattice])
        spheres = graph.with_spheres(graph.delaunay(df, tile, XYZ, flat=True), df)
        v = graph.voronoi_volumes(spheres, df).toPandas().set_index("id")["volume"]
        inner = ((lattice > 0.5) & (lattice < 2.5)).all(1)
        assert np.allclose(v[np.flatnonzero(inner)], 1) and np.isinf(v[np.flatnonzero(~inner)]).all()
    # A point in a box of mirror images of itself has the box for a cell.
    box, p = np.array([2.0, 3.0, 5.0]), np.array([[0.4, 1.1, 2.2], [1.5, 2.5, 1.0], [0.9, 0.4, 4.0], [1.1, 1.9, 3.1]])
    mirrored = lambda side: np.where(side, 2 * (np.array(side) > 0) * box - p, p)
    images = np.concatenate([mirrored((a, b, c)) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    df = frame(spark, [np.unique(images, axis=0)])
    v = graph.voronoi_volumes(graph.with_spheres(graph.delaunay(df, None, XYZ, flat=True), df), df).join(df, "id").where("x between 0 and 2 and y between 0 and 3 and z between 0 and 5")
    assert v.count() == 4 and abs(v.agg(F.sum("volume")).first()[0] - 30) < 1e-6


def test_hull_volumes(spark):
    rng = np.random.default_rng(1)
    cube = np.array([[x, y, z] for x in (0, 2.0) for y in (0, 3.0) for z in (0, 4.0)])
    prism = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 5], [1, 0, 5], [0, 1, 5.0]])
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    inside = np.concatenate([cube, rng.random((30, 3)), [[1, 1.5, 0], [1, 0, 0], [0, 0, 0]]])
    solids = [(cube, 24), (prism, 2.5), (inside @ turn + 100, 24), (np.column_stack([rng.random((9, 2)), np.zeros(9)]), 0), (cube[:3], 0), (1e-6 * prism, 2.5e-18)]
    rows = spark.createDataFrame([(k, [tuple(map(float, p)) for p in s]) for k, (s, _) in enumerate(solids)], "id long, corners array<struct<x:double,y:double,z:double>>")
    got = {r.id: r.volume for r in graph.hull_volumes(rows).collect()}
    assert all(abs(got[k] - v) <= 1e-9 * max(v, 1e-18) + 1e-24 for k, (_, v) in enumerate(solids))
    flat = {r.id: r.volume for r in graph.hull_volumes(rows, ("x", "y")).collect()}
    assert abs(flat[0] - 6) < 1e-9 and abs(flat[1] - 0.5) < 1e-9
    # A random hull against the share of random points in it.
    p = rng.normal(size=(60, 3))
    t = tessellation.triangulated(tessellation.jogged(p, 1.0), p.mean(0), 8.0)
    edge, third = tessellation.hull_rim(t)
    n = tessellation.normals(p, edge, p[third])
    m = rng.uniform(-3, 3, (40_000, 3))
    share = (m @ n.T <= (n * p[edge[:, 0]]).sum(1)).all(1).mean() * 216
    assert abs(share - tessellation.hull_volume(p)) < 0.05 * share
