"""Known answers and invariants for operators that SQL can't state."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrallake import registry
from spectrallake.functions import signal
from spectrallake.operators import factor, filters, graph, grid, nn, points, registration, spectral, tessellation
from spectrallake.sources import carriers, headers


def block(spark, images):
    return spark.createDataFrame([(k, x.shape[0], x.shape[1], x.ravel().tolist()) for k, x in enumerate(images)], "img long, h int, w int, data array<double>")


def test_finds_all_atoms_of_a_lattice(spark):
    x = np.zeros((64, 64))
    x[4::8, 4::8] = 1
    x = signal.smoothed(x[None], 2.0)[0]
    found = {(r.x, r.y) for r in filters.find_atoms(block(spark, [x]), atom_size=0.1, threshold=0.0).collect()}
    want = {(8.0 * i + 4, 8.0 * j + 4) for i in range(8) for j in range(8)}
    assert want <= found


def golden_stack(spark):
    at = [((3, 5), (4, 6)), ((4, 6), (4, 6)), ((3, 5), (3, 5)), ((4, 6), (3, 5)), ((3, 5), (3, 5))]
    rows = []
    for f, ((r0, r1), (c0, c1)) in enumerate(at):
        rows += [(f, r, c, int(r0 <= r < r1 and c0 <= c < c1)) for r in range(64) for c in range(64)]
    return spark.createDataFrame(rows, "f int, r int, c int, v long")


def test_drift_and_crop_of_a_stack(spark):
    out, drift = registration.rigid_registration(golden_stack(spark), 64, 64)
    assert [(r.dr, r.dc) for r in drift.orderBy("f").collect()] == [(0, -1), (-1, -1), (0, 0), (-1, 0), (0, 0)]
    assert registration.common_area(drift, 64, 64) == (0, 63, 0, 63)
    assert out.count() == 5 * 63 * 63
    assert out.where("v = 1").select("r", "c").distinct().count() == 4


def test_crop_errors(spark):
    long = spark.createDataFrame([(0, 0, 1.0)], "r int, c int, v double")
    with pytest.raises(ValueError):
        grid.crop_image(long, (0, 0, 1))
    with pytest.raises(ValueError):
        grid.crop_image(long, (2, 2, 1, 3))


@pytest.mark.parametrize("n, size, step, count", [(10, 4, 2, 4), (7, 7, 2, 1), (10, 4, 4, 3), (11, 3, 2, 5), (200, 24, 7, 27)])
def test_window_grid(n, size, step, count):
    starts = grid.window_starts(n, size, step)
    assert len(starts) == count and starts[-1] == n - size


def test_fourier_roundtrip_and_symmetry(spark):
    x = np.random.default_rng(0).random((3, 8, 8))
    f = spectral.fourier_transform(block(spark, x)).collect()
    total = sum(r.re for r in f if r.img == 0 and r.u == 0 and r.v == 0)
    assert abs(total - (x[0] - x[0].min()).sum()) < 1e-9


def test_inpaint_restores_a_plane(spark):
    r, c = np.meshgrid(np.arange(8.0), np.arange(8.0), indexing="ij")
    x = 2 * r + 3 * c + 1
    mask = np.ones((8, 8))
    mask[3, 4] = mask[5, 2] = 0
    holed = np.where(mask == 0, 99.0, x)
    got = np.array(filters.inpaint(block(spark, [holed]), mask, 8, 8).first()["data"]).reshape(8, 8)
    assert np.abs(got - x).max() < 1e-6


def test_inpaint_is_the_least_squares_solution():
    rng = np.random.default_rng(9)
    x, hole = rng.random((3, 9, 11)), rng.random((9, 11)) < 0.4
    eye = np.eye(99).reshape(99, 9, 11)
    lap = filters._laplacian(eye).reshape(99, 99).T
    h = hole.ravel()
    want = x.reshape(3, 99).copy()
    want[:, h] = np.linalg.lstsq(lap[:, h], -lap[:, ~h] @ want[:, ~h].T, rcond=None)[0].T
    assert np.allclose(filters.smoothest(x, hole).reshape(3, 99), want, atol=1e-7)
    assert np.allclose(filters.smoothest(x, np.zeros_like(hole)), x)


def test_deconvolution_sharpens(spark):
    x = np.zeros((16, 16))
    x[8, 8] = 1
    blurred = signal.smoothed(x[None], 1.5)
    out = filters.lucy_richardson(blurred + 1e-9, 1.5, 50)
    assert out.max() > 1.5 * blurred.max()


def test_refined_atom(spark):
    rows, cols = (g.ravel() - 3 for g in np.meshgrid(np.arange(7.0), np.arange(7.0), indexing="ij"))
    v = filters.oval_gauss(np.array([2.0, 0.3, -0.4, 1.2, 1.6, 0.5]), rows, cols)
    df = spark.createDataFrame([(1, 10.0, 20.0, v.tolist())], "atom_id long, x double, y double, data array<double>")
    r = filters.atom_refine(df, 3).first()
    assert r.accepted and abs(r.x - 10.3) < 1e-3 and abs(r.y - 19.6) < 1e-3 and abs(r.width_y - 1.6) < 1e-2


def test_delaunay_counts_and_empty_circles():
    xy = np.random.default_rng(1).random((60, 2))
    t = tessellation.triangulated(xy, np.array([0.5, 0.5]), 1.0)
    for a, b, c in t:
        (ax, ay), (bx, by), (cx, cy) = xy[a], xy[b], xy[c]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        r = np.hypot(ax - ux, ay - uy)
        assert (np.hypot(xy[:, 0] - ux, xy[:, 1] - uy) > r - 1e-9).all()


def test_flat_tetrahedron_has_no_centre():
    flat = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.0]], [[0, 0, 0], [2, 0, 0], [0, 2, 0], [0, 0, 2.0]]])
    out = graph.circumcentre_3d(flat)
    assert (out[0] == 0).all() and np.allclose(out[1], [1, 1, 1, 3**0.5])


def test_polygon_area_does_not_depend_on_rotation(spark):
    p = np.array([[0, 0], [2, 0], [3, 1], [1, 3], [-1, 1.5]])
    a = 0.7
    q = p @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, r in enumerate((p, q))], "id long, corners array<struct<x:double,y:double>>")
    areas = [r.area for r in graph.polygon_area(graph.sorted_rings(df)).orderBy("id").collect()]
    assert abs(areas[0] - areas[1]) < 1e-9


def test_components_and_knn_on_ties(spark):
    p = spark.createDataFrame([(k, float(k % 3), float(k // 3), 0) for k in range(9)], "id long, x double, y double, type int")
    near = {(r.i, r["rank"]): r.j for r in points.knn(p, p, 3, include_self=False).collect()}
    assert near[4, 0] == 1 and near[4, 1] == 3 and near[0, 0] == 1
    assert graph.components(points.radius_pairs(p, 1.1)).select("component").distinct().count() == 1
    assert points.knn(p, p.limit(0), 3).count() == 0


def matrix(spark, n=40, p=6):
    rng = np.random.default_rng(3)
    x = rng.random((n, 2)) @ rng.random((2, p)) + 0.01 * rng.random((n, p))
    return x, spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, data array<double>")


def test_factorisations(spark):
    x, rows = matrix(spark)
    _, s, _ = factor.svd(rows, 6)
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False))
    w, h = factor.nmf(rows, 6, 2, 30)
    back = np.array([r["data"] for r in w.orderBy("id").collect()]) @ h
    assert np.abs(back - x).max() < 0.1
    scores, _ = factor.ica(rows, 6, 2)
    z = np.array([r["data"] for r in scores.collect()])
    assert np.allclose(np.cov(z.T), np.eye(2), atol=1e-6)
    a, ends = factor.nfindr(rows, 6, 3)
    a = np.array([r["data"] for r in a.collect()])
    assert (a >= -1e-12).all() and np.allclose(a.sum(1), 1) and len(np.unique(ends, axis=0)) == 3
    with pytest.raises(AssertionError):
        factor.factor(rows, "other", 6, 2)


@pytest.mark.parametrize("ndim", [1, 2, 3])
def test_layer_shapes(ndim):
    x = np.random.default_rng(0).random((2, 1, *[8] * ndim))
    assert nn.ConvBlock(ndim, 2, 1, 3, pool=True, batchnorm=True)(x).shape == (2, 3, *[4] * ndim)
    assert nn.UpsampleBlock(ndim, 1, 2, "nearest")(x).shape == (2, 2, *[16] * ndim)


def test_layer_errors():
    with pytest.raises(AssertionError):
        nn.ConvBlock(4, 1, 1, 1)
    with pytest.raises(NotImplementedError):
        nn.UpsampleBlock(2, 1, 1, "cubic")


def test_training_lowers_the_loss_and_repeats(spark):
    _, rows = matrix(spark)
    one, two = nn.Trainer(6, rate=1e-2), nn.Trainer(6, rate=1e-2)
    a, b = one.fit(rows, 5), two.fit(rows, 5)
    assert a[-1] < a[0] and np.allclose(a, b)


def test_tessellation_of_every_label(spark):
    """Triangles by brute force in each of the ten labels; cells, sites and polygons of all of them."""
    sf = "/root/testdata/sf0.001"
    rows = carriers.points(spark, sf).collect()
    want = set()
    for g in {r.type for r in rows}:
        mine = sorted((r.id, r.x, r.y) for r in rows if r.type == g)
        ids, xy = np.array([m[0] for m in mine]), np.array([m[1:] for m in mine])
        t = np.array(list(itertools.combinations(range(len(mine)), 3)))
        a, u, v = xy[t[:, 0]], xy[t[:, 1]] - xy[t[:, 0]], xy[t[:, 2]] - xy[t[:, 0]]
        det = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        uu, vv = (u * u).sum(1), (v * v).sum(1)
        at = np.stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu], 1) / det[:, None]
        far = ((xy[None] - (a + at)[:, None]) ** 2).sum(2) - (at * at).sum(1)[:, None]
        far[np.arange(len(t))[:, None], t] = np.inf
        want |= {(g, *map(int, ids[k])) for k in t[(far > -1e-12).all(1)]}
    assert {tuple(r) for r in registry.QUERIES["delaunay"](spark, sf).collect()} == want
    assert {tuple(r)[:4] for r in registry.QUERIES["circumcenters"](spark, sf).collect()} == want
    areas = {r.id: r.log_area for r in registry.QUERIES["voronoi_area"](spark, sf).collect()}
    assert set(areas) == {r.id for r in rows} and None in areas.values()
    label = {r.id: r.type for r in rows}
    units = registry.QUERIES["structural_units"](spark, sf).collect()
    assert all(len({label[i] for i in r.atom_ids}) == 1 for r in units)
    assert {label[r.atom_ids[0]] for r in units} == set(label.values())
    assert {r.unit_id >> 40 for r in registry.QUERIES["polygons"](spark, sf).collect()} == set(label.values())
    assert all(r.i >> 40 == r.j >> 40 for r in registry.QUERIES["interstitial_pairs"](spark, sf).collect())


def test_neighbours_of_every_point_and_every_phase(spark):
    sf = "/root/testdata/sf0.001"
    n = carriers.points(spark, sf).count()
    found = registry.QUERIES["knn_join"](spark, sf)
    assert found.count() == 7 * n and found.where("rank = 0 and i = j").count() == n
    phases = registry.QUERIES["window_fft_phase"](spark, sf)
    assert phases.groupBy("k").count().where(f"count = {9 * n}").count() == 16
    assert phases.where("abs(co * co + si * si - 1) > 1e-3").count() == 0


def test_iterations_are_not_cut(spark):
    sf = "/root/testdata/sf0.001"
    images = {r.img: np.reshape(r.data, (8, 8)) for r in carriers.images(spark, sf).where("img < 20").collect()}
    probe, open_ends = np.fft.fft2(np.fft.fftshift(signal.gauss(8, 1.5))), 0
    got = {k: np.zeros((8, 8)) for k in images}
    for r in registry.QUERIES["decon_lr"](spark, sf).where("img < 20").collect():
        got[r.img][r.r, r.c] = r.v
    for k, x in images.items():
        x = x - x.min() + 1e-9
        est, change, n = x, 1.0, 0
        while change > 1e-4 and n < 501:
            ratio = x / np.fft.ifft2(np.fft.fft2(est) * probe).real
            was, est = est, est * np.fft.ifft2(np.fft.fft2(ratio) * probe.conj()).real
            change, n = ((est - was) ** 2).sum() / abs(est.sum()) * 100, n + 1
        open_ends += n > 50
        assert np.allclose(got[k], est, atol=1e-3)
    assert len(images) == 20 and open_ends
    whole, short = ({r.f: r.data for r in registration.demon_registration(registration.frames(carriers.stack(spark, sf)), n).collect()} for n in (200, 20))
    demons = {r.f: r.data for r in registry.QUERIES["demon_register"](spark, sf).collect()}
    assert all(np.allclose(demons[f], whole[f], atol=1e-3) for f in whole)
    assert any(not np.allclose(whole[f], short[f], atol=1e-3) for f in whole)


def test_many_spots_are_not_refused(spark):
    """More spots than the former limits; a square grid has two-fold and four-fold symmetry, whichever its label."""
    n = 46
    rows = [(g, g * 10_000 + a * n + b, float(a - (n - 1) / 2), float(b - (n - 1) / 2)) for g in (0, 1) for a in range(n) for b in range(n)]
    spots = spark.createDataFrame(rows, "g int, id long, u double, v double")
    out = {(r.g, r.n): r for r in spectral.rotational_symmetry(spots).collect()}
    assert len(out) == 8 and all(out[g, k].symmetric and abs(out[g, k].d) < 1e-9 for g in (0, 1) for k in (2, 4))
    mine = spots.where("g = 0")
    alone = {r.n: r.d for r in spectral.rotational_symmetry(mine.drop("g")).collect()}
    assert alone == {k: out[0, k].d for k in alone} and len(alone) == 4
    assert points.midpoints(mine.select("id", F.col("u").alias("x"), F.col("v").alias("y"))).count() == n**4


def test_demons_keep_shape_and_lower_the_difference():
    r, c = np.meshgrid(np.arange(24.0), np.arange(24.0), indexing="ij")
    fixed, moving = (np.exp(-((r - a) ** 2 + (c - 12) ** 2) / 20) for a in (12, 13.5))
    out = registration.demons(moving, fixed, 100)
    assert np.abs(out - fixed).sum() < 0.6 * np.abs(moving - fixed).sum()


def test_components_of_a_long_chain(spark):
    n = 10_000
    chain = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("i"), ((F.col("id") + 1) * 7919 % n).alias("j"))
    got = graph.components(chain)
    assert got.count() == n and got.where("component <> 0").count() == 0
    assert graph.components(chain.where("i = j")).count() == 0


def test_neighbours_of_far_queries_and_clusters(spark):
    """Dense clusters, lone points and queries far outside, against brute force."""
    rng = np.random.default_rng(41)
    xy = np.concatenate([rng.normal(0, 1e-3, (60, 2)), rng.normal(5, 1e-3, (60, 2)), rng.uniform(0, 5, (8, 2)), [[0, 0], [0, 0]]])
    q = np.concatenate([xy[::9], rng.uniform(-40, 40, (12, 2))])
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double")
    qs = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(q)], "id long, x double, y double")
    got = {}
    for r in points.knn(qs, p, 5).collect():
        got.setdefault(r.i, {})[r.rank] = (r.j, r.d)
    for k, (x, y) in enumerate(q):
        d = np.hypot(xy[:, 0] - x, xy[:, 1] - y)
        want = np.lexsort((np.arange(len(d)), d))[:5]
        assert [got[k][n][0] for n in range(5)] == want.tolist() and np.allclose([got[k][n][1] for n in range(5)], d[want])
    assert points.knn(qs, p.limit(3), 5).count() == 3 * len(q)


def test_overlap_needs_room(spark):
    sites = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.5), (0, 2, 0.9, 0.0, 0.5), (0, 3, 1.8, 0.0, 0.1), (1, 4, 0.1, 0.0, 0.5)], "g int, tri_id long, ux double, uy double, room double")
    assert [(r.i, r.j) for r in graph.overlapping(sites, 0.6).collect()] == [(1, 2)]
    assert graph.overlapping(sites, 0.6, cheat=1.6).count() == 2
    assert graph.overlapping(sites, 0.4).count() == 0


def test_decompositions_of_neighbourhoods(spark):
    rng = np.random.default_rng(3)
    d, angle, dx, dy = (rng.normal(size=(40, 4)) for _ in range(4))
    rows = spark.createDataFrame([(k, *[m[k].tolist() for m in (d, angle, dx, dy)]) for k in range(40)], "id long, d array<double>, angle array<double>, dx array<double>, dy array<double>")
    found = factor.neighbour_svd(rows, 4)
    for kind, m in (("distance", d), ("angle", angle), ("offset", dx + 1j * dy)):
        u, s, vh = found[kind]
        assert np.allclose(s, np.linalg.svd(m, compute_uv=False))
        w = np.array([r.data for r in u.orderBy("id").collect()])
        w = w[:, :4] + 1j * w[:, 4:] if kind == "offset" else w
        assert np.allclose(w * s @ vh, m)
    data = points.interleaved(rows).orderBy("id").collect()
    assert len(data) == 39 and np.allclose(data[3].data, np.stack([dx[3], dy[3]], 1).ravel())


def test_tucker_restores_a_tensor(spark):
    rng = np.random.default_rng(8)
    x = np.einsum("ai,bj,ck,ijk->abc", rng.normal(size=(5, 2)), rng.normal(size=(4, 2)), rng.normal(size=(3, 2)), rng.normal(size=(2, 2, 2)))
    long = spark.createDataFrame([(a, b, c, float(x[a, b, c])) for a in range(5) for b in range(4) for c in range(3)], "a int, b int, c int, v double")
    core, factors = factor.long_tucker(long, ["a", "b", "c"], [5, 4, 3], [2, 2, 2])
    assert core.count() == 8 and all(np.allclose(u.T @ u, np.eye(2)) for u in factors)
    back = {(r.a, r.b, r.c): r.v for r in factor.tucker_reconstructed(core, ["a", "b", "c"], factors).collect()}
    assert max(abs(back[k] - x[k]) for k in back) < 1e-9 and len(back) == 60
    with pytest.raises(ValueError):
        factor.long_tucker(long, ["a", "b", "c"], [5, 4, 3], [2, 2, 4])


def test_window_options_and_rescaling(spark):
    for wrong in ({"mode": "other"}, {"filter": "box"}, {"fft_mode": "real"}, {"zoom": 0.5}):
        with pytest.raises(ValueError):
            grid.WindowOptions((4, 4), (2, 2), **wrong)
    assert grid.WindowOptions((4, 4), (2, 2), zoom=3, interpolation=2).zoom == 3
    x = np.random.default_rng(2).random((3, 4))
    win = spark.createDataFrame([(0, 0, 0, a, b, float(x[a, b])) for a in range(3) for b in range(4)], "img long, wr int, wc int, a int, b int, v double")
    got = {(r.a, r.b): r.v for r in grid.rescaled(win, (3, 4), 2).collect()}
    want = np.stack([np.interp((np.arange(6) + 0.5) / 2 - 0.5, np.arange(3), c) for c in x.T], 1)
    want = np.stack([np.interp((np.arange(8) + 0.5) / 2 - 0.5, np.arange(4), r) for r in want])
    assert len(got) == 48 and all(np.isclose(want[k], v) for k, v in got.items())


def test_gates_sets_and_headers(spark):
    long = spark.createDataFrame([(0, r, c, 1.0) for r in range(6) for c in range(6)], "img long, r int, c int, v double")
    atoms = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 3, 3)], "img long, atom_id long, x int, y int")
    kept = lambda **k: {r.atom_id: (r.total, r.kept) for r in points.intensity_gate(long, atoms, 1, **k).collect()}
    assert kept(min_int=5) == {0: (4.0, False), 1: (9.0, True)} and kept(min_int=3, max_int=9) == {0: (4.0, True), 1: (9.0, False)}
    head = spark.createDataFrame([(1, "raw", "lab", "current", "nA", "IMAGE", [("x", "nm", "SPATIAL", 0.5, 0.25, 3)], {"method": "old", "kept": "yes"})], headers.SCHEMA)
    new = headers.provenance(headers.like(head, "clean ", data_type=F.lit("IMAGE_STACK")), "nmf", k=3).first()
    assert (new.title, new.source, new.units, new.data_type) == ("clean raw", "raw", "nA", "IMAGE_STACK")
    assert new.metadata == {"method": "old", "kept": "yes", "analysis": "nmf", "k": "3"}
    assert [(r.axis, r.value) for r in headers.axis_values(head).orderBy("i").collect()] == [("x", 0.5), ("x", 0.75), ("x", 1.0)]


def test_batches_follow_the_order_of_keys(spark):
    keys = list(range(0, 3000, 7))
    df = spark.createDataFrame([(k,) for k in np.random.default_rng(0).permutation(keys).tolist()], "k long").repartition(9)
    got = {r.k: r.batch for r in nn.batch_ids(df, "k", 32).collect()}
    assert got == {k: n // 32 for n, k in enumerate(keys)}
