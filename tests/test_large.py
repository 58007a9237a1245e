"""What large images, groups and tables take another way for gives what the plain way gives."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectrallake import registry
from spectrallake.functions import signal
from spectrallake.operators import blobs, blocks, cluster, factor, filters, graph, nn, points, ranks, tessellation, trees


def long_images(spark, images):
    rows = [pd.DataFrame({"img": k, "r": np.repeat(np.arange(x.shape[0]), x.shape[1]), "c": np.tile(np.arange(x.shape[1]), x.shape[0]), "v": x.ravel()}) for k, x in enumerate(images)]
    return spark.createDataFrame(pd.concat(rows)).repartition(5)


def textures():
    rng = np.random.default_rng(12)
    return [signal.smoothed(rng.normal(size=(1, h, w)), s)[0] for h, w, s in ((70, 90, 1.5), (40, 33, 3.0), (5, 61, 1.0))]


def places(df):
    return sorted((r.img, r.x, r.y, round(r.sigma, 6)) for r in df.collect())


@pytest.mark.parametrize("size", [1.0, 3.0])
def test_blobs_of_tiles_are_those_of_whole_images(spark, size):
    images = textures()
    long = long_images(spark, images)
    whole = places(blobs.find_blobs(long, size, tile=1000))
    assert len(whole) > 40 and places(blobs.find_blobs(long, size, tile=16)) == whole
    block = spark.createDataFrame([(k, *x.shape, x.ravel().tolist()) for k, x in enumerate(images)], "img long, h int, w int, data array<double>")
    assert places(filters.find_atoms(block, size)) == whole
    assert blobs.find_blobs(long.limit(0)).count() == 0


def test_suppression_keeps_the_strongest_in_chains(spark):
    """A long row of blobs, each weaker than the one before and over it: every second one stays."""
    row = [(0, 2.0 * k, 0.0, 1.5, 100.0 - k) for k in range(40)] + [(1, 0.0, 0.0, 1.0, 5.0), (1, 0.0, 0.0, 2.0, 5.0), (2, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(row, "img long, x double, y double, sigma double, s double")
    got = sorted((r.img, r.x, r.sigma) for r in blobs.suppressed(df).collect())
    x = np.array([r[1] for r in row[:40]])
    stays = filters.strongest(x, np.zeros(40), np.full(40, 1.5))
    assert got == [(0, float(v), 1.5) for v in x[stays]] + [(1, 0.0, 1.0), (2, 0.0, 1.0)] and stays.sum() == 20


def test_fits_of_many_atoms_at_once(spark):
    rng = np.random.default_rng(7)
    rows, cols = (g.ravel() - 3 for g in np.meshgrid(np.arange(7.0), np.arange(7.0), indexing="ij"))
    truth = np.column_stack([rng.uniform(1, 5, 50), rng.uniform(-0.8, 0.8, (50, 2)), rng.uniform(1, 1.8, (50, 2)), rng.uniform(-1, 1, 50)])
    v = filters.oval_gauss(truth, rows, cols)
    df = spark.createDataFrame([(k, 10.0, 20.0, r.tolist()) for k, r in enumerate(v)], "atom_id long, x double, y double, data array<double>")
    got = filters.atom_refine(df, 3).orderBy("atom_id").toPandas()
    assert got["accepted"].all() and np.allclose(got[["x", "y"]], truth[:, 1:3] + [10, 20], atol=1e-6) and np.allclose(got[["width_x", "width_y"]], truth[:, 3:5], atol=1e-6)
    total = v.sum(1)
    gated = filters.atom_refine(df, 3, min_int=float(np.median(total)), max_int=float(total.max())).orderBy("atom_id").toPandas()
    kept = (total > np.median(total)) & (total < total.max())
    assert (gated["accepted"] == kept).all() and (gated.loc[~kept, "x"] == 10).all()
    noise = rng.normal(size=(20, 49))
    odd = spark.createDataFrame([(k, 0.0, 0.0, r.tolist()) for k, r in enumerate([*noise, np.zeros(49), np.full(49, 3.0)])], "atom_id long, x double, y double, data array<double>")
    assert np.isfinite(filters.atom_refine(odd, 3).select("x", "y", "amplitude").toPandas()).all().all()


def test_a_fit_without_a_solution_is_damped(spark):
    """A patch of a table of 51,282 images on which the equations of a round are singular: it ends, and others keep their fits."""
    noise = [0.20709647238254547, 0.04588032886385918, 0.16247214376926422, 0.06641692668199539, 0.17372798919677734, -0.16775141656398773, 0.03821196034550667, 0.12988480925559998, -0.11582972854375839, -0.12795709073543549, -0.19656166434288025, 0.02510927990078926, 0.22590580582618713, -0.3140552341938019, -0.0016242550918832421, 0.06014882028102875, 0.09557567536830902, 0.024589478969573975, 0.027632681652903557, -0.09772282093763351, -0.006606380920857191, 0.06941645592451096, 0.00249576848000288, 0.03833220526576042, 0.012923456728458405]
    rows, cols = (g.ravel() - 2 for g in np.meshgrid(np.arange(5.0), np.arange(5.0), indexing="ij"))
    blob = filters.oval_gauss(np.array([2.0, 0.3, -0.2, 1.1, 0.9, 0.5]), rows, cols).tolist()
    df = spark.createDataFrame([(0, 3.0, 3.0, noise), (1, 3.0, 3.0, blob)], "atom_id long, x double, y double, data array<double>").coalesce(1)
    got = filters.atom_refine(df, 2).orderBy("atom_id").toPandas()
    assert np.isfinite(got[["x", "y", "amplitude", "width_x", "width_y", "offset"]]).all().all()
    assert np.allclose(got.loc[1, ["x", "y", "amplitude"]].astype(float), [3.3, 2.8, 2.0], atol=1e-6)


def test_ranks_and_order_statistics_of_uneven_groups(spark):
    rng = np.random.default_rng(9)
    v = pd.concat([pd.DataFrame({"g": g, "v": x}) for g, x in enumerate((rng.normal(size=5000), rng.integers(0, 3, 400).astype(float), np.full(50, 2.5), rng.random(3), np.concatenate([rng.random(200), [1e12, -1e12]])))])
    v["id"] = np.arange(len(v))
    df = spark.createDataFrame(v).repartition(6)
    got = ranks.ranked(df, ["g"], ["v", "id"]).toPandas().set_index("id")["rank"]
    want = v.sort_values(["v", "id"]).groupby("g").cumcount().add(1)
    assert (got.sort_index().to_numpy() == pd.Series(want.to_numpy(), index=v.sort_values(["v", "id"])["id"]).sort_index().to_numpy()).all()
    assert sorted(r["rank"] for r in ranks.ranked(df.limit(10), [], ["v", "id"]).collect()) == list(range(1, 11))
    asked = [(g, int(p)) for g, n in ((0, 5000), (1, 400), (2, 50), (3, 3), (4, 202)) for p in (1, n // 2 + 1, n)]
    for k in range(3):
        part = asked[k::3]
        stat = ranks.order_statistic(df.unionByName(spark.createDataFrame([(0, None, -1)], "g long, v double, id long")), ["g"], spark.createDataFrame(part, "g long, place long"), bins=16)
        assert {r.g: r.value for r in stat.collect()} == {g: float(np.sort(v["v"][v["g"] == g])[p - 1]) for g, p in part}
    assert ranks.order_statistic(df, ["g"], spark.createDataFrame([(3, 4), (9, 1), (1, 0)], "g long, place long")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_permutations_take_each_place_once(n):
    place = np.arange(n)
    a, b = ranks.permuted(place, n, 1), ranks.permuted(place, n, 2)
    assert sorted(a) == sorted(b) == list(range(n)) and (a == ranks.permuted(place, n, 1)).all()
    if n > 60:
        assert (a != b).mean() > 0.9 and abs(np.corrcoef(place, a)[0, 1]) < 0.3


def test_batches_are_exact_and_do_not_depend_on_partitions(spark):
    df = spark.range(0, 2010, 2).withColumn("x", F.rand(1))
    of = lambda d, epoch: {r.id: (r.batch, r.slot) for r in ranks.shuffled_batches(ranks.numbered(d, ["id"]), 1005, 100, 3, epoch).collect()}
    one = of(df, 0)
    assert one == of(df.repartition(7, "x"), 0) and one != of(df, 1)
    counts = pd.Series([b for b, _ in one.values()]).value_counts()
    assert sorted(counts.index) == list(range(11)) and counts[10] == 5 and (counts.drop(10) == 100).all()
    assert len(set(one.values())) == 1005


def test_training_in_batches_with_a_test_pass(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2)) @ rng.normal(size=(2, 6))
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, data array<double>")
    t, again = nn.Trainer(6, rate=0.02), nn.Trainer(6, rate=0.02)
    losses = t.fit(rows.where("id < 80"), 4, batch_size=30, test=rows.where("id >= 80"))
    assert len(losses) == len(t.test_losses) == 4 and losses[-1] < losses[0] and t.test_losses[-1] < t.test_losses[0] and len(t.losses) == 12
    assert np.allclose(losses, again.fit(rows.where("id < 80").repartition(3), 4, batch_size=30))


def test_trees_are_rolled_up_like_a_loop(spark):
    """A random tree and a chain of joins, against a loop over the joins."""
    rng = np.random.default_rng(13)
    leaves = [(k, int(rng.integers(1, 9)), *map(float, rng.normal(size=2))) for k in range(60)]
    df = spark.createDataFrame(leaves, "label long, n long, x double, y double")
    for chain in (False, True):
        open_, joins = list(range(60)), []
        while len(open_) > 1:
            a = open_.pop(-1 if chain else int(rng.integers(len(open_))))
            b = open_.pop(0 if chain else int(rng.integers(len(open_))))
            open_.append(60 + len(joins))
            joins.append((a, b))
        want = {k: (0, 1, n, x, y) for k, n, x, y in leaves}
        for j, (a, b) in enumerate(joins):
            p, q = want[a], want[b]
            n = p[2] + q[2]
            want[60 + j] = (max(p[0], q[0]) + 1, p[1] + q[1], n, (p[3] * p[2] + q[3] * q[2]) / n, (p[4] * p[2] + q[4] * q[2]) / n)
        got = {r.node: r for r in graph.cluster_tree(joins, df).collect()}
        assert set(got) == set(want)
        for k, (level, size, n, x, y) in want.items():
            r = got[k]
            assert (r.level, r.n_leaves, r.n) == (level, size, n) and abs(r.x - x) < 1e-9 and abs(r.y - y) < 1e-9
            assert (r.left, r.right) == (joins[k - 60] if k >= 60 else (None, None))
    assert trees.rolled_up(spark.createDataFrame([], "node long, parent long, v long"), ["v"]).count() == 0


def test_few_edges_are_joined_up_in_one_task(spark):
    rng = np.random.default_rng(3)
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 560)] + [(9, 9), (None, 3)], "i long, j long")
    few, many = (sorted((r.node, r.component) for r in graph.components(pairs, n).collect()) for n in (10_000, 0))
    assert few == many and len(few) > 300
    assert graph.components(pairs.limit(0)).count() == 0


def test_latent_places_are_counted_before_they_are_rounded(spark, tmp_path):
    """Images whose latent places lie 3e-7 beside the bounds of a node, on either side."""
    w = nn.formula_weights((2, 64))
    to_image = np.linalg.pinv(w)
    ends = [(m * 0.015 + e, 0.004) for m in range(-5, 6) for e in (-3e-7, 3e-7)]
    images = [to_image @ np.array(z) for pair in ends for z in (pair, pair[::-1])]
    df = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(images)], "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(i, j): n for i, j, n in c.execute(f"SELECT i, j, n FROM ({registry.ORACLES['decode_grid_points']})").fetchall()}
    assert {(r.i, r.j): r.n for r in registry.QUERIES["decode_grid_points"](spark, str(tmp_path)).collect()} == want


def test_images_come_to_functions_some_at_a_time(spark):
    """A batch of many images is not worked on whole, and blobs are those of each image alone."""
    rng = np.random.default_rng(8)
    images = rng.normal(size=(3000, 8, 8))
    block = spark.createDataFrame([(k, 8, 8, x.ravel().tolist()) for k, x in enumerate(images)], "img long, h int, w int, data array<double>").coalesce(1)
    sizes = blocks.map_to_rows(block, lambda ids, x: {"first": ids[:1], "n": [len(x)]}, "first long, n long").toPandas()
    assert sizes["n"].sum() == 3000 and sizes["n"].max() * 64 <= blocks.PIXELS
    got, few = places(filters.find_atoms(block, 2.0)), places(filters.find_atoms(block.where("img >= 2900"), 2.0))
    assert few and [p for p in got if p[0] >= 2900] == few


def test_kernel_features_stay_in_their_task(spark):
    """Rows of a table are as wide as the data or the scores, never as the landmarks; more rows than are worked on at once give the exact kernel's scores."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, 3)), 80, 0)[:2300]
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, data array<double>").coalesce(1)
    scores, values = factor.kernel_pca(rows, 3, 2, "rbf", 0.5, most=2300)
    assert scores._jdf.queryExecution().analyzed().toString().count("MapInPandas") == 1
    kernel = factor.KERNELS["rbf"](x, x, 0.5)
    centred = kernel - kernel.mean(0) - kernel.mean(1)[:, None] + kernel.mean()
    assert np.allclose(values, np.linalg.eigvalsh(centred)[::-1][:2], rtol=1e-6)
    got = np.array([r.data for r in scores.orderBy("id").collect()])
    assert np.allclose((got**2).sum(0), values, rtol=1e-6)


def plain_dbscan(rows, eps, least):
    ids = [r[0] for r in rows if r[1] is not None and r[2] is not None and np.isfinite(r[1:]).all()]
    at = {r[0]: np.array(r[1:]) for r in rows if r[0] in set(ids)}
    near = {i: [j for j in ids if j != i and np.hypot(*(at[i] - at[j])) < eps] for i in ids}
    core = {i for i in ids if len(near[i]) + 1 >= least} | ({r[0] for r in rows} if least <= 1 else set())
    out = dict.fromkeys([r[0] for r in rows])
    for i in sorted(core):
        if out[i] is None:
            todo = [i]
            while todo:
                k = todo.pop()
                if out[k] is None:
                    out[k] = i
                    todo += [j for j in near.get(k, []) if j in core]
    return {i: min((out[j] for j in near.get(i, []) if j in core), default=None) if c is None else c for i, c in out.items()}


@pytest.mark.parametrize("least", [1, 2, 3, 6])
def test_dbscan_by_cells_is_plain_dbscan(spark, least):
    rng = np.random.default_rng(least)
    dense = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.4, 120), ((3, 0), 1.2, 120), ((-30, 4), 8, 80))])
    # Two walls of points, nearest to each other in the middle only, at some distance that no outermost point has.
    wall = [(x, y + side * (0.62 + 0.2 * (x - 40) ** 2)) for x in np.linspace(39, 41, 41) for y in (0.0,) for side in (0, 1)]
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate([*dense, *wall, (0.0, 0.0), (0.0, 0.0), (9.0, 9.0), (9.7, 9.0), (10.4, 9.0)])]
    rows += [(1000, float("nan"), 0.0), (1001, None, 0.0), (1002, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    for eps in (0.3, 0.65, 0.7):
        assert {r.id: r.cluster for r in cluster.dbscan(df, eps, least).collect()} == plain_dbscan(rows, eps, least)


def test_dbscan_makes_no_pairs_of_a_dense_place(spark, monkeypatch):
    """5,000 points within reach of each other: edges are those of cells, not 12 million of points."""
    seen = []
    plain = cluster.components
    monkeypatch.setattr(cluster, "components", lambda pairs: (seen.append(pairs.count()), plain(pairs))[1])
    df = spark.range(5000).select("id", (F.col("id") % 100 / 1000).alias("x"), (F.floor(F.col("id") / 100) / 1000).alias("y"))
    assert {r.cluster for r in cluster.dbscan(df, 0.2, 3).collect()} == {0}
    assert max(seen) < 100


@pytest.mark.parametrize("axes", ["xy", "xyz"])
def test_tiles_are_spread_over_tasks(spark, monkeypatch, axes):
    """Tiles are few bytes and much work, so they have tasks of their own; any tiling of uneven points gives the same simplices."""
    files = []
    plain = tessellation.settled

    def seen(df, name="round"):
        out = plain(df, name)
        if name == "simplices":
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(tessellation, "settled", seen)
    rng = np.random.default_rng(6)
    p = rng.normal(size=(1500, len(axes))) * np.exp(rng.normal(size=(1500, 1)) * 1.5)
    df = spark.createDataFrame([(0, k, *map(float, r)) for k, r in enumerate(p)], "g int, id long, " + ", ".join(f"{c} double" for c in axes))
    tiled = {tuple(r) for r in tessellation.delaunay(df, 100, tuple(axes)).collect()}
    assert files[0] > 4
    assert tiled == {tuple(r) for r in tessellation.delaunay(df, 10_000, tuple(axes)).collect()}


def test_pairs_of_large_groups_are_made_in_blocks(spark):
    """All pairs of a group, each once, by keys that deal the group to more than one task."""
    rows = [(k % 3 if k < 90 else 7 if k < 250 else None, k, float(k), k / 4) for k in range(255)]
    df = spark.createDataFrame(rows, "g int, id long, x double, y double")
    got = points.midpoints(df, 50)
    assert "bi" in got._jdf.queryExecution().optimizedPlan().toString()
    made = sorted(tuple(r) for r in got.collect())
    assert made == sorted((g, i, j, (x + a) / 2, (y + b) / 2) for g, i, x, y in rows for h, j, a, b in rows if g is not None and g == h)


def test_blocks_of_pairs_do_not_grow_in_number_with_a_group(spark, monkeypatch):
    """A spot goes to as many tasks as its group has blocks: no more than the tasks need, and no fewer than memory bears."""
    monkeypatch.setattr(points, "PAIR_TASKS", 16)
    df = spark.range(640).select(F.lit(0).alias("g"), "id", F.col("id").cast("double").alias("x"), (F.col("id") / 4).alias("y"))

    def blocks():
        got = points.midpoints(df, 10)
        assert got.count() == 640**2 and got.select("i", "j").distinct().count() == 640**2
        return int(re.search(r"xxhash64\(id#\d+L?, 42\), (\d+)", got._jdf.queryExecution().optimizedPlan().toString())[1])

    assert blocks() == 4
    monkeypatch.setattr(points, "MOST_BLOCK", 80)
    assert blocks() == 8
