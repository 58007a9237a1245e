"""Factorisations that run to convergence, kernels, Tucker rounds, splines and parts of pixels, against plain numpy."""

import numpy as np
import pytest

from spectrallake.functions import signal
from spectrallake.operators import factor, registration


def table(spark, x):
    return spark.createDataFrame([(k, r.ravel().tolist()) for k, r in enumerate(x)], "id long, data array<double>")


def values(df):
    return np.array([r["data"] for r in df.orderBy("id").collect()])


def test_nonnegative_least_squares_is_exact():
    rng = np.random.default_rng(1)
    h, x = rng.random((3, 8)), rng.normal(size=(50, 8))
    w = factor.nonnegative(x @ h.T, h @ h.T)
    slope = w @ (h @ h.T) - x @ h.T
    assert (w >= 0).all() and (slope > -1e-6).all() and np.abs(w * slope).max() < 1e-6  # Karush-Kuhn-Tucker


def test_nmf_and_cp_run_until_the_fit_stands_still(spark):
    rng = np.random.default_rng(2)
    x = rng.random((60, 3)) @ rng.random((3, 16)) + 0.05 * rng.random((60, 16))
    rows = table(spark, x)
    error = lambda w, h: ((values(w) @ h - x) ** 2).sum()
    fitted, long = error(*factor.nmf(rows, 16, 3)), error(*factor.nmf(rows, 16, 3, rounds=60, tolerance=0.0))
    assert fitted <= 1.01 * long and error(*factor.nmf(rows, 16, 3, rounds=1)) > 1.01 * fitted
    t = np.einsum("nr,ar,br->nab", rng.random((40, 2)), rng.random((4, 2)), rng.random((5, 2)))
    w, fa, fb, weight = factor.cp(table(spark, t), (4, 5), 2)
    back = np.einsum("nr,ar,br->nab", values(w), fa, fb)
    assert ((back - t) ** 2).sum() < 1e-3 * (t**2).sum() and (fa >= 0).all() and (fb >= 0).all() and len(weight) == 2


def test_constrained_abundances_are_exact():
    rng = np.random.default_rng(3)
    ends, x = rng.normal(size=(3, 5)), rng.normal(size=(30, 5))
    a = factor.fcls(x, ends)
    assert np.allclose(a.sum(1), 1) and (a >= 0).all()
    far = ((a @ ends - x) ** 2).sum(1)
    for _ in range(300):
        other = rng.dirichlet(np.ones(3) * 0.5, 30)
        assert (far <= ((other @ ends - x) ** 2).sum(1) + 1e-9).all()


def test_kernel_pca_with_all_rows_as_landmarks_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    n = len(x)
    centre = np.eye(n) - 1 / n
    for kernel, gamma in (("rbf", 0.5), ("poly", 0.3), ("cosine", None), ("linear", None)):
        own = factor.KERNELS[kernel](x, x, gamma or 1 / 3)
        want, vectors = np.linalg.eigh(centre @ own @ centre)
        scores, got = factor.kernel_pca(table(spark, x), 3, 3, kernel, gamma)
        assert np.allclose(got, want[::-1][:3], rtol=1e-6)
        exact = vectors[:, ::-1][:, :3] * np.sqrt(want[::-1][:3])
        assert np.allclose(np.abs(values(scores)), np.abs(exact), atol=1e-5)
    few = factor.kernel_pca(table(spark, x), 3, 2, "rbf", 0.05, most=20)[1]
    exact = np.linalg.eigvalsh(centre @ factor.KERNELS["rbf"](x, x, 0.05) @ centre)[::-1][:2]
    assert np.allclose(few, exact, rtol=0.05)
    with pytest.raises(ValueError):
        factor.kernel_pca(table(spark, x), 3, 2, "other")
    named = factor.factor(table(spark, x), "kernelpca", 3, 2, kernel="rbf", gamma=0.5)
    assert values(named[0]).shape == (40, 2)


def plain_tucker(x, ranks, rounds):
    """Alternating rounds on a whole tensor."""
    unfold = lambda t, m: np.moveaxis(t, m, 0).reshape(t.shape[m], -1)
    left = lambda t, m, r: np.linalg.svd(unfold(t, m), full_matrices=False)[0][:, :r]
    u = [left(x, m, r) for m, r in enumerate(ranks)]
    project = lambda skip: np.einsum("abc,ar,bs,ct->rst", x, *[np.eye(len(f)) if m == skip else f for m, f in enumerate(u)])
    start = np.linalg.norm(x) ** 2 - np.linalg.norm(project(None)) ** 2
    for _ in range(rounds):
        for m in range(3):
            u[m] = left(project(m), m, ranks[m])
    return np.sqrt(start) / np.linalg.norm(x), np.sqrt(max(np.linalg.norm(x) ** 2 - np.linalg.norm(project(None)) ** 2, 0)) / np.linalg.norm(x)


def test_tucker_rounds_lower_the_error_of_the_first_step(spark):
    rng = np.random.default_rng(5)
    x = np.einsum("nr,as,bt,rst->nab", rng.normal(size=(30, 3)), rng.normal(size=(6, 2)), rng.normal(size=(5, 2)), rng.normal(size=(3, 2, 2))) + 1.5 * rng.normal(size=(30, 6, 5))
    first, best = plain_tucker(x, (3, 2, 2), 60)
    w, fa, fb, core, errors = factor.tucker(table(spark, x), (6, 5), (3, 2, 2), tolerance=1e-9)
    assert errors[-1] < first and abs(errors[-1] - best) < 1e-5
    back = values(factor.tucker_rebuilt(w, fa, fb, core)).reshape(x.shape)
    assert abs(np.linalg.norm(back - x) / np.linalg.norm(x) - errors[-1]) < 1e-8
    u = values(w)
    assert all(np.allclose(f.T @ f, np.eye(f.shape[1])) for f in (u, fa, fb))
    with pytest.raises(ValueError):
        factor.tucker(table(spark, x), (6, 5), (5, 2, 2))
    with pytest.raises(ValueError):
        factor.tensor_decomposition(table(spark, x), (6, 5), 2, "other")
    assert len(factor.tensor_decomposition(table(spark, np.abs(x)), (6, 5), 2, rounds=2)) == 4


def dense_spline(x):
    """Coefficients by solving the whole system, mirrored at both ends."""
    n = len(x)
    m = np.zeros((n, n))
    for k in range(n):
        m[k, k] += 4 / 6
        m[k, abs(k - 1)] += 1 / 6
        m[k, n - 1 - abs(n - 1 - (k + 1))] += 1 / 6
    return np.linalg.solve(m, x)


@pytest.mark.parametrize("n", [2, 3, 7, 60])
def test_spline_coefficients(n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    assert np.allclose(signal.spline_coefficients(x, 0), dense_spline(x))
    assert np.allclose(signal.spline_coefficients(x.T, 1), dense_spline(x).T)
    assert np.allclose(signal.spline_coefficients(x[:1], 0), x[:1])


def bumps(h, w, dr=0.0, dc=0.0):
    r, c = np.meshgrid(np.arange(h) - dr, np.arange(w) - dc, indexing="ij")
    return sum(a * np.exp(-((r - y) ** 2 + (c - x) ** 2) / 18) for a, y, x in ((1, 14, 12), (0.7, 22, 25), (0.5, 16, 30)))


def test_images_move_by_parts_of_a_pixel():
    x = bumps(40, 44)
    assert np.allclose(signal.spline_shifted(x, (3, -2)), bumps(40, 44, 3, -2), atol=1e-4)
    assert np.abs(signal.spline_shifted(x, (0.25, -1.6)) - bumps(40, 44, 0.25, -1.6)).max() < 1e-3
    assert (signal.spline_shifted(x + 1, (2.5, 0))[:3] == 0).all()


def test_registration_restores_shifts_of_a_quarter_pixel(spark):
    shifts = [(0, 0), (0.25, -0.5), (0.75, -0.25), (1.5, 0.5), (1.25, 1.25)]
    stack = spark.createDataFrame([(f, r, c, float(v)) for f, (dr, dc) in enumerate(shifts) for (r, c), v in np.ndenumerate(bumps(40, 44, dr, dc))], "f int, r int, c int, v double")
    registered, drift = registration.rigid_registration(stack, 40, 44, upsample=20)
    got = {r.f: (r.dr, r.dc) for r in drift.collect()}
    middle = np.array(shifts[2])
    for f, s in enumerate(shifts):
        assert np.allclose(got[f], middle - s, atol=0.051)
    rows = registered.toPandas()
    frames = [rows[rows.f == f].pivot(index="r", columns="c", values="v").to_numpy() for f in range(5)]
    assert max(np.abs(f - frames[2]).max() for f in frames) < 0.03
    whole = registration.rigid_registration(stack, 40, 44)[0].toPandas()
    plain = [whole[whole.f == f].pivot(index="r", columns="c", values="v").to_numpy() for f in range(5)]
    assert max(np.abs(f - plain[2]).max() for f in plain) > 0.05
