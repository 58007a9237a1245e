"""Matrix and tensor factorisation.

A matrix is a table of rows with their values in an array (id, data). Products over all rows are small (columns by
columns): each task adds up its own and Spark adds the tasks' sums, so only p x p numbers reach the driver, where p is
the number of columns. What has one entry a row (scores, abundances) is computed by a map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("pca", "svd", "nmf", "ica", "nfindr", "kernelpca")
#: Rows whose features against landmarks are made at once.
WIDE = 1024


def _summed(rows: DataFrame, fn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over batches of fn(matrix of a batch), `size` numbers each, by an aggregation over (position, value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += fn(np.stack(pdf["data"].to_numpy())).ravel()
        yield pd.DataFrame({"k": np.arange(size), "v": total})

    sums = rows.select("data").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in sums:
        out[r.k] = r.v
    return out


def _mapped(rows: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "data": list(fn(np.stack(pdf["data"].to_numpy()))) if len(pdf) else []})

    return rows.select("id", "data").mapInPandas(run, "id long, data array<double>")


def gram(rows: DataFrame, p: int) -> np.ndarray:
    return _summed(rows, lambda x: x.T @ x, p * p).reshape(p, p)


def gram_table(long: DataFrame) -> DataFrame:
    """k1, k2, g: sums of products over rows of long(row, k, v), as SQL would have it. Both sides come from one array a row, so nothing is joined."""
    rows = long.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s"))
    first = rows.select("s", F.explode("s").alias("p"))
    both = first.select("p", F.explode("s").alias("q"))
    return both.groupBy(F.col("p.k").alias("k1"), F.col("q.k").alias("k2")).agg(F.sum(F.col("p.v") * F.col("q.v")).alias("g"))


def moments(rows: DataFrame, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariance) of the columns."""
    return _moments(_summed(rows, lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]), 1 + p + p * p), p)


def _moments(s: np.ndarray, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The same from sums of ones, columns and products."""
    n, mean = int(s[0]), s[1 : p + 1] / max(s[0], 1)
    return n, mean, (s[p + 1 :].reshape(p, p) - n * np.outer(mean, mean)) / max(n - 1, 1)


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest component positive."""
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def pca(rows: DataFrame, p: int, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(scores by row, components (k, p), variances): centred."""
    _, mean, cov = moments(rows, p)
    values, vectors = np.linalg.eigh(cov)
    top = signed(vectors[:, ::-1][:, :k])
    return _mapped(rows, lambda x: (x - mean) @ top), top.T, values[::-1][:k]


def svd(rows: DataFrame, p: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(U by row, s, Vh): all components."""
    values, vectors = np.linalg.eigh(gram(rows, p))
    s, v = np.sqrt(np.maximum(values[::-1], 0)), signed(vectors[:, ::-1])
    inverse = np.where(s > s[0] * 1e-12, 1 / np.maximum(s, 1e-300), 0)
    return _mapped(rows, lambda x: x @ v * inverse), s, v.T


def _start(p: int, k: int) -> np.ndarray:
    """A fixed positive start: no random numbers, so runs agree."""
    i, j = np.meshgrid(np.arange(k), np.arange(p), indexing="ij")
    return 0.5 + ((i * 7 + j * 3) % 11) / 11


def nonnegative(x: np.ndarray, products: np.ndarray, sweeps: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative least squares for many rows: w >= 0 with |x - w h| least, from x h' and h h'. Coordinate descent until nothing changes."""
    w = np.ones_like(x)
    for _ in range(sweeps):
        most = 0.0
        for j in range(x.shape[1]):
            new = np.maximum(w[:, j] + (x[:, j] - w @ products[:, j]) / max(products[j, j], 1e-300), 0)
            most = max(most, np.abs(new - w[:, j]).max(initial=0))
            w[:, j] = new
        if most <= tolerance * max(np.abs(w).max(initial=0), 1e-300):
            break
    return w


#: Alternating factorisations go on until a round lowers the squared error by less than this share, 200 rounds at most.
TOLERANCE, ROUNDS = 1e-5, 200


def nmf(rows: DataFrame, p: int, k: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, np.ndarray]:
    """(W by row, H (k, p)) of a non-negative matrix by alternating non-negative least squares.

    W is found from H alone in each task, so nothing long is kept; H comes from the sums W'X and W'W, the error from them as well.
    """
    h, before = _start(p, k), np.inf

    def weights(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        return nonnegative(x @ h.T, h @ h.T)

    for _ in range(rounds):
        s = _summed(rows, lambda x, h=h: np.concatenate([((w := weights(x, h)).T @ x).ravel(), (w.T @ w).ravel(), [(x * x).sum()]]), k * p + k * k + 1)
        wx, ww = s[: k * p].reshape(k, p), s[k * p : -1].reshape(k, k)
        error = s[-1] - 2 * (wx * h).sum() + (ww * (h @ h.T)).sum()
        if before - error <= tolerance * before < np.inf:
            break
        before, h = error, nonnegative(wx.T, ww).T
    return _mapped(rows, lambda x: weights(x, h)), h


def ica_sums(rows: DataFrame, mean: np.ndarray, white: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a fixed-point step needs of all rows: their number, sums of tanh(w z) z' and of 1 - tanh(w z)^2, z being the whitened row."""
    k = len(w)

    def step(x):
        z = (x - mean) @ white.T
        g = np.tanh(z @ w.T)
        return np.concatenate([[len(x)], (g.T @ z).ravel(), (1 - g**2).sum(0)])

    return _summed(rows, step, 1 + k * k + k)


def ica(rows: DataFrame, p: int, k: int, rounds: int = 60) -> tuple[DataFrame, np.ndarray]:
    """(sources by row, unmixing (k, p)): whitening, then symmetric fixed-point steps with tanh; the sums of a step come from all rows."""
    _, mean, cov = moments(rows, p)
    values, vectors = np.linalg.eigh(cov)
    white = (signed(vectors[:, ::-1][:, :k]) / np.sqrt(np.maximum(values[::-1][:k], 1e-12))).T
    w = np.linalg.qr(_start(k, k) + 2 * np.eye(k))[0]
    for _ in range(rounds):
        s = ica_sums(rows, mean, white, w)
        new = (s[1 : 1 + k * k].reshape(k, k) - s[1 + k * k :, None] * w) / s[0]
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-6
        w = new
        if done:
            break
    unmix = w @ white
    return _mapped(rows, lambda x: (x - mean) @ unmix.T), unmix


def fcls(x: np.ndarray, ends: np.ndarray, rounds: int = 5000, tolerance: float = 1e-10) -> np.ndarray:
    """Abundances of end-members: not negative, summing to one; least squares by accelerated projected gradients until nothing changes."""
    k = len(ends)
    a = np.full((len(x), k), 1 / k)
    g, b = ends @ ends.T, x @ ends.T
    step = 1 / max(np.linalg.eigvalsh(g)[-1], 1e-12)
    ahead, t = a, 1.0
    for _ in range(rounds):
        new = _simplex(ahead - step * (ahead @ g - b))
        then = (1 + np.sqrt(1 + 4 * t * t)) / 2
        back = ((ahead - new) * (new - a)).sum(1, keepdims=True) > 0  # where momentum overshoots, start it anew
        ahead = np.where(back, new, new + (t - 1) / then * (new - a))
        change, a, t = np.abs(new - a).max(initial=0), new, then
        if change < tolerance:
            break
    return a


def _simplex(a: np.ndarray) -> np.ndarray:
    s = -np.sort(-a, 1)
    c = (np.cumsum(s, 1) - 1) / np.arange(1, a.shape[1] + 1)
    n = (s > c).sum(1)
    return np.maximum(a - c[np.arange(len(a)), n - 1][:, None], 0)


def nfindr(rows: DataFrame, p: int, k: int, sweeps: int = 50) -> tuple[DataFrame, np.ndarray]:
    """(abundances by row, end-members (k, p)): the rows that span the largest simplex after a PCA to k - 1 dimensions. Each swap looks at all rows by an aggregation."""
    scores, _, _ = pca(rows, p, k - 1)
    first = scores.orderBy("id").limit(k).collect()
    ids, ends = [r.id for r in first], np.array([r.data for r in first])

    for _ in range(sweeps):
        changed = False
        for j in range(k):
            def volume(batches, j=j, ends=ends):
                for pdf in batches:
                    m = np.ones((len(pdf), k, k))
                    m[:, 1:, :] = ends.T
                    m[:, 1:, j] = np.stack(pdf["data"].to_numpy()) if len(pdf) else np.empty((0, k - 1))
                    yield pd.DataFrame({"id": pdf["id"], "data": pdf["data"], "volume": np.abs(np.linalg.det(m))})

            best = scores.mapInPandas(volume, "id long, data array<double>, volume double").agg(F.max(F.struct("volume", (-F.col("id")).alias("o"), "id", "data")).alias("b")).first().b
            if best.id != ids[j]:
                ids[j], changed = best.id, True
                ends = ends.copy()
                ends[j] = best.data
        if not changed:
            break
    chosen = {r.id: r.data for r in rows.where(F.col("id").isin(ids)).collect()}
    full = np.array([chosen[i] for i in ids])
    return _mapped(rows, lambda x: fcls(x, full)), full


KERNELS: dict[str, Callable[[np.ndarray, np.ndarray, float], np.ndarray]] = {
    "linear": lambda x, y, gamma: x @ y.T,
    "poly": lambda x, y, gamma: (gamma * (x @ y.T) + 1) ** 3,
    "rbf": lambda x, y, gamma: np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)),
    "sigmoid": lambda x, y, gamma: np.tanh(gamma * (x @ y.T) + 1),
    "cosine": lambda x, y, gamma: (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)).T,
}


def landmarks(rows: DataFrame, most: int) -> np.ndarray:
    """At most `most` rows, those of the smallest hashes of id: a bounded sample that does not depend on the partitioning."""
    picked = rows.select("id", "data").orderBy(F.xxhash64("id"), "id").limit(most).collect()
    return np.array([r.data for r in picked], float)


def kernel_features(rows: DataFrame, points: np.ndarray, kernel: str = "rbf", gamma: float | None = None) -> DataFrame:
    """id, data: the kernel between each row and each landmark; a map."""
    if kernel not in KERNELS:
        raise ValueError(f"kernel is one of {', '.join(KERNELS)}")
    gamma = 1 / points.shape[1] if gamma is None else gamma
    return _mapped(rows, lambda x: KERNELS[kernel](x, points, gamma))


def kernel_pca(rows: DataFrame, p: int, k: int, kernel: str = "linear", gamma: float | None = None, most: int = 512) -> tuple[DataFrame, np.ndarray]:
    """(scores, eigenvalues of the centred kernel). gamma: 1 / p, if not said.

    The linear kernel's eigenvalues are those of the scatter matrix. Other kernels go over at most `most` landmarks
    (Nystroem): rows become their kernels with these, whitened by the landmarks' own kernel, and their scatter matrix is
    most x most; no N x N matrix is made. With all rows as landmarks the result is that of the exact kernel.
    """
    if kernel == "linear":
        n, mean, cov = moments(rows, p)
        values, vectors = np.linalg.eigh(cov * max(n - 1, 1))
        top = signed(vectors[:, ::-1][:, :k])
        return _mapped(rows, lambda x: (x - mean) @ top), values[::-1][:k]
    points = landmarks(rows, most)
    gamma = 1 / p if gamma is None else gamma
    if kernel not in KERNELS:
        raise ValueError(f"kernel is one of {', '.join(KERNELS)}")
    own = KERNELS[kernel](points, points, gamma)
    values, vectors = np.linalg.eigh(own)
    good = values > values[-1] * 1e-12
    white = vectors[:, good] / np.sqrt(values[good])
    p = int(good.sum())

    # Features are made and used up some rows at a time; as rows of a table they would be far wider than the data.
    def features(x: np.ndarray) -> Iterator[np.ndarray]:
        for n in range(0, len(x), WIDE):
            yield KERNELS[kernel](x[n : n + WIDE], points, gamma) @ white

    def sums(x: np.ndarray) -> np.ndarray:
        return sum(np.concatenate([[len(f)], f.sum(0), (f.T @ f).ravel()]) for f in features(x))

    n, mean, cov = _moments(_summed(rows, sums, 1 + p + p * p), p)
    values, vectors = np.linalg.eigh(cov * max(n - 1, 1))
    top = signed(vectors[:, ::-1][:, :k])
    return _mapped(rows, lambda x: np.concatenate([(f - mean) @ top for f in features(x)])), values[::-1][:k]


def factor(rows: DataFrame, method: str, p: int, k: int, **options):
    """One of METHODS by name; options go to it (kernel, gamma, most; rounds, tolerance)."""
    if method not in METHODS:
        raise AssertionError(f"method is one of {', '.join(METHODS)}")
    if method == "svd":
        u, s, vh = svd(rows, p)
        return u, np.diag(s) @ vh
    if method == "pca":
        return pca(rows, p, k)[:2]
    return {"nmf": nmf, "ica": ica, "nfindr": nfindr, "kernelpca": kernel_pca}[method](rows, p, k, **options)


def reconstructed(weights: DataFrame, components: np.ndarray) -> DataFrame:
    return _mapped(weights, lambda w: w @ components)


def complex_svd(rows: DataFrame, p: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(U by row: real parts, then imaginary ones; s; complex Vh) of rows whose data holds p real parts, then p imaginary ones."""

    def joined(x: np.ndarray) -> np.ndarray:
        return x[:, :p] + 1j * x[:, p:]

    def products(x: np.ndarray) -> np.ndarray:
        z = joined(x)
        g = z.conj().T @ z
        return np.concatenate([g.real.ravel(), g.imag.ravel()])

    g = _summed(rows, products, 2 * p * p)
    values, v = np.linalg.eigh(g[: p * p].reshape(p, p) + 1j * g[p * p :].reshape(p, p))
    s, v = np.sqrt(np.maximum(values[::-1], 0)), v[:, ::-1]
    # A column's largest component is made real and positive, so that signs and phases are settled.
    lead = v[np.abs(v).argmax(0), np.arange(p)]
    v = v * (np.abs(lead) / np.where(lead == 0, 1, lead))
    inverse = np.where(s > s[0] * 1e-12, 1 / np.maximum(s, 1e-300), 0)

    def scores(x: np.ndarray) -> np.ndarray:
        u = joined(x) @ v * inverse
        return np.concatenate([u.real, u.imag], 1)

    return _mapped(rows, scores), s, v.conj().T


def neighbour_svd(rows: DataFrame, p: int) -> dict[str, tuple[DataFrame, np.ndarray, np.ndarray]]:
    """Singular value decompositions of the distances, angles and complex offsets of rows(id, d, angle, dx, dy) of p neighbours each."""
    data = lambda c: rows.select("id", c.alias("data"))
    return {"distance": svd(data(F.col("d")), p), "angle": svd(data(F.col("angle")), p), "offset": complex_svd(data(F.concat("dx", "dy")), p)}


def mode_gram(long: DataFrame, mode: str, others: list[str]) -> DataFrame:
    """m1, m2, g: Gram matrix of a tensor (columns of axes and v) unfolded along one axis; a fibre is gathered once and never longer than the axis."""
    fibres = long.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct(F.col(mode).alias("m"), "v"))).alias("s"))
    first = fibres.select("s", F.explode("s").alias("p"))
    both = first.select("p", F.explode("s").alias("q"))
    return both.groupBy(F.col("p.m").alias("m1"), F.col("q.m").alias("m2")).agg(F.sum(F.col("p.v") * F.col("q.v")).alias("g"))


def hosvd(long: DataFrame, axes: list[str], sizes: list[int], ranks: list[int]) -> list[np.ndarray]:
    """Leading eigenvectors of each mode's Gram matrix (Tucker factors)."""
    out = []
    for mode, n, r in zip(axes, sizes, ranks, strict=True):
        g = np.zeros((n, n))
        for row in mode_gram(long, mode, [a for a in axes if a != mode]).collect():  # n x n numbers
            g[row.m1, row.m2] = row.g
        out.append(signed(np.linalg.eigh(g)[1][:, ::-1][:, :r]))
    return out


def _factor_table(spark, axis: str, f: str, w: str, u: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, r, float(u[i, r])) for i in range(u.shape[0]) for r in range(u.shape[1])], f"{axis} int, {f} int, {w} double")


def tucker_core(long: DataFrame, axes: list[str], factors: list[np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """f0, f1, ..., v: the tensor with each axis turned into its factor's columns, one axis at a time, so that each step sums. Axes in keep stay as they are."""
    spark, out = long.sparkSession, long
    done: list[str] = list(keep)
    for n, (axis, u) in enumerate(zip(axes, factors, strict=True)):
        t = _factor_table(spark, axis, f"f{n}", "w", u)
        rest = axes[n + 1 :]
        out = out.join(t, axis).groupBy(*done, f"f{n}", *rest).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        done.append(f"f{n}")
    return out


def tucker_reconstructed(core: DataFrame, axes: list[str], factors: list[np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """The tensor (axes, v) that a core and its factors stand for."""
    spark, out = core.sparkSession, core
    done: list[str] = list(keep)
    for n, (axis, u) in enumerate(zip(axes, factors, strict=True)):
        t = _factor_table(spark, axis, f"f{n}", "w", u)
        rest = [f"f{m}" for m in range(n + 1, len(axes))]
        out = out.join(t, f"f{n}").groupBy(*done, axis, *rest).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        done.append(axis)
    return out


def long_tucker(long: DataFrame, axes: list[str], sizes: list[int], ranks: list[int]) -> tuple[DataFrame, list[np.ndarray]]:
    """(core, factors) of a tensor with columns axes and v, by higher-order singular value decomposition."""
    if not len(axes) == len(sizes) == len(ranks) or any(r < 1 or r > n for r, n in zip(ranks, sizes, strict=True)):
        raise ValueError("a rank for each axis, from 1 to its size")
    factors = hosvd(long, axes, sizes, ranks)
    return tucker_core(long, axes, factors), factors


def tucker(rows: DataFrame, shape: tuple[int, int], ranks: tuple[int, int, int], rounds: int = 100, tolerance: float = 1e-4) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Tucker factors of rows(id, data of shape a x b) by alternating rounds: (factor of the long mode by row, A, B, core, relative errors by round).

    ranks are those of the rows, of a and of b. A mode's factor is found from the tensor projected on the other two, so
    its sums are as small as their ranks; the rows' own factor follows from their projection in each task and is never
    gathered. Rounds start from the modes' own singular vectors and go on until the relative error stands still.
    """
    (a, b), (rn, ra, rb) = shape, ranks
    if not (1 <= ra <= a and 1 <= rb <= b and 1 <= rn <= ra * rb and ra <= rn * rb and rb <= rn * ra):
        raise ValueError("ranks from 1 to the axis' size, none above the product of the other two")
    cut = lambda x: x.reshape(-1, a, b)
    s = _summed(rows, lambda x: np.concatenate([np.einsum("nab,ncb->ac", t := cut(x), t).ravel(), np.einsum("nab,nac->bc", t, t).ravel(), [(t * t).sum()]]), a * a + b * b + 1)
    fa = signed(np.linalg.eigh(s[: a * a].reshape(a, a))[1][:, ::-1][:, :ra])
    fb = signed(np.linalg.eigh(s[a * a : -1].reshape(b, b))[1][:, ::-1][:, :rb])
    total, errors = s[-1], []

    def flat(x, fa, fb):
        return np.einsum("nab,ar,bs->nrs", cut(x), fa, fb).reshape(len(x), -1)

    def turn(fa, fb):
        """(right vectors, singular values) of the rows' projection."""
        g = _summed(rows, lambda x: (q := flat(x, fa, fb)).T @ q, (ra * rb) ** 2).reshape(ra * rb, ra * rb)
        values, v = np.linalg.eigh(g)
        return signed(v[:, ::-1][:, :rn]), np.sqrt(np.maximum(values[::-1][:rn], 0))

    def own(x, fa, fb, v, size):
        return flat(x, fa, fb) @ v / np.where(size > 1e-12 * max(size[0], 1e-300), size, np.inf)

    for _ in range(rounds + 1):
        v, size = turn(fa, fb)
        errors.append(float(np.sqrt(max(total - (size**2).sum(), 0) / max(total, 1e-300))))
        if len(errors) > rounds or len(errors) > 1 and errors[-2] - errors[-1] <= tolerance:
            break
        xa = _summed(rows, lambda x, fa=fa, fb=fb, v=v, size=size: np.einsum("nab,nr,bs->ars", cut(x), own(x, fa, fb, v, size), fb), a * rn * rb)
        fa = signed(np.linalg.svd(xa.reshape(a, -1), full_matrices=False)[0][:, :ra])
        v, size = turn(fa, fb)
        xb = _summed(rows, lambda x, fa=fa, fb=fb, v=v, size=size: np.einsum("nab,nr,as->brs", cut(x), own(x, fa, fb, v, size), fa), b * rn * ra)
        fb = signed(np.linalg.svd(xb.reshape(b, -1), full_matrices=False)[0][:, :rb])
    return _mapped(rows, lambda x: own(x, fa, fb, v, size)), fa, fb, (v * size).T.reshape(rn, ra, rb), errors


def tucker_rebuilt(weights: DataFrame, fa: np.ndarray, fb: np.ndarray, core: np.ndarray) -> DataFrame:
    """id, data: the rows that the factors and the core stand for."""
    return _mapped(weights, lambda w: np.einsum("nr,rst,as,bt->nab", w, core, fa, fb).reshape(len(w), -1))


def tensor_decomposition(rows: DataFrame, shape: tuple[int, int], rank, decomposition_type: str = "cp", **options):
    """The factors of rows(id, data of shape a x b): `cp` of one rank, or `tucker` of three."""
    if decomposition_type == "cp":
        return cp(rows, shape, rank, **options)
    if decomposition_type == "tucker":
        return tucker(rows, shape, rank, **options)
    raise ValueError("decomposition_type is cp or tucker")


def mttkrp(long: DataFrame, mode: str, factors: dict[str, DataFrame], rank: int) -> DataFrame:
    """mode index, f, v: the tensor times the other modes' factors; factors[axis](axis, f, w) are small and broadcast if Spark finds them so."""
    out = long
    for n, (axis, table) in enumerate(factors.items()):
        t = table.select(axis, F.col("f").alias(f"f{n}"), F.col("w").alias(f"w{n}"))
        out = out.join(t, axis)
        if n:
            out = out.where(F.col(f"f{n}") == F.col("f0"))
    product = F.col("v")
    for n in range(len(factors)):
        product = product * F.col(f"w{n}")
    return out.groupBy(mode, F.col("f0").alias("f")).agg(F.sum(product).alias("v"))


def cp(rows: DataFrame, shape: tuple[int, int], rank: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Non-negative PARAFAC of rows(id, data of shape a x b): (factor of the long mode by row, A, B, weights).

    Alternating non-negative least squares until a round lowers the squared error by no more than the tolerance's share.
    """
    a, b = shape
    fa, fb, before = _start(a, rank).T, _start(b, rank).T, np.inf

    def first(x, fa, fb):
        return nonnegative(np.einsum("nab,ar,br->nr", x.reshape(-1, a, b), fa, fb), (fa.T @ fa) * (fb.T @ fb))

    for _ in range(rounds):
        for turn in (0, 1):
            def step(x, fa=fa, fb=fb, turn=turn):
                w, t = first(x, fa, fb), x.reshape(-1, a, b)
                m = np.einsum("nab,nr,br->ar", t, w, fb) if turn == 0 else np.einsum("nab,nr,ar->br", t, w, fa)
                return np.concatenate([m.ravel(), (w.T @ w).ravel(), [(t * t).sum()]])

            n = (a, b)[turn]
            s = _summed(rows, step, n * rank + rank * rank + 1)
            m, ww = s[: n * rank].reshape(n, rank), s[n * rank : -1].reshape(rank, rank)
            if turn == 0:
                error = s[-1] - 2 * (m * fa).sum() + (ww * (fa.T @ fa) * (fb.T @ fb)).sum()
                if before - error <= tolerance * before < np.inf:
                    break
                before, fa = error, nonnegative(m, ww * (fb.T @ fb))
            else:
                fb = nonnegative(m, ww * (fa.T @ fa))
        else:
            continue
        break
    weight = np.linalg.norm(fa, axis=0) * np.linalg.norm(fb, axis=0)
    return _mapped(rows, lambda x: first(x, fa, fb)), fa, fb, weight
