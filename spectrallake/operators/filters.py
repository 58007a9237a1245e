"""Cleaning of images: flattening, smoothing, inpainting, deconvolution, low-rank cleaning, blobs, atom fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal import gauss, smoothed
from .blocks import map_images, map_to_rows


def flattened(blocks: DataFrame, h: int, w: int, axis: str = "row", order: int = 1) -> DataFrame:
    """Each line less its polynomial of the given order over the pixel number. axis: row or col."""
    if axis not in ("row", "col"):
        raise ValueError("axis is row or col")
    n = w if axis == "row" else h
    basis = np.vander(np.arange(n, dtype=float), order + 1)
    keep = np.eye(n) - basis @ np.linalg.pinv(basis)
    return map_images(blocks, (lambda x: x @ keep.T) if axis == "row" else (lambda x: keep @ x), h, w)


def flattened_lines(long: DataFrame, line: str = "r", along: str = "c") -> DataFrame:
    """Order 1 in long form, by regression aggregates: img, r, c, v. The fit is joined back on the line."""
    fits = long.groupBy("img", line).agg(F.regr_slope("v", along).alias("s"), F.regr_intercept("v", along).alias("i"))
    return long.join(fits, ["img", line]).select("img", "r", "c", (F.col("v") - F.col("s") * F.col(along) - F.col("i")).alias("v"))


def plane_flattened(blocks: DataFrame, h: int, w: int) -> DataFrame:
    r, c = np.meshgrid(np.arange(h, dtype=float), np.arange(w, dtype=float), indexing="ij")
    basis = np.stack([np.ones(h * w), r.ravel(), c.ravel()], 1)
    keep = np.eye(h * w) - basis @ np.linalg.pinv(basis)
    return map_images(blocks, lambda x: x.reshape(len(x), -1) @ keep.T, h, w)


def gaussian_smooth(blocks: DataFrame, h: int, w: int, sigma: float) -> DataFrame:
    return map_images(blocks, lambda x: smoothed(x, sigma), h, w)


def _laplacian(u: np.ndarray) -> np.ndarray:
    """Sum over a pixel's neighbours inside the image of their difference from it."""
    out = np.zeros_like(u)
    for axis in (1, 2):
        step = np.diff(u, axis=axis)
        low, high = ([slice(None)] * 3 for _ in range(2))
        low[axis], high[axis] = slice(None, -1), slice(1, None)
        out[tuple(low)] += step
        out[tuple(high)] -= step
    return out


def smoothest(x: np.ndarray, hole: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Images with the pixels in hole chosen so that the squared Laplacian is least, by conjugate gradients: no matrix is made."""
    start = np.where(hole, 0.0, x)
    rest = -_laplacian(_laplacian(start)) * hole
    found, way = np.zeros_like(rest), rest.copy()
    size = (rest * rest).sum((1, 2))
    least = size * tolerance**2
    for _ in range(20 * int(hole.sum()) + 20):
        if not (size > least).any():
            break
        on = _laplacian(_laplacian(way)) * hole
        along = (way * on).sum((1, 2))
        step = np.where((size > least) & (along > 0), size / np.where(along > 0, along, 1), 0)[:, None, None]
        found += step * way
        rest -= step * on
        now = (rest * rest).sum((1, 2))
        way = rest + (now / np.where(size > 0, size, 1))[:, None, None] * way
        size = np.where(step[:, 0, 0] > 0, now, 0)
    return np.where(hole, found, x)


def inpaint(blocks: DataFrame, mask: np.ndarray, h: int, w: int) -> DataFrame:
    """Fill the pixels where mask is 0 so that the squared Laplacian is least, the others held."""
    hole = np.asarray(mask).reshape(h, w) == 0
    return map_images(blocks, lambda x: smoothest(x.reshape(-1, h, w), hole), h, w)


def lucy_richardson(x: np.ndarray, width: float, iterations: int = 501, tolerance: float = 1e-4) -> np.ndarray:
    """Deconvolution of positive images with a Gaussian probe, each until its change is below tolerance percent; the original gives up after its 501st iteration."""
    h, w = x.shape[-2:]
    if h != w:
        raise ValueError("square images only")
    probe = np.fft.fft2(np.fft.fftshift(gauss(h, width)))
    estimate, open_ = x.copy(), np.ones(len(x), bool)
    for _ in range(iterations):
        now = estimate[open_]
        blurred = np.fft.ifft2(np.fft.fft2(now) * probe).real
        ratio = x[open_] / np.where(np.abs(blurred) < 1e-12, 1e-12, blurred)
        then = now * np.fft.ifft2(np.fft.fft2(ratio) * probe.conj()).real
        change = ((then - now) ** 2).sum((1, 2)) / np.maximum(np.abs(then.sum((1, 2))), 1e-300) * 100
        estimate[open_] = then
        open_[np.flatnonzero(open_)[change <= tolerance]] = False
        if not open_.any():
            break
    return estimate


def decon_lr(blocks: DataFrame, h: int, w: int, resolution: float = 0.1, pixel_size: float = 1.0, iterations: int = 501) -> DataFrame:
    return map_images(blocks, lambda x: lucy_richardson(x - x.min((1, 2), keepdims=True) + 1e-9, resolution / pixel_size, iterations), h, w)


def clean_svd(blocks: DataFrame, h: int, w: int, source: int = 3) -> DataFrame:
    """Each image's patches by their first singular vector; the first column of weights, scaled to the image's sum."""
    p = max(3, int(source))

    def run(x):
        patches = np.lib.stride_tricks.sliding_window_view(x, (p, p), axis=(1, 2)).reshape(len(x), -1, p * p)
        _, vectors = np.linalg.eigh(np.einsum("nij,nik->njk", patches, patches))
        first = np.einsum("nij,nj->ni", patches, vectors[:, :, -1])
        first *= np.sign(first.sum(1, keepdims=True)) * np.sign(x.sum((1, 2)))[:, None]
        scale = x.sum((1, 2)) / np.where(np.abs(first.sum(1)) < 1e-300, 1, first.sum(1))
        return first * scale[:, None]

    return map_images(blocks, run, h - p + 1, w - p + 1)


def scale_space(x: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
    """Normalised negative Laplacian of Gaussian at each sigma: (n, sigma, h, w)."""
    out = []
    for s in sigmas:
        g = smoothed(x, s)
        wide = np.pad(g, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
        lap = wide[:, 2:, 1:-1] + wide[:, :-2, 1:-1] + wide[:, 1:-1, 2:] + wide[:, 1:-1, :-2] - 4 * g
        out.append(-lap * s * s)
    return np.stack(out, 1)


def strongest(x: np.ndarray, y: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Which of blobs in order of strength stay: none that overlaps a stronger one that stays."""
    alive, kept = np.ones(len(x), bool), np.zeros(len(x), bool)
    while alive.any():
        k = int(np.argmax(alive))
        kept[k] = True
        alive &= (x - x[k]) ** 2 + (y - y[k]) ** 2 > (sigma + sigma[k]) ** 2 / 2
    return kept


def find_atoms(blocks: DataFrame, atom_size: float = 0.1, threshold: float = -1.0, pixel_size: float = 1.0) -> DataFrame:
    """Blobs of each image: img, x (row), y (column), sigma. A negative threshold means the standard deviation."""

    def run(ids, x):
        x = x - x.min((1, 2), keepdims=True)
        x = x / np.maximum(x.max((1, 2), keepdims=True), 1e-300)
        sigmas = np.linspace(1, max(atom_size / pixel_size, 1.0), 10)
        space = scale_space(x, sigmas)
        limit = x.std((1, 2)) if threshold < 0 else np.full(len(x), threshold)
        wide = np.pad(space, ((0, 0), (1, 1), (1, 1), (1, 1)), constant_values=-np.inf)
        s, h, w = space.shape[1:]
        top = space.copy()
        for a, b, c in np.ndindex(3, 3, 3):
            np.maximum(top, wide[:, a : a + s, b : b + h, c : c + w], out=top)
        n, k, r, c = np.nonzero((space == top) & (space > limit[:, None, None, None] * 0.5))
        d = pd.DataFrame({"img": ids[n], "x": r, "y": c, "sigma": sigmas[k], "s": space[n, k, r, c]})
        d = d.sort_values(["img", "s", "x", "y"], ascending=[True, False, True, True])
        kept = [g[strongest(g["x"].to_numpy(), g["y"].to_numpy(), g["sigma"].to_numpy())] for _, g in d.groupby("img", sort=False)]
        found = pd.concat(kept) if kept else d
        return {"img": found["img"], "x": found["x"].astype(float), "y": found["y"].astype(float), "sigma": found["sigma"].astype(float)}

    return map_to_rows(blocks, run, "img long, x double, y double, sigma double")


def oval_gauss(p: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Amplitude, centre (row, column), two widths, offset; one set, or one for each of many atoms."""
    a, x, y, wx, wy, offset = (p[..., k, None] for k in range(6))
    return a * np.exp(-((rows - x) ** 2 / (2 * wx**2) + (cols - y) ** 2 / (2 * wy**2))) + offset


def gauss_difference(patches: DataFrame, h: int, w: int, parameters: tuple[float, ...]) -> DataFrame:
    """Patches img, h, w, data less an oval Gaussian (amplitude, centre from the patch's middle, widths, offset)."""
    rows, cols = (g.ravel() for g in np.meshgrid(np.arange(h) - h // 2, np.arange(w) - w // 2, indexing="ij"))
    model = oval_gauss(np.array(parameters, float), rows, cols)
    return map_images(patches, lambda x: x.reshape(len(x), -1) - model, h, w)


def line_fits(spectra: DataFrame) -> DataFrame:
    """row, slope, intercept, error of the straight line through each of spectra(row, k, v): sums before the shuffle, no fit by rounds."""
    fits = spectra.groupBy("row").agg(F.regr_slope("v", "k").alias("slope"), F.regr_intercept("v", "k").alias("intercept"), F.regr_syy("v", "k").alias("all"), F.regr_r2("v", "k").alias("r2"), F.count("v").alias("n"))
    return fits.select("row", "slope", "intercept", F.sqrt(F.col("all") * (1 - F.col("r2")) / F.greatest(F.col("n") - 2, F.lit(1))).alias("error"))


def _slopes(p: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Derivatives of `oval_gauss` by its six parameters: (atoms, pixels, 6)."""
    a, x, y, wx, wy, _ = (p[:, k, None] for k in range(6))
    e = np.exp(-((rows - x) ** 2 / (2 * wx**2) + (cols - y) ** 2 / (2 * wy**2)))
    return np.stack([e, a * e * (rows - x) / wx**2, a * e * (cols - y) / wy**2, a * e * (rows - x) ** 2 / wx**3, a * e * (cols - y) ** 2 / wy**3, np.ones_like(e)], 2)


def fitted_ovals(v: np.ndarray, rows: np.ndarray, cols: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Least squares within bounds for many atoms at once, by Levenberg and Marquardt: v (atoms, pixels). Each goes on until its step is nothing."""
    p, damp = start.astype(float).copy(), np.full(len(v), 1e-3)
    error = ((oval_gauss(p, rows, cols) - v) ** 2).sum(1)
    open_ = np.arange(len(v))
    for _ in range(rounds):
        if not len(open_):
            break
        q, slopes = p[open_], _slopes(p[open_], rows, cols)
        rest = oval_gauss(q, rows, cols) - v[open_]
        # At a bound, what leads beyond it counts for nothing.
        slope = np.einsum("nkp,nk->np", slopes, rest)
        held = ((q <= low) & (slope > 0)) | ((q >= high) & (slope < 0))
        slopes = np.where(held[:, None, :], 0, slopes)
        a = np.einsum("nkp,nkq->npq", slopes, slopes)
        at = np.arange(6)
        a[:, at, at] += damp[open_, None] * (a[:, at, at] + 1e-12) + held
        # Where rounding leaves no solution, this round goes nowhere, and the next one is damped more.
        lost = np.linalg.slogdet(a)[0] == 0
        a[lost] = np.eye(6)
        step = np.where(lost[:, None], 0, np.linalg.solve(a, -np.where(held, 0, slope)[..., None])[..., 0])
        new = np.clip(q + step, low, high)
        then = ((oval_gauss(new, rows, cols) - v[open_]) ** 2).sum(1)
        better = then < error[open_]
        moved = np.abs(new - q).max(1)
        p[open_[better]], error[open_[better]] = new[better], then[better]
        damp[open_] = np.where(better, damp[open_] / 3, damp[open_] * 4)
        open_ = open_[((moved > 1e-10) | lost) & (damp[open_] < 1e12)]
    return p


def atom_refine(patches: DataFrame, radius: int, max_dist: float = 4.0, min_int: float | None = None, max_int: float | None = None) -> DataFrame:
    """patches(atom_id, x, y, data) with (2 radius + 1)^2 values each -> atom_id, x, y, amplitude, width_x, width_y, offset, accepted.

    A fit that moves the atom by more than max_dist keeps the old place and is not accepted; nor are atoms whose patch
    sums to no more than min_int or to max_int or more, where these are given. Atoms of a batch are fitted together.
    """
    side = 2 * radius + 1
    rows, cols = (g.ravel() - radius for g in np.meshgrid(np.arange(side, dtype=float), np.arange(side, dtype=float), indexing="ij"))
    low, high = np.array([0, -side, -side, 0.2, 0.2, -np.inf]), np.array([np.inf, side, side, side, side, np.inf])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["data"].to_numpy()).astype(float)
            n, least = len(v), v.min(1)
            start = np.column_stack([v.max(1) - least, np.zeros((n, 2)), np.full((n, 2), radius / 2), least])
            p = np.concatenate([fitted_ovals(v[k : k + 4096], rows, cols, start[k : k + 4096], low, high) for k in range(0, n, 4096)])
            total = v.sum(1)
            ok = np.hypot(p[:, 1], p[:, 2]) <= max_dist
            ok &= (total > min_int if min_int is not None else True) & (total < max_int if max_int is not None else True)
            yield pd.DataFrame({"atom_id": pdf["atom_id"], "x": pdf["x"] + p[:, 1] * ok, "y": pdf["y"] + p[:, 2] * ok, "amplitude": p[:, 0], "width_x": p[:, 3], "width_y": p[:, 4], "offset": p[:, 5], "accepted": ok})

    return patches.mapInPandas(run, "atom_id long, x double, y double, amplitude double, width_x double, width_y double, offset double, accepted boolean")
