"""Fourier analysis of images in block form: spectra, masks, inverse, diffraction spots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import smoothed
from .blocks import map_images, map_to_rows
from .iterate import forget, settled
from .ranks import order_statistic, ranked


def fourier_transform(blocks: DataFrame) -> DataFrame:
    """img, u, v, re, im of each image less its minimum; u, v from -n/2 (zero frequency in the middle)."""

    def run(ids, x):
        n, h, w = x.shape
        f = np.fft.fftshift(np.fft.fft2(x - x.min((1, 2), keepdims=True)), axes=(1, 2)).reshape(-1)
        u, v = np.meshgrid(np.arange(h) - h // 2, np.arange(w) - w // 2, indexing="ij")
        return {"img": np.repeat(ids, h * w), "u": np.tile(u.ravel(), n).astype(np.int32), "v": np.tile(v.ravel(), n).astype(np.int32), "re": f.real, "im": f.imag}

    return map_to_rows(blocks, run, "img long, u int, v int, re double, im double")


def reciprocal_axis(index: Column, n: int, pixel_size: float) -> Column:
    return index / F.lit(n * pixel_size)


def power_spectrum(blocks: DataFrame, h: int, w: int, smoothing: float = 3.0) -> DataFrame:
    """log(1 + smoothed magnitude) in block form."""
    return map_images(blocks, lambda x: np.log1p(smoothed(np.abs(np.fft.fftshift(np.fft.fft2(x - x.min((1, 2), keepdims=True)), axes=(1, 2))), smoothing)), h, w)


def adaptive_fourier_filter(blocks: DataFrame, spots: list[tuple[float, float]], h: int, w: int, low_pass: float = 3.0, radius: float = 0.3) -> DataFrame:
    """Keep disks around the spots (in reciprocal pixels from the middle) and around zero; back to an image."""
    u, v = np.meshgrid(np.arange(h) - h // 2, np.arange(w) - w // 2, indexing="ij")
    mask = u**2 + v**2 < low_pass**2
    for a, b in spots:
        mask |= (u - a) ** 2 + (v - b) ** 2 < radius**2
    keep = np.fft.ifftshift(mask)
    return map_images(blocks, lambda x: np.fft.ifft2(np.fft.fft2(x) * keep).real, h, w)


def window_fft(windows: DataFrame, size: int, mode: str = "abs") -> DataFrame:
    """Spectrum of each window: windows(img, wr, wc, data array) -> data; mode abs, phase or complex (re and im in turn)."""
    if mode not in ("abs", "phase", "complex"):
        raise ValueError("mode is abs, phase or complex")

    def run(batches):
        for pdf in batches:
            f = np.fft.fftshift(np.fft.fft2(np.stack(pdf["data"].to_numpy()).reshape(-1, size, size)), axes=(1, 2)) if len(pdf) else np.empty((0, size, size))
            out = np.abs(f) if mode == "abs" else np.angle(f) if mode == "phase" else np.stack([f.real, f.imag], -1)
            yield pdf.assign(data=list(out.reshape(len(pdf), -1)))

    return windows.mapInPandas(run, windows.schema)


def spots_by_distance(spots: DataFrame) -> DataFrame:
    """spots(id, u, v) with their rank by distance from the origin (ties: id) and the angle atan2(u, v); with a column g, ranks are within each g."""
    g = [c for c in ("g",) if c in spots.columns]
    d = F.sqrt(F.col("u") ** 2 + F.col("v") ** 2)
    return ranked(spots.select(*g, "id", d.alias("distance"), F.atan2("u", "v").alias("angle")), g, ["distance", "id"]).withColumn("rank", F.col("rank").cast("int"))


def rotational_symmetry(spots: DataFrame, orders=(2, 3, 4, 6), share: float = 0.7, limit: float = 0.2) -> DataFrame:
    """For each order n: whether spots(id, u, v) turned by 360/n degrees fall on spots; with a column g, for each g.

    Of the distances of all pairs in order, the one at place int(share * number of spots) decides. Pairs meet in cells of a
    radius that is doubled until so many lie within it, so the work follows the number of spots, not its square.
    """
    grouped = "g" in spots.columns
    s = (spots if grouped else spots.withColumn("g", F.lit(0))).select("g", "u", "v").where(" and ".join(f"{c} is not null and abs({c}) < double('infinity')" for c in "uv"))
    spread = F.greatest(F.max("u") - F.min("u"), F.max("v") - F.min("v"), F.lit(1e-9))
    todo = settled(s.groupBy("g").agg(F.count("*").alias("size"), spread.alias("spread")).select(
        "g", F.explode(F.array(*[F.lit(k) for k in orders])).alias("n"), (F.floor(F.col("size") * share) + 1).alias("place"), (F.col("spread") / F.sqrt("size")).alias("reach")))
    a, done = F.lit(2 * math.pi) / F.col("n"), None
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        here = s.join(todo, "g")
        turned = here.select("g", "n", "place", "reach", (F.col("u") * F.cos(a) - F.col("v") * F.sin(a)).alias("ru"), (F.col("u") * F.sin(a) + F.col("v") * F.cos(a)).alias("rv"))
        turned = turned.withColumn("o", F.explode(around)).withColumns({"gx": F.floor(F.col("ru") / F.col("reach")) + F.col("o.i"), "gy": F.floor(F.col("rv") / F.col("reach")) + F.col("o.j")})
        cells = here.select("g", "n", "u", "v", F.floor(F.col("u") / F.col("reach")).alias("gx"), F.floor(F.col("v") / F.col("reach")).alias("gy"))
        pairs = turned.join(cells, ["g", "n", "gx", "gy"]).withColumn("d", F.sqrt((F.col("ru") - F.col("u")) ** 2 + (F.col("rv") - F.col("v")) ** 2)).where("d <= reach")
        near = settled(pairs.select("g", "n", F.col("d").alias("v")), "pairs")
        found = order_statistic(near, ["g", "n"], todo.select("g", "n", "place")).withColumnRenamed("value", "d")
        forget(near)
        done = found if done is None else done.unionByName(found)
        todo = settled(todo.join(found, ["g", "n"], "left_anti").withColumn("reach", F.col("reach") * 2))
        if todo.isEmpty():
            return done.select(*["g"] * grouped, "n", (F.col("d") < limit).alias("symmetric"), "d")


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Where a value exceeds its eight neighbours."""
    wide = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(1, 1), (1, 1)], constant_values=-np.inf)
    h, w = x.shape[-2:]
    around = [wide[..., 1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    return (x[None] > np.stack(around)).all(0)


def peaks(blocks: DataFrame) -> DataFrame:
    def run(ids, x):
        n, r, c = np.nonzero(local_maxima(x))
        return {"img": ids[n], "r": r.astype(np.int32), "c": c.astype(np.int32), "v": x[n, r, c]}

    return map_to_rows(blocks, run, "img long, r int, c int, v double")


def diffractogram_spots(blocks: DataFrame, threshold: float = 0.5, pixel_size: float = 1.0) -> DataFrame:
    """Peaks of the normalised log spectrum above a threshold: img, u, v (reciprocal units), distance, angle."""

    def run(ids, x):
        n, h, w = x.shape
        p = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(x - x.min((1, 2), keepdims=True)), axes=(1, 2))))
        p = p - p.min((1, 2), keepdims=True)
        p /= np.maximum(p.max((1, 2), keepdims=True), 1e-300)
        k, r, c = np.nonzero(local_maxima(p) & (p > threshold))
        u, v = (r - h // 2) / (h * pixel_size), (c - w // 2) / (w * pixel_size)
        d = pd.DataFrame({"img": ids[k], "u": u, "v": v, "distance": np.hypot(u, v), "angle": np.arctan2(u, v)})
        return d.sort_values(["img", "distance"])

    return map_to_rows(blocks, run, "img long, u double, v double, distance double, angle double")
