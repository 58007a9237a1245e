"""Blobs of images of any size, in long form: tiles with a halo, then suppression of overlaps by rounds of joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal import smoothing_kernel
from .filters import scale_space
from .iterate import forget, settled


def tiles(long: DataFrame, size: int, halo: int) -> DataFrame:
    """img, r, c, v and the tiles (tr, tc) of size x size pixels that a pixel lies in or beside: a pixel goes to at most nine."""
    near = lambda c, by: F.floor((F.col(c) + by) / size).cast("int")
    around = lambda c: F.sequence(F.greatest(near(c, -halo), F.lit(0)), near(c, halo))
    return long.withColumn("tr", F.explode(around("r"))).withColumn("tc", F.explode(around("c")))


def scale_maxima(long: DataFrame, sigmas: np.ndarray, tile: int) -> DataFrame:
    """img, x (row), y (column), k (number of the scale), s: maxima of the scale space among the 26 around, s over 0.

    A tile's halo is as wide as the widest kernel reaches, so its own pixels have the values of the whole image.
    """
    halo = len(smoothing_kernel(float(sigmas.max()))) // 2 + 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img, tr, tc = pdf["img"].iloc[0], int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        r0, c0 = r.min(), c.min()
        x = np.zeros((1, r.max() - r0 + 1, c.max() - c0 + 1))
        x[0, r - r0, c - c0] = pdf["v"].to_numpy()
        space = scale_space(x, sigmas)[0]
        wide = np.pad(space, 1, constant_values=-np.inf)
        n, h, w = space.shape
        top = np.max([wide[a : a + n, b : b + h, d : d + w] for a in range(3) for b in range(3) for d in range(3)], 0)
        k, i, j = np.nonzero((space == top) & (space > 0))
        own = ((i + r0) // tile == tr) & ((j + c0) // tile == tc)
        k, i, j = k[own], i[own], j[own]
        return pd.DataFrame({"img": img, "x": i + r0, "y": j + c0, "k": k, "s": space[k, i, j]})

    return tiles(long, tile, halo).groupBy("img", "tr", "tc").applyInPandas(run, "img long, x int, y int, k int, s double").where("x is not null")


def suppressed(blobs: DataFrame) -> DataFrame:
    """blobs(img, x, y, sigma, s) without those that overlap a stronger one that stays; of equal ones the smaller x, then y, then sigma is the stronger.

    Blobs meet in cells as wide as any two can overlap. Each round keeps all that have no stronger one beside them and
    drops those beside the kept, so a round settles every place at once.
    """
    blobs = settled(blobs.groupBy("img", "x", "y", "sigma").agg(F.max("s").alias("s")).withColumn("id", F.struct("x", "y", "sigma")), "blobs")
    widest = blobs.agg(F.max("sigma")).first()[0]
    if widest is None:
        return blobs.drop("id")
    reach = float(np.sqrt(2) * widest)
    one = blobs.withColumns({"gx": F.floor(F.col("x") / reach), "gy": F.floor(F.col("y") / reach)})
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = one.withColumn("o", F.explode(around)).select("img", (F.col("gx") + F.col("o.a")).alias("gx"), (F.col("gy") + F.col("o.b")).alias("gy"), *[F.col(c).alias(f"{c}2") for c in ("x", "y", "sigma", "s", "id")])
    near = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= (F.col("sigma") + F.col("sigma2")) ** 2 / 2
    stronger = (F.col("s") > F.col("s2")) | ((F.col("s") == F.col("s2")) & (F.col("id") < F.col("id2")))
    edges = settled(one.join(other, ["img", "gx", "gy"]).where(near & stronger).select("img", F.col("id").alias("strong"), F.col("id2").alias("weak")), "overlaps")
    alive, kept = blobs.select("img", "id"), []
    while True:
        free = settled(alive.join(edges.select("img", F.col("weak").alias("id")), ["img", "id"], "left_anti"), "kept")
        kept.append(free)
        gone = edges.join(free.withColumnRenamed("id", "strong"), ["img", "strong"], "left_semi").select("img", F.col("weak").alias("id")).distinct()
        alive = settled(alive.join(free, ["img", "id"], "left_anti").join(gone, ["img", "id"], "left_anti"), "alive")
        if alive.isEmpty():
            break
        both = edges.join(alive.withColumnRenamed("id", "strong"), ["img", "strong"], "left_semi").join(alive.withColumnRenamed("id", "weak"), ["img", "weak"], "left_semi")
        then = settled(both.select("img", "strong", "weak"), "overlaps")
        forget(edges)
        edges = then
    chosen = kept[0]
    for part in kept[1:]:
        chosen = chosen.unionByName(part)
    return blobs.join(chosen, ["img", "id"], "left_semi").drop("id")


def find_blobs(long: DataFrame, atom_size: float = 0.1, threshold: float = -1.0, pixel_size: float = 1.0, tile: int = 512) -> DataFrame:
    """img, x (row), y (column), sigma of the blobs of images img, r, c, v of any size: `filters.find_atoms`, tile by tile.

    A negative threshold means the standard deviation. Strengths are those of the image as it is; its range scales the
    threshold instead, so no pixel waits for it.
    """
    sigmas = np.unique(np.linspace(1, max(atom_size / pixel_size, 1.0), 10))
    pixels = long.select(F.col("img").cast("long").alias("img"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    stats = pixels.groupBy("img").agg((F.max("v") - F.min("v")).alias("range"), F.stddev_pop("v").alias("deviation"))
    limit = F.col("deviation") if threshold < 0 else threshold * F.col("range")
    found = scale_maxima(pixels, sigmas, tile).join(stats, "img").where(F.col("s") > 0.5 * limit)
    sigma = F.array(*[F.lit(float(v)) for v in sigmas])[F.col("k")]
    return suppressed(found.select("img", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), sigma.alias("sigma"), "s")).drop("s")
