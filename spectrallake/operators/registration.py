"""Registration of image stacks: drift by cross-correlation, shifts, common crop, diffeomorphic demons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import smoothed, spline_shifted
from .iterate import settled


def frames(stack: DataFrame) -> DataFrame:
    """stack(f, r, c, v) in block form: f, h, w, data; one shuffle by frame."""
    return stack.groupBy("f").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("r", "c", F.col("v").cast("double").alias("v")))), lambda s: s["v"]).alias("data"))


def _finer(product: np.ndarray, coarse: np.ndarray, upsample: int) -> tuple[float, float]:
    """The peak of the cross-correlation within 3/4 pixel of coarse, in steps of 1 / upsample: the inverse transform at these places only."""
    steps = np.arange(-int(0.75 * upsample), int(0.75 * upsample) + 1) / upsample
    rows, cols = (np.exp(2j * np.pi * np.outer(steps + at, np.fft.fftfreq(n))) for at, n in zip(coarse, product.shape, strict=True))
    c = (rows @ product @ cols.T).real
    r, k = np.unravel_index(c.argmax(), c.shape)
    return float(coarse[0] + steps[r]), float(coarse[1] + steps[k])


def relative_drift(blocks: DataFrame, normalization: str | None = None, upsample: int = 1) -> DataFrame:
    """f, dr, dc: the shift of each frame that fits it best to the frame before, by circular cross-correlation. Ties: smallest |dr|, then |dc|.

    In whole pixels, or with upsample over 1 in parts of a pixel (doubles). Each frame meets the next by an equi-join on
    its number; a task holds two frames at a time.
    """
    before = blocks.select((F.col("f") + 1).alias("f"), F.col("data").alias("before"))
    pairs = blocks.join(before, "f", "left").select("f", "h", "w", "data", "before")

    def run(batches):
        for pdf in batches:
            out = []
            for f, h, w, now, then in pdf.itertuples(index=False):
                if then is None:
                    out.append((f, 0, 0))
                    continue
                a, b = np.reshape(then, (h, w)), np.reshape(now, (h, w))
                product = np.fft.fft2(a) * np.fft.fft2(b).conj()
                if normalization == "phase":
                    product /= np.maximum(np.abs(product), 1e-12)
                c = np.fft.ifft2(product).real
                top = np.argwhere(c >= c.max() - 1e-9 * max(abs(c.max()), 1))
                signed = np.where(top > np.array([h, w]) // 2, top - np.array([h, w]), top)
                best = signed[np.lexsort((signed[:, 1], signed[:, 0], np.abs(signed[:, 1]), np.abs(signed[:, 0])))[0]]
                out.append((f, *(_finer(product, best, upsample) if upsample > 1 else map(int, best))))
            yield pd.DataFrame(out, columns=["f", "dr", "dc"])

    kind = "double" if upsample > 1 else "int"
    return pairs.mapInPandas(run, f"f int, dr {kind}, dc {kind}")


def absolute_drift(relative: DataFrame) -> DataFrame:
    """Cumulative drift, relative to the middle frame. A stack has few frames: the window is over one row a frame."""
    kind = dict(relative.dtypes)["dr"]
    w = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    total = relative.select("f", F.sum("dr").over(w).alias("dr"), F.sum("dc").over(w).alias("dc"))
    n = relative.agg(F.floor(F.count("*") / 2).cast("int").alias("mid"))
    middle = total.join(F.broadcast(n), F.col("f") == F.col("mid")).select(F.col("dr").alias("mr"), F.col("dc").alias("mc"))
    return total.join(F.broadcast(middle)).select("f", (F.col("dr") - F.col("mr")).cast(kind).alias("dr"), (F.col("dc") - F.col("mc")).cast(kind).alias("dc"))


def resampled(blocks: DataFrame, drift: DataFrame) -> DataFrame:
    """Frames f, h, w, data moved by drift(f, dr, dc) in pixels or parts of them, by cubic splines; 0 where nothing was. A map over frames."""

    def run(batches):
        for pdf in batches:
            moved = [spline_shifted(np.reshape(d, (h, w)), (dr, dc)).ravel() for h, w, d, dr, dc in pdf[["h", "w", "data", "dr", "dc"]].itertuples(index=False)]
            yield pdf[["f", "h", "w"]].assign(data=moved)

    joined = blocks.select("f", "h", "w", "data").join(drift.select("f", F.col("dr").cast("double").alias("dr"), F.col("dc").cast("double").alias("dc")), "f")
    return joined.mapInPandas(run, "f int, h int, w int, data array<double>")


def shifted(stack: DataFrame, drift: DataFrame) -> DataFrame:
    """Pixels moved by whole drifts; those that leave the frame are dropped, those that open are 0."""
    moved = stack.join(drift, "f").select("f", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), F.col("v").alias("nv"))
    cells = stack.select("f", "r", "c")
    return cells.join(moved, ["f", "r", "c"], "left").select("f", "r", "c", F.coalesce("nv", F.lit(0)).alias("v"))


def common_area(drift: DataFrame, h: int, w: int) -> tuple[int, int, int, int]:
    """Rows from, to and columns from, to that every shifted frame covers wholly."""
    a = drift.agg(F.ceil(F.max("dr")), F.floor(F.min("dr")), F.ceil(F.max("dc")), F.floor(F.min("dc"))).first()
    return max(0, a[0]), h + min(0, a[1]), max(0, a[2]), w + min(0, a[3])


def crop_stack(stack: DataFrame, drift: DataFrame, h: int, w: int) -> DataFrame:
    r0, r1, c0, c1 = common_area(drift, h, w)
    return stack.where(F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)).withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})


def frame_pixels(blocks: DataFrame) -> DataFrame:
    """Frames in long form: f, r, c, v."""
    long = blocks.select("f", "w", F.posexplode("data").alias("p", "v"))
    return long.select("f", F.floor(F.col("p") / F.col("w")).cast("int").alias("r"), (F.col("p") % F.col("w")).cast("int").alias("c"), "v")


def rigid_registration(stack: DataFrame, h: int, w: int, normalization: str | None = None, upsample: int = 1) -> tuple[DataFrame, DataFrame]:
    """(registered and cropped stack, drift). With upsample over 1 the drift is in parts of a pixel and frames are resampled by splines."""
    blocks = frames(stack)
    drift = absolute_drift(relative_drift(blocks, normalization, upsample))
    if upsample > 1:
        drift = settled(drift, "drift")
        return crop_stack(frame_pixels(resampled(blocks, drift)), drift, h, w), drift
    return crop_stack(shifted(stack, drift), drift, h, w), drift


def demons(moving: np.ndarray, fixed: np.ndarray, iterations: int = 200, sigma: float = 1.0) -> np.ndarray:
    """moving, warped onto fixed by Thirion's demons with a smoothed displacement field; 0 outside."""
    h, w = fixed.shape
    grid = np.stack(np.meshgrid(np.arange(h, dtype=float), np.arange(w, dtype=float), indexing="ij"))
    field, warped = np.zeros((2, h, w)), moving
    gr, gc = np.gradient(fixed)
    square = gr**2 + gc**2
    for _ in range(iterations):
        warped = _bilinear(moving, grid + field)
        diff = fixed - warped
        scale = diff / np.where(square + diff**2 > 1e-12, square + diff**2, np.inf)
        field = smoothed(field + np.stack([gr * scale, gc * scale]), sigma)
    return _bilinear(moving, grid + field)


def _bilinear(image: np.ndarray, at: np.ndarray) -> np.ndarray:
    h, w = image.shape
    r, c = at
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    out = np.zeros_like(r)
    for dr in (0, 1):
        for dc in (0, 1):
            rr, cc = r0 + dr, c0 + dc
            ok = (rr >= 0) & (rr < h) & (cc >= 0) & (cc < w)
            weight = (1 - np.abs(r - rr)) * (1 - np.abs(c - cc))
            out += np.where(ok, image[np.clip(rr, 0, h - 1), np.clip(cc, 0, w - 1)] * weight, 0)
    return out


def demon_registration(blocks: DataFrame, iterations: int = 200, sigma: float = 1.0) -> DataFrame:
    """Every frame of blocks(f, h, w, data) warped onto the smoothed mean of all: f, h, w, data. The mean, one image, goes to all tasks."""
    sums = blocks.select("h", "w", F.posexplode("data").alias("k", "v")).groupBy("k", "h", "w").agg(F.avg("v").alias("v")).orderBy("k").collect()
    if not sums:
        return blocks.select("f", "h", "w", "data")
    h, w = sums[0].h, sums[0].w
    fixed = smoothed(np.array([s.v for s in sums]).reshape(1, h, w), np.sqrt(2.0))[0]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(data=[demons(np.reshape(d, (h, w)), fixed, iterations, sigma).ravel() for d in pdf["data"]])

    return blocks.select("f", "h", "w", "data").mapInPandas(run, "f int, h int, w int, data array<double>")


def complete_registration(stack: DataFrame, h: int, w: int) -> tuple[DataFrame, DataFrame]:
    """(non-rigid in block form, rigid in long form)."""
    rigid, _ = rigid_registration(stack, h, w)
    return demon_registration(frames(rigid)), rigid
