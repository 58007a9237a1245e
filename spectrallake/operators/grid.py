"""Grid algebra: crops, folds, slices, masks, normalisation, windows. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import taper


def crop_image(long: DataFrame, corners: tuple[float, float, float, float], pixel_size: float = 1.0) -> DataFrame:
    """The half-open rectangle x1, y1, x2, y2 (in axis units) of long(r, c, v, ...), with r and c from 0."""
    if len(corners) != 4:
        raise ValueError("corners are x1, y1, x2, y2")
    x1, y1, x2, y2 = (int(v / pixel_size + 0.5) for v in corners)
    if x2 <= x1 or y2 <= y1:
        raise ValueError("the rectangle is empty")
    inside = (F.col("r") >= x1) & (F.col("r") < x2) & (F.col("c") >= y1) & (F.col("c") < y2)
    return long.where(inside).withColumns({"r": F.col("r") - x1, "c": F.col("c") - y1})


def fold_spaspec(cube: DataFrame, n_j: int, n_b: int) -> DataFrame:
    """Spatial axes i, j to row; spectral axes a, b to col."""
    return cube.select((F.col("i") * n_j + F.col("j")).cast("int").alias("row"), (F.col("a") * n_b + F.col("b")).cast("int").alias("col"), "v")


def fold(cube: DataFrame, spatial: list[str], spectral: list[str], sizes: dict[str, int], method: str = "spaspec") -> DataFrame:
    """A cube of any axes and v in fewer axes: `spaspec` to row (spatial) and col (spectral), `spec` to the spatial axes and col, `blocks` to row, the first spectral axis and rest.

    Axes count in their order, the last fastest. A cube needs a spatial axis, and more than one spectral for blocks.
    """
    def one(axes: list[str]) -> Column:
        at: Column = F.lit(0).cast("long")
        for axis in axes:
            at = at * sizes[axis] + F.col(axis)
        return at

    if not spatial or not spectral:
        raise NotImplementedError("a cube has spatial and spectral axes")
    if method == "spaspec":
        return cube.select(one(spatial).alias("row"), one(spectral).alias("col"), "v")
    if method == "spec":
        return cube.select(*spatial, one(spectral).alias("col"), "v")
    if method == "blocks":
        if len(spectral) < 2:
            raise NotImplementedError("blocks need two spectral axes")
        return cube.select(one(spatial).alias("row"), spectral[0], one(spectral[1:]).alias("rest"), "v")
    raise ValueError("method is spaspec, spec or blocks")


def picked(cube: DataFrame, at: dict[str, int]) -> DataFrame:
    """The part of a cube at one index of each axis named in `at`, without these axes; the first of an axis is 0."""
    for axis, index in at.items():
        cube = cube.where(F.col(axis) == index).drop(axis)
    return cube


def unfold(matrix: DataFrame, n_j: int, n_b: int) -> DataFrame:
    div = lambda c, n: F.floor(F.col(c) / n).cast("int")
    return matrix.select(div("row", n_j).alias("i"), (F.col("row") % n_j).cast("int").alias("j"), div("col", n_b).alias("a"), (F.col("col") % n_b).cast("int").alias("b"), "v")


def flat_from(cube: DataFrame, axes: list[str], sizes: list[int], start: int) -> DataFrame:
    """Axes from number `start` on become one, `flat`."""
    flat: Column = F.lit(0)
    for axis, size in zip(axes[start:], sizes[start:], strict=True):
        flat = flat * size + F.col(axis)
    return cube.select(*axes[:start], flat.cast("int").alias("flat"), "v")


def min_max_normalised(blocks: DataFrame) -> DataFrame:
    """(v - min) / max of what is left, within each image; an even image is 0. Array functions: no shuffle."""
    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  a value that each element needs is computed once
    shifted = blocks.withColumn("data", once(F.array_min("data"), lambda low: F.transform("data", lambda v: v - low)))
    return shifted.withColumn("data", once(F.array_max("data"), lambda top: F.transform("data", lambda v: F.when(top > 0, v / top).otherwise(0.0))))


def inverted_mask(mask: DataFrame) -> DataFrame:
    return mask.withColumn("m", 1 - F.col("m"))


def in_disk(r: Column, c: Column, centre_r: float, centre_c: float, radius: float) -> Column:
    return (r - centre_r) * (r - centre_r) + (c - centre_c) * (c - centre_c) < radius * radius


def annulus_limits(long: DataFrame, centre: float, inner: float, outer: float) -> DataFrame:
    """0.95 * min and 1.05 * max of each image's values at inner < distance < outer."""
    d2 = (F.col("r") - centre) ** 2 + (F.col("c") - centre) ** 2
    ring = long.where((d2 > inner**2) & (d2 < outer**2))
    return ring.groupBy("img").agg((F.min("v") * 0.95).alias("vmin"), (F.max("v") * 1.05).alias("vmax"))


def window_starts(n: int, size: int, step: int) -> list[int]:
    """Starts of windows along one axis: every step, and the last that fits."""
    if size > n:
        raise ValueError("the window is larger than the image")
    return [*range(0, n - size, step), n - size]


def window_pixels(long: DataFrame, h: int, w: int, size: tuple[int, int], step: tuple[int, int]) -> DataFrame:
    """Pixels of every window of every image: img, wr, wc (numbers of the window), a, b (pixel in the window), v.

    Each pixel is sent to the few windows that hold it: an explode, no join.
    """

    def held(axis: str, starts: Column, width: int) -> Column:
        return F.filter(starts, lambda p: (F.col(axis) >= p["x"]) & (F.col(axis) < p["x"] + width))

    for name, n, s, t in (("r", h, size[0], step[0]), ("c", w, size[1], step[1])):
        starts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in enumerate(window_starts(n, s, t))])
        long = long.withColumn(f"_{name}", F.explode(held(name, starts, s)))
    return long.select("img", F.col("_r.k").alias("wr"), F.col("_c.k").alias("wc"), (F.col("r") - F.col("_r.x")).alias("a"), (F.col("c") - F.col("_c.x")).alias("b"), "v")


def zoomed(windows: DataFrame, size: tuple[int, int], factor: tuple[float, float]) -> DataFrame:
    """The centre part of each window: size / factor pixels along each axis."""
    out = windows
    for axis, n, z in (("a", size[0], factor[0]), ("b", size[1], factor[1])):
        mid = n / 2
        lo, hi = int(mid - n / z / 2), int(mid + n / z / 2)
        out = out.where((F.col(axis) >= lo) & (F.col(axis) < hi)).withColumn(axis, F.col(axis) - lo)
    return out


@dataclass(frozen=True)
class WindowOptions:
    """What a windowing run is asked for; anything else than these values is an error before a job starts."""

    size: tuple[int, int]
    step: tuple[int, int]
    mode: str = "image"
    filter: str | None = None
    fft_mode: str = "abs"
    zoom: float = 1.0
    interpolation: float = 1.0

    def __post_init__(self):
        for name, value, known in (("mode", self.mode, ("image", "fft")), ("filter", self.filter, (None, "blackman", "hamming", "hann")), ("fft_mode", self.fft_mode, ("abs", "phase", "complex"))):
            if value not in known:
                raise ValueError(f"{name} is one of {', '.join(map(str, known))}")
        if min(*self.size, *self.step) < 1 or self.zoom < 1 or self.interpolation < 1:
            raise ValueError("sizes and steps are positive, zoom and interpolation are 1 or more")


def rescaled(windows: DataFrame, size: tuple[int, int], factor: float) -> DataFrame:
    """Windows (img, wr, wc, a, b, v) of a size, interpolated linearly to round(size * factor) pixels; edges are continued.

    Each pixel goes to the few output pixels that it has weight in (an explode of a bounded list), and they sum up.
    """
    out = windows
    for axis, n in (("a", size[0]), ("b", size[1])):
        m = int(round(n * factor))
        shares: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for o in range(m):
            at = min(max((o + 0.5) * n / m - 0.5, 0.0), n - 1.0)
            lo = int(at)
            for i, w in ((lo, 1 - (at - lo)), (min(lo + 1, n - 1), at - lo)):
                if w > 0:
                    shares[i].append((o, w))
        table = F.array(*[F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in row]) if row else F.array().cast("array<struct<o:int,w:double>>") for row in shares])
        out = out.withColumn("s", F.explode(table[F.col(axis)])).withColumn("v", F.col("v") * F.col("s.w")).withColumn(axis, F.col("s.o")).drop("s")
    return out.groupBy("img", "wr", "wc", "a", "b").agg(F.sum("v").alias("v"))


def axis_buckets(axes: Column, spatial: Column) -> tuple[Column, Column]:
    """(spatial axes, all others) of an array of axes, in their order."""
    return F.array_intersect(axes, spatial), F.array_except(axes, spatial)


def l1_error(one: DataFrame, other: DataFrame, keys: list[str], step: float = 1.0) -> DataFrame:
    """error: the sum of |v - v'| over positions that both have, times the step; one row."""
    both = one.select(*keys, F.col("v").alias("v0")).join(other.select(*keys, F.col("v").alias("v1")), keys)
    return both.agg((F.coalesce(F.sum(F.abs(F.col("v0") - F.col("v1"))), F.lit(0.0)) * step).alias("error"))


def stack_sum(stack: DataFrame) -> DataFrame:
    return stack.groupBy("r", "c").agg(F.sum("v").alias("v"))


def stack_mean(stack: DataFrame) -> DataFrame:
    return stack.groupBy("r", "c").agg(F.avg("v").alias("v"))


def merged_metadata(first: Column, second: Column) -> Column:
    """Two maps in one; where both have a key the second's value holds."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def mesh(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))


def tapered(windows: DataFrame, kind: str, size: tuple[int, int]) -> DataFrame:
    """Window pixels img, wr, wc, a, b, v times a taper along both axes: hamming, hann or blackman."""
    return windows.withColumn("v", F.col("v") * taper(kind, F.col("a"), size[0]) * taper(kind, F.col("b"), size[1]))
