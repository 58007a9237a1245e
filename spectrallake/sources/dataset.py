"""Datasets that know their units: images or spectra with a header, and operators that take and return both.

A header says what the values are, the axes of an image (start and step in units), where the data come from and what was
done to them. Lengths are given in the axes' units; an operator turns them into pixels, passes the data to the pixel
operator of the same name and writes the result's header: axes moved or turned into reciprocal ones, the method and its
arguments under `analysis` with the earlier steps kept. Headers are small and stay on the driver until they are saved.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blobs, factor, filters, grid, registration, spectral
from . import carriers, headers

DATA_TYPES = ("IMAGE", "IMAGE_STACK", "SPECTRAL_IMAGE", "SPECTRUM", "POINT_CLOUD", "UNKNOWN")


@dataclass(frozen=True)
class Axis:
    """One axis of an image: pixel k lies at start + k * step."""

    name: str
    size: int
    units: str = "px"
    kind: str = "spatial"
    start: float = 0.0
    step: float = 1.0

    def __post_init__(self):
        if self.size < 1 or not self.step:
            raise ValueError("an axis has pixels and a step")

    def at(self, value: float) -> int:
        """The pixel nearest to a value, within the axis."""
        return int(min(max(round((value - self.start) / self.step), 0), self.size - 1))

    def pixels(self, length: float) -> float:
        return abs(length / self.step)

    def part(self, first: int, size: int) -> Axis:
        return replace(self, size=size, start=self.start + first * self.step)

    def reciprocal(self) -> Axis:
        """The axis of this one's spectrum, zero frequency in the middle."""
        step = 1 / (self.size * self.step)
        return Axis({"x": "u", "y": "v"}.get(self.name, f"1/{self.name}"), self.size, f"1/{self.units}", "reciprocal", -(self.size // 2) * step, step)


@dataclass(frozen=True)
class Header:
    title: str
    axes: tuple[Axis, ...]
    source: str = ""
    quantity: str = "generic"
    units: str = "counts"
    data_type: str = "IMAGE"
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.data_type not in DATA_TYPES:
            raise ValueError(f"data_type is one of {', '.join(DATA_TYPES)}")

    def after(self, method: str, prefix: str = "", changed: dict | None = None, **arguments) -> Header:
        """The header of a result: this one's title as source, the method and its arguments added to what was done."""
        done = [*self.metadata.get("analysis", []), {"method": method, **arguments}]
        return replace(self, title=f"{prefix or method}_{self.title}", source=self.title, metadata=self.metadata | {"analysis": done}, **(changed or {}))


@dataclass(frozen=True)
class Dataset:
    """Images img, h, w, data that share a header whose axes are their rows and columns."""

    data: DataFrame
    header: Header

    @property
    def shape(self) -> tuple[int, int]:
        return self.header.axes[0].size, self.header.axes[1].size

    def _with(self, data: DataFrame, method: str, changed: dict | None = None, **arguments) -> Dataset:
        return Dataset(data, self.header.after(method, changed=changed, **arguments))


def from_array(spark: SparkSession, arrays, title: str = "generic", units: str = "counts", quantity: str = "generic", axes: tuple[Axis, Axis] | None = None) -> Dataset:
    """A dataset of equally large two-dimensional arrays; complex values and other dimensions are refused."""
    arrays = [np.asarray(a) for a in arrays]
    if any(a.ndim != 2 or a.shape != arrays[0].shape for a in arrays) or not arrays:
        raise ValueError("two-dimensional arrays of one shape")
    if any(a.dtype.kind not in "biuf" for a in arrays):
        raise TypeError("real numbers only")
    h, w = arrays[0].shape
    axes = axes or (Axis("x", h), Axis("y", w))
    if (axes[0].size, axes[1].size) != (h, w):
        raise ValueError("the axes are as long as the arrays")
    kind = "IMAGE" if len(arrays) == 1 else "IMAGE_STACK"
    return Dataset(carriers.from_arrays(spark, [a.astype(float) for a in arrays]), Header(title, tuple(axes), quantity=quantity, units=units, data_type=kind))


def crop(ds: Dataset, x: tuple[float, float], y: tuple[float, float]) -> Dataset:
    """The part of the images between values of both axes, the last one left out; axes keep their values."""
    rows, cols = ds.header.axes[:2]
    r, c = sorted(map(rows.at, x)), sorted(map(cols.at, y))
    if r[0] == r[1] or c[0] == c[1]:
        raise ValueError("nothing is left")
    h, w = r[1] - r[0], c[1] - c[0]
    long = grid.crop_image(carriers.to_long(ds.data), (r[0], c[0], r[1], c[1]))
    return ds._with(carriers.to_block(long, h, w), "crop", {"axes": (rows.part(r[0], h), cols.part(c[0], w), *ds.header.axes[2:])}, x=list(x), y=list(y))


def smooth(ds: Dataset, sigma: float) -> Dataset:
    """Gaussian smoothing with a width in the units of the axes, which must have one step."""
    rows, cols = ds.header.axes[:2]
    if not np.isclose(abs(rows.step), abs(cols.step)):
        raise ValueError("both axes need the same step")
    return ds._with(filters.gaussian_smooth(ds.data, *ds.shape, rows.pixels(sigma)), "smooth", sigma=sigma)


def decon(ds: Dataset, resolution: float) -> Dataset:
    """Lucy-Richardson deconvolution with a probe as wide as the resolution, in the units of the axes."""
    return ds._with(filters.decon_lr(ds.data, *ds.shape, resolution=resolution, pixel_size=abs(ds.header.axes[0].step)), "decon_lr", resolution=resolution)


def power_spectrum(ds: Dataset, smoothing: float = 3.0) -> Dataset:
    """Log-magnitude spectra over reciprocal axes."""
    axes = tuple(a.reciprocal() for a in ds.header.axes[:2])
    return ds._with(spectral.power_spectrum(ds.data, *ds.shape, smoothing), "power_spectrum", {"axes": axes, "quantity": "log magnitude", "units": "a.u."}, smoothing=smoothing)


def spots(ds: Dataset, threshold: float = 0.5) -> DataFrame:
    """img, u, v, distance, angle of the spots of the spectra, in reciprocal units."""
    rows, cols = ds.header.axes[:2]
    found = spectral.diffractogram_spots(ds.data, threshold)
    u, v = F.col("u") / abs(rows.step), F.col("v") / abs(cols.step)
    return found.select("img", u.alias("u"), v.alias("v"), F.sqrt(u * u + v * v).alias("distance"), F.atan2(u, v).alias("angle"))


def atoms(ds: Dataset, atom_size: float, threshold: float = -1.0, tile: int | None = None) -> tuple[DataFrame, Header]:
    """(img, x, y, sigma in the units of the axes, header of the points). With tile, images are searched in tiles."""
    rows, cols = ds.header.axes[:2]
    step = abs(rows.step)
    found = filters.find_atoms(ds.data, atom_size, threshold, step) if tile is None else blobs.find_blobs(carriers.to_long(ds.data), atom_size, threshold, step, tile)
    places = found.select("img", (F.col("x") * rows.step + rows.start).alias("x"), (F.col("y") * cols.step + cols.start).alias("y"), (F.col("sigma") * step).alias("sigma"))
    return places, ds.header.after("find_atoms", changed={"data_type": "POINT_CLOUD"}, atom_size=atom_size, threshold=threshold)


def registered(ds: Dataset, normalization: str | None = None, upsample: int = 1) -> tuple[Dataset, DataFrame]:
    """(stack moved onto its middle frame and cropped to what all frames show, drift in the units of the axes). img is the number of the frame."""
    if ds.header.data_type != "IMAGE_STACK":
        raise TypeError("registration makes sense for an image stack only")
    rows, cols = ds.header.axes[:2]
    stack = carriers.to_long(ds.data).select(F.col("img").cast("int").alias("f"), "r", "c", "v")
    moved, drift = registration.rigid_registration(stack, *ds.shape, normalization, upsample)
    r0, r1, c0, c1 = registration.common_area(drift, *ds.shape)
    data = carriers.to_block(moved.select(F.col("f").cast("long").alias("img"), "r", "c", "v"), r1 - r0, c1 - c0)
    out = ds._with(data, "rigid_registration", {"axes": (rows.part(r0, r1 - r0), cols.part(c0, c1 - c0), *ds.header.axes[2:])}, normalization=normalization, upsample=upsample, input_crop=[r0, r1, c0, c1], input_shape=list(ds.shape))
    return out, drift.select("f", (F.col("dr") * rows.step).alias("x"), (F.col("dc") * cols.step).alias("y"))


def factorised(ds: Dataset, method: str, components: int, **options) -> tuple[DataFrame, np.ndarray, Header]:
    """(weights by image, components, header) of a matrix factorisation of the images as rows; the header says how it was made."""
    p = ds.shape[0] * ds.shape[1]
    weights, found = factor.factor(ds.data.select(F.col("img").alias("id"), "data"), method, p, components, **options)[:2]
    return weights, found, ds.header.after(method, changed={"data_type": "UNKNOWN"}, components=components, **options)


def header_row(spark: SparkSession, header: Header, dataset: int = 0) -> DataFrame:
    """The header as a row of the table of headers."""
    axes = [(a.name, a.units, a.kind, float(a.start), float(a.step), a.size) for a in header.axes]
    meta = {k: v if isinstance(v, str) else json.dumps(v) for k, v in header.metadata.items()}
    return spark.createDataFrame([(dataset, header.title, header.source, header.quantity, header.units, header.data_type, axes, meta)], headers.SCHEMA)


def save(ds: Dataset, path: str) -> None:
    """Images and header, as Parquet side by side."""
    ds.data.write.mode("overwrite").parquet(f"{path}/data")
    header_row(ds.data.sparkSession, ds.header).write.mode("overwrite").parquet(f"{path}/header")


def load(spark: SparkSession, path: str) -> Dataset:
    r = spark.read.parquet(f"{path}/header").first()
    axes = tuple(Axis(a["name"], a["size"], a["units"], a["kind"], a["start"], a["step"]) for a in r["axes"])

    def value(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return text

    return Dataset(spark.read.parquet(f"{path}/data"), Header(r["title"], axes, r["source"], r["quantity"], r["units"], r["data_type"], {k: value(v) for k, v in (r["metadata"] or {}).items()}))
