"""The usual chains of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import factor, filters, graph, grid, points, spectral
from ..operators.iterate import settled
from ..operators.ranks import numbered


def ring_graph(blocks: DataFrame, h: int, w: int, atom_size: float, r_a: float, cheat: float = 1.0) -> DataFrame:
    """Images -> atoms -> tessellation -> structural units -> polygons, one image: unit_id, cyclicity, cx, cy, area, angle_gaps."""
    atoms = filters.find_atoms(blocks, atom_size).withColumn("id", F.row_number().over(Window.partitionBy("img").orderBy("x", "y")).cast("long"))
    p = atoms.select(F.col("img").cast("int").alias("g"), "id", "x", "y")
    sites = graph.interstitials(graph.with_circles(graph.delaunay(p), p), r_a, (float(h), float(w)))
    sites = sites.withColumn("tri_id", F.row_number().over(Window.partitionBy("g").orderBy("a", "b", "c")).cast("long"))
    return graph.polygons(graph.structural_units(sites, graph.components(graph.overlapping(sites, r_a, cheat))), p)


def numbered_windows(long: DataFrame, h: int, w: int, size: int, step: int) -> DataFrame:
    """id, img, wr, wc, data of all sliding windows, numbered in their order."""
    px = grid.window_pixels(long, h, w, (size, size), (step, step))
    win = px.groupBy("img", "wr", "wc").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "v"))), lambda s: s["v"]).alias("data"))
    return settled(numbered(win, ["img", "wr", "wc"]).withColumnRenamed("place", "id"), "windows")


def window_components(long: DataFrame, h: int, w: int, size: int, step: int, k: int, mode: str = "abs", taper: str | None = None):
    """Sliding windows -> taper, if one is named -> spectra -> non-negative factorisation: (weights id, data by window; components; windows id, img, wr, wc)."""
    px = grid.window_pixels(long, h, w, (size, size), (step, step))
    if taper:
        px = grid.tapered(px, taper, (size, size))
    win = px.groupBy("img", "wr", "wc").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "v"))), lambda s: s["v"]).alias("data"))
    rows = settled(numbered(spectral.window_fft(win, size, mode), ["img", "wr", "wc"]).withColumnRenamed("place", "id"), "windows")
    weights, components = factor.nmf(rows.select("id", "data"), size * size, k)
    return weights, components, rows.select("id", "img", "wr", "wc")


def pca_cleaned(long: DataFrame, h: int, w: int, size: int, step: int, k: int | None = None, options: grid.WindowOptions | None = None) -> DataFrame:
    """Windows rebuilt from k components (half of all, if not said) and put back; where windows overlap, the last one's value holds: img, r, c, v.

    options, where given, must not ask for zoom or interpolation: windows go back to where they came from.
    """
    if options is not None and (options.zoom != 1 or options.interpolation != 1):
        raise AssertionError("zoom and interpolation can't be used for cleaning")
    windows = numbered_windows(long, h, w, size, step)
    rows = windows.select("id", "data")
    vh = factor.svd(rows, size * size)[2]
    top = vh[: min(rows.count(), size * size) // 2 if k is None else k]
    back = factor._mapped(rows, lambda x: x @ top.T @ top)
    starts_r, starts_c = (F.array(*map(F.lit, grid.window_starts(m, size, step))) for m in (h, w))
    cells = back.join(windows.select("id", "img", "wr", "wc"), "id").select("id", "img", "wr", "wc", F.posexplode("data").alias("p", "v"))
    r = starts_r[F.col("wr")] + F.floor(F.col("p") / size)
    c = starts_c[F.col("wc")] + F.col("p") % size
    return cells.select("img", r.cast("int").alias("r"), c.cast("int").alias("c"), "id", "v").groupBy("img", "r", "c").agg(F.max_by("v", "id").alias("v"))
