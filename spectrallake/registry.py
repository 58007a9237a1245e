"""Queries over the driver's tables, one for each operator, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import signal
from .operators import blobs, blocks, cluster, factor, filters, graph, grid, nn, points, ranks, registration, spectral
from .operators.iterate import settled
from .plans import pipelines
from .sources import carriers, dataset, headers
from .sources.carriers import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Register a query under its function's name; sql may use the carriers named in tables."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = (f"WITH {', '.join(CTES[t] for t in tables)} {', ' if sql.startswith('+') else ''}{sql.lstrip('+')}" if tables else sql)
        return fn

    return keep


def rounded(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def _long(block_rows: DataFrame, digits: int = 6) -> DataFrame:
    return carriers.to_long(block_rows).withColumn("v", rounded("v", digits))


# ---- grid ----


@query("SELECT img, r - 2 AS r, c - 1 AS c, v FROM px WHERE r >= 2 AND r < 6 AND c >= 1 AND c < 7", "px")
def crop_rect(spark, d):
    return grid.crop_image(carriers.px(spark, d), (2, 1, 6, 7))


@query('SELECT CAST(i * 25 + j AS INTEGER) AS "row", CAST(a * 8 + b AS INTEGER) AS col, v FROM cube', "cube")
def fold_spaspec(spark, d):
    return grid.fold_spaspec(carriers.cube(spark, d), 25, 8)


@query("SELECT i, j, a, b, v FROM cube", "cube")
def unfold_roundtrip(spark, d):
    return grid.unfold(grid.fold_spaspec(carriers.cube(spark, d), 25, 8), 25, 8)


@query("SELECT i, CAST((j * 8 + a) * 8 + b AS INTEGER) AS flat, v FROM cube", "cube")
def flat_from(spark, d):
    return grid.flat_from(carriers.cube(spark, d), ["i", "j", "a", "b"], [0, 25, 8, 8], 1)


@query("SELECT i, j, b, v FROM cube WHERE a = 2", "cube")
def channel_select(spark, d):
    return grid.picked(carriers.cube(spark, d), {"a": 2})


@query(
    """SELECT img, r, c, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0.0 END, 6) + 0.0 AS v
    FROM px WINDOW w AS (PARTITION BY img)""", "px")
def minmax_norm(spark, d):
    return _long(grid.min_max_normalised(carriers.images(spark, d)))


@query("SELECT img, r, c, CAST(CASE WHEN v > 0 THEN 0 ELSE 1 END AS INTEGER) AS m FROM px", "px")
def mask_invert(spark, d):
    """The pixels outside a mask of those over 0, in every image."""
    mask = carriers.px(spark, d).select("img", "r", "c", (F.col("v") > 0).cast("int").alias("m"))
    return grid.inverted_mask(mask)


@query("SELECT img, r, c, v FROM px WHERE (r - 4) * (r - 4) + (c - 4) * (c - 4) < 9", "px")
def circular_mask(spark, d):
    return carriers.px(spark, d).where(grid.in_disk(F.col("r"), F.col("c"), 4, 4, 3))


@query("SELECT img, round(min(v) * 0.95, 6) + 0.0 AS vmin, round(max(v) * 1.05, 6) + 0.0 AS vmax FROM px WHERE (r - 4) ** 2 + (c - 4) ** 2 > 1 AND (r - 4) ** 2 + (c - 4) ** 2 < 16 GROUP BY img", "px")
def annulus_limits(spark, d):
    return grid.annulus_limits(carriers.px(spark, d), 4, 1, 4).select("img", rounded("vmin").alias("vmin"), rounded("vmax").alias("vmax"))


_WINDOWS = "+wr AS (SELECT * FROM (VALUES (0, 0), (1, 2), (2, 4), (3, 4)) t(k, x) WHERE k < 3), win AS (SELECT p.img, a.k AS wr, b.k AS wc, p.r - a.x AS a, p.c - b.x AS b, p.v FROM px p JOIN wr a ON p.r >= a.x AND p.r < a.x + 4 JOIN wr b ON p.c >= b.x AND p.c < b.x + 4)"


@query(_WINDOWS + " SELECT img, wr, wc, a, b, v FROM win", "px")
def window_pixels(spark, d):
    return grid.window_pixels(carriers.px(spark, d), 8, 8, (4, 4), (2, 2))


@query(_WINDOWS + " SELECT img, wr, wc, a - 1 AS a, b - 1 AS b, v FROM win WHERE a BETWEEN 1 AND 2 AND b BETWEEN 1 AND 2", "px")
def window_zoom(spark, d):
    return grid.zoomed(grid.window_pixels(carriers.px(spark, d), 8, 8, (4, 4), (2, 2)), (4, 4), (2, 2))


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY x) - 1 AS INTEGER) AS k, CAST(x AS INTEGER) AS x FROM (SELECT p_partkey, unnest(list_distinct(list_append(range(0, p_size + 41 - 24, 7), p_size + 41 - 24))) AS x FROM part)")
def window_grid(spark, d):
    """Starts of windows of 24 in steps of 7 along axes of different lengths, the last one at the end."""
    sizes = carriers.read(spark, d, "part").select("p_partkey", (F.col("p_size") + 41).alias("n"))
    starts = F.udf(lambda n: grid.window_starts(n, 24, 7), "array<int>", useArrow=True)
    lists = sizes.select("n").distinct().select("n", starts("n").alias("starts"))
    return sizes.join(lists, "n").select("p_partkey", F.posexplode("starts").alias("k", "x"))


@query("SELECT r, c, CAST(sum(v) AS BIGINT) AS v FROM stack GROUP BY r, c", "stack")
def stack_sum(spark, d):
    return grid.stack_sum(carriers.stack(spark, d))


@query("SELECT r, c, round(avg(v), 4) + 0.0 AS v FROM stack GROUP BY r, c", "stack")
def stack_mean(spark, d):
    return grid.stack_mean(carriers.stack(spark, d)).withColumn("v", rounded("v", 4))


@query("SELECT p_partkey, 'part' AS kind, p_type AS note FROM part")
def metadata_merge(spark, d):
    first = F.create_map(F.lit("kind"), F.lit("any"), F.lit("note"), F.lit("none"))
    second = F.create_map(F.lit("kind"), F.lit("part"), F.lit("note"), F.col("p_type"))
    merged = carriers.read(spark, d, "part").select("p_partkey", grid.merged_metadata(first, second).alias("m"))
    return merged.select("p_partkey", F.col("m")["kind"].alias("kind"), F.col("m")["note"].alias("note"))


# ---- filters ----

_FLATTEN = "+fit AS (SELECT img, {0}, regr_slope(v, {1}) AS s, regr_intercept(v, {1}) AS i FROM px GROUP BY img, {0}) SELECT p.img, p.r, p.c, round(p.v - f.s * p.{1} - f.i, 6) + 0.0 AS v FROM px p JOIN fit f USING (img, {0})"


@query(_FLATTEN.format("r", "c"), "px")
def flatten_rows(spark, d):
    return _long(filters.flattened(carriers.images(spark, d), 8, 8))


@query(_FLATTEN.format("c", "r"), "px")
def flatten_cols(spark, d):
    return _long(filters.flattened(carriers.images(spark, d), 8, 8, "col"))


@query(_FLATTEN.format("r", "c"), "px")
def flatten_lines_regr(spark, d):
    return filters.flattened_lines(carriers.px(spark, d)).withColumn("v", rounded("v"))


#: Residuals of an order-2 fit: the part along the three orthogonal polynomials of eight points goes.
@query(
    """+b AS (SELECT *, 1 / sqrt(8) AS p0, (2 * c - 7) / sqrt(168) AS p1, ((c - 3.5) * (c - 3.5) - 5.25) / sqrt(168) AS p2 FROM px),
    s AS (SELECT *, sum(v * p0) OVER w AS s0, sum(v * p1) OVER w AS s1, sum(v * p2) OVER w AS s2, sum(p2 * p2) OVER w AS n2 FROM b WINDOW w AS (PARTITION BY img, r))
    SELECT img, r, c, round(v - s0 * p0 - s1 * p1 - s2 * p2 / n2, 6) + 0.0 AS v FROM s""", "px")
def flatten_rows_order2(spark, d):
    return _long(filters.flattened(carriers.images(spark, d), 8, 8, order=2))


@query(
    """+m AS (SELECT *, avg(v) OVER w AS mv, sum(v * (r - 3.5)) OVER w / 336 AS sr, sum(v * (c - 3.5)) OVER w / 336 AS sc FROM px WINDOW w AS (PARTITION BY img))
    SELECT img, r, c, round(v - mv - sr * (r - 3.5) - sc * (c - 3.5), 6) + 0.0 AS v FROM m""", "px")
def plane_fit(spark, d):
    return _long(filters.plane_flattened(carriers.images(spark, d), 8, 8))


_KERNEL = "k AS (SELECT d - 4 AS d, exp(-0.5 * (d - 4) * (d - 4)) / (SELECT sum(exp(-0.5 * (e - 4) * (e - 4))) FROM range(9) t(e)) AS w FROM range(9) t(d)), m AS (SELECT p AS at, k.w, CASE WHEN (p + k.d + 16) % 16 >= 8 THEN 15 - (p + k.d + 16) % 16 ELSE (p + k.d + 16) % 16 END AS fr FROM range(8) t(p), k)"


@query(f"+{_KERNEL}, one AS (SELECT p.img, CAST(m.at AS INTEGER) AS r, p.c, sum(m.w * p.v) AS v FROM px p JOIN m ON p.r = m.fr GROUP BY ALL) SELECT p.img, p.r, CAST(m.at AS INTEGER) AS c, round(sum(m.w * p.v), 6) + 0.0 AS v FROM one p JOIN m ON p.c = m.fr GROUP BY p.img, p.r, m.at", "px")
def gaussian_smooth(spark, d):
    return _long(filters.gaussian_smooth(carriers.images(spark, d), 8, 8, 1.0))


@query("+g AS (SELECT r, c, exp(-((r - 4) ** 2 + (c - 4) ** 2) / 8.0) AS w FROM range(8) a(r), range(8) b(c)) SELECT img, round(sum(v * w) / (SELECT sum(w) FROM g), 9) + 0.0 AS seen FROM px JOIN g USING (r, c) GROUP BY img", "px")
def gauss_probe(spark, d):
    """What a probe in the middle of each image sees."""
    g = signal.gauss(8, 2.0)
    return _long(blocks.map_images(carriers.images(spark, d), lambda x: (x * g).sum((1, 2)), 1, 1), 9).select("img", F.col("v").alias("seen"))


@query("+n AS (SELECT a.img, a.r, a.c, a.v, max(b.v) AS m FROM px a JOIN px b ON a.img = b.img AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY ALL) SELECT img, r, c, v FROM n WHERE v > m", "px")
def local_maxima(spark, d):
    return spectral.peaks(carriers.images(spark, d))


@query()
def decon_lr(spark, d):
    return _long(filters.decon_lr(carriers.images(spark, d), 8, 8, resolution=1.5), 4)


_DECON = """+z AS (SELECT img, r, c, v - min(v) OVER (PARTITION BY img) + 1e-9 AS v FROM px), g AS (SELECT d, exp(-1 * (((d + 4) % 8) - 4) * (((d + 4) % 8) - 4) / 4.5) / (SELECT sum(exp(-1 * (e - 4) * (e - 4) / 4.5)) FROM range(8) t(e)) AS w FROM range(8) t(d)),
 b1 AS (SELECT z.img, (z.r + g.d) % 8 AS r, z.c, sum(z.v * g.w) AS v FROM z, g GROUP BY ALL), b AS (SELECT b1.img, b1.r, (b1.c + g.d) % 8 AS c, sum(b1.v * g.w) AS v FROM b1, g GROUP BY ALL),
 q AS (SELECT z.img, z.r, z.c, z.v / b.v AS v FROM z JOIN b USING (img, r, c)),
 c1 AS (SELECT q.img, (q.r - g.d + 8) % 8 AS r, q.c, sum(q.v * g.w) AS v FROM q, g GROUP BY ALL), c2 AS (SELECT c1.img, c1.r, (c1.c - g.d + 8) % 8 AS c, sum(c1.v * g.w) AS v FROM c1, g GROUP BY ALL)
 SELECT z.img, z.r, z.c, round(z.v * c2.v, 6) + 0.0 AS v FROM z JOIN c2 USING (img, r, c)"""


@query(_DECON, "px")
def decon_lr_1step(spark, d):
    return _long(filters.decon_lr(carriers.images(spark, d), 8, 8, resolution=1.5, iterations=1))


@query()
def clean_svd(spark, d):
    return _long(filters.clean_svd(carriers.images(spark, d), 8, 8), 4)


@query()
def inpaint(spark, d):
    mask = np.array([[(r + 2 * c) % 5 != 0 for c in range(8)] for r in range(8)])
    return _long(filters.inpaint(carriers.images(spark, d), mask, 8, 8))


@query()
def find_atoms(spark, d):
    return filters.find_atoms(carriers.images(spark, d), atom_size=2.0)


@query()
def atom_refine(spark, d):
    atoms = spectral.peaks(carriers.images(spark, d)).where("r between 2 and 5 and c between 2 and 5").select("img", (F.col("img") * 64 + F.col("r") * 8 + F.col("c")).alias("atom_id"), F.col("r").alias("x"), F.col("c").alias("y"))
    cut = points.patches(carriers.px(spark, d), atoms, 2).groupBy("atom_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dr", "dc", "v"))), lambda s: s["v"]).alias("data"))
    rows = atoms.join(cut, "atom_id").select("atom_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "data")
    return filters.atom_refine(rows, 2)


# ---- spectral ----

_DFT = """+w AS (SELECT u, x, cos(2 * pi() * u * x / 8) AS co, sin(2 * pi() * u * x / 8) AS si FROM range(-4, 4) a(u), range(8) b(x)),
 z AS (SELECT img, r, c, v - min(v) OVER (PARTITION BY img) AS v FROM px),
 one AS (SELECT z.img, w.u, z.c, sum(z.v * w.co) AS re, -sum(z.v * w.si) AS im FROM z JOIN w ON w.x = z.r GROUP BY ALL),
 f AS (SELECT o.img, CAST(o.u AS INTEGER) AS u, CAST(w.u AS INTEGER) AS v, sum(o.re * w.co + o.im * w.si) AS re, sum(o.im * w.co - o.re * w.si) AS im FROM one o JOIN w ON w.x = o.c GROUP BY o.img, o.u, w.u)"""


@query(_DFT + " SELECT img, u, v, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM f", "px")
def dft2(spark, d):
    f = spectral.fourier_transform(carriers.images(spark, d))
    return f.select("img", "u", "v", rounded("re", 5).alias("re"), rounded("im", 5).alias("im"))


_KERNEL3 = "k AS (SELECT d - 12 AS d, exp(-0.5 * ((d - 12) / 3.0) ** 2) / (SELECT sum(exp(-0.5 * ((e - 12) / 3.0) ** 2)) FROM range(25) t(e)) AS w FROM range(25) t(d)), m AS (SELECT p - 4 AS at, k.w, CASE WHEN (p + k.d + 16) % 16 >= 8 THEN 15 - (p + k.d + 16) % 16 ELSE (p + k.d + 16) % 16 END - 4 AS fr FROM range(8) t(p), k)"


@query(_DFT + f", {_KERNEL3}, a AS (SELECT img, u, v, sqrt(re * re + im * im) AS x FROM f), b AS (SELECT a.img, m.at AS u, a.v, sum(m.w * a.x) AS x FROM a JOIN m ON a.u = m.fr GROUP BY ALL) SELECT b.img, CAST(b.u + 4 AS INTEGER) AS r, CAST(m.at + 4 AS INTEGER) AS c, round(ln(1 + sum(m.w * b.x)), 6) + 0.0 AS v FROM b JOIN m ON b.v = m.fr GROUP BY b.img, b.u, m.at", "px")
def power_spectrum(spark, d):
    return _long(spectral.power_spectrum(carriers.images(spark, d), 8, 8))


@query("SELECT img, r, c, round(v, 6) + 0.0 AS v FROM px", "px")
def inverse_dft_roundtrip(spark, d):
    return _long(spectral.adaptive_fourier_filter(carriers.images(spark, d), [], 8, 8, low_pass=100.0))


@query(
    """+w AS (SELECT u, x, cos(2 * pi() * u * x / 8) AS co, sin(2 * pi() * u * x / 8) AS si FROM range(-4, 4) a(u), range(8) b(x)),
    one AS (SELECT z.img, w.u, z.c, sum(z.v * w.co) AS re, -sum(z.v * w.si) AS im FROM px z JOIN w ON w.x = z.r GROUP BY ALL),
    f AS (SELECT o.img, o.u AS u, w.u AS v, sum(o.re * w.co + o.im * w.si) AS re, sum(o.im * w.co - o.re * w.si) AS im FROM one o JOIN w ON w.x = o.c GROUP BY o.img, o.u, w.u),
    g AS (SELECT * FROM f WHERE u * u + v * v < 4 OR (u - 3) ** 2 + (v - 1) ** 2 < 0.09 OR (u + 3) ** 2 + (v + 1) ** 2 < 0.09),
    h AS (SELECT g.img, w.x AS r, g.v, sum(g.re * w.co - g.im * w.si) AS re, sum(g.re * w.si + g.im * w.co) AS im FROM g JOIN w ON w.u = g.u GROUP BY ALL)
    SELECT h.img, CAST(h.r AS INTEGER) AS r, CAST(w.x AS INTEGER) AS c, round(sum(h.re * w.co - h.im * w.si) / 64, 6) + 0.0 AS v FROM h JOIN w ON w.u = h.v GROUP BY h.img, h.r, w.x""", "px")
def fourier_filter(spark, d):
    return _long(spectral.adaptive_fourier_filter(carriers.images(spark, d), [(3, 1), (-3, -1)], 8, 8, low_pass=2.0))


def _windows(spark, d, mode):
    px = grid.window_pixels(carriers.px(spark, d), 8, 8, (4, 4), (2, 2))
    win = px.groupBy("img", "wr", "wc").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "v"))), lambda s: s["v"]).alias("data"))
    return spectral.window_fft(win, 4, mode).select("img", "wr", "wc", F.posexplode("data").alias("k", "v"))


_WINDOW_FFT = _WINDOWS + """, w AS (SELECT u, x, cos(2 * pi() * u * x / 4) AS co, sin(2 * pi() * u * x / 4) AS si FROM range(-2, 2) a(u), range(4) b(x)),
 f AS (SELECT z.img, z.wr, z.wc, p.u AS u, q.u AS v, sum(z.v * (p.co * q.co - p.si * q.si)) AS re, -sum(z.v * (p.si * q.co + p.co * q.si)) AS im FROM win z JOIN w p ON p.x = z.a JOIN w q ON q.x = z.b GROUP BY ALL)"""


@query(_WINDOW_FFT + " SELECT img, wr, wc, CAST((u + 2) * 4 + v + 2 AS INTEGER) AS k, round(sqrt(re * re + im * im), 6) + 0.0 AS v FROM f", "px")
def window_fft_abs(spark, d):
    return _windows(spark, d, "abs").withColumn("v", rounded("v"))


#: Phases are compared as unit vectors where the magnitude is not next to zero: -pi and pi are one angle.
@query(_WINDOW_FFT + """ SELECT img, wr, wc, CAST((u + 2) * 4 + v + 2 AS INTEGER) AS k, CASE WHEN sqrt(re * re + im * im) > 1e-6 THEN round(cos(atan2(im, re)), 4) + 0.0 END AS co,
 CASE WHEN sqrt(re * re + im * im) > 1e-6 THEN round(sin(atan2(im, re)), 4) + 0.0 END AS si FROM f""", "px")
def window_fft_phase(spark, d):
    """Cosine and sine of every coefficient's phase; null where the magnitude is next to zero."""
    phase = _windows(spark, d, "phase").withColumnRenamed("v", "phase").join(_windows(spark, d, "abs"), ["img", "wr", "wc", "k"])
    told = F.col("v") > 1e-6
    return phase.select("img", "wr", "wc", "k", F.when(told, rounded(F.cos("phase"), 4)).alias("co"), F.when(told, rounded(F.sin("phase"), 4)).alias("si"))


def _taper(kind):
    def run(spark, d):
        windows = grid.window_pixels(carriers.px(spark, d), 8, 8, (4, 4), (2, 2))
        return grid.tapered(windows, kind, (4, 4)).withColumn("v", rounded("v", 9))

    return run


for _kind, _sql in (("hamming", "0.54 - 0.46 * cos(2 * pi() * {0} / 3)"), ("hann", "0.5 - 0.5 * cos(2 * pi() * {0} / 3)"), ("blackman", "0.42 - 0.5 * cos(2 * pi() * {0} / 3) + 0.08 * cos(4 * pi() * {0} / 3)")):
    QUERIES[f"taper_{_kind}"] = _taper(_kind)
    ORACLES[f"taper_{_kind}"] = f"WITH {CTES['px']}, {_WINDOWS[1:]} SELECT img, wr, wc, a, b, round(v * ({_sql.format('a')}) * ({_sql.format('b')}), 9) + 0.0 AS v FROM win"


@query(_WINDOW_FFT.replace("sum(z.v *", "sum(z.v * (0.5 - 0.5 * cos(2 * pi() * z.a / 3)) * (0.5 - 0.5 * cos(2 * pi() * z.b / 3)) *") + " SELECT img, wr, wc, CAST((u + 2) * 4 + v + 2 AS INTEGER) AS k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM f", "px")
def window_fft_complex(spark, d):
    """Complex spectra of windows under a Hann taper."""
    px = grid.tapered(grid.window_pixels(carriers.px(spark, d), 8, 8, (4, 4), (2, 2)), "hann", (4, 4))
    win = px.groupBy("img", "wr", "wc").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "v"))), lambda s: s["v"]).alias("data"))
    both = spectral.window_fft(win, 4, "complex").select("img", "wr", "wc", F.posexplode("data").alias("at", "v"))
    pairs = both.groupBy("img", "wr", "wc", F.floor(F.col("at") / 2).cast("int").alias("k")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("v"))).alias("re"), F.max(F.when(F.col("at") % 2 == 1, F.col("v"))).alias("im"))
    return pairs.withColumns({"re": rounded("re"), "im": rounded("im")})


def _all_spots(spark, d):
    """Each label is one diffractogram."""
    return carriers.points(spark, d).select(F.col("type").alias("g"), "id", F.col("x").alias("u"), F.col("y").alias("v"))


@query("SELECT type AS g, id, round(sqrt(x * x + y * y), 9) + 0.0 AS distance, round(atan2(x, y), 6) + 0.0 AS angle, CAST(row_number() OVER (PARTITION BY type ORDER BY sqrt(x * x + y * y), id) AS INTEGER) AS rank FROM points", "points")
def spot_sort_angle(spark, d):
    return spectral.spots_by_distance(_all_spots(spark, d)).select("g", "id", rounded("distance", 9).alias("distance"), rounded("angle").alias("angle"), "rank")


@query(
    """+s AS (SELECT type AS g, x AS u, y AS v FROM points), c AS (SELECT g, count(*) AS size FROM s GROUP BY g), t AS (SELECT g, n, u * cos(2 * pi() / n) - v * sin(2 * pi() / n) AS ru, u * sin(2 * pi() / n) + v * cos(2 * pi() / n) AS rv FROM s, (VALUES (2), (3), (4), (6)) o(n)),
    k AS (SELECT s.g, n, sqrt((ru - u) ** 2 + (rv - v) ** 2) AS d, row_number() OVER (PARTITION BY s.g, n ORDER BY sqrt((ru - u) ** 2 + (rv - v) ** 2)) AS k FROM t JOIN s ON s.g = t.g)
    SELECT k.g, n, d < 0.2 AS symmetric, round(d, 9) + 0.0 AS d FROM k JOIN c ON c.g = k.g WHERE k = CAST(floor(size * 0.7) AS BIGINT) + 1""", "points")
def rotational_symmetry(spark, d):
    return spectral.rotational_symmetry(_all_spots(spark, d)).withColumn("d", rounded("d", 9))


@query("SELECT a.type AS g, a.id AS i, b.id AS j, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y FROM points a JOIN points b ON a.type = b.type", "points")
def midpoints(spark, d):
    return points.midpoints(_groups(spark, d).select("g", "id", "x", "y"))


@query(
    _DFT + """, p AS (SELECT img, u, v, ln(1 + sqrt(re * re + im * im)) AS x FROM f), q AS (SELECT img, u, v, (x - min(x) OVER w) / greatest(max(x) OVER w - min(x) OVER w, 1e-300) AS y FROM p WINDOW w AS (PARTITION BY img)),
    m AS (SELECT a.img, a.u, a.v, a.y, max(b.y) AS most FROM q a JOIN q b ON a.img = b.img AND abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1 AND (a.u <> b.u OR a.v <> b.v) GROUP BY ALL)
    SELECT img, u / 8 AS u, v / 8 AS v, round(sqrt(u * u + v * v) / 8, 6) + 0.0 AS distance, round(atan2(u, v), 6) + 0.0 AS angle FROM m WHERE y > most AND y > 0.5""", "px")
def diffractogram_spots(spark, d):
    return spectral.diffractogram_spots(carriers.images(spark, d), 0.5).withColumns({"distance": rounded("distance"), "angle": rounded("angle")})


# ---- points ----

_KNN = "+k AS (SELECT a.id AS i, CAST(row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) - 1 AS INTEGER) AS rank, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, a.x - b.x AS dx, a.y - b.y AS dy, b.type FROM {0} a JOIN points b ON {1})"


@query(_KNN.format("points", "true") + " SELECT i, rank, j, round(d, 9) + 0.0 AS d FROM k WHERE rank < 7", "points")
def knn_join(spark, d):
    p = carriers.points(spark, d)
    return points.knn(p, p, 7).select("i", "rank", "j", rounded("d", 9).alias("d"))


@query(_KNN.format("points", "a.id <> b.id") + " SELECT i, rank, j, round(d, 9) + 0.0 AS d FROM k WHERE rank < 8", "points")
def knn_self(spark, d):
    p = carriers.points(spark, d)
    return points.knn(p, p, 8, include_self=False).select("i", "rank", "j", rounded("d", 9).alias("d"))


@query(_KNN.format("points", "a.id <> b.id") + " SELECT i, rank, j, type FROM k WHERE rank < 8", "points")
def neighbor_types(spark, d):
    p = carriers.points(spark, d)
    return points.neighbour_types(points.knn(p, p, 8, include_self=False), p)


@query(_KNN.format("points", "a.id <> b.id") + " SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY atan2(dy, dx), j) - 1 AS INTEGER) AS place, j, round(d, 9) + 0.0 AS d, round(atan2(dy, dx), 6) + 0.0 AS angle, round(dx, 9) + 0.0 AS dx, round(dy, 9) + 0.0 AS dy FROM k WHERE rank < 8", "points")
def neighborhood_sorted(spark, d):
    p = carriers.points(spark, d)
    n = points.neighbourhood(points.knn(p, p, 8, include_self=False))
    return n.select("i", "place", "j", rounded("d", 9).alias("d"), rounded("angle").alias("angle"), rounded("dx", 9).alias("dx"), rounded("dy", 9).alias("dy"))


@query("SELECT id, NOT (x + 0.5 > 0.03 AND x + 0.5 < 0.97 AND y + 0.5 > 0.03 AND y + 0.5 < 0.97) AS border FROM points", "points")
def border_flag(spark, d):
    return carriers.points(spark, d).select("id", points.border_flag(F.col("x") + 0.5, F.col("y") + 0.5, 1.0, 1.0).alias("border"))


@query("SELECT id, x + 0.5 > 0.2 AND y + 0.5 > 0.2 AND 1 - (x + 0.5) > 0.2 AND 1 - (y + 0.5) > 0.2 AS inside FROM points", "points")
def interior_gate(spark, d):
    return carriers.points(spark, d).select("id", points.interior(F.col("x") + 0.5, F.col("y") + 0.5, 1.0, 1.0, 0.2).alias("inside"))


@query(
    """+a AS (SELECT img, img AS atom_id, CAST(img % 8 AS INTEGER) AS x, CAST((img // 8) % 8 AS INTEGER) AS y FROM (SELECT DISTINCT img FROM px)),
    s AS (SELECT a.img, a.atom_id, sum(p.v) AS s, max(p.v) AS m, count(*) AS n FROM a JOIN px p ON p.img = a.img AND (p.r - a.x) ** 2 + (p.c - a.y) ** 2 < 4 GROUP BY ALL)
    SELECT img, atom_id, CASE WHEN n = 9 THEN round(s, 6) + 0.0 ELSE -1 END AS intensity, CASE WHEN n = 9 THEN m ELSE -1 END AS maximum FROM s""", "px")
def patch_intensity(spark, d):
    atoms = carriers.images(spark, d).select("img", F.col("img").alias("atom_id"), (F.col("img") % 8).cast("int").alias("x"), (F.floor(F.col("img") / 8) % 8).cast("int").alias("y"))
    return points.intensity_area(carriers.px(spark, d), atoms, 2).withColumn("intensity", rounded("intensity"))


_PAIRS = "pr AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM points a JOIN points b ON a.id < b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < {0})"


@query(f"+{_PAIRS.format(0.012)} SELECT i, j, round(d, 9) + 0.0 AS d FROM pr", "points")
def radius_pairs(spark, d):
    return points.radius_pairs(carriers.points(spark, d), 0.012).withColumn("d", rounded("d", 9))


@query(f"+{_PAIRS.format(0.012)}, b AS (SELECT i, j FROM pr UNION ALL SELECT j, i FROM pr UNION ALL SELECT id, id FROM points) SELECT b.i AS id, round(avg(p.x), 9) + 0.0 AS x, round(avg(p.y), 9) + 0.0 AS y, count(*) AS n FROM b JOIN points p ON p.id = b.j GROUP BY b.i", "points")
def radius_merge(spark, d):
    m = points.merged_within(carriers.points(spark, d), 0.012)
    return m.select("id", rounded("x", 9).alias("x"), rounded("y", 9).alias("y"), "n")


_REACH = "e AS (SELECT i, j FROM pr UNION ALL SELECT j, i FROM pr), reach AS (SELECT i AS node, j AS c FROM e UNION SELECT r.node, e.j FROM reach r JOIN e ON r.c = e.i)"


def _recursive(name: str) -> None:
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"+{_PAIRS.format(0.012)}, {_REACH} SELECT node, least(node, min(c)) AS component FROM reach GROUP BY node", "points")
def components(spark, d):
    return graph.components(points.radius_pairs(carriers.points(spark, d), 0.012))


_recursive("components")
_DBSCAN = f"""+all_pairs AS (SELECT a.id AS i, b.id AS j FROM points a JOIN points b ON a.id <> b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 0.015),
 core AS (SELECT i FROM all_pairs GROUP BY i HAVING count(*) + 1 >= 3), pr AS (SELECT i, j FROM all_pairs WHERE i IN (FROM core) AND j IN (FROM core)),
 {_REACH}, cl AS (SELECT k.i, least(k.i, min(r.c)) AS cluster FROM core k LEFT JOIN reach r ON r.node = k.i GROUP BY k.i),
 bd AS (SELECT p.i, min(c.cluster) AS cluster FROM all_pairs p JOIN cl c ON c.i = p.j WHERE p.i NOT IN (FROM core) GROUP BY p.i),
 lab AS (SELECT p.id, coalesce(cl.cluster, bd.cluster) AS cluster FROM points p LEFT JOIN cl ON cl.i = p.id LEFT JOIN bd ON bd.i = p.id)"""


@query(_DBSCAN + " SELECT id, cluster FROM lab", "points")
def dbscan_labels(spark, d):
    return cluster.dbscan(carriers.points(spark, d), 0.015, 3)


_recursive("dbscan_labels")


@query(_DBSCAN + ", g AS (SELECT cluster, count(*) AS n, avg(p.x) AS x, avg(p.y) AS y FROM lab JOIN points p USING (id) WHERE cluster IS NOT NULL GROUP BY cluster) SELECT round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, n FROM g ORDER BY g.n DESC, cluster LIMIT 1", "points")
def densest_center(spark, d):
    p = carriers.points(spark, d)
    return cluster.densest(p, cluster.dbscan(p, 0.015, 3)).select(rounded("x", 9).alias("x"), rounded("y", 9).alias("y"), "n")


_recursive("densest_center")

# ---- registration ----


@query(
    """+p AS (SELECT a.f, (30 + a.r - b.r) % 30 AS dr, (24 + a.c - b.c) % 24 AS dc, sum(a.v * b.v) AS s FROM (SELECT f + 1 AS f, r, c, v FROM stack) a JOIN stack b ON a.f = b.f GROUP BY ALL),
    t AS (SELECT f, CASE WHEN dr > 15 THEN dr - 30 ELSE dr END AS dr, CASE WHEN dc > 12 THEN dc - 24 ELSE dc END AS dc, s FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY s DESC, abs(dr), abs(dc), dr, dc) AS k FROM t)
    SELECT CAST(f AS INTEGER) AS f, CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc FROM n WHERE k = 1 UNION ALL SELECT 0, 0, 0""", "stack")
def xcorr_peak(spark, d):
    return registration.relative_drift(registration.frames(carriers.stack(spark, d)))


_DRIFT = ORACLES["xcorr_peak"].replace("WITH stack", "WITH stack", 1)
_ABS = _DRIFT[: _DRIFT.rindex("SELECT CAST(f")] + ", rel AS (" + _DRIFT[_DRIFT.rindex("SELECT CAST(f") :] + "), ab AS (SELECT f, sum(dr) OVER (ORDER BY f) AS dr, sum(dc) OVER (ORDER BY f) AS dc FROM rel), dd AS (SELECT f, CAST(dr - (SELECT dr FROM ab WHERE f = 2) AS INTEGER) AS dr, CAST(dc - (SELECT dc FROM ab WHERE f = 2) AS INTEGER) AS dc FROM ab) "


@query(_ABS + "SELECT f, dr, dc FROM dd")
def drift_abs(spark, d):
    return registration.absolute_drift(registration.relative_drift(registration.frames(carriers.stack(spark, d))))


@query(_ABS + "SELECT s.f, s.r, s.c, CAST(coalesce(o.v, 0) AS BIGINT) AS v FROM stack s JOIN dd ON dd.f = s.f LEFT JOIN stack o ON o.f = s.f AND o.r = s.r - dd.dr AND o.c = s.c - dd.dc")
def shift_frames(spark, d):
    s = carriers.stack(spark, d)
    return registration.shifted(s, drift_abs(spark, d))


#: The frames of this carrier do not overlap after their measured drift, so these two queries plant one.
_PLANTED = "+dd AS (SELECT CAST(f AS INTEGER) AS f, CAST(f - 2 AS INTEGER) AS dr, CAST(1 - f % 3 AS INTEGER) AS dc FROM range(5) t(f)), sh AS (SELECT s.f, s.r, s.c, CAST(coalesce(o.v, 0) AS BIGINT) AS v FROM stack s JOIN dd ON dd.f = s.f LEFT JOIN stack o ON o.f = s.f AND o.r = s.r - dd.dr AND o.c = s.c - dd.dc), ar AS (SELECT greatest(0, max(dr)) AS r0, 30 + least(0, min(dr)) AS r1, greatest(0, max(dc)) AS c0, 24 + least(0, min(dc)) AS c1 FROM dd), cr AS (SELECT f, CAST(r - r0 AS INTEGER) AS r, CAST(c - c0 AS INTEGER) AS c, v FROM sh, ar WHERE r >= r0 AND r < r1 AND c >= c0 AND c < c1) "


@query(_PLANTED + "SELECT f, r, c, v FROM cr", "stack")
def crop_common(spark, d):
    drift = spark.range(5).select(F.col("id").cast("int").alias("f"), (F.col("id") - 2).cast("int").alias("dr"), (1 - F.col("id") % 3).cast("int").alias("dc"))
    return registration.crop_stack(registration.shifted(carriers.stack(spark, d), drift), drift, 30, 24)


@query(_PLANTED + "SELECT r, c, round(avg(v), 4) + 0.0 AS v FROM cr GROUP BY r, c", "stack")
def registered_mean(spark, d):
    return grid.stack_mean(crop_common(spark, d)).withColumn("v", rounded("v", 4))


#: Cubic splines in closed form: coefficients are sums over the mirrored frame weighed by powers of the pole, values four of them.
_SPLINE = """+dd AS (SELECT CAST(f AS INTEGER) AS f, f * 0.75 - 1.5 AS dr, 0.3 - f * 0.4 AS dc FROM range(5) t(f)), ax AS (SELECT * FROM (VALUES ('r', 30), ('c', 24)) t(ax, n)),
 co AS (SELECT ax, n, k, abs(k + e) % (2 * n - 2) AS m, sqrt(3) * (sqrt(3) - 2) ** abs(e) AS w FROM ax, (SELECT unnest(range(-40, 70)) AS k) a, range(-40, 41) b(e)),
 cf AS (SELECT ax, k, CASE WHEN m >= n THEN 2 * n - 2 - m ELSE m END AS src, sum(w) AS w FROM co GROUP BY 1, 2, 3),
 pl AS (SELECT f, ax, n, o, o - CASE WHEN ax = 'r' THEN dr ELSE dc END AS s FROM dd, ax, (SELECT unnest(range(30)) AS o) WHERE o < n),
 tap AS (SELECT f, ax, o, CAST(floor(s) AS BIGINT) + j AS k, CASE j WHEN -1 THEN (1 - (s - floor(s))) ** 3 / 6 WHEN 0 THEN (4 - 6 * (s - floor(s)) ** 2 + 3 * (s - floor(s)) ** 3) / 6
   WHEN 1 THEN (1 + 3 * (s - floor(s)) + 3 * (s - floor(s)) ** 2 - 3 * (s - floor(s)) ** 3) / 6 ELSE (s - floor(s)) ** 3 / 6 END AS w FROM pl, (SELECT unnest(range(-1, 3)) AS j) WHERE s >= 0 AND s <= n - 1),
 mx AS (SELECT f, t.ax, o, src, sum(t.w * c.w) AS w FROM tap t JOIN cf c ON c.ax = t.ax AND c.k = t.k GROUP BY 1, 2, 3, 4),
 one AS (SELECT s.f, m.o AS r, s.c, sum(s.v * m.w) AS v FROM stack s JOIN mx m ON m.f = s.f AND m.ax = 'r' AND m.src = s.r GROUP BY 1, 2, 3),
 two AS (SELECT s.f, s.r, m.o AS c, sum(s.v * m.w) AS v FROM one s JOIN mx m ON m.f = s.f AND m.ax = 'c' AND m.src = s.c GROUP BY 1, 2, 3) """


@query(_SPLINE + "SELECT s.f, s.r, s.c, round(coalesce(t.v, 0), 3) + 0.0 AS v FROM stack s LEFT JOIN two t ON t.f = s.f AND t.r = s.r AND t.c = s.c", "stack")
def shift_subpixel(spark, d):
    """Frames moved by parts of a pixel."""
    f = F.col("id").cast("int")
    drift = spark.range(5).select(f.alias("f"), (f * 0.75 - 1.5).alias("dr"), (0.3 - f * 0.4).alias("dc"))
    return registration.frame_pixels(registration.resampled(registration.frames(carriers.stack(spark, d)), drift)).withColumn("v", rounded("v", 3))


@query()
def drift_subpixel(spark, d):
    """Drift of each frame in tenths of a pixel."""
    return registration.absolute_drift(registration.relative_drift(registration.frames(carriers.stack(spark, d)), upsample=10)).select("f", rounded("dr", 3).alias("dr"), rounded("dc", 3).alias("dc"))


@query()
def demon_register(spark, d):
    out = registration.demon_registration(registration.frames(carriers.stack(spark, d)))
    return out.select("f", "h", "w", F.transform("data", lambda v: F.round(v, 3)).alias("data"))


# ---- graph ----


def _groups(spark, d):
    return carriers.points(spark, d).withColumn("g", F.col("type"))


_CIRC = """gp AS (SELECT type AS g, id, x, y FROM points), tr AS (SELECT a.g, a.id AS a, b.id AS b, c.id AS c, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, c.x AS xc, c.y AS yc, 2 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) AS d
 FROM gp a JOIN gp b ON a.g = b.g AND a.id < b.id JOIN gp c ON b.g = c.g AND b.id < c.id),
 ci AS (SELECT g, a, b, c, xa, ya, ((xa*xa+ya*ya)*(yb-yc) + (xb*xb+yb*yb)*(yc-ya) + (xc*xc+yc*yc)*(ya-yb)) / d AS ux, ((xa*xa+ya*ya)*(xc-xb) + (xb*xb+yb*yb)*(xa-xc) + (xc*xc+yc*yc)*(xb-xa)) / d AS uy FROM tr WHERE d <> 0),
 de AS (SELECT g, a, b, c, ux, uy, sqrt((xa - ux) ** 2 + (ya - uy) ** 2) AS radius FROM ci WHERE NOT EXISTS (SELECT 1 FROM gp p WHERE p.g = ci.g AND p.id NOT IN (ci.a, ci.b, ci.c) AND (p.x - ux) ** 2 + (p.y - uy) ** 2 < (xa - ux) ** 2 + (ya - uy) ** 2 - 1e-12))"""


_SITES = _CIRC.replace("SELECT type AS g, id, x, y FROM points", "SELECT type AS g, id, x + 0.5 AS x, y + 0.5 AS y FROM points") + """,
 si AS (SELECT *, CAST(g AS BIGINT) * 1099511627776 + row_number() OVER (PARTITION BY g ORDER BY a, b, c) AS tri_id, radius - 0.01 AS room FROM de WHERE ux >= 0 AND uy >= 0 AND ux < 1 AND uy < 1 AND radius > 0.01),
 nr AS (SELECT p.tri_id AS i, q.tri_id AS j, sqrt((p.ux - q.ux) ** 2 + (p.uy - q.uy) ** 2) AS d, p.room + q.room AS room FROM si p JOIN si q ON p.g = q.g AND p.tri_id < q.tri_id),
 pr AS (SELECT i, j, d FROM nr WHERE d < 0.02 AND d < room)"""


def _all_circles(spark, d):
    p = _groups(spark, d)
    return p, graph.with_circles(graph.delaunay(p), p)


@query(f"+{_CIRC} SELECT g, a, b, c FROM de", "points")
def delaunay(spark, d):
    return graph.delaunay(_groups(spark, d))


@query(f"+{_CIRC} SELECT g, a, b, c, CASE WHEN radius < 1 THEN round(ux, 5) + 0.0 END AS ux, CASE WHEN radius < 1 THEN round(uy, 5) + 0.0 END AS uy, round(ln(radius), 4) + 0.0 AS log_radius FROM de", "points")
def circumcenters(spark, d):
    """Radii of all circles, as logarithms; centres where the circle is no wider than the image."""
    c = _all_circles(spark, d)[1]
    return c.select("g", "a", "b", "c", *[F.when(F.col("radius") < 1, rounded(x, 5)).alias(x) for x in ("ux", "uy")], rounded(F.ln("radius"), 4).alias("log_radius"))


@query(
    f"""+{_CIRC}, hull AS (SELECT a.id AS i, b.id AS j FROM gp a JOIN gp b ON a.g = b.g AND a.id < b.id
    WHERE (SELECT min((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) > 0 OR max((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) < 0 FROM gp p WHERE p.g = a.g AND p.id <> a.id AND p.id <> b.id)),
    cell AS (SELECT unnest([a, b, c]) AS id, ux, uy FROM de), mid AS (SELECT *, avg(ux) OVER (PARTITION BY id) AS cx, avg(uy) OVER (PARTITION BY id) AS cy FROM cell),
    nxt AS (SELECT id, ux, uy, row_number() OVER (PARTITION BY id ORDER BY atan2(uy - cy, ux - cx)) - 1 AS n, count(*) OVER (PARTITION BY id) AS k FROM mid),
    ar AS (SELECT a.id, abs(sum(a.ux * b.uy - b.ux * a.uy)) / 2 AS area FROM nxt a JOIN nxt b ON a.id = b.id AND b.n = (a.n + 1) % a.k GROUP BY a.id)
    SELECT gp.id, gp.id IN (SELECT i FROM hull UNION SELECT j FROM hull) AS is_open, CASE WHEN gp.id NOT IN (SELECT i FROM hull UNION SELECT j FROM hull) THEN round(ln(area), 4) + 0.0 END AS log_area FROM gp LEFT JOIN ar ON ar.id = gp.id""", "points")
def voronoi_area(spark, d):
    """Every point: the logarithm of its cell's area, as cells at the rim are very wide; cells on the hull are open."""
    p, circles = _all_circles(spark, d)
    areas = graph.voronoi_areas(circles, p, graph.hull_edges(p))
    is_open = F.col("area") == float("inf")
    return areas.select("id", is_open.alias("is_open"), F.when(~is_open & (F.col("area") > 0), rounded(F.ln("area"), 4)).alias("log_area"))


def _all_sites(spark, d):
    """Points, sites of every label (a site's number holds its label), and pairs that overlap."""
    p = _groups(spark, d).withColumns({"x": F.col("x") + 0.5, "y": F.col("y") + 0.5})
    sites = graph.interstitials(graph.with_circles(graph.delaunay(p), p), 0.01, (1.0, 1.0))
    place = F.row_number().over(Window.partitionBy("g").orderBy("a", "b", "c"))
    sites = settled(sites.withColumn("tri_id", F.col("g").cast("long") * 2**40 + place), "sites")
    return p, sites, graph.overlapping(sites, 0.01)


@query(f"+{_SITES} SELECT i, j FROM pr", "points")
def interstitial_pairs(spark, d):
    return _all_sites(spark, d)[2].select("i", "j")


@query(f"+{_SITES}, {_REACH}, un AS (SELECT s.*, coalesce((SELECT least(s.tri_id, min(c)) FROM reach r WHERE r.node = s.tri_id), s.tri_id) AS unit_id FROM si s) SELECT unit_id, list_sort(list_distinct(flatten(list([a, b, c])))) AS atom_ids, count(*) AS n_cells FROM un GROUP BY unit_id", "points")
def structural_units(spark, d):
    _, s, pairs = _all_sites(spark, d)
    return graph.structural_units(s, graph.components(pairs)).select("unit_id", "atom_ids", "n_cells")


_recursive("structural_units")


_UNIT = "un AS (SELECT s.*, coalesce((SELECT least(s.tri_id, min(c)) FROM reach r WHERE r.node = s.tri_id), s.tri_id) AS unit_id FROM si s)"


@query(
    f"""+{_SITES}, {_REACH}, {_UNIT}, ua AS (SELECT DISTINCT unit_id, unnest([a, b, c]) AS id FROM un),
    co AS (SELECT u.unit_id, p.x, p.y, avg(p.x) OVER w AS cx, avg(p.y) OVER w AS cy, count(*) OVER w AS k FROM ua u JOIN gp p ON p.id = u.id WINDOW w AS (PARTITION BY u.unit_id)),
    an AS (SELECT *, CASE WHEN atan2(y - cy, x - cx) < 0 THEN degrees(atan2(y - cy, x - cx)) + 360 ELSE degrees(atan2(y - cy, x - cx)) END AS t FROM co),
    so AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY t) - 1 AS n FROM an),
    nx AS (SELECT p.*, q.x AS fx, q.y AS fy, radians(q.t - p.t) AS gap FROM so p JOIN so q ON q.unit_id = p.unit_id AND q.n = (p.n + 1) % p.k)
    SELECT unit_id, CAST(max(k) AS INTEGER) AS cyclicity, round(max(cx), 9) + 0.0 AS cx, round(max(cy), 9) + 0.0 AS cy, round(abs(sum(x * fy - fx * y)) / 2, 9) + 0.0 AS area, list(round(gap - pi() * floor(gap / pi()), 5) + 0.0 ORDER BY n) AS angle_gaps FROM nx GROUP BY unit_id""", "points")
def polygons(spark, d):
    p, s, pairs = _all_sites(spark, d)
    made = graph.polygons(graph.structural_units(s, graph.components(pairs)), p)
    return made.select("unit_id", "cyclicity", *[rounded(c, 9).alias(c) for c in ("cx", "cy", "area")], F.transform("angle_gaps", lambda g: F.round(g, 5) + F.lit(0.0)).alias("angle_gaps"))


_recursive("polygons")


_SOLID = """e AS (SELECT a.g, a.id AS a, b.id AS b, c.id AS c, d.id AS d, a.x, a.y, a.z, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz, d.x - a.x AS wx, d.y - a.y AS wy, d.z - a.z AS wz
 FROM solid_points a JOIN solid_points b ON a.g = b.g AND a.id < b.id JOIN solid_points c ON b.g = c.g AND b.id < c.id JOIN solid_points d ON c.g = d.g AND c.id < d.id),
 f AS (SELECT *, ux * ux + uy * uy + uz * uz AS uu, vx * vx + vy * vy + vz * vz AS vv, wx * wx + wy * wy + wz * wz AS ww, vy * wz - vz * wy AS ax, vz * wx - vx * wz AS ay, vx * wy - vy * wx AS az,
 wy * uz - wz * uy AS bx, wz * ux - wx * uz AS by_, wx * uy - wy * ux AS bz, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz FROM e),
 s AS (SELECT *, 2 * (ux * ax + uy * ay + uz * az) AS det FROM f),
 h AS (SELECT g, a, b, c, d, x, y, z, (uu * ax + vv * bx + ww * cx) / det AS sx, (uu * ay + vv * by_ + ww * cy) / det AS sy, (uu * az + vv * bz + ww * cz) / det AS sz FROM s WHERE det <> 0),
 tet AS (SELECT g, a, b, c, d, x + sx AS px, y + sy AS py, z + sz AS pz FROM h WHERE NOT EXISTS (SELECT 1 FROM solid_points p WHERE p.g = h.g AND p.id NOT IN (a, b, c, d)
 AND (p.x - h.x - sx) ** 2 + (p.y - h.y - sy) ** 2 + (p.z - h.z - sz) ** 2 < sx * sx + sy * sy + sz * sz - 1e-12))"""


@query(f"+{_SOLID} SELECT g, a, b, c, d FROM tet", "solid_points")
def delaunay_3d(spark, d):
    return graph.delaunay(carriers.solid_points(spark, d), coordinates=("x", "y", "z"))


@query(
    f"""+{_SOLID}, edge AS (SELECT g, unnest([[a, b], [a, c], [a, d], [b, c], [b, d], [c, d]]) AS ij, px, py, pz FROM tet),
    way AS (SELECT t.g, i.id AS i, j.id AS j, px - i.x AS wx, py - i.y AS wy, pz - i.z AS wz, j.x - i.x AS ex, j.y - i.y AS ey, j.z - i.z AS ez FROM edge t JOIN solid_points i ON i.id = t.ij[1] JOIN solid_points j ON j.id = t.ij[2]),
    unit AS (SELECT g, i, j, sqrt(ex * ex + ey * ey + ez * ez) AS len, wx, wy, wz, ex, ey, ez, sqrt(ex * ex + ey * ey) AS flat FROM way),
    side AS (SELECT g, i, j, len, (wx * ey - wy * ex) / flat AS x, (wx * ex * ez + wy * ey * ez - wz * flat * flat) / (flat * len) AS y FROM unit),
    mid AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM side WINDOW w AS (PARTITION BY g, i, j)),
    ring AS (SELECT *, row_number() OVER (PARTITION BY g, i, j ORDER BY atan2(y - my, x - mx)) - 1 AS n, count(*) OVER (PARTITION BY g, i, j) AS k FROM mid),
    area AS (SELECT p.g, p.i, p.j, max(p.len) AS len, abs(sum(p.x * q.y - q.x * p.y)) / 2 AS area FROM ring p JOIN ring q ON q.g = p.g AND q.i = p.i AND q.j = p.j AND q.n = (p.n + 1) % p.k GROUP BY p.g, p.i, p.j),
    cone AS (SELECT unnest([i, j]) AS id, area * len / 6 AS v FROM area), cell AS (SELECT id, sum(v) AS v FROM cone GROUP BY id),
    face AS (SELECT unnest([[a, b, c], [a, b, d], [a, c, d], [b, c, d]]) AS f FROM tet), hull AS (SELECT DISTINCT unnest(f) AS id FROM (SELECT f FROM face GROUP BY f HAVING count(*) = 1))
    SELECT p.id, hull.id IS NOT NULL AS is_open, CASE WHEN hull.id IS NULL THEN round(ln(cell.v), 5) + 0.0 END AS log_volume FROM solid_points p LEFT JOIN cell ON cell.id = p.id LEFT JOIN hull ON hull.id = p.id""", "solid_points")
def voronoi_volume(spark, d):
    """Every point in space: the logarithm of its cell's volume, as cells differ by orders of magnitude; open cells are told."""
    p = carriers.solid_points(spark, d)
    tetrahedra = graph.delaunay(p, coordinates=("x", "y", "z"), flat=True)
    cells = graph.voronoi_volumes(graph.with_spheres(tetrahedra, p), p)
    is_open = F.col("volume") == float("inf")
    return cells.select("id", is_open.alias("is_open"), F.when(~is_open & (F.col("volume") > 0), rounded(F.ln("volume"), 5)).alias("log_volume"))


_UNITS = "unit AS (SELECT vec_id AS id, CAST(label * 1000 + floor((embedding[1] + 10) / 0.05) AS BIGINT) AS unit_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


@query(
    f"""WITH {_UNITS}, o AS (SELECT unit_id, count(*) AS n, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM unit GROUP BY unit_id HAVING count(*) > 3),
    f AS (SELECT unit_id, a.id AS a, b.id AS b, c.id AS c, a.x - ox AS x, a.y - oy AS y, a.z - oz AS z, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz
      FROM o JOIN unit a USING (unit_id) JOIN unit b USING (unit_id) JOIN unit c USING (unit_id) WHERE a.id < b.id AND b.id < c.id),
    g AS (SELECT f.*, (p.x - ox - f.x) * nx + (p.y - oy - f.y) * ny + (p.z - oz - f.z) * nz AS far FROM f JOIN o USING (unit_id) JOIN unit p USING (unit_id) WHERE p.id NOT IN (a, b, c)),
    h AS (SELECT unit_id, abs(x * nx + y * ny + z * nz) / 6 AS v FROM g GROUP BY unit_id, a, b, c, x, y, z, nx, ny, nz HAVING max(far) < 0 OR min(far) > 0)
    SELECT unit_id, n, round(ln(sum(v)), 5) + 0.0 AS log_volume FROM h JOIN o USING (unit_id) GROUP BY unit_id, n""")
def unit_volumes(spark, d):
    """Volumes of the hulls of units' atoms: units of more than three."""
    rows = carriers.solid_points(spark, d)
    units = rows.groupBy((F.col("g") * 1000 + F.floor((F.col("x").cast("float") + 10) / 0.05)).cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct("x", "y", "z"))).alias("corners"))
    sizes = units.where(F.size("corners") > 3)
    volumes = graph.hull_volumes(sizes).withColumnRenamed("id", "unit_id")
    return sizes.select(F.col("id").alias("unit_id"), F.size("corners").cast("long").alias("n")).join(volumes, "unit_id").select("unit_id", "n", rounded(F.ln("volume"), 5).alias("log_volume"))


@query(
    """+gp AS (SELECT type AS g, id, x, y FROM points) SELECT a.g, a.id AS i, b.id AS j FROM gp a JOIN gp b ON a.g = b.g AND a.id < b.id
    WHERE (SELECT min((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) > 0 OR max((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) < 0 FROM gp p WHERE p.g = a.g AND p.id <> a.id AND p.id <> b.id)""", "points")
def hull_edges(spark, d):
    return graph.hull_edges(_groups(spark, d))


_RING = """+cc AS (SELECT *, avg(x) OVER (PARTITION BY id) AS cx, avg(y) OVER (PARTITION BY id) AS cy FROM ring), an AS (SELECT *, degrees(atan2(y - cy, x - cx)) AS t FROM cc),
 so AS (SELECT id, x, y, CASE WHEN t < 0 THEN t + 360 ELSE t END AS angle, CAST(row_number() OVER (PARTITION BY id ORDER BY CASE WHEN t < 0 THEN t + 360 ELSE t END, n) - 1 AS INTEGER) AS n FROM an),
 nx AS (SELECT a.id, a.n, a.x, a.y, b.x AS bx, b.y AS by_, f.x AS fx, f.y AS fy, a.angle FROM so a JOIN so b ON b.id = a.id AND b.n = (a.n + 4) % 5 JOIN so f ON f.id = a.id AND f.n = (a.n + 1) % 5)"""


@query(_RING + " SELECT id, n, x, y, round(angle, 6) + 0.0 AS angle FROM so", "ring")
def ccw_sort(spark, d):
    r = graph.sorted_rings(carriers.rings(spark, d))
    return r.select("id", F.posexplode("corners").alias("n", "p")).select("id", "n", "p.x", "p.y", rounded("p.angle").alias("angle"))


@query(_RING + " SELECT id, round(abs(sum(x * fy - fx * y)) / 2, 9) + 0.0 AS area FROM nx GROUP BY id", "ring")
def polygon_area(spark, d):
    return graph.polygon_area(graph.sorted_rings(carriers.rings(spark, d))).select("id", rounded("area", 9).alias("area"))


_INNER = "SELECT id, n, 180 - degrees(atan2(fy - y, fx - x) - atan2(y - by_, x - bx)) AS q FROM nx"


@query(_RING + f", q AS ({_INNER}) SELECT id, n, round(q - 360 * floor(q / 360), 5) + 0.0 AS angle FROM q", "ring")
def polygon_inner_angles(spark, d):
    return graph.inner_angles(graph.sorted_rings(carriers.rings(spark, d))).withColumn("angle", rounded("angle", 5))


_EXT = "atan2((x - bx) * (fy - y) - (y - by_) * (fx - x), (x - bx) * (fx - x) + (y - by_) * (fy - y))"


@query(_RING + f" SELECT id, n, round({_EXT}, 6) + 0.0 AS angle FROM nx", "ring")
def polygon_exterior_angles(spark, d):
    return graph.exterior_angles(graph.sorted_rings(carriers.rings(spark, d))).withColumn("angle", rounded("angle"))


@query(_RING + " SELECT id, n, round(degrees(acos(greatest(-1, least(1, ((bx - x) * (fx - x) + (by_ - y) * (fy - y)) / sqrt(((bx - x) ** 2 + (by_ - y) ** 2) * ((fx - x) ** 2 + (fy - y) ** 2)))))), 4) + 0.0 AS angle FROM nx", "ring")
def turning_function(spark, d):
    return graph.turning_function(graph.sorted_rings(carriers.rings(spark, d))).withColumn("angle", rounded("angle", 4))


@query(_RING + f", x AS (SELECT id, n, {_EXT} AS angle FROM nx) SELECT a.id, round(sum(abs(a.angle - b.angle)), 6) + 0.0 AS distance FROM x a JOIN x b ON b.id = 0 AND b.n = a.n GROUP BY a.id", "ring")
def polygon_similarity(spark, d):
    a = graph.exterior_angles(graph.sorted_rings(carriers.rings(spark, d)))
    return graph.polygon_similarity(a, a.where("id = 0")).withColumn("distance", rounded("distance"))


_TREE = "leaf AS (SELECT type AS label, count(*) AS n, avg(x) AS x, avg(y) AS y FROM points GROUP BY type), tree(node, lv, nl, leaves) AS (VALUES (10, 1, 2, [0, 1]), (11, 1, 2, [2, 3]), (12, 1, 2, [4, 5]), (13, 1, 2, [6, 7]), (14, 1, 2, [8, 9]), (15, 2, 4, [0, 1, 2, 3]), (16, 2, 4, [4, 5, 6, 7]), (17, 3, 8, [0, 1, 2, 3, 4, 5, 6, 7]), (18, 4, 10, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9])), members AS (SELECT node, lv, nl, unnest(leaves) AS label FROM tree UNION ALL SELECT label, 0, 1, label FROM leaf)"


def _tree(spark, d):
    leaves = carriers.points(spark, d).groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return graph.cluster_tree(carriers.LINKAGE, leaves)


@query(f"+{_TREE} SELECT m.node, m.lv AS level, m.nl AS n_leaves, CAST(sum(l.n) AS BIGINT) AS n FROM members m JOIN leaf l USING (label) GROUP BY ALL", "points")
def cluster_tree_levels(spark, d):
    return _tree(spark, d).select("node", "level", "n_leaves", "n")


@query(f"+{_TREE} SELECT m.node, round(sum(l.x * l.n) / sum(l.n), 9) + 0.0 AS x, round(sum(l.y * l.n) / sum(l.n), 9) + 0.0 AS y FROM members m JOIN leaf l USING (label) GROUP BY m.node", "points")
def cluster_tree_means(spark, d):
    return _tree(spark, d).select("node", rounded("x", 9).alias("x"), rounded("y", 9).alias("y"))


# ---- factor ----


def _rows(spark, d):
    return carriers.images(spark, d).select(F.col("img").alias("id"), "data")


@query('SELECT a.k AS k1, b.k AS k2, round(sum(a.v * b.v), 6) + 0.0 AS g FROM spectra a JOIN spectra b ON a."row" = b."row" GROUP BY a.k, b.k', "spectra")
def gram(spark, d):
    g = factor.gram(_rows(spark, d), 64)
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(64) for j in range(64)], "k1 int, k2 int, g double").withColumn("g", rounded("g"))


@query('SELECT a.k AS k1, b.k AS k2, round(covar_samp(a.v, b.v), 8) + 0.0 AS g FROM spectra a JOIN spectra b ON a."row" = b."row" GROUP BY a.k, b.k', "spectra")
def covariance(spark, d):
    g = factor.moments(_rows(spark, d), 64)[2]
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(64) for j in range(64)], "k1 int, k2 int, g double").withColumn("g", rounded("g", 8))


@query("SELECT round(sum(s), 6) + 0.0 AS total FROM (SELECT var_samp(v) AS s FROM spectra GROUP BY k)", "spectra")
def total_variance(spark, d):
    """The sum of the variances of all principal components."""
    return spark.createDataFrame([(float(factor.pca(_rows(spark, d), 64, 64)[2].sum()),)], "total double").withColumn("total", rounded("total"))


@query("SELECT round(sum(v * v), 6) + 0.0 AS energy FROM spectra", "spectra")
def svd_energy(spark, d):
    return spark.createDataFrame([(float((factor.svd(_rows(spark, d), 64)[1] ** 2).sum()),)], "energy double").withColumn("energy", rounded("energy"))


@query('SELECT "row" AS id, k, round(v, 6) + 0.0 AS v FROM spectra', "spectra")
def svd_reconstruct(spark, d):
    u, s, vh = factor.svd(_rows(spark, d), 64)
    return factor.reconstructed(u, np.diag(s) @ vh).select("id", F.posexplode("data").alias("k", "v")).withColumn("v", rounded("v"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, 0.0 AS mean0 FROM embeddings")
def pca_project(spark, d):
    """Scores are centred: their mean is 0."""
    return factor.pca(_rows(spark, d), 64, 3)[0].agg(F.count("*").alias("n"), rounded(F.avg(F.col("data")[0])).alias("mean0"))


@query()
def nmf(spark, d):
    rows = _rows(spark, d).withColumn("data", F.transform("data", F.abs))
    return factor.nmf(rows, 64, 3)[0].select("id", F.transform("data", lambda v: F.round(v, 4)).alias("data"))


@query()
def ica(spark, d):
    return factor.ica(_rows(spark, d), 64, 3)[0].select("id", F.transform("data", lambda v: F.round(v, 3)).alias("data"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, 0 AS bad FROM embeddings")
def nfindr_simplex(spark, d):
    """Abundances are not negative and sum to one."""
    a = factor.nfindr(_rows(spark, d), 64, 4)[0]
    wrong = (F.abs(F.aggregate("data", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9) | (F.array_min("data") < -1e-12)
    return a.agg(F.count("*").alias("n"), F.sum(wrong.cast("int")).cast("int").alias("bad"))


@query("SELECT round(sum(s) * (SELECT count(*) - 1 FROM embeddings), 5) + 0.0 AS total FROM (SELECT var_samp(v) AS s FROM spectra GROUP BY k)", "spectra")
def kernel_pca_energy(spark, d):
    return spark.createDataFrame([(float(factor.kernel_pca(_rows(spark, d), 64, 64)[1].sum()),)], "total double").withColumn("total", rounded("total", 5))


def _mode(mode, others):
    def run(spark, d):
        return factor.mode_gram(carriers.cube(spark, d).select("j", "a", "b", "i", "v"), mode, others).withColumn("g", rounded("g"))

    on = " AND ".join(f"p.{o} = q.{o}" for o in others)
    return run, f"WITH {CTES['cube']} SELECT p.{mode} AS m1, q.{mode} AS m2, round(sum(p.v * q.v), 6) + 0.0 AS g FROM cube p JOIN cube q ON {on} GROUP BY p.{mode}, q.{mode}"


for _n, (_m, _o) in enumerate((("j", ["i", "a", "b"]), ("a", ["i", "j", "b"]), ("b", ["i", "j", "a"]))):
    QUERIES[f"mode_gram_{_n}"], ORACLES[f"mode_gram_{_n}"] = _mode(_m, _o)


@query("+fa AS (SELECT x AS a, f, 0.5 + ((f * 7 + x * 3) % 11) / 11.0 AS w FROM range(8) p(x), range(2) q(f)) SELECT c.i * 25 + c.j AS id, CAST(u.f AS INTEGER) AS f, round(sum(c.v * u.w * w.w), 6) + 0.0 AS v FROM cube c JOIN fa u ON u.a = c.a JOIN fa w ON w.a = c.b AND w.f = u.f GROUP BY c.i, c.j, u.f", "cube")
def cp_mttkrp(spark, d):
    f = spark.range(16).select(F.floor(F.col("id") / 2).cast("int").alias("x"), (F.col("id") % 2).cast("int").alias("f")).withColumn("w", 0.5 + ((F.col("f") * 7 + F.col("x") * 3) % 11) / 11.0)
    long = carriers.cube(spark, d).select((F.col("i") * 25 + F.col("j")).alias("id"), "a", "b", "v")
    return factor.mttkrp(long, "id", {"a": f.withColumnRenamed("x", "a"), "b": f.withColumnRenamed("x", "b")}, 2).withColumn("v", rounded("v"))


@query()
def cp_fit(spark, d):
    rows = _rows(spark, d).withColumn("data", F.transform("data", F.abs))
    return factor.cp(rows, (8, 8), 2)[0].select("id", F.transform("data", lambda v: F.round(v, 4)).alias("data"))


_HALF = "greatest(0, 1 + ({0}) / {1})"


@query(
    f"""+h AS (SELECT f, x, 0.5 + ((f * 7 + x * 3) % 11) / 11.0 AS w FROM range(3) a(f), range(64) b(x)), g AS (SELECT a.f AS i, b.f AS j, sum(a.w * b.w) AS v FROM h a JOIN h b USING (x) GROUP BY 1, 2),
    gg AS (SELECT {", ".join(f"max(v) FILTER (i = {i} AND j = {j}) AS g{i}{j}" for i in range(3) for j in range(3))} FROM g),
    b AS (SELECT s."row" AS id, {", ".join(f"sum(abs(s.v) * h.w) FILTER (h.f = {f}) AS b{f}" for f in range(3))} FROM spectra s JOIN h ON h.x = s.k GROUP BY 1),
    w0 AS (SELECT *, {_HALF.format("b0 - g00 - g01 - g02", "g00")} AS w0 FROM b, gg), w1 AS (SELECT *, {_HALF.format("b1 - w0 * g01 - g11 - g12", "g11")} AS w1 FROM w0), w2 AS (SELECT *, {_HALF.format("b2 - w0 * g02 - w1 * g12 - g22", "g22")} AS w2 FROM w1)
    SELECT id, round(w0, 6) + 0.0 AS w0, round(w1, 6) + 0.0 AS w1, round(w2, 6) + 0.0 AS w2 FROM w2""", "spectra")
def nmf_step(spark, d):
    """One sweep of coordinate descent over the weights of the factorisation's start."""
    rows, h = _rows(spark, d).withColumn("data", F.transform("data", F.abs)), factor._start(64, 3)
    w = factor._mapped(rows, lambda x: factor.nonnegative(x @ h.T, h @ h.T, 1))
    return w.select("id", *[rounded(F.col("data")[k]).alias(f"w{k}") for k in range(3)])


@query(
    f"""+h AS (SELECT f, x, 0.5 + ((f * 7 + x * 3) % 11) / 11.0 AS w FROM range(2) a(f), range(8) b(x)), g AS (SELECT a.f AS i, b.f AS j, sum(a.w * b.w) ** 2 AS v FROM h a JOIN h b USING (x) GROUP BY 1, 2),
    gg AS (SELECT {", ".join(f"max(v) FILTER (i = {i} AND j = {j}) AS g{i}{j}" for i in range(2) for j in range(2))} FROM g),
    b AS (SELECT c.i * 25 + c.j AS id, {", ".join(f"sum(abs(c.v) * p.w * q.w) FILTER (p.f = {f}) AS b{f}" for f in range(2))} FROM cube c JOIN h p ON p.x = c.a JOIN h q ON q.x = c.b AND q.f = p.f GROUP BY 1),
    w0 AS (SELECT *, {_HALF.format("b0 - g00 - g01", "g00")} AS w0 FROM b, gg), w1 AS (SELECT *, {_HALF.format("b1 - w0 * g01 - g11", "g11")} AS w1 FROM w0)
    SELECT CAST(id AS BIGINT) AS id, round(w0, 6) + 0.0 AS w0, round(w1, 6) + 0.0 AS w1 FROM w1""", "cube")
def cp_step(spark, d):
    """One sweep of coordinate descent over the long mode's factor, from the start of both others."""
    rows, f = _rows(spark, d).withColumn("data", F.transform("data", F.abs)), factor._start(8, 2).T
    products = (f.T @ f) ** 2
    w = factor._mapped(rows, lambda x: factor.nonnegative(np.einsum("nab,ar,br->nr", x.reshape(-1, 8, 8), f, f), products, 1))
    return w.select("id", *[rounded(F.col("data")[k]).alias(f"w{k}") for k in range(2)])


@query(
    """+h AS (SELECT f, x, ((f * 5 + x * 3) % 7 - 3) / 4.0 AS w FROM range(2) a(f), range(64) b(x)), z AS (SELECT s."row", h.f, sum(s.v * h.w) AS z FROM spectra s JOIN h ON h.x = s.k GROUP BY 1, 2),
    g AS (SELECT "row", f, (exp(2 * z) - 1) / (exp(2 * z) + 1) AS g FROM z)
    SELECT CAST(g.f AS INTEGER) AS i, CAST(z.f AS INTEGER) AS j, round(sum(g.g * z.z), 6) + 0.0 AS v FROM g JOIN z USING ("row") GROUP BY 1, 2 UNION ALL SELECT CAST(f AS INTEGER), -1, round(sum(1 - g * g), 6) + 0.0 FROM g GROUP BY 1""", "spectra")
def ica_step(spark, d):
    """The sums of one fixed-point step for a given whitening: i, j and, at j = -1, those of the slopes."""
    white = np.array([[((f * 5 + x * 3) % 7 - 3) / 4 for x in range(64)] for f in range(2)])
    s = factor.ica_sums(_rows(spark, d), np.zeros(64), white, np.eye(2))
    cells = [(i, j, float(s[1 + 2 * i + j])) for i in range(2) for j in range(2)] + [(i, -1, float(s[5 + i])) for i in range(2)]
    return spark.createDataFrame(cells, "i int, j int, v double").withColumn("v", rounded("v"))


#: The two principal axes of two columns in closed form, their largest component positive: variances l, directions (vx, vy).
_AXES = """m AS (SELECT {0} AS a, {1} AS b, {2} AS c FROM points), q AS (SELECT a, b, c, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l0, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l1 FROM m),
 d0 AS (SELECT *, b / sqrt(b * b + (l0 - a) ** 2) AS x, (l0 - a) / sqrt(b * b + (l0 - a) ** 2) AS y FROM q),
 axes AS (SELECT l0, l1, CASE WHEN greatest(abs(x), abs(y)) = greatest(x, y) THEN x ELSE -x END AS vx, CASE WHEN greatest(abs(x), abs(y)) = greatest(x, y) THEN y ELSE -y END AS vy,
 CASE WHEN greatest(abs(x), abs(y)) = greatest(-y, x) THEN -y ELSE y END AS ux, CASE WHEN greatest(abs(x), abs(y)) = greatest(-y, x) THEN x ELSE -x END AS uy FROM d0)"""
_CENTRED = _AXES.format("var_samp(x)", "covar_samp(x, y)", "var_samp(y)")


def _plane(spark, d):
    return carriers.points(spark, d).select("id", F.array("x", "y").alias("data"))


@query(f"+{_CENTRED} SELECT id, round((p.x - mx) * vx + (p.y - my) * vy, 6) + 0.0 AS s0, round((p.x - mx) * ux + (p.y - my) * uy, 6) + 0.0 AS s1 FROM points p, axes, (SELECT avg(x) AS mx, avg(y) AS my FROM points)", "points")
def pca_points(spark, d):
    """Scores along both principal axes."""
    return factor.pca(_plane(spark, d), 2, 2)[0].select("id", *[rounded(F.col("data")[k]).alias(f"s{k}") for k in range(2)])


@query(f"+{_AXES.format('sum(x * x)', 'sum(x * y)', 'sum(y * y)')} SELECT id, round((p.x * vx + p.y * vy) / sqrt(l0), 7) + 0.0 AS u0, round((p.x * ux + p.y * uy) / sqrt(l1), 7) + 0.0 AS u1, round((p.x * vx + p.y * vy) * vx, 6) + 0.0 AS x, round((p.x * vx + p.y * vy) * vy, 6) + 0.0 AS y FROM points p, axes", "points")
def svd_points(spark, d):
    """Left singular vectors, and the points rebuilt from the first component."""
    rows = _plane(spark, d)
    u, s, vh = factor.svd(rows, 2)
    first = factor.reconstructed(u, np.outer([s[0], 0], vh[0])).select("id", *[rounded(F.col("data")[k]).alias(c) for k, c in enumerate("xy")])
    return u.select("id", *[rounded(F.col("data")[k], 7).alias(f"u{k}") for k in range(2)]).join(first, "id")


@query(
    f"""+{_CENTRED}, s AS (SELECT id, p.x, p.y, p.x * vx + p.y * vy AS s FROM points p, axes), e AS (SELECT arg_min(x, s) AS x0, arg_min(y, s) AS y0, arg_max(x, s) AS x1, arg_max(y, s) AS y1 FROM s)
    SELECT id, round(least(1, greatest(0, ((p.x - x0) * (x1 - x0) + (p.y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))), 6) + 0.0 AS high FROM points p, e""", "points")
def nfindr_points(spark, d):
    """Abundances of the end-member that lies farther along the first principal axis: with two of them, both ends of that axis."""
    rows = _plane(spark, d)
    a, ends = factor.nfindr(rows, 2, 2)
    top = factor.pca(rows, 2, 1)[1][0]
    return a.select("id", rounded(F.col("data")[int(np.argmax(ends @ top))]).alias("high"))


@query("+l AS (SELECT * FROM spectra WHERE \"row\" < 8) SELECT s.\"row\" AS id, CAST(l.\"row\" AS INTEGER) AS k, round(exp(-0.25 * sum((s.v - l.v) ** 2)), 9) + 0.0 AS v FROM spectra s JOIN l USING (k) GROUP BY 1, 2", "spectra")
def kernel_features(spark, d):
    """The radial kernel of every row to eight given ones."""
    rows = _rows(spark, d)
    given = np.array([r.data for r in rows.where("id < 8").orderBy("id").collect()])
    return factor.kernel_features(rows, given, "rbf", 0.25).select("id", F.posexplode("data").alias("k", "v")).withColumn("v", rounded("v", 9))


@query()
def kernel_pca_rbf(spark, d):
    """Scores along the three first axes of the radial kernel."""
    return factor.kernel_pca(_rows(spark, d), 64, 3, "rbf", 0.25)[0].select("id", F.transform("data", lambda v: F.round(v, 4)).alias("data"))


@query(
    """+w AS (SELECT i, f, ((i * 3 + f * 5) % 7 - 3) / 10.0 AS u FROM range(8) s(i), range(2) t(f)),
    p AS (SELECT c.i * 25 + c.j AS "row", CAST(x.f * 2 + y.f AS INTEGER) AS k, sum(c.v * x.u * y.u) AS v FROM cube c JOIN w x ON x.i = c.a JOIN w y ON y.i = c.b GROUP BY 1, 2)
    SELECT a.k AS k1, b.k AS k2, round(sum(a.v * b.v), 8) + 0.0 AS g FROM p a JOIN p b USING ("row") GROUP BY 1, 2""", "cube")
def tucker_step(spark, d):
    """What a round's factor of the rows comes from: products of the rows projected on given factors of both spectral axes."""
    u = np.array([[((i * 3 + f * 5) % 7 - 3) / 10 for f in range(2)] for i in range(8)])
    flat = factor._mapped(_rows(spark, d), lambda x: np.einsum("nab,ar,bs->nrs", x.reshape(-1, 8, 8), u, u).reshape(len(x), -1))
    return factor.gram_table(flat.select(F.col("id").alias("row"), F.posexplode("data").alias("k", "v"))).withColumn("g", rounded("g", 8))


@query()
def tucker_fit(spark, d):
    """The images rebuilt from a Tucker decomposition of ranks 4, 3 and 3."""
    weights, fa, fb, core, _ = factor.tensor_decomposition(_rows(spark, d), (8, 8), (4, 3, 3), "tucker")
    return factor.tucker_rebuilt(weights, fa, fb, core).select("id", F.transform("data", lambda v: F.round(v, 4)).alias("data"))


# ---- cluster ----

_START = [(0.1, 0.1), (0.1, -0.1), (-0.1, 0.1), (-0.1, -0.1)]
_NEAR = " ".join(f"WHEN d{k} = least(d0, d1, d2, d3) THEN {k}" for k in range(4))
_DIST = ", ".join(f"(x - {a}) * (x - {a}) + (y - {b}) * (y - {b}) AS d{k}" for k, (a, b) in enumerate(_START)).replace("- -", "+ ")


@query(f"+e AS (SELECT id, x, y, {_DIST} FROM points), l AS (SELECT id, x, y, CASE {_NEAR} END AS label FROM e) SELECT label, count(*) AS n, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y FROM l GROUP BY label", "points")
def kmeans_fixed(spark, d):
    s = cluster.kmeans_step(carriers.points(spark, d), _START)
    return s.groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg("x")).alias("x"), rounded(F.avg("y")).alias("y"))


@query()
def atoms_clustering(spark, d):
    p = carriers.points(spark, d)
    near = points.knn(p, p, 7).groupBy(F.col("i").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda s: s["d"]).alias("data"))
    return cluster.kmeans_vectors(near, 3)


# ---- networks ----


def _weights():
    w = np.array([x for _, _, x in carriers.kernel3()]).reshape(1, 1, 3, 3)
    return w, np.zeros(1)


_CONV = "+cv AS (SELECT p.img, p.r, p.c, sum(k.w * coalesce(q.v, 0)) AS v FROM px p CROSS JOIN kernel3 k LEFT JOIN px q ON q.img = p.img AND q.r = p.r + k.dr AND q.c = p.c + k.dc GROUP BY p.img, p.r, p.c), ac AS (SELECT img, r, c, CASE WHEN v > 0 THEN v ELSE 0.01 * v END AS v FROM cv)"


@query(_CONV + " SELECT img, r, c, round(v, 6) + 0.0 AS v FROM ac", "px", "kernel3")
def conv_block(spark, d):
    w, b = _weights()
    return _long(blocks.map_images(carriers.images(spark, d), lambda x: nn.ACTIVATIONS["lrelu"](nn.conv(x[:, None], w, b)), 8, 8))


@query(_CONV + " SELECT img, CAST(r // 2 AS INTEGER) AS r, CAST(c // 2 AS INTEGER) AS c, round(max(v), 6) + 0.0 AS v FROM ac GROUP BY img, r // 2, c // 2", "px", "kernel3")
def maxpool(spark, d):
    w, b = _weights()
    return _long(blocks.map_images(carriers.images(spark, d), lambda x: nn.max_pool(nn.ACTIVATIONS["lrelu"](nn.conv(x[:, None], w, b))), 4, 4))


@query("SELECT p.img, CAST(2 * p.r + a.i AS INTEGER) AS r, CAST(2 * p.c + b.j AS INTEGER) AS c, round(p.v, 6) + 0.0 AS v FROM px p, range(2) a(i), range(2) b(j)", "px")
def upsample_nearest(spark, d):
    return _long(blocks.map_images(carriers.images(spark, d), lambda x: nn.upsample(x[:, None], "nearest"), 16, 16))


@query(
    """+ats AS (SELECT i, floor(least(7, greatest(0, (i + 0.5) / 2 - 0.5))) AS lo, least(7, greatest(0, (i + 0.5) / 2 - 0.5)) - floor(least(7, greatest(0, (i + 0.5) / 2 - 0.5))) AS w FROM range(16) t(i)),
    pt AS (SELECT i, CAST(lo AS INTEGER) AS x, 1 - w AS w FROM ats UNION ALL SELECT i, CAST(least(lo + 1, 7) AS INTEGER), w FROM ats)
    SELECT p.img, CAST(a.i AS INTEGER) AS r, CAST(b.i AS INTEGER) AS c, round(sum(p.v * a.w * b.w), 6) + 0.0 AS v FROM px p JOIN pt a ON a.x = p.r JOIN pt b ON b.x = p.c GROUP BY p.img, a.i, b.i""", "px")
def upsample_bilinear(spark, d):
    return _long(blocks.map_images(carriers.images(spark, d), lambda x: nn.upsample(x[:, None], "bilinear"), 16, 16))


def _latent(spark, d):
    """Both latent values of every image, not rounded."""
    w = nn.formula_weights((2, 64))
    return blocks.map_images(carriers.images(spark, d), lambda x: x.reshape(len(x), -1) @ w.T, 1, 2)


@query('SELECT "row" AS img, CAST(l AS INTEGER) AS l, round(sum(v * ((((l * 64 + k) * 5) % 11 - 5) / 10.0 / 8)), 6) + 0.0 AS z FROM spectra, range(2) t(l) GROUP BY "row", l', "spectra")
def linear_latent(spark, d):
    return _latent(spark, d).select("img", F.posexplode("data").alias("l", "z")).withColumn("z", rounded("z"))


@query("SELECT img, r, c, round(1 / (1 + exp(-v)), 6) + 0.0 AS v FROM px", "px")
def sigmoid_out(spark, d):
    return _long(blocks.map_images(carriers.images(spark, d), nn.ACTIVATIONS["sigmoid"], 8, 8))


@query(_CONV + " SELECT round(avg((a.v - p.v) ** 2), 9) + 0.0 AS loss FROM ac a JOIN px p USING (img, r, c)", "px", "kernel3")
def mse_loss(spark, d):
    w, b = _weights()
    out = blocks.map_images(carriers.images(spark, d), lambda x: (nn.ACTIVATIONS["lrelu"](nn.conv(x[:, None], w, b))[:, 0] - x) ** 2, 8, 8)
    return carriers.to_long(out).agg(rounded(F.avg("v"), 9).alias("loss"))


@query("SELECT vec_id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 32 AS INTEGER) AS batch FROM embeddings")
def batch_ids(spark, d):
    return nn.batch_ids(carriers.read(spark, d, "embeddings"), "vec_id", 32)


@query(
    """+z AS (SELECT "row", l, sum(v * ((((l * 64 + k) * 5) % 11 - 5) / 10.0 / 8)) * 20 AS z FROM spectra, range(2) t(l) GROUP BY "row", l),
    n AS (SELECT CAST(least(11, greatest(0, floor((1.65 - a.z) / (3.3 / 11) + 0.5))) AS INTEGER) AS i, CAST(least(11, greatest(0, floor((b.z + 1.65) / (3.3 / 11) + 0.5))) AS INTEGER) AS j, count(*) AS n FROM z a JOIN z b ON a."row" = b."row" AND a.l = 0 AND b.l = 1 GROUP BY 1, 2)
    SELECT CAST(x.i AS INTEGER) AS i, CAST(y.j AS INTEGER) AS j, round(1.65 - x.i * 3.3 / 11, 9) + 0.0 AS z0, round(-1.65 + y.j * 3.3 / 11, 9) + 0.0 AS z1, coalesce(n.n, 0) AS n FROM range(12) x(i) JOIN range(12) y(j) ON true LEFT JOIN n ON n.i = x.i AND n.j = y.j""", "spectra")
def decode_grid_points(spark, d):
    """The grid of latent places that is decoded, and how many images have their latent place nearest to each."""
    z = _latent(spark, d).select(*[(F.col("data")[k] * 20).alias(f"z{k}") for k in (0, 1)])
    node = lambda c: F.least(F.lit(11), F.greatest(F.lit(0), F.floor(c / (3.3 / 11) + 0.5))).cast("int")
    counts = z.groupBy(node(1.65 - F.col("z0")).alias("i"), node(F.col("z1") + 1.65).alias("j")).agg(F.count("*").alias("n"))
    return nn.decode_grid(spark).join(counts, ["i", "j"], "left").select("i", "j", rounded("z0", 9).alias("z0"), rounded("z1", 9).alias("z1"), F.coalesce("n", F.lit(0)).alias("n"))


@query()
def sgd_step(spark, d):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(nn.Trainer(64).fit(_rows(spark, d)))], "epoch int, loss double")


# ---- gates, sets, neighbourhood statistics, headers ----


@query("SELECT id FROM points WHERE type = 3 AND id IN (SELECT id FROM points WHERE x + 0.5 > 0.2 AND y + 0.5 > 0.2 AND 1 - (x + 0.5) > 0.2 AND 1 - (y + 0.5) > 0.2)", "points")
def type_interior(spark, d):
    """Atoms of one type that are no border atoms: a semi-join of two lists of ids."""
    p = carriers.points(spark, d)
    inside = p.where(points.interior(F.col("x") + 0.5, F.col("y") + 0.5, 1.0, 1.0, 0.2)).select("id")
    return p.where("type = 3").select("id").join(inside, "id", "left_semi")


@query(f"+{_PAIRS.format(0.012)} SELECT id FROM points WHERE id NOT IN (SELECT i FROM pr UNION SELECT j FROM pr)", "points")
def unpaired_points(spark, d):
    p = carriers.points(spark, d)
    pairs = points.radius_pairs(p, 0.012)
    return p.select("id").join(pairs.select(F.explode(F.array("i", "j")).alias("id")), "id", "left_anti")


@query(
    """+a AS (SELECT img, img AS atom_id, CAST(img % 8 AS INTEGER) AS x, CAST((img // 8) % 8 AS INTEGER) AS y FROM (SELECT DISTINCT img FROM px)),
    s AS (SELECT a.img, a.atom_id, coalesce(sum(p.v), 0) AS s FROM a LEFT JOIN px p ON p.img = a.img AND abs(p.r - a.x) <= 1 AND abs(p.c - a.y) <= 1 GROUP BY ALL)
    SELECT img, atom_id, round(s, 6) + 0.0 AS total, s > -0.1 AND s < 0.3 AS kept FROM s""", "px")
def intensity_gate(spark, d):
    atoms = carriers.images(spark, d).select("img", F.col("img").alias("atom_id"), (F.col("img") % 8).cast("int").alias("x"), (F.floor(F.col("img") / 8) % 8).cast("int").alias("y"))
    return points.intensity_gate(carriers.px(spark, d), atoms, 1, -0.1, 0.3).withColumn("total", rounded("total"))


@query(
    """SELECT unit_id, CAST(n AS BIGINT) AS length, round(z, 9) + 0.0 AS z FROM (SELECT CAST(label * 1000 + floor((embedding[1] + 10) / 0.05) AS BIGINT) AS unit_id, count(*) AS n, avg(CAST(embedding[3] AS DOUBLE)) AS z FROM embeddings GROUP BY 1)
    WHERE n BETWEEN 4 AND 12 AND z > -0.02 AND z < 0.05""")
def polyhedra_by_vertices(spark, d):
    rows = carriers.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding")[0].alias("x"), F.col("embedding")[2].cast("double").alias("z"))
    unit = (F.col("label") * 1000 + F.floor((F.col("x") + 10) / 0.05)).cast("long")
    units = rows.groupBy(unit.alias("unit_id")).agg(F.array_sort(F.collect_list("id")).alias("atom_ids"))
    return graph.by_vertices(units, rows, (4, 12), (-0.02, 0.05)).withColumn("z", rounded("z", 9))


_PLACED = _KNN.format("points", "a.id <> b.id") + ", pl AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY atan2(dy, dx), j) - 1 AS place, d, dx, dy FROM k WHERE rank < 8)"


def _neighbour_rows(spark, d):
    p = carriers.points(spark, d)
    return points.neighbour_rows(points.knn(p, p, 8, include_self=False), 8)


@query(_PLACED + " SELECT CAST(a.place AS INTEGER) AS k1, CAST(b.place AS INTEGER) AS k2, round(sum(a.d * b.d), 8) + 0.0 AS g FROM pl a JOIN pl b ON a.i = b.i GROUP BY a.place, b.place", "points")
def neighbor_gram(spark, d):
    """What the decomposition of the neighbours' distances starts from."""
    long = _neighbour_rows(spark, d).select(F.col("id").alias("row"), F.posexplode("d").alias("k", "v"))
    return factor.gram_table(long).withColumn("g", rounded("g", 8))


@query()
def neighbor_pca(spark, d):
    """Singular values of the neighbours' distances, angles and complex offsets."""
    found = factor.neighbour_svd(settled(_neighbour_rows(spark, d), "neighbours"), 8)
    return spark.createDataFrame([(kind, k, float(s)) for kind, (_, values, _) in found.items() for k, s in enumerate(values)], "kind string, component int, value double")


@query(
    _PLACED + """, z AS (SELECT i, 2 * place AS p, dx AS v FROM pl UNION ALL SELECT i, 2 * place + 1, dy FROM pl),
    f AS (SELECT i, c, sum((v - ((c * 5 + p * 3) % 7 - 3) / 100.0) ** 2) AS far FROM z, range(4) t(c) WHERE i < (SELECT max(i) FROM z) GROUP BY i, c)
    SELECT i AS id, CAST(arg_min(c, (round(far, 12), c)) AS INTEGER) AS label FROM f GROUP BY i""", "points")
def neighbor_kmeans_step(spark, d):
    """The nearest of four given centres to each atom's interleaved offsets."""
    centres = [[((c * 5 + p * 3) % 7 - 3) / 100.0 for p in range(16)] for c in range(4)]
    return cluster.nearest_centre(points.interleaved(settled(_neighbour_rows(spark, d), "neighbours")), centres)


@query()
def neighbor_kmeans(spark, d):
    return cluster.kmeans_vectors(points.interleaved(settled(_neighbour_rows(spark, d), "neighbours")), 4)


@query(
    _WINDOWS + """, z AS (SELECT img, wr, wc, a - 1 AS a, b - 1 AS b, v FROM win WHERE a BETWEEN 1 AND 2 AND b BETWEEN 1 AND 2),
    o AS (SELECT o, least(1, greatest(0, (o + 0.5) / 2 - 0.5)) AS t FROM range(4) s(o)), x AS (SELECT o, i, CASE WHEN i = 0 THEN 1 - t ELSE t END AS w FROM o, range(2) s(i))
    SELECT img, wr, wc, CAST(p.o AS INTEGER) AS a, CAST(q.o AS INTEGER) AS b, round(sum(v * p.w * q.w), 9) + 0.0 AS v FROM z JOIN x p ON p.i = z.a JOIN x q ON q.i = z.b GROUP BY ALL""", "px")
def window_rescale(spark, d):
    """Windows zoomed to their centre and interpolated back to their size."""
    zoomed = grid.zoomed(grid.window_pixels(carriers.px(spark, d), 8, 8, (4, 4), (2, 2)), (4, 4), (2, 2))
    return grid.rescaled(zoomed, (2, 2), 2).withColumn("v", rounded("v", 9))


@query()
def pca_window_cleaning(spark, d):
    return pipelines.pca_cleaned(carriers.px(spark, d), 8, 8, 4, 2)


@query('SELECT "row", f AS f0, g AS f1, round(sum(v * (((a * 3 + f * 5) % 7 - 3) / 10.0) * (((b * 3 + g * 5) % 7 - 3) / 10.0)), 8) + 0.0 AS v FROM (SELECT i * 25 + j AS "row", a, b, v FROM cube), range(2) s(f), range(3) t(g) GROUP BY "row", f, g', "cube")
def tucker_core(spark, d):
    """The core along both spectral axes for given factors."""
    u = lambda r: np.array([[((i * 3 + f * 5) % 7 - 3) / 10 for f in range(r)] for i in range(8)])
    long = carriers.cube(spark, d).select((F.col("i") * 25 + F.col("j")).alias("row"), "a", "b", "v")
    core = factor.tucker_core(long, ["a", "b"], [u(2), u(3)], keep=("row",))
    return core.select(F.col("row").cast("long").alias("row"), F.col("f0").cast("long").alias("f0"), F.col("f1").cast("long").alias("f1"), rounded("v", 8).alias("v"))


@query("SELECT sum(abs(a.v - b.v)) * 0.5 AS error FROM stack a JOIN stack b USING (r, c) WHERE a.f = 0 AND b.f = 1", "stack")
def l1_error(spark, d):
    s = settled(carriers.stack(spark, d), "stack")
    return grid.l1_error(s.where("f = 0"), s.where("f = 1"), ["r", "c"], 0.5)


@query("SELECT p_brand AS dataset, list_sort(list_filter(list(DISTINCT p_size), lambda x: x <= 25)) AS spatial, list_sort(list_filter(list(DISTINCT p_size), lambda x: x > 25)) AS other FROM part GROUP BY p_brand")
def axis_buckets(spark, d):
    """Which of a dataset's axes are spatial: sizes up to 25 stand for them."""
    axes = carriers.read(spark, d, "part").groupBy(F.col("p_brand").alias("dataset")).agg(F.array_sort(F.collect_set("p_size")).alias("axes"))
    spatial, other = grid.axis_buckets(F.col("axes"), F.sequence(F.lit(1), F.lit(25)))
    return axes.select("dataset", spatial.alias("spatial"), other.alias("other"))


@query("SELECT p_partkey AS dataset, 'filtered ' || p_name AS title, p_name AS source, p_type AS quantity, 'nm' AS units, 'decon_lr' AS analysis, '500' AS rounds FROM part")
def derived_header(spark, d):
    part = carriers.read(spark, d, "part")
    given = part.select(F.col("p_partkey").alias("dataset"), F.col("p_name").alias("title"), F.lit("part").alias("source"), F.col("p_type").alias("quantity"), F.lit("counts").alias("units"), F.create_map().cast("map<string,string>").alias("metadata"))
    made = headers.provenance(headers.like(given, "filtered ", units=F.lit("nm")), "decon_lr", rounds=500)
    return made.select("dataset", "title", "source", "quantity", "units", F.col("metadata")["analysis"].alias("analysis"), F.col("metadata")["rounds"].alias("rounds"))


# ---- units, large groups ----


def _in_units(spark, d):
    """The images with pixels of a quarter nanometre, the first at -1 and 2."""
    axes = (dataset.Axis("x", 8, "nm", start=-1.0, step=0.25), dataset.Axis("y", 8, "nm", start=2.0, step=0.25))
    return dataset.Dataset(carriers.images(spark, d), dataset.Header("images", axes, data_type="IMAGE_STACK"))


def _placed(ds):
    """img, x, y, v: values at places in the units of the header's axes."""
    rows, cols = ds.header.axes
    long = carriers.to_long(ds.data)
    return long.select("img", rounded(F.lit(rows.start) + F.col("r") * rows.step).alias("x"), rounded(F.lit(cols.start) + F.col("c") * cols.step).alias("y"), "v")


@query("SELECT img, r / 4 - 1 AS x, c / 4 + 2 AS y, v FROM px WHERE r / 4 - 1 >= -0.5 AND r / 4 - 1 < 0.5 AND c / 4 + 2 >= 2.25 AND c / 4 + 2 < 3.75", "px")
def crop_units(spark, d):
    return _placed(dataset.crop(_in_units(spark, d), (-0.5, 0.5), (2.25, 3.75)))


@query(_DFT + f", {_KERNEL3}, a AS (SELECT img, u, v, sqrt(re * re + im * im) AS x FROM f), b AS (SELECT a.img, m.at AS u, a.v, sum(m.w * a.x) AS x FROM a JOIN m ON a.u = m.fr GROUP BY ALL) SELECT b.img, b.u / 2.0 AS x, m.at / 2.0 AS y, round(ln(1 + sum(m.w * b.x)), 6) + 0.0 AS v FROM b JOIN m ON b.v = m.fr GROUP BY b.img, b.u, m.at", "px")
def power_spectrum_units(spark, d):
    """Log spectra over the reciprocal axes that the header tells."""
    return _placed(dataset.power_spectrum(_in_units(spark, d))).withColumn("v", rounded("v"))


@query()
def find_blobs(spark, d):
    """Blobs of the frames of the stack, searched in tiles of 12 x 12 pixels."""
    return blobs.find_blobs(carriers.stack(spark, d).select(F.col("f").cast("long").alias("img"), "r", "c", "v"), 3.0, tile=12)


@query("WITH n AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS size FROM lineitem) SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS value FROM n WHERE k = CAST(floor(size * 0.7) AS BIGINT) + 1")
def order_statistic(spark, d):
    """The value at place int(0.7 n) of each group's sorted values, without sorting a group."""
    rows = carriers.read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    places = rows.groupBy("l_returnflag").agg((F.floor(F.count("*") * 0.7) + 1).alias("place"))
    return ranks.order_statistic(rows, ["l_returnflag"], places)


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def group_ranks(spark, d):
    orders = carriers.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranks.ranked(orders, ["o_orderpriority"], ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_orderpriority", "rank")


@query()
def shuffled_batches(spark, d):
    """Batches of 32 vectors in the order of seed 1, first epoch."""
    places = ranks.numbered(carriers.read(spark, d, "embeddings").select("vec_id"), ["vec_id"])
    return ranks.shuffled_batches(places, places.count(), 32).select("vec_id", "batch", "slot")


_SIZES = {"j": 25, "a": 8, "b": 8}


@query("SELECT i, j, CAST(a * 8 + b AS BIGINT) AS col, v FROM cube", "cube")
def fold_spec(spark, d):
    return grid.fold(carriers.cube(spark, d), ["i", "j"], ["a", "b"], _SIZES | {"i": 1}, "spec")


@query('SELECT CAST(i * 25 + j AS BIGINT) AS "row", a, CAST(b AS BIGINT) AS rest, v FROM cube', "cube")
def fold_blocks(spark, d):
    return grid.fold(carriers.cube(spark, d), ["i", "j"], ["a", "b"], _SIZES | {"i": 1}, "blocks")


@query("SELECT i, j, v FROM cube WHERE a = 2 AND b = 5", "cube")
def dim_slice(spark, d):
    return grid.picked(carriers.cube(spark, d), {"a": 2, "b": 5})


@query('SELECT "row", round(regr_slope(v, k), 9) + 0.0 AS slope, round(regr_intercept(v, k), 9) + 0.0 AS intercept, round(sqrt(regr_syy(v, k) * (1 - regr_r2(v, k)) / 62), 7) + 0.0 AS error FROM spectra GROUP BY "row"', "spectra")
def spectra_line_fit(spark, d):
    return filters.line_fits(carriers.spectra(spark, d)).select("row", rounded("slope", 9).alias("slope"), rounded("intercept", 9).alias("intercept"), rounded("error", 7).alias("error"))


@query("SELECT img, r, c, round(v - 0.2 * exp(-((r - 4 - 0.5) ** 2 / (2 * 1.5 ** 2) + (c - 4 + 0.25) ** 2 / (2 * 2.0 ** 2))) - 0.01, 9) + 0.0 AS v FROM px", "px")
def gauss_difference(spark, d):
    """What an oval Gaussian leaves of each image."""
    return _long(filters.gauss_difference(carriers.images(spark, d), 8, 8, (0.2, 0.5, -0.25, 1.5, 2.0, 0.01)), 9)


@query("SELECT id, NOT (x + 0.5 > 0.1 AND x + 0.5 < 0.9 AND y + 0.5 > 0.1 AND y + 0.5 < 0.9) AS border FROM points", "points")
def border_band(spark, d):
    return carriers.points(spark, d).select("id", points.border_band(F.col("x") + 0.5, F.col("y") + 0.5, 1.0, 1.0, 0.1).alias("border"))
