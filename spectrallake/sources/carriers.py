"""Images, spectra, stacks and point sets as views over the driver's tables.

Two layouts: block form, one row an image with its values in row-major order (h, w, data), for what works on one image
at a time; long form, one row a value, for what joins and aggregates. `to_long` and `to_block` go between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 images in block form: img, h, w, data."""
    data = F.transform("embedding", lambda v: v.cast("double"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.lit(8).alias("h"), F.lit(8).alias("w"), data.alias("data"))


def from_arrays(spark: SparkSession, arrays) -> DataFrame:
    """Images in block form from two-dimensional numpy arrays, numbered in their order."""
    rows = [(k, int(a.shape[0]), int(a.shape[1]), [float(v) for v in a.ravel()]) for k, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "img long, h int, w int, data array<double>")


def write(df: DataFrame, path: str, by: str | None = None) -> None:
    """Results as Parquet beside the data, in a folder for each value of `by`."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def to_long(blocks: DataFrame) -> DataFrame:
    """img, r, c, v; no shuffle."""
    long = blocks.select("img", "w", F.posexplode("data").alias("pos", "v"))
    return long.select("img", (F.floor(F.col("pos") / F.col("w"))).cast("int").alias("r"), (F.col("pos") % F.col("w")).cast("int").alias("c"), "v")


def to_block(long: DataFrame, h: int, w: int) -> DataFrame:
    """One row an image from img, r, c, v; positions without a value are 0."""
    cells = long.groupBy("img").agg(F.map_from_entries(F.collect_list(F.struct((F.col("r") * w + F.col("c")).alias("p"), "v"))).alias("m"))
    data = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda p: F.coalesce(F.col("m")[p], F.lit(0.0)))
    return cells.select("img", F.lit(h).alias("h"), F.lit(w).alias("w"), data.alias("data"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(images(spark, sf_dir))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, k, v: one spectrum of 64 channels a vector."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("k", "v"))
    return rows.withColumn("v", F.col("v").cast("double"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, a, b, v: two spatial and two spectral axes."""
    s = spectra(spark, sf_dir)
    return s.select(
        F.floor(F.col("row") / 25).cast("int").alias("i"), (F.col("row") % 25).cast("int").alias("j"),
        F.floor(F.col("k") / 8).cast("int").alias("a"), (F.col("k") % 8).cast("int").alias("b"), "v",
    )


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, r, c, v: five frames of 30 days by 24 hours; v is the sum of cents, 0 where nothing happened."""
    names = ["click", "error", "purchase", "signup", "view"]
    frame = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("event_type")).cast("int") - 1
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin(names)).select(frame.alias("f"), (F.dayofmonth("ts") - 1).alias("r"), F.hour("ts").alias("c"), F.round(F.col("value") * 100).cast("long").alias("v"))
    sums = e.groupBy("f", "r", "c").agg(F.sum("v").alias("v"))
    axes = spark.range(5 * 30 * 24).select(F.floor(F.col("id") / 720).cast("int").alias("f"), (F.floor(F.col("id") / 24) % 30).cast("int").alias("r"), (F.col("id") % 24).cast("int").alias("c"))
    return axes.join(sums, ["f", "r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, type."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").alias("type"))


def solid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z, g: points in space, a group for each label."""
    at = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")]
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *at, F.col("label").alias("g"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, corners: an array of five corners (x, y) in no order."""
    corner = lambda n: F.struct(F.col("embedding")[2 * n].cast("double").alias("x"), F.col("embedding")[2 * n + 1].cast("double").alias("y"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[corner(n) for n in range(5)]).alias("corners"))


#: A linkage over ten leaves: row j joins two nodes to node 10 + j.
LINKAGE = ((0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11), (12, 13), (15, 16), (17, 14))


def kernel3() -> list[tuple[int, int, float]]:
    """A 3x3 kernel given by a formula: dr, dc, weight."""
    return [(dr, dc, (((dr + 1) * 7 + (dc + 1) * 3) % 11 - 5) / 10) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


#: The same in DuckDB.
CTES = {
    "px": "px AS (SELECT vec_id AS img, CAST(pos // 8 AS INTEGER) AS r, CAST(pos % 8 AS INTEGER) AS c, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings))",
    "spectra": "spectra AS (SELECT vec_id AS \"row\", CAST(pos AS INTEGER) AS k, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings))",
    "cube": "cube AS (SELECT CAST(vec_id // 25 AS INTEGER) AS i, CAST(vec_id % 25 AS INTEGER) AS j, CAST(pos // 8 AS INTEGER) AS a, CAST(pos % 8 AS INTEGER) AS b, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings))",
    "stack": """stack AS (SELECT CAST(a.f AS INTEGER) AS f, CAST(b.r AS INTEGER) AS r, CAST(d.c AS INTEGER) AS c, CAST(coalesce(s.v, 0) AS BIGINT) AS v
      FROM range(5) a(f), range(30) b(r), range(24) d(c) LEFT JOIN (SELECT list_position(['click','error','purchase','signup','view'], event_type) - 1 AS f, day(ts) - 1 AS r, hour(ts) AS c, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY ALL) s
      ON s.f = a.f AND s.r = b.r AND s.c = d.c)""",
    "points": "points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS type FROM embeddings)",
    "solid_points": "solid_points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label AS g FROM embeddings)",
    "ring": "ring AS (SELECT vec_id AS id, CAST(n AS INTEGER) AS n, CAST(embedding[2*n+1] AS DOUBLE) AS x, CAST(embedding[2*n+2] AS DOUBLE) AS y FROM embeddings, range(5) t(n))",
    "kernel3": "kernel3 AS (SELECT a.d - 1 AS dr, b.d - 1 AS dc, ((a.d * 7 + b.d * 3) % 11 - 5) / 10.0 AS w FROM range(3) a(d), range(3) b(d))",
}
