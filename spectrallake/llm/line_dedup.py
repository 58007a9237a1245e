"""Lines that many documents share, found batch by batch in levelled sorted runs, and taken out. DataFrame functions only.

A run is a table of (line hash, documents), bucketed and sorted by the hash. Each batch of documents counts its own
lines, is merge-anti-joined with the runs' hashes that are known to be frequent already (they need no more counting) and
adds the rest as a run of level 0. When a level has `fanout` runs they are merged, their counts added up, into one run of
the next level, so a hash is rewritten once a level and a batch meets few runs. Runs have as many buckets as a shuffle has
partitions: the batch's counts are dealt alike already, so an anti-join moves no run. Documents are then looked through for the frequent hashes' places, by hash, and
texts meet only the places to drop.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh_path, written

KEY = ["h1", "h2"]
BATCHES, FANOUT = 8, 4
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def hashed(line: Column, least_chars: int) -> Column:
    """128 bits of a line's key; null for keys of fewer code points."""
    key = line_key(line)
    return F.when(F.length(key) >= least_chars, F.struct(*[F.xxhash64(F.lit(seed), key).alias(f"h{seed}") for seed in (1, 2)]))


class LineRuns:
    """Counts of line hashes over the batches seen so far."""

    def __init__(self, spark: SparkSession, frequent: int, fanout: int = FANOUT) -> None:
        self.spark, self.frequent, self.fanout = spark, frequent, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _written(self, run: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", fresh_path(self.spark, "line-run")
        # Hashes don't shrink, and a codec keeps memory outside the heap for every file.
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).option("compression", "none").saveAsTable(name)
        return name, path

    def _read(self, run: tuple[str, str]) -> DataFrame:
        return self.spark.read.table(run[0])

    def _removed(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            self.spark.sql(f"DROP TABLE {name}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        # Read as plain files: Spark 4.1 takes a union of bucketed tables as dealt by their buckets, which its columnar form is not.
        files = [self.spark.read.schema("h1 long, h2 long, n long").parquet(path) for _, path in runs]
        return reduce(DataFrame.unionByName, files).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def add(self, own: DataFrame) -> None:
        """own(h1, h2, n): distinct hashes of a batch and in how many of its documents each occurs."""
        for run in [r for level in self.levels for r in level]:
            settled = self._read(run).where(F.col("n") >= self.frequent).select(*KEY)
            own = own.join(settled.hint("merge"), KEY, "left_anti")
        new, level = self._written(own.select(*KEY, "n")), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            new = self._written(self._merged(full))
            self._removed(full)
            level += 1

    def close(self) -> DataFrame:
        """(h1, h2) of hashes in at least `frequent` documents, written; the runs are removed."""
        runs = [r for level in self.levels for r in level]
        out = written(self._merged(runs).where(F.col("n") >= self.frequent).select(*KEY), "frequent-lines")
        self._removed(runs)
        self.levels = []
        return out


def drop_frequent_lines(docs: DataFrame, *, frequent: int = 10, least_chars: int = 1, batch: Column | None = None, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_lines, n_dropped, text: lines whose key stands in at least `frequent` documents go from all of them.

    Texts are split at \\n; a null or empty text is one empty line. A key is the line without white space at its ends, A-Z
    in lower case; keys under `least_chars` code points always stay. Each row is a document, also rows of one doc_id or
    none; a key counts once a document. Documents are dealt to `batches` by `batch`, a long from 0 (where it is not given,
    by a hash of doc_id and text); the result is the same however they are dealt. A text that loses all its lines becomes
    empty. Further columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) if batch is None else batch).alias("batch"))
    rows = source.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"), "text", "batch")
    path = fresh_path(spark, "line-hashes")
    keyed = rows.select("doc_id", "text_hash", F.transform("lines", lambda x: hashed(x, least_chars)).alias("keys"), "batch")
    keyed.write.partitionBy("batch").option("compression", "none").parquet(path)
    keyed = spark.read.schema(keyed.schema).parquet(path)

    runs = LineRuns(spark, frequent, fanout)
    for number in range(batches):
        own = keyed.where(F.col("batch") == number).select(F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
        runs.add(own.groupBy("key.h1", "key.h2").agg(F.count("*").alias("n")))
    common = runs.close()

    # Rows of one doc_id and text lose the same lines, so doc_id and the text's hash say where a place belongs.
    places = keyed.select("doc_id", "text_hash", F.posexplode("keys").alias("place", "key")).where("key is not null").select("doc_id", "text_hash", "place", "key.*")
    drops = places.join(common, KEY).groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("drops"))
    drops = written(drops, "drops")
    forget(keyed, common)
    at = drops.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "drops")
    full = rows.join(at, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), "drops")
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return full.select("doc_id", n.cast("long").alias("n_lines"), (n - F.coalesce(F.size(left), n)).cast("long").alias("n_dropped"), kept.alias("text"))


def digest(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


__all__ = ["LineRuns", "digest", "drop_frequent_lines", "hashed", "line_key"]
