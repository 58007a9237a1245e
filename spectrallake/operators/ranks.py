"""Ranks, order statistics and batches of rows, also of very large groups: no window over a whole group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import forget, settled

_IN_RUN = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `place`, from 0 without a gap, in ascending order. Range partitions number their own rows; a table of one row a task says what stands before."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = settled(dealt, "numbered").withColumn("run", F.shiftright("at", 33))
    before = F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    runs = rows.groupBy("run").agg(F.count("*").alias("n")).select("run", before.alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit(_IN_RUN))
    return rows.join(F.broadcast(runs), "run").withColumn("place", place).drop("run", "at", "before")


def ranked(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """rows with `rank`, from 1 within each group. A group lies in many range partitions; only its first place is looked up."""
    n = numbered(rows, [*groups, *order])
    if not groups:
        return n.withColumn("rank", F.col("place") + 1).drop("place")
    first = n.groupBy(*groups).agg(F.min("place").alias("first"))
    return n.join(first, groups).withColumn("rank", F.col("place") - F.col("first") + 1).drop("place", "first")


def order_statistic(values: DataFrame, groups: list[str], places: DataFrame, bins: int = 1024) -> DataFrame:
    """groups, value: the place-th smallest (from 1) v of values(groups, v) in each group of places(groups, place); groups too small have no row.

    Each round counts the values in bins between two bounds of each group, with sums before the shuffle, and goes on with
    the bin that holds the place, until it has one value only. Counts leave the tasks, values never do. Nulls don't count.
    """
    values = values.where("v is not null").select(*groups, F.col("v").cast("double").alias("v"))
    ends = values.groupBy(*groups).agg(F.min("v").alias("_low"), F.max("v").alias("_high"), F.count("*").alias("_size"))
    todo = settled(places.select(*groups, F.col("place").cast("long").alias("place")).join(ends, groups).where("place between 1 and _size").drop("_size"), "bounds")
    done, spent = [], []
    while True:
        done.append(todo.where("_low = _high").select(*groups, F.col("_low").alias("value")))
        wide = todo.where("_low < _high")
        if wide.isEmpty():
            break
        here = values.join(wide, groups).where("v between _low and _high")
        number = F.least(F.floor((F.col("v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))
        counts = here.groupBy(*groups, "place", number.alias("_bin")).agg(F.count("*").alias("_n"), F.min("v").alias("_low"), F.max("v").alias("_high"))
        # At most `bins` rows a group.
        upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_bin"))
        found = counts.withColumn("_upto", upto).where("place <= _upto and place > _upto - _n")
        spent.append(todo)
        todo = settled(found.select(*groups, (F.col("place") - F.col("_upto") + F.col("_n")).alias("place"), "_low", "_high"), "bounds")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = settled(out, "statistics")
    forget(todo, *spent)
    return out


def permuted(place: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 to n - 1 told by key: four rounds of a Feistel network over the next power of four, walked until inside."""
    half = max(1, (int(max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for k in keys:
                mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(place.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def shuffled_batches(places: DataFrame, n: int, size: int, seed: int = 1, epoch: int = 0) -> DataFrame:
    """places(place, ...) of n rows with `batch` and `slot` in it: another order for each seed and epoch, the same for any partitioning; a map.

    Each row is in one batch an epoch; all batches have `size` rows, but the last one for what is left over.
    """
    key = (seed * 1_000_003 + epoch) & (2**63 - 1)

    @F.pandas_udf("long")
    def drawn(place: pd.Series) -> pd.Series:
        return pd.Series(permuted(place.to_numpy(), n, key))

    at = places.withColumn("_drawn", drawn("place"))
    return at.withColumns({"batch": F.floor(F.col("_drawn") / size), "slot": F.col("_drawn") % size}).drop("_drawn")
