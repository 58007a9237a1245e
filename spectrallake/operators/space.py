"""Space partitions: cells of about equal counts, cut at medians of a bounded sample.

Cells are the leaves of a tree of axis cuts, so they follow the points however unevenly these lie: a far outlier or a
dense spot changes the cuts, not the counts. The tree and a box for each cell are small (at most MOST_CELLS leaves) and
go to all tasks; points and questions meet by cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a cell, about; most cells; sampled points a cell.
CELL, MOST_CELLS, SAMPLE = 8192, 1 << 16, 32


class Cells:
    """A tree of axis cuts over points of any dimension; its nodes are numbered level by level, the root first."""

    def __init__(self, axis: np.ndarray, cut: np.ndarray) -> None:
        self.axis, self.cut = axis, cut
        self.depth = int(math.log2(len(axis) + 1))
        self.size = 1 << self.depth

    def place(self, at: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node, rows = np.zeros(len(at), np.int64), np.arange(len(at))
        for _ in range(self.depth):
            node = 2 * node + 1 + (at[rows, self.axis[node]] >= self.cut[node])
        return node - (self.size - 1)

    def column(self, *coordinates: str) -> Column:
        """The cell as a column of a DataFrame with these coordinates."""
        if not self.depth:
            return F.lit(0)

        @F.pandas_udf("int")
        def cell(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.place(np.column_stack([c.to_numpy(float) for c in columns])).astype(np.int32))

        return cell(*coordinates)

    def boxed(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> Boxes:
        return Boxes(self, low, high, count)


class Boxes:
    """Cells with the boxes of the points in them (low, high; infinite where there are none) and their counts."""

    def __init__(self, cells: Cells, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        self.cells, self.count, self.leaf_low, self.leaf_high = cells, count, low, high
        levels = [(low, high)]
        for _ in range(cells.depth):
            a, b = levels[0]
            levels.insert(0, (np.minimum(a[::2], a[1::2]), np.maximum(b[::2], b[1::2])))
        self.low, self.high = (np.concatenate(side) for side in zip(*levels, strict=True))

    def _crossed(self, meets, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): cells reached from the root through nodes for which meets(rows, nodes) holds."""
        rows, nodes = np.arange(n), np.zeros(n, np.int64)
        for level in range(self.cells.depth + 1):
            near = meets(rows, nodes)
            rows, nodes = rows[near], nodes[near]
            if level < self.cells.depth:
                rows, nodes = np.repeat(rows, 2), np.column_stack([2 * nodes + 1, 2 * nodes + 2]).ravel()
        return rows, nodes - (self.cells.size - 1)

    def within(self, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells whose box comes as near as reach to a point; a hair more, as distances are rounded."""
        most = (reach * (1 + 1e-12)) ** 2

        def meets(rows, nodes):
            gap = np.maximum(np.maximum(self.low[nodes] - at[rows], at[rows] - self.high[nodes]), 0)
            return (gap**2).sum(1) <= most[rows]

        return self._crossed(meets, len(at))

    def overlapping(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells whose box meets a box."""
        return self._crossed(lambda rows, nodes: ((self.low[nodes] <= high[rows]) & (self.high[nodes] >= low[rows])).all(1), len(low))

    def reach_of(self, at: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each point has k others: that of the far corner of the box that completes k, boxes in the order of their far corners."""
        out = np.full(len(at), np.inf)
        full = self.count > 0
        low, high, count = self.leaf_low[full], self.leaf_high[full], self.count[full]
        for n, p in enumerate(at):
            far = np.sqrt((np.maximum(np.abs(p - low), np.abs(p - high)) ** 2).sum(1))
            order = np.argsort(far)
            last = np.searchsorted(np.cumsum(count[order]), k)
            if last < len(order):
                out[n] = far[order[last]]
        return out


def finite(points: DataFrame, *coordinates: str) -> DataFrame:
    """Points with all coordinates there and finite."""
    for c in coordinates:
        points = points.where(F.abs(F.col(c).cast("double")) < float("inf"))
    return points


def cells_of(points: DataFrame, n: int, coordinates: tuple[str, ...] = ("x", "y"), cell: int = CELL) -> Cells:
    """Cells of about `cell` of the n points, from a sample of at most SAMPLE points a cell: MOST_CELLS * SAMPLE rows, whatever n."""
    depth = max(0, min(math.ceil(math.log2(max(n / cell, 1))), int(math.log2(MOST_CELLS))))
    if not depth:
        return Cells(np.zeros(0, np.int64), np.zeros(0))
    wanted = SAMPLE << depth
    picked = points.select(*coordinates)
    if n > wanted:
        picked = picked.sample(min(1.0, 1.2 * wanted / n), seed=7).limit(wanted)
    return cut(picked.toPandas().to_numpy(float), depth)


def cut(sample: np.ndarray, depth: int) -> Cells:
    """The tree of medians, each along the axis in which the node's sample is widest."""
    axis, at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = [np.arange(len(sample))]
    node = 0
    for _ in range(depth):
        below = []
        for part in parts:
            p = sample[part]
            if len(p):
                axis[node] = np.argmax(p.max(0) - p.min(0))
                along = p[:, axis[node]]
                at[node] = np.median(along)
                if at[node] <= along.min() < along.max():  # most lie at the least place: these are cut off from the rest
                    at[node] = along[along > at[node]].min()
            right = p[:, axis[node]] >= at[node] if len(p) else np.zeros(0, bool)
            below += [part[~right], part[right]]
            node += 1
        parts = below
    return Cells(axis, at)


def boxes_of(placed: DataFrame, cells: Cells, coordinates: tuple[str, ...] = ("x", "y")) -> Boxes:
    """Boxes and counts of placed(cell, coordinates): a row a cell."""
    low, high, count = np.full((cells.size, len(coordinates)), np.inf), np.full((cells.size, len(coordinates)), -np.inf), np.zeros(cells.size, np.int64)
    for r in placed.groupBy("cell").agg(F.count("*"), *[f(c) for c in coordinates for f in (F.min, F.max)]).collect():
        count[r[0]], low[r[0]], high[r[0]] = r[1], r[2::2], r[3::2]
    return cells.boxed(low, high, count)


def dealt(asked: DataFrame, placed: DataFrame, most: int, by: str) -> tuple[DataFrame, DataFrame]:
    """Both with a column `part`: a cell that is asked more than `most` times is dealt to several tasks, each with all its points.

    asked has `cell` and a column `by` that deals; placed has `cell`. The list of such cells is at most MOST_CELLS long.
    """
    busy = asked.groupBy("cell").count().where(F.col("count") > most).select("cell", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    rows = busy.collect()
    if not rows:
        return asked.withColumn("part", F.lit(0)), placed.withColumn("part", F.lit(0))
    small = asked.sparkSession.createDataFrame([(r["cell"], r["parts"]) for r in rows], "cell int, parts int")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    spread = asked.join(F.broadcast(small), "cell", "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    return spread, placed.join(F.broadcast(small), "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
