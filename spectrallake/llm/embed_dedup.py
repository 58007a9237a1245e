"""Embedding near-duplicates: dual traversal of cover trees, exact threshold pairs.

Vectors are compared within a label only. Equal vectors are one entity. The entities of a label are dealt to cells, the
top level of its tree: centres are entities of the smallest hashes, one for about `cell` entities, and each entity goes
to its nearest centre; a label of one cell needs no centre, and a cell with more than `cell` entities is dealt out
further by hash. Two cells meet only if their centres are no farther apart than their covering radii and the threshold's
distance allow. Where they meet, a task builds a cover tree over each (levels with halving radii, down to single
entities, each node with its true covering radius) and goes down both at once, dropping node pairs that the radii rule
out; what is left is decided by the cosine itself. A task returns the number of links of each entity and a spanning forest
of them, never the pairs of a dense group. Where vectors lie far apart, as in many dimensions, the radii rule out pairs of
single entities, but hardly pairs of cells: the work is then that of all pairs of centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, forget, one_blas_thread, written

THRESHOLD = 0.93
#: Entities of a cell. Centres of one label are at most its entities over this, and at most `CENTRES`; so many entities meet them in one task.
CELL, CENTRES, SLICE = 2048, 1024, 50_000
#: Distances are compared with this much to spare; links are decided by the cosine.
SLACK = 1e-7


class Node:
    """A node of a cover tree: its points, a point at its centre, the largest distance of a point from it, and its children."""

    __slots__ = ("centre", "children", "points", "radius", "table")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray):
        self.centre, self.radius, self.points, self.children, self.table = centre, radius, points, [], None

    def nets(self) -> tuple[list[Node], np.ndarray, np.ndarray]:
        """Children, their centres and their radii; the node itself where it is a leaf."""
        if self.table is None:
            nodes = self.children or [self]
            self.table = nodes, np.stack([k.centre for k in nodes]), np.array([k.radius for k in nodes])
        return self.table


def cover_tree(x: np.ndarray, rows: np.ndarray, step: float = 1.0, leaf: int = 8) -> Node:
    """A cover tree over unit vectors x[rows]: children are nets of half the level's radius; leaves hold few points.

    The points of a node are compared in one product; each point that no net before it covers starts a net.
    """
    near = x[rows] @ x[rows].T if len(rows) > 1 else np.ones((1, 1))
    radius = float(np.sqrt(max(0.0, 2 - 2 * near[0].min())))
    node = Node(x[rows[0]], radius, rows)
    if len(rows) <= leaf or radius < 1e-6:
        return node
    while step >= radius:
        step /= 2
    close = near >= 1 - step * step / 2
    np.fill_diagonal(close, True)
    left = np.ones(len(rows), bool)
    for i in range(len(rows)):
        if left[i]:
            mine = np.flatnonzero(close[i] & left)
            left[mine] = False
            child = cover_tree(x, rows[mine], step / 2, leaf) if len(mine) > 1 else Node(x[rows[i]], 0.0, rows[mine])
            node.children.append(child)
    return node


def leaf_pairs(a: Node, b: Node, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows of both trees that may hold points within reach; with a is b each block pair comes once."""
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if not p.children and not q.children or p is not q and len(p.points) * len(q.points) <= 64:
            yield p.points, q.points
            continue
        if p is not q and p.children and q.children and min(len(p.points), len(q.points)) * 8 < max(len(p.points), len(q.points)):
            # Only the larger of two uneven nodes is opened.
            ps, qs = (p.nets(), ([q], q.centre[None], np.array([q.radius]))) if len(p.points) > len(q.points) else (([p], p.centre[None], np.array([p.radius])), q.nets())
        else:
            ps, qs = p.nets(), q.nets()
        (left, c, r), (right, e, s) = ps, qs
        for at in range(0, len(left), 512):
            # Unit vectors are within d of each other if their product is at least 1 - d^2 / 2: first with the largest radius, then each with its own.
            part = slice(at, at + 512)
            product = c[part] @ e.T
            most = np.minimum(r[part] + s.max() + reach + SLACK, 2.0)
            i, j = np.nonzero(product >= (1 - most * most / 2)[:, None])
            own = np.minimum(r[part][i] + s[j] + reach + SLACK, 2.0)
            ok = product[i, j] >= 1 - own * own / 2
            i, j = i[ok] + at, j[ok]
            if p is q:
                i, j = i[i <= j], j[i <= j]
            stack.extend((left[u], right[v]) for u, v in zip(i.tolist(), j.tolist(), strict=True))


def links(x: np.ndarray, y: np.ndarray | None, weight_x: np.ndarray, weight_y: np.ndarray | None, threshold: float):
    """Links within x (y None) or between x and y: weighted numbers of links of both sides, and a spanning forest as row pairs."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    own = y is None
    y, weight_y = (x, weight_x) if own else (y, weight_y)
    n, m = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    parent = np.arange(len(x) + (0 if own else len(y)))
    forest: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def take(i: np.ndarray, j: np.ndarray) -> None:
        """Decide pairs of rows, each given once; cosines are summed in one way, whatever block a pair was found in."""
        ok = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
        i, j = i[ok], j[ok]
        np.add.at(n, i, weight_y[j])
        np.add.at(n if own else m, j, weight_x[i])
        seen = set()
        for u, v in zip(i.tolist(), (j if own else j + len(x)).tolist(), strict=True):
            ru, rv = root(u), root(v)
            if ru != rv and (ru, rv) not in seen:
                parent[max(ru, rv)] = min(ru, rv)
                forest.append((u, v))

    a = cover_tree(x, np.arange(len(x)))
    b = a if own else cover_tree(y, np.arange(len(y)))
    few: tuple[list[int], list[int]] = ([], [])
    for p, q in leaf_pairs(a, b, reach):
        same = own and p is q
        if len(p) * len(q) <= 64:
            for u in p.tolist():
                for v in q.tolist():
                    if not same or u < v:
                        few[0].append(u)
                        few[1].append(v)
            if len(few[0]) > 1 << 16:
                take(*(np.array(f, np.int64) for f in few))
                few = ([], [])
            continue
        for at in range(0, len(p), 512):
            part = p[at : at + 512]
            i, j = np.nonzero(x[part] @ y[q].T >= threshold - 1e-9)
            i, j = part[i], q[j]
            if same:
                i, j = i[i < j], j[i < j]
            take(i, j)
    take(*(np.array(f, np.int64) for f in few))
    return n, m, forest


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one_blas_thread()
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        x = np.stack(left.unit.to_numpy()) if len(left) else np.empty((0, 1))
        if len(right):
            if not len(left):
                return pd.DataFrame({"rep": [], "n": [], "other": []}).astype({"rep": "int64", "n": "int64", "other": "Int64"})
            y = np.stack(right.unit.to_numpy())
            n, m, forest = links(x, y, left.copies.to_numpy(), right.copies.to_numpy(), threshold)
            rep, count = np.concatenate([left.rep, right.rep]), np.concatenate([n, m])
        else:
            n, _, forest = links(x, None, left.copies.to_numpy(), None, threshold)
            rep, count = left.rep.to_numpy(), n
        some = count > 0
        out = pd.DataFrame({"rep": rep[some], "n": count[some], "other": pd.array([None] * int(some.sum()), "Int64")})
        tree = pd.DataFrame({"rep": [int(rep[u]) for u, _ in forest], "n": 0, "other": pd.array([int(rep[v]) for _, v in forest], "Int64")})
        return pd.concat([out, tree]).astype({"rep": "int64", "n": "int64", "other": "Int64"})

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, cell: int = CELL, centres: int = CENTRES) -> DataFrame:
    """vectors(vec_id, embedding, label, ...) -> vec_id, n_links, component_id, kept; a row for each row.

    Two vectors link if their labels are equal and not null, their lengths are equal and their cosine, in double
    precision, is at least threshold. Vectors that are null or zero, or hold null or non-finite components, link with
    nothing. n_links counts other rows; component_id is the smallest vec_id reachable; kept is vec_id = component_id.
    Repeated rows and equal vectors link like any others, and rows of one vec_id only if their vectors do. A null vec_id
    links but names no component that has others. Other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    bound_batches(vectors.sparkSession)
    v = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & (F.aggregate("v", F.lit(0.0), lambda s, e: s + F.abs(e)) > 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    over = lambda value: F.transform(F.array(value), lambda x: F.transform("v", lambda e: e / x))[0]  # noqa: E731  the divisor is computed once a row
    scaled = F.when(F.col("sound"), over(F.array_max(F.transform("v", F.abs)))).otherwise(F.col("v"))
    rows = rows.withColumn("v", scaled)
    unit = F.when(F.col("sound"), over(norm))
    kinds = rows.select("vec_id", "label", "sound", unit.alias("unit")).withColumn("kind", F.when(F.col("sound"), F.concat_ws("|", F.size("unit").cast("string"), "label")))
    entities = kinds.where("sound").groupBy("kind", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # Entities are told apart by a number of their own: vec_ids may be null or repeat.
    entities = written(entities.withColumn("node", F.monotonically_increasing_id()), "vectors")

    sizes = entities.groupBy("kind").agg(F.count("*").alias("entities"))
    want = written(sizes.where(F.col("entities") > cell).select("kind", F.least(F.ceil(F.col("entities") / cell), F.lit(centres)).cast("int").alias("centres"), F.ceil(F.col("entities") / SLICE).cast("int").alias("slices")), "kinds")
    large = entities.join(want, "kind")
    # Centres: for each of a kind's hash slots the entity of the smallest hash. Kinds of one cell have none.
    slot = F.pmod(F.xxhash64("node", F.lit(3)), F.col("centres")).cast("long")
    chosen = large.withColumn("cell", slot).groupBy("kind", "cell").agg(F.min_by("unit", F.struct(F.xxhash64("node"), "node")).alias("centre"))
    chosen = written(chosen, "centres")

    def assign(key: tuple, some: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        some = some[["kind", "unit", "rep", "copies", "node"]]
        if not len(some):
            return some.assign(cell=pd.Series(dtype="int64"), far=pd.Series(dtype="float64"))
        around = around.sort_values("cell")
        c, number = np.stack(around.centre.to_numpy()), around.cell.to_numpy()
        at, far = np.zeros(len(some), np.int64), np.zeros(len(some))
        x = some.unit.to_numpy()
        for k in range(0, len(some), 1024):
            d = np.stack(x[k : k + 1024]) @ c.T
            at[k : k + 1024], far[k : k + 1024] = number[d.argmax(1)], np.sqrt(np.maximum(0, 2 - 2 * d.max(1)))
        return some.assign(cell=at, far=far, rep=some.rep.astype("Int64"))

    mine = large.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(9)), F.col("slices")).cast("int")).select("kind", "slice", "unit", "rep", "copies", "node")
    theirs = chosen.join(want, "kind").select("kind", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "cell", "centre")
    dealt = mine.groupBy("kind", "slice").cogroup(theirs.groupBy("kind", "slice")).applyInPandas(assign, "kind string, unit array<double>, rep long, copies long, node long, cell long, far double")
    alone = entities.join(want, "kind", "left_anti").select("kind", "unit", "rep", "copies", "node", F.lit(0).cast("long").alias("cell"), F.lit(2.0).alias("far"))
    placed = written(dealt.unionByName(alone), "cells")
    cells = placed.groupBy("kind", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
    parts = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("kind", "cell", "parts", "part", "radius")
    parts = written(parts.join(chosen, ["kind", "cell"], "left"), "parts")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    p, q = parts.alias("p"), parts.alias("q")
    dot = F.aggregate(F.zip_with("p.centre", "q.centre", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    later = (F.col("p.cell") < F.col("q.cell")) | ((F.col("p.cell") == F.col("q.cell")) & (F.col("p.part") <= F.col("q.part")))
    near = (F.col("p.cell") == F.col("q.cell")) | (F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("p.radius") + F.col("q.radius") + reach)
    meets = p.join(q, (F.col("p.kind") == F.col("q.kind")) & later).where(near)
    ends = meets.select("p.kind", F.col("p.cell").alias("c0"), F.col("p.part").alias("p0"), F.col("q.cell").alias("c1"), F.col("q.part").alias("p1"))
    tile = F.concat_ws("/", "kind", "c0", "p0", "c1", "p1")
    sides = written(
        ends.select("kind", tile.alias("tile"), F.col("c0").alias("cell"), F.col("p0").alias("part"), F.lit(0).alias("side"))
        .unionByName(ends.where("c0 <> c1 or p0 <> p1").select("kind", tile.alias("tile"), F.col("c1").alias("cell"), F.col("p1").alias("part"), F.lit(1).alias("side"))), "tiles",
    )
    dealt = placed.join(cells.select("kind", "cell", "parts"), ["kind", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))
    tiled = dealt.join(sides, ["kind", "cell", "part"]).select("tile", "side", F.col("node").alias("rep"), "copies", "unit")
    found = written(tiled.groupBy("tile").applyInPandas(_compare(threshold), "rep long, n long, other long"), "links")
    forget(placed, parts, sides, want, chosen)
    components = connected_components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    counts = found.where("other is null").groupBy("rep").agg(F.sum("n").alias("n")).withColumnRenamed("rep", "of")
    tied = entities.select("kind", "unit", "rep", "copies", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = tied.groupBy("component").agg(F.min("rep").alias("name"))
    label = (
        tied.join(names, "component").join(counts, tied.node == counts.of, "left")
        .select(F.col("kind").alias("of_kind"), F.col("unit").alias("of_unit"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("name").alias("component"))
    )
    out = kinds.join(label, (kinds.kind == label.of_kind) & (kinds.unit == label.of_unit), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
