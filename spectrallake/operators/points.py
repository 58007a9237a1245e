"""Point sets: neighbours, neighbourhoods, radius joins, patches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import space
from .iterate import forget, settled


def _cells(p: DataFrame, size: float) -> DataFrame:
    return p.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})


def radius_pairs(p: DataFrame, radius: float) -> DataFrame:
    """Pairs i < j of points(id, x, y) less than radius apart: i, j, d.

    Points meet in cells of the radius' size: each looks into its own and half of the eight cells around, so a pair is
    found once, and cells are the keys of the shuffle.
    """
    a = _cells(p.select("id", "x", "y"), radius)
    ahead = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = a.withColumn("n", F.explode(ahead)).select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), (F.col("gx") + F.col("n.dx")).alias("gx"), (F.col("gy") + F.col("n.dy")).alias("gy"), (F.abs("n.dx") + F.abs("n.dy") == 0).alias("own"))
    right = a.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), "gx", "gy")
    d = F.sqrt((F.col("xi") - F.col("xj")) ** 2 + (F.col("yi") - F.col("yj")) ** 2)
    pairs = left.join(right, ["gx", "gy"]).where("not own or i < j").withColumn("d", d).where(F.col("d") < radius)
    return pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d").where("i < j")


def _top(best: tuple[np.ndarray, ...], k: int, n: int) -> tuple[np.ndarray, ...]:
    """Of (row, d, id, index) those of the k least (d, id) of each row below n, in order, with their rank."""
    row, d, ids, index = best
    order = np.lexsort((ids, d, row))
    row, d, ids, index = row[order], d[order], ids[order], index[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    keep = rank < k
    return row[keep], d[keep], ids[keep], index[keep], rank[keep]


def _blocks(xy: np.ndarray, size: int) -> list[np.ndarray]:
    """Indices in blocks of at most `size` that lie close together."""
    out, todo = [], [np.arange(len(xy))]
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(part)
            continue
        p = xy[part]
        half = len(part) // 2
        order = np.argpartition(p[:, np.argmax(np.ptp(p, 0))], half)
        todo += [part[order[half:]], part[order[:half]]]
    return [b for b in out if len(b)]


def nearest(xy: np.ndarray, ids: np.ndarray, at: np.ndarray, own: np.ndarray, k: int, include_self: bool, reach: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, ...]:
    """(row of at, d, id, index into xy, rank) of the k nearest of xy to each of at, no farther than reach; ties: smaller id.

    Blocks of questions look at blocks of points in the order of the distance of their boxes, until none can hold a nearer one.
    """
    near = _blocks(xy, 4 * block)
    low, high = (np.array([f(xy[b], 0) for b in near]).reshape(-1, 2) for f in (np.min, np.max))
    out = []
    for rows in _blocks(at, block):
        q, n = at[rows], len(rows)
        most = np.full(n, np.inf) if reach is None else reach[rows].copy()
        gap = np.maximum(np.maximum(low - q.max(0), q.min(0) - high), 0)
        far = np.sqrt((gap**2).sum(1)) * (1 - 1e-12)
        best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        for b in np.argsort(far):
            if far[b] > most.max():
                break
            part = near[b]
            dx, dy = q[:, :1] - xy[part, 0], q[:, 1:] - xy[part, 1]
            d = np.sqrt(dx * dx + dy * dy)
            if not include_self:
                d[ids[part] == own[rows][:, None]] = np.inf
            limit = np.minimum(most, np.partition(d, k - 1, 1)[:, k - 1]) if len(part) > k else most
            row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            best = tuple(np.concatenate(pair) for pair in zip(best, (row, d[row, col], ids[part[col]], part[col]), strict=True))
            *best, rank = _top(best, k, n)
            best = tuple(best)
            last = rank == k - 1
            most[best[0][last]] = np.minimum(most[best[0][last]], best[1][last])
        row, d, found, index, rank = _top(best, k, n)
        out.append((rows[row], d, found, index, rank))
    empty = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(parts) for parts in zip(*(out or [empty]), strict=True))


_FOUND = "i long, rank int, j long, d double, dx double, dy double"


def knn(queries: DataFrame, p: DataFrame, k: int, *, include_self: bool = True, cell: int = space.CELL) -> DataFrame:
    """The k nearest points of p(id, x, y) to each of queries(id, x, y): i, rank (from 0), j, d, dx, dy. Ties: smaller id.

    Points lie in cells of about `cell` each, cut at medians of a sample. A question is answered in its own cell first;
    then those whose k-th distance reaches the box of another cell ask there too, and only these are merged. Cells asked
    very often are dealt to several tasks. Of a place with many points only the k + 1 smallest ids can be anyone's
    neighbours, so cells that such places fill are thinned to these. Points without finite coordinates are no
    neighbours, and questions without them get no answer. Ids are distinct.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    pick = lambda t: space.finite(t.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "x", "y")
    points, asked = pick(p), pick(queries)
    n = points.count()
    if not n:
        return asked.sparkSession.createDataFrame([], _FOUND)
    cells = space.cells_of(points, n, cell=cell)
    where = cells.column("x", "y")
    placed, asked = points.withColumn("cell", where), asked.withColumn("cell", where)
    boxes = None
    if cells.depth:
        placed, asked = settled(placed, "points"), settled(asked, "questions")
        boxes = space.boxes_of(placed, cells)
        full = np.flatnonzero(boxes.count > 4 * cell)
        if len(full):
            same = F.row_number().over(Window.partitionBy("cell", "x", "y").orderBy("id"))
            crowded = F.col("cell").isin([int(c) for c in full])
            thin = settled(placed.where(~crowded).unionByName(placed.where(crowded).withColumn("same", same).where(F.col("same") <= k + 1).drop("same")), "points")
            forget(placed)
            placed, boxes = thin, space.boxes_of(thin, cells)

    def answers(q: pd.DataFrame, near: pd.DataFrame, reach: np.ndarray | None) -> pd.DataFrame:
        at, xy = q[["x", "y"]].to_numpy(), near[["x", "y"]].to_numpy()
        ids = q["id"].to_numpy()
        row, d, j, index, rank = nearest(xy, near["id"].to_numpy(), at, ids, k, include_self, reach)
        return pd.DataFrame({"i": ids[row], "rank": rank.astype(np.int32), "j": j, "d": d, "dx": at[row, 0] - xy[index, 0], "dy": at[row, 1] - xy[index, 1], "row": row})

    def first(q: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        """Answers of the own cell; rows with a cell are questions to it, with their place in dx, dy and how far they look in d."""
        if not len(q):
            return pd.DataFrame({c: [] for c in ("i", "rank", "j", "d", "dx", "dy", "cell", "open")})
        out = answers(q, near, None)
        if boxes is None:
            return out.drop(columns="row").assign(cell=-1, open=False)
        at, reach = q[["x", "y"]].to_numpy(), np.full(len(q), np.inf)
        last = out["rank"].to_numpy() == k - 1
        reach[out["row"].to_numpy()[last]] = out["d"].to_numpy()[last]
        lost = np.flatnonzero(np.isinf(reach))
        reach[lost] = boxes.reach_of(at[lost], k + (not include_self))
        row, to = boxes.within(at, reach)
        other = to != q["cell"].to_numpy()[row]
        row, to = row[other], to[other]
        is_open = np.zeros(len(q), bool)
        is_open[row] = True
        asks = pd.DataFrame({"i": q["id"].to_numpy()[row], "rank": -1, "j": -1, "d": reach[row], "dx": at[row, 0], "dy": at[row, 1], "cell": to, "open": True})
        out = out.assign(cell=-1, open=is_open[out["row"].to_numpy()]).drop(columns="row")
        return pd.concat([out, asks]) if len(asks) else out

    def more(q: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        return answers(q, near, q["reach"].to_numpy()).drop(columns="row")

    def met(q: DataFrame, fn, schema: str) -> DataFrame:
        q, near = space.dealt(q, placed, 8 * cell, "id")
        return q.groupBy("cell", "part").cogroup(near.groupBy("cell", "part")).applyInPandas(fn, schema)

    found = met(asked, first, _FOUND + ", cell int, open boolean")
    columns = ["i", "rank", "j", "d", "dx", "dy"]
    if boxes is None:
        return found.select(*columns)
    found = settled(found, "neighbours")
    asks = found.where("cell >= 0").select(F.col("i").alias("id"), F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("d").alias("reach"), "cell")
    both = found.where("cell < 0 and open").select(*columns).unionByName(met(asks, more, _FOUND).select(*columns))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j")) - 1).where(F.col("rank") < k)
    return found.where("cell < 0 and not open").select(*columns).unionByName(ranked.select(*columns))


def neighbour_types(neighbours: DataFrame, p: DataFrame) -> DataFrame:
    return neighbours.join(p.select(F.col("id").alias("j"), "type"), "j").select("i", "rank", "j", "type")


def border_flag(x: Column, y: Column, width: float, height: float, border: float = 0.03) -> Column:
    inside = (x > border * width) & (x < width - border * width) & (y > border * height) & (y < height - border * height)
    return ~inside


def border_band(x: Column, y: Column, width: float, height: float, pixels: float) -> Column:
    """Whether a point lies within so many pixels of the image's edge."""
    return ~((x > pixels) & (x < width - pixels) & (y > pixels) & (y < height - pixels))


def interior(x: Column, y: Column, width: float, height: float, window: float) -> Column:
    return (x > window) & (y > window) & (width - x > window) & (height - y > window)


def neighbourhood(neighbours: DataFrame) -> DataFrame:
    """i, place, j, d, angle, dx, dy: neighbours by angle. Vectors point from the neighbour to the atom."""
    angle = F.atan2("dy", "dx")
    return neighbours.withColumn("angle", angle).withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy("angle", "j")) - 1).select("i", "place", "j", "d", "angle", "dx", "dy")


def merged_within(p: DataFrame, radius: float) -> DataFrame:
    """Each point moved to the mean of all points within the radius, itself included: id, x, y, n."""
    pairs = radius_pairs(p, radius)
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(p.select(F.col("id").alias("i"), F.col("id").alias("j")))
    return both.join(p.select(F.col("id").alias("j"), "x", "y"), "j").groupBy(F.col("i").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


#: Spots of a block, about, at least and at most; tasks that blocks are to make: the pairs of two blocks of a group are made in one.
BLOCK, MOST_BLOCK, PAIR_TASKS = 2048, 1 << 16, 1024


def midpoints(spots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Midpoints of all pairs of spots(id, x, y), themselves included: i, j, x, y; with a column g, of the pairs within each g.

    A large group is dealt to blocks by a hash of the id, and each block meets each: a spot goes to as many tasks as its
    group has blocks, and no task has a whole group. Blocks are as large as leaves PAIR_TASKS tasks of about equal numbers of
    pairs, up to MOST_BLOCK spots, so what is shuffled grows with the spots. The result has a row for each pair all the same.
    """
    g = [c for c in ("g",) if c in spots.columns]
    one, other = (spots.select(*g, F.col("id").alias(i), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i in "ij")
    if g:
        groups, most, made = spots.where("g is not null").groupBy("g").count().agg(F.count("*"), F.max("count"), F.sum(F.col("count").cast("double") ** 2)).first()
        if (most or 0) > block:
            n = math.ceil(most / min(max(block, math.sqrt(made / PAIR_TASKS)), MOST_BLOCK))
            every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
            mine = lambda k: F.pmod(F.xxhash64(k), F.lit(n)).cast("int")
            one, other = one.withColumn("bi", mine("i")).withColumn("bj", every), other.withColumn("bj", mine("j")).withColumn("bi", every)
            g_keys = [*g, "bi", "bj"]
            # Blocks are few bytes and many pairs, so they are not left to be put together by their bytes.
            one, other = (t.repartition(min(groups * n * n, PAIR_TASKS), *g_keys) for t in (one, other))
        else:
            g_keys = g
    pairs = one.join(other, g_keys) if g else one.crossJoin(other)
    return pairs.select(*g, "i", "j", ((F.col("xi") + F.col("xj")) / 2).alias("x"), ((F.col("yi") + F.col("yj")) / 2).alias("y"))


def patches(long: DataFrame, atoms: DataFrame, radius: int) -> DataFrame:
    """Pixels of each atom's patch: atoms(img, atom_id, x, y) with whole x (row), y (column) -> img, atom_id, dr, dc, v. An equi-join on the pixel."""
    offsets = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)])
    wanted = atoms.withColumn("o", F.explode(offsets)).select("img", "atom_id", F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), (F.col("x") + F.col("o.dr")).alias("r"), (F.col("y") + F.col("o.dc")).alias("c"))
    return wanted.join(long, ["img", "r", "c"]).select("img", "atom_id", "dr", "dc", "v")


def intensity_area(long: DataFrame, atoms: DataFrame, radius: int) -> DataFrame:
    """Sum and maximum of the disk around each atom; -1 where it goes over the edge of the image: img, atom_id, intensity, maximum."""
    disk = patches(long, atoms, radius).where(F.col("dr") ** 2 + F.col("dc") ** 2 < radius * radius)
    full = sum(1 for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b < radius * radius)
    got = disk.groupBy("img", "atom_id").agg(F.sum("v").alias("s"), F.max("v").alias("m"), F.count("*").alias("n"))
    ok = F.coalesce(F.col("n") == full, F.lit(False))
    return atoms.select("img", "atom_id").join(got, ["img", "atom_id"], "left").select("img", "atom_id", F.when(ok, F.col("s")).otherwise(-1.0).alias("intensity"), F.when(ok, F.col("m")).otherwise(-1.0).alias("maximum"))


def intensity_gate(long: DataFrame, atoms: DataFrame, radius: int, min_int: float = 0.0, max_int: float = 0.0) -> DataFrame:
    """img, atom_id, total, kept: whether the sum of the square patch around an atom is over min_int and, where max_int is over 0, under max_int.

    Atoms whose patch goes over the edge of the image have the sum of the pixels that it holds.
    """
    sums = patches(long, atoms, radius).groupBy("img", "atom_id").agg(F.sum("v").alias("total"))
    out = atoms.select("img", "atom_id").join(sums, ["img", "atom_id"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    ok = F.col("total") > min_int
    return out.withColumn("kept", ok & (F.col("total") < max_int) if max_int > 0 else ok)


def neighbour_rows(neighbours: DataFrame, k: int) -> DataFrame:
    """A row for each atom with k neighbours: id, d, angle, dx, dy as arrays in order of the angle."""
    placed = neighbourhood(neighbours).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("place", "d", "angle", "dx", "dy"))).alias("n"))
    return placed.where(F.size("n") == k).select(F.col("i").alias("id"), *[F.col(f"n.{c}").alias(c) for c in ("d", "angle", "dx", "dy")])


def interleaved(rows: DataFrame) -> DataFrame:
    """id, data: dx and dy of each neighbour in turn; the row of the largest id is left out, as the original does."""
    data = F.flatten(F.zip_with("dx", "dy", lambda a, b: F.array(a, b)))
    last = rows.agg(F.max("id").alias("last_id"))
    return rows.join(F.broadcast(last), F.col("id") < F.col("last_id")).select("id", data.alias("data"))
