"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersections.

A text's set holds the hashes of its distinct word shingles. Texts with equal sets are one entity from the start, so a
group of copies costs one comparison partner. Two sets that reach the threshold share one of the first
n - ceil(t n) + 1 elements of either, in any one order of all elements (prefix principle); those elements are the tile
keys. The order puts very frequent shingles last, so that lines and passages that many documents share make no tiles
unless a document has little else. Within a tile only sizes within the threshold's band meet; a signature of about one
parity bit per element bounds the overlap from above, and the pairs that are left are decided by exact intersection of
sorted arrays.

Large groups of near copies would meet in many tiles. So the first pass links each member of a tile with one pivot (the
member whose prefix is shared most) and the second pass compares only members of tiles that are still in different
components: exact, since every pair of one tile is either joined already or compared. A tile that is larger than a block is
cut: its largest component, within which nothing is left to compare, is dealt to blocks once, and only its other members
go to several blocks.

Memory of a task follows Arrow batches, which are bounded by bytes, a pool of `POOL` shingles, and its longest text (about
60 bytes a byte of it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bound_batches, connected_components, forget, release, written

#: The share of all shingle occurrences from which a shingle is ordered last is 1 / FREQUENT; so at most 2 * FREQUENT shingles are.
FREQUENT = 1 << 18
#: Rows of a block of a tile. Larger tiles are compared block by block.
BLOCK = 4096
#: Shingles that a task gathers before it tells the frequent ones among them.
POOL = 1 << 21


def _signature(s: np.ndarray) -> bytes:
    bits = 64
    while bits < len(s):
        bits *= 2
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _entity(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(tv.mix(np.array([tv.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _needed(n: np.ndarray | int, percent: int):
    """Least overlap of a set of n elements with any set that it links to."""
    return -(-percent * n // 100)


def _features(width: int, frequent: int):
    schema = pa.schema([("is_doc", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("entity", pa.int64()), ("bits", pa.binary())])

    def common(pool: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(pool), return_counts=True)
        keep = counts >= max(2, -(-sum(map(len, pool)) // frequent))
        if keep.any():
            n = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(keys[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64)), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a document, and one for each shingle that is frequent within a pool of them."""
        pool, size = [], 0
        for batch in batches:
            n, entity, bits = [], [], []
            for _, s in tv.shingle_sets(batch.column("text"), width):
                n.append(len(s))
                entity.append(_entity(s))
                bits.append(_signature(s))
                pool.append(s)
                size += len(s)
                if size >= POOL:
                    yield from common(pool)
                    pool, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(n), pa.bool_()), batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(entity, pa.int64()), pa.array(bits, pa.binary())], schema=schema)
        if size:
            yield from common(pool)
        pool = []
        release()

    return run


def _prefixes(width: int, percent: int, last):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, done = last.value, set()  # what was seen is only left out to save work; it is bounded
        for batch in batches:
            keys, entities, sizes = [], [], []
            for _, s in tv.shingle_sets(batch.column("text"), width):
                if not len(s) or (e := _entity(s)) in done:
                    continue
                if len(done) < 1 << 16:
                    done.add(e)
                first = len(s) - _needed(len(s), percent) + 1
                if len(late):
                    at = np.searchsorted(late, s)
                    hot = late[np.minimum(at, len(late) - 1)] == s
                    s = np.concatenate([s[~hot], s[hot]]) if hot.any() else s
                keys.append(s[:first])
                entities.append(e)
                sizes.append((len(s), first))
            k = np.array([x[1] for x in sizes], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.concatenate(keys) if keys else np.empty(0, np.uint64)).view(np.int64)),
                    pa.array(np.repeat(np.array(entities, np.int64), k)),
                    pa.array(np.repeat(np.array([x[0] for x in sizes], np.int32), k)),
                ],
                ["key", "entity", "n"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_entity(s), s.tobytes()) for _, s in tv.shingle_sets(batch.column("text"), width) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["entity", "elements"])

    return run


def _intersect(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _folded(bits: np.ndarray, to: int) -> np.ndarray:
    """Signatures (rows of bytes) as they would be with `to` bytes: parities of the halves add up."""
    while bits.shape[-1] > to:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _may_link(na, nb, odd, percent: int):
    """Whether sets of sizes na and nb whose signatures differ in `odd` bits can reach the threshold."""
    most = (na + nb - odd) // 2
    return 100 * most >= percent * (na + nb - most)


def tile_pairs(entity: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile that may link and are in different components. side 0 meets side 1; in a tile of one block all meet."""
    order = np.argsort(n, kind="stable")
    entity, n, component, side = entity[order], n[order], component[order], side[order]
    bits = [bits[i] for i in order]
    length = np.array([len(x) for x in bits])
    split = len(np.unique(side)) > 1
    bands = {}
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        bands[int(size)] = (rows, np.frombuffer(b"".join(bits[i] for i in rows), np.uint8).reshape(len(rows), size))
    a, b = [], []
    for i in range(1, len(n)):
        least = -(-percent * int(n[i]) // 100)
        own = np.frombuffer(bits[i], np.uint8)
        for size, (rows, matrix) in bands.items():
            if size > len(own):
                continue
            lo, hi = np.searchsorted(n[rows], least), np.searchsorted(rows, i)
            if lo >= hi:
                continue
            js = rows[lo:hi]
            odd = np.bitwise_count((matrix[lo:hi] ^ _folded(own, size)).view(np.uint64)).sum(1, dtype=np.int64)
            ok = _may_link(int(n[i]), n[js].astype(np.int64), odd, percent) & (component[js] != component[i])
            if split:
                ok &= side[js] != side[i]
            if ok.any():
                js = js[ok]
                a.append(np.minimum(entity[js], entity[i]))
                b.append(np.maximum(entity[js], entity[i]))
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _tiles(percent: int):
    def flush(t: pa.Table):
        n, entity, component, side = (t.column(c).to_numpy() for c in ("n", "entity", "component", "side"))
        tile = t.column("key").to_numpy(), t.column("i").to_numpy(), t.column("j").to_numpy()
        bits = t.column("bits").to_pylist()
        cut = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in tile])]))
        ends = np.append(cut[1:], len(n))
        a, b = [], []
        for s, e in zip(cut, ends, strict=True):
            if e - s > 1:
                x, y = tile_pairs(entity[s:e], n[s:e], component[s:e], side[s:e], bits[s:e], percent)
                a.append(x)
                b.append(y)
        if a and len(a := np.concatenate(a)):
            pairs = np.unique(np.stack([a, np.concatenate(b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by tile; the last tile of a batch waits for the next batch."""
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not len(t):
                continue
            keys = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            start = int(np.argmax(same))
            if start:
                yield from flush(t.slice(0, start))
            rest = t.slice(start).combine_chunks()
        if rest is not None and len(rest):
            yield from flush(rest)
        release()

    return run


def _labels(docs: DataFrame, percent: int, width: int, frequent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """features (doc_id, n, entity), a row for each row, and label (entity, component, first): the component's smallest doc_id, and the entity that has it."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = written(texts.mapInArrow(_features(width, frequent), "is_doc boolean, id long, n long, entity long, bits binary"), "features")
    features = made.where("is_doc").select(F.col("id").alias("doc_id"), "n", "entity", "bits")
    entities = written(features.where("n > 0").groupBy("entity").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bits").alias("bits")), "entities")

    total = features.agg(F.sum("n")).first()[0] or 0
    counted = made.where("not is_doc").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= max(16, -(-total // (2 * frequent))))
    last = np.sort(counted.select("id").toArrow().column("id").to_numpy().view(np.uint64))  # at most 2 * frequent rows, in one job
    last = spark.sparkContext.broadcast(last)

    # Both uses read all columns of one exchange, so that prefixes are made and moved once.
    prefixes = texts.mapInArrow(_prefixes(width, percent, last), "key long, entity long, n int").repartition("key")
    several = prefixes.groupBy("key").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"), F.max("n").alias("most")).where("lo <> hi and most > 0").select("key")
    shared = written(prefixes.join(several, "key", "left_semi"), "tiles")

    # First pass: each member of a tile with the tile's pivot.
    weight = shared.groupBy("entity", "n").agg((F.count("*") / F.col("n")).alias("share"))
    ranked = shared.join(weight.select("entity", "share"), "entity")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("share", "entity", "n")).alias("p"))
    close = F.col("n") * 100 >= F.col("p.n") * percent
    close = close & (F.col("p.n") * 100 >= F.col("n") * percent)
    stars = (
        shared.join(pivots, "key").where(close & (F.col("entity") != F.col("p.entity")))
        .select(F.least("entity", "p.entity").alias("a"), F.greatest("entity", "p.entity").alias("b")).distinct()
    )
    tried = _decided(texts, _bounded(stars, entities, percent), entities, width, percent)
    so_far = connected_components(tried.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))

    # Second pass: members of one tile that are still in different components.
    known = entities.select("entity").join(so_far, F.col("entity") == so_far.node, "left").select("entity", F.coalesce("component", "entity").alias("component"))
    rows = shared.join(known, "entity")
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("members"))
    bounds = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("members").alias("rows"), F.max(F.struct("members", "component")).alias("most")).where("parts > 1")
    rest = F.col("rows") - F.col("most.members")
    bounds = bounds.select("key", F.col("most.component").alias("main"), (F.col("rows") > block).alias("large"), F.ceil(F.col("most.members") / block).cast("int").alias("main_blocks"), F.ceil(rest / block).cast("int").alias("rest_blocks"))
    open_rows = rows.join(bounds, "key").dropDuplicates(["key", "entity"])
    at = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    zero, one = F.lit(0), F.lit(1)
    mine = F.pmod(F.xxhash64("entity"), F.col("rest_blocks")).cast("int") + 1
    # Cells (0, j) hold a block of the main component and all others, cells (i, j) from 1 on two blocks of the others.
    others = F.concat(F.transform(F.sequence(one, F.col("main_blocks")), lambda j: at(zero, j, one)), F.transform(F.sequence(one, F.col("rest_blocks")), lambda o: at(F.least(mine, o), F.greatest(mine, o), mine > o)))
    in_main = F.array(at(zero, F.pmod(F.xxhash64("entity"), F.col("main_blocks")) + 1, zero))
    cells = F.when(~F.col("large"), F.array(at(zero, zero, zero))).when(F.col("component") == F.col("main"), in_main).otherwise(others)
    laid = (
        open_rows.select("key", "entity", "n", "component", F.explode(cells).alias("cell")).select("key", "entity", "n", "component", "cell.*")
        .join(entities.select("entity", "bits"), "entity")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        .select("key", "i", "j", "n", "entity", "component", "side", "bits")
    )
    left = laid.mapInArrow(_tiles(percent), "a long, b long").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = _decided(texts, left, entities, width, percent)
    links = more.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    components = connected_components(so_far.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))

    # A component is named by its smallest doc_id; rows without one name none that has others.
    named = entities.select("entity", "rep").join(components, F.col("entity") == components.node, "left").select("entity", "rep", F.coalesce("component", "entity").alias("root"))
    names = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "entity")).alias("name")).select("root", F.col("name.rep").alias("component"), F.col("name.entity").alias("first"))
    label = written(named.select("entity", "root").join(names, "root").select("entity", "component", "first"), "components")
    forget(shared, tried, more, so_far, components, entities)
    return features.select("doc_id", "n", "entity"), label


def jaccard_components(docs: DataFrame, *, percent: int = 80, width: int = 5, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_shingles, set_id, component_id.

    Links: 100 * intersection >= percent * union of the sets of `width`-word shingles (fewer words: the whole text is
    one shingle). component_id is the smallest doc_id reachable by links. Null, empty and blank texts have an empty set,
    link with nothing and are their own component. Repeated rows and equal texts share a component, whatever their
    doc_id; different texts of one doc_id are linked only by what they say. A null doc_id takes part but never names a
    component that has others. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    features, label = _labels(docs, percent, width, frequent, block)
    label = label.select(F.col("entity").alias("of"), "component")
    return features.join(label, (features.entity == label.of) & (features.n > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("entity").alias("set_id"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _bounded(pairs: DataFrame, entities: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their signatures leave possible."""
    one = entities.select(F.col("entity").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    two = entities.select(F.col("entity").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "x", "y")), strict=True):
                size = min(len(x), len(y))
                odd = int.from_bytes(_folded(np.frombuffer(x, np.uint8), size).tobytes(), "little") ^ int.from_bytes(_folded(np.frombuffer(y, np.uint8), size).tobytes(), "little")
                keep.append(_may_link(na, nb, odd.bit_count(), percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _decided(texts: DataFrame, pairs: DataFrame, entities: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked) by exact intersection, written. Only one text of each set that takes part is read into arrays."""
    pairs = written(pairs, "candidates")
    taking = pairs.select(F.col("a").alias("entity")).unionByName(pairs.select(F.col("b").alias("entity"))).distinct()
    reps = entities.join(taking, "entity", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    sets = written(texts.join(reps, texts.doc_id.eqNullSafe(reps.doc_id), "left_semi").select("text").mapInArrow(_sets(width), "entity long, elements binary"), "sets")
    one = sets.join(taking, "entity", "left_semi").dropDuplicates(["entity"])
    done = (
        pairs.join(one.select(F.col("entity").alias("a"), F.col("elements").alias("x")), "a")
        .join(one.select(F.col("entity").alias("b"), F.col("elements").alias("y")), "b")
        .mapInArrow(_intersect(percent), "a long, b long, linked boolean")
    )
    out = written(done, "pairs")
    forget(pairs, sets)
    return out


def keep_one(docs: DataFrame, *, percent: int = 80, width: int = 5, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest doc_id stays.

    Rows of one doc_id with equal sets count as one document; with different sets they are judged apart, so no text is
    lost. Rows without doc_id are judged like others, and stay only where no row with a doc_id is linked with them. Texts
    without words all stay. All columns are kept, whatever their names; an empty table gives an empty result.
    """
    label = _labels(docs, percent, width, frequent, block)[1]
    stays = label.where("entity = first").select(F.col("entity").alias("kept_set"), F.col("component").alias("kept_id"))

    @F.arrow_udf("long")
    def set_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([_entity(s) if len(s) else None for _, s in tv.shingle_sets(part, width)], pa.int64())

    mine = "set_of_text"
    while mine in docs.columns:
        mine += "_"
    known = docs.withColumn(mine, set_of(F.col("text").cast("string")))
    words = known.where(F.col(mine).isNotNull())
    kept = words.join(stays, (F.col(mine) == F.col("kept_set")) & F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", mine]).select(*docs.columns).unionByName(known.where(F.col(mine).isNull()).select(*docs.columns))
