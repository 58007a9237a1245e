"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index of all their words.

Examples are a bounded sample of labelled documents; every word of theirs is in the index. Labels weigh words and drop
none: besides its idf, a word counts the more, the more it leans to toxic examples, by its log odds and by how sure they
are (the log-likelihood ratio). Equal vectors are one entry of the index with the counts of its members. Entries lie in blocks
of entries with like words, and the index holds the largest share of every word in every block. The sum of a text's
largest shares bounds all cosines within a block from above: a text opens the block of the greatest bound first, and then
only blocks whose bound reaches the k-th cosine found so far, so the result is exact. Postings are read for open blocks
only; words that many entries of a block have are stored as rows over the block, so that texts that open a block together
are one matrix product, in single precision; what may be among the nearest is summed up in double precision. Entries vote with their members' labels, weighted by similarity; the vote is turned
into a probability by isotonic regression on leave-one-out votes of the examples. The nearest members are the evidence.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bound_batches, crc32_of, forget, one_blas_thread, release, written

#: Most labelled documents used as examples, half of them toxic at most.
SAMPLE = 20_000
#: Most examples whose leave-one-out votes calibrate, half of them toxic at most: those of the smallest hashes.
CALIBRATED = 4_000
#: The log-likelihood ratio at which a term counts half its idf, and the least share of it that any term counts.
MIDDLE, LEAST_SHARE = 20.0, 0.01
#: Entries of a block; a word of so many entries of a block is a row over the block; texts that are searched together.
BLOCK, ROW, TOGETHER = 512, 64, 64
#: Kinds of entries that blocks are filled by, told apart by so many most common words.
KINDS, COMMON = 8, 256
#: What a sum in single precision may be off by.
LOOSE = 1e-5
NEAREST = 15
#: Cosines are rounded to so many digits before they are compared, so that the order of a sum does not break ties.
DIGITS = 12

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 with the upper-case letters of U+00C0 to U+00DE as lower case; range_hashes folds A-Z itself."""
    upper = np.zeros(len(data), bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return np.where(upper, data + np.uint8(0x20), data)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word: a run of ASCII letters and digits and of all non-ASCII characters."""
    data = _lowered(data)
    starts, ends, rows = tv.runs(data, offsets, _WORD)
    return tv.range_hashes(data, starts, ends), rows


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + size[0] - 1, first[1], ..."""
    some = size > 0
    if not some.all():
        first, size = first[some], size[some]
    if not len(first):
        return np.empty(0, np.int32)
    ends = np.cumsum(size)
    steps = np.ones(ends[-1], np.int32)
    steps[0] = first[0]
    steps[ends[:-1]] = first[1:] - first[:-1] - size[:-1] + 1
    return np.cumsum(steps, dtype=np.int32)


@dataclass
class Index:
    terms: np.ndarray  # sorted term hashes
    weight: np.ndarray  # of each term: idf times the share that labels give it
    n_entries: int = 0
    start: np.ndarray = None  # postings of term t: start[t] to start[t + 1], by entry
    post_entry: np.ndarray = None
    post_tf: np.ndarray = None
    norm: np.ndarray = None  # of each entry
    toxic: np.ndarray = None  # weight of the toxic and of all members of an entry; the last is the zero vector's
    total: np.ndarray = None
    first_id: np.ndarray = None
    entry_of: dict = field(default_factory=dict)  # by digest of the vector
    prior: float = 0.0
    steps: tuple = ((0.0, 1.0), (0.0, 1.0))  # calibration: votes, probabilities
    shared: Broadcast = None
    n_blocks: int = 0
    # Made where it is used: of each common word (one with rows) its largest share in
    # each block; of each block its rows and whose they are; and thin slices, the postings of a word in a block without row.
    common_of: np.ndarray = None
    most: np.ndarray = None
    rows: list = None
    row_words: list = None
    thin_start: np.ndarray = None
    thin_block: np.ndarray = None
    thin_most: np.ndarray = None
    thin_at: np.ndarray = None
    thin_size: np.ndarray = None
    thin_value: np.ndarray = None
    thin_entry: np.ndarray = None
    opened: int = 0
    asked: int = 0

    def __getstate__(self) -> dict:
        """What workers can't make themselves, in few bytes: every executor has a copy on its disk."""
        made = dict.fromkeys(("common_of", "most", "rows", "row_words", "thin_start", "thin_block", "thin_most", "thin_at", "thin_size", "thin_value", "thin_entry", "shared"))
        small = {"terms": self.terms, "weight": self.weight.astype(np.float32), "post_tf": zlib.compress(self.post_tf.astype("<i4").tobytes(), 1)}
        return self.__dict__ | small | made

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.weight = self.weight.astype(np.float64)
        self.post_tf = np.frombuffer(zlib.decompress(self.post_tf), "<i4")
        self.sent = True

    def ready(self) -> Index:
        """Make what a search reads; where the index was sent, what it was made of is freed."""
        if self.rows is not None:
            return self
        one_blas_thread()
        df = np.diff(self.start)
        value = np.repeat(self.weight.astype(np.float32), df)
        value *= 1 + np.log(self.post_tf, dtype=np.float32)
        value /= self.norm.astype(np.float32)[self.post_entry]
        self.n_blocks = blocks = -(-self.n_entries // BLOCK)
        # Slices: postings of one term within one block.
        block = (self.post_entry // BLOCK).astype(np.uint16 if blocks < 1 << 16 else np.int32)
        inside = (self.post_entry % BLOCK).astype(np.int16)
        first = np.ones(len(block), bool)
        first[1:] = block[1:] != block[:-1]
        first[self.start[:-1][df > 0]] = True
        at = np.flatnonzero(first).astype(np.int32)
        del first
        size = np.diff(np.append(at, np.int32(len(block))))
        of = np.searchsorted(self.start, at, "right").astype(np.int32) - 1
        most = np.maximum.reduceat(value, at) if len(at) else value
        where = block[at]
        del block
        if getattr(self, "sent", False):
            self.post_entry = self.post_tf = None
        thick = size >= ROW
        common = np.unique(of[thick])
        self.common_of = np.full(len(self.terms), -1, np.int32)
        self.common_of[common] = np.arange(len(common))
        self.most = np.zeros((len(common), blocks), np.float32)
        mine = self.common_of[of] >= 0
        self.most[self.common_of[of[mine]], where[mine]] = most[mine]
        del mine
        rows, self.row_words = [], []
        wide = np.flatnonzero(thick)
        wide = wide[np.argsort(where[wide], kind="stable")]
        ends = np.searchsorted(where[wide], np.arange(blocks + 1))
        for b in range(blocks):
            part = wide[ends[b] : ends[b + 1]]
            posts = _spread(at[part], size[part])
            row = np.zeros((len(part), BLOCK), np.float32)
            row[np.repeat(np.arange(len(part)), size[part]), inside[posts]] = value[posts]
            rows.append(row)
            self.row_words.append(self.common_of[of[part]])
        # Thin slices keep the order of words; their postings lie block by block, so that an open block's are close together.
        thin = ~thick
        self.thin_start = np.searchsorted(of[thin], np.arange(len(self.terms) + 1)).astype(np.int32)
        del of
        self.thin_block, self.thin_most, self.thin_size, at = where[thin], most[thin], size[thin], at[thin]
        del where, most, size
        by_block = np.argsort(self.thin_block, kind="stable").astype(np.int32)
        ends = np.cumsum(self.thin_size[by_block], dtype=np.int32)
        self.thin_at = np.empty(len(at), np.int32)
        self.thin_at[by_block] = ends - self.thin_size[by_block]
        posts = _spread(at[by_block], self.thin_size[by_block])
        self.thin_value, self.thin_entry = value[posts], inside[posts]
        self.thin_size = self.thin_size.astype(np.uint8)  # less than ROW
        self.rows = rows
        if getattr(self, "sent", False):
            del value, inside, posts, by_block, ends, at, thin, thick
            release()
        return self

    def weights(self, cut: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Components of unit vectors: those of text q are cut[q] to cut[q + 1]."""
        w = (1 + np.log(tf)) * self.weight[at]
        of = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        return w / np.sqrt(np.bincount(of, w * w, len(cut) - 1))[of]

    def search(self, cut: np.ndarray, at: np.ndarray, w: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, entry, cosine) of the k entries of greatest cosine over 0 for each text (ties: first in order), exactly."""
        self.ready()
        n, blocks = len(cut) - 1, self.n_blocks
        of = np.repeat(np.arange(n), np.diff(cut))
        column = self.common_of[at]
        common = column >= 0
        dense = np.zeros((n, len(self.most)))
        dense[of[common], column[common]] = w[common]
        size = self.thin_start[at + 1] - self.thin_start[at]
        s = _spread(self.thin_start[at], size)
        order = np.argsort(self.thin_block[s], kind="stable")
        s, pair = s[order], np.repeat(np.arange(len(at)), size)[order]
        by, share = of[pair], w[pair]
        where = self.thin_block[s].astype(np.int64)
        # Common words are bounded by `most`, which covers their thin slices too.
        alone = ~common[pair]
        single = dense.astype(np.float32)
        bound = single @ self.most + np.bincount(by[alone] * blocks + where[alone], share[alone] * self.thin_most[s[alone]], n * blocks).reshape(n, blocks)
        bound = bound * (1 + 1e-9) + LOOSE
        ends = np.searchsorted(where, np.arange(blocks + 1))
        top, least = np.zeros((n, k)), np.zeros(n)  # the k-th cosine is at least `least`
        found: list[tuple] = []
        place = np.full(n, -1)

        def open_block(b: int, texts: np.ndarray) -> None:
            self.opened += len(texts)
            total = (single[texts[:, None], self.row_words[b]] @ self.rows[b]).astype(np.float64)
            place[texts] = np.arange(len(texts))
            part = slice(ends[b], ends[b + 1])
            row = place[by[part]]
            place[texts] = -1
            use = row >= 0
            sl, row, x = s[part][use], row[use], share[part][use]
            size = self.thin_size[sl].astype(np.int32)
            posts = _spread(self.thin_at[sl], size)
            cell = np.repeat((row * BLOCK).astype(np.int32), size)
            cell += self.thin_entry[posts]
            part = np.repeat(x, size)
            part *= self.thin_value[posts]
            thin = np.bincount(cell, part, total.size).reshape(total.shape)
            total += thin
            # The k largest sums so far, of which the smallest is a bound for all further blocks.
            largest = np.concatenate([top[texts], total if k >= BLOCK else np.partition(total, BLOCK - k, 1)[:, BLOCK - k :]], 1)
            top[texts] = np.partition(largest, largest.shape[1] - k, 1)[:, largest.shape[1] - k :]
            least[texts] = top[texts].min(1) - LOOSE
            i, j = np.nonzero((total >= least[texts, None]) & (total > 0))
            found.append((texts[i], j + b * BLOCK, total[i, j], thin[i, j]))

        if blocks:
            self.asked += n * blocks
            some = np.diff(cut) > 0
            best = bound.argmax(1)
            for b in np.unique(best[some]):
                open_block(b, np.flatnonzero((best == b) & some))
            for b in np.argsort(-bound.sum(0), kind="stable"):
                texts = np.flatnonzero((bound[:, b] >= least) & (best != b) & some)
                if len(texts):
                    open_block(b, texts)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, e, c, thin = (np.concatenate([f[k] for f in found]) for k in range(4))
        # Single precision orders what was found; what may be among the nearest by it is summed up again.
        order = np.lexsort((-c, q))
        start = np.searchsorted(q[order], np.arange(n + 1))
        full = np.flatnonzero(np.diff(start) >= k)
        least[full] = np.maximum(least[full], c[order[start[full] + k - 1]] - 2 * LOOSE)
        stay = np.flatnonzero(c >= least[q])
        stay = stay[np.argsort(e[stay], kind="stable")]
        q, e, c = q[stay], e[stay], thin[stay]
        ends = np.searchsorted(e, np.arange(blocks + 1) * BLOCK)
        for b in np.flatnonzero(np.diff(ends)):
            mine = slice(ends[b], ends[b + 1])
            c[mine] += np.einsum("ij,ij->i", dense[q[mine, None], self.row_words[b]], self.rows[b].T[e[mine] - b * BLOCK])
        c = np.round(c, DIGITS)
        order = np.lexsort((e, -c, q))
        q, e, c = q[order], e[order], c[order]
        stay = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[stay], e[stay], c[stay]

    def votes(self, cut: np.ndarray, at: np.ndarray, tf: np.ndarray, own: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weighted share of toxic members among the nearest, a number a text, and (text, entry, cosine); own (entry, toxic, total) is left out."""
        n = len(cut) - 1
        q, e, s = self.search(cut, at, self.weights(cut, at, tf))
        none = np.flatnonzero(np.diff(cut) == 0)  # texts without a known word are like the entry that has none
        q, e, s = np.concatenate([q, none]), np.concatenate([e, np.full(len(none), self.n_entries)]), np.concatenate([s, np.ones(len(none))])
        order = np.argsort(q, kind="stable")
        q, e, s = q[order], e[order], s[order]
        toxic, total = self.toxic[e], self.total[e]
        if own is not None:
            same = e == own[0][q]
            toxic, total = toxic - same * own[1][q], total - same * own[2][q]
        # Closeness counts, and the number of members only as its root, so that one very common vector does not outvote nearer ones.
        scale = s**4 / np.sqrt(np.maximum(total, 1))
        vote = (np.bincount(q, scale * toxic, n) + self.prior) / (np.bincount(q, scale * total, n) + 1)
        return vote, q, e, s

    def probability(self, vote: np.ndarray) -> np.ndarray:
        return np.interp(vote, *self.steps)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps of y over x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        if blocks and blocks[-1][1] == a:
            blocks[-1][2] += b * w
            blocks[-1][3] += w
        else:
            blocks.append([a, a, b * w, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    xs = np.array([v for lo, hi, _, _ in blocks for v in (lo, hi)])
    return xs, np.repeat([s / w for _, _, s, w in blocks], 2)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that have it, toxic ones among them) of each slice of a batch."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        for first, data, offsets in tv.slices(batch.column("text")):
            h, rows = _terms(data, offsets)
            order = np.lexsort((rows, h))
            h, rows = h[order], rows[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))) if len(h) else np.empty(0, bool)
            terms, at = np.unique(h[new], return_inverse=True)
            toxic = np.bincount(at, label[first + rows[new]], len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.bincount(at, minlength=len(terms))), pa.array(toxic)], ["term", "docs", "toxic"])


def _vectors(terms: np.ndarray, texts: pa.Array, together: int = TOGETHER) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, cut, positions in terms, term frequencies) of up to `together` texts at a time; text k has cut[k] to cut[k + 1]."""
    for first, data, offsets in tv.slices(texts):
        size = len(offsets) - 1
        of = at = tf = np.empty(0, np.int64)
        if len(terms):
            h, rows = _terms(data, offsets)
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            ok = terms[at] == h
            code, tf = np.unique(rows[ok] * len(terms) + at[ok], return_counts=True)
            of, at = np.divmod(code, len(terms))
        cut = np.searchsorted(of, np.arange(size + 1))
        for k in range(0, size, together):
            end = min(size, k + together)
            yield first + k, cut[k : end + 1] - cut[k], at[cut[k] : cut[end]], tf[cut[k] : cut[end]]


def _packed(x) -> bytes:
    return np.asarray(x, "<i4").tobytes()


def _digest(at: bytes, tf: bytes) -> bytes:
    return hashlib.blake2b(at + tf, digest_size=16).digest()


def _example_vectors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_packed(at[a:b]), _packed(tf[a:b])) for _, cut, at, tf in _vectors(shared.value, batch.column("text")) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array([x[k] for x in found], pa.binary()) for k in (0, 1))], ["doc_id", "label", "at", "tf"])

    return run


def _own_votes(shared, stands_for: dict[int, float], stands_for_all: dict[int, float]):
    """(vote, label, mass) of examples among all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            mass = np.array([stands_for.get(int(x), 1.0) for x in labels])
            votes = np.zeros(len(labels))
            for first, cut, at, tf in _vectors(index.terms, batch.column("text")):
                mine = slice(first, first + len(cut) - 1)
                own = np.array([index.entry_of.get(_digest(_packed(at[a:b]), _packed(tf[a:b])), index.n_entries) for a, b in zip(cut[:-1], cut[1:], strict=True)])
                votes[mine] = index.votes(cut, at, tf, (own, labels[mine] * mass[mine], mass[mine]))[0]
            all_mass = np.array([stands_for_all.get(int(x), 1.0) for x in labels])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (votes, labels, all_mass)], ["vote", "label", "mass"])
        release()

    return run


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label) of at most `sample` labelled documents, and how many documents each example of a label stands for.

    Held-out documents (crc32 of doc_id as text divisible by 5) are never examples. A document with several labels is
    toxic if one of them says so; null labels and null doc_ids are left out.
    """
    one = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.pmod(crc32_of(F.col("doc_id").cast("long")), F.lit(5)) != 0))
    one = written(one.groupBy(F.col("doc_id").cast("long").alias("example")).agg(F.max(F.col("toxic").cast("int")).alias("label")), "toxic-labels")
    sizes = {r.label: r.n for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rank = (F.xxhash64("example"), F.col("example"))
    chosen = one.where("label = 1").orderBy(*rank).limit(sample // 2).unionByName(one.where("label = 0").orderBy(*rank).limit(sample - sample // 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("example")).select("doc_id", "text", "label")
    # A doc_id may repeat among the documents: of its rows only one is an example, so that the bound holds.
    found = found.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("label").alias("label"))
    most = {1: sample // 2, 0: sample - sample // 2}
    found = written(found, "toxic-examples")
    forget(one)
    return found, {k: max(1.0, n / most[k]) for k, n in sizes.items()}


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, calibrated: int = CALIBRATED) -> Index:
    """The index over at most `sample` labelled documents, calibrated on at most `calibrated` of them. What comes to the driver is bounded by their terms.

    Without labels, or with one label only, every score is the share of toxic examples (0 without any). Null and empty
    texts may be examples: they are the entry without words.
    """
    bound_batches(docs.sparkSession)
    found, stands_for = examples(docs, labels, sample)
    context = docs.sparkSession.sparkContext
    n = {r.label: r.n for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    counts = found.select("text", "label").mapInArrow(_term_counts, "term long, docs long, toxic long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    if n0 and n1:
        got = counts.toArrow()
        term, having, toxic = (got.column(c).to_numpy() for c in ("term", "docs", "toxic"))
        del got
    else:
        term, having, toxic = (np.empty(0, np.int64) for _ in range(3))
    order = np.argsort(term.view(np.uint64))
    terms, having, toxic = term[order].view(np.uint64), having[order].astype(float), toxic[order].astype(float)
    share = _share(having, toxic, n0, n1)
    index = Index(terms, (np.log((1 + n0 + n1) / (1 + having)) + 1) * share)
    shared = context.broadcast(index.terms)
    rows = found.mapInArrow(_example_vectors(shared), "doc_id long, label int, at binary, tf binary").toArrow()  # at most `sample` rows
    shared.unpersist()
    index = _filled(index, *_flat(rows), stands_for)
    del rows
    index.shared = context.broadcast(index)
    index.post_entry = index.post_tf = None  # workers have their copies
    rank = (F.xxhash64("doc_id", F.lit(3)), F.col("doc_id"))
    most = {k: min(n.get(k, 0), calibrated // 2) for k in (0, 1)}
    # An example that calibrates stands for all of its label.
    stands_for_all = {k: stands_for.get(k, 1.0) * n[k] / most[k] for k in (0, 1) if most[k]}
    asked = found.where("label = 1").orderBy(*rank).limit(max(1, most[1])).unionByName(found.where("label = 0").orderBy(*rank).limit(max(1, most[0])))
    asked = written(asked, "toxic-calibration").repartition(context.defaultParallelism)
    votes = asked.mapInArrow(_own_votes(index.shared, stands_for, stands_for_all), "vote double, label double, mass double").toArrow()
    if len(votes):
        index.steps = isotonic(*(votes.column(c).to_numpy() for c in ("vote", "label", "mass")))
    forget(found, asked)
    return index


def _share(having: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """How much of a term's idf counts: g / (g + MIDDLE) * l^2 / (1 + l^2), LEAST_SHARE at least.

    g is the log-likelihood ratio of its documents by label, l the part over 0 of its log odds of toxic documents against
    all terms', with one document of the mean kind added.
    """
    total = float(n0 + n1)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    if not n0 or not n1:
        return np.full(len(having), LEAST_SHARE)
    lacking = total - having
    cells = ((toxic, n1 * having), (having - toxic, n0 * having), (n1 - toxic, n1 * lacking), (n0 - having + toxic, n0 * lacking))
    g = np.maximum(2 * sum(part(seen, product / total) for seen, product in cells), 0)
    odds = np.maximum(np.log((toxic + n1 / total) / (having - toxic + n0 / total) * (n0 / n1)), 0)
    return np.maximum(g / (g + MIDDLE) * odds**2 / (1 + odds**2), LEAST_SHARE)


def _kinds(group: np.ndarray, at: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """The kind of each entry: spherical k-means over which of the most common words it has, from evenly spread entries."""
    words = np.argsort(-df, kind="stable")[:COMMON]
    place = np.full(len(df), -1, np.int16)
    place[words] = np.arange(len(words))
    x = np.zeros((n, len(words)), np.float32)
    some = place[at] >= 0
    x[group[some], place[at[some]]] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)
    centres = x[np.linspace(0, n - 1, KINDS).astype(int)]
    for _ in range(8):
        kind = (x @ centres.T).argmax(1)
        centres = np.stack([x[kind == k].mean(0) if (kind == k).any() else centres[k] for k in range(KINDS)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return kind


def _flat(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """doc_ids, labels, numbers of terms, positions in terms, frequencies; by doc_id."""
    rows = rows.sort_by("doc_id").combine_chunks()
    numbers = []
    for c in ("at", "tf"):
        column = rows.column(c).cast(pa.large_binary()).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
        if isinstance(column, pa.ChunkedArray):
            return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.int32, np.int32))
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
        numbers.append(np.frombuffer(column.buffers()[2] or b"", "<i4")[ends[0] : ends[-1]])
    return rows.column("doc_id").to_numpy(), rows.column("label").to_numpy().astype(np.int64), np.diff(ends), *numbers


def _filled(index: Index, doc_id: np.ndarray, label: np.ndarray, lengths: np.ndarray, at: np.ndarray, tf: np.ndarray, stands_for: dict[int, float]) -> Index:
    """The index of the examples, not calibrated yet: example k has lengths[k] of the positions in terms and frequencies.

    Entries are put in order by kind (which tells languages apart, say), whether labels single a word of theirs out, and
    norm, so that blocks have few words with large shares.
    """
    mass = np.array([stands_for.get(k, 1.0) for k in label.tolist()])
    first = np.cumsum(lengths) - lengths
    ends = first + lengths
    number, members = {}, np.empty(len(doc_id), np.int64)
    for k, (a, b) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
        members[k] = number.setdefault(_digest(_packed(at[a:b]), _packed(tf[a:b])) if b > a else b"", len(number))
    # One example of each vector, the one of the smallest doc_id; the one without words is put last.
    lead = np.unique(members, return_index=True)[1] if len(members) else members
    toxic, total = np.bincount(members, label * mass, len(lead)), np.bincount(members, mass, len(lead))
    zero = number.pop(b"", None)
    some = np.array([k for k in range(len(lead)) if k != zero], np.int64)
    lead_some = lead[some]
    posts = _spread(first[lead_some], lengths[lead_some])
    at, tf, size = at[posts], tf[posts], lengths[lead_some]
    del posts
    df = np.bincount(at, minlength=len(index.terms))
    n = index.n_entries = len(some)
    order = np.empty(0, np.int64)
    if n:
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(n, dtype=np.int32), size)
        heaviest = np.maximum.reduceat(index.weight[at], start)
        weight = index.weight.astype(np.float32)[at]
        weight *= 1 + np.log(tf, dtype=np.float32)
        weight *= weight
        norm = np.sqrt(np.add.reduceat(weight, start, dtype=np.float64))
        order = np.lexsort((np.arange(n), norm, heaviest > 0.5 * index.weight.max(), _kinds(of, at, df, n)))
        del of, weight
        posts = _spread(start[order], size[order])
        at, tf = at[posts], tf[posts]
        del posts
        index.norm = norm[order]
    else:
        index.norm = np.empty(0)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    where = dict(zip(some.tolist(), place.tolist(), strict=True))
    index.entry_of = {key: where[k] for key, k in number.items()}
    kept = some[order]
    none = (toxic[zero], total[zero]) if zero is not None else (0.0, 0.0)
    index.first_id = np.append(doc_id[lead[kept]], -1)
    index.toxic, index.total = np.append(toxic[kept], none[0]), np.append(total[kept], none[1])
    index.prior = index.toxic.sum() / max(index.total.sum(), 1e-9)
    index.start = np.concatenate(([0], np.cumsum(df)))
    of = np.repeat(np.arange(n, dtype=np.int32), size[order])
    by_term = np.argsort(at, kind="stable")
    index.post_entry, index.post_tf = of[by_term], tf[by_term]
    return index


def _judged(index: Index, texts: pa.Array, evidence: int) -> tuple[np.ndarray, list, list]:
    """Score, ids of the nearest members and their cosines, for each text."""
    scores = np.zeros(len(texts))
    near: list[list] = [[] for _ in range(len(texts))] if evidence else []
    likes: list[list] = [[] for _ in range(len(texts))] if evidence else []
    for first, cut, at, tf in _vectors(index.terms, texts):
        vote, q, e, s = index.votes(cut, at, tf)
        scores[first : first + len(cut) - 1] = index.probability(vote)
        if evidence:
            mine = (np.arange(len(q)) - np.searchsorted(q, q) < evidence) & (e < index.n_entries)
            for k, doc_id, like in zip(q[mine].tolist(), index.first_id[e[mine]].tolist(), s[mine].tolist(), strict=True):
                near[first + k].append(doc_id)
                likes[first + k].append(like)
    return scores, near, likes


def _score(shared, steps: tuple, evidence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        index.steps = steps  # the index was sent before its calibration
        for batch in batches:
            scores, ids, likes = _judged(index, batch.column("text"), evidence)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())), pa.array(likes, pa.list_(pa.float64()))], ["doc_id", "score", "nearest", "similarity"])

    return run


def score(docs: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, score, predicted, nearest (ids of labelled examples), similarity.

    A row for each row; repeated rows and equal texts score alike. Null and empty texts have no terms and score like
    examples without any. A null doc_id is scored too, with held_out null. Equal cosines are taken in the index's order.
    Other columns are never looked at; an empty table gives no rows. A task needs about 60 bytes a byte of its longest text.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score(index.shared, index.steps, max(1, evidence)), "doc_id long, score double, nearest array<long>, similarity array<double>")
    return scored.select("doc_id", (F.pmod(crc32_of(F.col("doc_id")), F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest", "similarity")


def kept(docs: DataFrame, index: Index) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic: one pass, nothing is joined.

    Only texts go through Python, and one number a row comes back; the other columns, whatever their names, stay where
    they are. Nulls, repeats and empty tables as in `score`; a row without doc_id is judged by its text.
    """
    bound_batches(docs.sparkSession)
    shared, steps = index.shared, index.steps

    @F.arrow_udf("double")
    def toxicity(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mine: Index = shared.value
        mine.steps = steps
        for part in texts:
            yield pa.array(_judged(mine, part, 0)[0], pa.float64())
        release()

    return docs.where(toxicity(F.col("text").cast("string")) < 0.5)
