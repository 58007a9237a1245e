"""Quality by importance resampling with hashed n-gram models.

Two bag-of-n-grams models over hashed features: one of the texts that labels call good (the target), one of all (raw)
texts. The features are words as they are written and pairs of neighbouring words, each kind hashed into half of
`buckets` counters, which bounds the models. A text's log-weight is the sum of log(p_good / p_raw) over its n-grams.
Adding standard Gumbel noise to the log-weights and taking the k largest draws k texts without replacement in
proportion to their weights (Gumbel top-k).

Log-weights of long texts are sums of many terms, so `fit` also calibrates, on labelled texts that the models left out,
the log-weight a feature below which texts are bad: `advantage` is the log-weight against that rate, the weight that a
filter draws by. k is an argument; `calibrated_k` is the number of texts whose advantage is not negative.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bound_batches, written

BUCKETS = 1 << 15
#: Most labelled documents that the good model and the floor are fitted on: those of the smallest hashes of doc_id.
SAMPLE = 20_000
#: Log-odds that a text starts with, so that a few odd n-grams do not reject a short text.
PRIOR = 2.0
#: Pseudo-counts, dealt in proportion to the raw model, that the good model is smoothed with.
SMOOTHING = 500.0


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log(p_good / p_raw) by bucket
    floor: float  # least log-weight a feature that is kept, on average
    buckets: int


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word, and of every pair of neighbouring words, of a slice of texts."""
    words, rows = tv.words(data, offsets, fold=False)
    same = rows[1:] == rows[:-1]
    pairs = tv.mix(words[:-1] * tv._ODD[9] + words[1:] * tv._ODD[10])[same]
    half = np.uint64(buckets // 2)
    return np.concatenate([words % half, half + pairs % half]).astype(np.int64), np.concatenate([rows, rows[1:][same]])


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two rows of bucket counts a task: of all its texts, of its good training texts; and rows for calibration."""
        raw, good, kept = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), []
        for batch in batches:
            texts, label, part = batch.column("text"), batch.column("good").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(zero_copy_only=False)
            for first, data, offsets in tv.slices(texts):
                found, rows = features(data, offsets, buckets)
                raw += np.bincount(found, minlength=buckets)
                use = (label[first : first + len(offsets) - 1] == 1) & (part[first : first + len(offsets) - 1] != 0)
                if use.any():
                    good += np.bincount(found[use[rows]], minlength=buckets)
        for kind, x in ((0, raw), (1, good)):
            at = np.flatnonzero(x)
            kept.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(x[at])], ["kind", "bucket", "n"]))
        yield from kept

    return run


def log_weights(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log-weight, number of features) of every text."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for first, data, offsets in tv.slices(texts):
        found, rows = features(data, offsets, model.buckets)
        size = len(offsets) - 1
        total[first : first + size] = np.bincount(rows, model.ratio[found], minlength=size)
        n[first : first + size] = np.bincount(rows, minlength=size)
    return total, n


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = log_weights(batch.column("text"), shared.value)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(w), pa.array(n)], [*rest, "log_weight", "n_features"])

    return run


def labelled(labels: DataFrame, column: str, sample: int) -> DataFrame:
    """(labelled_id, label, part) of at most `sample` labelled documents, of the smallest hashes of doc_id; part 0 (a fifth) is held out.

    A document with several labels has the largest. The bound on rows makes it safe to broadcast.
    """
    one = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    one = one.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(sample)
    return one.withColumn("part", F.pmod(F.xxhash64("labelled_id", F.lit(7)), F.lit(5)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, sample: int = SAMPLE, keep: float = 0.999) -> Model:
    """Fit on all texts of docs (raw model) and on at most `sample` rows of labels(doc_id, quality).

    The floor lets `keep` of the held-out good texts pass, but lies in the gap below them where bad ones leave one.
    Without labels, or without any good one, all log-weights are 0 and the floor lets everything pass.
    """
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    known = F.broadcast(labelled(labels, "quality", sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, F.col("doc_id") == F.col("labelled_id"), "left")
    given = rows.select("text", F.coalesce("label", F.lit(-1)).alias("good"), F.coalesce("part", F.lit(0)).alias("part"))
    counts = given.mapInArrow(_counts(buckets), "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():  # at most 2 * buckets rows
        (raw, good)[r.kind][r.bucket] = r.n
    if not good.sum():
        return Model(np.zeros(buckets), -np.inf, buckets)
    ratio = np.zeros(buckets)
    for half in (slice(0, buckets // 2), slice(buckets // 2, buckets)):
        share = raw[half] / max(raw[half].sum(), 1)
        some = share > 0
        # An n-gram that no text has counts as likely under both models.
        ratio[half][some] = np.log((good[half] + SMOOTHING * share)[some] / (good[half].sum() + SMOOTHING) / share[some])
    model = Model(ratio, -np.inf, buckets)
    shared = spark.sparkContext.broadcast(model)
    seen = rows.where("part = 0").select("text", "label").mapInArrow(_scores(shared), "label int, log_weight double, n_features long").collect()  # at most `sample` rows
    rate = lambda want: np.array([(r.log_weight + PRIOR) / r.n_features for r in seen if r.label == want and r.n_features])
    return Model(ratio, calibrated_floor(rate(1), rate(0), keep), buckets)


def calibrated_floor(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """The log-weight a feature below which texts are rejected."""
    if not len(good):
        return -np.inf
    low = float(np.quantile(good, 1 - keep))
    under = bad[bad < low]
    return float((low + under.max()) / 2) if len(under) else low - 1e-9


def _floor(model: Model) -> float:
    return float(model.floor) if np.isfinite(model.floor) else -1e300


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, log_weight, n_features, advantage; a row for each row, repeated or not.

    Null and empty texts have no features and log-weight 0. Other columns are ignored, whatever their names; an empty
    table gives no rows. A task needs about 60 bytes a byte of its longest text.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(shared), "doc_id long, log_weight double, n_features long")
    return scored.withColumn("advantage", F.col("log_weight") + PRIOR - F.lit(_floor(model)) * F.col("n_features"))


def gumbel(seed: int):
    """Standard Gumbel noise of a document: a function of doc_id and seed alone, so a repeated task draws the same.

    Rows of one doc_id share a draw, as do rows without doc_id.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def calibrated_k(scored: DataFrame) -> int:
    return scored.where("advantage >= 0").count()


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, exactly, by counting in ever finer bins: a job of `bins` rows each, no sort."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0
    while True:
        if not low < high:
            return low
        width = (high - low) / bins
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        inside = values.where((F.col(column) >= low) & (F.col(column) <= high))
        rows = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.bin):
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
        else:
            return low
        if len(rows) == 1:
            # All in one bin although their bounds differ: halve by value.
            middle = low + (high - low) / 2
            more = inside.where(F.col(column) > middle).count()
            if above + more >= k:
                low = inside.where(F.col(column) > middle).agg(F.min(column)).first()[0]
            else:
                above += more
                high = inside.where(F.col(column) <= middle).agg(F.max(column)).first()[0]


def resample(scored: DataFrame, k: int | None = None, *, weight: str = "advantage", seed: int = 1) -> DataFrame:
    """scored with gumbel_key (weight plus standard Gumbel noise) and a boolean `sampled`: the k largest keys, ties all taken.

    k None: `calibrated_k`. weight: advantage, or log_weight for importance resampling without the calibrated rate.
    scored is read several times.
    """
    keyed = scored.withColumn("gumbel_key", F.col(weight) + gumbel(seed))
    k = calibrated_k(scored) if k is None else k
    return keyed.withColumn("sampled", F.col("gumbel_key") >= F.lit(kth_largest(keyed, "gumbel_key", k)))


def kept(docs: DataFrame, model: Model, k: int | None = None, *, seed: int = 1) -> DataFrame:
    """The rows of docs, all columns, that `resample` takes with the advantages as weights; nothing is joined. k None: `calibrated_k`.

    A first pass writes the keys alone and finds the least one that is taken; a second one scores the rows again and
    drops those below it. Only texts go through Python, and one number a row comes back. A row without doc_id is judged
    like others; other columns, whatever their names, stay as they are.
    """
    scored = written(score(docs, model), "quality").withColumn("gumbel_key", F.col("advantage") + gumbel(seed))
    least = kth_largest(scored, "gumbel_key", calibrated_k(scored) if k is None else k)
    shared, floor = docs.sparkSession.sparkContext.broadcast(model), _floor(model)

    @F.arrow_udf("double")
    def advantage(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            w, n = log_weights(part, shared.value)
            yield pa.array(w + PRIOR - floor * n)

    return docs.where(advantage(F.col("text").cast("string")) + gumbel(seed) >= F.lit(least))


__all__ = ["Model", "calibrated_floor", "calibrated_k", "features", "fit", "gumbel", "kept", "kth_largest", "labelled", "log_weights", "resample", "score"]
