"""Token counts by look-up in two tiers, without moving any text or pre-token.

A pre-token is what stands between two spaces. No piece of the model goes on over a space, so a text has as many tokens
as its pre-tokens together; texts where a cut would not be exact (runs of spaces, the space symbol itself) go to the
library whole. Tier one is a table of the lengths of the most frequent pre-tokens, counted over all documents and sent
to every task; it holds at most `frequent` entries whatever the input. Tier two is each worker's own bounded memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release
from .wordcache import Memory, rest_collector

#: Most entries of the table that is sent to the tasks.
FREQUENT = 1 << 16
#: Longest pre-token, in characters, that the table holds: it bounds the table's bytes.
LONGEST = 64
#: Different pre-tokens that a task gathers before it tells the frequent ones among them.
POOL = 1 << 18
_SPACE = "▁"
_workers: dict[str, "Counting"] = {}


class Counting:
    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.known, self.token, self.rest = {}, None, Memory(self._count)

    def use(self, token: str, known: dict[str, int]) -> "Counting":
        """Start from the lengths of one broadcast table."""
        if self.token != token:
            self.token, self.known = token, known
        return self

    def _count(self, word: str) -> int | None:
        if not word or _SPACE in word:
            return None
        n = self.known.get(word)
        return len(self.library.encode(word)) if n is None else n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        try:
            return sum(map(self.rest.__getitem__, text.split(" ")))
        except TypeError:
            return len(self.library.encode(text))


def worker(model: str) -> Counting:
    if model not in _workers:
        _workers[model] = Counting(model)
    return _workers[model]


def _frequent(frequent: int):
    def told(seen: Counter) -> Iterator[pa.RecordBatch]:
        least = max(2, seen.total() // (2 * frequent))
        some = [(w, n) for w, n in seen.items() if n >= least and 0 < len(w) <= LONGEST and _SPACE not in w]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of what is frequent among the pre-tokens seen so far, told whenever POOL different ones were met."""
        seen = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                if t:
                    seen.update(t.split(" "))
            if len(seen) >= POOL:
                yield from told(seen)
                seen = Counter()
        yield from told(seen)

    return run


def _lengths(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            found = library.encode(batch.column("word").to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array([len(x) for x in found], pa.int32())], ["word", "n_tokens"])

    return run


def frequent_lengths(texts: DataFrame, model: str, frequent: int = FREQUENT) -> DataFrame:
    """(word, n_tokens) of at most `frequent` pre-tokens that occur most often in all texts; what is rare among a task's is not counted."""
    counted = texts.select("text").mapInArrow(_frequent(frequent), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(frequent).select("word").mapInArrow(_lengths(model), "word string, n_tokens int")


def count_tokens(docs: DataFrame, model: str, *, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit; a row for each row, in any order.

    n_tokens is what the sentencepiece model gives for the whole text, without begin and end symbols. Null texts count
    as empty: no bytes, no tokens. Repeated rows are counted each, a null doc_id stays null, other columns are ignored,
    whatever their names; an empty table gives no rows. A long text is split in memory, at most a few times its size.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = {r.word: r.n_tokens for r in frequent_lengths(rows, model, frequent).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    token = f"{docs.sparkSession.sparkContext.applicationId}/{id(shared)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker(model).use(token, shared.value).text
        rest_collector(True)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n = [count(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        worker(model).rest.forget()
        rest_collector(False)
        release()

    counted = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("long"), F.lit(0))).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
