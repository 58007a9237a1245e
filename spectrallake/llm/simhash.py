"""SimHash fingerprints of documents and search within a Hamming radius. DataFrame functions only.

Terms are words in lower case; each occurrence adds its term's weight (its length in characters, as long words tell
more) to the votes of the term's 64-bit hash: for each bit, terms that have it against terms that lack it. Two 32-bit
counters share a long, so 32 sums make a fingerprint. The search splits fingerprints into blocks; a table for each
choice of blocks keys the fingerprints by those blocks, as if the bits were permuted to put them in front. Fingerprints
within radius r agree in at least blocks - r blocks, so one table at least brings each such pair together.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

BITS = 64
RADIUS, BLOCKS = 3, 6
_PAIR = 0x0000000100000001


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def fingerprints(texts: DataFrame, key: list[str], carried: str | None = None) -> DataFrame:
    """texts(*key, text) with distinct keys -> *key, fingerprint (long); texts without words have no row (their fingerprint counts as 0).

    carried: a column that comes along; rows that have it have a row in any case.
    """
    more = [carried] if carried else []
    words = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    terms = texts.select(*key, *more, F.explode(words).alias("term")).where("term <> ''" + (f" or {carried} is not null" if carried else ""))
    weight = F.when(F.col("term") != "", F.least(F.length("term"), F.lit(32)).cast("long"))
    hashed = terms.select(*key, *more, F.xxhash64("term").alias("h64"), weight.alias("w"))
    votes = hashed.groupBy(*key).agg(F.sum("w").alias("all"), *[F.max(c).alias(c) for c in more], *[F.sum(F.shiftrightunsigned("h64", k).bitwiseAND(F.lit(_PAIR)) * F.col("w")).alias(f"v{k}") for k in range(BITS // 2)])
    # Each sum holds the votes for bit k in its low and for bit k + 32 in its high half.
    low = lambda k: F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda k: F.shiftrightunsigned(F.col(f"v{k}"), 32)
    bit = lambda votes, k: F.when(2 * votes > F.col("all"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))
    total = None
    for k in range(BITS // 2):
        both = bit(low(k), k).bitwiseOR(bit(high(k), k + 32))
        total = both if total is None else total.bitwiseOR(both)
    return votes.select(*key, *more, total.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the share of differing bits estimates, not below 0."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793 / BITS) * F.bit_count(a.bitwiseXOR(b))))


def block_keys(fingerprint: Column, blocks: int, radius: int) -> Column:
    """array of (table, key): the blocks that each table has in front."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    tables = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        tables.append(F.struct(F.lit(number).alias("table"), fingerprint.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*tables)


def within_radius(queries: DataFrame, all_prints: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (fingerprint of queries, other fingerprint of all_prints, distance) with distance <= radius; exact.

    Both have distinct fingerprints. A pair that several tables bring together is kept by the first of them.
    """
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    q = queries.select(F.col("fingerprint").alias("q"), F.explode(block_keys(F.col("fingerprint"), blocks, radius)).alias("t")).select("q", "t.*")
    p = all_prints.select(F.col("fingerprint").alias("p"), F.explode(block_keys(F.col("fingerprint"), blocks, radius)).alias("t")).select("p", "t.*")
    differ = F.bit_count(F.col("q").bitwiseXOR(F.col("p")))
    own, other = block_keys(F.col("q"), blocks, radius), block_keys(F.col("p"), blocks, radius)
    first = F.array_position(F.zip_with(own, other, lambda a, b: a["key"] == b["key"]), True) - 1
    joined = q.join(p, ["table", "key"]).where(differ <= radius)
    return joined.where(first == F.col("table")).select(F.col("q").alias("fingerprint"), F.col("p").alias("other"), differ.alias("distance"))


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with `at`: a long for each row, ascending in order, in one run of numbers a task. Written, so numbers stay."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.withColumn("at", F.monotonically_increasing_id()), "numbered")


def successors(numbers: DataFrame) -> DataFrame:
    """(at) as `numbered` gives it -> at, next (the next larger number; after the largest, the smallest).

    Numbers of one task have no gap, so only the last of each run needs a look-up, in a table of one row a task.
    """
    run = F.shiftright("at", 33)
    runs = numbers.groupBy(run.alias("run")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # One row for each task of a shuffle: the window is over a short list, whatever the number of rows.
    after = F.coalesce(F.lead("first").over(Window.orderBy("run")), F.min("first").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)))
    ends = runs.select("run", "last", after.alias("after"))
    found = numbers.select("at", run.alias("run")).join(F.broadcast(ends), "run")
    return found.select("at", F.when(F.col("at") == F.col("last"), F.col("after")).otherwise(F.col("at") + 1).alias("next"))


def edited_fingerprints(docs: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS, every: int = 50) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within; a row for each row.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document's, in ascending doc_id; the last is followed by the first. near_*: `likeness` of the fingerprint to the
    edited text's and to the next document's. n_within, for doc_ids divisible by `every`, is the number of other rows
    whose fingerprint is within the radius; null for the rest. A null text counts as empty. Rows of one doc_id follow each
    other in an order of their texts' hashes; rows without doc_id come before all others. doc_ids may be any longs. Other
    columns are ignored, whatever their names; an empty table gives no rows. A long text makes a row a word, one at a time.
    Rows alike in doc_id and text are worked on once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A document's key is its doc_id and a hash of its text; rows alike in both are copies, one after the other.
    keyed = rows.select("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")).alias("k"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("h"), "text")
    sizes = keyed.groupBy("k", "h").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max(F.length("text")).cast("long").alias("n_chars"))
    order = numbered(sizes, [F.col("doc_id").asc_nulls_first(), F.col("h")])
    follows = written(successors(order.select("at")), "order")
    giver = order.select(F.col("at").alias("next"), F.col("k").alias("gk"), F.col("h").alias("gh"))
    needs = order.join(follows, "at").join(giver, "next").select("gk", "gh", F.col("k").alias("tk"), F.col("h").alias("th"), "copies", F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    needs = written(needs, "needs")
    # One text a key; both joins read the same shuffle of them, and only starts of texts are shuffled again.
    texts = keyed.groupBy("k", "h").agg(F.first("text").alias("text"))
    gifts = texts.join(needs.hint("merge"), (F.col("k") == F.col("gk")) & (F.col("h") == F.col("gh"))).select("tk", "th", "copies", "half", F.col("text").substr(F.lit(1), F.col("half")).alias("start"))
    both = texts.join(gifts.hint("merge"), (F.col("k") == F.col("tk")) & (F.col("h") == F.col("th")))
    stays = F.col("text").substr(F.lit(1), F.length("text") - F.col("half"))
    made = both.select("k", "h", "copies", "text", F.concat(stays, "start").alias("edited"), F.when(F.col("copies") > 1, F.concat(stays, F.col("text").substr(F.lit(1), F.col("half")))).alias("own"))
    none, nothing = F.lit(None).cast("string"), F.lit("")
    sha = lambda c: F.sha2(F.encode(F.col(c), "UTF-8"), 256)
    version = lambda kind, text, digest: F.struct(F.lit(kind).alias("kind"), text.alias("text"), digest.alias("sha256"))
    # What a text's words must not repeat, its digest, comes as a version without words. Copies but the last are followed by themselves.
    own = F.when(F.col("copies") > 1, F.array(version(2, F.col("own"), none), version(4, nothing, sha("own")))).otherwise(F.array().cast("array<struct<kind:int,text:string,sha256:string>>"))
    versions = F.concat(F.array(version(0, F.col("text"), none), version(1, F.col("edited"), none), version(3, nothing, sha("edited"))), own)
    prints = fingerprints(made.select("k", "h", F.explode(versions).alias("v")).select("k", "h", "v.*"), ["k", "h", "kind"], "sha256")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    told = prints.groupBy("k", "h").agg(of(0, "fingerprint").alias("f"), of(1, "fingerprint").alias("e"), of(3, "sha256").alias("sha"), of(2, "fingerprint").alias("own_e"), of(4, "sha256").alias("own_sha")).fillna(0, ["f", "e", "own_e"])
    told = written(order.join(told, ["k", "h"]).join(follows, "at"), "told")
    full = told.join(told.select(F.col("at").alias("next"), F.col("f").alias("next_f")), "next")
    last = F.col("copy") == F.col("copies")
    full = full.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "n_chars", "f", F.when(last, F.col("e")).otherwise(F.col("own_e")).alias("e"),
        F.when(last, F.col("sha")).otherwise(F.col("own_sha")).alias("edited_sha256"), F.when(last, F.col("next_f")).otherwise(F.col("f")).alias("next_f"),
    )
    full = written(full, "documents")
    forget(order, follows, needs, told)

    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    groups = full.groupBy(F.col("f").alias("fingerprint")).agg(F.count("*").alias("copies"))
    asked = full.where(asks).select(F.col("f").alias("fingerprint")).distinct()
    found = within_radius(asked, groups, radius=radius, blocks=blocks).join(groups.select(F.col("fingerprint").alias("other"), "copies"), "other")
    counts = found.groupBy("fingerprint").agg(F.sum("copies").alias("within")).withColumnRenamed("fingerprint", "f")
    out = full.join(counts, "f", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("f")).alias("fingerprint"), hex_of(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
        F.when(asks, F.col("within") - 1).cast("long").alias("n_within"),
    )


__all__ = ["block_keys", "edited_fingerprints", "fingerprints", "hex_of", "likeness", "numbered", "successors", "within_radius"]
