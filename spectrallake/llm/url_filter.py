"""URL filter: host and path rules, and for the rest a ratio of character language models. DataFrame functions only.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are counted in one table of n-grams: for
each n-gram up to `order` + 1 characters, how often either class has it. The probability of its last character after
the others is interpolated with that after one character less, down to a uniform one (Witten-Bell style with a constant
`smoothing`). A URL's score is the sum of log(p_accepted / p_rejected) over its characters, each by the longest n-gram
that the table holds, over their number. The threshold is calibrated on URLs that the counts left out: the score that is
as many standard deviations below the accepted ones' mean as above the rejected ones', but no higher than the score under
which a hundredth of the accepted ones lie, so that hardly any URL like an accepted one is blocked.

The table holds each n-gram's log ratio less that of its end without the first character. All ends of an n-gram that
the table has are in it too, so the differences of all n-grams that end at a character add up to the log ratio of the
longest: a score is one sum, made before anything is shuffled. All labelled URLs are counted or calibrate, unless a
sample is asked for; the table of their n-grams is broadcast if it has at most `BROADCAST` rows. Ratios are whole multiples of 2^-32, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import order_statistic
from .common import forget, written

#: Host and path, and what they say.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Characters before the predicted one, and the weight of the shorter context.
ORDER, SMOOTHING = 4, 2.0
#: Most rows of the table of n-grams that is broadcast; a larger one is joined by shuffles. And what a ratio is a multiple of.
BROADCAST, UNIT = 2_000_000, 2.0**-32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _grams(urls: DataFrame, order: int, empty: bool = False) -> DataFrame:
    """A row for each character and each n-gram that ends with it: the other columns, size (1 to order + 1), gram.

    empty: also rows for n-grams before the first character, which no table holds, so that every url has rows.
    """
    before = order + empty
    padded = urls.withColumn("padded_url", F.concat(F.repeat(F.lit("\u0002"), before), "url")).drop("url")
    ends = padded.where(F.length("padded_url") > order).withColumn("at", F.explode(F.sequence(F.lit(order + 1), F.length("padded_url"))))
    sized = ends.withColumn("size", F.explode(F.array(*[F.lit(k) for k in range(1, order + 2)])))
    return sized.withColumn("gram", F.col("padded_url").substr(F.col("at") - F.col("size") + 1, F.col("size"))).drop("padded_url", "at")


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """At most so many of each class of labelled(url, accepted): those of the smallest hashes."""
    first = [labelled.where(c).orderBy(F.xxhash64("url"), "url").limit(sample) for c in ("accepted", "not accepted")]
    return first[0].unionByName(first[1]).select("accepted", "url")


def _quantile(scores: DataFrame, share: float, n: int) -> float:
    """Of n rows of scores(score), exact and interpolated; no task sees all of them."""
    at = share * (n - 1)
    below = int(at)
    one = scores.sparkSession.createDataFrame([(True, below + 1)], "all boolean, place long")
    low = order_statistic(scores.select(F.lit(True).alias("all"), F.col("score").alias("v")), ["all"], one).first().value
    r = scores.agg(F.count_if(F.col("score") <= low).alias("n"), F.min(F.when(F.col("score") > low, F.col("score"))).alias("next")).first()
    high = low if r.n > below + 1 or r.next is None else r.next
    return low if at == below else (below + 1 - at) * low + (at - below) * high


def model(labelled: DataFrame, *, order: int = ORDER, smoothing: float = SMOOTHING, sample: int | None = None) -> DataFrame:
    """(gram, ratio, step) from labelled(url, accepted boolean), url distinct: log(p_accepted / p_rejected) of the last character after the others, and in UNITs what it adds to that without the first character.

    All URLs are counted. With `sample`, at most so many of each class are: those of the smallest hashes.
    """
    used = labelled.select("accepted", "url") if sample is None else written(_sampled(labelled, sample), "url-sample")
    used = used.repartition(2 * labelled.sparkSession.sparkContext.defaultParallelism)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = written(_grams(used, order).groupBy("gram", "size").agg(one(F.col("accepted")).alias("a"), one(~F.col("accepted")).alias("r")), "url-grams")
    # The count of a context is that of all n-grams with it.
    context = F.expr("substring(gram, 1, size - 1)")
    contexts = counts.groupBy(context.alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    sized = counts.join(contexts, context == F.col("context")).select("gram", "size", F.struct("size", "a", "r", "ca", "cr").alias("n"))
    # Each n-gram meets the counts of all its ends, shortest first, and the probabilities are folded over them.
    ends = counts.select("gram", F.explode(F.expr("transform(sequence(1, size), k -> substring(gram, size - k + 1, k))")).alias("end"))
    found = ends.join(sized.select(F.col("gram").alias("end"), "n"), "end").groupBy("gram").agg(F.sort_array(F.collect_list("n")).alias("levels"))
    rate = lambda n, c, p: (n + F.lit(smoothing) * p) / (c + F.lit(smoothing))
    start = F.struct(F.lit(1 / 256).alias("pa"), F.lit(1 / 256).alias("pr"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("before"))

    def deeper(s: Column, n: Column) -> Column:
        pa, pr = rate(n["a"], n["ca"], s["pa"]), rate(n["r"], n["cr"], s["pr"])
        return F.struct(pa.alias("pa"), pr.alias("pr"), F.log(pa / pr).alias("ratio"), s["ratio"].alias("before"))

    last = found.select("gram", F.aggregate("levels", start, deeper).alias("s"))
    table = last.select("gram", F.col("s.ratio").alias("ratio"), (F.round(F.col("s.ratio") / UNIT).cast("long") - F.round(F.col("s.before") / UNIT).cast("long")).alias("step"))
    return written(table, "url-model")


def scored(urls: DataFrame, table: DataFrame, order: int = ORDER, *, keep_url: bool = True) -> DataFrame:
    """urls(url not null, ...) with score: the mean log ratio of a character; 0 for the empty url. A row for each row.

    Rows get a number and are summed up where they lie. The columns are grouped by along with it, so each row is
    shuffled once; keep_url False leaves the url itself out.
    """
    names = [c for c in urls.columns if keep_url or c != "url"]
    rows = urls.withColumns({"url_row": F.monotonically_increasing_id(), "url_size": F.length("url")})
    steps = table.select("gram", "step")
    small = table.count() <= BROADCAST
    rows = rows.withColumn("url_kept", F.col("url")) if keep_url else rows
    grams = _grams(rows, order, empty=True)
    grams = grams.withColumnRenamed("url_kept", "url") if keep_url else grams
    hits = grams.join(F.broadcast(steps) if small else steps, "gram", "left")
    sums = hits.groupBy(*names, "url_row", "url_size").agg(F.sum("step").alias("total"))
    return sums.select(*names, F.coalesce(F.col("total") * UNIT / F.col("url_size"), F.lit(0.0)).alias("score"))


def filter_urls(pages: DataFrame, rules=RULES, *, order: int = ORDER, smoothing: float = SMOOTHING, sample: int | None = None) -> DataFrame:
    """pages(page_id, url, ...) -> page_id, host, path, rule, verdict, score; a row for each row, repeated or not.

    URLs that a rule fits are the labelled ones: allowed are accepted, blocked are rejected. A fifth of them (by hash)
    only calibrates; where it has one class only, that class's scores decide. sample bounds what is counted and what
    calibrates, each class on its own; without it, all do. verdict is the rule's or, without a rule, block where the score is below the threshold. Without labelled URLs of both classes,
    what no rule fits is allowed; so are null URLs. score is null where a rule decides and for null URLs. A null page_id
    stays null. Other columns are ignored, whatever their names; an empty table gives no rows. A long URL makes a row for
    each of its characters and sizes, one at a time.
    """
    page_host, page_path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": page_host, "path": page_path})
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    fold = F.pmod(F.xxhash64("url", F.lit(11)), F.lit(5))
    labelled = written(rows.where("said is not null and url is not null").groupBy("url").agg((F.max("said") == "allow").alias("accepted")), "url-labels")
    table = model(labelled.where(fold != 0), order=order, smoothing=smoothing, sample=sample)
    held = labelled.where(fold == 0)
    held = held if sample is None else written(_sampled(held, sample), "url-held-out")
    seen = written(scored(held, table, order, keep_url=False), "url-scores")
    stats = {r.accepted: r for r in seen.groupBy("accepted").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.count("*").alias("n")).collect()}
    limit = lambda accepted, share: _quantile(seen.where(F.col("accepted") == accepted), share, stats[accepted].n)
    threshold = None
    if len(stats) == 2:
        a, r = stats[True], stats[False]
        wa, wr = a.s + 1e-6, r.s + 1e-6
        threshold = min((a.m * wr + r.m * wa) / (wa + wr), limit(True, 0.01))
    elif stats and labelled.select("accepted").distinct().count() == 2:
        threshold = limit(True, 0.01) if True in stats else limit(False, 0.99)
    forget(labelled, seen)
    ruled = rows.where("said is not null or url is null").select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    judged = scored(rows.where("said is null and url is not null").select("page_id", "url", "host", "path"), table, order, keep_url=False)
    verdict = F.when(F.col("score") < F.lit(threshold), "block").otherwise("allow") if threshold is not None else F.lit("allow")
    return ruled.unionByName(judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), "score"))
