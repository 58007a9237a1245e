"""The ten operators against brute force, exact round trips and held-out accuracy, with odd inputs."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spectrallake.llm import common, embed_dedup, ngram_jaccard, packing, piece_viterbi, quality, simhash, token_counts, token_store, toxicity, url_filter
from spectrallake.llm.wordcache import encoder

LONG = "word" + " another" * 3000 + " café\n" * 500
ODD = [None, "", " ", "\n\t", "one", "One TWO three", "a b c d e", "A b c d e", LONG, LONG + " end", "x" * 5000, "日本語 テキスト  double  spaces", "tab\tand nbsp", "<|endoftext|> </s> it's", "é İ Σς ☃"]


def docs(spark, texts):
    """Rows with columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(k, t, "clash", "u") for k, t in enumerate(texts)], "doc_id long, text string, entity string, key string")


def shingle_set(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = [lo if c == hi else c for c in comp]
    return sets, comp


def test_jaccard_join_is_exact(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], n)) for n in (30, 80, 200)]
    texts = list(ODD)
    for b in base:
        w = b.split()
        for cut in range(0, 14):
            v = list(w)
            for at in rng.choice(len(v), max(1, len(v) * cut // 150), replace=False):
                v[at] = f"new{rng.integers(1000)}"
            texts.append(" ".join(v))
        texts += [b, b.upper(), b + " tail"]
    sets, comp = brute_components(texts)
    for block in (4096, 4):  # small blocks: tiles are compared block by block
        got = {r.doc_id: r for r in ngram_jaccard.jaccard_components(docs(spark, texts), block=block, frequent=64).collect()}
        assert len(got) == len(texts)
        assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
        assert [got[k].component_id for k in range(len(texts))] == comp
    kept = ngram_jaccard.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp)) and kept.columns == docs(spark, texts).columns


def test_jaccard_join_odd_tables(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert ngram_jaccard.jaccard_components(empty).count() == 0
    twice = docs(spark, ["a b c d e f", "x"]).unionByName(docs(spark, ["a b c d e f", "x"]))
    assert ngram_jaccard.jaccard_components(twice).count() == 4
    assert ngram_jaccard.keep_one(twice).count() == 2


def test_jaccard_join_with_odd_ids(spark):
    """Texts that share a doc_id are not linked for that, and none of them is lost; nulls name no component."""
    a, b, c = "a b c d e f g h", "r s t u v w x y", "k l m n o p q z"
    rows = [(7, a), (7, b), (3, b), (None, a), (None, c), (None, c), (9, None), (9, ""), (None, " "), (7, a)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, set_of_text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(7, 4, 7), (7, 4, 3), (3, 4, 3), (None, 4, 7), (None, 4, None), (None, 4, None), (9, 0, 9), (9, 0, 9), (None, 0, None), (7, 4, 7)], key=str)
    kept = ngram_jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(7, a), (3, b), (None, c), (9, None), (9, ""), (None, " ")], key=str)
    assert ngram_jaccard.keep_one(df.limit(0)).count() == 0


def test_large_tiles_compare_all_that_may_link(spark):
    """A hot tile: one large group of near copies, and texts that share its passage without being linked, or with each other only."""
    rng = np.random.default_rng(77)
    base = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(60):
        w = list(base)
        w[rng.integers(60)] = f"q{k}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:22] + [f"r{k}{j}" for j in range(20 + k % 3)]) for k in range(12)]
    texts += [texts[61] + " z", texts[66] + " y", texts[0] + " x"]
    sets, comp = brute_components(texts)
    assert len(set(comp)) > 3
    for block in (4096, 8, 3):
        got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(docs(spark, texts), block=block, frequent=1 << 18).collect()}
        assert [got[k] for k in range(len(texts))] == comp


def test_bitmap_bound_never_drops_a_link():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(5, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.7, 1))], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            x, y = ngram_jaccard.tile_pairs(np.array([1, 2]), np.array([len(a), len(b)]), np.array([1, 2]), np.array([0, 0]), [ngram_jaccard._signature(a), ngram_jaccard._signature(b)], 80)
            assert len(x) == 1


def test_simhash(spark):
    texts = [t for t in ODD if t is not None] + ["the quick brown fox"] * 3
    got = {r.doc_id: r for r in simhash.edited_fingerprints(docs(spark, [None, *texts]), every=2).collect()}
    full = ["", *texts]
    import hashlib

    for k, t in enumerate(full):
        nxt, half = full[(k + 1) % len(full)], len(t) // 2
        assert got[k].n_chars == len(t)
        assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    prints = [int(got[k].fingerprint, 16) for k in range(len(full))]
    for k in range(0, len(full), 2):
        assert got[k].n_within == sum((prints[k] ^ p).bit_count() <= 3 for p in prints) - 1
    assert got[len(full) - 1].near_next < 1 and got[len(full) - 2].near_next == 1
    assert simhash.edited_fingerprints(docs(spark, ["x"]).limit(0)).count() == 0


def test_simhash_like_brute_force_with_odd_ids(spark):
    texts = [*ODD, "alpha beta gamma delta", "alpha beta gamma delta", "Alpha BETA gamma delta\x0bx", "wörter ÄRGER"]
    ids = [-(2**63), 2**63 - 1, None, 5, 5, None, *range(100, 100 + len(texts) - 6)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fingerprint string, at int")
    got = simhash.edited_fingerprints(df).collect()
    assert sorted((g.doc_id is not None, g.doc_id or 0, g.n_chars) for g in got) == sorted((i is not None, i or 0, len(t or "")) for i, t in zip(ids, texts, strict=True))
    words = sorted({w for t in texts for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w})
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}

    def plain(text):
        votes, total = [0] * 64, 0
        for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()):
            if w:
                total += min(len(w), 32)
                for b in range(64):
                    votes[b] += min(len(w), 32) * (hashes[w] >> b & 1)
        return sum(1 << b for b in range(64) if 2 * votes[b] > total)

    by_id = {g.doc_id: g for g in got if g.doc_id is not None and g.doc_id != 5}
    for i, t in zip(ids, texts, strict=True):
        if i in by_id:
            assert int(by_id[i].fingerprint, 16) == plain(t), t
    known = sorted((i, t or "") for i, t in zip(ids, texts, strict=True) if i is not None and i >= 100)
    for (i, t), (_, nxt) in itertools.pairwise(known):
        half = len(t) // 2
        cos = lambda a, b: max(0.0, float(np.cos(np.pi / 64 * (a ^ b).bit_count())))
        changed = t[: len(t) - half] + nxt[:half]
        if all(w in hashes for w in re.split(r"[\x20\x09-\x0D]+", changed.lower()) if w):
            assert int(by_id[i].edited_fingerprint, 16) == plain(changed) and np.isclose(by_id[i].near_edited, cos(plain(t), plain(changed)))
        assert np.isclose(by_id[i].near_next, cos(plain(t), plain(nxt)))


def test_radius_search_is_exact(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 20)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(6):
            v = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                v ^= 1 << int(bit) if bit < 63 else -(1 << 63)
            prints.add(v)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    got = {(r.fingerprint, r.other) for r in simhash.within_radius(df, df).collect()}
    m = 2**64 - 1
    assert got == {(a, b) for a in prints for b in prints if ((a ^ b) & m).bit_count() <= 3}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_memory_gives_the_librarys_ids(name):
    library = Tokenizer.from_file(P.path(name))
    texts = [t or "" for t in ODD]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(encoder(P.path(name)).encode(texts)) == want


def test_token_store_roundtrip(spark):
    folder = common.fresh_path(spark, "store")
    path = P.path("word_bpe_49k.json")
    manifest = token_store.write_store(docs(spark, ODD), folder, path)
    library = Tokenizer.from_file(path)
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in ODD]
    rows = sorted(token_store.read_store(manifest, folder).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, ids in zip(rows, want, strict=True):
        assert (bytes(r.ids), r.start) == (ids, at)
        at += len(ids) // 4
    some = token_store.read_store(manifest, folder, [3, 8]).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {3: want[3], 8: want[8]}
    assert token_store.read_store(token_store.write_store(docs(spark, ["x"]).limit(0), folder + "-none", path), folder + "-none").count() == 0


def test_a_damaged_frame_is_noticed(tmp_path):
    w = token_store.Writer()
    for k in range(50):
        w.add(k, np.arange(k, k + 5000, dtype="<u4").tobytes())
    data = bytearray(w.finish())
    (tmp_path / "good").write_bytes(data)
    fs = pafs.LocalFileSystem()
    r = token_store.Reader(fs.open_input_file(str(tmp_path / "good")))
    assert [d for d, _, _ in r.documents({7, 40})] == [7, 40] and len(r.packed) > 3
    sums = int(len(data) - 9 - 12 * len(r.packed) + 8)
    data[sums] ^= 1
    (tmp_path / "bad").write_bytes(data)
    with pytest.raises(ValueError):
        list(token_store.Reader(fs.open_input_file(str(tmp_path / "bad"))).documents())


def test_url_parts_rules_and_model(spark):
    rows = [(1, "http://Shop.COM/a"), (2, "https://www.example.com/en/x?q#f"), (3, "https://m.example.com/en/x"), (4, "http://a.net/es/1"), (5, None), (6, "no scheme"), (7, "http://x.org"), (8, "http://example.com?x/en/"), (9, "http://notcom/"), (7, "http://x.org")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect())
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert by[1] == ("shop.com", "/a", "com/", "allow")
    assert by[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert by[3] == ("m.example.com", "/en/x", "example.com/en/", "block")
    assert by[4][2:] == ("net/es/", "block")
    assert by[5][:3] == by[6][:3] == ("", "", None) and by[5][3] == "allow"
    assert by[7][:3] == ("x.org", "", None) and by[8][:3] == ("example.com", "", None) and by[9][0] == "notcom"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_threshold_with_a_rare_class(spark):
    """Held-out URLs are limited by class, so a rare class does not fall out and open the filter."""
    good, bad = [f"http://good{i}.com/abc/{i}" for i in range(600)], [f"http://pills{i}.net/es/zzz{i}" for i in range(20)]
    new = ["http://good9999.nex/abc/9", "http://pills9999.nex/ez/zzz9"]
    for blocked in (bad, bad[:1]):
        df = spark.createDataFrame(list(enumerate(good + blocked + new)), "page_id long, url string")
        got = {r.page_id: r for r in url_filter.filter_urls(df, sample=5).collect()}
        n = len(good) + len(blocked)
        assert got[n].rule is None and got[n + 1].rule is None and got[n].score > got[n + 1].score
        assert got[n + 1].verdict == "block"


def test_all_labelled_urls_are_counted_and_calibrate(spark):
    """More URLs of a class than were once sampled: each of them is in the counts, and limits are exact."""
    urls = spark.range(20_600).select(F.concat(F.lit("http://a.com/"), F.col("id").cast("string")).alias("url"), F.lit(True).alias("accepted"))
    few = spark.createDataFrame([("http://b.net/es/1", False)], "url string, accepted boolean")
    start = {r.gram: r.ratio for r in url_filter.model(urls.unionByName(few), order=0).collect()}
    a, r = 20_600, 1
    total = [urls.select(F.sum(F.length("url"))).first()[0], 17]
    rate = lambda n, c: (n + 2 / 256) / (c + 2)
    assert abs(start["m"] - np.log(rate(a, total[0]) / rate(0, total[1]))) < 1e-12
    assert abs(start["b"] - np.log(rate(0, total[0]) / rate(r, total[1]))) < 1e-12
    v = np.round(np.random.default_rng(2).normal(size=900), 2)
    for n, share in ((900, 0.01), (900, 0.99), (7, 0.01), (1, 0.99), (101, 0.01)):
        got = url_filter._quantile(spark.createDataFrame([(float(x),) for x in v[:n]], "score double"), share, n)
        assert abs(got - np.quantile(v[:n], share)) < 1e-12


def test_url_verdicts_like_a_plain_filter(spark):
    rng = np.random.default_rng(17)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    urls = [f"https://{word(5)}.com/{word(4)}" for _ in range(60)] + [f"http://{word(6)}x.net/fr/{word(9)}" for _ in range(60)]
    urls += [f"http://{word(5)}.org/{word(4)}" for _ in range(15)] + [f"http://{word(6)}x.io/fr/{word(9)}" for _ in range(15)] + [None, "", "no scheme", "http://", urls[0], urls[99], "ftp://é☃.org/"]
    rows = [(k if k % 40 else None, u, "clash") for k, u in enumerate(urls)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert len(got) == len(rows)
    order, smooth = url_filter.ORDER, url_filter.SMOOTHING
    said = {}
    for u in urls:
        host, path = (u.split("://", 1)[1].split("/", 1) + [""])[:2] if u and "://" in u else ("", "")
        if host.endswith(".com"):
            said[u] = True
        elif host.endswith(".net") and path.startswith("fr/"):
            said[u] = False
    df = spark.createDataFrame([(u,) for u in said], "url string")
    fold = {r.url: r.f for r in df.select("url", F.pmod(F.xxhash64("url", F.lit(11)), F.lit(5)).alias("f")).collect()}
    grams, context = [Counter(), Counter()], [Counter(), Counter()]
    for u, ok in said.items():
        if fold[u]:
            t = "\x02" * order + u
            for at in range(order, len(t)):
                for n in range(order + 1):
                    grams[ok][t[at - n : at + 1]] += 1
                    context[ok][t[at - n : at]] += 1

    def score(u):
        t, total = "\x02" * order + u, 0.0
        for at in range(order, len(t)):
            p, ratio = [1 / 256, 1 / 256], 0.0
            for n in range(order + 1):
                g = t[at - n : at + 1]
                if grams[0][g] + grams[1][g] == 0:
                    break
                p = [(grams[c][g] + smooth * p[c]) / (context[c][g[:-1]] + smooth) for c in (0, 1)]
                ratio = np.log(p[1] / p[0])
            total += ratio
        return total / len(u) if u else 0.0

    held = [np.array([score(u) for u, ok in said.items() if ok is c and fold[u] == 0]) for c in (False, True)]
    wide = [h.std() + 1e-6 for h in held]
    threshold = min((held[1].mean() * wide[0] + held[0].mean() * wide[1]) / sum(wide), np.quantile(held[1], 0.01))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    want = []
    for k, u, _ in rows:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host, path = rest.split("/", 1)[0], "/" + rest.split("/", 1)[1] if "/" in rest else ""
        verdict = "allow" if u is None or said.get(u) else "block" if u in said or score(u) < threshold else "allow"
        want.append((k, host, path, {True: "com/", False: "net/fr/"}.get(said.get(u)), verdict, None if u is None or u in said else score(u)))
    mine = sorted(((r.page_id, r.host, r.path, r.verdict, r.rule, r.score) for r in got), key=lambda r: (key(r[:4]), r[5] or 0))
    want = sorted(((a, b, c, e, d, f) for a, b, c, d, e, f in want), key=lambda r: (key(r[:4]), r[5] or 0))
    assert [r[:5] for r in mine] == [r[:5] for r in want]
    assert not [(a, b) for a, b in zip(mine, want, strict=True) if (a[5] is None) != (b[5] is None) or a[5] is not None and abs(a[5] - b[5]) >= 1e-6]
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_url_scores_are_those_of_a_plain_model(spark):
    good, bad = [f"http://good{i}.com/abc/{i}" for i in range(30)], [f"http://pills{i}.net/zzz/{i}" for i in range(30)]
    df = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean")
    table = {(r.gram): r.ratio for r in url_filter.model(df, order=2).collect()}

    def prob(urls, gram):
        p = 1 / 256
        for k in range(1, len(gram) + 1):
            g = gram[-k:]
            seen = sum(("\u0002\u0002" + u)[i - k : i] == g for u in urls for i in range(3, len(u) + 3))
            ctx = sum(("\u0002\u0002" + u)[i - k : i - 1] == g[:-1] for u in urls for i in range(3, len(u) + 3))
            p = (seen + 2.0 * p) / (ctx + 2.0)
        return p

    for gram in ("p", "om", "z/", "goo", "pil"):
        if gram in table:
            assert abs(table[gram] - np.log(prob(good, gram) / prob(bad, gram))) < 1e-9
    s = {r.url: r.score for r in url_filter.scored(spark.createDataFrame([("http://good99.com/abc",), ("http://pills7.net/z",)], "url string"), url_filter.model(df)).collect()}
    assert s["http://good99.com/abc"] > 0 > s["http://pills7.net/z"]


def brute_links(rows, t=0.93):
    ok = [(i, np.array(e, float), lab) for i, e, lab in rows if lab is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, comp = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    for (i, a, p), (j, b, q) in itertools.combinations(ok, 2):
        if p == q and a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
            n[i] += 1
            n[j] += 1
            lo, hi = sorted((comp[i], comp[j]))
            comp = {k: lo if c == hi else c for k, c in comp.items()}
    return n, comp


def test_embedding_links_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = []
    for lab in (0, 1):
        for _ in range(12):
            c = rng.normal(size=16)
            for s in (0.0, 0.0, 0.1, 0.3, 0.5):
                rows.append((len(rows), (c + s * rng.normal(size=16)).tolist(), lab))
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 1), (1003, rows[0][1], None), (1004, [None] * 16, 0), (1005, [1e-30 * x for x in rows[0][1]], 0), (1006, [], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, kind string")
    n, comp = brute_links(rows)
    for cell in (2048, 10):
        got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, cell=cell).collect()}
        assert {k: g.n_links for k, g in got.items()} == n
        assert {k: g.component_id for k, g in got.items()} == comp
        assert all(g.kept == (g.vec_id == g.component_id) for g in got.values())
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_ids_may_be_null_or_repeat(spark):
    e = np.eye(4)
    near = lambda k: (e[k] + 0.1 * e[(k + 1) % 4]).tolist()
    rows = [(-1, e[0].tolist()), (None, e[1].tolist()), (6, near(0)), (7, near(1)), (9, e[2].tolist()), (9, e[3].tolist()), (10, near(2)), (None, near(1)), (4, near(3)), (4, near(3))]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()), key=str)
    want = [(-1, 1, -1, True), (None, 2, 7, False), (6, 1, -1, False), (7, 2, 7, True), (9, 1, 9, True), (9, 2, 4, False), (10, 1, 9, False), (None, 2, 7, False), (4, 2, 4, True), (4, 2, 4, True)]
    assert got == sorted(want, key=str)


def test_cover_trees_prune_and_lose_no_pair():
    rng = np.random.default_rng(14)
    c = rng.normal(size=(150, 64))
    x = np.concatenate([c + s * rng.normal(size=c.shape) for s in (0.0, 0.1, 0.2, 0.3)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reach = float(np.sqrt(2 - 2 * 0.93))
    tree = embed_dedup.cover_tree(x, np.arange(len(x)), leaf=2)

    def check(node):
        assert np.sqrt(np.maximum(0, 2 - 2 * (x[node.points] @ node.centre))).max() <= node.radius + 1e-7
        if node.children:
            assert sorted(np.concatenate([k.points for k in node.children])) == sorted(node.points)
            assert all(k.radius < node.radius for k in node.children)
        return 1 + max(map(check, node.children), default=0)

    assert check(tree) > 2
    seen = set()
    compared = 0
    for p, q in embed_dedup.leaf_pairs(tree, tree, reach):
        compared += len(p) * len(q)
        seen |= {(min(a, b), max(a, b)) for a in p for b in q}
    close = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.93), strict=True) if i < j}
    assert close <= seen and compared < 0.05 * len(x) ** 2


def test_quality_keeps_good_and_rejects_junk(spark):
    rng = np.random.default_rng(6)
    words = ["river", "stone", "house", "walks", "under", "bright", "morning", "and", "the", "of"]
    good = [" ".join(rng.choice(words, 60)).capitalize() + "." for _ in range(80)]
    junk = [" ".join(w.upper() + "!!" for w in rng.choice(words, 60)) for _ in range(30)]
    df = docs(spark, good + junk + [None, ""])
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(0, 110, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = {r.doc_id: r.sampled for r in quality.resample(common.written(quality.score(df, quality.fit(df, labels)), "q")).collect()}
    assert all(out[k] for k in range(80)) and not any(out[k] for k in range(80, 110)) and out[110] and out[111]
    none = quality.fit(df, labels.limit(0))
    assert quality.resample(quality.score(df, none)).where("sampled").count() == 112
    assert quality.score(df.limit(0), none).count() == 0


def test_importance_resampling_like_brute_force(spark):
    rng = np.random.default_rng(31)
    good_words, bad_words = [f"g{k}" for k in range(40)], [f"g{k}" for k in range(30, 60)]
    texts = [" ".join(rng.choice(good_words if k % 3 else bad_words, int(rng.integers(1, 50)))) for k in range(240)] + [None, "", " \n", "g1"]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)], "doc_id long, quality int")
    buckets = 1 << 22
    model = quality.fit(df, labels, buckets=buckets)
    part = {r.labelled_id: (r.label, r.part) for r in quality.labelled(labels, "quality", 1000).collect()}
    assert {p for _, p in part.values()} == set(range(5))
    bags = [[re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    for b in bags:
        b.append(list(zip(b[0][:-1], b[0][1:], strict=True)))
    weight = [{}, {}]
    for kind in (0, 1):
        raw, target = Counter(), Counter()
        for k, b in enumerate(bags):
            raw.update(b[kind])
            if k in part and part[k][0] == 1 and part[k][1]:
                target.update(b[kind])
        total = sum(raw.values())
        for f, n in raw.items():
            weight[kind][f] = np.log((target[f] + quality.SMOOTHING * n / total) / (sum(target.values()) + quality.SMOOTHING) / (n / total))
    want = [sum(weight[kind][f] for kind in (0, 1) for f in b[kind]) for b in bags]
    scored = common.written(quality.score(df, model), "q")
    got = {r.doc_id: r for r in quality.resample(scored, 100, weight="log_weight", seed=7).collect()}
    # Two of some 2,000 pairs of words may share a bucket.
    assert np.isclose([got[k].log_weight for k in range(len(texts))], want).mean() > 0.9
    assert all(got[k].n_features == len(bags[k][0]) + len(bags[k][1]) for k in range(len(texts)))
    noise = np.array([got[k].gumbel_key - got[k].log_weight for k in range(len(texts))])
    assert abs(noise.mean() - 0.5772) < 0.3 and abs(noise.var() - np.pi**2 / 6) < 0.6
    keys = sorted((g.gumbel_key for g in got.values()), reverse=True)
    assert all(g.sampled == (g.gumbel_key >= keys[99]) for g in got.values())
    calibrated = {r.doc_id: r for r in quality.resample(scored).collect()}
    assert sum(r.sampled for r in calibrated.values()) == sum(r.advantage >= 0 for r in calibrated.values())
    assert all(np.isclose(r.advantage, r.log_weight + quality.PRIOR - model.floor * r.n_features) for r in calibrated.values())
    kept = quality.kept(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, r in calibrated.items() if r.sampled}
    twice = df.unionByName(df).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert quality.score(twice, model).count() == 2 * len(texts) and quality.kept(twice.limit(0), model).count() == 0
    assert quality.kept(twice, model, 2 * len(texts)).count() == 2 * len(texts)


def test_kth_largest(spark):
    v = [0.5, -3.0, 7.25, 7.25, 1e-9, 2.0, 2.0, 2.0]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for k in range(1, len(v) + 1):
        assert quality.kth_largest(df, "x", k, bins=3) == sorted(v, reverse=True)[k - 1]


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(200)]
    bad = ["vileword", "uglystem"]
    texts, y = [], []
    for k in range(400):
        t = list(rng.choice(words, 40))
        if k % 4 == 0:
            t[rng.integers(40)] = bad[k % 8 // 4] + ["", "ish", "ness"][k % 3]
        texts.append(" ".join(t))
        y.append(int(k % 4 == 0))
    df = docs(spark, texts + [None, ""])
    labels = spark.createDataFrame([(k, v) for k, v in enumerate(y)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert len(out) == 402 and all(0 <= r.score <= 1 for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.items())
    held = [k for k in range(400) if out[k].held_out]
    assert np.mean([out[k].predicted == y[k] for k in held]) > 0.97
    assert not out[400].predicted and not out[401].predicted
    none = toxicity.fit(df, labels.limit(0))
    assert toxicity.score(df, none).where("predicted = 0").count() == 402
    assert toxicity.score(df.limit(0), none).count() == 0


def test_toxicity_keeps_rare_terms(spark):
    """Insults that few examples have decide too, and every term of an example finds it."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(200)]
    bad = ["".join(rng.choice(list("bcdfghjklmnpqrstvz"), 8)) for _ in range(25)]
    texts = [" ".join([*rng.choice(words, 40), f"{k:03d}own", *([bad[k // 4 % 25]] if k % 4 == 0 else [])]) for k in range(400)]
    df = docs(spark, texts)
    index = toxicity.fit(df, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.score(df, index).collect()}
    held = [k for k in range(400) if out[k].held_out]
    assert np.mean([out[k].predicted for k in held if k % 4 == 0]) > 0.9
    assert np.mean([out[k].predicted for k in held if k % 4]) < 0.1
    known = [k for k in range(400) if not out[k].held_out][:20]
    alone = spark.createDataFrame([(k, f"{k:03d}own") for k in known], "doc_id long, text string")
    assert all(r.nearest == [r.doc_id] for r in toxicity.score(alone, index).collect())


@pytest.mark.parametrize("terms", [30, 400])
def test_block_max_search_is_exact(monkeypatch, terms):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "ROW", 4)
    rng = np.random.default_rng(9)
    index = toxicity.Index(np.arange(terms, dtype=np.uint64), rng.uniform(1, 3, terms))
    rows = []
    for k in range(900):
        at = np.sort(rng.choice(terms, rng.integers(1, 6), replace=False))
        rows.append((k, int(rng.random() < 0.3), tuple(at.tolist()), tuple(rng.integers(1, 4, len(at)).tolist())))
    flat = [np.array(sum((list(r[k]) for r in rows), []), np.int32) for k in (2, 3)]
    index = toxicity._filled(index, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([len(r[2]) for r in rows]), *flat, {})
    dense = np.zeros((index.n_entries, terms))
    term_of = np.repeat(np.arange(terms), np.diff(index.start))
    dense[index.post_entry, term_of] = (1 + np.log(index.post_tf)) * index.weight[term_of]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    queries = [(np.sort(rng.choice(terms, n, replace=False)), rng.integers(1, 3, n)) for n in [0, 4, 1, 6, 2, 0] * 8]
    cut = np.cumsum([0, *(len(a) for a, _ in queries)])
    at, tf = np.concatenate([a for a, _ in queries]), np.concatenate([t for _, t in queries])
    w = index.weights(cut, at, tf)
    q, e, c = index.search(cut, at, w, 10)
    for k in range(len(queries)):
        s = dense[:, at[cut[k] : cut[k + 1]]] @ w[cut[k] : cut[k + 1]]
        want = np.sort(s[s > 0])[::-1][:10]
        assert np.allclose(c[q == k], want, atol=1e-6) and np.allclose(s[e[q == k]], want, atol=1e-6)
        ties = list(zip(-c[q == k], e[q == k], strict=True))
        assert ties == sorted(ties)
    if terms == 400:
        assert index.opened < 0.7 * index.asked  # blocks are skipped


def test_toxicity_scores_like_brute_force(spark):
    rng = np.random.default_rng(21)
    words = [f"w{k}" for k in range(150)] + ["Éa", "ñu"]
    texts = [" ".join([*rng.choice(words, int(rng.integers(5, 40))), *(["vile"] if k % 5 == 0 else [])]) for k in range(300)]
    texts += [texts[3], texts[3].upper(), None, ""]
    df, n = docs(spark, texts), 200
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(n)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    index = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, index).collect()}
    bags = [Counter(re.findall(r"[0-9a-zéñ]+", (t or "").lower())) for t in texts]
    known = [k for k in range(n) if zlib.crc32(str(k).encode()) % 5]
    n1 = sum(k % 5 == 0 for k in known)
    n0 = len(known) - n1
    weight = {}
    for t in {t for k in known for t in bags[k]}:
        having, toxic = sum(t in bags[k] for k in known), sum(t in bags[k] for k in known if k % 5 == 0)
        g = 0.0
        for seen, row, column in ((toxic, n1, having), (having - toxic, n0, having), (n1 - toxic, n1, n0 + n1 - having), (n0 - having + toxic, n0, n0 + n1 - having)):
            g += 2 * seen * np.log(seen * (n0 + n1) / (row * column)) if seen else 0
        odds = max(np.log((toxic + n1 / (n0 + n1)) / (having - toxic + n0 / (n0 + n1)) * n0 / n1), 0)
        weight[t] = (np.log((1 + n0 + n1) / (1 + having)) + 1) * max(g / (g + 20) * odds**2 / (1 + odds**2), 0.01)

    def unit(bag):
        v = {t: (1 + np.log(c)) * weight[t] for t, c in bag.items() if t in weight}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {k: unit(bags[k]) for k in known}
    entries = {}
    for k in known:
        entries.setdefault(tuple(sorted(bags[k].items())), []).append(k)
    for k in range(len(texts)):
        mine = unit(bags[k])
        if not mine:
            continue
        s = sorted(((sum(x * vectors[m[0]].get(t, 0) for t, x in mine.items()), m) for m in entries.values()), key=lambda r: -r[0])[:15]
        up = sum(c**4 / np.sqrt(len(m)) * sum(d % 5 == 0 for d in m) for c, m in s) + n1 / (n0 + n1)
        down = sum(c**4 / np.sqrt(len(m)) * len(m) for c, m in s) + 1
        assert np.isclose(got[k].score, np.interp(up / down, *index.steps), atol=1e-4), k
        assert np.allclose(got[k].similarity, [c for c, _ in s[:3]], atol=1e-5) and got[k].nearest[0] in s[0][1]
    assert got[302].score == got[303].score and not got[302].nearest
    assert got[300].score == got[301].score == got[3].score
    kept = toxicity.kept(df, index)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [k for k in range(len(texts)) if got[k].score < 0.5]


def test_token_counts(spark):
    model = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, ODD), model, frequent=10, limit=100).collect()}
    for k, t in enumerate(ODD):
        n = len(library.encode(t or ""))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 100)
    assert token_counts.count_tokens(docs(spark, ["x"]).limit(0), model).count() == 0


def test_packing_covers_every_token_once(spark):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for k, t in enumerate(ODD)}
    pieces = packing.pack_documents(docs(spark, ODD), path, capacity=64, group_tokens=2000).collect()
    got, sequences = {k: b"" for k in want}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start * 4 == len(got[p.doc_id]) and p.length * 4 == len(p.ids) and p.doc_tokens * 4 == len(want[p.doc_id])
        got[p.doc_id] += bytes(p.ids)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end == 64 or end & (end - 1) == 0
    assert packing.pack_documents(docs(spark, ["x"]).limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs(spark, ["x"]), path, capacity=100)


def test_piece_search_gives_the_librarys_ids(spark):
    model = P.path("piece_bpe_32k.model")
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=model), piece_viterbi.Pieces(model)
    texts = [t or "" for t in ODD] + ["abcdetion" * 200, "▁ under ▁▁", "}\r();\r\n" * 20]
    for t in texts:
        ids = np.frombuffer(pieces.encode(t), "<u4").tolist()
        assert ids == library.encode(t)
        assert pieces.decode(pieces.encode(t)) == t.replace("▁", " ")
    # The same in one stream over the whole text, committing as paths meet.
    t = piece_viterbi.SPACE + LONG[:3000].replace(" ", piece_viterbi.SPACE)
    commits = list(pieces.search(t, check=16))
    assert len(commits) > 50 and "".join(sum(commits, [])) == t
    for text, check in ((LONG[:3000], 16), (" ".join(o for o in ODD if o) * 12 + "  runs   of spaces " * 300, 64), ("unbrokenlettersandthings" * 4000, 256)):
        got = pieces._ids(pieces.search(piece_viterbi.SPACE + text.replace(" ", piece_viterbi.SPACE), check=check))
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text)
    out = piece_viterbi.digest(piece_viterbi.decode_ids(piece_viterbi.encode_texts(docs(spark, ODD), model), model)).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {k: len(library.encode(t or "")) for k, t in enumerate(ODD)}
    # Repeated rows and rows without doc_id come back each; merging scans no neighbour twice and gives what rescanning gives.
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_tokens) for r in piece_viterbi.digest(piece_viterbi.decode_ids(piece_viterbi.encode_texts(twice, model), model)).collect()) == [(False, 2), (False, 2), (True, 0), (True, 1)]


def test_piece_search_merges_each_piece_once(spark, monkeypatch):
    """Boundaries are decided from pieces merged alone, not by merging every pair; what is decided is what merging both gives."""
    model = P.path("piece_bpe_32k.model")
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=model), piece_viterbi.Pieces(model)
    merged, merging = [], pieces.merging
    monkeypatch.setattr(pieces, "merging", lambda text: merged.append(text) or merging(text))
    rng = np.random.default_rng(7)
    parts = ["th", "on", "er", "ung", "ció", "ment", "eau", "ß", "re", "Sch", "ble", "is", "ñ", "TH", "ing", "z"]
    tails = ["", "", "", ".", ",", "!!", "%%%", "'s", ".)", "…", "☃"]
    text = " ".join("".join(rng.choice(parts, rng.integers(1, 7))) + str(rng.choice(tails)) for _ in range(4000))
    want = library.encode(text)
    assert np.frombuffer(pieces.encode(text), "<u4").tolist() == want
    pairs = sum(len(after) for after in pieces.after.values())
    assert len(merged) == len(set(merged)) < pairs / 2

    def rescanned(text):
        now = list(text)
        while at := max(((pieces.score[a + b], -k) for k, (a, b) in enumerate(itertools.pairwise(now)) if a + b in pieces.score), default=None):
            now[-at[1] : 2 - at[1]] = [now[-at[1]] + now[1 - at[1]]]
        return now

    every = list(pieces.id)
    spaces, short = [p for p in every if set(p) == {piece_viterbi.SPACE}], [p for p in every if len(p) < 5]
    some = [*itertools.product(spaces, spaces), *((str(a), str(b)) for a, b in rng.choice(every, (2000, 2))), *((str(a), str(b)) for a, b in rng.choice(short, (3000, 2)))]
    some += [(str(a), b) for a in rng.choice(every, 100) for b in spaces] + [("☃", "s"), ("", "the"), ("s", "☃")]
    kept = [pieces.keeps(a, b) for a, b in some]
    assert kept == [rescanned(a + b) == [x for x in (a, b) if x] for a, b in some] and 0 < sum(kept) < len(kept)
    # Tables that start anew now and then change nothing, nor does a stream that begins with what no piece covers.
    monkeypatch.setattr(piece_viterbi, "MOST_LEARNED", 200)
    pieces.forget()
    assert np.frombuffer(pieces.encode(text), "<u4").tolist() == want and pieces.learned < 2000
    for text in ("☃☃ the  end ☃", "\U0001f600the\U0001f600" * 300):
        assert "".join(sum(pieces.search(text, check=16), [])) == text
        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == library.encode(text)
    # One text without spaces doesn't learn beyond the bound either.
    text = "".join(rng.choice(parts, 20_000))
    assert np.frombuffer(pieces.encode(text), "<u4").tolist() == library.encode(text) and pieces.learned < 2000


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (7, 7), (102, 100)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in common.connected_components(df).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}
    assert common.connected_components(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs0 = spark.read.parquet(f"{d}/documents.parquet")
    now, sizes = docs0, [docs0.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = common.written(stage(spark, now, d), "stage")
        assert now.columns == docs0.columns
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, now, d)
    assert last.select("doc_id").distinct().count() == sizes[-1]
    texts = [r.text for r in now.orderBy("doc_id").collect()]
    assert len(set(brute_components(texts)[1])) == len(texts)




def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, repeats, empty and long texts, clashing names and empty tables go through all stages; each stage's result is checked by hand."""
    import corpus_pipeline

    rng = np.random.default_rng(51)
    words = [f"w{k}" for k in range(300)]
    clean = [" ".join(rng.choice(words, 60)).capitalize() + "." for _ in range(120)]
    junk = [" ".join(w.upper() + "!!" for w in rng.choice(words, 60)) for _ in range(20)]
    toxic = [" ".join([*rng.choice(words, 58), "vileword", "vileword"]) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(clean + junk + toxic)]
    rows += [(None, clean[3]), (None, "lone text of no id " + " ".join(words[:40])), (5, clean[5]), (6, " ".join(words[100:160])), (900, None), (901, ""), (902, clean[7] + " and more"), (903, " ".join(rng.choice(words, 30_000)))]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, gumbel_key string, score double")
    labels = spark.createDataFrame([(k, int(not 120 <= k < 140), int(k >= 140)) for k in range(170)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    for name, t in (("documents", df), ("labels", labels)):
        t.write.parquet(f"{tmp_path}/full/{name}.parquet")
        t.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
        (t.limit(0) if name == "labels" else t).write.parquet(f"{tmp_path}/unlabelled/{name}.parquet")
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    now = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = common.written(stages["quality"](spark, now, f"{tmp_path}/full"), "stage")
    assert good.columns == df.columns
    left = {(r.doc_id, r.text) for r in good.collect()}
    assert not left & set(rows[120:140]) and len(left & set(rows[:120])) > 117
    safe = common.written(stages["toxicity"](spark, good, f"{tmp_path}/full"), "stage")
    safe_rows = [(r.doc_id, r.text) for r in safe.collect()]
    assert safe.columns == df.columns and not set(safe_rows) & set(rows[140:170]) and len(set(safe_rows)) > len(left - set(rows[140:170])) - 3
    one = common.written(stages["near_duplicates"](spark, safe, f"{tmp_path}/full"), "stage")
    comp = brute_components([t for _, t in safe_rows])[1]
    groups = {}
    for c, (i, t) in zip(comp, safe_rows, strict=True):
        groups.setdefault(c, []).append((i is None, i or 0, t or ""))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in one.collect()) == sorted(min(g) for g in groups.values())
    packed = stages["packing"](spark, one, f"{tmp_path}/full").collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lengths = [(r.doc_id or -1, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in one.collect()]
    assert {(p.doc_id or -1, p.doc_tokens) for p in packed} == set(lengths)
    assert sum(p.length for p in packed) == sum(n for _, n in lengths)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/unlabelled").select("doc_id").distinct().count() > 150
