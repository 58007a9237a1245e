"""Conversation repair, prefix trie and line dedup against brute force, with odd inputs."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrallake.llm import conversation_repair, line_dedup, prefix_trie, queries

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SPACE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(spark, rows):
    """Rows with columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(*r, "clash", 7, b"x") for r in rows], "conv_id long, turn long, role string, text string, fault string, copies int, content binary")


def best_path(turns):
    """The cheapest edits of turns (initial, must go, dear), by a plain table over all turns and states."""
    states = {0: (0, "")}

    def inserted(states):
        for _ in range(3):
            for g, (cost, audit) in list(states.items()):
                for symbol, to in NEXT[g].items():
                    if symbol in "ua":
                        states[to] = min(states.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return states

    for initial, gone, dear in turns:
        states, then = inserted(states), {}
        for g, (cost, audit) in states.items():
            ways = [(g, cost + 2, "D")]
            if not gone:
                ways += [(to, cost + dear + (symbol != initial), "K" if symbol == initial else "R") for symbol, to in NEXT[g].items() if symbol == initial or symbol in "ua"]
            for to, c, letter in ways:
                then[to] = min(then.get(to, (10**9, "")), (c, audit + letter))
        states = then
    states = inserted(states)
    return min(states[g] for g in (0, 3) if g in states)


def brute_repair(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)."""
    out, by_conv = {}, defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        which = zlib.crc32(key.encode()) % 20
        by_conv[conv_id] += []
        if which == 0:
            continue
        text = "" if which == 1 else "".join(c for c in text if c not in ".!?") if which == 2 else text
        by_conv[conv_id] += [((turn is not None, turn or 0), "user" if which == 4 else role, text)] * (2 if which == 3 else 1)
    for conv_id, turns in by_conv.items():
        turns.sort()
        seen, faults = set(), []
        for _, role, text in turns:
            core = text.rstrip(SPACE)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t[1] for t, _, _ in turns if t[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = best_path([(i, f in ("blank", "duplicate"), 5 * (f == "truncated")) for i, f in zip(initials, faults, strict=True)])
        left, state, done = iter(turns), 0, []
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(left)
            if letter == "D":
                continue
            symbol = role[:1] if letter == "K" else "a" if state == 2 else "u"
            state = NEXT[state][symbol]
            done.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[symbol]}:{text}")
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv_id] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def odd_conversations(rng, n=60):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "unknown", "", None, "User"]
    texts = ["Yes.", "No!", "so", "well ?\n\t", " ", "", None, "a.b", "...", "é.", "same.", "x" * 3000 + "."]
    rows = []
    for conv_id in [*range(n), None, -7, 2**62]:
        for turn in range(int(rng.integers(1, 14))):
            if rng.random() < 0.7:
                role = ("user", "assistant")[turn % 2]
                text = f"turn {turn} of {conv_id}" + (".", "", "!")[rng.integers(3)]
            else:
                role, text = roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]
            rows.append((conv_id, None if rng.random() < 0.03 else int(turn + (turn > 4) * rng.integers(3)), role, text))
    return rows + rows[:7]  # repeated rows


def test_repair_like_brute_force(spark):
    rows = odd_conversations(np.random.default_rng(11))
    want = brute_repair(rows)
    for stretch in (256, 3, 1):  # short stretches: what crosses them is settled piece by piece
        got = conversation_repair.repair_report(conversation_repair.damaged(conversations(spark, rows)), stretch=stretch).collect()
        assert {g.conv_id: tuple(g)[1:] for g in got} == want and len(got) == len(want)
    turns = conversation_repair.repaired_turns(conversation_repair.damaged(conversations(spark, rows)), stretch=4).collect()
    by_conv = defaultdict(list)
    for t in sorted(turns, key=lambda t: (str(t.conv_id), t.position)):
        assert t.position == len(by_conv[t.conv_id])
        by_conv[t.conv_id].append(f"{t.role}:{t.text}")
    assert all(hashlib.sha256("\n".join(by_conv[k]).encode()).hexdigest() == v[-1] for k, v in want.items())


def test_repair_of_one_long_conversation(spark):
    """Thousands of turns of one conversation go through stretches, and memory holds few of them."""
    rng = np.random.default_rng(3)
    rows = [(1, k, ("user", "assistant")[k % 2] if rng.random() < 0.9 else ("system", "user", "tool")[rng.integers(3)], f"text {k}" + (".", "")[rng.random() < 0.1]) for k in range(4000)]
    got = conversation_repair.repair_report(conversation_repair.damaged(conversations(spark, rows)), stretch=64).first()
    assert tuple(got)[1:] == brute_repair(rows)[1]
    one, most = conversation_repair._Repair(1, 64), 0
    for _, turn, role, text in rows:
        list(one.add(turn, role, text, ""))
        most = max(most, len(one.waiting))
    assert most < 400


def test_dijkstra_settles_ties_by_the_least_audit():
    for n in range(6):
        for codes in itertools.product("suaoUAx", repeat=n) if n < 5 else [tuple(np.random.default_rng(k).choice(list("suaoUAx"), 9)) for k in range(300)]:
            turns = [(c.lower(), c == "x", 5 * c.isupper()) for c in codes]
            assert conversation_repair.cheapest("".join(codes), ((0, 0, ""),), True) == best_path(turns)


def test_repair_odd_tables(spark):
    empty = conversations(spark, [(1, 0, "user", "x")]).limit(0)
    assert conversation_repair.repair_report(conversation_repair.damaged(empty)).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = conversation_repair.repair_report(conversation_repair.damaged(conversations(spark, [(dropped, 0, "user", "x.")]))).collect()
    assert [tuple(g) for g in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert conversation_repair.repaired_turns(conversation_repair.damaged(empty)).count() == 0


def brute_trie(rows):
    by_conv = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            by_conv[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {}
    for conv_id, turns in by_conv.items():
        key = lambda t: (t[0], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()[:16])
        own[conv_id] = [(r, t) for _, r, t in sorted(turns, key=key)]
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in m if len(made[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_like_brute_force(spark):
    rng = np.random.default_rng(21)
    rows = []
    for c in [*range(40), -3, -5, 101, 103]:
        rows += [(c, k, ("user", "assistant", None)[k % 3], ("hello", f"t{rng.integers(2)}", None, "é" * 5, "w" * 4000)[rng.integers(5)]) for k in range(int(rng.integers(1, 12)))]
    rows += [(200 + c, k, "user", "same") for c in range(0, 60, 5) for k in range(70)]  # a large group of long copies
    rows += [(300, None, "user", "first"), (300, None, "user", "first"), (300, 0, "user", ""), (None, 0, "user", "of none")]
    for chunk in (1 << 12, 4):  # small chunks: prefixes are summed in parts
        got = sorted(tuple(r) for r in prefix_trie.conversation_trie(conversations(spark, rows), chunk=chunk).select(*TRIE).collect())
        assert got == brute_trie(rows)


def test_trie_odd_tables(spark):
    empty = conversations(spark, [(1, 0, "user", "x")]).limit(0)
    assert prefix_trie.conversation_trie(empty).count() == 0
    got = prefix_trie.conversation_trie(conversations(spark, [(3, 0, "user", "x")])).collect()
    want = brute_trie([(3, 0, "user", "x")])
    assert sorted(tuple(g) for g in got) == want


def brute_lines(texts, frequent):
    key = lambda line: line.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    split = [(t or "").split("\n") for t in texts]
    found = Counter(k for lines in split for k in {key(x) for x in lines})
    kept = [[x for x in lines if not key(x) or found[key(x)] < frequent] for lines in split]
    return [(len(lines), len(lines) - len(k), "\n".join(k)) for lines, k in zip(split, kept, strict=True)]


def test_line_dedup_like_brute_force(spark):
    rng = np.random.default_rng(9)
    pool = ["", " ", "Hot line", "\thot LINE \r", "École", "école", "ÉCOLE", "x" * 5000, *[f"line {k}" for k in range(60)], "\x0b\x0c"]
    weights = np.array([3, 1, 20, 5, 4, 4, 4, 1, *np.linspace(0.1, 6, 60), 1])
    texts = [None, "", "\n", "\n\n\n", "only one", "one\n"] + ["\n".join(rng.choice(pool, int(rng.integers(1, 40)), p=weights / weights.sum())) for _ in range(150)]
    texts += ["copied\nHot line\nend"] * 40 + ["\n".join(f"long {k}" for k in range(20000)) + "\nhot line"]
    ids = [*range(len(texts) - 5), None, None, 3, 3, 3]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, h1 string, batch int")
    want = sorted(((i, *w) for i, w in zip(ids, brute_lines(texts, 10), strict=True)), key=repr)
    for batches, fanout in ((8, 2), (1, 4)):
        got = line_dedup.drop_frequent_lines(df, batches=batches, fanout=fanout)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    one = line_dedup.drop_frequent_lines(df, frequent=2, least_chars=5, batch=F.coalesce(F.col("doc_id") % 3, F.lit(0)), batches=3)
    assert one.count() == len(texts)
    assert line_dedup.drop_frequent_lines(df.limit(0)).count() == 0


def test_line_runs_compact_and_skip_what_is_frequent(spark):
    runs, total = line_dedup.LineRuns(spark, 10, fanout=3), Counter()
    rng = np.random.default_rng(2)
    for _ in range(7):
        own = Counter(int(k) for k in rng.integers(0, 40, 60))
        total += own
        runs.add(spark.createDataFrame([(k, -k, n) for k, n in own.items()], "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n")))
        assert all(len(level) < 3 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 2]
    held = sum(runs._read(r).agg(F.sum("n")).first()[0] for level in runs.levels for r in level)
    assert held < sum(total.values())  # batches left out what the runs knew as frequent
    assert {(r.h1, r.h2) for r in runs.close().collect()} == {(k, -k) for k, n in total.items() if n >= 10}
    assert spark.catalog.listTables() == [] or not any(t.name.startswith("line_run") for t in spark.catalog.listTables())


def test_line_dedup_runs_no_python(spark):
    df = spark.createDataFrame([(k, "a\nb") for k in range(20)], "doc_id long, text string")
    plan = line_dedup.digest(line_dedup.drop_frequent_lines(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_prefix_trie", "op13_line_dedup"])
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = c.execute(queries.ORACLES[name])
    names = [x[0] for x in rel.description]
    ours = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(ours.columns)
    assert sorted((tuple(r) for r in ours.select(*names).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
