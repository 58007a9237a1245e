"""Structure repair of conversations: faults of turns, and the cheapest edits that make the roles legal.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Its edits are a path over the lattice of (turns
read, grammar state): keeping a turn costs 0, giving it another role 1, deleting it 2, inserting an empty turn 5, and a
truncated turn that stays 5 more. Dijkstra's algorithm opens lattice nodes as it comes to them, in order of (cost,
audit), audit being the edits' initials so far, and stops at the first accepting end node that it takes. A path to a
node is never a prefix of an equally dear one, as only inserts read nothing and they cost, so equal costs are settled by
the first edit that differs, and the least audit of all cheapest ones wins.

Faults come from column expressions and one window over equal turns. Turns then meet in one task a conversation, sorted,
and stream through it: a long one is solved by stretches. Between stretches only the four grammar states go on, without
those that cannot win any more, and what their audits have in common is settled and its turns leave memory.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, crc32_of

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: What may follow in each grammar state: nothing yet, after the system turn, after a user's, after an assistant's.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
#: AS[g][f]: most that it costs to go on from state g as one would from f; a state that is dearer by more cannot win.
AS = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
NAMES = {"u": "user", "a": "assistant"}
#: Turns of a stretch.
STRETCH = 256
_SPACE = " \t\n\x0b\x0c\r"
_MOST = 2**63 - 1


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> conv_id, turn, role, text, copies: rows with planted faults, by crc32 of `conv_id:turn`.

    Nulls count as one space. Of 20 remainders, 0 drops the row (copies 0), 1 empties its text, 2 takes its `.!?` out,
    3 repeats it (copies 2), 4 makes it the user's.
    """
    space = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    which = crc32_of(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), which.alias("which"))
    text = F.when(F.col("which") == 1, "").when(F.col("which") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("which") == 0, 0).when(F.col("which") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("which") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def flagged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) with `fault`: blank, duplicate, truncated or an empty string; rows of no copies stay as marks without text."""
    there = F.col("copies") > 0
    rows = rows.withColumn("copies", F.coalesce(F.col("copies"), F.lit(0)))
    rows = rows.select("conv_id", "turn", *[F.when(there, F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text")], "copies")
    core = F.rtrim(F.col("text"), F.lit(_SPACE))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(core == "", "blank").when(there & (F.col("nth") > 1), "duplicate").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.withColumn("nth", nth).withColumn("fault", F.coalesce(fault, F.lit(""))).drop("nth")


def cheapest(codes: str, front: tuple[tuple[int, int, str], ...], last: bool):
    """Dijkstra over a stretch. codes: a turn's role initial, `o` for others, in upper case if it is truncated, `x` if it must go.

    front: (cost, state, audit) of the paths that come in. last: (cost, audit) of the best accepting end; else those of
    all end nodes, as a front.
    """
    heap = [(cost, audit, 0, g) for cost, g, audit in front]
    heapq.heapify(heap)
    seen, ends, n = set(), [], len(codes)
    while heap:
        cost, audit, i, g = heapq.heappop(heap)
        if (i, g) in seen:
            continue
        seen.add((i, g))
        if i == n:
            if not last:
                ends.append((cost, g, audit))
                if len(ends) == len(NEXT):
                    break
            elif g in ACCEPTING:
                return cost, audit
        else:
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, g))
            if codes[i] != "x":
                initial = codes[i].lower()
                dear = cost + (CUT if codes[i] != initial else 0)
                for symbol, to in NEXT[g].items():
                    if symbol == initial:
                        heapq.heappush(heap, (dear + KEEP, audit + "K", i + 1, to))
                    elif symbol in NAMES:
                        heapq.heappush(heap, (dear + REROLE, audit + "R", i + 1, to))
        for symbol, to in NEXT[g].items():
            if symbol in NAMES:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, to))
    return tuple(ends)


_START = ((0, 0, ""),)
_whole = lru_cache(1 << 14)(lambda codes: cheapest(codes, _START, True))


class _Repair:
    """One conversation, turn by turn."""

    def __init__(self, conv_id, stretch: int) -> None:
        self.conv_id, self.stretch = conv_id, stretch
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.before = None
        self.waiting: list[tuple[str, str]] = []  # turns without settled edits
        self.codes: list[str] = []  # of the stretch
        self.front, self.audit, self.state = _START, [], 0

    def add(self, turn, role: str, text: str, fault: str) -> Iterator[tuple[str, str]]:
        """Takes a turn, gives the repaired turns that are settled by then."""
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if len(self.codes) == self.stretch:
            yield from self._stretch()
        code = initial if initial in ("s", "u", "a") else "o"
        self.codes.append("x" if fault in ("blank", "duplicate") else code.upper() if fault else code)
        self.waiting.append((role, text))

    def _stretch(self) -> Iterator[tuple[str, str]]:
        ends = cheapest("".join(self.codes), self.front, False)
        self.codes = []
        self.front = tuple(e for e in ends if all(e[0] <= b[0] + AS[b[1]][e[1]] for b in ends))
        yield from self._settle(commonprefix([audit for _, _, audit in self.front]))

    def _settle(self, edits: str) -> Iterator[tuple[str, str]]:
        self.audit.append(edits)
        self.front = tuple((cost, g, audit[len(edits) :]) for cost, g, audit in self.front)
        read = 0
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.waiting[read]
            read += edit != "I"
            if edit == "D":
                continue
            symbol = role[:1] if edit == "K" else "a" if self.state == 2 else "u"
            self.state = NEXT[self.state][symbol]
            yield role if edit == "K" else NAMES[symbol], text
        del self.waiting[:read]

    def close(self) -> Iterator[tuple[str, str]]:
        codes = "".join(self.codes)
        self.cost, rest = _whole(codes) if self.front is _START else cheapest(codes, self.front, True)
        yield from self._settle(rest)

    def report(self) -> dict:
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, _MOST)
        counts = {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal", "cost")}
        return {"conv_id": self.conv_id, "gaps": gaps, **counts, "audit": "".join(self.audit)}


def _events(batches: Iterator[pd.DataFrame], stretch: int) -> Iterator[tuple[_Repair, tuple[str, str] | None]]:
    """For each conversation of sorted rows: its repaired turns, then None."""
    one, none = None, object()
    known = none
    for pdf in batches:
        columns = (pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("conv_id", "turn", "role", "text", "copies", "fault"))
        for conv_id, turn, role, text, copies, fault in zip(*columns, strict=True):
            if known is none or conv_id != known:
                if one is not None:
                    yield from ((one, t) for t in one.close())
                    yield one, None
                known, one = conv_id, _Repair(conv_id if conv_id is None else int(conv_id), stretch)
            for nth in range(int(copies)):
                again = "duplicate" if nth and fault != "blank" else fault
                yield from ((one, t) for t in one.add(turn if turn is None else int(turn), role, text, again))
    if one is not None:
        yield from ((one, t) for t in one.close())
        yield one, None


def _sorted(rows: DataFrame) -> DataFrame:
    bound_batches(rows.sparkSession)
    # Whole numbers as text, as pandas would make doubles of longs with nulls.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = flagged(rows).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})


def repair_report(rows: DataFrame, *, stretch: int = STRETCH) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; a row for each conv_id.

    Turns come in order of turn (null first), then role and text; copies of a row follow each other. Each turn counts its
    first fault: blank (nothing but white space), duplicate (role and text seen before), truncated (the last character
    is none of `.!?`). Blank and duplicate turns must go. illegal: neighbours whose initials are none of su, ua, au.
    gaps: turn numbers missing between the least and the largest (at most 2^63 - 1), 0 without any. Conversations whose
    rows have no copies have zeros, an empty audit and the digest of nothing. Rows without conv_id make one
    conversation. Roles may be any text, also empty; only the first character is read. An empty table gives no rows,
    further columns are ignored. Memory holds the turns back to where all surviving edits agree, and a stretch.
    """

    def run(batches):
        reports, digest, first = [], hashlib.sha256(), True
        for one, turn in _events(batches, stretch):
            if turn is not None:
                digest.update(f"{'' if first else chr(10)}{turn[0]}:{turn[1]}".encode())
                first = False
                continue
            reports.append(one.report() | {"repaired_sha256": digest.hexdigest()})
            digest, first = hashlib.sha256(), True
            if len(reports) == 1024:
                yield pd.DataFrame(reports).astype({"conv_id": "Int64"})
                reports = []
        if reports:
            yield pd.DataFrame(reports).astype({"conv_id": "Int64"})

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _sorted(rows).mapInPandas(run, schema)


def repaired_turns(rows: DataFrame, *, stretch: int = STRETCH) -> DataFrame:
    """The repaired conversations themselves: conv_id, position (from 0), role, text. Input and order as `repair_report`; a conversation that loses all its turns has no row."""

    def run(batches):
        out, size, position = [], 0, 0
        for one, turn in _events(batches, stretch):
            if turn is None:
                position = 0
                continue
            out.append((one.conv_id, position, *turn))
            position, size = position + 1, size + len(turn[1])
            if len(out) == 2048 or size > 1 << 20:
                yield pd.DataFrame(out, columns=["conv_id", "position", "role", "text"]).astype({"conv_id": "Int64"})
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "position", "role", "text"]).astype({"conv_id": "Int64"})

    return _sorted(rows).mapInPandas(run, "conv_id long, position long, role string, text string")


__all__ = ["cheapest", "damaged", "flagged", "repair_report", "repaired_turns"]
