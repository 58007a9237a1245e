"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the characters of a text. For each position it holds the last piece of the best path to it, and
with that a backpointer. The model is a BPE, whose best path is not the one of the highest sum but the one that merging
in order of scores leaves. Such a segmentation is exactly one in which every two neighbours are what merging gives for
them alone; so a path to a position may be extended by a piece if it keeps its boundary with the path's last piece, and
each position has one path at most. Only positions within the longest piece's length of the front can still be
extended. Whenever their paths meet in one boundary, the ids up to it are committed and forgotten: memory depends on
the longest piece and on how soon paths meet, not on the text.

The search walks an automaton over the starts of pieces, whose states tell what pieces end at a position. Whether two
pieces keep their boundary follows from the parts beside it as each piece is merged alone. What stands between two single
spaces is remembered by each worker, so that frequent words are searched once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import bound_batches, release
from .wordcache import Memory, rest_collector

SPACE = "▁"
#: Bytes of words, and of what stands behind them, that a worker remembers.
WORD_BYTES, TAIL_BYTES = 160 << 20, 16 << 20
#: Punctuation that often ends words.
TAIL = ".,;:!?%$#&*|)(-+/\"_=<>[]{}~@^`"
#: The score of what is no piece.
NEVER = float("-inf")
#: Most entries that the tables of a search learn in each worker, at about 100 bytes; then they start anew.
MOST_LEARNED = 1 << 20
_models: dict[str, "Pieces"] = {}


class State(dict):
    """What a search has read, as far as it starts a piece, and by the next character what it has read then.

    `ends` are the pieces that end here, the longest first: their lengths (negative: positions from the front), themselves,
    and what they keep their boundary with.
    """

    __slots__ = ("ends", "model", "read")

    def __init__(self, model: Pieces, read: str):
        self.model, self.read = model, read
        self.ends = [(-len(after.piece), after.piece, after) for k in range(len(read)) if (after := model.after.get(read[k:])) is not None]

    def __missing__(self, c: str) -> State:
        model, read = self.model, self.read + c
        while read not in model.states:
            read = read[1:]
        state = model.states[read]
        if state is None:
            state = model.states[read] = State(model, read)
        if read:  # characters of no piece may be many and are not remembered
            model.learned += 1
            self[c] = state
        return state


class After(dict):
    """Whether a piece keeps its boundary with a path's last piece, by that; not where there is no path (None)."""

    __slots__ = ("model", "piece")

    def __init__(self, model: Pieces, piece: str):
        self.model, self.piece = model, piece

    def __missing__(self, left: str | None) -> bool:
        kept = self[left] = left is not None and self.model.keeps(left, self.piece)
        self.model.learned += 1
        return kept


class Pieces:
    """The pieces of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("a model without normalisation, with a space before the text, is needed")
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        self.score = {p: s for _, p, s in normal}
        self.id = {p: i for i, p, _ in normal}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.longest = max(map(len, self.id))
        self.single = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        # What searches learn about the model: boundaries by their right piece, states by what they have read, pieces' sides.
        self.learned = 0
        self.after = {p: After(self, p) for p in self.id}
        self.states: dict[str, State | None] = dict.fromkeys(p[:k] for p in self.id for k in range(len(p) + 1))
        self.states[""] = State(self, "")
        self.sides: dict[str, tuple | None] = {}
        self.words = Memory(self._word, WORD_BYTES)
        self.tails = Memory(lambda tail: self._ids(self.search(tail)), TAIL_BYTES)
        self.together = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}

    def unlearn(self) -> None:
        for known in (*filter(None, self.states.values()), *self.after.values(), self.sides):
            known.clear()
        self.learned = 0

    def merging(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """Merges of a short text: the best-scored neighbours become one, the leftmost first. Each one's score, and the parts then."""
        parts, score = list(text), self.score
        scores = [score.get(a + b, NEVER) for a, b in pairwise(parts)]
        while scores and (best := max(scores)) > NEVER:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score.get(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = score.get(parts[at] + parts[at + 1], NEVER)
            yield best, parts

    def _sides(self, piece: str) -> tuple[list[str], list[float], list[str], list[float]] | None:
        """The first parts of a piece while it is merged alone, with the least score until each gives way; the last parts likewise.

        The last ones never do. None if merging does not give the piece.
        """
        heads, tails, head_until, tail_until = [piece[0]], [piece[-1]], [], []
        head_low = tail_low = float("inf")
        whole = len(piece) == 1
        for best, parts in self.merging(piece):
            head_low, tail_low, whole = min(head_low, best), min(tail_low, best), len(parts) == 1
            if parts[0] != heads[-1]:
                heads.append(parts[0])
                head_until.append(head_low)
                head_low = float("inf")
            if parts[-1] != tails[-1]:
                tails.append(parts[-1])
                tail_until.append(tail_low)
                tail_low = float("inf")
        return (heads, [*head_until, NEVER], tails, [*tail_until, NEVER]) if whole else None

    def _sides_of(self, piece: str) -> tuple[list[str], list[float], list[str], list[float]] | None:
        if (sides := self.sides.get(piece, False)) is False:
            self.learned += 8
            sides = self.sides[piece] = self._sides(piece)
        return sides

    def keeps(self, left: str, right: str) -> bool:
        """Whether merging both together gives both again. An empty left one keeps what merging gives at all.

        Until something is merged over the boundary, each side is merged as if it were alone, the better score first and the
        left side if they are equal. So the side whose part holds the higher least score gives way first, and what would
        cross the boundary is merged before if it beats that score (or equals it, on the right side, as it lies further left).
        """
        after = self._sides_of(right)
        before = self._sides_of(left) if left else None
        if after is None or before is None:
            return not left and after is not None
        score, (heads, head_until, _, _), (_, _, tails, tail_until) = self.score, after, before
        i = j = 0
        while True:
            cross, x, y = score.get(tails[i] + heads[j], NEVER), tail_until[i], head_until[j]
            if x >= y:
                if cross > x:
                    return False
                if x == NEVER:
                    return True
                i += 1
            else:
                if cross >= y:
                    return False
                j += 1

    def search(self, text: str, check: int = 256) -> Iterator[list[str]]:
        """Pieces of a text in order, a list each time that some are committed. A character that no piece covers comes as it is."""
        longest, state, n = self.longest, self.states[""], len(text)
        # Last pieces of the paths to the positions from `base` on, after as many as a piece may reach back: no index is out of range.
        base, ahead = 0, [None] * longest
        last: list[str | None] = [*ahead, ""]
        for start in range(0, n, check):
            if self.learned > MOST_LEARNED:
                self.unlearn()
            for c in text[start : start + check]:
                state = state[c]
                # A position has one path at most, so the first piece that keeps its boundary ends the look-out.
                for at, p, after in state.ends:
                    if after[last[at]]:
                        last.append(p)
                        break
                else:
                    last.append(None if c in self.id or last[-1] is None else c)
            i = start + check
            if i < n and i - base >= check and (meet := self._meeting(last, longest)) > longest:
                yield self._path(last, longest, meet)
                base += meet - longest
                last[longest:] = last[meet:]
                last[:longest] = ahead
        yield self._path(last, longest, len(last) - 1)

    @staticmethod
    def _meeting(last: list[str | None], longest: int) -> int:
        """The latest boundary that lies on the path to every position that can still be extended, as an index of `last`."""
        alive = {k for k in range(max(longest, len(last) - longest), len(last)) if last[k] is not None}
        while len(alive) > 1:
            k = max(alive)
            alive.remove(k)
            alive.add(max(longest, k - len(last[k])))
        return alive.pop() if alive else longest

    @staticmethod
    def _path(last: list[str | None], base: int, end: int) -> list[str]:
        out = []
        while end > base:
            p = last[end]
            out.append(p)
            end -= len(p)
        out.reverse()
        return out

    def _ids(self, committed: Iterable[list[str]]) -> bytes:
        """ids of pieces as they are committed; only the packed ids are kept."""
        packed = self.packed
        return b"".join([b"".join([packed.get(p) or self._spelled(p) for p in part]) for part in committed])

    def _spelled(self, c: str) -> bytes:
        """The byte pieces of a character that no piece covers."""
        return b"".join([self.bytes[b].to_bytes(4, "little") for b in c.encode()])

    def _word(self, word: str) -> bytes | None:
        if not word or SPACE in word or not self.single:
            return None
        # Between two characters that stand side by side in no piece all paths meet, so what lies before may be known already.
        body = word.rstrip(TAIL)
        if body and len(body) < len(word) and word[len(body) - 1 : len(body) + 1] not in self.together:
            return self.words[body] + self.tails[word[len(body) :]]
        return self._ids(self.search(SPACE + word))

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers; none for null and empty texts."""
        if not text:
            return b""
        try:
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        except TypeError:  # runs of spaces, or the space symbol itself
            return self._ids(self.search(SPACE + text.replace(" ", SPACE)))

    def forget(self) -> None:
        self.words.forget()
        self.tails.forget()
        self.unlearn()
        rest_collector(False)

    def decode(self, ids: bytes) -> str:
        raw = b"".join([self.raw[i] for i in memoryview(ids).cast("I")])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids (binary: little-endian unsigned 32-bit); null and empty texts have no ids.

    A row for each row, repeated or not; a null doc_id stays null; other columns are ignored, whatever their names; an
    empty table gives no rows. Besides a text and its packed ids, a search holds a window of the longest piece's length
    and what is not committed yet.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces(model).encode
        rest_collector(True)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([encode(t) for t in part.column("text").to_pylist()], pa.binary())], ["doc_id", "ids"])
        pieces(model).forget()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, ids, text; null ids give the empty text. The space symbol U+2581 reads back as a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = pieces(model).decode
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array([decode(b or b"") for b in part.column("ids").to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )
