"""Token ids in files of independent zstandard frames with a seek table and a checksum for each frame.

A file holds frames of whole documents' ids (little-endian unsigned 32-bit), one frame with the directory of its
documents, and at the end a skippable frame in zstandard's seekable format: compressed and raw size and the low 32 bits
of XXH64 for every frame. A reader takes the seek table from the file's tail, the directory, and then only the frames
that hold the documents asked for; each frame is checked against its checksum. Any zstandard tool can decompress a file.

Documents are dealt out by ranges of doc_id, so files in order of their names hold ascending doc_ids. A task writes
under a name of its own and renames, so a repeated task leaves the same file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, release, written
from .wordcache import encoder

#: Fixed values of zstandard's seekable format: skippable frame, seek table footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, FILE_BYTES = 1 << 18, 1 << 26
#: Most tasks that read a store back.
READERS = 10_000
_MANIFEST = "file string, docs long, tokens long, first_id long, last_id long"


class Writer:
    def __init__(self, level: int = 1):
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.parts, self.table, self.size = [], [], 0
        self.open, self.open_bytes = [], 0
        self.doc_id, self.has_id, self.frame, self.tokens = [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_id.append(doc_id or 0)
        self.has_id.append(doc_id is not None)
        self.frame.append(len(self.table))
        self.tokens.append(len(ids) // 4)
        self.open.append(ids)
        self.open_bytes += len(ids)
        if self.open_bytes >= FRAME_BYTES:
            self._close_frame()

    def _frame(self, raw: bytes) -> None:
        packed = self.zstd.compress(raw)
        self.parts.append(packed)
        self.size += len(packed)
        self.table.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _close_frame(self) -> None:
        if self.open:
            self._frame(b"".join(self.open))
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        n = len(self.doc_id)
        self._frame(struct.pack("<Q", n) + np.array(self.doc_id, "<i8").tobytes() + np.array(self.tokens, "<u8").tobytes() + np.array(self.frame, "<u4").tobytes() + np.array(self.has_id, "u1").tobytes())
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(table)) + table


class Reader:
    """Documents of one file, by random access."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        file.seek(size - 9 - 12 * n)
        entries = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.packed, self.raw, self.sums = (entries[:, k].astype(np.int64) for k in range(3))
        self.at = np.concatenate(([0], np.cumsum(self.packed)))
        directory = self.frame(n - 1)
        (d,) = struct.unpack_from("<Q", directory)
        self.doc_id = np.frombuffer(directory, "<i8", d, 8)
        self.tokens = np.frombuffer(directory, "<u8", d, 8 + 8 * d).astype(np.int64)
        self.of_frame = np.frombuffer(directory, "<u4", d, 8 + 16 * d)
        self.has_id = np.frombuffer(directory, "u1", d, 8 + 20 * d).astype(bool)
        self.start = np.cumsum(self.tokens) - self.tokens

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.packed[k])), max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: wrong checksum")
        return raw

    def documents(self, wanted=None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, its ids); frames without a wanted document are not read."""
        rows = np.arange(len(self.doc_id)) if wanted is None else np.flatnonzero(self.has_id & np.isin(self.doc_id, np.fromiter(wanted, np.int64)))
        now, raw, base = -1, b"", 0
        for r in rows:
            if (k := int(self.of_frame[r])) != now:
                now, raw = k, self.frame(k)
                base = int(self.start[np.searchsorted(self.of_frame, k)])
            s = 4 * (int(self.start[r]) - base)
            yield (int(self.doc_id[r]) if self.has_id[r] else None), int(self.start[r]), raw[s : s + 4 * int(self.tokens[r])]


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, fs_path = encoder(tokenizer).encode, end_id.to_bytes(4, "little"), pafs.FileSystem.from_uri(folder)
        fs, root = fs_path
        fs.create_dir(root, recursive=True)
        out, number, w = [], 0, Writer()

        def close() -> None:
            nonlocal number, w
            if not w.doc_id:
                return
            name = f"part-{TaskContext.get().partitionId():06d}-{number:06d}.zst"
            own = f"{root}/.{name}-{uuid.uuid4().hex}"
            known = [x for x, has in zip(w.doc_id, w.has_id, strict=True) if has]
            out.append((name, len(w.doc_id), sum(w.tokens), min(known, default=None), max(known, default=None)))
            with fs.open_output_stream(own) as f:
                f.write(w.finish())
            fs.move(own, f"{root}/{name}")
            number, w = number + 1, Writer()

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                    w.add(doc_id, ids + end)
                    if w.size >= FILE_BYTES:
                        close()
        close()
        encoder(tokenizer).forget()
        release()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "docs", "tokens", "first_id", "last_id"), x, strict=True)) for x in out], pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("docs", "tokens", "first_id", "last_id"))]))

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1) -> DataFrame:
    """Encode docs(doc_id, text, ...) into files in folder, ascending by doc_id (ties by text, nulls first). Returns the manifest: a row a file.

    Null texts count as empty; each document ends with end_id; repeated rows are written as often as they occur, and
    rows without doc_id before all others; other columns are ignored, whatever their names; an empty table writes no file.
    A task holds one file at most, and its longest text's ids. folder is a URI that pyarrow can open on every worker.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(dealt.mapInArrow(_write(folder, tokenizer, end_id), _MANIFEST), "manifest")
    # One row a file of tens of MB: this window is over a short list.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_store(manifest: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids. With doc_ids (a short list), only the frames that hold them are read."""
    wanted = None if doc_ids is None else sorted(set(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    rows, size = [], 0
                    for d, s, ids in Reader(f).documents(wanted):
                        rows.append((d, before + s, ids))
                        size += len(ids)
                        if size > 8_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    files = manifest.select("file", "before", "first_id", "last_id")
    if wanted is not None:
        files = files.where(F.expr("exists({}, x -> x between first_id and last_id)".format(f"array({','.join(f'{x}L' for x in wanted)})")) if wanted else F.lit(False))
    files = files.select("file", "before")
    # A number of partitions is not coalesced by the few bytes of the manifest: each file is a task, up to READERS tasks.
    return files.repartition(max(1, min(files.count(), READERS))).mapInArrow(run, "doc_id long, start long, ids binary")


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "start", "ids"])


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


__all__ = ["Reader", "Writer", "digest", "read_store", "write_store"]
