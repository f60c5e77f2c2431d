"""Packing documents into training sequences by bounded-space best fit.

Every task keeps at most ``OPEN`` open windows. A document's ids go, in full
windows first, to the open window that they fit best; when none fits, the
fullest is topped up with their head and emitted, so it has no padding.
A task's leftover windows are joined into full ones, and what remains of each
task (less than one window) is merged with other tasks' in groups of
``GROUP``; a group's last remainder is cut into powers of two, which need no
padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import checkpointed, lean, name_package
from shardloom.llm.tokens import grouped, words

WINDOW = 4096
OPEN = 32
GROUP = 64
END = 2
_COLS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

Piece = tuple[object, int, bytes, int]  # id, start, ids, tokens of the document


class Packer:
    """Windows of one task; emitted ones are lists of pieces, full to the last id."""

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most = window, most
        self.open: list[list[Piece]] = []
        self.free: list[int] = []
        self.done: list[list[Piece]] = []

    def add(self, doc: object, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self.done.append([(doc, at, ids[4 * at : 4 * (at + self.window)], total)])
            at += self.window
        while at < total:
            n = total - at
            fits = [f for f in self.free if f >= n]
            if fits:
                k = self.free.index(min(fits))
            elif len(self.open) < self.most:
                self.open.append([])
                self.free.append(self.window)
                k = len(self.open) - 1
            else:
                k = self.free.index(min(self.free))
                n = self.free[k]
            self.open[k].append((doc, at, ids[4 * at : 4 * (at + n)], total))
            self.free[k] -= n
            at += n
            if not self.free[k]:
                self.done.append(self.open.pop(k))
                self.free.pop(k)

    def finish(self) -> list[Piece]:
        """Join the open windows into full ones; the rest is less than one window."""
        pieces = [p for w in self.open for p in w]
        self.open, self.free = [], []
        full, rest = refill(pieces, self.window)
        self.done += full
        return rest


def refill(pieces: list[Piece], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Pieces end to end, cut into full windows, and what is left."""
    full, now, room = [], [], window
    for doc, start, ids, total in pieces:
        at, n = 0, len(ids) // 4
        while at < n:
            m = min(room, n - at)
            now.append((doc, start + at, ids[4 * at : 4 * (at + m)], total))
            at += m
            room -= m
            if not room:
                full.append(now)
                now, room = [], window
    return full, now


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces end to end, cut into sequences of falling powers of two."""
    out, rest = [], pieces
    while rest:
        total = sum(len(p[2]) for p in rest) // 4
        full, more = refill(rest, 1 << (total.bit_length() - 1))
        out.append(full[0])
        rest = [p for w in full[1:] for p in w] + more
    return out


def _batch(id_type: pa.DataType, id_col: str, windows: list[tuple[int, list[Piece]]], with_ids: bool, rest: int | None) -> pa.RecordBatch:
    rows: list[list] = [[] for _ in range(9)]
    for seq, pieces in windows:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            for col, v in zip(rows, (doc, start, n, zlib.crc32(ids), total, seq, at, ids if with_ids or rest is not None else None, rest), strict=True):
                col.append(v)
            at += n
    kinds = [id_type, *[pa.int64()] * 6, pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=[id_col, *_COLS, "ids", "rest"])


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, open_windows: int = OPEN, end_id: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Each id of each row's text (and ``end_id`` after it) lies in exactly one
    piece; in a sequence the offsets are gapless from 0. Sequences hold
    ``window`` ids, but for at most one set of powers of two per ``GROUP``
    tasks. Null and empty texts are packed as ``end_id`` alone; repeated rows
    and null ids are packed like any other; an empty table gives no pieces.
    Other columns are not read. ``ids`` are little-endian unsigned 32-bit.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in _COLS) + ", ids binary, rest long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, kind = TaskContext.get().partitionId(), 0, None
        encode, packer = words(vocabulary).encode_many, Packer(window, open_windows)
        for b in batches:
            kind = b.column(0).type
            ids = (i for part in grouped([t or "" for t in b.column(1).to_pylist()]) for i in encode(part))
            for doc, own in zip(b.column(0).to_pylist(), ids, strict=True):
                packer.add(doc, own + end)
                if len(packer.done) >= 512:
                    yield _batch(kind, id_col, list(enumerate(packer.done, (task << 32) + n)), with_ids, None)
                    n += len(packer.done)
                    packer.done = []
        if kind is None:
            return
        rest = packer.finish()
        if packer.done:
            yield _batch(kind, id_col, list(enumerate(packer.done, (task << 32) + n)), with_ids, None)
        if rest:
            yield _batch(kind, id_col, [(task << 32, rest)], with_ids, task)

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("rest", "ascending"), ("offset", "ascending")])
        group = t.column("rest")[0].as_py() // GROUP
        pieces = list(zip(*(t.column(c).to_pylist() for c in (id_col, "start", "ids", "doc_tokens")), strict=True))
        full, left = refill(pieces, window)
        windows = list(enumerate(full + powers(left), ((1 << 30) + group) << 32))
        return pa.Table.from_batches([_batch(t.column(id_col).type, id_col, windows, with_ids, None)])

    name_package(docs.sparkSession)
    pieces = checkpointed(docs.select(id_col, text_col).mapInArrow(lean(run), schema))
    # at most one window of ids per task meets in a group of GROUP tasks
    merged = pieces.where("rest is not null").groupBy(F.floor(F.col("rest") / GROUP).alias("part")).applyInArrow(merge, schema)
    out = pieces.where("rest is null").union(merged).drop("rest")
    return out if with_ids else out.drop("ids")
