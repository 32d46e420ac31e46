"""Packing of token sequences by bounded-space online best fit.

Each task keeps a fixed number of open windows. A piece goes into the window whose room it fills best; when none has
room, the fullest window is emitted and a new one opened. What is left open when a task ends is merged afterwards, in
groups of a fixed number of tasks, by the same rule with the longest pieces first.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, crc
from tidemark.llm.tokens import encoded_rows, library_units
from tidemark.session import materialize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TASK_BITS = 32
MERGED = 1 << 62  # sequence ids from the merge lie above those of the tasks


class Windows:
    """At most ``open_windows`` open sequences of ``size`` tokens."""

    def __init__(self, size: int, open_windows: int, base: int):
        self.size, self.most, self.next = size, open_windows, base
        self.rooms: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def fits(self, length: int) -> int | None:
        at = bisect.bisect_left(self.rooms, (length, -1))
        return at if at < len(self.rooms) else None

    def put(self, piece: tuple) -> None:
        """``piece``: (doc_id, start, length, crc, doc_tokens), no longer than a window."""
        at = self.fits(piece[2])
        if at is None:
            if len(self.rooms) >= self.most:
                self.emit(0)
            room, number = self.size, self.next
            self.next += 1
            self.held[number] = []
        else:
            room, number = self.rooms.pop(at)
        self.held[number].append(piece)
        room -= piece[2]
        bisect.insort(self.rooms, (room, number))
        if room == 0:
            self.emit(0)

    def emit(self, at: int) -> None:
        _, number = self.rooms.pop(at)
        self.done += placed(self.held.pop(number), number)

    def fullest(self) -> int:
        """Room of the fullest window when all windows are open, else 0."""
        return self.rooms[0][0] if len(self.rooms) >= self.most else 0

    def leftovers(self) -> list[tuple]:
        rows = [r for _, number in self.rooms for r in placed(self.held[number], number)]
        self.rooms, self.held = [], {}
        return rows


def placed(pieces: list[tuple], number: int) -> list[tuple]:
    rows, offset = [], 0
    for p in pieces:
        rows.append((*p, number, offset))
        offset += p[2]
    return rows


def place_document(windows: Windows, doc_id, ids: bytes, least: int) -> None:
    """Whole windows are cut off first; the rest is put where it fits best. Where it fits nowhere, it fills up the fullest
    window if that takes at least ``least`` tokens, which keeps the padding of emitted windows below ``least``."""
    total, start = len(ids) // 4, 0

    def put(length: int) -> None:
        nonlocal start
        windows.put((doc_id, start, length, crc(ids[4 * start : 4 * (start + length)]), total))
        start += length

    while total - start >= windows.size:
        put(windows.size)
    while start < total:
        rest = total - start
        room = 0 if windows.fits(rest) is not None else windows.fullest()
        put(room if least <= room < rest else rest)


def columns(rows: list[tuple], done: bool, group: int) -> dict[str, list]:
    names = [f.split()[0] for f in PIECES.split(", ")]
    out = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}
    return out | {"done": [done] * len(rows), "group": [group] * len(rows)}


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    size: int = 2048,
    open_windows: int = 32,
    least: int = 64,
    tasks_per_merge: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    encode_special_tokens: bool = True,
) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``size`` tokens.

    A null text counts as empty; an empty text is its end token alone. Rows that repeat are packed as often as they
    occur; a null id is carried. An empty table gives no rows. Columns other than the two named are ignored. Added tokens of
    the vocabulary are matched in the texts if ``encode_special_tokens`` is false, and ordinary text otherwise.
    One scan encodes and packs; only the pieces (no ids) are stored, and only windows that a task left open are shuffled,
    ``open_windows * tasks_per_merge`` of them to a group at most.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        units, windows = library_units(tokenizer, encode_special_tokens), Windows(size, open_windows, task << TASK_BITS)
        for doc_ids, found in encoded_rows(batches, units):
            for doc_id, ids in zip(doc_ids, found, strict=True):
                place_document(windows, doc_id, ids + end, least)
            yield columns(windows.done, True, -1)
            windows.done = []
        yield columns(windows.leftovers(), False, task // tasks_per_merge)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(arrow_map(rows, run, f"{PIECES}, done boolean, group long"))

    names = [f.split()[0] for f in PIECES.split(", ")]

    def merge(left: pa.Table) -> pa.Table:  # Arrow keeps whole numbers whole beside nulls
        windows = Windows(size, open_windows * tasks_per_merge, MERGED + (left["group"][0].as_py() << TASK_BITS))
        left = left.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        for piece in zip(*[left[c].to_pylist() for c in names[:5]], strict=True):
            windows.put(piece)
        rows = list(zip(*(windows.done + windows.leftovers()), strict=True))
        return pa.table({c: pa.array(column, left.schema.field(c).type) for c, column in zip(names, rows, strict=True)})

    merged = pieces.filter("not done").groupBy("group").applyInArrow(merge, PIECES)
    return pieces.filter("done").drop("done", "group").unionByName(merged)
