"""Token-id files of compressed bit planes.

Ids are cut into blocks of a fixed number. A block is transposed: plane ``b`` holds bit ``b`` of all its ids (or byte
``b``, in byte mode), and every plane is compressed with zstandard on its own. Planes above the highest set bit are left
out. Layout, all numbers little-endian::

    magic | planes of block 0, 1, ... | footer | footer length (8 bytes) | magic
    footer = head (mode, number of blocks, of planes, of documents) and, compressed with zstandard:
             ids and planes of each block, length of each plane, ids of each document, document ids and their nulls

Plane lengths are the chunk index: they give the place of every block without reading another.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, crc
from tidemark.llm.tokens import encoded_rows, library_units
from tidemark.session import materialize

MAGIC = b"TMPLANE1"
HEAD = struct.Struct("<BQQQ")
BLOCK = 1 << 16
FILE_IDS = 1 << 22  # a file is closed once it holds so many ids


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Bit or byte planes of unsigned 32-bit ids, lowest first, up to the highest that is not all zero."""
    top = int(ids.max(initial=0)).bit_length()
    if mode == "byte":
        rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [rows[:, b].tobytes() for b in range((top + 7) // 8)]
    return [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(top)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for b, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8)
        if mode == "byte":
            ids |= part.astype("<u4") << np.uint32(8 * b)
        else:
            ids |= np.unpackbits(part, count=n).astype("<u4") << np.uint32(b)
    return ids


class PlaneFile:
    """Collects one file; the bytes of a finished block are kept compressed only."""

    def __init__(self, mode: str, block: int = BLOCK, level: int = 3):
        import zstandard

        self.mode, self.block, self.pack = mode, block, zstandard.ZstdCompressor(level=level).compress
        self.body, self.waiting = [MAGIC], bytearray()
        self.block_ids, self.block_planes, self.plane_bytes = [], [], []
        self.doc_ids, self.doc_tokens, self.ids = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.doc_tokens.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.waiting += ids
        while len(self.waiting) >= 4 * self.block:
            self._close_block(4 * self.block)

    def _close_block(self, size: int) -> None:
        ids = np.frombuffer(bytes(self.waiting[:size]), "<u4")
        del self.waiting[:size]
        planes = [self.pack(p) for p in to_planes(ids, self.mode)]
        self.body += planes
        self.block_ids.append(len(ids))
        self.block_planes.append(len(planes))
        self.plane_bytes += map(len, planes)

    def finish(self) -> bytes:
        if self.waiting:
            self._close_block(len(self.waiting))
        head = HEAD.pack(self.mode == "byte", len(self.block_ids), len(self.plane_bytes), len(self.doc_ids))
        known = [d is not None for d in self.doc_ids]
        numbers = [self.block_ids, self.block_planes, self.plane_bytes, self.doc_tokens, [d or 0 for d in self.doc_ids]]
        packed = self.pack(b"".join(np.array(x, "<i8").tobytes() for x in numbers) + np.array(known, np.uint8).tobytes())
        footer = head + packed
        return b"".join([*self.body, footer, struct.pack("<Q", len(footer)), MAGIC])


def read_file(data: bytes) -> Iterator[tuple[int | None, int, int]]:
    """``doc_id, n_tokens, ids_crc32`` of every document, with one block in memory at a time."""
    for doc_id, parts in documents_of(data):
        n = value = 0
        for part in parts:
            n += len(part) // 4
            value = crc(part, value)
        yield doc_id, n, value


def documents_of(data: bytes) -> Iterator[tuple[int | None, list[bytes]]]:
    """Ids of every document, as the parts that its blocks hold."""
    import zstandard

    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a plane file, or cut short")
    (size,) = struct.unpack("<Q", data[-len(MAGIC) - 8 : -len(MAGIC)])
    footer = data[-len(MAGIC) - 8 - size : -len(MAGIC) - 8]
    byte_mode, n_blocks, n_planes, n_docs = HEAD.unpack(footer[: HEAD.size])
    unpack = zstandard.ZstdDecompressor().decompress
    index = unpack(footer[HEAD.size :])
    ends = np.cumsum([0, n_blocks, n_blocks, n_planes, n_docs, n_docs]) * 8
    block_ids, block_planes, plane_bytes, doc_tokens, doc_ids = (
        np.frombuffer(index[a:b], "<i8") for a, b in zip(ends[:-1], ends[1:], strict=True)
    )
    known = np.frombuffer(index[ends[-1] :], np.uint8)
    starts = np.concatenate([[0], np.cumsum(plane_bytes)]) + len(MAGIC)

    def blocks() -> Iterator[memoryview]:
        plane = 0
        for ids, planes in zip(block_ids.tolist(), block_planes.tolist(), strict=True):
            parts = [unpack(data[starts[p] : starts[p + 1]]) for p in range(plane, plane + planes)]
            plane += planes
            yield memoryview(from_planes(parts, ids, "byte" if byte_mode else "bit").tobytes())

    source, held = blocks(), memoryview(b"")
    for i in range(n_docs):
        missing, parts = 4 * int(doc_tokens[i]), []
        while missing:
            if not held:
                held = next(source)
            parts.append(bytes(held[:missing]))
            held, missing = held[len(parts[-1]) :], missing - len(parts[-1])
        yield (int(doc_ids[i]) if known[i] else None), parts


def write_file(path: str, name: str, data: bytes) -> None:
    """Appears under its name as a whole or not at all; a task that runs again writes the same bytes."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    part = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}")
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, posixpath.join(folder, name))


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    mode: str = "bit",
    id_col: str = "doc_id",
    text_col: str = "text",
    encode_special_tokens: bool = True,
) -> DataFrame:
    """Write ids of all texts, each closed by ``end_id``, in ascending order of id; returns one row per file.

    A null text counts as empty and leaves its end id. Null ids come first; rows with one id are ordered by text. An empty
    table writes no file. The texts are range-partitioned by id once; a task holds one file of bounded size at a time.
    Added tokens of the vocabulary are matched in the texts if ``encode_special_tokens`` is false.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        task, units = TaskContext.get().partitionId(), library_units(tokenizer, encode_special_tokens)
        number, out = 0, PlaneFile(mode)

        def close() -> dict:
            name = f"ids-{task:08d}-{number:06d}.planes"
            write_file(path, name, out.finish())
            return {"file": [name], "docs": [len(out.doc_ids)], "ids": [out.ids]}

        for doc_ids, found in encoded_rows(batches, units):
            for doc_id, ids in zip(doc_ids, found, strict=True):
                out.add(doc_id, ids + end)
                if out.ids >= FILE_IDS:
                    yield close()
                    number, out = number + 1, PlaneFile(mode)
        if out.doc_ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(arrow_map(ordered, run, "file string, docs long, ids long"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of a folder, in the order of the files.

    ``start`` counts the ids of all documents before it: those in its file, and the sums of the files before (one row per
    file in that window).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.planes").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = posixpath.basename(batch.column(0)[i].as_py())
                found = list(read_file(batch.column(1)[i].as_buffer().to_pybytes()))
                tokens = np.array([f[1] for f in found], np.int64)
                yield {
                    "file": [name] * len(found),
                    "doc_id": [f[0] for f in found],
                    "before": (np.cumsum(tokens) - tokens).tolist(),
                    "n_tokens": tokens.tolist(),
                    "ids_crc32": [f[2] for f in found],
                }

    rows = materialize(arrow_map(files, run, "file string, doc_id long, before long, n_tokens long, ids_crc32 long"))
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
