"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

SLICE = 256  # rows turned into Python objects at a time


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """``fn`` takes the batches of a task and yields column dicts that fit ``schema``; empty ones are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            arrays = [pa.array(columns[f.name], f.type) for f in arrow]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[list[list]]:
    """Columns as Python lists, a bounded number of rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield [c.to_pylist() for c in part.columns]


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not use, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        number = 0
        while f"_{name}_{number}" in taken:
            number += 1
        out.append(f"_{name}_{number}")
        taken.add(out[-1])
    return out


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """True for the fold that nothing may learn from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds == 0


def crc(ids: bytes, before: int = 0) -> int:
    return zlib.crc32(ids, before)


class WordIds(dict):
    """A stable 64-bit number for every word; forgets all words once it holds ``limit`` of them."""

    def __init__(self, limit: int = 300_000, seed: int = 0):
        super().__init__()
        import xxhash

        self.limit, self.seed, self.hash = limit, seed, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.hash(word, self.seed)
        return value

    def of(self, words: list) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling (finaliser of the splitmix generator)."""
    x = x.astype(np.uint64)  # a copy, changed in place
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def worker_cache(name: str, make: Callable[[], object], _held: dict = {}) -> object:  # noqa: B006
    """What a worker process builds once and keeps for its tasks, such as a loaded vocabulary; only the last one is kept, so
    that the stages of a pipeline do not add up."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]
