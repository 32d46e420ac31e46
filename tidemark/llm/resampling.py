"""Importance resampling of documents towards a target distribution, over hashed word runs.

Both corpora are counted in buckets of feature hashes; a bucket's gain is the log ratio of its smoothed shares, and a
document's weight the mean gain of its features. Gumbel noise from the hashed id turns the highest scores into a draw
without replacement.

Hashes are CRC-32, made in bulk: the distinct features of a slice are grouped by length, each group is a matrix of bytes, one
row a feature, and all CRCs of a matrix are advanced column by column. The results are scattered back over the features.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, worker_cache
from tidemark.operators.ordered import with_position
from tidemark.session import materialize

POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed; a fixed value
LONG = 512  # features of more bytes are hashed one by one, as hardly two of them share a length
CHUNK = 1 << 20  # bytes of text whose features are held as Python objects at a time
KNOWN = 500_000  # features whose bucket a worker remembers
SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
TO_WORDS = bytes.maketrans(bytes(range(0x41, 0x5B)) + SEPARATORS.translate(None, bytes(range(0x41, 0x5B))),
                           bytes(range(0x61, 0x7B)) + b" " * (len(SEPARATORS) - 26))


def crc_table() -> np.ndarray:
    """CRC-32 of every single byte, eight shifts each."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    return table


TABLE = crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a byte matrix."""
    value = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        value = TABLE[(value ^ column) & np.uint32(0xFF)] ^ (value >> np.uint32(8))
    return ~value


def crcs(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, feature in enumerate(features):
        by_length[len(feature)].append(i)
    out = np.zeros(len(features), np.uint32)
    for length, at in by_length.items():
        if length > LONG:
            out[at] = [zlib.crc32(features[i]) for i in at]
        else:
            matrix = np.frombuffer(b"".join([features[i] for i in at]), np.uint8).reshape(len(at), length)
            out[at] = crc_matrix(matrix)
    return out


class Buckets(dict):
    """Buckets of features; forgets all of them once it holds ``KNOWN``."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def of(self, features: list[bytes]) -> np.ndarray:
        if len(self) > KNOWN:
            self.clear()
        new = list(set(features) - self.keys())
        self.update(zip(new, (crcs(new) % np.uint32(self.buckets)).tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, features), np.uint32, len(features))


def pieces(text: bytes, runs: int) -> Iterator[tuple[int, list[bytes]]]:
    """Number of words, and features, of one part of a text after the other, cut between words."""
    data, start, carry = text.translate(TO_WORDS), 0, []
    while start < len(data):
        end = data.find(b" ", start + CHUNK)
        end = len(data) if end < 0 else end
        new = data[start:end].split()
        words, start = carry + new, end
        found = list(new)
        for k in range(2, runs + 1):
            first = max(0, len(carry) - k + 1)
            found += [b" ".join(words[i : i + k]) for i in range(first, len(words) - k + 1)]
        carry = words[len(words) - runs + 1 :] if 1 < runs <= len(words) else words if runs > 1 else []
        yield len(new), found


def hashed(docs: DataFrame, buckets: int, runs: int, id_col: str | None, text_col: str) -> DataFrame:
    """``doc_id, n_words, n_features, buckets`` of every row; buckets as little-endian unsigned 32-bit numbers, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        numbers = worker_cache(f"resampling {buckets}", lambda: Buckets(buckets))
        for batch in batches:
            for part in portions(batch):
                yield digest(part, numbers, runs)

    doc_id = F.lit(None) if id_col is None else F.col(id_col)
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_words long, n_features long, buckets binary")


def portions(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows as Python objects, of about ``CHUNK`` bytes or of one row."""
    held, size = [], 0
    for i in range(batch.num_rows):
        row = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
        held.append(row)
        size += len(row[1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def digest(rows: list[tuple], numbers: Buckets, runs: int) -> dict[str, list]:
    words, counts, found, owners = [0] * len(rows), [0] * len(rows), [], []
    parts: list[list[bytes]] = [[] for _ in rows]
    waiting: list[bytes] = []

    def flush() -> None:
        at = numbers.of(waiting)
        end = 0
        for i, n in owners:
            parts[i].append(at[end : end + n])
            end += n
        waiting.clear()
        owners.clear()

    for i, (_, text) in enumerate(rows):
        for n, features in pieces(text, runs):
            words[i] += n
            counts[i] += len(features)
            waiting.extend(features)
            owners.append((i, len(features)))
            if len(waiting) * 8 > CHUNK:
                flush()
    flush()
    for part in parts:
        found.append(np.sort(np.concatenate(part)).astype("<u4").tobytes() if part else b"")
    return {"doc_id": [r[0] for r in rows], "n_words": words, "n_features": counts, "buckets": found}


def bucket_counts(stored: DataFrame, buckets: int) -> list[int]:
    """How many features each bucket holds; a task sends one row per bucket it met, at most ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += np.bincount(np.frombuffer(batch.column(0)[i].as_buffer(), "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield {"bucket": at, "n": total[at]}

    sums = arrow_map(stored.select("buckets"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for bucket, n in sums.collect():  # at most one row per bucket
        out[bucket] = n
    return out


def gains(source: Iterable[int], target: Iterable[int], buckets: int) -> np.ndarray:
    """floor(1000 ln ratio) of the smoothed shares, per bucket, in doubles."""
    source, target = list(source), list(target)
    s_all, t_all = float(sum(source) + buckets), float(sum(target) + buckets)
    ratio = lambda s, t: ((t + 1.0) * s_all) / ((s + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source, target, strict=True)], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths, from the hashed id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    buckets: int = 10_000,
    runs: int = 1,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    Words are runs of ASCII digits, ASCII letters (upper case made lower) and all characters beyond ASCII; features are the
    runs of one to ``runs`` words. Of the N rows with at least ``least_words`` words the floor(``percent`` N / 100) of
    highest score have a rank, counted from 1. A null or empty text has no feature and the weight 0. Ties go to the smaller
    id, a null id (whose noise is that of an empty id) before all others; rows that share an id have the same noise and
    are ranked one by one, the one of fewer features first. Without a target all counts of it are zero. An empty table
    gives no rows. Other columns are ignored.

    The texts are read once: their buckets are stored, counted, and weighed from the store. Scores are whole thousandths of
    logarithms, so there are fewer than 200,000 different ones at any size; their counts give the lowest score that is
    drawn, and only rows from there on are sorted, over all tasks.
    """
    stored = materialize(hashed(docs, buckets, runs, id_col, text_col))
    wanted = materialize(hashed(target, buckets, runs, None, target_text))
    gain = gains(bucket_counts(stored, buckets), bucket_counts(wanted, buckets), buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [np.frombuffer(b.as_buffer(), "<u4") for b in batch.column(3)]
            yield {
                "doc_id": batch.column(0),
                "n_words": batch.column(1),
                "n_features": batch.column(2),
                "weight": [int(gain[at].sum()) // len(at) if len(at) else 0 for at in found],
            }

    weighed = arrow_map(stored, weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    usable = F.col("n_words") >= least_words
    drawn, lowest = draw(scored.filter(usable), percent)
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(out)
    near = usable & (F.col("score") >= lowest)
    unique = scored.filter(near).withColumn("row", F.monotonically_increasing_id())
    placed = with_position(unique, [F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "row"])
    ranked = placed.withColumn("rank", F.when(F.col("pos") < drawn, F.col("pos") + 1).cast("long"))
    rest = scored.filter(~near).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(out).unionByName(rest.select(out))


def draw(usable: DataFrame, percent: int) -> tuple[int, int | None]:
    """How many rows are drawn, and the lowest score among them (None if none is)."""
    counts = usable.groupBy("score").count().orderBy(F.desc("score")).collect()  # fewer than 200,000 scores
    drawn = percent * sum(r["count"] for r in counts) // 100
    seen = 0
    for r in counts:
        seen += r["count"]
        if drawn and seen >= drawn:
            return drawn, r["score"]
    return 0, None
