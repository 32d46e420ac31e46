"""Document versions: history with validity ranges, as-of lookup, search at a point in time.

A version row holds ``doc_id, version_id, ts, content`` and whatever else the caller carries (``embedding``,
``metadata``). One document may own a third of all versions, so no step works on a whole document at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.knn import nearest
from tidemark.operators.ordered import page_of, with_neighbour, with_position, with_row_number, with_running


def version_id(doc_id: Column, ts: Column, content: Column) -> Column:
    return F.md5(F.concat_ws("|", doc_id.cast("string"), ts.cast("string"), content))


def new_versions(df: DataFrame, doc_id: str, ts: str, content: str = "content") -> DataFrame:
    """Stamp content rows as versions; the same document, time and content give the same id again."""
    return df.withColumn("version_id", version_id(F.col(doc_id), F.col(ts), F.col(content)))


def add_documents(df: DataFrame, doc_id: str = "doc_id", ts: str = "ts", content: str = "content") -> DataFrame:
    """The first version of every document; of several at one time the one with the smallest content."""
    rest = [c for c in df.columns if c != doc_id]
    first = df.groupBy(doc_id).agg(F.min_by(F.struct(*rest), F.struct(ts, content)).alias("_v")).select(doc_id, "_v.*")
    return new_versions(first, doc_id, ts, content).withColumn("is_active", F.lit(True))


def split_unknown(updates: DataFrame, known: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(updates of known documents, updates of unknown ones)."""
    ids = known.select(doc_id).distinct()
    return updates.join(ids, doc_id, "left_semi"), updates.join(ids, doc_id, "left_anti")


def history(versions: DataFrame, doc_id: str = "doc_id", ts: str = "ts", version: str = "version_id") -> DataFrame:
    """Validity of every version: ``version_no``, ``valid_from``, ``valid_to`` (null while current), ``is_active``."""
    placed = with_position(versions, [doc_id, ts, version])
    followed = with_neighbour(placed, [doc_id], {"valid_to": ts})
    return (
        with_row_number(followed, [doc_id], "version_no")
        .withColumn("valid_from", F.col(ts))
        .withColumn("is_active", F.col("valid_to").isNull())
        .drop("pos", "_slice")
    )


def as_of(
    versions: DataFrame, at: Column, doc_id: str = "doc_id", ts: str = "ts", version: str = "version_id"
) -> DataFrame:
    """Per document the latest version at or before ``at``; documents born later are absent."""
    rest = [c for c in versions.columns if c != doc_id]
    latest = F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(version)))
    return versions.where(F.col(ts) <= at).groupBy(doc_id).agg(latest.alias("_v")).select(doc_id, "_v.*")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the row that is last in ``order``; tasks pre-aggregate, so a hot key sends one row each."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, "_v.*")
    )


def current(history_rows: DataFrame) -> DataFrame:
    return history_rows.where("is_active")


def as_of_join(
    probes: DataFrame,
    versions: DataFrame,
    probe_ts: str,
    columns: Sequence[str],
    doc_id: str = "doc_id",
    ts: str = "ts",
    version: str = "version_id",
    probe_id: str = "probe_id",
) -> DataFrame:
    """For every probe the version of its document valid at its time, nulls when there is none.

    Both sides are sorted together once; the last version before a probe is the running last value of its document. No
    probe is ever paired with versions, and probes without one meet nowhere.
    """
    marks = versions.select(
        F.col(doc_id),
        F.col(ts).alias("_at"),
        F.lit(0).alias("_kind"),
        F.col(version).cast("string").alias("_tie"),
        *[F.col(c).alias(f"_o_{c}") for c in columns],
    ).unionByName(
        probes.select(
            F.col(doc_id),
            F.col(probe_ts).alias("_at"),
            F.lit(1).alias("_kind"),
            F.col(probe_id).cast("string").alias("_tie"),
            F.col(probe_id),
        ),
        allowMissingColumns=True,
    )
    placed = with_position(marks, [doc_id, "_at", "_kind", "_tie"])
    version_row = F.when(F.col("_kind") == 0, F.struct(*[F.col(f"_o_{c}").alias(c) for c in columns]))
    seen = with_running(placed, [doc_id], version_row, "_valid", "last")
    return seen.where("_kind = 1").select(probe_id, doc_id, F.col("_at").alias(probe_ts), *[F.col("_valid")[c].alias(c) for c in columns])


def search_at(
    versions: DataFrame,
    queries: DataFrame,
    at: Column,
    k: int = 5,
    doc_id: str = "doc_id",
    query_keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Top ``k`` documents per query vector by cosine with the version valid at ``at``; rows without vector are skipped."""
    return nearest(as_of(versions, at, doc_id), queries, k, id_col=doc_id, query_keys=query_keys)


def version_index(versions: DataFrame, ts: str = "ts", doc_id: str = "doc_id", page: int = 1000) -> DataFrame:
    """Timestamp to its (document, version) list, in pages of ``page`` entries so that no list grows without bound."""
    placed = with_row_number(with_position(versions.select(ts, doc_id, "version_id"), [ts, doc_id, "version_id"]), [ts])
    return (
        placed.withColumn("page", page_of(F.col("rn") - 1, page))
        .groupBy(ts, "page")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", doc_id, "version_id"))), lambda v: F.struct(v[doc_id], v["version_id"])).alias("versions"))
    )
