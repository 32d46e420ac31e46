"""Item trees: every item to the root of its thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def thread_roots(items: DataFrame, item: str = "id", parent: str = "parent") -> DataFrame:
    """``id, root_id, is_orphan, in_circle``. An item whose parent is unknown ends at its topmost known ancestor; one whose
    parents run in a circle, or lead into one, ends at the circle's smallest id.

    Pointer doubling: a chain of n items needs log2(n) joins. Finished items leave the loop, and every round is written
    out once, so the lineage stays one join long. In every round that leaves an item with a root unfinished another one
    finishes, so once a round finishes none, all that is left leads into circles; only these go on.
    """
    nodes = materialize(items.select(F.col(item).alias("id"), F.col(parent).alias("parent")))  # read in every round
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    linked = materialize(nodes.where("parent is not null").join(known, "parent", "left"))
    tops = nodes.where("parent is null").select("id", F.col("id").alias("up"), F.lit(False).alias("is_orphan"))
    orphans = linked.where("_known is null").select("id", F.col("id").alias("up"), F.lit(True).alias("is_orphan"))
    finished = tops.unionByName(orphans)
    moving = linked.where("_known").select("id", F.col("parent").alias("up"), F.col("id").alias("low"))
    left, ended = moving.count(), True
    while left and ended:
        pointers = finished.select("*", F.lit(None).cast("bigint").alias("low"), F.lit(True).alias("done")).unionByName(
            moving.select("*", F.lit(False).alias("is_orphan"), F.lit(False).alias("done"))
        )
        ahead = pointers.select(F.col("id").alias("up"), F.col("up").alias("_next"), F.col("low").alias("_low"), "is_orphan", "done")
        step = moving.join(ahead, "up").select("id", F.col("_next").alias("up"), F.least("low", "_low").alias("low"), "is_orphan", "done")
        step = materialize(step)
        ended, left = step.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        finished = finished.unionByName(step.where("done").select("id", "up", "is_orphan"))
        moving = step.where("not done").select("id", "up", "low")
    if left:
        moving = _on_circles(moving)
    on_circle = moving.select(F.col("id").alias("up"), F.col("low").alias("root_id"))
    circles = moving.join(on_circle, "up").select("id", "root_id", F.lit(False).alias("is_orphan"), F.lit(True).alias("in_circle"))
    return finished.select("id", F.col("up").alias("root_id"), "is_orphan", F.lit(False).alias("in_circle")).unionByName(circles)


def _on_circles(moving: DataFrame) -> DataFrame:
    """Pointers of items that lead into circles (``id, up``, and ``low``, the smallest id on the way), doubled until every
    ``up`` lies on a circle and ``low`` of every item there is the smallest id of its circle.

    Both are so when a round leaves the number of items pointed at and every ``low`` as they were: what is pointed at only
    shrinks, to the circles; and windows along a circle that all have one smallest id cover it together.
    """
    aims = moving.agg(F.count_distinct("up")).first()[0]
    while True:
        ahead = moving.select(F.col("id").alias("up"), F.col("up").alias("_next"), F.col("low").alias("_low"))
        step = moving.join(ahead, "up").select("id", F.col("_next").alias("up"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("fell"))
        step = materialize(step)
        before, (aims, fell) = aims, step.agg(F.count_distinct("up"), F.count_if("fell")).first()
        moving = step.drop("fell")
        if aims == before and not fell:
            return moving


def branch(df: DataFrame, predicate) -> tuple[DataFrame, DataFrame]:
    """(rows where the predicate holds, all others); unknown goes to the others."""
    holds = F.coalesce(predicate, F.lit(False))
    return df.where(holds), df.where(~holds)


def story_and_comment_streams(items: DataFrame, is_story, item: str = "id", parent: str = "parent"):
    """(stories, comments re-keyed by their root), both as ``key, json``."""
    stories, comments = branch(items, is_story)
    columns = list(items.columns)
    told = stories.select(F.col(item).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("json"))
    roots = thread_roots(items, item, parent).select(F.col("id").alias(item), "root_id")
    rooted = comments.join(roots, item)
    said = rooted.select(
        F.col("root_id").cast("string").alias("key"), F.to_json(F.struct(*columns, "root_id")).alias("json")
    )
    return told, said
