"""Invariants, skewed inputs, and the ways taken beyond the size bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.catalog.base import AS_OF, articles, at, candidates, centroids, collection, scored_candidates, vectors
from tidemark.operators import ingest, knn, threads, versions
from tidemark.operators.ordered import dealt, with_neighbour, with_position, with_row_number, with_running
from tidemark.session import shared_dir
from tidemark.sources import ranges, sinks


def test_softmax_sums_to_one_and_fused_scores_stay_in_range(spark, sf):
    from tidemark.operators.ranking import add_scores

    rows = add_scores(scored_candidates(spark, sf)).collect()
    totals = {}
    for r in rows:
        totals[r["query_id"]] = totals.get(r["query_id"], 0) + r["rerank_score"]
        for c in ("weighted_avg_score", "harmonic_mean_score", "geometric_mean_score"):
            assert r[c] is None or -1e-9 <= r[c] <= 1 + 1e-9
    assert all(abs(t - 1) < 1e-9 for t in totals.values())


def test_chunks_give_the_text_back(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for cost, budget in (("words", 10), ("chars", 120), (lambda s: F.length(s) + 1, 64)):
        pieces = docs.select("text", F.array_join(ingest.chunk_text(F.col("text"), budget, 2, cost), "").alias("again"))
        assert pieces.where("text <> again").count() == 0


def test_upsert_twice_equals_once(spark, sf, tmp_path):
    points, _ = ingest.ingest(articles(spark, sf), 64)
    path = str(tmp_path / "points")
    sinks.upsert(points, path, 0, ["updated_at", "article_id"], dim=64)
    once = sinks.read_collection(spark, path).count()
    sinks.upsert(points, path, 0, ["updated_at", "article_id"], dim=64)
    sinks.upsert(points, path, 1, ["updated_at", "article_id"], dim=64)
    assert sinks.read_collection(spark, path).count() == once
    with pytest.raises(Exception, match="vector size is not 32"):
        sinks.upsert(points, path, 2, ["updated_at", "article_id"], dim=32)


def skewed(spark, n=5000):
    """A third of the rows belongs to one key, and a third of those shares one time."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 1 / 3 else f"k{rng.randrange(200)}"
        ts = 77 if rng.random() < 1 / 3 else rng.randrange(1000)
        rows.append((key, ts, i))
    return rows, spark.createDataFrame(rows, "key string, ts bigint, id bigint").repartition(8)


@pytest.fixture
def many_slices(spark):
    """Keep the sort in several partitions, which Spark would merge for a table this small."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def test_ordered_windows_on_a_hot_key(spark, many_slices):
    rows, df = skewed(spark)
    placed = with_position(df, ["key", "ts", "id"])
    out = with_neighbour(
        with_neighbour(with_row_number(placed, ["key"]), ["key"], {"after": "id"}), ["key"], {"before": "id"}, step=-1
    )
    out = with_running(out, ["key"], F.col("id"), "biggest", "max")
    got = {r["id"]: r for r in out.collect()}
    slices = placed.select("_slice").distinct().count()
    assert slices > 1
    groups = {}
    for key, ts, i in sorted(rows):
        groups.setdefault(key, []).append(i)
    for ids in groups.values():
        for n, i in enumerate(ids):
            r = got[i]
            assert r["rn"] == n + 1
            assert r["after"] == (ids[n + 1] if n + 1 < len(ids) else None)
            assert r["before"] == (ids[n - 1] if n else None)
            assert r["biggest"] == max(ids[: n + 1])
    assert sorted(r["pos"] for r in out.collect()) == list(range(len(rows)))


def test_every_slice_has_a_task_of_its_own(spark, many_slices):
    _, df = skewed(spark)
    placed = with_position(df, ["key", "ts", "id"])
    slices = placed.select("_slice").distinct().count()
    tasks = [[r["_slice"] for r in part] for part in dealt(placed).select("_slice").rdd.glom().collect()]
    assert len(tasks) == slices > 4 and all(len(set(part)) == 1 for part in tasks)
    out = with_running(with_neighbour(placed, ["key"], {"after": "id"}), ["key"], F.col("id"), "biggest", "max")
    main = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert out.schema["_slice"].metadata == {"slices": slices, "dealt": True} and "SortMergeJoin" not in plan_of(out)
    assert out.rdd.getNumPartitions() == slices and "Join" not in main
    assert with_position(df.limit(0), ["key", "ts", "id"]).transform(dealt).count() == 0


def test_exploded_conflicts_hold_no_texts(spark):
    from tidemark.operators.conflicts import detect_conflicts

    pairs = spark.createDataFrame([(1, "Ann paid 10", "Bob paid 20")], "pair_id int, old_content string, new_content string")
    plan = detect_conflicts(pairs)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.rindex("Generate")]  # the first explode stands last
    assert plan.count("Generate") == 2 and "old_content#" not in above.replace("AS old_content#", "") and "_new#" not in above


def test_as_of_join_on_a_hot_key(spark, many_slices):
    rng = random.Random(3)
    stored = [("hot" if rng.random() < 0.5 else f"d{rng.randrange(20)}", rng.randrange(10_000), f"v{i}") for i in range(2000)]
    asked = [("hot" if rng.random() < 0.5 else f"d{rng.randrange(25)}", rng.randrange(-50, 10_500), i) for i in range(2000)]
    found = versions.as_of_join(
        spark.createDataFrame(asked, "doc_id string, at bigint, probe_id bigint"),
        spark.createDataFrame(stored, "doc_id string, ts bigint, version_id string").withColumn("seen", F.col("version_id")),
        "at",
        ["seen"],
    )
    got = {r["probe_id"]: r["seen"] for r in found.collect()}
    for doc, t, i in asked:
        known = [(ts, v) for d, ts, v in stored if d == doc and ts <= t]
        assert got[i] == (max(known)[1] if known else None)


def test_history_has_one_active_version_and_agrees_with_as_of(spark, sf):
    from tidemark.catalog.history import edits

    rows = versions.history(edits(spark, sf))
    live = versions.current(rows).select("doc_id", "version_id")
    assert live.count() == rows.select("doc_id").distinct().count()
    now = versions.as_of(edits(spark, sf), at("2030-01-01 00:00:00")).select("doc_id", "version_id")
    assert live.exceptAll(now).count() == 0 and now.exceptAll(live).count() == 0


def test_neighbours_equal_brute_force(spark, sf):
    rows = {r["chunk_id"]: np.array(r["embedding"], dtype=float) for r in vectors(spark, sf).collect()}
    asked = {r["query_id"]: np.array(r["embedding"]) for r in centroids(spark, sf).collect()}
    found = {}
    for r in knn.nearest(vectors(spark, sf), centroids(spark, sf), 7).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    for q, v in asked.items():
        score = {i: round(float(w @ v / np.linalg.norm(w) / np.linalg.norm(v)), 9) for i, w in rows.items()}
        best = sorted(score, key=lambda i: (-score[i], i))[:7]
        assert [found[q][n] for n in range(1, 8)] == best


def test_many_query_vectors_meet_the_chunks_block_by_block(spark, sf, monkeypatch):
    small = knn.nearest(vectors(spark, sf), centroids(spark, sf), 5)
    expected = sorted(map(tuple, small.collect()))
    asked = knn.query_vectors(centroids(spark, sf), at_most=3)
    assert asked.rows is None and asked.max_hits(5) is None
    assert sorted(map(tuple, knn.nearest(vectors(spark, sf), asked, 5).collect())) == expected


def test_long_query_tables_do_not_pass_the_driver(spark, monkeypatch):
    def through_the_driver(asked):
        raise AssertionError("blocks of queries passed the driver")

    rng = random.Random(3)
    vecs = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    vecs += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(150)] + [(2000, [0.0] * 4), (2001, None), (2002, [1.0]), (2003, [float("inf"), 1.0, 1.0, 1.0])]
    chunks = spark.createDataFrame(vecs, "chunk_id int, embedding array<double>").repartition(5)
    asks = [(i, v) for i, v in vecs[:40]] + [(7, [4.0, 3.0, 2.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.1]), (50, [0.0] * 4), (51, None)]
    asked = spark.createDataFrame(asks, "query_id int, embedding array<double>")
    expected = sorted(map(str, knn.nearest(chunks.where("chunk_id < 2003"), asked, 6).collect()))
    monkeypatch.setattr(knn, "blocks_of", through_the_driver)
    monkeypatch.setattr(knn, "TILE_VALUES", 4 * 60)
    monkeypatch.setattr(knn, "SCORES_AT_ONCE", 500)
    found = knn.nearest(chunks, knn.query_vectors(asked, at_most=3), 6)
    assert sorted(map(str, found.collect())) == expected and len(expected) == 41 * 6


def exchanged_rows(df):
    """Rows that the exchanges of a query that has run have written."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_long_query_tables_exchange_no_pairs(spark, monkeypatch):
    draw = np.random.default_rng(5)
    vecs = [(i, v.tolist()) for i, v in enumerate(draw.standard_normal((600, 4)))]
    rows = spark.createDataFrame(vecs, "chunk_id int, embedding array<double>").repartition(5)
    chunks, asked = rows.where("chunk_id < 400"), rows.withColumnRenamed("chunk_id", "query_id")
    expected = sorted(map(tuple, knn.nearest(chunks, asked, 3).collect()))
    monkeypatch.setattr(knn, "TILE_VALUES", 4 * 60)
    monkeypatch.setattr(knn, "SHORT_BLOCK", 20, raising=False)
    monkeypatch.setattr(knn, "TASKS_PER_CORE", 1, raising=False)
    found = knn.nearest(chunks, knn.query_vectors(spark.createDataFrame(asked.collect(), asked.schema), at_most=3), 3)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) == 1800
    assert exchanged_rows(found) <= 600 + 1800  # every query once and its hits, however many blocks there are


@pytest.mark.parametrize("k", [1, 7, 70])
def test_long_query_tables_in_small_tiles(spark, monkeypatch, k):
    draw = np.random.default_rng(6)
    plain = np.round(draw.standard_normal((500, 3)), 1)
    vecs = [(f"n{i:04}", v.tolist()) for i, v in enumerate(plain)] + [(f"c{i:04}", plain[i % 4].tolist()) for i in range(300)]
    vecs += [("z1", [1.0] * 5), ("z2", [2.0, 2.0, 2.0, 2.0, 1.0]), ("z3", [0.0] * 3), ("z4", None), (None, [1.0] * 3), ("z5", [])]
    chunks = spark.createDataFrame(vecs, "chunk_id string, embedding array<float>").repartition(4)
    asks = [(i, (plain[i] + 0.01).tolist()) for i in range(90)] + [(i % 2, plain[i].tolist()) for i in range(20)]
    by_length = {3: asks, 5: [(900, [1.0] * 5), (901, [5.0, 4.0, 3.0, 2.0, 1.0])]}
    kinds = "query_id int, embedding array<double>"
    expected = [r for rows in by_length.values() for r in knn.nearest(chunks, spark.createDataFrame(rows, kinds), k).collect()]
    for name, size in (("TILE_VALUES", 300), ("TILE_CHUNKS", 40), ("TILE_QUERIES", 8), ("TILE_GROUP", 4), ("SHORT_BLOCK", 10)):
        monkeypatch.setattr(knn, name, size, raising=False)
    asked = spark.createDataFrame(sum(by_length.values(), []) + [(5, []), (6, None), (7, [0.0] * 3)], kinds).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = knn.nearest(chunks, knn.query_vectors(asked, at_most=3), k).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected)) and len(found) > 90 * k


def test_scores_are_held_in_bounded_blocks(spark, sf, monkeypatch):
    expected = sorted(map(tuple, knn.nearest(vectors(spark, sf), centroids(spark, sf), 5).collect()))
    monkeypatch.setattr(knn, "SCORES_AT_ONCE", 40)
    assert sorted(map(tuple, knn.nearest(vectors(spark, sf), centroids(spark, sf), 5).collect())) == expected


def test_copies_of_one_vector_are_kept_by_id(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(900)] + [(900, [0.0, 0.0]), (901, None), (902, [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id int, embedding array<double>").repartition(8)
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<double>")
    assert [r["chunk_id"] for r in knn.nearest(chunks, asked, 4).orderBy("rank").collect()] == [1, 2, 4, 5]
    none = knn.nearest(chunks, asked.where("query_id = 2"), 4)
    assert none.count() == 0


def test_long_threads(spark):
    n = 3000
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(n + i, 5) for i in range(200)]
    rows += [(10_000, 9_999), (10_001, 10_000)]
    random.Random(1).shuffle(rows)
    got = {r["id"]: (r["root_id"], r["is_orphan"]) for r in threads.thread_roots(spark.createDataFrame(rows, "id bigint, parent bigint")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (0, False) for i in range(n + 200))
    assert got[10_000] == got[10_001] == (10_000, True)


def test_circles_end_when_nothing_changes(spark, monkeypatch):
    rows, expected = [], {}
    for start, tail, size, step in ((0, 0, 7, 1), (1000, 40, 1, 1), (2000, 13, 5, -1), (3000, 0, 64, 1), (4000, 9, 33, -1), (5000, 3, 2, 1)):
        ring = [start + 500 + step * i for i in range(size)]
        rows += [(a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
        way = [start + i if step > 0 else start + 900 - i for i in range(tail)]
        rows += list(zip(way, [*way[1:], ring[0]])) if way else []
        expected |= {i: (min(ring), False, True) for i in ring + way}
    rows += [(7000 + i, 7000 + i - 1 if i else None) for i in range(900)]
    expected |= {7000 + i: (7000, False, False) for i in range(900)}
    random.Random(2).shuffle(rows)
    stored, store = [], threads.materialize
    monkeypatch.setattr(threads, "materialize", lambda df: stored.append(1) or store(df))
    found = threads.thread_roots(spark.createDataFrame(rows, "id bigint, parent bigint")).collect()
    assert {r["id"]: (r["root_id"], r["is_orphan"], r["in_circle"]) for r in found} == expected and len(found) == len(rows)
    stored.clear()
    ring = [(7 * c + i, 7 * c + (i + 1) % 7) for c in range(200) for i in range(7)]
    found = threads.thread_roots(spark.createDataFrame(ring, "id bigint, parent bigint")).collect()
    assert all(r["root_id"] == r["id"] // 7 * 7 and r["in_circle"] for r in found) and len(found) == 1400
    assert len(stored) <= 6  # the rounds that seven need, not those that 1,400 would


def test_tasks_hold_bounded_rows(spark, tmp_path, monkeypatch):
    from tidemark import session
    from tidemark.catalog.history import filing_feeds
    from tidemark.operators import ordered

    orders = "id o_orderkey, id % 7 o_custkey, timestamp_ntz '2024-01-01' o_orderdate, '3-MEDIUM' o_orderpriority"
    spark.range(3000).selectExpr(*orders.split(", ")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")  # one row group
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200, raising=False)
    held = [r["count"] for r in filing_feeds(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 3000 and max(held) < 300
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100, raising=False)
    placed = ordered.with_position(spark.read.parquet(f"{tmp_path}/orders.parquet"), ["o_custkey", "o_orderkey"])
    held = [r["count"] for r in placed.groupBy("_slice").count().collect()]
    assert sum(held) == 3000 and max(held) < 200
    assert sorted((r["o_custkey"], r["o_orderkey"]) for r in placed.collect()) == [(r["o_custkey"], r["o_orderkey"]) for r in placed.orderBy("pos").collect()]


def test_words_are_counted_in_batches(spark, monkeypatch):
    import hashlib
    import re

    from tidemark.functions import vectors as module

    monkeypatch.setattr(module, "EMBED_ROWS", 7, raising=False)
    texts = [None, "", " - ", "A a b", "Zo\u00eb's 3,4\nK\u212a \u0130x"] + [f"word{i % 13} other{i} word{i % 5}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    made = rows.select("id", module.hash_embedding(F.col("text"), 16).alias("v"))
    assert "array_remove" not in plan_of(made)
    found = {r["id"]: r["v"] for r in made.collect()}
    cut = {r["id"]: r["w"] for r in rows.select("id", F.array_join(F.split(F.lower("text"), "[^a-z0-9]+"), " ").alias("w")).collect()}
    for i, text in enumerate(texts):
        counts = np.zeros(16)
        for word in re.findall("[a-z0-9]+", cut[i] or ""):
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
        length = np.sqrt((counts * counts).sum())
        assert found[i] == (list(counts / length) if length else None)


def test_long_ranges_are_dealt_out(spark):
    one = spark.createDataFrame([(1, 0, 45_000), (2, 9, 9), (3, 9, 2)], "p int, low bigint, high bigint")
    rows = ranges.unfold_ranges(one, ["p"])
    assert rows.agg(F.count("*"), F.min("item_id"), F.max("item_id"), F.countDistinct("item_id")).first()[:] == (45_000, 0, 44_999, 45_000)


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_plan(spark, sf):
    from tidemark.catalog.search import filtered

    plan = plan_of(filtered(spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("MapInArrow") == 1  # scoring; everything else stays in the JVM
    assert "GreaterThanOrEqual(created_at" in plan  # filters reach the scan, below the top-k
    first_scan = plan[plan.index("ReadSchema") :][:200]
    assert "WindowGroupLimit" in plan and first_scan


def test_running_last_skips_nulls_and_crosses_slices(spark, many_slices):
    rows, df = skewed(spark)
    placed = with_position(df, ["key", "ts", "id"])
    out = with_running(placed, ["key"], F.when(F.col("id") % 7 == 0, F.col("id")), "marked", "last")
    got = {r["id"]: r["marked"] for r in out.select("id", "marked").collect()}
    seen = {}
    for key, _, i in sorted(rows):
        if i % 7 == 0:
            seen[key] = i
        assert got[i] == seen.get(key)


def test_detectors_are_chosen(spark):
    from tidemark.operators.conflicts import detect_conflicts

    pairs = spark.createDataFrame([(1, "Ann paid 10 on Monday", "Bob paid 20 on Friday")], "pair_id int, old_content string, new_content string")
    whole = detect_conflicts(pairs).select("type", "old_content", "new_content").collect()
    for kind in ("numerical", "temporal", "entity"):
        alone = detect_conflicts(pairs, detectors=[kind]).select("type", "old_content", "new_content").collect()
        assert alone and sorted(alone) == sorted(r for r in whole if r["type"] == kind)
    with pytest.raises(ValueError):
        detect_conflicts(pairs, detectors=["tone"])


def test_candidates_are_bounded(spark, sf):
    counts = candidates(spark, sf).groupBy("query_id").count().collect()
    assert all(r["count"] <= 30 for r in counts)
    assert AS_OF and collection(spark, sf).groupBy("chunk_id").count().where("count > 1").count() == 0


def test_no_cross_joins_in_registered_queries(spark, sf):
    from tidemark.catalog import QUERIES

    for name in ("c1_all_conflicts", "j2_fallback_lookup", "v2_history", "s6_pages", "s9_key_shares", "u1_union_of_hits"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_hits_without_a_row_stay(spark):
    """A bounded set of hits is broadcast, a larger one is joined as it is; both keep every hit."""
    hits = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.8), (2, 7, 0.7), (2, None, 0.1)], "query_id long, chunk_id long, score double")
    rows = spark.createDataFrame([(7, "seven"), (9, "nine")], "chunk_id long, text string")
    want = {(1, 7, "seven"), (1, 8, None), (2, 7, "seven"), (2, None, None)}
    for bound in (4, None):
        got = knn.attach_payload(hits, rows, max_hits=bound).select("query_id", "chunk_id", "text").collect()
        assert len(got) == 4 and {tuple(r) for r in got} == want
    assert knn.attach_payload(hits, rows, how="inner", max_hits=4).count() == 2


def test_pruned_search_is_exact_and_skips_groups(spark):
    """Vectors in clumps: the answer is that of plain search, and most (query, group) cells are never scored."""
    from tidemark.operators import clusters

    draw = np.random.default_rng(3)
    middles = draw.standard_normal((30, 16))
    rows = [(i, (middles[i % 30] + 0.05 * draw.standard_normal(16)).tolist()) for i in range(3000)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0]), (5003, rows[7][1]), (5004, rows[7][1])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5)
    asked = [(q, (middles[q % 30] + 0.05 * draw.standard_normal(16)).tolist()) for q in range(40)] + [(99, rows[7][1])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    index = clusters.build(chunks, groups=64)
    want = sorted(map(tuple, knn.nearest(chunks, queries, 10).collect()))
    assert sorted(map(tuple, clusters.nearest(index, queries, 10).collect())) == want
    blocks = knn.query_vectors(queries, at_most=8)
    assert blocks.rows is None and sorted(map(tuple, clusters.nearest(index, blocks, 10).collect())) == want
    assert sorted(map(tuple, knn.nearest(chunks, blocks, 10).collect())) == want
    matrix = clusters.unit(np.array([v for _, v in asked]))
    apart = clusters.angles(matrix, index.centres)
    edge = np.array([min(r[2] for r in want if r[0] == q) for q, _ in asked])
    read = clusters.home_groups(apart, index.size, 10) | clusters.reachable(apart, index.radius, index.size, edge)
    assert read.sum() < 0.25 * read[:, index.size > 0].size
    assert clusters.nearest(index, queries.limit(0), 10).count() == 0
    assert clusters.build(chunks.where("chunk_id = 5000")) is None and clusters.nearest(None, queries, 3).count() == 0
    assert len(clusters.nearest(index, queries, 4000).where("query_id = 0").collect()) == 3002


def test_diversified_against_plain_rounds(spark):
    draw = np.random.default_rng(6)
    rows = [(q, i, float(np.round(draw.random(), 3)), draw.standard_normal(8).tolist()) for q in range(5) for i in range(25)]
    frame = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, embedding array<double>")
    got = {}
    for r in knn.diversified(frame, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for q in range(5):
        rest, taken = {r[1]: r for r in rows if r[0] == q}, []
        for _ in range(6):
            best = min(rest.values(), key=lambda r: (-round(0.5 * r[2] - 0.5 * max([cos(t[3], r[3]) for t in taken], default=0.0), 9), r[1]))
            taken.append(rest.pop(best[1]))
        assert got[q] == [t[1] for t in taken]


def test_first_rows_of_a_stream(spark, tmp_path):
    """The first row per key, whatever later batches bring; the state is Spark's, and a batch reads no earlier output."""
    from tidemark.streaming import jobs

    batches = [[(1, 5, "a"), (1, 3, "b"), (None, 9, "c")], [(1, 1, "d"), (2, 8, "e"), (2, 7, "f")], [(None, 1, "g"), (2, 1, "h"), (3, 0, None)]]
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "k long, at long, v string")
        frame.coalesce(1).write.mode("append").parquet(landing)
        stream = jobs.first_rows(jobs.read_landing(spark, landing, frame.schema, max_files=1), ["k"], ["at"])
        jobs.drain_updates(stream, lambda batch, i: jobs.put_batch(batch, out, i), str(tmp_path / "progress"))
    got = {r["k"]: (r["at"], r["v"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: (3, "b"), None: (9, "c"), 2: (7, "f"), 3: (0, None)} and spark.read.parquet(out).count() == 4


def test_totals_are_folded(spark, tmp_path, monkeypatch):
    from tidemark.streaming import jobs

    monkeypatch.setattr(jobs, "FOLD", 4)
    path, want = str(tmp_path / "totals"), {}
    for n in range(11):
        rows = spark.createDataFrame([(None, 1), (n % 3, n)], "k long, n long")
        for _ in range(2):  # a replay changes nothing
            before = jobs.totals_before(spark, path, n, rows.schema)
            got = {r["k"]: r["n"] for r in before.groupBy("k").agg(F.sum("n").alias("n")).collect()}
            assert got == want and len({f.split("/totals/")[1].rsplit("/", 1)[0] for f in before.inputFiles()}) <= 4
            jobs.put_totals(rows, path, n, "k")
        for k, v in ((None, 1), (n % 3, n)):
            want[k] = want.get(k, 0) + v


def test_days_are_pruned(spark, tmp_path):
    """A collection that is stored by day is read between the dates only, after compaction too."""
    from tidemark.plans.search import search_by_filters

    path, folded = str(tmp_path / "a"), str(tmp_path / "b")
    points = spark.range(60).select(
        F.col("id").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("text"), F.array(F.lit("s")).alias("symbols"),
        F.when(F.col("id") > 2, F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 43_200)).alias("created_at"),
        F.array(F.cos("id"), F.sin("id")).alias("embedding"), F.current_timestamp().alias("updated_at"), F.lit("s").alias("source"),
    )
    for batch in range(2):
        sinks.upsert(points, path, batch, ["created_at"], by_day="created_at")
    sinks.compact(spark, path, folded)
    asked = spark.createDataFrame([(1, "text")], "query_id long, query string")
    for stored in (path, folded):
        rows = sinks.read_collection(spark, stored)
        assert rows.count() == 60 and "created_day" in rows.columns
        found = search_by_filters(rows, asked, date_from=at("2024-01-05 06:00:00"), date_to=at("2024-01-07 00:00:00"), limit=99, dim=2)
        assert {r["chunk_id"] for r in found.collect()} == {9, 10, 11, 12}
    assert "PartitionFilters: [isnotnull(created_day" in found._jdf.queryExecution().executedPlan().toString()
