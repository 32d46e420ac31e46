"""Vector search, freshness, re-ranking, fusion, diversification, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import (
    AS_OF, CANDIDATES, CONFIDENCE, PAYLOAD, age_sql, at, candidates, centroids, collection, hits_sql, payload,
    query, questions, r6, scored_candidates, scratch, share_sql, stamp_sql, table, vectors, DIM,
)
from tidemark.catalog.texts import chunks_sql, clean_sql, counts_sql, buckets_sql
from tidemark.functions.freshness import Freshness, age_hours, boost, freshness_columns
from tidemark.functions.fusion import Fusion, variance
from tidemark.operators import clusters, knn, ranking, reports
from tidemark.operators.ordered import with_position
from tidemark.plans.search import search, search_by_filters
from tidemark.sources.sinks import read_collection, upsert

Spark, Rows = SparkSession, DataFrame
LIFE = Freshness()


# --- J, T, U: neighbours ----------------------------------------------------------------------------------------------


@query("j3_all_pairs_top", f"with {hits_sql(30)} select query_id, chunk_id, round(score, 6) score, rank from hits")
def all_pairs_top(spark: Spark, sf: str) -> Rows:
    found = knn.nearest(vectors(spark, sf), centroids(spark, sf), 30)
    return found.select("query_id", "chunk_id", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "j3_every_vector_asks",
    """select query_id, chunk_id, round(score, 6) score, rank from (
      select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from (
        select q.query_id, e.vec_id chunk_id, round(list_cosine_similarity(e.embedding::double[], q.v), 9) score
        from (select vec_id * 10 + s query_id, list_transform(embedding::double[], lambda x: x + s / 100.0::double) v
          from embeddings, range(10) r(s)) q, embeddings e))
    where rank <= 3""",
)
def every_vector_asks(spark: Spark, sf: str) -> Rows:
    """Every vector and nine shifted forms of it ask: more query vectors than a task takes at once."""
    shifted = vectors(spark, sf).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(9))))
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.col("s") / F.lit(100.0))
    asked = shifted.select((F.col("chunk_id") * 10 + F.col("s")).alias("query_id"), moved.alias("embedding"))
    found = knn.nearest(vectors(spark, sf), asked, 3)
    return found.select("query_id", "chunk_id", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("j3_pruned_search", f"with {hits_sql(30)} select query_id, chunk_id, round(score, 6) score, rank from hits")
def pruned_search(spark: Spark, sf: str) -> Rows:
    """The same answer from groups of near vectors, of which those that are out of every query's reach are not read."""
    index = clusters.build(vectors(spark, sf), groups=32)
    found = clusters.nearest(index, centroids(spark, sf), 30)
    return found.select("query_id", "chunk_id", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "t1_over_fetch",
    f"with {hits_sql(30)} select query_id, count(*) n, round(min(score), 6) worst, sum(chunk_id)::bigint ids from hits group by 1",
)
def over_fetch(spark: Spark, sf: str) -> Rows:
    found = knn.nearest(vectors(spark, sf), centroids(spark, sf), 3 * 10)
    return found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.min("score")).alias("worst"), F.sum("chunk_id").alias("ids")
    )


@query("t2_by_similarity", f"with {hits_sql(3)} select query_id, chunk_id, rank, round(score, 6) score from hits")
def by_similarity(spark: Spark, sf: str) -> Rows:
    found = knn.nearest(vectors(spark, sf), centroids(spark, sf), 30).drop("rank")
    ranked = ranking.rank_articles(found, 3, scorer=None)
    return ranked.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), r6("score").alias("score"))


@query("t6_plain_nearest", f"with {hits_sql(2)} select query_id, chunk_id, round(score, 6) score from hits")
def plain_nearest(spark: Spark, sf: str) -> Rows:
    return knn.nearest(vectors(spark, sf), centroids(spark, sf), 2).select("query_id", "chunk_id", r6("score").alias("score"))


@query("f5_min_score_after_limit", f"with {hits_sql(5)} select query_id, chunk_id from hits where score >= 0.3")
def min_score_after_limit(spark: Spark, sf: str) -> Rows:
    found = knn.nearest(vectors(spark, sf), centroids(spark, sf), 5)
    return found.where("score >= 0.3").select("query_id", "chunk_id")


def _mmr() -> str:
    sim = "round(list_cosine_similarity(x.v, y.v), 9)"
    rounds = ["r1 as (select query_id, min_by(chunk_id, (-score, chunk_id)) id from c group by query_id)"]
    for n in (2, 3):
        taken = " union all ".join(f"select * from r{i}" for i in range(1, n))
        rounds.append(f"""t{n} as ({taken}), r{n} as (
          select query_id, min_by(chunk_id, (-value, chunk_id)) id from (
            select x.query_id, x.chunk_id, round(0.5 * any_value(x.score) - 0.5 * max({sim}), 9) as value
            from c x join t{n} t on t.query_id = x.query_id join c y on y.query_id = t.query_id and y.chunk_id = t.id
            where (x.query_id, x.chunk_id) not in (select query_id, id from t{n})
            group by x.query_id, x.chunk_id)
          group by query_id)""")
    out = " union all ".join(f"select query_id, {n}::bigint rank, id chunk_id from r{n}" for n in (1, 2, 3))
    return f"""with {hits_sql(20)}, c as (select h.query_id, h.chunk_id, h.score, e.embedding::double[] v
      from hits h join embeddings e on e.vec_id = h.chunk_id), {', '.join(rounds)} {out}"""


@query("t7_diversified", _mmr())
def diversified(spark: Spark, sf: str) -> Rows:
    asked = knn.query_vectors(centroids(spark, sf))
    found = knn.nearest(vectors(spark, sf), asked, 20)
    rows = knn.attach_payload(found, vectors(spark, sf), how="inner", max_hits=asked.max_hits(20))
    return knn.diversified(rows, 3).select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id")


@query(
    "j10_late_payload",
    f"with {hits_sql(10)}, {PAYLOAD} select query_id, chunk_id, lang, md5(text) digest from hits left join payload using (chunk_id)",
)
def late_payload(spark: Spark, sf: str) -> Rows:
    asked = knn.query_vectors(centroids(spark, sf))
    found = knn.nearest(vectors(spark, sf), asked, 10)
    rows = knn.attach_payload(found, payload(spark, sf), max_hits=asked.max_hits(10))
    return rows.select("query_id", "chunk_id", "lang", F.md5("text").alias("digest"))


# a question made of several vectors: the centroids of odd and even labels ask together
_UNION = f"{hits_sql(30)}, u as (select query_id % 2 query_id, chunk_id, score from hits)"


def _hits_of_parts(spark: Spark, sf: str) -> Rows:
    found = knn.nearest(vectors(spark, sf), centroids(spark, sf), 30)
    return found.select((F.col("query_id") % 2).alias("query_id"), "chunk_id", "score")


@query("u1_union_of_hits", f"with {_UNION} select query_id, chunk_id, round(max(score), 6) score from u group by 1, 2")
def union_of_hits(spark: Spark, sf: str) -> Rows:
    return knn.union_hits(_hits_of_parts(spark, sf)).select("query_id", "chunk_id", r6("score").alias("score"))


@query("u1_union_strict", f"with {_UNION} select distinct query_id, chunk_id, round(score, 6) score from u")
def union_strict(spark: Spark, sf: str) -> Rows:
    return knn.union_hits(_hits_of_parts(spark, sf), strict=True).select("query_id", "chunk_id", r6("score").alias("score"))


# --- R: freshness -----------------------------------------------------------------------------------------------------

_AGED = f"with a as (select event_id, {age_sql('ts', '2024-01-30 00:00:00')} age from events)"
_CATEGORY = "case when age <= 1 then 'real-time' when age <= 4 then 'very_fresh' when age <= 12 then 'fresh' when age <= 24 then 'recent' else 'outdated' end"


def _aged(spark: Spark, sf: str) -> Rows:
    events = table(spark, sf, "events")
    return events.withColumns(freshness_columns(F.col("ts"), at("2024-01-30 00:00:00")))


@query("r1_confidence", f"{_AGED} select event_id, round({CONFIDENCE}, 6) confidence_score from a")
def confidence(spark: Spark, sf: str) -> Rows:
    return _aged(spark, sf).select("event_id", r6("confidence_score").alias("confidence_score"))


@query("r2_category", f"{_AGED} select event_id, {_CATEGORY} freshness_category from a")
def freshness_category(spark: Spark, sf: str) -> Rows:
    return _aged(spark, sf).select("event_id", "freshness_category")


@query("r3_is_fresh", f"{_AGED} select event_id, age <= 4 is_fresh from a")
def is_fresh(spark: Spark, sf: str) -> Rows:
    return _aged(spark, sf).select("event_id", "is_fresh")


@query("r4_boost", f"{_AGED} select event_id, round(({CONFIDENCE}) * ({CONFIDENCE}), 6) boost_factor from a")
def boost_factor(spark: Spark, sf: str) -> Rows:
    return _aged(spark, sf).select("event_id", r6("boost_factor").alias("boost_factor"))


_BOOSTED = f"""{{}}, e as (select h.query_id, h.chunk_id, h.score, {age_sql('ts')} age from {{}} h join events on event_id = h.chunk_id),
    b as (select query_id, chunk_id, score * ({CONFIDENCE}) * ({CONFIDENCE}) boosted from e)"""


def _boosted(hits: Rows, spark: Spark, sf: str) -> Rows:
    times = table(spark, sf, "events").select(F.col("event_id").alias("chunk_id"), F.col("ts").alias("updated_at"))
    trust = LIFE.confidence(age_hours(F.col("updated_at"), at(AS_OF)))
    return hits.join(times, "chunk_id").withColumn("boosted", F.col("score") * boost(trust))


@query(
    "r5_fresh_search",
    """with e as (select event_id, (epoch_us(timestamp '2024-01-30') - epoch_us(ts)) / 3.6e9 age, user_id % 7 / 7 relevance from events),
    b as (select event_id, relevance * ({c}) * ({c}) boosted from e)
    select event_id, round(boosted, 6) final_score from b order by round(boosted, 9) desc, event_id limit 5""".format(c=CONFIDENCE),
)
def fresh_search(spark: Spark, sf: str) -> Rows:
    rows = _aged(spark, sf).withColumn("final_score", F.col("user_id") % 7 / 7 * F.col("boost_factor"))
    best = rows.orderBy(F.round("final_score", 9).desc(), "event_id").limit(5)
    return best.select("event_id", r6("final_score").alias("final_score"))


@query(
    "r6_boost_after_retrieval",
    f"""with {_BOOSTED.format(hits_sql(30), 'hits')} select query_id, chunk_id, round(boosted, 6) boosted,
      row_number() over (partition by query_id order by round(boosted, 9) desc, chunk_id) rank from b""",
)
def boost_after_retrieval(spark: Spark, sf: str) -> Rows:
    rows = _boosted(knn.nearest(vectors(spark, sf), centroids(spark, sf), 30).drop("rank"), spark, sf)
    ranked = knn.top_k(rows, ["query_id"], [F.round("boosted", 9).desc(), F.col("chunk_id")], 30)
    return ranked.select("query_id", "chunk_id", r6("boosted").alias("boosted"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "t4_boosted_top",
    f"""with {_BOOSTED.format(hits_sql(30), 'hits')} select query_id, chunk_id, round(boosted, 6) boosted from b
    qualify row_number() over (partition by query_id order by round(boosted, 9) desc, chunk_id) <= 5""",
)
def boosted_top(spark: Spark, sf: str) -> Rows:
    rows = _boosted(knn.nearest(vectors(spark, sf), centroids(spark, sf), 30).drop("rank"), spark, sf)
    ranked = knn.top_k(rows, ["query_id"], [F.round("boosted", 9).desc(), F.col("chunk_id")], 5)
    return ranked.select("query_id", "chunk_id", r6("boosted").alias("boosted"))


@query("r7_decay_signal", f"with {CANDIDATES} select query_id, chunk_id, round(decay_score, 6) decay_score from cand")
def decay_signal(spark: Spark, sf: str) -> Rows:
    rows = ranking.add_decay(candidates(spark, sf), at(AS_OF))
    return rows.select("query_id", "chunk_id", r6("decay_score").alias("decay_score"))


# --- A, B, W: re-ranking and fusion -----------------------------------------------------------------------------------


@query(
    "a4_softmax",
    f"""with {hits_sql(30)} select query_id, chunk_id, round(exp(score - mx) / sum(exp(score - mx)) over (partition by query_id), 6) share
    from (select *, max(score) over (partition by query_id) mx from hits)""",
)
def softmax(spark: Spark, sf: str) -> Rows:
    found = knn.nearest(vectors(spark, sf), centroids(spark, sf), 30)
    rows = ranking.softmax_scores(found, "score", "query_id", "share")
    return rows.select("query_id", "chunk_id", r6("share").alias("share"))


@query(
    "a5_min_max",
    f"""with {hits_sql(30)} select query_id, chunk_id, round(coalesce((score - lo) / nullif(hi - lo, 0), 0), 6) scaled from (
      select *, min(score) over (partition by query_id) lo, max(score) over (partition by query_id) hi from hits)""",
)
def min_max(spark: Spark, sf: str) -> Rows:
    found = knn.nearest(vectors(spark, sf), centroids(spark, sf), 30)
    return found.select("query_id", "chunk_id", r6(ranking.min_max(F.col("score"), "query_id")).alias("scaled"))


@query(
    "a6_score_variance",
    f"""with {CANDIDATES} select query_id, chunk_id, round(case when score + rerank_score + decay_score is not null
      then (select var_pop(x) from unnest([score, rerank_score, decay_score]) t(x)) end, 6) variance from cand""",
)
def score_variance(spark: Spark, sf: str) -> Rows:
    spread = variance(F.col("score"), F.col("rerank_score"), F.col("decay_score"))
    return scored_candidates(spark, sf).select("query_id", "chunk_id", r6(spread).alias("variance"))


@query("b1_rerank", f"with {CANDIDATES} select query_id, chunk_id, round(rerank_score, 6) rerank_score from cand")
def rerank(spark: Spark, sf: str) -> Rows:
    rows = ranking.rerank(candidates(spark, sf))
    return rows.select("query_id", "chunk_id", r6("rerank_score").alias("rerank_score"))


S = "case when score between 0 and 1 then score end"
_FUSED = f"""{CANDIDATES}, f as (select *, 0.15 * s + 0.35 * rerank_score + 0.5 * decay_score weighted,
    1.0 / (0.15 / (s + 1e-10) + 0.35 / (rerank_score + 1e-10) + 0.5 / (decay_score + 1e-10)) harmonic,
    pow(s, 0.15) * pow(rerank_score, 0.35) * pow(decay_score, 0.5) geometric
    from (select *, {S} s from cand))"""


def _fused(spark: Spark, sf: str) -> Rows:
    return ranking.add_scores(scored_candidates(spark, sf))


@query("b2_weighted_average", f"with {_FUSED} select query_id, chunk_id, round(weighted, 6) weighted from f")
def weighted_average(spark: Spark, sf: str) -> Rows:
    return _fused(spark, sf).select("query_id", "chunk_id", r6("weighted_avg_score").alias("weighted"))


@query("b3_harmonic_mean", f"with {_FUSED} select query_id, chunk_id, round(harmonic, 6) harmonic from f")
def harmonic_mean(spark: Spark, sf: str) -> Rows:
    return _fused(spark, sf).select("query_id", "chunk_id", r6("harmonic_mean_score").alias("harmonic"))


@query("b4_geometric_mean", f"with {_FUSED} select query_id, chunk_id, round(geometric, 6) geometric from f")
def geometric_mean(spark: Spark, sf: str) -> Rows:
    return _fused(spark, sf).select("query_id", "chunk_id", r6("geometric_mean_score").alias("geometric"))


@query(
    "b5_dynamic_weights",
    f"""with {CANDIDATES}, v as (select *, {S} s from cand), w as (
      select *, ((s - m) * (s - m) + (rerank_score - m) * (rerank_score - m) + (decay_score - m) * (decay_score - m)) / 3 var
      from (select *, (s + rerank_score + decay_score) / 3 m from v))
    select query_id, chunk_id, round(case when var < 0.1 then 0.33 * s + 0.34 * rerank_score + 0.33 * decay_score
      else 0.25 * s + 0.5 * rerank_score + 0.25 * decay_score end, 6) weighted from w""",
)
def dynamic_weights(spark: Spark, sf: str) -> Rows:
    rows = ranking.add_scores(scored_candidates(spark, sf), Fusion(dynamic=True))
    return rows.select("query_id", "chunk_id", r6("weighted_avg_score").alias("weighted"))


def _fractions(*columns: str) -> str:
    return ", ".join(
        f"(rank() over (partition by query_id order by {c} desc) - 1) / count(*) over (partition by query_id) f{i}"
        for i, c in enumerate(columns)
    )


@query("w1_rank_fraction", f"with {hits_sql(30)} select query_id, chunk_id, round(f0, 6) fraction from (select *, {_fractions('score')} from hits)")
def rank_fraction(spark: Spark, sf: str) -> Rows:
    found = knn.nearest(vectors(spark, sf), centroids(spark, sf), 30)
    return found.select("query_id", "chunk_id", r6(ranking.rank_fraction(F.col("score"), "query_id")).alias("fraction"))


_R = "round({}, 9)".format
_RANKS = _fractions(_R("score"), _R("rerank_score"), _R("decay_score"))


@query(
    "b6_rank_fusion",
    f"""with {CANDIDATES}, m as (select query_id, chunk_id, round(0.15 * f0 + 0.35 * f1 + 0.5 * f2, 12) mix from (select *, {_RANKS} from cand))
    select query_id, chunk_id, round(coalesce((mix - lo) / nullif(hi - lo, 0), 0), 6) fusion_score from (
      select *, min(mix) over (partition by query_id) lo, max(mix) over (partition by query_id) hi from m)""",
)
def rank_fusion(spark: Spark, sf: str) -> Rows:
    rows = scored_candidates(spark, sf).withColumns({c: F.round(c, 9) for c in ("score", "rerank_score", "decay_score")})
    return ranking.rank_fusion(rows).select("query_id", "chunk_id", r6("fusion_score").alias("fusion_score"))


@query(
    "b7_three_scores",
    f"with {_FUSED} select query_id, chunk_id, round(weighted, 6) weighted, round(harmonic, 6) harmonic, round(geometric, 6) geometric from f",
)
def three_scores(spark: Spark, sf: str) -> Rows:
    return _fused(spark, sf).select(
        "query_id", "chunk_id", r6("weighted_avg_score").alias("weighted"), r6("harmonic_mean_score").alias("harmonic"),
        r6("geometric_mean_score").alias("geometric"),
    )


def _ordered(score: str, k: int) -> str:
    return f"""row_number() over (partition by query_id order by round({score}, 12) desc nulls last,
      round(rerank_score, 12) desc nulls last, round(score, 12) desc nulls last, chunk_id) as rank
    from f qualify rank <= {k}"""


@query("b8_rank_articles", f"with {_FUSED} select query_id, chunk_id, round(harmonic, 6) harmonic, {_ordered('harmonic', 3)}")
def rank_articles(spark: Spark, sf: str) -> Rows:
    ranked = ranking.rank_articles(candidates(spark, sf), 3, "Harmonic Mean", use_time_decay=True, as_of=at(AS_OF))
    return ranked.select(
        "query_id", "chunk_id", r6("harmonic_mean_score").alias("harmonic"), F.col("rank").cast("bigint").alias("rank")
    )


@query("t3_by_chosen_score", f"with {_FUSED} select query_id, chunk_id, {_ordered('geometric', 5)}")
def by_chosen_score(spark: Spark, sf: str) -> Rows:
    ranked = ranking.rank_articles(candidates(spark, sf), 5, "Geometric Mean", use_time_decay=True, as_of=at(AS_OF))
    return ranked.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "b8_missing_signal",
    f"""with {CANDIDATES} select query_id, chunk_id,
      row_number() over (partition by query_id order by round(rerank_score, 12) desc, round(score, 12) desc, chunk_id) as rank
    from cand qualify rank <= 3""",
)
def missing_signal(spark: Spark, sf: str) -> Rows:
    ranked = ranking.rank_articles(candidates(spark, sf), 3)
    return ranked.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "w2_source_numbers",
    f"with {_FUSED} select query_id, chunk_id, row_number() over (partition by query_id order by round(weighted, 12) desc nulls last, chunk_id) number from f",
)
def source_numbers(spark: Spark, sf: str) -> Rows:
    numbered = knn.top_k(_fused(spark, sf), ["query_id"], [F.round("weighted_avg_score", 12).desc_nulls_last(), F.col("chunk_id")], 30, "number")
    return numbered.select("query_id", "chunk_id", F.col("number").cast("bigint").alias("number"))


@query("w3_document_numbers", "select doc_id, row_number() over (order by n_chars desc, doc_id) - 1 number from documents")
def document_numbers(spark: Spark, sf: str) -> Rows:
    placed = with_position(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.col("n_chars").desc(), "doc_id"], "number")
    return placed.select("doc_id", "number")


# --- B9, B10: whole searches ------------------------------------------------------------------------------------------


def search_sql(where: str, limit: int, use_decay: bool, method: str, as_of: str, tail: str = "") -> str:
    decay = CONFIDENCE if use_decay else "null::double"
    return f"""with {chunks_sql()},
    stored as (
      select md5(text) chunk_id, arg_max(struct_pack(t := text, a := article_id, u := updated_at, s := source, h := headline, l := url, w := author), (updated_at, article_id)) p
      from chunks group by 1),
    coll as (
      select chunk_id, p.t as text, p.a article_id, p.u updated_at, p.s source, p.h headline, p.l url, p.w author, {counts_sql('b')} v
      from (select *, {buckets_sql('p.t')} b from stored) where len(b) > 0),
    kept as (select * from coll where {where}),
    qt as (select item_id query_id, text query, {clean_sql('text')} clean from benchmark),
    qv as (select query_id, query, {counts_sql('b')} v from (select *, {buckets_sql('clean')} b from qt) where len(b) > 0),
    pr as (select query_id, chunk_id, round(list_cosine_similarity(qv.v, kept.v), 9) score from qv, kept),
    hits as (select * from pr qualify row_number() over (partition by query_id order by score desc, chunk_id) <= {limit * 10}),
    c0 as (
      select h.*, k.text, k.article_id, k.updated_at, k.source, k.headline, k.url, k.author, q.query,
        {share_sql('q.query', 'k.text')} pair, {age_sql('k.updated_at', as_of)} age
      from hits h join kept k using (chunk_id) join qt q using (query_id)),
    c1 as (select *, max(pair) over (partition by query_id) mx from c0),
    c2 as (select *, exp(pair - mx) / sum(exp(pair - mx)) over (partition by query_id) rerank_score, {decay} decay_score from c1),
    f as (
      select *, 0.15 * s + 0.35 * rerank_score + 0.5 * decay_score weighted,
        1.0 / (0.15 / (s + 1e-10) + 0.35 / (rerank_score + 1e-10) + 0.5 / (decay_score + 1e-10)) harmonic,
        pow(s, 0.15) * pow(rerank_score, 0.35) * pow(decay_score, 0.5) geometric
      from (select *, {S} s from c2)),
    best as (select *, {_ordered(method, limit)}){tail}"""


SEARCH_AS_OF = "2024-01-03 00:00:00"
FILTER = "source in ('src1', 'src2', 'src3', 'src4', 'src7') and updated_at >= timestamp '2024-01-01 01:00:00' and updated_at <= timestamp '2024-01-04'"
_SHOWN = " select query_id, chunk_id, article_id, round(score, 6) score, round(rerank_score, 6) rerank_score, round(decay_score, 6) decay_score, round(weighted, 6) weighted, rank from best"


def _shown(ranked: Rows) -> Rows:
    return ranked.select(
        "query_id", "chunk_id", "article_id", r6("score").alias("score"), r6("rerank_score").alias("rerank_score"),
        r6("decay_score").alias("decay_score"), r6("weighted_avg_score").alias("weighted"), F.col("rank").cast("bigint").alias("rank"),
    )


@query("b9_search", search_sql("true", 3, True, "weighted", SEARCH_AS_OF, _SHOWN))
def whole_search(spark: Spark, sf: str) -> Rows:
    return _shown(search(collection(spark, sf), questions(spark, sf), 3, True, as_of=at(SEARCH_AS_OF)))


def filtered(spark: Spark, sf: str, stored: Rows | None = None, **options) -> Rows:
    return search_by_filters(
        collection(spark, sf) if stored is None else stored,
        questions(spark, sf),
        ["src1", "src2", "src3", "src4", "src7"],
        at("2024-01-01 01:00:00"),
        at("2024-01-04 00:00:00"),
        use_time_decay=True,
        as_of=at(SEARCH_AS_OF),
        **options,
    )


@query("b10_filtered_search", search_sql(FILTER, 3, True, "weighted", SEARCH_AS_OF, _SHOWN))
def filtered_search(spark: Spark, sf: str) -> Rows:
    return _shown(filtered(spark, sf))


@query("b10_stored_by_day", search_sql(FILTER, 3, True, "weighted", SEARCH_AS_OF, _SHOWN))
def stored_by_day(spark: Spark, sf: str) -> Rows:
    """The same search over a collection on disk, of which only the days asked for are read."""
    path = scratch(spark, "collection")
    upsert(collection(spark, sf), path, 0, ["updated_at", "article_id"], dim=DIM, by_day="created_at")
    return _shown(filtered(spark, sf, read_collection(spark, path)))


@query("b10_min_score", search_sql(FILTER, 3, True, "weighted", SEARCH_AS_OF, _SHOWN + " where score >= 0.7"))
def filtered_min_score(spark: Spark, sf: str) -> Rows:
    return _shown(filtered(spark, sf, min_score=0.7))


# --- G: contexts, prompts, sources, score tables ----------------------------------------------------------------------

_PART = """'Source ' || rank || ':' || chr(10) || 'Headline: ' || headline || chr(10)
      || 'Date: ' || strftime(updated_at, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Content: ' || text || chr(10)
      || 'Relevance Score: ' || printf('%.3f', rerank_score) || chr(10)"""
_CONTEXT = f", ctx as (select query_id, any_value(query) query, string_agg({_PART}, chr(10) || chr(10) order by rank) context from best group by query_id)"


@query(
    "g1_context",
    search_sql(FILTER, 3, True, "weighted", SEARCH_AS_OF, _CONTEXT + " select query_id, md5(context) digest, length(context)::bigint size from ctx"),
)
def context(spark: Spark, sf: str) -> Rows:
    rows = reports.format_context(filtered(spark, sf))
    return rows.select("query_id", F.md5("context").alias("digest"), F.length("context").cast("bigint").alias("size"))


_TOP_DOCS = "(select *, row_number() over (partition by source order by n_chars desc, doc_id) rank from documents qualify rank <= 3)"


@query(
    "g2_plain_context",
    f"""select source, md5(string_agg('Content ' || (rank - 1) || ':' || chr(10) || text, chr(10) || chr(10) order by rank)) digest
    from {_TOP_DOCS} group by source""",
)
def plain_context(spark: Spark, sf: str) -> Rows:
    top = knn.top_k(table(spark, sf, "documents"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 3)
    return reports.plain_context(top, "source").select("source", F.md5("context").alias("digest"))


@query(
    "a10_joined_sources",
    f"select source, string_agg(rank || '. ' || doc_id || ' ' || lang, chr(10) || chr(10) order by rank) context from {_TOP_DOCS} group by source",
)
def joined_sources(spark: Spark, sf: str) -> Rows:
    top = knn.top_k(table(spark, sf, "documents"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 3)
    part = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("doc_id").cast("string"), F.lit(" "), "lang")
    return reports.join_parts(top, part, "source")


def _prompt(template: str) -> str:
    filled = template.replace("'", "''").replace("{context}", "' || context || '").replace("{question}", "' || query || '")
    return f"md5('{filled}')"


@query(
    "g3_prompts",
    search_sql(
        FILTER, 3, True, "weighted", SEARCH_AS_OF,
        _CONTEXT + f" select query_id, {_prompt(reports.ANSWER_PROMPT)} answer, {_prompt(reports.ANALYSIS_PROMPT)} analysis from ctx",
    ),
)
def prompts(spark: Spark, sf: str) -> Rows:
    contexts = reports.format_context(filtered(spark, sf)).join(questions(spark, sf), "query_id")
    both = reports.prompts(contexts).withColumnRenamed("prompt", "answer")
    return reports.prompts(both, analysis_mode=True).select(
        "query_id", F.md5("answer").alias("answer"), F.md5("prompt").alias("analysis")
    )


@query(
    "g4_sources",
    search_sql(
        FILTER, 3, True, "weighted", SEARCH_AS_OF,
        f""" select query_id, rank, headline, url, strftime(updated_at, '%Y-%m-%d %H:%M:%S') created_at, source symbols, author, md5(text) as content,
        round(rerank_score, 6) rerank_score, round(weighted, 6) weighted_score, round(harmonic, 6) harmonic_score,
        round(geometric, 6) geometric_score, round(decay_score, 6) decay_score, round(score, 6) original_score,
        {stamp_sql('updated_at')} updated_at, article_id from best""",
    ),
)
def sources(spark: Spark, sf: str) -> Rows:
    packed = reports.source_records(filtered(spark, sf))
    rows = packed.select("query_id", F.posexplode("sources").alias("p", "s")).select(
        "query_id", (F.col("p") + 1).cast("bigint").alias("rank"), "s.*"
    )
    rounded = ("rerank_score", "weighted_score", "harmonic_score", "geometric_score", "decay_score", "original_score")
    return rows.withColumns(
        {
            **{c: r6(c) for c in rounded},
            "symbols": F.array_join("symbols", ","),
            "content": F.md5("content"),
            "updated_at": F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        }
    )


_SOURCE = "'Source ' || rank || ': ' || substr(headline, 1, 30) || '...' source"
_WIDE = f", wide as (select query_id, {_SOURCE}, weighted \"Weighted\", harmonic \"Harmonic\", geometric \"Geometric\", decay_score \"Decay\", score \"Similarity\", rerank_score \"Cross-Encoder\" from best)"


@query(
    "g5_scores_long",
    search_sql(
        FILTER, 3, True, "weighted", SEARCH_AS_OF,
        _WIDE + """ select query_id, source, score_type, round(score, 6) score from wide
        unpivot include nulls (score for score_type in ("Weighted", "Harmonic", "Geometric", "Decay", "Similarity", "Cross-Encoder"))""",
    ),
)
def scores_long(spark: Spark, sf: str) -> Rows:
    return reports.score_table_long(filtered(spark, sf)).withColumn("score", r6("score"))


@query(
    "g6_scores_wide",
    search_sql(
        FILTER, 3, True, "weighted", SEARCH_AS_OF,
        _WIDE + """ select query_id, source, round("Weighted", 3) weighted, round("Harmonic", 3) harmonic, round("Geometric", 3) geometric,
        round("Decay", 3) decay, round("Similarity", 3) similarity, round("Cross-Encoder", 3) cross_encoder from wide""",
    ),
)
def scores_wide(spark: Spark, sf: str) -> Rows:
    table_ = reports.score_table_wide(reports.score_table_long(filtered(spark, sf)))
    return table_.select("query_id", "source", *[F.col(f"`{n}`").alias(n.lower().replace("-", "_")) for n in reports.SCORE_TYPES])


@query(
    "a8_pivot",
    """pivot (select user_id, event_type, round(avg(value), 3) v from events group by 1, 2)
    on event_type in ('click', 'error', 'purchase', 'signup', 'view') using first(v) group by user_id""",
)
def pivot(spark: Spark, sf: str) -> Rows:
    kinds = ("click", "error", "purchase", "signup", "view")
    means = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("score_type")).agg(F.avg("value").alias("score"))
    return reports.score_table_wide(means, ("user_id",), kinds)
