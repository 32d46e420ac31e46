"""Literal rows with known results."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import freshness, fusion, records, text
from tidemark.operators import conflicts, feeds, ingest, ranking, threads, versions
from tidemark.operators.ordered import with_position, with_row_number
from tidemark.sources import news, ranges, sinks


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "age, confidence, boost, category, fresh",
    [
        (0.5, 1.0, 1.0, "real-time", True),
        (4.0, 1.0, 1.0, "very_fresh", True),
        (5.0, 0.860708, 0.740818, "fresh", False),
        (6.0, 0.740818, 0.548812, "fresh", False),
        (20.0, 0.1, 0.01, "recent", False),
        (25.0, 0.1, 0.01, "outdated", False),
        (-3.0, 1.0, 1.0, "real-time", True),
    ],
)
def test_freshness(spark, age, confidence, boost, category, fresh):
    minutes = int(age * 60)
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    row = (
        spark.range(1)
        .withColumn("ts", now - F.make_dt_interval(mins=F.lit(minutes)))
        .withColumns(freshness.freshness_columns(F.col("ts"), now))
        .first()
    )
    assert row["age_hours"] == pytest.approx(age)
    assert row["confidence_score"] == pytest.approx(confidence, abs=1e-6)
    assert row["boost_factor"] == pytest.approx(boost, abs=1e-6)
    assert (row["freshness_category"], row["is_fresh"]) == (category, fresh)


FUSED = [
    ((0.8, 0.6, 1.0), 0.83, 0.786885, 0.808754),
    ((0.9, 0.1, 0.1), 0.22, 0.115385, 0.139039),
    ((0.5, 0.5, 0.5), 0.5, 0.5, 0.5),
    ((0.7, 0.0, 1.0), 0.605, 2.857e-10, 0.0),
]


@pytest.mark.parametrize("scores, weighted, harmonic, geometric", FUSED)
def test_fusion(spark, scores, weighted, harmonic, geometric):
    s, c, t = map(F.lit, scores)
    model = fusion.Fusion()
    assert one(spark, model.weighted_average(s, c, t)) == pytest.approx(weighted, abs=1e-6)
    assert one(spark, model.harmonic_mean(s, c, t)) == pytest.approx(harmonic, abs=1e-6)
    assert one(spark, model.geometric_mean(s, c, t)) == pytest.approx(geometric, abs=1e-6)


def test_dynamic_weights(spark):
    low = fusion.Fusion(dynamic=True).weighted_average(F.lit(0.8), F.lit(0.6), F.lit(1.0))
    high = fusion.Fusion(dynamic=True).weighted_average(F.lit(1.0), F.lit(0.0), F.lit(1.0))
    assert one(spark, low) == pytest.approx(0.798)
    assert one(spark, high) == pytest.approx(0.5)


def test_rank_fusion_and_softmax(spark):
    rows = values(
        spark,
        [(1, "a", 0.8, 0.6, 1.0), (1, "b", 0.9, 0.1, 0.1), (1, "c", 0.7, 0.6, 0.5), (2, "d", 0.1, 0.1, 0.1)],
        "query_id int, chunk_id string, score double, rerank_score double, decay_score double",
    )
    fused = {r["chunk_id"]: r["fusion_score"] for r in ranking.rank_fusion(rows).collect()}
    assert fused["a"] == pytest.approx(0.0) and fused["b"] == pytest.approx(1.0)
    assert fused["c"] == pytest.approx(0.419355, abs=1e-6)
    assert fused["d"] == 0.0  # one candidate: no range, no error
    raw = values(spark, [(1, 2.0), (1, 1.0), (1, 0.0)], "q int, s double")
    soft = sorted(r["p"] for r in ranking.softmax_scores(raw, "s", "q", "p").collect())
    assert soft == pytest.approx([0.090031, 0.244728, 0.665241], abs=1e-6)


def test_score_range_modes(spark):
    assert one(spark, fusion.in_unit_range(F.lit(-0.2))) is None
    assert one(spark, fusion.in_unit_range(F.lit(1.2), "clamp")) == 1.0
    with pytest.raises(Exception, match="between 0 and 1"):
        one(spark, fusion.in_unit_range(F.lit(1.2) + F.rand() * 0, "error"))
    with pytest.raises(ValueError):
        fusion.in_unit_range(F.lit(1.0), "other")


def test_cleaning_literals(spark):
    assert one(spark, text.unbold(F.lit("\U0001d5d4\U0001d5ee\U0001d7ec\U0001d7ce"))) == "Aa0\U0001d7ce"
    assert one(spark, text.unitalic(F.lit("\U0001d608\U0001d622"))) == "Aa"
    assert one(spark, text.drop_emoji(F.lit("a\U0001f600\U0001f601b↳c"))) == "a b c"
    assert one(spark, text.mask_urls(F.lit("a http://x.y b www.q c"))) == "a [URL] b [URL] c"
    assert one(spark, text.strip(F.lit("  \n x y\t"))) == "x y"
    html = '<ul>\r\n\t<li><strong>Firm&nbsp;A</strong> rose<!-- x --></li><li>it&#39;s &amp;lt; 5</li></ul><script>"</p>"</script>'
    assert one(spark, text.html_to_text(F.lit(html))) == "Firm A rose it's &lt; 5"
    chain = "<p>\U0001d5d4pple “up” → http://a.b/c?d</p>\U0001f600 é"
    assert one(spark, text.clean_all(F.lit(chain))) == 'Apple "up"   [URL]   '
    assert one(spark, text.clean_all(F.lit(None).cast("string"))) is None
    assert one(spark, text.parse_symbols(F.lit("aapl, msft,, "))) == ["AAPL", "MSFT"]
    assert one(spark, text.parse_symbols(F.lit(""))) == []


def test_greedy_chunks(spark):
    line = F.lit("aa bbb cc d eeeeee f")
    assert one(spark, ingest.chunk_text(line, 6, 0, "chars")) == ["aa bbb ", "cc d ", "eeeeee ", "f"]
    assert one(spark, ingest.chunk_text(line, 4, 2)) == ["aa bbb ", "cc d ", "eeeeee f"]
    assert one(spark, ingest.chunk_text(F.lit(""), 4, 2)) == []
    # a segment above the budget stands alone, or stops the job
    assert one(spark, ingest.chunk_text(F.lit("a bbbbbbb c"), 3, 0, "chars")) == ["a ", "bbbbbbb ", "c"]
    with pytest.raises(Exception, match="above the chunk budget"):
        one(spark, ingest.chunk_text(F.concat(F.lit("a bbbbbbb c"), F.rand().cast("string")), 3, 0, "chars", strict=True))
    with pytest.raises(ValueError):
        ingest.chunk_text(line, 2, 2)


def message(**changes):
    base = {
        "T": "n", "id": 7, "headline": "h", "summary": "s", "author": "a", "created_at": "2021-03-04T05:06:07Z",
        "updated_at": "2021-03-04T05:08:09Z", "url": None, "content": "<p>c</p>", "symbols": ["X"], "source": "feed",
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v != "drop"}


@pytest.mark.parametrize(
    "changes, valid",
    [
        ({}, True),
        ({"id": "123"}, True),
        ({"id": "x"}, False),
        ({"url": "drop"}, False),
        ({"url": 5}, False),
        ({"headline": 5}, False),
        ({"headline": None}, False),
        ({"symbols": "drop"}, False),
        ({"symbols": [None]}, False),
        ({"created_at": "soon"}, False),
        ({"extra": {"a": 1}}, True),
    ],
)
def test_message_validation(spark, changes, valid):
    rows = values(spark, [(1, json.dumps([message(**changes)]))], "batch_id int, payload string")
    assert [r["valid"] for r in ingest.parse_messages(rows).collect()] == [valid]


def test_batch_policy_and_broken_payloads(spark):
    payloads = [(1, json.dumps([message(), message(id="x")])), (2, json.dumps(message())), (3, "no json"), (4, "[]")]
    parsed = ingest.parse_messages(values(spark, payloads, "batch_id int, payload string"))
    by_row, bad = ingest.validate(parsed)
    by_batch, _ = ingest.validate(parsed, "batch")
    assert sorted(r["batch_id"] for r in by_row.collect()) == [1, 2]
    assert sorted(r["batch_id"] for r in bad.collect()) == [1, 3]
    assert [r["batch_id"] for r in by_batch.collect()] == [2]
    article = by_batch.first()
    assert (article["id"], article["symbols"], str(article["created_at"])) == (7, ["X"], "2021-03-04 05:06:07")


def test_interval_split(spark):
    bounds = values(spark, [("2024-01-01 00:00:00", "2024-01-02 00:00:00")], "start string, end string")
    bounds = bounds.select(*[F.col(c).cast("timestamp").alias(c) for c in ("start", "end")])
    rows = ranges.split_intervals(bounds, 4, gap=True).orderBy("interval_no").collect()
    assert [(str(r["interval_start"])[11:16], str(r["interval_end"])[8:16]) for r in rows] == [
        ("00:00", "01 05:59"), ("06:00", "01 11:59"), ("12:00", "01 17:59"), ("18:00", "02 00:00"),
    ]


def test_id_ranges(spark):
    polls = values(spark, [(1, 1000), (2, 1004), (3, 1004)], "poll_ts int, max_id bigint")
    found = ranges.poll_ranges(polls)
    assert sorted((r["poll_ts"], r["low"], r["high"]) for r in found.collect()) == [(1, 850, 1000), (2, 1000, 1004), (3, 1004, 1004)]
    ids = sorted(r["item_id"] for r in ranges.unfold_ranges(found, ["poll_ts"]).collect())
    assert ids == list(range(850, 1004))


def test_running_count(spark):
    rows = values(spark, list(enumerate("aaaba")), "i int, item string")
    counted = with_row_number(with_position(rows, ["item", "i"]), ["item"], "n")
    assert [r["n"] for r in counted.orderBy("i").collect()] == [1, 2, 3, 1, 4]


def test_small_expressions(spark):
    assert one(spark, records.relative_difference(F.lit(10.5), F.lit(12.8))) == pytest.approx(0.179688, abs=1e-6)
    assert one(spark, records.relative_difference(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, records.numeric_literal(F.lit("1.2.3"))) is None
    assert one(spark, records.cik_of_title(F.lit("4 - X (0001) (Issuer)"))) == "0001"
    assert one(spark, records.cik_of_title(F.lit("none"))) == "No CIK found"
    assert one(spark, records.accession_id(F.lit("urn:a=0001-24-5"))) == "0001245"
    assert one(spark, records.filing_text_url(F.lit("https://h/too/short"))) is None
    assert one(spark, records.first_or_null(F.array().cast("array<string>"))) is None


REVENUE = ("Harbour fees brought in 41.2 million crowns.", "Harbour fees brought in 55.7 million crowns.")
CHIEF = ("the pilots are led by Amara Okafor.", "the pilots are led by Lena Fischer.")


def test_conflicts(spark):
    pairs = values(spark, [(1, *REVENUE), (2, *CHIEF), (3, "same text", "same text")], "pair_id int, old_content string, new_content string")
    found = conflicts.detect_conflicts(pairs)
    rows = {(r["pair_id"], r["type"], r["old_content"], r["new_content"], r["confidence"]) for r in found.collect()}
    assert (1, "numerical", "41.2", "55.7", 0.8) in rows
    assert (2, "entity", "Amara Okafor", "Lena Fischer", 0.7) in rows
    assert all(r[0] != 3 for r in rows)
    resolved = {r["pair_id"]: r for r in conflicts.resolve_conflicts(found.where("type = 'numerical'"), "merge").collect()}
    assert resolved[1]["resolved_content"] == "55.7 (previously reported as 41.2)"
    assert resolved[1]["confidence_score"] == 0.5
    kept = conflicts.resolve_conflicts(found.where("pair_id = 2"), "confidence_based").first()
    assert kept["resolved_content"] == "Amara Okafor" and kept["confidence_score"] == pytest.approx(0.3)
    assert kept["resolution_metadata"] == {"strategy": "confidence_based", "confidence_threshold": "0.7"}
    assert set(resolved) == {1}  # no conflict, no row
    with pytest.raises(ValueError):
        conflicts.resolve_conflicts(found, "coin")


def test_temporal_and_factual_conflicts(spark):
    pairs = values(
        spark,
        [(1, "Shipped on March 3, 2024 by rail", "Shipped on March 5, 2024 by rail"), (2, "the plant will open now", "the plant will not open now")],
        "pair_id int, old_content string, new_content string",
    )
    rows = conflicts.detect_conflicts(pairs).collect()
    assert ("March 3, 2024", "March 5, 2024") in {(r["old_content"], r["new_content"]) for r in rows if r["type"] == "temporal"}
    factual = [r for r in rows if r["type"] == "factual"]
    assert [r["pair_id"] for r in factual] == [2] and factual[0]["new_content"] == "the plant will not open now"


def test_enrichment(spark):
    link = "https://www.sec.gov/Archives/edgar/data/9/00/0-1-index.htm"
    filings = values(
        spark,
        [("a", "1", "8-K", link), ("b", "2", "8-K", link), ("c", "2", "4", link), ("d", "2", "4", "https://x"), ("e", "No CIK found", "8-K", link)],
        "id string, cik string, form_type string, link string",
    )
    tickers = values(spark, [(1, "B"), (1, "A")], "cik_str bigint, ticker string")
    texts = values(
        spark,
        [("https://www.sec.gov/Archives/edgar/data/9/00/0-1.txt", "<issuerTradingSymbol>S\n</issuerTradingSymbol>")],
        "url string, text string",
    )
    found = {r["id"]: r["ticker"] for r in feeds.enrich(filings, tickers, texts).collect()}
    assert found == {"a": "A", "b": "no_ticker", "c": "S\n", "e": "no_ticker"}


def test_branch_puts_unknown_with_the_others(spark):
    rows = values(spark, [(1, "story"), (2, None), (3, "job")], "id int, type string")
    yes, no = threads.branch(rows, F.col("type") == "story")
    assert [r["id"] for r in yes.collect()] == [1]
    assert sorted(r["id"] for r in no.collect()) == [2, 3]


def test_source_selector_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="both bounds"):
        news.read_news(spark, "batch", str(tmp_path))
    with pytest.raises(ValueError, match="unknown mode"):
        news.read_news(spark, "queue", str(tmp_path))
    with pytest.raises(ValueError, match="scoring method"):
        ranking.rank_articles(spark.range(1), 1, "Median")


def test_mock_feed(spark, tmp_path):
    (tmp_path / "feed.jsonl").write_text(json.dumps([message(), message(id=8)]) + "\n" + json.dumps([message(id="x")]) + "\n")
    rows = news.read_news(spark, "mock", str(tmp_path / "feed.jsonl"))
    assert sorted(r["id"] for r in rows.collect()) == [7, 8]
    points, rejects = ingest.ingest(rows, 64)
    assert points.count() == 6 and rejects.count() == 0
    assert all(math.isclose(sum(x * x for x in r["embedding"]), 1.0) for r in points.collect())


def test_feeds_keep_every_entry(spark):
    entry = "<entry><id>urn:tag:x,accession-number=000-{n}</id><title>4 - A ({n}) (Issuer)</title></entry>"
    xml = "<feed>" + "".join(entry.format(n=n) for n in range(14)) + "</feed>"
    frame = values(spark, [(xml,)], "xml string")
    assert feeds.parse_atom(frame).count() == 14 and feeds.parse_atom(frame, at_most=3).count() == 3


def test_all_named_and_long_numeric_entities(spark):
    frame = values(spark, [("caf&eacute; &rarr; &frac12; &#00008217;x &amp;lt; &nosuch; a & b &#x0002019;&NotEqualTilde;",)], "t string")
    assert frame.select(text.html_to_text("t").alias("t")).first()["t"] == "café → ½ ’x &lt; &nosuch; a & b ’≂̸"


def test_later_map_wins(spark):
    frame = spark.sql("select map('a', 1, 'b', 2) as x, map('b', 3, 'c', 4) as y")
    assert frame.select(records.merge_maps(F.col("x"), F.col("y")).alias("m")).first()["m"] == {"a": 1, "b": 3, "c": 4}


def test_a_new_stream_keeps_a_compacted_collection(spark, tmp_path):
    first, folded = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.upsert(spark.range(20).select(F.col("id").alias("chunk_id"), F.lit(0).alias("v")), first, 0, ["v"])
    sinks.compact(spark, first, folded)
    for _ in range(2):
        sinks.upsert(spark.createDataFrame([(3, 1), (3, 2), (99, 1)], "chunk_id long, v int"), folded, 0, ["v"], writer="second")
    rows = {r["chunk_id"]: r["v"] for r in sinks.read_collection(spark, folded).collect()}
    assert len(rows) == 21 and rows[3] == 2 and rows[99] == 1 and rows[4] == 0


def test_writers_share_a_collection(spark, tmp_path):
    path, folded = str(tmp_path / "a"), str(tmp_path / "b")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "chunk_id long, v int")
    read = lambda p: {r["chunk_id"]: r["v"] for r in sinks.read_collection(spark, p).collect()}
    first, other, late = rows(*[(i, 0) for i in range(20)], (None, 0)), rows((3, 1), (30, 1)), rows((3, 2), (None, 2))
    sinks.upsert(first, path, 0, ["v"], writer="one")
    sinks.upsert(other, path, 0, ["v"], writer="two")
    assert len(read(path)) == 22 and read(path)[3] == 1
    sinks.upsert(first, path, 0, ["v"], writer="one")  # comes again: it keeps its place before the other
    assert read(path)[3] == 1 and sinks.commits(spark, path).places == {("one", 0): 1, ("two", 0): 2}
    sinks.upsert(late, path, 1, ["v"], writer="one")
    want = read(path)
    assert want[3] == 2 and want[None] == 2 and want[30] == 1
    sinks.compact(spark, path, folded)
    for _ in range(2):
        sinks.upsert(other, folded, 0, ["v"], writer="two")  # folded already
    assert read(folded) == want and sinks.commits(spark, folded).folded == {"one": 1, "two": 0}
    sinks.upsert(rows((3, 9)), folded, 1, ["v"], writer="two")
    assert read(folded) == want | {3: 9}
    sinks.compact(spark, folded, str(tmp_path / "c"))
    assert read(str(tmp_path / "c")) == want | {3: 9} and sinks.commits(spark, str(tmp_path / "c")).folded == {"one": 1, "two": 1}
    rows((7, 7)).write.parquet(f"{folded}/part=w.three.0")  # a batch that was cut off before its commit
    assert read(folded) == want | {3: 9}
    for name in ("", "_x", "a.b", "a/b"):
        with pytest.raises(ValueError):
            sinks.upsert(late, path, 1, ["v"], writer=name)


def test_interval_edges_agree_with_the_split(spark):
    bounds = values(spark, [("2024-01-01 00:00:00", "2024-01-01 00:00:01.000001")], "start string, end string")
    bounds = bounds.select(*[F.col(c).cast("timestamp").alias(c) for c in ("start", "end")])
    for n in (2, 3, 7):
        cut = ranges.split_intervals(bounds, n)
        found = cut.select("interval_no", ranges.interval_of(F.col("interval_start"), F.col("start"), F.col("end"), n).alias("i")).collect()
        assert all(r["interval_no"] == r["i"] for r in found)


def test_versions_of_one_time_are_told_apart(spark):
    frame = values(spark, [(1, "2024-01-01", "b"), (1, "2024-01-01", "a")], "doc_id int, ts string, content string")
    assert versions.new_versions(frame, "doc_id", "ts").select("version_id").distinct().count() == 2
    assert versions.add_documents(frame).first()["content"] == "a"


def test_repeated_filing_texts_do_not_multiply_filings(spark):
    frame = values(spark, [("1", "http://h/a-index.htm", None, "4")], "id string, link string, cik string, form_type string")
    address = frame.select(records.filing_text_url(F.col("link")).alias("u")).first()["u"]
    told = "<issuerTradingSymbol>ABC</issuerTradingSymbol>"
    found = feeds.enrich(frame, values(spark, [(1, "T")], "cik_str long, ticker string"), values(spark, [(address, told)] * 2, "url string, text string"))
    assert found.count() <= 1
