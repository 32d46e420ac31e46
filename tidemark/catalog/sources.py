"""Scans, sinks, dataflow steps, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import at, query, r6, scratch, stamp, stamp_sql, table
from tidemark.functions.fusion import in_unit_range
from tidemark.functions.records import is_ownership_form
from tidemark.functions.text import characters, parse_symbols, split_tokens
from tidemark.functions.vectors import has_dimension
from tidemark.operators import feeds, ingest
from tidemark.operators.ordered import with_position, with_row_number
from tidemark.operators.threads import branch
from tidemark.session import materialize
from tidemark.sources import news, ranges, sinks

Spark, Rows = SparkSession, DataFrame


# --- S: sources -------------------------------------------------------------------------------------------------------


@query(
    "s1_source_selector",
    f"""select event_id, {stamp_sql('ts')} ts, event_type from events
    where ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-20 12:00:00'""",
)
def source_selector(spark: Spark, sf: str) -> Rows:
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = news.read_news(
        spark, "batch", path, at("2024-01-05 00:00:00"), at("2024-01-20 12:00:00"), fmt="parquet", schema=schema, ts="ts"
    )
    return rows.select("event_id", stamp("ts").alias("ts"), "event_type")


@query(
    "s2_mock_lists",
    """select doc_id batch_id, unnest([0, 1]) as position, unnest([doc_id, -doc_id]) id, unnest([lang, source]) headline
    from documents""",
)
def mock_lists(spark: Spark, sf: str) -> Rows:
    docs = table(spark, sf, "documents")
    messages = F.array(
        F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("headline")),
        F.struct((-F.col("doc_id")).alias("id"), F.col("source").alias("headline")),
    )
    return news.mock_payloads(docs.select(F.col("doc_id").alias("batch_id"), messages.alias("messages")))


@query(
    "s3_time_scan",
    f"""select event_id, {stamp_sql('ts')} ts, value from events
    where ts >= timestamp '2024-01-10 00:00:00' and ts <= timestamp '2024-01-12 00:00:00'""",
)
def time_scan(spark: Spark, sf: str) -> Rows:
    events = table(spark, sf, "events")
    scan = news.time_scan(events, "ts", "event_id", at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00"))
    return scan.select("event_id", stamp("ts").alias("ts"), "value")


def _intervals(gap: bool):
    minute = "case when i = 3 then 0 else 60000000 end" if gap else "0"
    return f"""with b as (select event_type, epoch_us(min(ts)) a, epoch_us(max(ts)) z from events group by event_type)
    select event_type, i interval_no, a + round(i * ((z - a) / 4))::bigint interval_start,
      a + round((i + 1) * ((z - a) / 4))::bigint - {minute} interval_end
    from b, range(4) t(i)"""


def _bounds(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "events").groupBy("event_type").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def _split(spark: Spark, sf: str, gap: bool) -> Rows:
    rows = ranges.split_intervals(_bounds(spark, sf), 4, gap=gap)
    return rows.select(
        "event_type",
        F.col("interval_no").cast("bigint").alias("interval_no"),
        F.unix_micros("interval_start").alias("interval_start"),
        F.unix_micros("interval_end").alias("interval_end"),
    )


@query("s4_intervals", _intervals(False))
def intervals(spark: Spark, sf: str) -> Rows:
    return _split(spark, sf, False)


@query("s4_intervals_with_gap", _intervals(True))
def intervals_with_gap(spark: Spark, sf: str) -> Rows:
    return _split(spark, sf, True)


@query(
    "s5_interval_per_worker",
    """with e as (select (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) o from events),
    t as (select 30::bigint * 86400000000 total)
    select worker, count(*) n from (
      select case when o >= 0 and o <= total then least(floor(o * 7 / total), 6)::bigint end worker from e, t)
    where worker is not null group by worker""",
)
def interval_per_worker(spark: Spark, sf: str) -> Rows:
    number = ranges.interval_of(F.col("ts"), at("2024-01-01 00:00:00"), at("2024-01-31 00:00:00"), 7)
    rows = table(spark, sf, "events").select(number.alias("worker"))
    return rows.where("worker is not null").groupBy("worker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s6_pages",
    """select event_id, floor((row_number() over (order by ts, event_id) - 1) / 20)::bigint page from events""",
)
def pages(spark: Spark, sf: str) -> Rows:
    events = table(spark, sf, "events").select("ts", "event_id")
    return ranges.paged(events, "ts", "event_id").select("event_id", "page")


@query(
    "s6_next_page",
    f"""select event_id, {stamp_sql('ts')} ts from events
    where (ts, event_id) > (timestamp '2024-01-10 00:00:00', 0) order by ts, event_id limit 20""",
)
def next_page(spark: Spark, sf: str) -> Rows:
    events = table(spark, sf, "events")
    page = ranges.next_page(events, "ts", "event_id", (at("2024-01-10 00:00:00"), F.lit(0)))
    return page.select("event_id", stamp("ts").alias("ts"))


@query(
    "s7_last_days",
    """select event_id, event_type from events
    where ts >= timestamp '2024-01-31' - interval 7 day and ts <= timestamp '2024-01-31'""",
)
def last_days(spark: Spark, sf: str) -> Rows:
    return news.last_days(table(spark, sf, "events"), "ts", at("2024-01-31 00:00:00"), 7).select("event_id", "event_type")


@query("s9_key_shares", "select c_custkey, floor((row_number() over (order by c_custkey) - 1) * 4 / (select count(*) from customer))::bigint worker from customer")
def key_shares(spark: Spark, sf: str) -> Rows:
    keys = with_position(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"])
    return ranges.split_keys(keys, 4).select("c_custkey", "worker")


@query("s10_subscription", "select event_id, event_type from events where event_type in ('click', 'error')")
def subscription(spark: Spark, sf: str) -> Rows:
    events = table(spark, sf, "events").withColumn("symbols", F.array("event_type"))
    return news.subscribe(events, ["click", "error"]).select("event_id", "event_type")


@query("s10_subscription_wildcard", "select event_type, count(*) n from events group by event_type")
def subscription_wildcard(spark: Spark, sf: str) -> Rows:
    events = table(spark, sf, "events").withColumn("symbols", F.array("event_type"))
    return news.subscribe(events, ["*"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def polls(spark: Spark, sf: str) -> Rows:
    events = table(spark, sf, "events")
    return events.groupBy(F.date_trunc("hour", "ts").alias("poll_ts")).agg(F.max("event_id").alias("max_id"))


POLLS = """polls as (select date_trunc('hour', ts) poll_ts, max(event_id) max_id from events group by 1),
    r as (select poll_ts, max_id, coalesce(lag(max_id) over (order by poll_ts, max_id), max_id - 150) low from polls)"""


@query("s13_poll_ranges", f"with {POLLS} select max_id, unnest(range(low, max_id)) item_id from r where max_id > low")
def poll_ranges(spark: Spark, sf: str) -> Rows:
    return ranges.unfold_ranges(ranges.poll_ranges(polls(spark, sf)), ["max_id"])


@query(
    "s14_batches",
    """with g as (select event_id, event_type, ts,
        case when ts - lag(ts) over w <= interval 7200 second then 0 else 1 end opens
      from events window w as (partition by event_type order by ts, event_id)),
    s as (select *, sum(opens) over (partition by event_type order by ts, event_id) run from g),
    p as (select *, row_number() over (partition by event_type, run order by ts, event_id) - 1 i from s)
    select event_id, event_type,
      (sum(case when i % 10 = 0 then 1 else 0 end) over (partition by event_type order by ts, event_id) - 1)::bigint batch_no
    from p""",
)
def batches(spark: Spark, sf: str) -> Rows:
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return ranges.batch_numbers(events, "event_type", "ts", "event_id", 10, 7200).select("event_id", "event_type", "batch_no")


@query(
    "s15_ticker_json",
    """select c_custkey source, unnest(['0', '1']) as position, unnest([c_custkey, c_custkey + 7]) cik_str,
      unnest([c_mktsegment, 'N' || c_nationkey]) ticker, c_name title from customer""",
)
def ticker_json(spark: Spark, sf: str) -> Rows:
    def entry(pos, cik, ticker):
        return F.concat(
            F.lit(f'"{pos}":{{"cik_str":'), cik.cast("string"), F.lit(',"ticker":"'), ticker, F.lit('","title":"'), "c_name", F.lit('"}')
        )

    nation = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    doc = F.concat(
        F.lit("{"), entry(0, F.col("c_custkey"), F.col("c_mktsegment")), F.lit(","), entry(1, F.col("c_custkey") + 7, nation), F.lit("}")
    )
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), doc.alias("value"))
    return feeds.read_ticker_table(rows, keep=("source",))


@query("s16_scroll", "select doc_id, lang from documents where source = 'src7' order by doc_id limit 10")
def scroll(spark: Spark, sf: str) -> Rows:
    return news.scroll(table(spark, sf, "documents"), F.col("source") == "src7", "doc_id", 10).select("doc_id", "lang")


@query(
    "s17_typed_points",
    """select vec_id::varchar chunk_id, (vec_id + 1)::varchar article_id, null::double score, null::double rerank_score,
    len(embedding)::bigint dims from embeddings""",
)
def typed_points(spark: Spark, sf: str) -> Rows:
    points = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), (F.col("vec_id") + 1).alias("article_id"), "embedding"
    )
    rows = news.typed_points(points)
    return rows.select(
        "chunk_id", "article_id", "score", "rerank_score", F.size("text_embedding").cast("bigint").alias("dims")
    )


# --- K: sinks ---------------------------------------------------------------------------------------------------------


@query(
    "k1_upsert",
    """select md5(text) chunk_id, coalesce(max(doc_id) filter (where lang = 'en'), max(doc_id)) doc_id,
      case when count(*) filter (where lang = 'en') > 0 then 'second' else 'first' end pass
    from documents group by 1""",
)
def upsert(spark: Spark, sf: str) -> Rows:
    path = scratch(spark, "collection")
    rows = table(spark, sf, "documents").select(F.md5("text").alias("chunk_id"), "doc_id", "lang")
    sinks.upsert(rows.withColumn("pass", F.lit("first")), path, 0, order=["doc_id"])
    second = rows.where("lang = 'en'").withColumn("pass", F.lit("second"))
    for _ in range(2):  # delivered twice, stored once
        sinks.upsert(second, path, 1, order=["doc_id"])
    return sinks.read_collection(spark, path).select("chunk_id", "doc_id", "pass")


@query("k1_compacted", "select md5(text) chunk_id, max(doc_id) doc_id from documents group by 1")
def compacted(spark: Spark, sf: str) -> Rows:
    path, target = scratch(spark, "collection"), scratch(spark, "compacted")
    rows = table(spark, sf, "documents").select(F.md5("text").alias("chunk_id"), "doc_id")
    sinks.upsert(rows, path, 0, order=["doc_id"])
    sinks.upsert(rows, path, 1, order=["doc_id"])
    sinks.compact(spark, path, target)
    return sinks.read_collection(spark, target)


@query(
    "k1_compacted_then_streamed",
    """select md5(text) chunk_id, coalesce(max(doc_id) filter (where lang = 'en'), max(doc_id)) doc_id,
      case when count(*) filter (where lang = 'en') > 0 then 'stream' else 'before' end pass,
      max_by(lang, (lang = 'en', doc_id)) lang, max_by(source, (lang = 'en', doc_id)) source
    from documents group by 1""",
)
def compacted_then_streamed(spark: Spark, sf: str) -> Rows:
    """A new stream starts at batch 0 on a compacted collection, and its batch is delivered twice."""
    path, target = scratch(spark, "collection"), scratch(spark, "compacted")
    rows = table(spark, sf, "documents").select(F.md5("text").alias("chunk_id"), "doc_id", "lang", "source")
    sinks.upsert(rows.withColumn("pass", F.lit("before")), path, 0, order=["doc_id"])
    sinks.compact(spark, path, target)
    for _ in range(2):
        sinks.upsert(rows.where("lang = 'en'").withColumn("pass", F.lit("stream")), target, 0, order=["doc_id"], writer="stream")
    return sinks.read_collection(spark, target).select("chunk_id", "doc_id", "pass", "lang", "source")


@query(
    "k1_two_writers",
    """select md5(text) chunk_id, max_by(doc_id, (pass, doc_id)) doc_id, ['old', 'english', 'long', 'new'][max(pass)] pass,
      max_by(lang, (pass, doc_id)) lang, max_by(source, (pass, doc_id)) source
    from (select *, unnest([1, case when lang = 'en' then 2 end, case when n_chars > 2000 then 3 end, case when source = 'src1' then 4 end]) pass
      from documents)
    where pass is not null group by 1""",
)
def two_writers(spark: Spark, sf: str) -> Rows:
    """Two streams, each from batch 0 on, share a collection. It is compacted in between, and every batch comes again."""
    path, target = scratch(spark, "collection"), scratch(spark, "compacted")
    rows = table(spark, sf, "documents").select(F.md5("text").alias("chunk_id"), "doc_id", "lang", "source", "n_chars")

    def put(writer: str, batch: int, name: str, where: str, folder: str) -> None:
        sinks.upsert(rows.where(where).withColumn("pass", F.lit(name)), folder, batch, order=["doc_id"], writer=writer)

    early = [("one", 0, "old", "true"), ("two", 0, "english", "lang = 'en'")]
    late = [("one", 1, "long", "n_chars > 2000"), ("two", 1, "new", "source = 'src1'")]
    for batch in [*early, *early]:
        put(*batch, path)
    sinks.compact(spark, path, target)
    for batch in [*early, *late, *late, *early]:  # what compaction has folded changes nothing any more
        put(*batch, target)
    return sinks.read_collection(spark, target).select("chunk_id", "doc_id", "pass", "lang", "source")


@query("k2_checked_vectors", "select vec_id, len(embedding)::bigint dims, label::bigint label from embeddings")
def checked_vectors(spark: Spark, sf: str) -> Rows:
    path = scratch(spark, "vectors")
    sinks.upsert(table(spark, sf, "embeddings"), path, 0, ["label"], key="vec_id", dim=64)
    rows = sinks.read_collection(spark, path, "vec_id")
    return rows.select("vec_id", F.size("embedding").cast("bigint").alias("dims"), F.col("label").cast("bigint").alias("label"))


@query("k3_json_dump", "select doc_id, md5(text) digest, lang from documents")
def json_dump(spark: Spark, sf: str) -> Rows:
    path = scratch(spark, "dump")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    for _ in range(2):  # the second dump replaces the first
        sinks.dump_json(docs, path)
    return spark.read.schema("doc_id bigint, text string, lang string").json(path).select(
        "doc_id", F.md5("text").alias("digest"), "lang"
    )


@query("k4_keyed_json", "select event_type as key, event_id, user_id from events")
def keyed_json(spark: Spark, sf: str) -> Rows:
    path = scratch(spark, "keyed")
    events = table(spark, sf, "events").select("event_id", "user_id", F.array("event_type").alias("symbols"))
    sinks.write_keyed_json(events, F.get("symbols", 0), path)
    back = spark.read.text(path)
    parsed = F.from_json("value", "event_id bigint, user_id bigint")
    return back.select("key", parsed.alias("v")).select("key", "v.event_id", "v.user_id")


@query(
    "k5_tap",
    """select event_type, count(*) n, any_value(total) seen, any_value(largest) largest
    from events, (select count(*) total, max(event_id) largest from events) group by event_type""",
)
def tap(spark: Spark, sf: str) -> Rows:
    """What passed on the way to the stored counts is read from the observation, not counted again."""
    rows, seen = sinks.tap(table(spark, sf, "events"), "events", F.count(F.lit(1)).alias("rows"), F.max("event_id").alias("largest"))
    counts = materialize(rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    told = seen.get
    return counts.withColumns({"seen": F.lit(told["rows"]).cast("bigint"), "largest": F.lit(told["largest"])})


# --- D: dataflow steps ------------------------------------------------------------------------------------------------


def messages(spark: Spark, sf: str) -> Rows:
    """Payloads made of events: a list of two messages, for every third user a single object instead. Errors carry a
    number that is none; views lack the url; clicks have a null url, which is fine."""

    def text(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = F.when(F.col("event_type") == "error", text(F.lit("n/a"))).otherwise(text(F.col("event_id").cast("string")))
    url = (
        F.when(F.col("event_type") == "view", F.lit(""))
        .when(F.col("event_type") == "click", F.lit('"url":null,'))
        .otherwise(F.lit('"url":"https://x.example.com",'))
    )

    def message(id_text, link):
        return F.concat(
            F.lit('{"T":"n","id":'), id_text, F.lit(',"headline":'), text(F.col("event_type")),
            F.lit(',"summary":"s","author":"a",'), link, F.lit('"created_at":'), text(when), F.lit(',"updated_at":'), text(when),
            F.lit(',"content":"<p>c</p>","symbols":['), text(F.col("event_type")), F.lit('],"source":"feed"}'),
        )

    good = message(F.col("event_id").cast("string"), F.lit('"url":"u",'))
    single = message(number, url)
    payload = F.when(F.col("user_id") % 3 == 0, single).otherwise(F.concat(F.lit("["), single, F.lit(","), good, F.lit("]")))
    return table(spark, sf, "events").select(F.col("event_id").alias("batch_id"), payload.alias("payload"))


MESSAGES = """m as (
  select event_id batch_id, 0 as position, event_type not in ('error', 'view') valid,
    event_type not in ('error', 'view') batch_valid, event_id id, event_type headline, ts from events
  union all
  select event_id, 1, true, event_type not in ('error', 'view'), event_id, event_type, ts from events where user_id % 3 <> 0)"""


@query("d1_flatten_messages", f"with {MESSAGES} select batch_id, position, headline from m")
def flatten_messages(spark: Spark, sf: str) -> Rows:
    return ingest.parse_messages(messages(spark, sf)).select("batch_id", "position", "headline")


def _accepted(spark: Spark, sf: str, policy: str) -> Rows:
    good, _ = ingest.validate(ingest.parse_messages(messages(spark, sf)), policy)
    return good.select(
        "batch_id", "position", "id", F.unix_seconds("created_at").alias("created_at"), F.get("symbols", 0).alias("symbol")
    )


_ACCEPTED = "select batch_id, position, id, epoch_us(ts) // 1000000 created_at, headline symbol from m"


@query("d2_validate_rows", f"with {MESSAGES} {_ACCEPTED} where valid")
def validate_rows(spark: Spark, sf: str) -> Rows:
    return _accepted(spark, sf, "row")


@query("d2_validate_batches", f"with {MESSAGES} {_ACCEPTED} where batch_valid")
def validate_batches(spark: Spark, sf: str) -> Rows:
    return _accepted(spark, sf, "batch")


@query("d2_rejected_rows", f"with {MESSAGES} select batch_id, position from m where not valid")
def rejected_rows(spark: Spark, sf: str) -> Rows:
    _, bad = ingest.validate(ingest.parse_messages(messages(spark, sf)))
    return bad.select("batch_id", "position")


@query(
    "a2_valid_counts",
    f"with {MESSAGES} select batch_id, count(*) filter (where valid) valid_articles, count(*) filter (where not valid) rejected_messages from m group by 1",
)
def valid_counts(spark: Spark, sf: str) -> Rows:
    return ingest.valid_counts(ingest.parse_messages(messages(spark, sf)))


@query("d3_map", "select event_id, upper(event_type) kind, round(value * 2, 6) doubled from events")
def map_rows(spark: Spark, sf: str) -> Rows:
    step = lambda df: df.select("event_id", F.upper("event_type").alias("kind"), r6(F.col("value") * 2).alias("doubled"))
    return table(spark, sf, "events").transform(step)


_EVEN = "case when json_extract_string(props, '$.k')::bigint % 2 = 0 then json_extract_string(props, '$.k')::bigint end"


@query("d4_filter_map", f"select event_id, {_EVEN} k from events where {_EVEN} is not null")
def filter_map(spark: Spark, sf: str) -> Rows:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").select("event_id", F.when(k % 2 == 0, k).alias("k")).where("k is not null")


@query("d5_key_on", "select event_id, event_type || 'xx' as key from events")
def key_on(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "events").select("event_id", F.concat("event_type", F.lit("xx")).alias("key"))


@query(
    "d6_branch",
    "select event_id, case when nullif(event_type, 'error') = 'click' then 'true' else 'false' end side from events",
)
def branches(spark: Spark, sf: str) -> Rows:
    kind = F.nullif(F.col("event_type"), F.lit("error"))
    yes, no = branch(table(spark, sf, "events"), kind == "click")
    return yes.select("event_id", F.lit("true").alias("side")).unionByName(no.select("event_id", F.lit("false").alias("side")))


@query("d7_redistribute", "select event_id, user_id from events")
def redistribute(spark: Spark, sf: str) -> Rows:
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf, "events").select("event_id", "user_id").repartition(tasks)


@query(
    "d8_running_count",
    "select event_id, event_type, count(*) over (partition by event_type order by event_id) running_count from events",
)
def running_count(spark: Spark, sf: str) -> Rows:
    placed = with_position(table(spark, sf, "events").select("event_type", "event_id"), ["event_type", "event_id"])
    return with_row_number(placed, ["event_type"], "running_count").select("event_id", "event_type", "running_count")


@query(
    "d9_first_occurrence",
    "select user_id, min(event_id) event_id, min_by(event_type, event_id) event_type from events group by user_id",
)
def first_occurrence(spark: Spark, sf: str) -> Rows:
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return feeds.first_occurrences(events, "user_id", F.col("event_id"))


_TOKENS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


@query("d10_words", f"select word, count(*) n from (select unnest({_TOKENS}) word from conversations) group by word")
def sentence_words(spark: Spark, sf: str) -> Rows:
    rows = table(spark, sf, "conversations").select(F.explode(split_tokens("text")).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d10_characters",
    "select conv_id, turn, len(string_split(text, ''))::bigint n, list_count(list_filter(string_split(text, ''), lambda c: c = 'e'))::bigint e from conversations",
)
def sentence_characters(spark: Spark, sf: str) -> Rows:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(characters("text")).alias("c"))
    return rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") == "e").alias("e"))


# --- F: filters -------------------------------------------------------------------------------------------------------


@query("f1_match_any", "select event_id from events where event_type in ('view', 'purchase')")
def match_any(spark: Spark, sf: str) -> Rows:
    condition = news.match_any(F.array("event_type"), ["view", "purchase"])
    return news.where_all(table(spark, sf, "events"), [condition]).select("event_id")


@query("f2_date_range", "select event_id from events where ts >= timestamp '2024-01-20'")
def date_range(spark: Spark, sf: str) -> Rows:
    return news.time_range(table(spark, sf, "events"), "ts", at("2024-01-20 00:00:00"), None).select("event_id")


@query(
    "f3_all_conditions",
    "select event_id from events where event_type in ('view') and ts <= timestamp '2024-01-20' and value > 5",
)
def all_conditions(spark: Spark, sf: str) -> Rows:
    conditions = [news.match_any(F.array("event_type"), ["view"]), F.col("ts") <= at("2024-01-20 00:00:00"), None, F.col("value") > 5]
    return news.where_all(table(spark, sf, "events"), conditions).select("event_id")


@query("f3_no_condition", "select event_id from events")
def no_condition(spark: Spark, sf: str) -> Rows:
    return news.where_all(table(spark, sf, "events"), [None, news.match_any(F.array("event_type"), [])]).select("event_id")


@query("f4_equality", "select doc_id from documents where lang = 'fr'")
def equality(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "documents").where(F.col("lang") == "fr").select("doc_id")


_PRESET = """case event_type when 'click' then 'Past day' when 'view' then 'Past week' when 'signup' then 'Past month'
  when 'error' then 'Custom' else 'All time' end"""


@query(
    "f6_date_presets",
    f"""with p as (select event_id, ts, {_PRESET} preset, timestamp '2024-01-31' z from events),
    r as (select event_id, ts, preset, case preset when 'Past day' then z - interval 1 day when 'Past week' then z - interval 7 day
        when 'Past month' then z - interval 30 day when 'Custom' then timestamp '2024-01-03' end a,
      case preset when 'All time' then null when 'Custom' then timestamp '2024-01-04' else z end b from p)
    select event_id, preset, {stamp_sql('a')} date_from, {stamp_sql('b')} date_to from r
    where (a is null or ts >= a) and (b is null or ts <= b)""",
)
def date_presets(spark: Spark, sf: str) -> Rows:
    kind = F.col("event_type")
    preset = (
        F.when(kind == "click", "Past day").when(kind == "view", "Past week").when(kind == "signup", "Past month")
        .when(kind == "error", "Custom").otherwise("All time")
    )
    low, high = news.date_preset(preset, at("2024-01-31 00:00:00"), at("2024-01-03 00:00:00"), at("2024-01-04 00:00:00"))
    rows = table(spark, sf, "events").select("event_id", "ts", preset.alias("preset"), low.alias("a"), high.alias("b"))
    kept = rows.where("(a is null or ts >= a) and (b is null or ts <= b)")
    return kept.select("event_id", "preset", stamp("a").alias("date_from"), stamp("b").alias("date_to"))


@query(
    "f7_symbol_text",
    """select event_id, array_to_string(list_filter(list_transform(string_split(upper(' ' || event_type || ' ,, u' || user_id || ' ,'), ','),
      lambda s: trim(s)), lambda s: s <> ''), '|') symbols from events""",
)
def symbol_text(spark: Spark, sf: str) -> Rows:
    typed = F.concat(F.lit(" "), "event_type", F.lit(" ,, u"), F.col("user_id").cast("string"), F.lit(" ,"))
    return table(spark, sf, "events").select("event_id", F.array_join(parse_symbols(typed), "|").alias("symbols"))


@query("f8_form_types", "select o_orderkey, o_orderpriority[1] form_type from orders where o_orderpriority[1] in ('3', '4', '5')")
def form_types(spark: Spark, sf: str) -> Rows:
    form = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf, "orders").where(is_ownership_form(form)).select("o_orderkey", form.alias("form_type"))


@query(
    "f9_score_range",
    """select vec_id, part, case when s between 0 and 1 then round(s, 6) end dropped, round(greatest(0, least(1, s)), 6) clamped
    from (select vec_id, unnest(range(0, len(embedding))) part, unnest(embedding)::double s from embeddings)""",
)
def score_range(spark: Spark, sf: str) -> Rows:
    score = F.col("score").cast("double")
    parts = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("part", "score"))
    return parts.select(
        "vec_id", F.col("part").cast("bigint").alias("part"), r6(in_unit_range(score)).alias("dropped"), r6(in_unit_range(score, "clamp")).alias("clamped")
    )


@query("e5_vector_sizes", "select vec_id, (len(list_filter(embedding, lambda x: x > 0.3)) = 0) rejected from embeddings")
def vector_sizes(spark: Spark, sf: str) -> Rows:
    # vectors without a large component become empty, as when a model fails
    shaped = table(spark, sf, "embeddings").withColumn(
        "embedding", F.when(F.exists("embedding", lambda x: x > 0.3), F.col("embedding")).otherwise(F.array().cast("array<float>"))
    )
    return shaped.select("vec_id", (~has_dimension(F.col("embedding"), 64)).alias("rejected"))
