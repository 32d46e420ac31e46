"""Versions, conflicts, feeds, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import CENTROIDS, at, centroids, query, r6, stamp, stamp_sql, table
from tidemark.operators import conflicts, feeds, threads, versions
from tidemark.operators.ordered import with_neighbour, with_position
from tidemark.operators.versions import latest_by
from tidemark.catalog.sources import POLLS, polls
from tidemark.session import spread
from tidemark.sources.ranges import poll_ranges

Spark, Rows = SparkSession, DataFrame


# --- V, J8, A3, A7, W4: versions --------------------------------------------------------------------------------------


def edits(spark: Spark, sf: str) -> Rows:
    """Events as document versions: the user is the document."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), "ts", F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("content"), "event_id"
    )
    return versions.new_versions(rows, "doc_id", "ts")


_ID = "md5(user_id || '|' || regexp_replace(ts::varchar, '0+$', '') || '|' || event_type || ':' || event_id)"
EDITS = f"edits as (select user_id doc_id, ts, event_type || ':' || event_id as content, event_id, {_ID} version_id from events)"


@query(
    "v1_first_versions",
    f"with {EDITS} select doc_id, min_by(content, (ts, content)) as content, min_by(version_id, (ts, content)) version_id, true is_active from edits group by doc_id",
)
def first_versions(spark: Spark, sf: str) -> Rows:
    rows = versions.add_documents(edits(spark, sf).select("doc_id", "ts", "content"))
    return rows.select("doc_id", "content", "version_id", "is_active")


_HISTORY = f"""{EDITS}, h as (select *, row_number() over w version_no, lead(ts) over w valid_to from edits
    window w as (partition by doc_id order by ts, version_id))"""


@query(
    "v2_history",
    f"with {_HISTORY} select event_id, version_no, {stamp_sql('ts')} valid_from, {stamp_sql('valid_to')} valid_to, valid_to is null is_active from h",
)
def history(spark: Spark, sf: str) -> Rows:
    rows = versions.history(edits(spark, sf))
    return rows.select("event_id", "version_no", stamp("valid_from").alias("valid_from"), stamp("valid_to").alias("valid_to"), "is_active")


@query(
    "v2_unknown_documents",
    "select event_id, user_id in (select doc_id from labels) known from events",
)
def unknown_documents(spark: Spark, sf: str) -> Rows:
    known, unknown = versions.split_unknown(edits(spark, sf), table(spark, sf, "labels"))
    return known.select("event_id", F.lit(True).alias("known")).unionByName(unknown.select("event_id", F.lit(False).alias("known")))


_AS_OF = "2024-01-12 08:00:00"


@query(
    "v3_as_of",
    f"with {EDITS} select doc_id, max_by(content, ts) as content, {stamp_sql('max(ts)')} ts from edits where ts <= timestamp '{_AS_OF}' group by doc_id",
)
def as_of(spark: Spark, sf: str) -> Rows:
    return versions.as_of(edits(spark, sf), at(_AS_OF)).select("doc_id", "content", stamp("ts").alias("ts"))


def _embedded(spark: Spark, sf: str) -> Rows:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding")
    return edits(spark, sf).join(vectors, "event_id", "left")


_SEARCH_AT = f"""{EDITS}, {CENTROIDS}, live as (select doc_id, max(ts) ts from edits where ts <= timestamp '2024-01-02 06:00:00' group by 1),
    v as (select l.doc_id, m.embedding::double[] v from live l join edits e on e.doc_id = l.doc_id and e.ts = l.ts join embeddings m on m.vec_id = e.event_id),
    s as (select c.query_id, v.doc_id, round(list_cosine_similarity(v.v, c.embedding), 9) score from cent c, v),
    r as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from s)"""


@query("v4_search_history", f"with {_SEARCH_AT} select query_id, doc_id, round(score, 6) score, rank from r where rank <= 5")
def search_history(spark: Spark, sf: str) -> Rows:
    found = versions.search_at(_embedded(spark, sf), centroids(spark, sf), at("2024-01-02 06:00:00"), 5)
    return found.select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("t5_as_of_top", f"with {_SEARCH_AT} select query_id, doc_id from r where rank <= 3")
def as_of_top(spark: Spark, sf: str) -> Rows:
    found = versions.search_at(_embedded(spark, sf), centroids(spark, sf), at("2024-01-02 06:00:00"), 3)
    return found.select("query_id", "doc_id")


@query("v5_current", f"with {_HISTORY} select doc_id, event_id, version_no from h where valid_to is null")
def current(spark: Spark, sf: str) -> Rows:
    return versions.current(versions.history(edits(spark, sf))).select("doc_id", "event_id", "version_no")


_INDEX = """select strftime(ts, '%Y-%m-%d') on_day, page, len(list(doc_id))::bigint n, string_agg(doc_id || '/' || event_id, ',' order by doc_id, event_id) entries from (
      select date_trunc('day', ts) ts, user_id doc_id, event_id,
        floor((row_number() over (partition by date_trunc('day', ts) order by user_id, event_id) - 1) / {page})::bigint page from events)
    group by ts, page"""


def _by_day(spark: Spark, sf: str, page: int) -> Rows:
    days = table(spark, sf, "events").select(
        F.date_trunc("day", "ts").alias("ts"), F.col("user_id").alias("doc_id"), F.col("event_id").alias("version_id")
    )
    rows = versions.version_index(days, page=page)
    entries = F.array_join(F.transform("versions", lambda v: F.concat(v["doc_id"].cast("string"), F.lit("/"), v["version_id"].cast("string"))), ",")
    return rows.select(F.date_format("ts", "yyyy-MM-dd").alias("on_day"), "page", F.size("versions").cast("bigint").alias("n"), entries.alias("entries"))


@query("v6_history_by_time", _INDEX.format(page=1000))
def history_by_time(spark: Spark, sf: str) -> Rows:
    return _by_day(spark, sf, 1000)


@query("a7_multimap", _INDEX.format(page=100))
def multimap(spark: Spark, sf: str) -> Rows:
    return _by_day(spark, sf, 100)


@query("a3_latest_row", "select user_id, max(event_id) event_id, max_by(value, event_id) as value from events group by 1")
def latest_row(spark: Spark, sf: str) -> Rows:
    rows = table(spark, sf, "events").select("user_id", "event_id", "value", "ts")
    return latest_by(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query(
    "w4_validity",
    f"select event_id, {stamp_sql('lead(ts) over (partition by user_id order by ts, event_id)')} valid_to from events",
)
def validity(spark: Spark, sf: str) -> Rows:
    placed = with_position(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"])
    return with_neighbour(placed, ["user_id"], {"valid_to": "ts"}).select("event_id", stamp("valid_to").alias("valid_to"))


@query(
    "w5_previous_poll",
    f"with {POLLS} select max_id, low previous from r",
)
def previous_poll(spark: Spark, sf: str) -> Rows:
    return poll_ranges(polls(spark, sf)).select("max_id", F.col("low").alias("previous"))


@query("w6_running_count", "select event_id, count(*) over (partition by user_id order by ts, event_id) n from events")
def running_count(spark: Spark, sf: str) -> Rows:
    from tidemark.operators.ordered import with_row_number

    placed = with_position(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"])
    return with_row_number(placed, ["user_id"], "n").select("event_id", "n")


@query(
    "j8_as_of_join",
    """select p.event_id probe_id, v.event_id version_event, v.value as value
    from (select * from events where event_type = 'click') p
    asof left join (select * from events where event_type = 'purchase') v on p.user_id = v.user_id and p.ts >= v.ts""",
)
def as_of_join(spark: Spark, sf: str) -> Rows:
    events = table(spark, sf, "events")
    probes = events.where("event_type = 'click'").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("asked_at"), F.col("event_id").alias("probe_id"))
    stored = events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("version_id"), F.col("event_id").alias("version_event"), "value"
    )
    found = versions.as_of_join(probes, stored, "asked_at", ["version_event", "value"])
    return found.select("probe_id", "version_event", "value")


# --- C, J4, J5, J6, U2, A9: conflicts ---------------------------------------------------------------------------------


def _sentence(price, day):
    return F.concat(
        F.col("c_name"), F.lit(" paid "), price.cast("string"), F.lit(" on "), F.date_format(day, "MMMM d, yyyy"), F.lit(" as "), "status"
    )


def order_pairs(spark: Spark, sf: str) -> Rows:
    """Two reports per order: the order itself and the next one of the same customer."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    told = orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", F.concat(F.lit("The "), F.initcap(F.lower("c_mktsegment"))).alias("c_name"),
        F.when(F.col("o_orderstatus") == "F", "Filled").when(F.col("o_orderstatus") == "O", "Open").otherwise("Pending").alias("status"),
    ).withColumn("told", _sentence(F.col("o_totalprice"), F.col("o_orderdate")))
    placed = with_position(told.select("o_orderkey", "o_custkey", "o_orderdate", "told", "o_totalprice"), ["o_custkey", "o_orderdate", "o_orderkey"])
    nexts = with_neighbour(placed, ["o_custkey"], {"new_content": "told", "next_price": "o_totalprice"})
    return nexts.where("new_content is not null").select(
        F.col("o_orderkey").alias("pair_id"), F.col("told").alias("old_content"), "new_content", "o_totalprice", "next_price"
    )


ORDER_PAIRS = """told as (
  select o_orderkey, o_custkey, o_orderdate, o_totalprice,
    'The ' || upper(c_mktsegment[1]) || lower(substr(c_mktsegment, 2)) || ' paid ' || o_totalprice::varchar || ' on ' || strftime(o_orderdate, '%B %-d, %Y')
      || ' as ' || case o_orderstatus when 'F' then 'Filled' when 'O' then 'Open' else 'Pending' end told
  from orders join customer on c_custkey = o_custkey),
op as (
  select o_orderkey pair_id, told old_content, lead(told) over w new_content, o_totalprice, lead(o_totalprice) over w next_price
  from told window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
pairs as (select * from op where new_content is not null)"""

_DATE = conflicts.DATE


def plain_sql(c: str) -> str:
    return f"regexp_replace({c}, '{_DATE}', ' | ', 'g')"


def dates_sql(c: str) -> str:
    return f"regexp_extract_all({c}, '{_DATE}')"


def numbers_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all({plain_sql(c)}, '{conflicts.NUMBER}'), lambda n: try_cast(n as double) is not null)"


def names_sql(c: str) -> str:
    return f"regexp_extract_all({plain_sql(c)}, '{conflicts.NAME}')"


def entities_sql(c: str) -> str:
    return f"""list_distinct(list_concat(list_concat(list_transform({names_sql(c)}, lambda e: 'NAME|' || e),
      list_transform({dates_sql(c)}, lambda e: 'DATE|' || e)), list_transform({numbers_sql(c)}, lambda e: 'CARDINAL|' || e)))"""


def detected_sql(source: str) -> str:
    """Conflicts of ``source(pair_id, old_content, new_content)`` without the factual ones."""
    return f"""x as (select pair_id, {numbers_sql('old_content')} od, {numbers_sql('new_content')} nd, {dates_sql('old_content')} ot, {dates_sql('new_content')} nt,
      {entities_sql('old_content')} oe, {entities_sql('new_content')} ne from {source}),
    found as (
      select pair_id, 'numerical' as type, o old_content, n new_content, 0.8 confidence from (select pair_id, o, unnest(nd) n from (select pair_id, unnest(od) o, nd from x))
        where abs(o::double - n::double) / nullif(greatest(o::double, n::double), 0) > 0.1
      union all
      select pair_id, 'temporal', o, n, 0.9 from (select pair_id, o, unnest(nt) n from (select pair_id, unnest(ot) o, nt from x)) where o <> n
      union all
      select pair_id, 'entity', split_part(o, '|', 2), split_part(n, '|', 2), 0.7 from (select pair_id, o, unnest(ne) n from (select pair_id, unnest(oe) o, ne from x))
        where split_part(o, '|', 1) = split_part(n, '|', 1) and o <> n)"""


_FOUND = f"{ORDER_PAIRS}, {detected_sql('pairs')}"
_SHOW = "select pair_id, type, old_content, new_content, confidence from found"


def _detected(spark: Spark, sf: str) -> Rows:
    return conflicts.detect_conflicts(order_pairs(spark, sf))


_COLUMNS = ("pair_id", "type", "old_content", "new_content", "confidence")


def _of(spark: Spark, sf: str, kind: str) -> Rows:
    return conflicts.detect_conflicts(order_pairs(spark, sf), detectors=[kind]).select(*_COLUMNS)


@query(
    "j4_price_changes",
    f"with {ORDER_PAIRS} select pair_id, round(abs(o_totalprice - next_price) / greatest(o_totalprice, next_price), 6) difference from pairs where abs(o_totalprice - next_price) / greatest(o_totalprice, next_price) > 0.1",
)
def price_changes(spark: Spark, sf: str) -> Rows:
    from tidemark.functions.records import relative_difference

    rows = order_pairs(spark, sf).withColumn("difference", relative_difference(F.col("o_totalprice"), F.col("next_price")))
    return rows.where("difference > 0.1").select("pair_id", r6("difference").alias("difference"))


@query("j5_date_changes", f"with {_FOUND} select pair_id, old_content, new_content from found where type = 'temporal'")
def date_changes(spark: Spark, sf: str) -> Rows:
    return _of(spark, sf, "temporal").select("pair_id", "old_content", "new_content")


def turn_pairs(spark: Spark, sf: str) -> Rows:
    """Turn n and n + 1 of a conversation as old and new text."""
    turns = table(spark, sf, "conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new_content"))
    return turns.join(later, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("pair_id"), F.col("text").alias("old_content"), "new_content"
    )


TURN_PAIRS = """tp as (select a.conv_id * 100000 + a.turn pair_id, a.text old_content, b.text new_content
    from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1)"""
_TURNS = f"{TURN_PAIRS}, {detected_sql('tp')}"


@query("j6_entity_changes", f"with {_TURNS} select pair_id, old_content, new_content from found where type = 'entity'")
def entity_changes(spark: Spark, sf: str) -> Rows:
    rows = conflicts.detect_conflicts(turn_pairs(spark, sf), detectors=["entity"])
    return rows.select("pair_id", "old_content", "new_content")


@query("u2_entity_sets", f"select conv_id, turn, len({entities_sql('text')})::bigint entities, array_to_string(list_sort(list_distinct({names_sql('text')})), '|') names from conversations")
def entity_sets(spark: Spark, sf: str) -> Rows:
    names = F.array_sort(F.array_distinct(conflicts.names(F.col("text"))))
    both = F.array_distinct(
        F.concat(
            F.transform(conflicts.names(F.col("text")), lambda e: F.concat(F.lit("NAME|"), e)),
            F.transform(conflicts.date_phrases(F.col("text")), lambda e: F.concat(F.lit("DATE|"), e)),
            F.transform(conflicts.numbers(F.col("text")), lambda e: F.concat(F.lit("CARDINAL|"), e)),
        )
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(both).cast("bigint").alias("entities"), F.array_join(names, "|").alias("names")
    )


@query("c1_all_conflicts", f"with {_FOUND} {_SHOW}")
def all_conflicts(spark: Spark, sf: str) -> Rows:
    return _detected(spark, sf).select(*_COLUMNS)


@query("c2_numerical", f"with {_FOUND} {_SHOW} where type = 'numerical'")
def numerical(spark: Spark, sf: str) -> Rows:
    return _of(spark, sf, "numerical")


@query("c3_temporal", f"with {_FOUND} {_SHOW} where type = 'temporal'")
def temporal(spark: Spark, sf: str) -> Rows:
    return _of(spark, sf, "temporal")


@query("c4_entity", f"with {_FOUND} {_SHOW} where type = 'entity'")
def entity(spark: Spark, sf: str) -> Rows:
    return _of(spark, sf, "entity")


def denials(spark: Spark, sf: str) -> Rows:
    """Every order reported twice; reports of urgent orders are denied."""
    status = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" is "), F.when(F.col("o_orderstatus") == "F", "filled").otherwise("open"))
    new = F.concat(status, F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(" not now")).otherwise(F.lit(" now")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair_id"), F.concat(status, F.lit(" now")).alias("old_content"), new.alias("new_content"))


@query(
    "c5_factual",
    """select o_orderkey pair_id, 'factual' as type, round(5 / 6, 6) confidence,
      'Order ' || o_orderkey || ' is ' || case when o_orderstatus = 'F' then 'filled' else 'open' end || ' not now' new_content,
      'Order|Order|' || o_orderkey || '|' || o_orderkey entities
    from orders where o_orderpriority = '1-URGENT'""",
)
def factual(spark: Spark, sf: str) -> Rows:
    rows = conflicts.detect_conflicts(denials(spark, sf), detectors=["factual"])
    return rows.select("pair_id", "type", r6("confidence").alias("confidence"), "new_content", F.array_join("entities_involved", "|").alias("entities"))


@query("c6_entities", f"select conv_id, turn, array_to_string(list_concat(list_concat({names_sql('text')}, {dates_sql('text')}), {numbers_sql('text')}), '|') entities from conversations")
def entities(spark: Spark, sf: str) -> Rows:
    found = F.array_join(conflicts.extract_entities(F.col("text")), "|")
    return table(spark, sf, "conversations").select("conv_id", "turn", found.alias("entities"))


# the last conflict of an order pair is its last entity clash; first and last follow the sorted entity lists
_ORDERED = f"""{ORDER_PAIRS}, x as (select pair_id, list_filter({numbers_sql('old_content')}, lambda n: true) od, {numbers_sql('new_content')} nd,
      {dates_sql('old_content')} ot, {dates_sql('new_content')} nt, list_sort({entities_sql('old_content')}) oe, list_sort({entities_sql('new_content')}) ne from pairs),
    seq as (
      select pair_id, 1 d, i, j, 'numerical' as type, od[i] o, nd[j] n, 0.8 c from (select *, unnest(range(1, len(nd) + 1)) j from (select *, unnest(range(1, len(od) + 1)) i from x))
        where abs(od[i]::double - nd[j]::double) / nullif(greatest(od[i]::double, nd[j]::double), 0) > 0.1
      union all
      select pair_id, 2, i, j, 'temporal', ot[i], nt[j], 0.9 from (select *, unnest(range(1, len(nt) + 1)) j from (select *, unnest(range(1, len(ot) + 1)) i from x)) where ot[i] <> nt[j]
      union all
      select pair_id, 3, i, j, 'entity', split_part(oe[i], '|', 2), split_part(ne[j], '|', 2), 0.7
        from (select *, unnest(range(1, len(ne) + 1)) j from (select *, unnest(range(1, len(oe) + 1)) i from x))
        where split_part(oe[i], '|', 1) = split_part(ne[j], '|', 1) and oe[i] <> ne[j]),
    ends as (select pair_id, min_by(o, (d, i, j)) fo, min_by(n, (d, i, j)) fn, max_by(o, (d, i, j)) lo, max_by(n, (d, i, j)) ln,
      max_by(type, (d, i, j)) lt, max_by(c, (d, i, j)) lc from seq group by pair_id)"""


def _resolved(spark: Spark, sf: str, strategy: str) -> Rows:
    rows = conflicts.resolve_conflicts(_detected(spark, sf), strategy)
    return rows.select("pair_id", "resolved_content", r6("confidence_score").alias("confidence_score"))


@query("a9_last_conflict", f"with {_ORDERED} select pair_id, lt as type, lo old_content, ln new_content from ends")
def last_conflict(spark: Spark, sf: str) -> Rows:
    rows = _detected(spark, sf)
    last = rows.groupBy("pair_id").agg(F.max_by(F.struct("type", "old_content", "new_content"), F.col("seq")).alias("c"))
    return last.select("pair_id", "c.*")


@query("c7_newest_wins", f"with {_ORDERED} select pair_id, ln resolved_content, lc confidence_score from ends")
def newest_wins(spark: Spark, sf: str) -> Rows:
    return _resolved(spark, sf, "newest_wins")


@query(
    "c8_confidence_based",
    f"with {_ORDERED} select pair_id, case when lc > 0.7 then ln else lo end resolved_content, case when lc > 0.7 then lc else 1 - lc end confidence_score from ends",
)
def confidence_based(spark: Spark, sf: str) -> Rows:
    return _resolved(spark, sf, "confidence_based")


@query(
    "c9_merge",
    f"""with {_ORDERED} select pair_id, case lt when 'numerical' then ln || ' (previously reported as ' || lo || ')'
      when 'temporal' then ln || ' (updated from ' || lo || ')' else ln || ' (formerly ' || lo || ')' end resolved_content, 0.5 confidence_score from ends""",
)
def merge(spark: Spark, sf: str) -> Rows:
    return _resolved(spark, sf, "merge")


@query(
    "c10_resolution_records",
    f"with {_ORDERED} select pair_id, fo original_version, fn new_version, ln resolved_content, 'newest_wins' strategy, lt conflict_type from ends",
)
def resolution_records(spark: Spark, sf: str) -> Rows:
    rows = conflicts.resolve_conflicts(_detected(spark, sf))
    meta = F.col("resolution_metadata")
    return rows.select(
        "pair_id", "original_version", "new_version", "resolved_content",
        meta["strategy"].alias("strategy"), meta["original_conflict_type"].alias("conflict_type"),
    )


# --- S12, D9, J1, J2, G8: filings -------------------------------------------------------------------------------------


def filing_feeds(spark: Spark, sf: str) -> Rows:
    """One feed document per order: its filing twice, and one more without a customer number."""
    orders = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"))
    number, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    form = F.substring("o_orderpriority", 1, 1)

    def entry(serial, title, kind):
        return F.concat(
            F.lit("<entry><id>urn:tag:x,2008:accession-number=00-24-"), serial, F.lit("</id><title>"), title,
            F.lit('</title><link rel="alternate" type="text/html" href="https://www.sec.gov/Archives/edgar/data/'), customer, F.lit("/00"), number,
            F.lit("/00-24-"), number, F.lit('-index.htm"/><link type="application/xml" href="x"/><category scheme="s" label="form type" term="'), kind, F.lit('"/></entry>'),
        )

    named = F.concat(form, F.lit(" - Holder &amp; Co ("), F.lpad(customer, 10, "0"), F.lit(") (Reporting)"))
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Latest</title>'),
        entry(number, named, form), entry(number, named, form), entry(F.concat(number, F.lit("-N9")), F.lit("no number"), F.lit("8-K")), F.lit("</feed>"),
    )
    return orders.select(F.col("o_orderkey").alias("feed_id"), F.col("o_orderdate").alias("poll_ts"), xml.alias("xml"))


_LINK = "'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/00' || o_orderkey || '/00-24-' || o_orderkey || '-index.htm'"
FILINGS = f"""entries as (
  select o_orderkey feed_id, unnest([0, 1, 2]) entry_no, unnest(['0024' || o_orderkey, '0024' || o_orderkey, '0024' || o_orderkey || 'N9']) id,
    unnest([o_orderpriority[1] || ' - Holder & Co (' || lpad(o_custkey::varchar, 10, '0') || ') (Reporting)',
      o_orderpriority[1] || ' - Holder & Co (' || lpad(o_custkey::varchar, 10, '0') || ') (Reporting)', 'no number']) title,
    {_LINK} link, unnest([lpad(o_custkey::varchar, 10, '0'), lpad(o_custkey::varchar, 10, '0'), 'No CIK found']) cik,
    unnest([o_orderpriority[1], o_orderpriority[1], '8-K']) form_type, o_custkey, o_orderkey
  from orders),
filings as (select * from entries qualify row_number() over (partition by id order by feed_id, entry_no) = 1),
tickers as (select c_custkey cik, 'A' || c_nationkey ticker from customer where c_mktsegment = 'BUILDING'),
texts as (select c_custkey, 'S' || c_custkey symbol from customer where c_mktsegment in ('MACHINERY', 'BUILDING'))"""


def tickers(spark: Spark, sf: str) -> Rows:
    """Customers of one segment, each with two symbols; the first in order counts."""
    chosen = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    nation = F.col("c_nationkey").cast("string")
    symbols = F.explode(F.array(F.concat(F.lit("B"), nation), F.concat(F.lit("A"), nation)))
    return chosen.select(F.col("c_custkey").alias("cik_str"), symbols.alias("ticker"), F.col("c_name").alias("title"))


def filing_texts(spark: Spark, sf: str) -> Rows:
    """Texts of the filings of two segments; those of a third name no symbol."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    number, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), customer, F.lit("/00"), number, F.lit("/00-24-"), number, F.lit(".txt"))
    named = F.concat(F.lit("<issuer>\n<issuerTradingSymbol>S"), customer, F.lit("</issuerTradingSymbol></issuer>"))
    text = F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), named).otherwise(F.lit("<issuer/>"))
    return orders.where("c_mktsegment <> 'FURNITURE'").select(url.alias("url"), text.alias("text"))


@query("s12_atom_feed", f"with {FILINGS} select feed_id, entry_no, id, title, link, cik, form_type from entries")
def atom_feed(spark: Spark, sf: str) -> Rows:
    return feeds.parse_atom(filing_feeds(spark, sf), keep=("feed_id",))


def _filings(spark: Spark, sf: str) -> Rows:
    entries = feeds.parse_atom(filing_feeds(spark, sf), keep=("feed_id",))
    return feeds.first_occurrences(entries, "id", F.struct("feed_id", "entry_no"))


@query(
    "j1_ticker_lookup",
    f"with {FILINGS} select f.id, coalesce(t.ticker, 'no_ticker') ticker from filings f left join tickers t on t.cik = try_cast(f.cik as bigint)",
)
def ticker_lookup(spark: Spark, sf: str) -> Rows:
    return feeds.enrich(_filings(spark, sf), tickers(spark, sf)).select("id", "ticker")


ENRICHED = """, e as (select f.id, f.form_type, f.title, f.link, f.cik, case when t.ticker is not null then t.ticker when f.form_type in ('3', '4', '5') then x.symbol else 'no_ticker' end ticker
    from filings f left join tickers t on t.cik = try_cast(f.cik as bigint) left join texts x on x.c_custkey = f.o_custkey)"""


@query("j2_fallback_lookup", f"with {FILINGS}{ENRICHED} select id, ticker from e where ticker is not null")
def fallback_lookup(spark: Spark, sf: str) -> Rows:
    return feeds.enrich(_filings(spark, sf), tickers(spark, sf), filing_texts(spark, sf)).select("id", "ticker")


# --- J9, G7: threads --------------------------------------------------------------------------------------------------


def items(spark: Spark, sf: str) -> Rows:
    """Turns as forum items: each answers the one before; openings of every conversation are stories. Where the second
    turn is the user's again, or the text is short, the parent is unknown to the table."""
    turns = table(spark, sf, "conversations")
    number = F.col("conv_id") * 100000 + F.col("turn")
    parent = F.when(F.col("turn") == 0, F.lit(None)).when(F.length("text") % 11 == 0, -number).otherwise(number - 1)
    return turns.select(number.alias("id"), parent.cast("bigint").alias("parent"), F.when(F.col("turn") == 0, "story").otherwise("comment").alias("type"))


ITEMS = """items as (select conv_id * 100000 + turn id, case when turn = 0 then null when length(text) % 11 = 0 then -(conv_id * 100000 + turn)
      else conv_id * 100000 + turn - 1 end parent, case when turn = 0 then 'story' else 'comment' end as type from conversations)"""
ROOTS = f"""{ITEMS}, walk as (
      select id, id root_id, parent is not null is_orphan from items where parent is null or parent not in (select id from items)
      union all
      select i.id, w.root_id, w.is_orphan from items i join walk w on i.parent = w.id)"""


@query("j9_thread_roots", f"with recursive {ROOTS} select id, root_id, is_orphan from walk")
def thread_roots(spark: Spark, sf: str) -> Rows:
    return threads.thread_roots(items(spark, sf)).drop("in_circle")


@query(
    "j9_circles",
    """with g as (select event_id // 7 g, min(event_id) lo, max(event_id) hi from events group by 1)
    select event_id id, case when g % 5 = 0 then lo else hi end root_id, g % 5 = 0 in_circle, false is_orphan
    from events join g on event_id // 7 = g""",
)
def circles(spark: Spark, sf: str) -> Rows:
    """Chains of seven events; every fifth chain is closed to a circle, and ends at its smallest id."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr("event_id div 7").alias("g"))
    ends = events.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    last = F.when(F.col("g") % 5 == 0, F.col("lo"))
    chained = events.join(ends, "g").select("id", F.when(F.col("id") == F.col("hi"), last).otherwise(F.col("id") + 1).alias("parent"))
    return threads.thread_roots(chained)


@query(
    "g7_story_and_comment_streams",
    f"""with recursive {ROOTS} select id::varchar as key, 'story' side, '{{"id":' || id || ',"type":"story"}}' json from items where type = 'story'
    union all
    select w.root_id::varchar, 'comment', '{{"id":' || i.id || ',"parent":' || i.parent || ',"type":"comment","root_id":' || w.root_id || '}}'
    from items i join walk w on w.id = i.id where i.type <> 'story'""",
)
def story_and_comment_streams(spark: Spark, sf: str) -> Rows:
    stories, comments = threads.story_and_comment_streams(items(spark, sf), F.col("type") == "story")
    return stories.withColumn("side", F.lit("story")).unionByName(comments.withColumn("side", F.lit("comment")))
