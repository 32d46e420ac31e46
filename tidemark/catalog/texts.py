"""Text functions, small expressions, chunking and embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import (
    BUDGET, DIM, articles, collection, query, questions, r6, scratch, stamp, stamp_sql, table, words_sql,
)
from tidemark.functions import records, text, vectors
from tidemark.functions.freshness import age_hours
from tidemark.operators import ingest
from tidemark.plans.search import process_queries
from tidemark.session import widen

Spark, Rows = SparkSession, DataFrame
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

# The named character entities of the test pages; the ampersand comes last, so nothing is decoded twice.
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&middot;": "·",
    "&copy;": "©",
    "&reg;": "®",
    "&trade;": "™",
    "&hellip;": "…",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&bull;": "•",
    "&euro;": "€",
    "&pound;": "£",
    "&amp;": "&",
}


def sub(expr: str, pattern: str, to: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({expr}, '{quoted}', '{to}', 'g')"


def html_sql(expr: str) -> str:
    out = expr
    for pattern, to in ((text.COMMENT, ""), (text.SCRIPT, " "), (text.STYLE, " "), (text.BLOCK_TAG, " "), (text.ANY_TAG, "")):
        out = sub(out, pattern, to)
    out = f"""array_to_string(list_transform(string_split({out}, '&#'), lambda p, i: case when i = 1 then p
      when regexp_matches(p, '^[0-9]{{1,7}};') then chr(regexp_extract(p, '^([0-9]+);', 1)::int) || regexp_replace(p, '^[0-9]+;', '')
      when regexp_matches(p, '^[xX][0-9a-fA-F]{{1,6}};') then chr(('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]+);', 1))::int)
        || regexp_replace(p, '^[xX][0-9a-fA-F]+;', '')
      else '&#' || p end), '')"""
    for entity, char in ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim({sub(out, '[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f]+', ' ')})"


def strip_sql(expr: str) -> str:
    spaces = "[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
    return sub(sub(expr, "^" + spaces, ""), spaces + "$", "")


def quotes_sql(expr: str) -> str:
    return sub(sub(expr, text.SINGLE_QUOTES, "''"), text.DOUBLE_QUOTES, '"')


def clean_sql(expr: str) -> str:
    out = html_sql(f"translate({expr}, '{text.BOLD}', '{text.BOLD_PLAIN}')")
    out = sub(f"translate({out}, '{text.ITALIC}', '{text.ITALIC_PLAIN}')", text.EMOJI, " ")
    return sub(sub(quotes_sql(strip_sql(out)), r"[^\x{0}-\x{7F}]", ""), text.URL, "[URL]")


def digest_sql(expr: str) -> str:
    return f"md5({expr}) digest, length({expr})::bigint size"


def digest(c):
    return [F.md5(c).alias("digest"), F.length(c).cast("bigint").alias("size")]


# --- X: text ----------------------------------------------------------------------------------------------------------


@query("x1_unbold", f"select doc_id, {digest_sql('text')}, length(text)::bigint styled from documents")
def unbold(spark: Spark, sf: str) -> Rows:
    styled = F.translate("text", text.BOLD_PLAIN, text.BOLD)
    plain = text.unbold(styled)
    return table(spark, sf, "documents").select("doc_id", *digest(plain), F.length(styled).cast("bigint").alias("styled"))


@query("x2_unitalic", f"select doc_id, {digest_sql('text')} from documents")
def unitalic(spark: Spark, sf: str) -> Rows:
    plain = text.unitalic(F.translate("text", text.ITALIC_PLAIN, text.ITALIC))
    return table(spark, sf, "documents").select("doc_id", *digest(plain))


_EMOJI = "\U0001f600\U0001f680→"


@query("x3_drop_emoji", f"""select doc_id, {digest_sql("regexp_replace(text, 'e+', ' ', 'g')")} from documents""")
def drop_emoji(spark: Spark, sf: str) -> Rows:
    decorated = F.replace("text", F.lit("e"), F.lit(_EMOJI))
    return table(spark, sf, "documents").select("doc_id", *digest(text.drop_emoji(decorated)))


@query(
    "x4_mask_urls",
    "select page_id, '[URL] see [URL] and [URL] ' || length(html) masked, url from pages",
)
def mask_urls(spark: Spark, sf: str) -> Rows:
    host = F.regexp_extract("url", r"//([^/]+)", 1)
    line = F.concat("url", F.lit(" see "), "url", F.lit(" and www."), host, F.lit(" "), F.length("html").cast("string"))
    return table(spark, sf, "pages").select("page_id", text.mask_urls(line).alias("masked"), "url")


_MARKED = "html || '<p>it&#8217;s &#x41;&amp;lt;</p>&nbsp;&#bad;'"


def _marked():
    return F.concat("html", F.lit("<p>it&#8217;s &#x41;&amp;lt;</p>&nbsp;&#bad;"))


@query("x5_html_to_text", f"select page_id, {digest_sql('t')} from (select page_id, {html_sql(_MARKED)} t from pages)")
def html_to_text(spark: Spark, sf: str) -> Rows:
    pages = widen(table(spark, sf, "pages"))
    return pages.select("page_id", text.html_to_text(_marked()).alias("t")).select("page_id", *digest("t"))


@query("x6_ascii_only", rf"select doc_id, {digest_sql('t')} from (select doc_id, {sub('text', '[^ -~' + chr(92) + 'x00-' + chr(92) + 'x1F' + chr(92) + 'x7F]', '')} t from documents)")
def ascii_only(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "documents").select("doc_id", *digest(text.ascii_only("text")))


@query(
    "x7_plain_quotes",
    f"""select doc_id, {digest_sql("replace(replace(text, '.', ''''), 'o', '\"')")} from documents""",
)
def plain_quotes(spark: Spark, sf: str) -> Rows:
    curly = F.replace(F.replace("text", F.lit("."), F.lit("’")), F.lit("o"), F.lit("“"))
    # documents hold one curly quote of their own; both sides see it as plain
    return table(spark, sf, "documents").select("doc_id", *digest(text.plain_quotes(curly)))


@query("x8_strip", f"select doc_id, {digest_sql('t')} from (select doc_id, {strip_sql('text')} t from documents)")
def strip(spark: Spark, sf: str) -> Rows:
    padded = F.concat(F.lit(" \t  "), "text", F.lit("　\n "))
    return table(spark, sf, "documents").select("doc_id", *digest(text.strip(padded)))


@query("x9_clean_documents", f"select doc_id, {digest_sql('t')} from (select doc_id, {clean_sql('text')} t from documents)")
def clean_documents(spark: Spark, sf: str) -> Rows:
    docs = widen(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", text.clean_all("text").alias("t")).select("doc_id", *digest("t"))


@query(
    "x9_clean_pages",
    f"""select page_id, {digest_sql('t')} from (select page_id, {clean_sql("html || '<i>' || url || '</i>'")} t from pages)""",
)
def clean_pages(spark: Spark, sf: str) -> Rows:
    page = F.concat("html", F.lit("<i>"), "url", F.lit("</i>"))
    pages = widen(table(spark, sf, "pages"))
    return pages.select("page_id", text.clean_all(page).alias("t")).select("page_id", *digest("t"))


@query("x10_content_id", "select doc_id, md5(text) content_id from documents")
def content_id(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "documents").select("doc_id", records.content_id(F.col("text")).alias("content_id"))


# --- X: dates and numbers ---------------------------------------------------------------------------------------------


@query(
    "x11_parse_rfc3339",
    "select event_id, case when event_type <> 'error' then epoch_us(date_trunc('second', ts)) end micros from events",
)
def parse_rfc3339(spark: Spark, sf: str) -> Rows:
    written = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), written)).otherwise(written)
    return table(spark, sf, "events").select("event_id", F.unix_micros(records.parse_rfc3339(broken)).alias("micros"))


@query(
    "x12_format_times",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') request, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') shown
    from orders""",
)
def format_times(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("request"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("shown"),
    )


@query(
    "x13_age_hours",
    "select event_id, round((epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3.6e9, 6) age_hours from events",
)
def ages(spark: Spark, sf: str) -> Rows:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", r6(age_hours(F.col("ts"), now)).alias("age_hours"))


@query(
    "x14_cosine",
    """select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 6) score
    from embeddings""",
)
def cosine(spark: Spark, sf: str) -> Rows:
    score = vectors.cosine(F.col("embedding"), F.reverse("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", r6(score).alias("score"))


@query(
    "x15_relative_difference",
    """select l_orderkey, l_linenumber, round(abs(l_tax - l_discount) / nullif(greatest(l_tax, l_discount), 0), 6) difference
    from lineitem""",
)
def relative_difference(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(records.relative_difference(F.col("l_tax"), F.col("l_discount"))).alias("difference")
    )


@query(
    "x16_numeric_literals",
    """select doc_id, token, round(try_cast(token as double), 6) number from (
      select doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))) token from documents)
    where regexp_matches(token, '^\\.*[0-9][0-9.]*$') and try_cast(token as double) is not null""",
)
def numeric_literals(spark: Spark, sf: str) -> Rows:
    tokens = F.explode(F.array_distinct(text.split_tokens("text"))).alias("token")
    rows = table(spark, sf, "documents").select("doc_id", tokens)
    number = records.numeric_literal(F.col("token"))
    return rows.select("doc_id", "token", r6(number).alias("number")).where("number is not null")


# --- X: ids, links, JSON ----------------------------------------------------------------------------------------------


def _title():
    named = F.concat(F.lit("4 - "), "c_name", F.lit(" ("), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit(") (Issuer)"))
    return F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(named)


@query(
    "x17_cik_of_title",
    "select c_custkey, case when c_mktsegment = 'BUILDING' then 'No CIK found' else lpad(c_custkey::varchar, 10, '0') end cik from customer",
)
def cik_of_title(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "customer").select("c_custkey", records.cik_of_title(_title()).alias("cik"))


@query("x18_accession_id", "select o_orderkey, '0' || o_custkey || '24' || o_orderkey id from orders")
def accession_id(spark: Spark, sf: str) -> Rows:
    urn = F.concat(F.lit("urn:tag:x,2008:accession-number=0"), F.col("o_custkey").cast("string"), F.lit("-24-"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", records.accession_id(urn).alias("id"))


@query(
    "x19_filing_text_url",
    """select o_orderkey, case when o_orderkey % 5 <> 0 then
      'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/00' || o_orderkey || '/0-' || o_orderkey || '.txt' end url from orders""",
)
def filing_text_url(spark: Spark, sf: str) -> Rows:
    number, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    full = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), customer, F.lit("/00"), number, F.lit("/0-"), number, F.lit("-index.htm"))
    link = F.when(F.col("o_orderkey") % 5 == 0, F.lit("https://short/link")).otherwise(full)
    return table(spark, sf, "orders").select("o_orderkey", records.filing_text_url(link).alias("url"))


@query("x20_first_element", "select doc_id, list_filter([lang, source], lambda x: x <> 'en' and x <> 'src1')[1] first from documents")
def first_element(spark: Spark, sf: str) -> Rows:
    symbols = F.filter(F.array("lang", "source"), lambda x: (x != "en") & (x != "src1"))
    return table(spark, sf, "documents").select("doc_id", records.first_or_null(symbols).alias("first"))


@query(
    "x21_to_json",
    """select event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' json from events""",
)
def to_json(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("json"))


@query(
    "x22_json_fields",
    "select event_id, json_extract_string(props, '$.k')::bigint k, json_extract_string(props, '$.none') missing from events",
)
def json_fields(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "events").select(
        "event_id",
        F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"),
        F.get_json_object("props", "$.none").alias("missing"),
    )


@query("x23_merge_maps", "select doc_id, 'later ' || lang || '|' || doc_id || '|' || source merged from documents")
def merged_maps(spark: Spark, sf: str) -> Rows:
    base = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    later = F.concat(F.lit("later "), "lang")
    more = F.create_map(F.lit("text_id"), F.col("doc_id").cast("string"), F.lit("lang"), later)
    both = records.merge_maps(base, more)
    merged = F.concat_ws("|", both["lang"], both["text_id"], both["source"])
    return table(spark, sf, "documents").select("doc_id", merged.alias("merged"))


@query(
    "x24_lists_and_labels",
    """select doc_id, lang || ', ' || source symbols, md5(substr(text, 1, 30) || '...') label, printf('%.3f', n_chars / 7) shown
    from documents""",
)
def lists_and_labels(spark: Spark, sf: str) -> Rows:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(F.array("lang", "source"), ", ").alias("symbols"),
        F.md5(text.shorten("text")).alias("label"),
        F.format_string("%.3f", F.col("n_chars") / 7).alias("shown"),
    )


@query(
    "x25_defaults",
    "select doc_id, coalesce(quality::varchar, 'N/A') quality from documents left join labels using (doc_id)",
)
def defaults(spark: Spark, sf: str) -> Rows:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", records.or_na(F.col("quality")).alias("quality"))


# --- E: chunks and vectors --------------------------------------------------------------------------------------------

ARTICLES = """articles as (
  select d.doc_id id, 'Report ' || d.source headline, d.lang summary, 'desk ' || d.lang author, e.ts created_at, e.ts updated_at,
    'https://news.example.com/' || d.doc_id url, d.text as content, d.source source
  from documents d join events e on e.event_id = d.doc_id)"""


def chunks_sql(budget: int = BUDGET) -> str:
    room = budget - 2
    return f"""{ARTICLES},
parts as (
  select md5(content) id, id article_id, unnest([0, 1, 2]) part_no, updated_at, source, url, headline, author,
    unnest([{clean_sql('headline')}, {clean_sql('summary')}, {clean_sql('content')}]) part from articles),
segs as (select *, string_split(part, ' ') seg from parts),
nos as (select *, unnest(range(0, (len(seg) - 1) // {room} + 1)) chunk_no from segs),
chunks as (
  select * from (
    select id, article_id, part_no, updated_at, source, url, headline, author, chunk_no,
      array_to_string(list_slice(seg, chunk_no * {room} + 1, (chunk_no + 1) * {room}), ' ')
        || case when (chunk_no + 1) * {room} < len(seg) then ' ' else '' end as text from nos)
  where text <> '')"""


def buckets_sql(expr: str, dim: int = DIM) -> str:
    return f"list_transform({words_sql(expr)}, lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % {dim})"


def counts_sql(buckets: str, dim: int = DIM) -> str:
    return f"list_transform(range(0, {dim}), lambda d: len(list_filter({buckets}, lambda x: x = d))::double)"


@query(
    "e1_documents",
    f"""with {ARTICLES} select md5(content) id, id article_id, md5(h || '|' || s || '|' || c) texts, h headline from (
      select *, {clean_sql('headline')} h, {clean_sql('summary')} s, {clean_sql('content')} c from articles)""",
)
def documents(spark: Spark, sf: str) -> Rows:
    docs = ingest.to_documents(articles(spark, sf))
    return docs.select("id", "article_id", F.md5(F.array_join("text", "|")).alias("texts"), "headline")


@query("e2_chunks", f"with {chunks_sql()} select article_id, part_no, chunk_no::bigint chunk_no, md5(text) chunk_id from chunks")
def chunks(spark: Spark, sf: str) -> Rows:
    rows = ingest.compute_chunks(ingest.to_documents(articles(spark, sf)), budget=BUDGET)
    return rows.select("article_id", "part_no", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk_id")


@query(
    "e2_chunks_by_length",
    # the greedy rule, walked segment by segment
    """with recursive s as (select conv_id, turn, string_split(text, ' ') seg from conversations),
    walk as (
      select conv_id, turn, seg, 1 i, 0 chunk_no, length(seg[1])::bigint used from s
      union all
      select conv_id, turn, seg, i + 1,
        case when used + length(seg[i + 1]) > 198 and used > 0 then chunk_no + 1 else chunk_no end,
        case when used + length(seg[i + 1]) > 198 and used > 0 then length(seg[i + 1]) else used + length(seg[i + 1]) end
      from walk where i < len(seg)),
    c as (
      select conv_id, turn, chunk_no, string_agg(seg[i], ' ' order by i) || case when max(i) < any_value(len(seg)) then ' ' else '' end piece
      from walk group by conv_id, turn, chunk_no)
    select conv_id, turn, (row_number() over (partition by conv_id, turn order by chunk_no) - 1)::bigint chunk_no, md5(piece) chunk_id
    from c where piece <> ''""",
)
def chunks_by_length(spark: Spark, sf: str) -> Rows:
    pieces = ingest.chunk_text(F.col("text"), 200, 2, "chars")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(pieces).alias("chunk_no", "piece"))
    return rows.select("conv_id", "turn", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("piece").alias("chunk_id"))


@query(
    "e3_payloads",
    f"with {chunks_sql()} select md5(text) chunk_id, article_id, source, url, author, headline, {stamp_sql('updated_at')} updated_at, len(text)::bigint size from chunks",
)
def payloads(spark: Spark, sf: str) -> Rows:
    rows = ingest.compute_chunks(ingest.to_documents(articles(spark, sf)), budget=BUDGET)
    return rows.select(
        "chunk_id", "article_id", "source", "url", "author", "headline",
        stamp("updated_at").alias("updated_at"), F.length("text").cast("bigint").alias("size"),
    )


@query(
    "e4_embeddings",
    f"""with {chunks_sql()}, b as (select md5(text) chunk_id, any_value({buckets_sql('text')}) b from chunks group by 1),
    v as (select chunk_id, {counts_sql('b')} v from b where len(b) > 0),
    n as (select chunk_id, unnest(v) x, generate_subscripts(v, 1) - 1 dim, sqrt(list_sum(list_transform(v, lambda y: y * y))) l from v)
    select chunk_id, dim::bigint dim, round(x / l, 6) weight from n where x > 0""",
)
def embeddings(spark: Spark, sf: str) -> Rows:
    stored = collection(spark, sf)
    return stored.select("chunk_id", F.posexplode("embedding").alias("dim", "w")).where("w > 0").select(
        "chunk_id", F.col("dim").cast("bigint").alias("dim"), r6("w").alias("weight")
    )


@query(
    "e6_query_vectors",
    f"""with q as (select item_id query_id, string_split({clean_sql('text')}, ' ') seg from benchmark),
    c as (select query_id, unnest(range(0, (len(seg) - 1) // 30 + 1)) part_no, seg from q),
    t as (select query_id, part_no, array_to_string(list_slice(seg, part_no * 30 + 1, (part_no + 1) * 30), ' ')
      || case when (part_no + 1) * 30 < len(seg) then ' ' else '' end chunk from c),
    v as (select query_id, part_no, chunk, {counts_sql('b')} v from (select *, {buckets_sql('chunk')} b from t) where chunk <> '')
    select query_id, part_no::bigint part_no, md5(chunk) chunk_id,
      round(list_max(v) / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) strongest from v""",
)
def query_vectors(spark: Spark, sf: str) -> Rows:
    rows = process_queries(questions(spark, sf), budget=32)
    return rows.select(
        "query_id", F.col("part_no").cast("bigint").alias("part_no"), F.md5("chunk").alias("chunk_id"), r6(F.array_max("embedding")).alias("strongest")
    )


@query(
    "a1_ingest_counters",
    f"with {chunks_sql()} select count(*) total_chunks, count(distinct md5(text)) unique_chunk_ids, count(text) total_payloads from chunks",
)
def ingest_counters(spark: Spark, sf: str) -> Rows:
    return ingest.ingest_counters(ingest.compute_chunks(ingest.to_documents(articles(spark, sf)), budget=BUDGET))


@query("a11_exact_duplicates", "select md5(text) content_id, min(doc_id) first_id, count(*) copies from documents group by 1")
def exact_duplicates(spark: Spark, sf: str) -> Rows:
    return ingest.exact_duplicates(table(spark, sf, "documents"), "text", "doc_id")


@query(
    "j7_positional_zip",
    """select vec_id, i, id, round(x, 6) x, piece from (
      select vec_id, unnest(range(0, n)) i, unnest(range(0, n)) + 100 id, unnest(list_slice(embedding, 1, n))::double x,
        list_transform(range(0, n), lambda k: 'p' || (k * 7 + vec_id)) pieces, unnest(pieces) piece
      from (select *, least(70 - label, 61 + label, len(embedding)) n from embeddings))""",
)
def positional_zip(spark: Spark, sf: str) -> Rows:
    """Whole vectors with as many ids and payloads, or a few more or less, as the row's label says."""
    ids = F.sequence(F.lit(100), F.lit(169) - F.col("label")).cast("array<bigint>")
    payloads_ = F.transform(F.sequence(F.lit(0), F.lit(60) + F.col("label")), lambda k: F.concat(F.lit("p"), (k * 7 + F.col("vec_id")).cast("string")))
    zipped = ingest.zip_points(ids, F.col("embedding"), payloads_)
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(zipped).alias("i", "z"))
    return rows.select(
        "vec_id", F.col("i").cast("bigint").alias("i"), "z.id", r6(F.col("z.vector").cast("double")).alias("x"), F.col("z.payload").alias("piece")
    )


@query(
    "k1_ingest_to_collection",
    f"with {chunks_sql()} select md5(text) chunk_id, max_by(article_id, (updated_at, article_id)) article_id from chunks where len({words_sql('text')}) > 0 group by 1",
)
def ingest_to_collection(spark: Spark, sf: str) -> Rows:
    from tidemark.sources.sinks import read_collection, upsert

    path = scratch(spark, "collection")
    order = ["updated_at", "article_id"]
    points, _ = ingest.ingest(articles(spark, sf), DIM, order=order, budget=BUDGET)
    upsert(points, path, 0, dim=DIM, order=order)
    return read_collection(spark, path).select("chunk_id", "article_id")
