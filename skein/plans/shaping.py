"""Catalogue, part 2: text, dates, URLs, JSON, classification, excerpts, summaries, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import jsonops as J
from ..functions import redact as R
from ..functions import text as T
from ..functions import urls as U
from ..operators import classify, excerpt, relops, render, summarize
from ..sources import html
from ..streaming import dedupe
from .catalogue import register
from .tables import read

L = "BIGINT"
WS = r"[\s\x1c-\x1f\x85\p{Z}]"


def sql_squish(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


# --- strings -----------------------------------------------------------------


@register("clean_text", "SELECT doc_id, " + sql_trim(r"regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\r\f\x0B]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.clean("text").alias("cleaned"))


@register("squish", f"SELECT doc_id, {sql_squish('text')} AS squished FROM documents")
def squish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.squish("text").alias("squished"))


@register("truncate", "SELECT doc_id, CASE WHEN length(text) > 220 THEN substr(text, 1, 220) || ' …' ELSE text END AS cut, substr(text, 1, 80) AS preview FROM documents")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.truncate("text", 220).alias("cut"), T.preview("text", 80).alias("preview"))


@register("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id", "html").select("page_id", T.html_escape("html").alias("escaped"))


@register("safe_name", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM pages")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.safe_name("url").alias("name"))


FENCE_SQL = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '```json' || chr(10) || text || chr(10) || '```' WHEN turn % 3 = 1 THEN '```' || chr(10) || text ELSE text END AS s FROM conversations"


@register("fence_strip", f"SELECT conv_id, turn, CASE WHEN starts_with(t, '```') THEN {sql_trim("regexp_replace(regexp_replace(CASE WHEN contains(t, chr(10)) THEN regexp_replace(t, '^[^\\n]*\\n', '') ELSE '' END, '[\\s\\p{Z}]+$', ''), '```$', '')")} ELSE t END AS bare FROM (SELECT conv_id, turn, {sql_trim('s')} AS t FROM ({FENCE_SQL}))")
def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    s = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```\n"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.unfence(s).alias("bare"))


@register("list_marker_strip", f"SELECT conv_id, turn, regexp_replace(CASE turn % 5 WHEN 0 THEN '- ' WHEN 1 THEN '-3.5% ' WHEN 2 THEN '• ' WHEN 3 THEN '12) ' ELSE '(3) ' END || text, '^(?:[-–—]+{WS}+|[•*·▪◦]+{WS}*|\\(?[0-9]{{1,2}}[.)]{WS}+)', '') AS bare FROM conversations")
def list_marker_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    k = F.col("turn") % 5
    mark = F.when(k == 0, "- ").when(k == 1, "-3.5% ").when(k == 2, "• ").when(k == 3, "12) ").otherwise("(3) ")
    return c.select("conv_id", "turn", T.strip_list_marker(F.concat(mark, "text")).alias("bare"))


@register(
    "file_names",
    "SELECT p_partkey AS id, regexp_replace(regexp_replace(regexp_replace(p_name || '.PDF (1.5 MB)', '[\\s]*[\\[(]?[\\s]*[0-9.,]+[\\s]*[KMGkmg]?[Bb][\\s]*[\\])]?[\\s]*$', ''), '^[\\s]+', ''), '[\\s]+$', '') AS name, CASE WHEN p_partkey % 2 = 0 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime FROM part",
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part", "p_partkey", "p_name")
    kind = T.mime(F.concat(F.lit("x"), F.when(F.col("p_partkey") % 2 == 0, ".PDF").otherwise(".zzz")))
    return p.select(F.col("p_partkey").alias("id"), T.strip_file_size(F.concat("p_name", F.lit(".PDF (1.5 MB)"))).alias("name"), kind.alias("mime"))


@register("labels", f"SELECT c_custkey AS id, CASE WHEN length(c_mktsegment) <= 6 THEN c_mktsegment ELSE '' END AS short, lower(regexp_replace(c_name, '{WS}+', '', 'g')) AS nav, CASE WHEN c_custkey % 4 > 0 THEN 'AI ' || (c_custkey % 4) || ' lines' ELSE '' END AS heading FROM customer")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    return c.select(F.col("c_custkey").alias("id"), T.short_label(F.concat("c_mktsegment", F.lit(" : "))).alias("short"), T.nav_key("c_name").alias("nav"), render.summary_label(F.col("c_custkey") % 4).alias("heading"))


@register("split_recipients", "SELECT n_nationkey AS id, array_to_string(list_filter(list_transform(regexp_split_to_array(n_name || ' ;, ' || n_name || ',x', '[,;]'), lambda v: trim(v)), lambda v: v <> ''), '|') AS names, array_to_string(list_distinct_ordered, '|') AS chain FROM (SELECT *, CASE WHEN n_name = 'x' THEN ['x'] ELSE [n_name, 'x'] END AS list_distinct_ordered FROM nation)")
def split_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    names = T.split_list(F.concat("n_name", F.lit(" ;, "), "n_name", F.lit(",x")))
    return n.select(F.col("n_nationkey").alias("id"), F.array_join(names, "|").alias("names"), F.array_join(F.array_distinct(names), "|").alias("chain"))


FLAT_SQL = r"regexp_replace(regexp_replace(coalesce(text, ''), '[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g'), '[\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g')"


@register("normalize_lines", f"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array({FLAT_SQL}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {sql_trim("regexp_replace(x, '[ \\t]+', ' ', 'g')")}), lambda x: x <> ''), '⏎') AS joined FROM documents")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.array_join(T.lines("text"), "⏎").alias("joined"))


@register("meaningful_text", "SELECT doc_id, regexp_matches(text, '[0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣ一-龥]') AS meaningful, regexp_matches(text, '^[\\s\\-=_~*|]+$') AS rule_line FROM documents")
def meaningful_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.meaningful("text").alias("meaningful"), F.col("text").rlike(r"^[\s\-=_~*|]+$").alias("rule_line"))


# --- dates -------------------------------------------------------------------

DATE_FORMS = "CASE o_orderkey % 5 WHEN 0 THEN '{y}-{m}-{d}' WHEN 1 THEN '{y}. {m}. {d}.' WHEN 2 THEN '{y}년 {m}월 {d}일' WHEN 3 THEN '{y}-02-30' ELSE '{y}-{m}-{d} ~ {y}-12-31' END"
YEAR = "(2000 + year(o_orderdate) % 30)"
PARTS_SQL = f"SELECT o_orderkey AS id, {YEAR}::VARCHAR AS y, lpad(month(o_orderdate)::VARCHAR, 2, '0') AS m, lpad(day(o_orderdate)::VARCHAR, 2, '0') AS d, o_orderkey % 5 AS k FROM orders"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    y = (F.lit(2000) + F.year("o_orderdate") % 30).cast("string")
    m, d = F.lpad(F.month("o_orderdate").cast("string"), 2, "0"), F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, "0")
    k = F.col("o_orderkey") % 5
    s = (
        F.when(k == 0, F.concat_ws("-", y, m, d))
        .when(k == 1, F.concat(y, F.lit(". "), m, F.lit(". "), d, F.lit(".")))
        .when(k == 2, F.concat(y, F.lit("년 "), m, F.lit("월 "), d, F.lit("일")))
        .when(k == 3, F.concat(y, F.lit("-02-30")))
        .otherwise(F.concat(y, m, d, F.lit(" ~ "), y, F.lit("1231")))
    )
    return o.select(F.col("o_orderkey").alias("id"), s.alias("s"))


@register("date_whole_value", f"SELECT id, CASE WHEN k IN (0, 1, 2) THEN y || '-' || m || '-' || d ELSE '' END AS iso FROM ({PARTS_SQL})")
def date_whole_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("id", D.whole_date("s").alias("iso"))


@register("date_in_text", f"SELECT id, CASE WHEN k = 3 THEN y || '-02-30' ELSE y || '-' || m || '-' || d END AS iso FROM ({PARTS_SQL})")
def date_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-checked only: the 30th of February stays."""
    return _dated(spark, sf_dir).select("id", D.date_inside("s").alias("iso"))


@register("row_date", f"SELECT id, CASE k WHEN 0 THEN y || '-' || m || '-' || d WHEN 3 THEN y || '-02-30' WHEN 4 THEN y || '-' || m || '-' || d ELSE '' END AS iso, k IN (0, 3, 4) AS leads FROM ({PARTS_SQL})")
def row_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _dated(spark, sf_dir)
    return s.select("id", D.row_date("s").alias("iso"), D.leads_with_date("s").alias("leads"))


@register("date_label_strip", f"SELECT id, CASE WHEN k IN (0, 1, 2) THEN y || '-' || m || '-' || d ELSE '' END AS iso FROM ({PARTS_SQL})")
def date_label_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels before every form, over all orders."""
    s = _dated(spark, sf_dir).withColumn("s", F.concat(F.lit("등록일자 : "), "s"))
    return s.select("id", D.whole_date(D.strip_label("s", ["등록일", "등록일자", "게시일"])).alias("iso"))


@register("epoch_ms_iso", "SELECT event_id, strftime(make_timestamp((event_id * 86400017)::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(((event_id * 86400017) % 1000)::VARCHAR, 3, '0') || 'Z' AS iso FROM events")
def epoch_ms_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For ids from 0 on; below, the SQL's milliseconds would have a sign of their own."""
    return read(spark, sf_dir, "events", "event_id").select("event_id", D.epoch_ms_iso(F.col("event_id") * 86400017).alias("iso"))


# --- URLs --------------------------------------------------------------------

LISTED_SQL = "SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'https://b.test/board/view?nttId=' || page_id || '&page=2' WHEN 1 THEN 'https://b.test/board/' || (1000 + page_id) || '/' WHEN 2 THEN 'https://b.test/other?nttId=5' ELSE 'https://b.test/x/down?file=a%20' || page_id || '.pdf&examMgmtNo=' || CASE WHEN page_id % 8 = 3 THEN page_id::VARCHAR ELSE '' END || '&emOpenSeq=7' END AS made FROM pages"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    made = (
        F.when(i % 4 == 0, F.concat(F.lit("https://b.test/board/view?nttId="), i, F.lit("&page=2")))
        .when(i % 4 == 1, F.concat(F.lit("https://b.test/board/"), i + 1000, F.lit("/")))
        .when(i % 4 == 2, F.lit("https://b.test/other?nttId=5"))
        .otherwise(F.concat(F.lit("https://b.test/x/down?file=a%20"), i, F.lit(".pdf&examMgmtNo="), F.when(i % 8 == 3, i.cast("string")).otherwise(""), F.lit("&emOpenSeq=7")))
    )
    return read(spark, sf_dir, "pages", "page_id", "url").withColumn("made", made)


@register("url_param", "SELECT page_id, regexp_extract(made, '[?&]nttId=([^&#]*)', 1) AS ntt, regexp_extract(made, '(?i)[?&]EMOPENSEQ=([^&#]*)', 1) AS seq, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM (" + LISTED_SQL + ")")
def url_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).select("page_id", U.param("made", "nttId").alias("ntt"), U.param("made", "EMOPENSEQ", True).alias("seq"), U.part("url", "HOST").alias("host"))


@register(
    "url_id",
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'nttId:' || page_id WHEN 1 THEN 'path:' || (1000 + page_id) ELSE '' END AS board, CASE page_id % 4 WHEN 0 THEN 'nttId:' || page_id WHEN 1 THEN 'url:/board/' || (1000 + page_id) || '/' WHEN 2 THEN 'nttId:5' ELSE CASE WHEN page_id % 8 = 3 THEN 'exam:' || page_id || '_7' ELSE 'file:a ' || page_id || '.pdf' END END AS file FROM pages",
)
def url_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _listed(spark, sf_dir)
    board = U.board_id("made", "/board/", ("noticeId", "no", "idx", "seq", "bbsId", "nttId", "boardId"))
    return u.select("page_id", board.alias("board"), U.file_id("made", ("nttId", "seqno", "lrgSlno"), ("examMgmtNo", "emOpenSeq")).alias("file"))


@register("canonical_url", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://b.test/now?id=' || page_id WHEN 1 THEN 'https://b.test/now?id=' || page_id ELSE url END AS canonical FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages", "page_id", "url")
    link = F.when(F.col("page_id") % 3 == 0, F.lit(" javascript:void(0)")).when(F.col("page_id") % 3 == 1, F.lit("https://B.test/old/Detail.do?x=1")).otherwise(F.col("url"))
    return p.select("page_id", U.canonical(link, F.col("page_id").cast("string"), "b.test", ["/old/detail.do"], ("https://b.test/now?id=", "")).alias("canonical"))


@register("stable_hash_id", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'dataIdx:' || page_id ELSE 'h:' || substr(md5(url || '|' || length(html)), 1, 16) END AS id FROM pages")
def stable_hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages", "page_id", "url", "html")
    fields = {"dataIdx": F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")), "seq": F.lit("")}
    return p.select("page_id", U.field_id(fields, F.col("url"), F.length("html").cast("string")).alias("id"))


@register("page_url_rewrite", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://b.test/l?a=1&page=9&a=2#f' ELSE 'https://b.test/l?a=2&page=' || (page_id % 3 + 1) || '#f' END AS next FROM pages")
def page_url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id").select("page_id", U.page_url(F.lit("https://b.test/l?a=1&page=9&a=2#f"), "page", (F.col("page_id") % 3 + 1).cast("int")).alias("next"))


@register("resolve_links", "SELECT page_id, 'https://b.test/a/' || page_id AS rel, 'https://b.test/' || page_id AS root, 'https://c.test/' || page_id AS scheme FROM pages")
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, i = F.lit("https://b.test/a/b?q=1"), F.col("page_id").cast("string")
    at = lambda prefix: U.resolve_simple(base, F.concat(F.lit(prefix), i))
    return read(spark, sf_dir, "pages", "page_id").select("page_id", at("").alias("rel"), at("/").alias("root"), at("//c.test/").alias("scheme"))


@register("dispatch_url", "SELECT s_suppkey AS id, 'https://api.test/repos/' || replace(replace(s_name, '#', '%23'), ' ', '%20') || '/w%20f' AS url FROM supplier")
def dispatch_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(F.col("s_suppkey").alias("id"), U.dispatch_url("https://api.test/repos/", F.col("s_name"), F.lit("w f")).alias("url"))


# --- redaction ---------------------------------------------------------------


@register("redact_values", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)JSESSIONID=[^;\"''\\s&?]+', 'REDACTED', 'g'), '(?i)WMONID=[^;\"''\\s&?]+', 'REDACTED', 'g'), '(?i)\\b[0-9a-f]{32,}\\b', 'REDACTED', 'g'), '\\b[0-9]{6}-[1-4][0-9]{6}\\b', 'REDACTED', 'g'), '\\b01[016789]-?[0-9]{3,4}-?[0-9]{4}\\b', 'REDACTED', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', 'REDACTED', 'g') AS redacted FROM documents")
def redact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", R.redact_values("text").alias("redacted"))


@register("redact_url_params", "SELECT page_id, 'https://b.test/p?csrfToken=REDACTED&billId=' || page_id || '&q=REDACTED&flag#s' AS redacted FROM pages")
def redact_url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    u = F.concat(F.lit("https://b.test/p?csrfToken=a-b-"), i, F.lit("&billId="), i, F.lit("&q="), F.md5(i), F.lit("&flag#s"))
    return read(spark, sf_dir, "pages", "page_id").select("page_id", U.redact_params(u, R.HINTS, R.PUBLIC).alias("redacted"))


@register("redact_headers_map", "SELECT user_id, event_id, 'Age=' || user_id || ';Authorization=REDACTED;X-Csrf=REDACTED;X-Type=' || event_type AS headers FROM events")
def redact_headers_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    m = R.redact_map(F.create_map(F.lit("X-Type"), F.col("event_type"), F.lit("Authorization"), F.lit("Bearer x"), F.lit("X-Csrf"), F.lit("y"), F.lit("Age"), F.col("user_id").cast("string")))
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return e.select("user_id", "event_id", F.array_join(pairs, ";").alias("headers"))


@register("redact_html")
def redact_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(page):
        return page.map(lambda p: html.redact_page(p, R.HINTS))

    return read(spark, sf_dir, "pages", "page_id", "html").select("page_id", run("html").alias("redacted"))


# --- HTML --------------------------------------------------------------------


@register("html_title_links", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), '|') AS hrefs FROM pages""")
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.array_join(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), "|").alias("hrefs"))


@register("html_strip_text")
def html_strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id", "html").select("page_id", html.text_of("html").alias("text"))


@register("html_link_rows")
def html_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.explode_rows(read(spark, sf_dir, "pages", "page_id", "url", "html"), "html", "url", "links", "page_id")


@register("link_predicates", "SELECT page_id, page_id % 3 = 0 AS usable, page_id % 3 = 0 AND page_id % 2 = 0 AS file FROM pages")
def link_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    href = F.when(i % 3 == 0, F.when(i % 2 == 0, "/x/GetFile?id=1").otherwise("/view?id=1")).when(i % 3 == 1, " JavaScript:go()").otherwise("")
    return read(spark, sf_dir, "pages", "page_id").select("page_id", U.usable(href).alias("usable"), U.file_link(href, ("getfile", "filedown")).alias("file"))


@register(
    "js_report_context",
    r"""WITH s AS (SELECT page_id, regexp_split_to_array(replace(html, '>', '>' || chr(10)), '\n') AS l FROM pages), x AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS line, l FROM s), h AS (SELECT page_id, line::BIGINT AS line, l FROM x WHERE contains(l[line], 'track('))
    SELECT page_id, line, array_to_string(l[greatest(1, line - 1):least(len(l), line + 1)], chr(10)) AS context, count(*) OVER (PARTITION BY page_id)::BIGINT AS hits FROM h""",
)
def js_report_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a pattern, with one line around each, and the hits of the page."""
    p = read(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.split(F.replace(F.col("html"), F.lit(">"), F.lit(">\n")), "\n", -1).alias("l"))
    n = F.size("l")
    found = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("l", i).contains("track("))
    p = p.select("page_id", "l", F.size(found).cast("long").alias("hits"), F.explode(found).alias("line"))
    lo = F.greatest(F.lit(1), F.col("line") - 1)
    return p.select("page_id", F.col("line").cast("long").alias("line"), F.array_join(F.slice("l", lo, F.least(n, F.col("line") + 1) - lo + 1), "\n").alias("context"), "hits")


# --- JSON --------------------------------------------------------------------


@register("json_first_nonempty", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x' || event_id END, ''), json_extract_string(props, '$.k'), '') AS picked FROM events")
def json_first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id", "props")
    j = F.concat(F.lit('{"name":"'), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string"))), F.lit('",'), F.expr("substring(props, 2)"))
    return e.select("event_id", J.pick(j, ["gone", "name", "k"]).alias("picked"))


@register("json_envelope_rows", "SELECT event_id, r::BIGINT AS pos, CASE WHEN event_id % 3 = 2 THEN 'flat' ELSE 'b' || r END AS bill FROM events, range(0, 2) t(r) WHERE CASE event_id % 3 WHEN 0 THEN r < 2 WHEN 1 THEN false ELSE r < 1 END")
def json_envelope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    j = F.when(k == 0, '{"svc":[{"head":[{"list_total_count":2}]},{"row":[{"BILL_ID":"b0"},{"BILL_ID":"b1"}]}]}').when(k == 1, '{"RESULT":{"CODE":"INFO-200"}}').otherwise('{"row":[{"BILL_ID":"flat"}]}')
    rows = read(spark, sf_dir, "events", "event_id").select("event_id", F.posexplode(J.envelope_rows(j)).alias("pos", "r"))
    return rows.select("event_id", F.col("pos").cast("long").alias("pos"), F.col("r")["BILL_ID"].alias("bill"))


@register("json_records", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END::BIGINT AS n FROM events")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    j = F.when(k == 0, '{"data":[{"a":1},{"a":2}]}').when(k == 1, '{"x":1,"resultList":[{"a":1}]}').when(k == 2, "[1,2,3]").otherwise('{"a":1}')
    return read(spark, sf_dir, "events", "event_id").select("event_id", F.size(J.records(j)).cast("long").alias("n"))


@register("result_code_policy", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'INFO-000' WHEN 1 THEN 'ERROR-290' ELSE '' END AS code, event_id % 3 <> 1 AS ok FROM events")
def result_code_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    j = F.when(k == 0, '{"svc":[{"head":[{"RESULT":{"CODE":"INFO-000","MESSAGE":"ok"}}]}]}').when(k == 1, '{"RESULT":{"MESSAGE":"m","CODE":"ERROR-290"}}').otherwise('{"row":[]}')
    e = read(spark, sf_dir, "events", "event_id").select("event_id", J.result_code(j).alias("code"))
    return e.select("event_id", "code", J.result_ok(F.col("code")).alias("ok"))


@register(
    "response_gate",
    "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CASE WHEN trim(text) = '' THEN 'EMPTY' ELSE 'OK' END WHEN 1 THEN 'SPLIT' WHEN 2 THEN 'FAILED' ELSE 'EMPTY' END AS gate, CASE WHEN turn % 4 = 3 THEN '' ELSE " + sql_trim("text") + " END AS said FROM conversations",
)
def response_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    k = F.col("turn") % 4
    reason = F.when(k == 1, "MAX_TOKENS").when(k == 2, "SAFETY").otherwise("STOP")
    part = F.struct(F.when(k == 3, F.lit(" ")).otherwise(F.col("text")).alias("text"))
    j = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part).alias("parts")).alias("content"), reason.alias("finishReason"))).alias("candidates")))
    return c.select("conv_id", "turn", J.gate(j).alias("gate"), J.response_text(j).alias("said"))


@register("body_shape", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'json:k' WHEN 2 THEN 'form:a,b' ELSE 'raw:5' END AS shape FROM events")
def body_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    body = F.when(k == 0, "").when(k == 1, F.col("props")).when(k == 2, "b=1&a=").otherwise("hello")
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", J.body_shape(body).alias("shape"))


# --- classification ----------------------------------------------------------

PROBE_SQL = "SELECT page_id, page_id % 2 = 0 AS has_pre, (page_id * 7 % 40)::INT AS pre_len, page_id % 3 <> 0 AS has_section, page_id % 5 = 0 AS has_marker, page_id % 4 = 0 AS broken FROM pages"


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    gone = F.when(i % 4 == 0, F.array(F.lit("shell"))).otherwise(F.expr("cast(array() as array<string>)"))
    return read(spark, sf_dir, "pages", "page_id").select("page_id", classify.followup_probe(i % 2 == 0, (i * 7 % 40).cast("int"), i % 3 != 0, i % 5 == 0, gone).alias("probe"))


PROBED = f"SELECT page_id, CASE WHEN has_pre AND has_section AND pre_len >= 20 THEN 'FOUND' WHEN NOT has_pre AND NOT has_section AND NOT has_marker AND NOT broken THEN 'EMPTY' ELSE 'UNEXPECTED' END AS probe FROM ({PROBE_SQL})"


@register("billinfo_decision", PROBED)
def billinfo_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir)


IDENTITY_SQL = "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'MISMATCH' WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'UNCONFIRMED' ELSE 'CONFIRMED' END AS identity FROM pages"


def _identity(i):
    form = F.when(i % 3 == 0, "").otherwise(i.cast("string"))
    asked = F.when(i % 2 == 0, "").otherwise(i.cast("string"))
    final = F.when(i % 7 == 0, "other")
    return classify.identity(i.cast("string"), form, asked, final)


@register("identity_check", IDENTITY_SQL)
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id").select("page_id", _identity(F.col("page_id")).alias("identity"))


@register(
    "status_machine",
    f"WITH p AS ({PROBED}), i AS ({IDENTITY_SQL}) SELECT page_id, CASE WHEN page_id % 11 = 0 OR identity = 'MISMATCH' THEN 'ERROR' WHEN page_id % 13 = 0 THEN CASE WHEN identity = 'CONFIRMED' THEN 'AVAILABLE' ELSE 'ERROR' END WHEN page_id % 17 = 0 THEN 'ERROR' WHEN probe = 'FOUND' THEN 'AVAILABLE' WHEN probe = 'EMPTY' THEN 'PENDING' ELSE 'ERROR' END AS status FROM p JOIN i USING (page_id)",
)
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    inline = F.when(i % 13 == 0, "FOUND").otherwise("MISSING")
    return _probe(spark, sf_dir).select("page_id", classify.status(i % 11 == 0, _identity(i), inline, i % 17 != 0, F.lit(False), F.col("probe")).alias("status"))


@register("not_found_page", "SELECT page_id, contains(regexp_replace(html, '[\\s\\p{Z}]+', '', 'g'), 'track(8)') AS gone FROM pages")
def not_found_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id", "html").select("page_id", classify.not_found(F.col("html"), ["track(8)"]).alias("gone"))


@register("details_all_or_nothing", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'institution=' || o_custkey || ';status=' || o_orderstatus END AS details FROM orders")
def details_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    rows = classify.all_or_none(["institution", "status"], [F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")), F.col("o_orderstatus")])
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(F.transform(rows, lambda r: F.concat_ws("=", r["label"], r["value"])), ";").alias("details"))


@register("block_precedence", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'details' WHEN c_custkey % 5 = 1 THEN 'summary' WHEN c_custkey % 3 = 0 THEN 'body' WHEN c_custkey % 2 = 0 THEN 'pending' ELSE 'none' END AS block FROM customer")
def block_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)"))
    return read(spark, sf_dir, "customer", "c_custkey").select(i.alias("id"), classify.block(some(i % 5 == 0), some(i % 5 == 1), F.when(i % 3 == 0, "b").otherwise(" "), i % 2 == 0).alias("block"))


@register("valid_lines", f"SELECT conv_id, list_count(l) = 2 AND list_bool_and(list_transform(l, lambda x: coalesce(regexp_matches(x, '[0-9A-Za-z가-힣一-龥]') AND length({sql_squish('x')}) <= 200, false))) AS valid FROM (SELECT conv_id, list(text ORDER BY turn, text) AS l FROM conversations GROUP BY 1)".replace("list_count(l)", "len(l)"))
def valid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return g.select("conv_id", classify.valid_lines(F.transform("l", lambda x: x["text"]), 2, 200).alias("valid"))


@register("model_unavailable", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 400 ELSE 403 END::BIGINT AS code, event_id % 5 = 0 OR (event_id % 5 = 3 AND event_id % 2 = 0) AS gone, event_id % 5 IN (1, 2) AS again FROM events")
def model_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    e = read(spark, sf_dir, "events", "event_id").withColumn("code", F.when(k == 0, 404).when(k == 1, 429).when(k == 2, 500).when(k == 3, 400).otherwise(403).cast("long"))
    said = F.when(F.col("event_id") % 2 == 0, "Model is NOT FOUND").otherwise("bad field")
    return e.select("event_id", "code", classify.model_gone(F.col("code"), F.lit(""), said, ["not found", "deprecated"]).alias("gone"), classify.retryable(F.col("code")).alias("again"))


# --- excerpts, summaries, streams --------------------------------------------


@register("excerpt_lite", f"SELECT doc_id, CASE WHEN length(s) > 220 THEN substr(s, 1, 220) || ' …' ELSE s END AS excerpt FROM (SELECT doc_id, {sql_squish("array_to_string(CASE WHEN f = 0 THEN l ELSE l[f:len(l) - list_position(list_reverse(list_transform(l, lambda x: NOT regexp_matches(x, '^[\\s\\-=_~*|]+$'))), true) + 1] END, ' ')")} AS s FROM (SELECT doc_id, l, coalesce(list_position(list_transform(l, lambda x: NOT regexp_matches(x, '^[\\s\\-=_~*|]+$')), true), 0) AS f FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda x: {sql_trim("regexp_replace(x, '[ \\t]+', ' ', 'g')")}), lambda x: x <> '') AS l FROM documents)))")
def excerpt_lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", excerpt.excerpt_lite("text").alias("excerpt"))


@register("excerpt_full")
def excerpt_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = excerpt.excerpt_udf()
    d = read(spark, sf_dir, "documents", "doc_id", "text").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), run("text", F.substring_index("text", "\n", 1)).alias("excerpt"))
    p = read(spark, sf_dir, "pages", "page_id", "url", "html").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), run("html", "url").alias("excerpt"))
    return d.unionByName(p)


def _summaries(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    d = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return summarize.summarise(d, summarize.stub, by="source", order="doc_id", id_col="doc_id", text_col="text", least=200, batch_rows=rows)


@register("summarize_stub_single")
def summarize_stub_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir, 1)


@register("summarize_stub_batch")
def summarize_stub_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir, 25)


def _digest(d: DataFrame) -> DataFrame:
    i = F.col("doc_id").cast("string")
    cards = d.select(F.col("source").alias("source_key"), "doc_id", render.card(i, F.concat(F.lit("/d/"), i), F.lit(""), F.lit("body"), F.col("n_chars").cast("string")).alias("card"))
    return render.html_blocks(cards, "source_key", "doc_id", "card")


@register("digest_html", "SELECT source AS source_key, '<h2>' || source || ' (' || count(*) || ')</h2><ul>' || string_agg('<li><a href=\"/d/' || doc_id || '\">' || doc_id || '</a> <span></span><div class=\"body\">' || n_chars || '</div></li>', '' ORDER BY doc_id) || '</ul>' AS block FROM documents GROUP BY 1")
def digest_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document."""
    return _digest(read(spark, sf_dir, "documents", "doc_id", "source", "n_chars"))


@register("stream_seen_dedupe", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each (type, user), found by a stream in one available-now run."""
    return dedupe.first_seen_stream(spark, f"{sf_dir}/events.parquet", ["event_type", "user_id"], "event_id")
