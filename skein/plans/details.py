"""Catalogue, part 3: detail pages, posting dates, JSON lists, model calls, reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonops as J
from ..functions import redact as R
from ..functions import urls as U
from ..operators import details, model_client
from ..sources import html, json_lists, post_dates
from .catalogue import register
from .tables import read

#: A date of this century from an order's.
DAY_SQL = "strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d')"


def _day() -> Column:
    return F.date_format(F.add_months("o_orderdate", 240), "yyyy-MM-dd")


def _text(*parts: Column | str) -> Column:
    """Texts and columns, end to end."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- posting dates ------------------------------------------------------------


@register(
    "posting_date",
    f"SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 5 THEN '' ELSE {DAY_SQL} END AS posted FROM orders",
)
def posting_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date label beside a period; a plain label within a period and a time
    element; a class; a label after an event's time element; a date beside a
    file's; a period alone."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    k, d = F.col("o_orderkey") % 6, _day()
    start = '<div class="view-head"><p class="subject">제출 기한 2030-01-01</p>'
    page = (
        F.when(k == 0, _text(start, "<div><span>예고기간</span><span>2026-01-01 ~ 2026-02-01</span></div><dl><dt>등록일시 :</dt><dd>", d, "</dd></dl></div>"))
        .when(k == 1, _text(start, "<div><p>예고기간</p><b>일자</b> 2031-01-01</div><time datetime='", d, "T09:30:00'>today</time></div>"))
        .when(k == 2, _text(start, "<span class='file'>2025-01-01</span><em class='reg_date'>등록일 : ", F.replace(d, F.lit("-"), F.lit(".")), "</em></div>"))
        .when(k == 3, _text(start, "<p>회의일</p><time>2031-01-01</time><div><strong>작성일자 :</strong> ", d, " <i>x</i></div></div>"))
        .when(k == 4, _text(start, "<ul class='atch-file'><li class='date'>2031-01-01</li></ul><div class='day'>", d, "</div></div>"))
        .otherwise(F.lit(start + "<div class='date'>2026-01-01 ~ 2026-02-01</div><div><span>접수일</span><time>2026-03-01</time></div></div>"))
    )
    found = post_dates.candidates_udf(post_dates.DETAIL_SCOPES)(page)
    return o.select(F.col("o_orderkey").alias("id"), post_dates.posting_date(found).alias("posted"))


@register("period_text", "SELECT conv_id, turn, contains(text, '~') OR turn % 3 = 1 AS period FROM conversations")
def period_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    said = F.when(F.col("turn") % 3 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(" 예고기간"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", post_dates.period_text(said).alias("period"))


@register("label_sets", "SELECT n_nationkey AS id, array_to_string(list_sort(list_distinct([n_name, 'A', 'B' || n_regionkey, 'A'])), ',') AS labels FROM nation")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    both = post_dates.label_union(F.array("n_name", F.lit("A")), F.array(_text("B", F.col("n_regionkey")), F.lit("A")))
    return n.select(F.col("n_nationkey").alias("id"), F.array_join(both, ",").alias("labels"))


# --- detail scans ---------------------------------------------------------------


def _posts(o: DataFrame, url: Column, date: Column, files: Column) -> DataFrame:
    return o.select(F.col("o_orderkey").alias("id"), url.alias("url"), _text("Order ", F.col("o_custkey")).alias("title"), date.alias("date"), files.alias("files"))


_NO_FILES = "cast(array() as array<struct<name:string,url:string>>)"


def _told(df: DataFrame) -> DataFrame:
    """A scan's columns as text."""
    pairs = F.array_join(F.transform("details", lambda x: F.concat_ws("=", x["label"], x["value"])), ";")
    names = F.array_join(F.transform("files", lambda x: F.concat_ws("=", x["name"], x["url"])), ";")
    return df.select("id", "body", "date", pairs.alias("details"), names.alias("files"), "found")


@register(
    "detail_scan",
    f"""SELECT o_orderkey AS id, CASE k WHEN 3 THEN '' WHEN 2 THEN 'Status ' || o_orderstatus ELSE o_orderpriority || chr(10) || o_custkey END AS body,
    CASE k WHEN 0 THEN {DAY_SQL} WHEN 1 THEN '2020-02-02' ELSE '' END AS date, '' AS details, '' AS files, k <> 3 AS found FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""",
)
def detail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body by the first selector that finds one; the date only where the list had none; no page at all."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    k, url = F.col("o_orderkey") % 4, _text("https://b.test/v?nttId=", F.col("o_orderkey"))
    page = F.when(
        k < 2,
        _text("<div id=content>menu</div><div class='board-view-wrap'><div class='header'><dl><dt>등록일</dt><dd>", _day(), "</dd></dl></div><div class='body'><p>", F.col("o_orderpriority"), "</p><p>", F.col("o_custkey"), "</p></div></div>"),
    ).when(k == 2, _text("<div id=content class='x y'>Status <b>", F.col("o_orderstatus"), "</b></div><div class=date>", _day(), "</div>"))
    pages = o.select(url.alias("url"), page.alias("html")).where("html IS NOT NULL")
    posts = _posts(o, url, F.when(k == 1, "2020-02-02").otherwise(""), F.expr(_NO_FILES))
    out = details.detail_scan(posts, pages, details.DetailRules())
    return _told(out.withColumn("body", F.regexp_replace("body", r"\s*\n\s*", "\n"))).withColumn("body", F.when(k_of("id") == 2, F.replace("body", F.lit("\n"), F.lit(" "))).otherwise(F.col("body")))


def k_of(name: str) -> Column:
    return F.col(name) % 4


@register(
    "detail_scan_records",
    f"""SELECT o_orderkey AS id, CASE WHEN k = 2 THEN 'no table' ELSE '' END AS body, CASE WHEN k = 0 THEN '' ELSE {DAY_SQL} END AS date,
    CASE k WHEN 1 THEN '금융기관명=Order ' || o_custkey || ';제재조치일=' || {DAY_SQL} || ';관련부서=' || o_orderpriority ELSE '' END AS details,
    CASE k WHEN 0 THEN 'fileDown?no=' || o_orderkey || '=https://b.test/fileDown?no=' || o_orderkey
           WHEN 1 THEN 'a.pdf=https://b.test/x/getFile?f=' || o_orderkey || ';b.hwp=https://b.test/x/getFile?g=' || o_orderkey ELSE '' END AS files, true AS found
    FROM (SELECT *, o_orderkey % 3 AS k FROM orders)""",
)
def detail_scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post that is a file; one with all labels, whose page has a known and a new file; one without."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey")
    url = F.when(k == 0, _text("https://b.test/fileDown?no=", key)).otherwise(_text("https://b.test/x/v?id=", key))
    table = _text("<table><tr><th>금융 기관명</th><td></td></tr><tr><th>관련부서</th><td>", F.col("o_orderpriority"), "</td></tr></table><div class=view-cont>text</div><a href='getFile?f=", key, "' title='old'>a</a><a href='/x/getFile?g=", key, "' title='b.hwp'>b</a>")
    page = F.when(k == 1, table).when(k == 2, F.lit("<div class=view-cont>no table</div><a href='/list'>list</a>"))
    pages = o.select(url.alias("url"), page.alias("html")).where("html IS NOT NULL")
    have = F.when(k == 1, F.array(F.struct(F.lit("a.pdf").alias("name"), _text("https://b.test/x/getFile?f=", key).alias("url")))).otherwise(F.expr(_NO_FILES))
    rules = details.DetailRules(bodies=(".view-cont", "#content"), direct=("hpdownload", "filedown", "getfile"), labels=("금융기관명", "제재조치일", "관련부서"), titled="금융기관명", dated="제재조치일")
    return _told(details.detail_scan(_posts(o, url, F.when(k == 0, "").otherwise(_day()), have), pages, rules))


# --- JSON lists -------------------------------------------------------------------


@register("offset_list_requests", "SELECT n_nationkey AS id, (n_nationkey - 1) * 30 * (n_nationkey > 1)::INT AS start_, '30' AS length_ FROM nation")
def offset_list_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = json_lists.offset_form(F.col("n_nationkey"), 30)
    return read(spark, sf_dir, "nation", "n_nationkey").select(F.col("n_nationkey").alias("id"), form["start"].cast("int").alias("start_"), form["length"].alias("length_"))


@register(
    "offset_list_rows",
    """SELECT page, id, title, date FROM (
        SELECT o_orderkey // 50 AS page, 'i' || o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '[' || o_orderstatus || '] ' ELSE '' END || o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS date,
               row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) AS k
        FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey // 50, o_custkey ORDER BY o_orderkey) AS first FROM orders) WHERE first = 1
    ) WHERE k <= 20""",
)
def offset_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of 50 records, some with the same id; 20 of a page are wanted."""
    o = read(spark, sf_dir, "orders")
    page = F.floor(F.col("o_orderkey") / 50).alias("page")
    kind = F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit("(2014이전)"))).otherwise("")
    record = F.struct("o_orderkey", _text("i", F.col("o_custkey")).alias("dataIdx"), F.col("o_orderpriority").alias("title"), kind.alias("pastreqType"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("replyRegDate"))
    answers = o.groupBy(page).agg(F.to_json(F.struct(F.array_sort(F.collect_list(record)).alias("resultList"))).alias("body"))
    return json_lists.offset_rows(answers, ["page"], "body", 20, id_names=["gone", "dataIdx"]).select("page", "id", "title", "date")


@register(
    "index_list_rows",
    """SELECT l_orderkey // 20 AS page, 'B' || l_orderkey AS id, 'Bill ' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN ' (S' || l_suppkey || ')' ELSE '' END AS title, strftime(l_shipdate, '%Y-%m-%d') AS date
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1 AND (l_orderkey // 20) % 7 <> 3""",
)
def index_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in an envelope; those of some pages say that there is no data, and one is missing."""
    x = read(spark, sf_dir, "lineitem")
    page = F.floor(F.col("l_orderkey") / 20).alias("page")
    row = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _text("B", F.col("l_orderkey")).alias("BILL_ID"), _text("Bill ", F.col("l_partkey")).alias("BILL_NAME"), F.when(F.col("l_linenumber") % 2 == 0, _text("S", F.col("l_suppkey"))).otherwise("").alias("PROPOSER"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("PROPOSE_DT"))
    rows = F.to_json(F.array_sort(F.collect_list(row)))
    answers = x.groupBy(page).agg(rows.alias("rows"))
    full = _text('{"svc":[{"head":[{"list_total_count":1},{"RESULT":{"CODE":"INFO-000","MESSAGE":"ok"}}]},{"row":', F.col("rows"), "}]}")
    body = F.when(F.col("page") % 7 == 3, F.when(F.col("page") % 2 == 0, '{"RESULT":{"CODE":"INFO-200","MESSAGE":"none"}}')).otherwise(full)
    return json_lists.index_rows(answers.select("page", body.alias("body")), ["page"], "body").select("page", "id", "title", "date")


# --- JSON, scripts, forms, redaction ---------------------------------------------------


@register("key_listing", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a,k,z' WHEN 1 THEN '' ELSE 'k' END AS keys, CASE event_id % 3 WHEN 0 THEN '["a","k","z"]' WHEN 1 THEN '[]' ELSE '["k"]' END AS names FROM events""")
def key_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events", "event_id", "props"), F.col("event_id") % 3
    body = F.when(k == 0, _text('{"z":1,', F.expr("substring(props, 2, length(props) - 2)"), ',"a":null}')).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return e.select("event_id", J.key_listing(body).alias("keys"), J.names_only(body).alias("names"))


@register("error_fields", "SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN 'S' || conv_id ELSE '' END AS status, CASE turn % 2 WHEN 0 THEN role ELSE substr('x' || text, 1, 200) END AS message FROM conversations")
def error_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    body = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.struct(_text("S", F.col("conv_id")).alias("status"), F.col("role").alias("message")).alias("error")))).otherwise(F.concat(F.lit("x"), "text"))
    return c.withColumn("e", J.error_fields(body)).select("conv_id", "turn", "e.status", "e.message")


@register("response_metadata", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'html_url=h;workflow_run_id=' || user_id WHEN 1 THEN 'run_url=' || event_type ELSE '' END AS kept FROM events")
def response_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events", "event_id", "user_id", "event_type"), F.col("event_id") % 3
    body = F.when(k == 0, _text('{"workflow_run_id":', F.col("user_id"), ',"html_url":"h","token":"t"}')).when(k == 1, _text('{"run_url":"', F.col("event_type"), '"}')).otherwise("[1]")
    pairs = F.array_sort(F.transform(F.map_entries(J.metadata(body)), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return e.select("event_id", F.array_join(pairs, ";").alias("kept"))


@register("body_kind", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'json' ELSE 'html' END AS kind FROM pages")
def body_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "pages", "page_id", "html"), F.col("page_id") % 4
    body = F.when(k == 0, _text("  {", F.col("page_id"), "}")).otherwise(F.coalesce("html", F.lit("")))
    return p.select("page_id", J.body_kind(body, F.when(k == 1, "application/JSON").when(k == 2, "text/plain")).alias("kind"))


@register("script_endpoints", "SELECT page_id, '/a.do,/b/' || page_id || '.do' AS endpoints FROM pages")
def script_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    js = _text("var u='/b/", i, ".do';post(\"/a.do?x=1\");get('/a.do');t='/c/", i, ".doc'")
    return read(spark, sf_dir, "pages", "page_id").select("page_id", F.array_join(U.script_endpoints(js), ",").alias("endpoints"))


@register("form_lookup", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'f' || c_nationkey END AS form, c_name || ' ' || c_mktsegment AS longest FROM customer")
def form_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def form(page: pd.Series) -> pd.Series:
        return page.map(lambda p: html.form_with(p, "billId"))

    @F.pandas_udf("string")
    def longest(page: pd.Series) -> pd.Series:
        return page.map(html.longest_text)

    c = read(spark, sf_dir, "customer")
    field = F.when(F.col("c_custkey") % 3 == 0, "other").otherwise("billId")
    page = _text("<form id=x><input name=q></form><form id='f", F.col("c_nationkey"), "'><input type=hidden name=", field, " value=1></form><pre>", F.col("c_name"), " ", F.col("c_mktsegment"), "</pre><p>short</p>")
    return c.select(F.col("c_custkey").alias("id"), form(page).alias("form"), longest(page).alias("longest"))


@register(
    "redact_urls_in_text",
    """SELECT page_id, 'failed https://b.test/p?csrfToken=REDACTED&billId=' || page_id || ' then http://c.test/q, mail REDACTED' AS said,
    CASE page_id % 3 WHEN 0 THEN '/p?token=REDACTED&n=' || page_id WHEN 1 THEN '#' ELSE '/s;REDACTED' END AS attribute FROM pages""",
)
def redact_urls_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("page_id"), F.col("page_id") % 3
    said = _text("failed https://b.test/p?csrfToken=a-", i, "&billId=", i, " then http://c.test/q, mail a@b.test")
    attribute = F.when(k == 0, _text("/p?token=", i, "&n=", i)).when(k == 1, "#").otherwise(_text("/s;JSESSIONID=x", i))
    return read(spark, sf_dir, "pages", "page_id").select("page_id", U.redact_free_text(said, R.HINTS, R.PUBLIC).alias("said"), U.redact_attribute(attribute, R.HINTS, R.PUBLIC).alias("attribute"))


# --- reports ------------------------------------------------------------------------


@register("run_errors", "SELECT user_id, string_agg('e' || event_id, '; ' ORDER BY event_id) AS errors FROM events WHERE event_type = 'error' GROUP BY 1")
def run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's errors in one line."""
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.expr("listagg('e' || event_id, '; ') WITHIN GROUP (ORDER BY event_id)").alias("errors"))


@register("batch_results", "SELECT user_id, count(*)::BIGINT AS asked, sum((event_type <> 'error')::INT)::BIGINT AS done, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of batches put together: counts add up, one failure counts for all."""
    e = read(spark, sf_dir, "events", "user_id", "event_type")
    return e.groupBy("user_id").agg(F.count("*").alias("asked"), F.count_if(F.col("event_type") != "error").alias("done"), F.bool_or(F.col("event_type") == "error").alias("failed"))


@register("line_cap", "SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> '')[1:3], '|') AS kept FROM conversations WHERE text IS NOT NULL")
def line_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three of a summary's parts."""
    parts = F.filter(F.split("text", " ", -1), lambda x: x != "")
    return read(spark, sf_dir, "conversations", "conv_id", "turn", "text").where("text IS NOT NULL").select("conv_id", "turn", F.array_join(F.slice(parts, 1, 3), "|").alias("kept"))


@register("detail_success", "SELECT doc_id, trim(coalesce(text, ''), ' ') <> '' OR doc_id % 3 = 0 OR doc_id % 5 = 0 AS found FROM documents")
def detail_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    some = lambda c, kind: F.when(c, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)"))
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", details.found(F.col("text"), some(i % 3 == 0, "d"), some(i % 5 == 0, "f")).alias("found"))


# --- model calls --------------------------------------------------------------------


def scripted(item: int) -> model_client.Transport:
    """Answers without a model: of every third item the first model is gone, of
    the next one it is busy at first; of every other one it refuses an option."""
    calls: list[str] = []

    def answer(model: str, payload: dict, seconds: float) -> tuple[int, str]:
        calls.append(model)
        if model == "gemini-2.5-a":
            if item % 2 and "thinkingConfig" in payload["generationConfig"]:
                return 400, '{"error":{"status":"INVALID_ARGUMENT","message":"bad"}}'
            if item % 3 == 0:
                return 404, '{"error":{"status":"NOT_FOUND","message":"no such model"}}'
            if item % 3 == 1 and calls.count(model) <= 1 + item % 2:
                return 503, "busy"
        return 200, json.dumps({"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": f"{model} {len(calls)}"}]}}]})

    return answer


@register(
    "model_chain",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'b' ELSE 'gemini-2.5-a' END AS model,
    1 + (s_suppkey % 2) + CASE WHEN s_suppkey % 3 < 2 THEN 1 ELSE 0 END AS calls, CASE WHEN s_suppkey % 3 = 1 THEN 1 ELSE 0 END::DOUBLE AS waited FROM supplier""",
)
def model_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of models, the retry and the dropped option, against scripted answers."""

    def run(parts):
        for pdf in parts:
            rows = []
            for i in pdf["id"]:
                waits: list[float] = []
                client = model_client.ModelClient(["gemini-2.5-a", "b"], scripted(int(i)), per_minute=0, backoff=1.0, sleep=waits.append)
                said = client.generate("text")["candidates"][0]["content"]["parts"][0]["text"]
                model, calls = said.rsplit(" ", 1)
                rows.append((i, model, int(calls), float(sum(waits))))
            yield pd.DataFrame(rows, columns=["id", "model", "calls", "waited"])

    return read(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("id")).mapInPandas(run, "id long, model string, calls long, waited double")
