"""Column functions on awkward values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import jsonops as J
from skein.functions import redact as R
from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import classify


def one(spark, value, run, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(run(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("run", "value", "want"),
    [
        (T.squish, "  a \t　b\n", "a b"),
        (T.squish, None, ""),
        (T.clean, "a \t b\n\n\n\nc　", "a b\n\nc"),
        (T.clean, None, ""),
        (T.html_escape, "<a href=\"x\">'&", "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"),
        (T.unfence, "```json\n{}\n```", "{}"),
        (T.unfence, "```json\n{", "{"),
        (T.unfence, "```", ""),
        (T.strip_list_marker, "-3.5% down", "-3.5% down"),
        (T.strip_list_marker, "- item", "item"),
        (T.strip_list_marker, "2026년 1월", "2026년 1월"),
        (T.strip_list_marker, "(3) item", "item"),
        (T.flatten_spaces, "1,​234 x", "1,234 x"),
        (T.strip_file_size, "plan.pdf (1.5 MB)", "plan.pdf"),
        (T.agency, "FSC · news", "FSC"),
        (T.mime, "a.PDF", "application/pdf"),
        (T.mime, "a", "application/octet-stream"),
        (D.whole_date, "2026. 7. 4.", "2026-07-04"),
        (D.whole_date, "2026년 7월 24일", "2026-07-24"),
        (D.whole_date, "2026-07-24T10:00:00+09:00", "2026-07-24"),
        (D.whole_date, "2026-02-30", ""),
        (D.whole_date, "2026.07.24 ~ 2026.08.13", ""),
        (D.whole_date, None, ""),
        (D.date_inside, "on 2026-02-30", "2026-02-30"),
        (D.date_inside, "2026-13-01", ""),
        (D.row_date, "no 20260724 x", "2026-07-24"),
        (R.redact_values, "a JSESSIONID=abc; x@y.zz 010-1234-5678", "a REDACTED; REDACTED REDACTED"),
        (J.result_code, '{"a":{"RESULT":{"MESSAGE":"m","CODE":"E-1"}}}', "E-1"),
        (J.body_shape, "a=1&b=2", "form:a,b"),
        (J.body_shape, None, "absent"),
    ],
)
def test_scalar(spark, run, value, want):
    assert one(spark, value, run) == want


def test_truncate_only_when_longer(spark):
    assert one(spark, "abc", lambda c: T.truncate(c, 3)) == "abc"
    assert one(spark, "abcd", lambda c: T.truncate(c, 3)) == "abc …"


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul", "America/New_York"])
def test_epoch_ms_iso_has_years_of_any_length_in_utc(spark, zone):
    wanted = {
        0: "1970-01-01T00:00:00.000Z",
        -1: "1969-12-31T23:59:59.999Z",
        1_710_054_123_045: "2024-03-10T07:02:03.045Z",
        253_402_300_799_999: "9999-12-31T23:59:59.999Z",
        253_402_300_800_000: "10000-01-01T00:00:00.000Z",
        9_223_372_036_854_775: "294247-01-10T04:00:54.775Z",
        -62_167_219_200_000: "0000-01-01T00:00:00.000Z",
        None: None,
    }
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(v,) for v in wanted], "v bigint").select("v", D.epoch_ms_iso("v").alias("r"))
        assert {v: r for v, r in df.collect()} == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_urls(spark):
    board = lambda c: U.board_id(c, "/board/", ("no", "nttId"))
    assert one(spark, "https://b.t/board/v?nttId=7", board) == "nttId:7"
    assert one(spark, "https://b.t/board/1234?x=1", board) == "path:1234"
    assert one(spark, "https://b.t/else?no=7", board) == ""
    page = lambda c: U.page_url(c, "page", F.lit(2))
    assert one(spark, "https://b.t/l?a=1&page=9&a=2", page) == "https://b.t/l?a=2&page=2"
    assert one(spark, "https://b.t/l", page) == "https://b.t/l?page=2"
    red = lambda c: U.redact_params(c, R.HINTS, R.PUBLIC)
    assert one(spark, "https://b.t/p?billId=1&_csrf=x-y&q=1", red) == "https://b.t/p?billId=1&_csrf=REDACTED&q=1"
    assert one(spark, "https://b.t/p#", red) == "https://b.t/p#"


def test_responses(spark):
    make = lambda text, why: '{"candidates":[{"content":{"parts":[{"text":"%s"}]},"finishReason":"%s"}]}' % (text, why)
    for text, why, want in (("a", "STOP", "OK"), (" ", "STOP", "EMPTY"), ("a", "MAX_TOKENS", "SPLIT"), ("a", "SAFETY", "FAILED"), ("a", "", "FAILED")):
        assert one(spark, make(text, why), J.gate) == want
    assert one(spark, "{}", J.gate) == "FAILED"


def test_classification(spark):
    ident = lambda c: classify.identity(c, F.lit("1"), F.lit(""), F.lit(None))
    assert one(spark, "1", ident) == "CONFIRMED"
    assert one(spark, "2", ident) == "MISMATCH"
    assert one(spark, "2", lambda c: classify.identity(c, F.lit(""))) == "UNCONFIRMED"
    lines = lambda c: classify.valid_lines(F.split(c, "/"), 2, 5)
    assert one(spark, "ab/cd", lines) and not one(spark, "ab/--", lines) and not one(spark, "abcdef/x", lines) and not one(spark, None, lines)
