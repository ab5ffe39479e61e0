"""Detail pages, posting dates, JSON lists, the model client, the HTTP source."""

from __future__ import annotations

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from skein.operators import details
from skein.operators import model_client as C
from skein.sources import boards, http_pages, json_lists
from skein.sources import html as H
from skein.sources import post_dates as P
from skein.streaming import dedupe, sinks


def dated(spark, pages: list[str], scopes=(".h",)) -> list[str]:
    df = spark.createDataFrame(list(enumerate(pages)), "i int, page string")
    made = df.select("i", P.posting_date(P.candidates_udf(scopes)("page")).alias("d"))
    return [r["d"] for r in made.orderBy("i").collect()]


def test_posting_dates(spark):
    inside = [
        ("<dl><dt>예고기간</dt><dd>2026-07-24 ~ 2026-08-13</dd><dt>등록일</dt><dd>2026.07.20</dd></dl>", "2026-07-20"),
        ("<p>예고기간</p><b>일자</b> 2026-08-01 <i>작성일시 :</i> 2026년 7월 1일", "2026-07-01"),
        ("<span>등록일시</span> 2026-07-24", "2026-07-24"),
        ("<div class='period'><span>예고기간</span><span>시작일</span><time>2026-08-01</time></div>", ""),
        ("<p>회의일</p><time datetime='2026-08-01'>Aug 1</time>", ""),
        ("<time datetime='2026-08-01T09:00'>Aug 1</time>", "2026-08-01"),
        ("<div class='subject'>제출 기한 연장</div><time>2026-08-01</time>", "2026-08-01"),
        ("<div class='file-list'><time>2026-08-01</time></div>", ""),
        ("<div class='profile'><time>2026-08-01</time></div>", "2026-08-01"),
        ("<em class='reg_date'>날짜: 2026-07-24</em>", "2026-07-24"),
        ("<em class='update'>2026-07-24</em>", ""),
        ("<div class='date'>2026-07-24 ~ 2026-08-13</div>", ""),
        ("<dl><dt>등록일</dt><dd>2026-13-45</dd></dl><time>2026-07-02</time>", "2026-07-02"),
        ("<div><span>예고기간</span><span>2026-07-24 ~ 2026-08-13</span></div><div><time>2026-07-02</time></div>", "2026-07-02"),
        ("2026-07-24", ""),
        ("", ""),
    ]
    assert dated(spark, [f"<div class=h>{x}</div>" for x, _ in inside]) == [d for _, d in inside]
    assert dated(spark, ["<p>none</p>", "<div class=h></div><div class=h><time>2026-07-02</time></div>"]) == ["", "2026-07-02"]


def test_selectors():
    root = H.parse("<div class='a b' id=x><p class=c>1</p><span><p class=c>2</p></span></div><p class=c>3</p>")
    assert [n.text() for n in H.select(root, ".a .c")] == ["1", "2"] and [n.text() for n in H.select(root, "div#x span p.c")] == ["2"]
    assert [n.text() for n in H.select(root, "p.c")] == ["1", "2", "3"] and H.select(root, ".b .a") == []
    assert H.first_of(root, (".none", "#x .c")).text() == "1" and H.first_of(root, (".none",)) is None


def test_detail_scan_without_pages(spark):
    posts = spark.createDataFrame([("u1", "t", "2026-01-01", []), ("http://h/FileDown?x", "t", None, []), (None, None, None, [])], "url string, title string, date string, files array<struct<name:string,url:string>>")
    pages = spark.createDataFrame([], "url string, html string")
    got = details.detail_scan(posts, pages, details.DetailRules(direct=("filedown",), labels=("a",))).collect()
    assert [(r["body"], r["date"], len(r["files"]), r["found"]) for r in sorted(got, key=lambda r: str(r["url"]))] == [("", "", 0, False), ("", "", 1, True), ("", "2026-01-01", 0, False)]


def test_list_with_an_error_code_stops(spark):
    df = spark.createDataFrame([(1, '{"RESULT":{"CODE":"ERROR-290","MESSAGE":"m"}}')], "page int, body string")
    with pytest.raises(Exception, match="ERROR-290"):
        json_lists.index_rows(df, ["page"], "body").collect()
    none = spark.createDataFrame([(1, None), (2, '{"RESULT":{"CODE":"INFO-200"}}'), (3, "{}")], "page int, body string")
    assert json_lists.index_rows(none, ["page"], "body").count() == 0 and json_lists.offset_rows(none, ["page"], "body", 5, id_names=["i"]).count() == 0
    row = spark.range(1).select(json_lists.index_query("k", F.lit(0), 100, "22").alias("q"), json_lists.index_query("", F.lit(1), 100).alias("none"), json_lists.offset_form(F.lit(3), 30).alias("f")).first()
    assert row["q"] == {"KEY": "k", "Type": "json", "pIndex": "1", "pSize": "100", "AGE": "22"} and row["none"] is None and row["f"]["start"] == "60"


def client(answers: list, models=("gemini-2.5-x", "b"), **more):
    now, sent = [0.0], []

    def transport(model, payload, seconds):
        sent.append((model, "thinkingConfig" in payload["generationConfig"], round(seconds, 1)))
        status, body = answers.pop(0)
        return status, body if isinstance(body, str) else json.dumps(body)

    def sleep(s):
        now[0] += s

    return C.ModelClient(list(models), transport, clock=lambda: now[0], sleep=sleep, **({"per_minute": 0} | more)), sent, now


def test_model_chain_retries_and_options():
    c, sent, _ = client([(400, "bad"), (200, {"a": 1}), (200, {"a": 2})])
    assert c.generate("t") == {"a": 1} and c.generate("t") == {"a": 2}
    assert [x[:2] for x in sent] == [("gemini-2.5-x", True), ("gemini-2.5-x", False), ("gemini-2.5-x", False)]
    c, sent, _ = client([(404, "{}"), (200, {}), (200, {})])
    assert c.generate("t") == {} == c.generate("t") and [x[0] for x in sent] == ["gemini-2.5-x", "b", "b"]
    c, sent, now = client([(503, "busy"), (429, "slow"), (200, {})], backoff=2.0)
    assert c.generate("t") == {} and now[0] == 6.0
    c, sent, _ = client([(503, "busy")] * 3, retries=2)
    with pytest.raises(RuntimeError, match="HTTP 503"):
        c.generate("t")
    c, sent, _ = client([(403, "no")])
    with pytest.raises(RuntimeError, match="HTTP 403"):
        c.generate("t")
    c, _, _ = client([(404, "{}"), (404, "{}")])
    with pytest.raises(C.NoModel):
        c.generate("t")
    with pytest.raises(C.NoModel):
        c.generate("t")
    assert not client([], models=())[0].available and not client([], key="")[0].available and client([])[0].available


def test_pauses_and_bounds():
    c, sent, now = client([(200, {})] * 3, per_minute=10, total=8.0, seconds=5.0)
    c.generate("t"), c.generate("t")
    assert now[0] == 6.0 and [x[2] for x in sent] == [5.0, 2.0]
    with pytest.raises(C.OutOfTime):
        c.generate("t")
    assert now[0] == 8.0 and len(sent) == 2
    c, sent, now = client([(503, "busy")], total=6.0, backoff=2.0)
    with pytest.raises(RuntimeError, match="HTTP 503"):
        c.generate("t")
    assert now[0] == 0.0
    stuck = threading.Event()
    with pytest.raises(C.OutOfTime):
        C.within(0.05, stuck.wait)
    stuck.set()
    with pytest.raises(ZeroDivisionError):
        C.within(1.0, lambda: 1 / 0)
    assert C.error_fields("oops" * 100) == ("", ("oops" * 100)[:200]) and C.error_fields('{"error":{"status":"S","message":"m"}}') == ("S", "m") and C.error_fields("[]") == ("", "")


def test_http_source_gets_and_posts(spark):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self):
            n = int(self.headers.get("Content-Length") or 0)
            seen.append((self.command, self.rfile.read(n), self.headers.get("Referer"), self.headers.get("Accept-Language")))
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"hello")

        do_GET = do_POST = answer  # noqa: N815

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = spark.read.format("http_pages").option("urls", f"{base}/a\n{base}/b").option("delay_sec", "0").load().collect()
    assert sorted((r["url"], r["status"], bytes(r["content"])) for r in rows) == [(f"{base}/a", "ok", b"hello"), (f"{base}/b", "ok", b"hello")]
    rows = spark.read.format("http_pages").option("urls", f"{base}/p").option("body", "a=1").option("referer", "r").option("connect_sec", "2").load().collect()
    assert rows[0]["charset"] == "utf-8" and seen[-1][:3] == ("POST", b"a=1", "r") and seen[-1][3]
    server.shutdown()
    waits: list[float] = []
    assert http_pages.fetch("http://127.0.0.1:9/", tries=5, connect=0.5, sleep=waits.append)[1] == "error" and len(waits) == 1


def test_board_is_fetched_twice_if_empty():
    pages, dumped = ["", "<a href='/1'>One</a><a href='/2'>Two</a>"], []
    assert [r["title"] for r in boards.scan_board(lambda: pages.pop(0), lambda p: H.links(p, "http://h/"), 1, dumped.append)] == ["One"]
    assert boards.scan_board(lambda: "<p>", lambda p: [], 5, dumped.append) == [] and dumped == ["<p>"]


def test_digest_messages():
    files = [sinks.File("a.pdf", b"x" * 60, "application/pdf"), sinks.File("b", b"y" * 50), sinks.File("none", None), sinks.File("c", b"z" * 40)]
    d = sinks.digest_message("s\nt", "<p>h</p>", "plain", "me@h", ["a@h", " a@h ", "b@h"], files, budget=100)
    assert [p.get_filename() for p in d.message.iter_attachments()] == ["a.pdf", "c"] and d.left_out == ["b", "none"]
    assert d.message["To"] == "undisclosed-recipients:;" and "a@h" not in d.message.as_string() and d.recipients == ["a@h", "b@h"]
    assert d.message.get_body(("plain",)).get_content().strip() == "plain" and d.message["Subject"] == "s t"
    assert sinks.deliver(d, lambda m, sender, to: {"b@h": (550, b"no")}) == ["b@h"] and sinks.deliver(d, lambda *a: {}) == []
    with pytest.raises(RuntimeError):
        sinks.deliver(d, lambda m, sender, to: dict.fromkeys(to))
    with pytest.raises(ValueError, match="recipient"):
        sinks.deliver(sinks.digest_message("s", "", "", "me@h", []), lambda *a: {})


def test_dry_run_marks_nothing(spark, tmp_path):
    state = dedupe.SeenState(spark, f"{tmp_path}/seen")
    state.commit(spark.createDataFrame([("s", "0", 1)], "source_key string, post_id string, pos int"), "pos")
    batch = spark.createDataFrame([("s", str(i), f"t{i}", i) for i in range(3)], "source_key string, post_id string, title string, pos int")
    said: list[str] = []
    for _ in range(2):
        dedupe.monitor_batch(state, lambda df, i: sinks.preview(df, said.append), dry=True)(batch, 1)
    assert said == ["[s] t1 (1)", "[s] t2 (2)"] * 2 and state.version() == 0
    sinks.preview(batch.limit(0), said.append)
    assert said[-1] == "nothing new"


def test_quarantine_and_manifest(spark, tmp_path):
    pages = spark.createDataFrame([("a", "<p>"), ("b", None)], "source_key string, body string")
    sinks.quarantine(pages, f"{tmp_path}/q", "source_key", "body", F.upper)
    sinks.quarantine(pages, f"{tmp_path}/q", "source_key", "body")
    got = spark.read.parquet(f"{tmp_path}/q")
    assert got.count() == 4 and {r["body"] for r in got.where("source_key = 'a'").collect()} == {"<P>", "<p>"}
    sinks.write_manifest(pages, f"{tmp_path}/m")
    assert sorted(json.loads(x["value"])["source_key"] for x in spark.read.text(f"{tmp_path}/m").collect()) == ["a", "b"]


def test_har_keeps_names_and_loses_secrets():
    from skein.functions.redact import redact_har

    entry = {
        "request": {"url": "https://h/p?csrfToken=s3cret&billId=7", "cookies": [{"name": "a", "value": "s3cret"}], "headers": [{"name": "Authorization", "value": "s3cret"}, {"name": "Accept", "value": "x"}], "postData": {"text": '{"token": "s3cret", "n": 1}', "params": [{"name": "sid", "value": "s3cret"}]}},
        "response": {"redirectURL": "https://h/?token=s3cret", "content": {"text": "mail a@b.test", "mimeType": "text/html"}, "status": 200},
    }
    got = redact_har({"log": {"entries": [entry]}})
    said = json.dumps(got)
    assert "s3cret" not in said and "a@b.test" not in said and "billId=7" in said and "csrfToken=REDACTED" in said
    assert got["log"]["entries"][0]["request"]["cookies"] == [] and got["log"]["entries"][0]["request"]["headers"][1] == {"name": "Accept", "value": "x"}
    assert got["log"]["entries"][0]["response"]["status"] == 200 and redact_har(None) is None
