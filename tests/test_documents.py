"""HTML parsing, excerpts, summaries, configuration, state and streams."""

from __future__ import annotations

import io
import json

import pytest

from skein.operators import excerpt as E
from skein.operators import summarize as M
from skein.sources import html as H
from skein.sources import http_pages, registry
from skein.streaming import dedupe

LIST = """<ul><li><div class="subject"><a href="/b/1?nttId=1" title="First"><span>new</span></a></div>
<li><div class=subject><a href="/b/2">Second<b>!</a></div><li><a href="/other">Other</a></ul><script>var t="<a href='/no'>no</a>"</script>"""
TABLE = """<table><thead><tr><td><a href="/h">Head</a></td></tr></thead><tbody>
<tr><td>12<td class=title><a href="v?nttId=3">Plan</a><td>2026-01-02<td><a href="/x/fileDown?f=1" title="p.pdf">get</a></tr>
<tr><td>11<td>Bank A<td>20260101<td><a href="javascript:go()">x</a><a href="/e?examMgmtNo=5&emOpenSeq=1">view</a></table>"""


def test_links():
    got = H.links(LIST, "https://b.t/list")
    assert [(r["title"], r["url"]) for r in got] == [("First", "https://b.t/b/1?nttId=1"), ("Second!", "https://b.t/b/2")]
    assert H.links(None, "https://b.t") == [] and H.links("", "") == []


def test_table_rows():
    got = H.table_rows(TABLE, "https://b.t/board/list")
    assert [(r["title"], r["url"]) for r in got] == [("Plan", "https://b.t/board/v?nttId=3"), ("Bank A", "https://b.t/e?examMgmtNo=5&emOpenSeq=1")]
    assert got[0]["files"] == "p.pdf=https://b.t/x/fileDown?f=1"


def test_label_values_and_forms():
    page = "<table><tr><th>A b</th><td>1</td></tr><tr><th>A b<td>2</table><dl><dt>C<dd>3<dt>D<dt>E<dd>5</dl>"
    assert H.label_values(page) == {"Ab": "1", "C": "3", "E": "5"}
    form = '<meta name="_csrf" content="t"><form><input type=hidden name=billId value=x><input type=hidden name=billId value=y></form>'
    assert H.hidden_inputs(form) == {"billId": "y"}
    assert H.summary_request(form, "y")["ok"] and not H.summary_request(form, "z")["ok"] and not H.summary_request("", "y")["ok"]
    assert "t" not in H.redact_page('<meta name="_csrf" content="t1t">', ("csrf",)).split("content=")[1].replace("REDACTED", "")


def test_text_repairs_markup():
    assert H.clean(H.parse("<p>a<b>b<br>c</p><p>d<script>e</script>").text(blocks=True)).split() == ["ab", "c", "d"]
    assert H.strip_tags("use the <br> tag") == "use the <br> tag"
    assert H.decode("가".encode("euc-kr"), None) == "가" and H.decode("é".encode(), "latin-1") == "é" and H.decode(None, None) == ""


@pytest.mark.parametrize(
    ("body", "title", "want"),
    [
        ("", "", ""),
        ("제목 줄\n본문이다.", "제목 줄", "본문이다."),
        ("등록일 : 2026-07-24\n조회수 : 1,234\n본문이다.", "", "본문이다."),
        ("담당부서\n은행과\n등록일\n2026-07-24\n본문이다.\n목록", "", "본문이다."),
        ("등록일\n부터 30일 이내 제출한다.", "", "등록일 부터 30일 이내 제출한다."),
        ("문의 : 대출 상한은 어떻게 해야 합니까?", "", "문의 : 대출 상한은 어떻게 해야 합니까?"),
        ("첨부파일\n보도자료.hwp\n별첨.pdf\n본문이다.", "", "본문이다."),
        ("본문이다.\n첨부파일\n보도자료.hwp", "", "본문이다."),
        ("수익률 3.5% 증가\n본문", "수익률 35% 증가", "수익률 3.5% 증가 본문"),
        ("-----\n목록", "", "----- 목록"),
        ("<p>1,<strong>234</strong>억원</p>", "", "1,234억원"),
        ("a&amp;b ?a=1&reg=2", "", "a&b ?a=1&reg=2"),
        ("가" * 220, "", "가" * 220),
        ("가" * 221, "", "가" * 220 + " …"),
        (None, None, ""),
    ],
)
def test_excerpt(body, title, want):
    assert E.excerpt(body, title) == want


BODY = "금융위원회는 외부감사 및 회계 등에 관한 규정 개정안을 입법예고한다고 밝혔다."


@pytest.mark.parametrize("heading", ["추진배경", "기대효과", "추진 성과", "신청"])
@pytest.mark.parametrize("label", ["담당자", "담당부서", "작성자"])
def test_heading_below_a_lone_label_is_content(label, heading):
    assert E.excerpt(f"{label}\n{heading}\n{BODY}", "규정") == f"{heading} {BODY}"


@pytest.mark.parametrize(
    "noise",
    [
        "등록일\n2026. 7. 24.",
        "담당자\n홍길동 사무관",
        "연락처\n(02) 2100-2600",
        "등록일\n2026-07-24 (금) 09:30",
        "첨부파일\n보도자료.hwp (188 KB)\n1. 공고문 입법예고.hwpx",
        "첨부파일: report.pdf (10 MB)",
        "담당부서\n담당자\n연락처\n02-2100-2600\n조회수\n1,234",
        "문의 : 금융위원회 은행과 (02-2100-2000)",
        "홈 > 알림마당 > 보도자료",
        "이 자료는 배포 즉시 보도할 수 있습니다.",
        "브라우저 설정에서 자바스크립트를 활성화해 주세요.",
        "이전글 : 은행법 시행령 개정안",
    ],
)
def test_noise_goes_from_both_ends_but_not_from_between(noise):
    assert E.excerpt(f"{noise}\n{BODY}") == BODY
    assert E.excerpt(f"{BODY}\n{noise}") == BODY
    between = E.excerpt(f"{BODY}\n{noise}\n{BODY}", limit=10**6)
    assert between == " ".join([BODY, *noise.split("\n"), BODY])


def test_department_counts_as_a_value_only_beside_another_label():
    assert E.excerpt(f"담당부서\n금융투자검사3국\n등록일\n2026. 7. 24.\n{BODY}") == BODY
    assert E.excerpt(f"{BODY}\n등록일\n담당부서\n금융투자검사3국") == BODY
    assert E.excerpt(f"{BODY}\n담당부서\n금융투자검사3국") == f"{BODY} 담당부서 금융투자검사3국"


@pytest.mark.parametrize("line", ["자바스크립트 사용 여부를 점검하도록 규정하였다.", "제출 파일은 report.pdf (10 MB)", "신청 서식: 금융지원신청서.hwp", "담당부서 : 대출한도를 1억원으로 상향한다", "온라인 광고에는 자료의 출처를 표기해야 한다."])
def test_content_that_looks_like_noise_stays(line):
    assert E.excerpt(f"{line}\n{BODY}") == f"{line} {BODY}"


@pytest.mark.parametrize(("a", "b", "same"), [("수익률 3.5% 기록", "수익률 - 3.5% 기록", False), ("실적 2026724 발표", "실적 2026. 7. 24. 발표", False), ("자산 < 10억원", "자산 > 10억원", False), ("개정안 - 규정.", "[개정안 규정]", True)])
def test_title_keys(a, b, same):
    assert (E.title_key(a) == E.title_key(b)) == same


def test_markup_is_told_from_text():
    for text in ("<p>a</p>", " <DIV a=1>q<b>r</b></DIV > ", "x <body> y", "<!DOCTYPE html><p>x"):
        assert E.looks_like_markup(text)
    for text in ("use <br> tag", "<div>x</div> y", "<p>a", "", "<붙임> a"):
        assert not E.looks_like_markup(text)
    assert H.unescape_closed("a&amp;b&copy=1&#44032;&;&bogus;&lt;") == "a&b&copy=1가&;&bogus;<"


def test_batches_of_summaries():
    items = [(str(i), f"Text {i}. More. End.") for i in range(4)]
    assert M.summarise_items(items, M.stub(3), 3, 200)["2"] == ["Text 2.", "More.", "End."]

    def answer(rows, why="STOP"):
        return {"candidates": [{"content": {"parts": [{"text": json.dumps({"summaries": rows})}]}, "finishReason": why}]}

    good = {"bill_id": "1", "summary": ["a", "b"]}
    wanted = {"1", "2"}
    assert M.parse_batch(answer([good, {"bill_id": "9", "summary": ["a", "b"]}, "junk"]), wanted, 2, 10) == ({"1": ["a", "b"]}, "ok")
    assert M.parse_batch(answer([{"bill_id": "1"}, good]), wanted, 2, 10)[0] == {}
    assert M.parse_batch(answer([good], "MAX_TOKENS"), wanted, 2, 10) == ({}, "split")
    calls = []

    def picky(part):
        calls.append(len(part))
        return answer([], "MAX_TOKENS") if len(part) > 2 else M.stub(3)(part)

    assert len(M.summarise_items(items, picky, 3, 200)) == 4 and calls == [4, 2, 2]
    assert M.summarise_items(items, lambda part: 1 / 0, 3, 200) == {}
    assert M.fallback_order(["a", "b", "a"], "b", {"a"}) == ["b"]
    assert "temperature" in M.generation_config(" Gemini-2.5-flash", 3) and "temperature" not in M.generation_config("gemini-3", 3)


def test_config_and_state(tmp_path, spark):
    c = registry.load_config({"sources": [{"key": "a", "name": "A", "type": "links", "list_url": "u", "colour": "x"}, {"key": "b", "name": "B", "type": "table", "list_url": "u", "enabled": False}], "max_pages": 4}, {"MAIL_TO": "a@b; ,c@d"})
    assert c.recipients == ["a@b", "c@d"] and c.max_pages == 4 and [s.key for s in c.selected()] == ["a"] and c.sources[0].extra == {"colour": "x"}
    assert registry.sources_frame(spark, c).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        registry.load_config({"sources": [{"key": "a", "name": "A", "type": "?", "list_url": "u"}]}, {})
    path = tmp_path / "s" / "seen.json"
    s = registry.State(path)
    s.mark("a", ["2", "1"])
    s.mark("a", ["3", "2"])
    s.save()
    assert registry.State(path).seen("a") == ["3", "2", "1"] and registry.State(path).is_baselined("a")
    path.write_text("{broken")
    assert registry.State(path).seen("a") == []
    assert registry.capture_target("7", "https://h/x?billId=7", "", "h") == ("7", "https://h/x?billId=7")
    for bad in ("http://h/x?billId=7", "https://other/x?billId=7", "https://h/x?billId=7&billId=8", "https://h/x?billId="):
        with pytest.raises(ValueError):  # noqa: PT011
            registry.capture_target("7", bad, "", "h")


class Reply(io.BytesIO):
    status = 200

    def __init__(self, body: bytes, length: int | None = None) -> None:
        super().__init__(body)
        self.headers = self
        self.length = length

    def get(self, name):
        return self.length

    def get_content_charset(self):
        return "utf-8"


def test_fetch():
    assert http_pages.fetch("http://h/", opener=lambda r, timeout: Reply(b"x"))[1:] == ("ok", 200, "utf-8", b"x")
    assert http_pages.fetch("http://h/", max_bytes=2, opener=lambda r, timeout: Reply(b"xxx"))[1] == "too_large"
    assert http_pages.fetch("http://h/", max_bytes=2, opener=lambda r, timeout: Reply(b"", 9))[1] == "too_large"
    waits = []

    def fail(r, timeout):
        raise OSError("secret in here")

    assert http_pages.fetch("http://h/", opener=fail, sleep=waits.append) == ("http://h/", "error", None, None, None)
    assert waits == [1.0, 2.0]
    assert len(http_pages.PagesReader({"urls": "http://a/1\nhttp://b/1\nhttp://a/2"}).partitions()) == 2


def test_monitor_batches(spark, tmp_path):
    state, sent = dedupe.SeenState(spark, str(tmp_path / "state")), []
    run = dedupe.monitor_batch(state, lambda df, b: sent.append((b, sorted(r["post_id"] for r in df.collect()))), cap=2)
    frame = lambda ids: spark.createDataFrame([("s", i, n) for n, i in enumerate(ids)], "source_key string, post_id string, pos int")
    run(frame(["a", "b"]), 0)  # the first batch only records
    run(frame(["e", "d", "c", "b", "c"]), 1)
    run(frame(["e", "d", "c"]), 2)
    assert sent == [(0, []), (1, ["d", "e"]), (2, [])]
    assert [r["post_id"] for r in state.read().orderBy("ord").collect()] == ["e", "d", "c", "a", "b"]


def test_stateful_stream(spark, tmp_path):
    for k, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([("s", i) for i in ids], "source_key string, post_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = dedupe.dedupe_stateful(spark.readStream.schema("source_key string, post_id string").parquet(str(tmp_path / "in")), "source_key", "post_id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["post_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_normalize_lines_keeps_documents_with_odd_breaks_and_spaces(spark, tmp_path):
    from skein.plans import catalogue

    rows = [(1, "a\r\nb\rc\x0bd\x0ce"), (2, "a\x1cb\x1dc\x1ed\x85e\u2028f\u2029g"), (3, " a\u00a0b\u2003 c\u3000\n\ufeffd\u200be "), (4, None), (5, "plain\n\n text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["joined"] for r in catalogue.queries()["normalize_lines"](spark, str(tmp_path)).collect()}
    want = {1: "a⏎b⏎c⏎d⏎e", 2: "a⏎b⏎c⏎d⏎e⏎f⏎g", 3: "a b c⏎de", 4: "", 5: "plain⏎text"}
    assert got == want


def test_digest_html_has_every_document(spark, tmp_path):
    from skein.plans import catalogue

    rows = [(i, f"s{i % 3}", i) for i in range(450)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source_key"]: r["block"] for r in catalogue.queries()["digest_html"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ["s0", "s1", "s2"]
    assert all(b.startswith(f"<h2>{k} (150)</h2>") and b.count("<li>") == 150 for k, b in got.items())


def test_json_first_nonempty_reads_long_props(spark, tmp_path):
    from skein.plans import catalogue

    rows = [(2, json.dumps({"pad": "p" * 12_000, "k": "kept"})), (3, json.dumps({"pad": "p" * 12_000, "k": "other"})), (4, '{"k":"short"}')]
    spark.createDataFrame(rows, "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["picked"] for r in catalogue.queries()["json_first_nonempty"](spark, str(tmp_path)).collect()}
    assert got == {2: "kept", 3: "x3", 4: "short"}
