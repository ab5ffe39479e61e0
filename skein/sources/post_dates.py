"""The posting date of a list item or a detail page.

A page holds dates of many kinds: periods, events, attachments.  An Arrow
function lists the places where a posting date may stand, in order of trust,
each with the labels around it from the nearest outwards; which of them counts
is decided by expressions over that list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates
from .html import Node, clean, parse, select


@dataclass(frozen=True)
class DateRules:
    """``roles``: labels of a posting date, which win over what is around them.
    ``plain``: labels of any date.  ``marks``: parts of labels of other dates.
    ``ranges``: signs of a period.  ``closed``: classes whose inside is passed
    over.  ``classes``: names of a date's own class, letters only."""

    roles: frozenset[str]
    plain: frozenset[str]
    marks: tuple[str, ...]
    ranges: tuple[str, ...]
    closed: frozenset[str]
    classes: re.Pattern
    longest: int = 6

    @property
    def labels(self) -> frozenset[str]:
        return self.roles | self.plain


# Fixed values of the Korean boards.
KOREAN_DATES = DateRules(
    roles=frozenset("등록일 등록일자 등록일시 게시일 게시일자 게시일시 작성일 작성일자 작성일시 배포일 배포일시 보도일 공고일 공고일시".split()),
    plain=frozenset(("일자", "날짜")),
    marks=tuple("기간 기한 마감 시행일 제출 시작일 종료일 개시일 만료일 회의일 행사일 개최 일시 예정일 발표일 접수일".split()),
    ranges=("~", "∼", "〜"),
    closed=frozenset("subject file files file-list filelist file-wrap filewrap atch atchfile atch-file".split()),
    classes=re.compile("(?:(?:reg|regist|register|write|wrt|post|board|bbs|notice|create|created)(?:ed)?)?date|day|regdt"),
)
#: Periods among the marks; a value that names one is no single date.
PERIODS = 9
LABEL_TAGS = frozenset("dt th strong b em i span p".split())
DETAIL_SCOPES = (".board-view-wrap .header", ".board-view-wrap .info", ".board-view-wrap .foot", ".board-view .header", ".board-view .info", ".view-head")

_A_DATE = re.compile(r"(?:19|20)[0-9]{2}\s*[-./년]\s*[0-9]{1,2}\s*[-./월]\s*[0-9]{1,2}")
_BETWEEN = frozenset(" \t\r\n:：·ㆍ|/\\,.-–—_>»«[](){}")


def plain_label(text: str, rules: DateRules = KOREAN_DATES) -> str:
    """A label without colon, if it is short enough to be one."""
    label = clean(text).rstrip(" :：")
    return label if len(label) <= rules.longest else ""


def _says(piece: Node | str, rules: DateRules) -> str | None:
    """What a piece says about its neighbours: its text; nothing at all (None)
    if it only separates; "" if it has a date of its own or is closed."""
    if isinstance(piece, Node) and rules.closed & {c.lower() for c in piece.classes}:
        return ""
    text = clean(piece if isinstance(piece, str) else piece.text(" "))
    if not set(text) - _BETWEEN:
        return None
    return "" if isinstance(piece, Node) and _A_DATE.search(text) else text


def candidates(scope: Node, rules: DateRules = KOREAN_DATES) -> list[dict]:
    """Places of a date within ``scope`` as (rank, raw, before, around): 0 the
    value of a date label, 1 a time element, 2 an element of a date class.
    ``before``: the label right before the place and before each element around
    it; ``around`` has besides the first label of each of these elements."""
    found: list[tuple[int, int, str, list[str], list[str]]] = []
    stack: list[tuple[Node, list[str], list[str]]] = [(scope, [], [])]
    n = 0
    while stack:
        node, before, around = stack.pop()
        says = [_says(c, rules) for c in node.children]
        first = next((s for s in says if s is not None), "")
        last, inner = "", []
        for k, c in enumerate(node.children):
            if isinstance(c, Node) and not rules.closed & {x.lower() for x in c.classes}:
                own, wide = [last, *before], [last, first, *around]
                text, n = clean(c.text(" ")), n + 1
                if c.tag in LABEL_TAGS and plain_label(c.text(), rules) in rules.labels:
                    rest = node.children[k + 1 :]
                    at = next((i for i, x in enumerate(rest) if isinstance(x, Node)), len(rest))
                    found += [(0, n, raw, own, wide) for raw in (clean(" ".join(rest[:at])), clean(rest[at].text(" ")) if at < len(rest) else "")]
                period = any(m in text for m in (*rules.marks[:PERIODS], *rules.ranges))
                if c.tag == "time" and not period:
                    found += [(1, n, raw, wide, wide) for raw in (c.attrs.get("datetime", ""), text)]
                if not period and any(rules.classes.fullmatch(re.sub("[^a-z]", "", x.lower())) for x in c.classes):
                    found.append((2, n, text, wide, wide))
                inner.append((c, own, wide))
            if says[k] is not None:
                last = says[k]
        stack += reversed(inner)
    return [{"rank": r, "raw": raw, "labels": [x for x in (own if r == 0 else wide) if x]} for r, _, raw, own, wide in sorted(found, key=lambda x: x[:2]) if raw]


CANDIDATES = "array<struct<rank:int,raw:string,labels:array<string>>>"


def candidates_udf(scopes: tuple[str, ...], rules: DateRules = KOREAN_DATES):
    """The candidates of a page's ``scopes`` (selectors), scope after scope."""

    @F.pandas_udf(CANDIDATES)
    def run(page: pd.Series) -> pd.Series:
        roots = (parse(p) for p in page)
        return pd.Series([[c for s in scopes for scope in select(root, s) for c in candidates(scope, rules)] for root in roots], dtype=object)

    return run


def period_text(c: Column, rules: DateRules = KOREAN_DATES) -> Column:
    """Whether a value names a period or has a range sign."""
    out = F.lit(False)
    for m in (*rules.marks[:PERIODS], *rules.ranges):
        out = out | c.contains(m)
    return out


def accepted(labels: Column, rules: DateRules = KOREAN_DATES) -> Column:
    """The nearest label that decides: one of a posting date accepts, one of
    another date rejects; without any the place is accepted."""
    bare = lambda x: F.regexp_replace(F.trim(x), "[ :：]+$", "")
    role = lambda x: bare(x).isin(*sorted(rules.roles))

    def other(x: Column) -> Column:
        out = F.lit(False)
        for m in (*rules.marks, *rules.ranges):
            out = out | x.contains(m)
        return out

    first = F.get(F.filter(labels, lambda x: role(x) | other(x)), F.lit(0))
    return first.isNull() | role(first)


def posting_date(found: Column, rules: DateRules = KOREAN_DATES) -> Column:
    """The first candidate that is accepted and is one whole date, as ISO text; empty without any."""
    some = F.filter(found, lambda c: accepted(c["labels"], rules))
    iso = F.transform(some, lambda c: dates.whole_date(F.when(c["rank"] == 2, dates.strip_label(c["raw"], sorted(rules.labels))).otherwise(c["raw"])))
    return F.coalesce(F.get(F.filter(iso, lambda x: x != ""), F.lit(0)), F.lit(""))


def label_union(*sets: Column) -> Column:
    """Label sets as one, sorted."""
    out = sets[0]
    for s in sets[1:]:
        out = F.array_union(out, s)
    return F.array_sort(out)
