"""Fallback excerpts: markup and entities resolved, edge noise peeled, cut.

Each line of a body gets a class; the classes in order make a tape, one
character a line.  What is noise at the front is what a grammar over the tape
accepts from its start, and at the back what another accepts from its end; the
lines between are the content.  Words and labels belong to the boards that are
monitored, so they are a parameter, ``Rules``; ``KOREAN`` has the Korean ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

LIMIT = 220

# Elements of a page, those that show a whole document, and those that may wrap a body.
ELEMENTS = frozenset("p br hr div span table thead tbody tfoot tr td th caption ul ol li dl dt dd a img h1 h2 h3 h4 h5 h6 strong em b i u font pre code blockquote section article header footer nav body html script style".split())
DOCUMENT = ("<!doctype", "<html", "<head", "<body")
BLOCKS = frozenset("p div section article table tbody tr td th ul ol li dl blockquote".split())
_ELEMENT = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?=[\s/>])[^>]*>")


def looks_like_markup(text: str) -> bool:
    """A known element, and either a document's skeleton or one block around it all."""
    names = [(m.group(2).lower(), bool(m.group(1)), m.span()) for m in _ELEMENT.finditer(text or "")]
    if not any(n in ELEMENTS for n, _, _ in names):
        return False
    low, body = text.lower(), text.strip()
    if any(re.search(rf"{d}\b", low) for d in DOCUMENT):
        return True
    (first, closes, (at, _)), (last, ends, (_, end)) = names[0], names[-1]
    lead = len(text) - len(text.lstrip())
    return first == last and first in BLOCKS and not closes and ends and at == lead and end == lead + len(body)


# --- what a value looks like ----------------------------------------------------

# File types, units of an organisation, ranks.
FILE_TYPES = frozenset("hwp hwpx pdf doc docx xls xlsx ppt pptx zip jpg jpeg png gif bmp txt csv".split())
BODIES = ("위원회", "감독원", "연구원", "담당관", "본부", "센터", "사무국", "지원단", "추진단")
UNITS = ("팀", "과", "국", "실", "부", "처", "청")
RANKS = ("사무관", "주사보", "주사", "주임", "팀장", "과장", "국장", "실장", "부장", "본부장", "서기관", "조사관", "연구관", "검사역", "수석", "선임", "담당자")
_HANGUL = re.compile("[가-힣]+")


def is_date(s: str) -> bool:
    """Year, month, day, perhaps a weekday and a time: 2026-07-24, 2026. 7. 24., 2026년 7월 24일(금) 09:30."""
    numbers = re.findall("[0-9]+", s)
    if not 3 <= len(numbers) <= 6 or [len(numbers[0]), max(map(len, numbers[1:]))] != [4, max(1, min(2, max(map(len, numbers[1:]))))]:
        return False
    return s[0].isdigit() and not set(s) - set("0123456789 .-/:()년월일시분초화수목금토")


def is_count(s: str) -> bool:
    """A number, perhaps with thousands separators and a unit: 1,234 or 15회."""
    number = s.rstrip("회건명").strip().replace(",", "")
    return len(s) - len(s.rstrip("회건명")) <= 1 and number.isascii() and number.isdigit()


def is_phone(s: str) -> bool:
    """7 to 11 digits in groups, perhaps an extension: 02-2100-2600, (02) 2100-2600 (내선 12)."""
    s = s.replace("내선", " ")
    groups = re.findall("[0-9]+", s)
    main = [g for g in groups if g][:3]
    return not set(s) - set("0123456789 -.()") and 2 <= len(groups) <= 4 and all(len(g) <= 5 for g in groups) and 7 <= sum(map(len, main)) <= 12 and not is_date(s)


def is_file(s: str) -> bool:
    """A file's name, perhaps with its size: report.pdf (10 MB)."""
    bare = re.sub(r"\s*\(?\s*[0-9][0-9.,]*\s*[KMG]?B\s*\)?$", "", s, flags=re.I)
    stem, dot, kind = bare.rpartition(".")
    return bool(dot) and 0 < len(stem) <= 120 and kind.lower() in FILE_TYPES and not set(stem) & set(":：")


def is_org(s: str) -> bool:
    """A department: its last word ends in a body or in a unit after two characters; 금융위원회 기업회계팀."""
    last = s.split(" ")[-1]
    named = last.endswith(BODIES) or (len(last) > 2 and last.endswith(UNITS) and last[-3:-1].isalnum())
    return named and len(s) <= 30 and all(c.isalnum() or c in " ()·-" for c in s)


def is_name(s: str) -> bool:
    return 2 <= len(s) <= 4 and bool(_HANGUL.fullmatch(s))


def is_ranked(s: str) -> bool:
    """A name and a rank: 홍길동 사무관."""
    return any(s.endswith(r) and is_name(s[: -len(r)].strip()) for r in RANKS)


def is_staff(s: str) -> bool:
    """A department, perhaps with a person after it."""
    words = s.split(" ")
    return is_org(s) or any(is_org(" ".join(words[:k])) and (is_name(" ".join(words[k:])) or is_ranked(" ".join(words[k:]))) for k in range(1, len(words)))


def _before_phone(what: Callable[[str], bool]) -> Callable[[str], bool]:
    def test(s: str) -> bool:
        at = re.search(r"\(?[0-9]", s)
        return bool(at) and any(what(s[:k].strip()) and is_phone(s[k:].strip()) for k in {at.start(), *(m.start() for m in re.finditer(r"\(?0[0-9]", s))})

    return test


def is_contact(s: str) -> bool:
    """A phone number, a department, or both."""
    return is_phone(s) or is_org(s) or _before_phone(is_org)(s)


SHAPES: dict[str, Callable[[str], bool]] = {
    "date": is_date, "count": is_count, "phone": is_phone, "file": is_file, "org": is_org, "name": is_name,
    "ranked": is_ranked, "staff": is_staff, "contact": is_contact, "name and phone": _before_phone(is_name),
}
#: Shapes that are metadata wherever they stand.
EVIDENT = ("date", "count", "file", "phone", "ranked")


def has_shape(s: str, shapes: tuple[str, ...]) -> bool:
    return any(SHAPES[x](s) for x in shapes)


# --- rules ----------------------------------------------------------------------


@dataclass(frozen=True)
class Notice:
    """A line of at most ``most`` characters that has one of each group of
    ``words`` and one of ``endings``; spaces and case don't matter."""

    words: tuple[tuple[str, ...], ...]
    endings: tuple[str, ...]
    most: int = 140

    def holds(self, line: str) -> bool:
        low = "".join(line.lower().split())
        return len(line) <= self.most and low.rstrip(".:：?？").endswith(self.endings) and all(any(w in low for w in group) for group in self.words)


@dataclass(frozen=True)
class Rules:
    """``labels``: label -> shapes of a value on its line, and on the line below;
    None: any.  ``files``: labels above lists of files.  ``menu``: whole lines,
    without spaces and in lower case.  ``roots``: first steps of a breadcrumb.
    ``particles``: first words of a line that continues the one before."""

    labels: dict[str, tuple[tuple[str, ...], tuple[str, ...]] | None]
    files: frozenset[str]
    menu: frozenset[str]
    notices: tuple[Notice, ...]
    roots: frozenset[str]
    particles: frozenset[str]


_BLANK = {i: " " for i in range(0x110000) if unicodedata.category(chr(i)) == "Zs"} | {9: " "}
_UNSEEN = dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF])


def split_lines(body: str | None) -> list[str]:
    """The lines of a body's text that aren't blank, their spaces squeezed."""
    from ..sources.html import parse, unescape_closed

    text = body or ""
    text = parse(text).text(blocks=True) if looks_like_markup(text) else unescape_closed(text)
    lines = (" ".join(x.split()) for x in text.translate(_BLANK | _UNSEEN).splitlines())
    return [x for x in lines if x]


#: A run of signs and separators, and whether a number comes next.
_SIGNS = re.compile(r"[.,:/~+±：–—-]+(?=(\s*[0-9])?)")
_FORMAT = dict.fromkeys(map(ord, "[]()（）〔〕【】《》「」『』｢｣\"'“”‘’`·・ㆍ;|_!?"))


def title_key(s: str | None) -> str:
    """A title's characters without spaces and format characters.  Signs and
    separators count only beside a number: right after a digit, or before one."""
    kept = _SIGNS.sub(lambda m: m[0] if m[1] or m.string[m.start() - 1 : m.start()].isdigit() else "", s or "")
    return "".join(kept.translate(_FORMAT).split())


@dataclass
class Line:
    """A line, the label it is or begins with, and whether it is noise by itself."""

    text: str
    label: str | None = None
    bare: bool = False
    noise: bool = False


def read_line(text: str, title: str, rules: Rules) -> Line:
    line = Line(text)
    head, colon, value = (x.strip() for x in re.match(r"([^:：]*)([:：]?)(.*)$", text, re.S).groups())
    if head in rules.labels:
        line.bare = not value
        shapes = rules.labels[head]
        if line.bare or shapes is None or has_shape(value, shapes[0]):
            line.label, line.noise = head, bool(colon)
    steps = [x.strip() for x in re.split("[>›》＞]", text)]
    line.noise |= (
        (len(title) > 1 and title_key(text) == title)
        or not any(c.isalnum() for c in text)
        or (len(steps) > 1 and steps[0] in rules.roots and bool(steps[1]))
        or "".join(text.lower().split()) in rules.menu
        or any(n.holds(text) for n in rules.notices)
    )
    return line


#: Noise from the front: a files label and its files, a label and its value, other noise.
FRONT = re.compile("(?:fa*|p.|n)*", re.S)
#: Noise from the back, read backwards: other noise, files and their label, a value and its label.
BACK = re.compile("(?:[nf]|[ab]+[fg]|[vb].)*", re.S)


def peel(lines: list[str], title: str | None, rules: Rules) -> list[str]:
    """The lines between the noise at both ends."""
    key = title_key(title)
    read = [read_line(x, key, rules) for x in lines]
    n = len(read)

    def goes_on(i: int) -> bool:
        """The next line continues this one."""
        return i + 1 < n and lines[i + 1].split(" ")[0] in rules.particles and " " in lines[i + 1]

    def pair(label: int, value: int, beyond: int) -> bool:
        """A line is the value of a bare label: of its shape, and evident or beside another label."""
        if not (0 <= label < n and 0 <= value < n) or not read[label].bare or read[label].label is None:
            return False
        shapes, x = rules.labels[read[label].label], read[value]
        if shapes is None or x.label is not None or x.noise or not has_shape(x.text, shapes[1]):
            return False
        return has_shape(x.text, EVIDENT) or (0 <= beyond < n and read[beyond].label is not None)

    front, back = [], []
    for i, x in enumerate(read):
        noise = x.noise or (x.bare and x.label is not None and not goes_on(i))
        files, file = x.bare and x.label in rules.files, is_file(x.text)
        if noise:
            front.append("f" if files else "p" if pair(i, i + 1, i + 2) else "n")
            back.append("f" if files else "n")
        else:
            value = pair(i - 1, i, i - 2)
            front.append("a" if file else "c")
            back.append("g" if files else "b" if file and value else "a" if file else "v" if value else "c")
    start = FRONT.match("".join(front)).end()
    end = n - BACK.match("".join(back[start:])[::-1]).end()
    return lines[start:end]


def excerpt(body: str | None, title: str | None = "", limit: int = LIMIT, rules: Rules | None = None) -> str:
    """The first ``limit`` code points of the body's content; if nothing with a
    letter or digit is left, of the unpeeled lines."""
    lines = split_lines(body)
    text = " ".join(peel(lines, title, rules or KOREAN))
    if not any(c.isalnum() for c in text):
        text = " ".join(lines)
    return text[:limit] + " …" if len(text) > limit else text


def excerpt_udf(limit: int = LIMIT, rules: Rules | None = None):
    """The excerpt as an Arrow function of (body, title)."""

    @F.pandas_udf("string")
    def run(body: pd.Series, title: pd.Series) -> pd.Series:
        return pd.Series([excerpt(b, t, limit, rules) for b, t in zip(body, title, strict=True)], dtype=object)

    return run


def excerpt_lite(body: Column | str, limit: int = LIMIT, noise: str = r"^[\s\-=_~*|]+$") -> Column:
    """An excerpt from built-in functions only: lines that match ``noise`` go from both ends."""

    def between(lines: Column, flags: Column) -> Column:
        first, last = F.array_position(flags, True), F.array_position(F.reverse(flags), True)
        n = (F.size(lines) - last - first + 2).cast("int")
        return F.when(first > 0, F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.greatest(n, F.lit(0))), " ")).otherwise(F.array_join(lines, " "))

    # Each array is bound to a variable, so that it is made once.
    bound = lambda x, f: F.transform(F.array(x), f)[0]
    kept = bound(T.lines(body), lambda lines: bound(F.transform(lines, lambda x: ~x.rlike(noise)), lambda flags: between(lines, flags)))
    return bound(kept, lambda text: T.truncate(T.squish(text), limit))


# Fixed values of the Korean boards: labels, menu words, notices, particles.
_DATES, _PEOPLE = (("date",), ("date",)), (("name", "ranked", "staff"), ("ranked", "staff", "name and phone"))
KOREAN = Rules(
    labels={
        **dict.fromkeys(("담당부서", "주관부서", "작성부서", "부서"), (("org",), ("org",))),
        **dict.fromkeys(("담당자", "작성자", "담당"), _PEOPLE),
        **dict.fromkeys(("연락처", "전화번호", "전화", "문의처", "문의"), (("contact",), ("contact",))),
        **dict.fromkeys(("등록일자", "등록일시", "등록일", "게시일자", "게시일", "작성일자", "작성일", "수정일자", "수정일", "배포일시", "배포일", "보도일시", "보도시점"), _DATES),
        **dict.fromkeys(("조회수", "조회"), (("count",), ("count",))),
        **dict.fromkeys(("첨부파일", "첨부"), (("file",), ("file",))),
        **dict.fromkeys(("제목", "이전글", "다음글")),
    },
    files=frozenset(("첨부파일", "첨부")),
    menu=frozenset(
        "목록 목록으로 목록보기 리스트 이전 다음 이전글 다음글 위로 맨위로 top 인쇄 인쇄하기 프린트 공유 공유하기 url복사 링크복사 다운로드 내려받기 미리보기 바로보기 "
        "본문바로가기 본문으로바로가기 주메뉴바로가기 메뉴바로가기 전체메뉴 홈 home 검색 닫기 트위터 페이스북 카카오톡 카카오스토리 네이버블로그 네이버밴드".split()
    ),
    notices=(
        Notice((("만족도조사", "만족도평가"),), ("만족도조사", "만족도평가"), 9),
        Notice((("만족하십니까", "만족하셨습니까", "만족하셨나요", "만족하십나"),), ("니까", "나요"), 60),
        Notice((("즉시보도", "인용하여보도", "출처를표기", "출처표기", "출처를명시", "출처를밝혀", "출처명시", "엠바고"),), ("바랍니다", "바람", "있습니다", "주십시오", "주세요", "부탁드립니다")),
        Notice((("자바스크립트", "javascript"), ("브라우저", "browser", "설정")), ("습니다", "주세요", "주십시오", "하십시오", "바랍니다", "바람")),
    ),
    roots=frozenset(("홈", "Home", "HOME", "home")),
    particles=frozenset("부터 까지 에서 으로 로서 로써 보다 처럼 마다 이라 라는 이란 이며 이고 와 과 은 는 이 가 을 를 의 에 도 만 로".split()),
)
