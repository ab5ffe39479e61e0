"""Text functions as column expressions.

Java's ``\\s`` is ASCII; ``WS`` is the Unicode white space that Python strips.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, and the same as RE2 writes it.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: File extensions and their types.  Fixed values.
MIME = {
    "pdf": "application/pdf", "zip": "application/zip", "txt": "text/plain", "csv": "text/csv", "html": "text/html",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "doc": "application/msword",
    "json": "application/json", "xml": "text/xml",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null is the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def utrim(c: Column | str) -> Column:
    return F.regexp_replace(text(c), rf"^{WS}+|{WS}+$", "")


def squish(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text(c), rf"{WS}+", " "))


def clean(c: Column | str) -> Column:
    """Horizontal white space becomes one space, three or more line ends two; trimmed."""
    s = F.regexp_replace(text(c), r"[ \t\r\f\x0B]+", " ")
    return utrim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def truncate(c: Column | str, limit: int, mark: str = " …") -> Column:
    """Cut to ``limit`` code points, with a mark, only if longer."""
    s = text(c)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit(mark))).otherwise(s)


def preview(c: Column | str, limit: int) -> Column:
    return F.substring(text(c), 1, limit)


def html_escape(c: Column | str) -> Column:
    s = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(text(c), "[^A-Za-z0-9_.-]", "_")


def bare(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(text(c), rf"{WS}+", "")


def nav_key(c: Column | str) -> Column:
    return F.lower(bare(c))


def short_label(c: Column | str, most: int = 6) -> Column:
    """A cleaned label without its colon, or empty if longer than ``most``."""
    s = F.regexp_replace(clean(c), rf"(?:[:：]|{WS})+$", "")
    return F.when(F.length(s) <= most, s).otherwise("")


def unfence(c: Column | str) -> Column:
    """Without a Markdown code fence, closed or not."""
    s = utrim(c)
    inner = F.when(F.instr(s, "\n") > 0, F.regexp_replace(s, r"^[^\n]*\n", "")).otherwise("")
    inner = F.regexp_replace(inner, rf"{WS}+$", "")
    return F.when(s.startswith("```"), utrim(F.regexp_replace(inner, "```$", ""))).otherwise(s)


def strip_list_marker(c: Column | str) -> Column:
    """Without a leading bullet or number.  A dash counts only before a space, so signs stay."""
    return F.regexp_replace(text(c), rf"^(?:[-–—]+{WS}+|[•*·▪◦]+{WS}*|\(?[0-9]{{1,2}}[.)]{WS}+)", "")


def strip_file_size(c: Column | str) -> Column:
    """Without a trailing size such as ``(1.2 MB)``."""
    return utrim(F.regexp_replace(text(c), r"[\s]*[\[(]?[\s]*[0-9.,]+[\s]*[KMGkmg]?[Bb][\s]*[\])]?[\s]*$", ""))


def agency(c: Column | str) -> Column:
    """What stands before the middle dot of a source's name."""
    return F.trim(F.split_part(text(c), F.lit("·"), F.lit(1)))


def split_list(c: Column | str, separators: str = "[,;]") -> Column:
    return F.filter(F.transform(F.split(text(c), separators, -1), lambda x: F.trim(x)), lambda x: x != "")


def mime(c: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(text(c), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in MIME.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def flatten_spaces(c: Column | str) -> Column:
    """Other spaces become U+0020, zero-width characters go."""
    s = F.regexp_replace(text(c), "[   -   　]", " ")
    return F.regexp_replace(s, "[​-‏⁠﻿]", "")


def lines(c: Column | str) -> Column:
    """Squished, non-blank lines, split where Python's ``splitlines`` splits."""
    parts = F.split(flatten_spaces(c), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    return F.filter(F.transform(parts, lambda x: utrim(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != "")


def meaningful(c: Column | str) -> Column:
    return text(c).rlike("[0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣ一-龥]")


def first_non_empty(*cs: Column | str) -> Column:
    """The first value that is neither null nor empty, as text; else empty."""
    return F.coalesce(*(F.nullif(col(c).cast("string"), F.lit("")) for c in cs), F.lit(""))


def titled(name: Column, proposer: Column) -> Column:
    return F.when(text(proposer) != "", F.concat(text(name), F.lit(" ("), text(proposer), F.lit(")"))).otherwise(text(name))


def breadcrumb(c: Column | str, root: str) -> Column:
    return text(c).rlike(rf"^(?:{root})\s*[>›》＞]\s*\S")


def decoration(c: Column | str) -> Column:
    return text(c).rlike(r"^[\s\-=_~*·・ㆍ‧∙•▪◦□■○●◇◆※☞▶▷─━│┃═╌┄]+$")
