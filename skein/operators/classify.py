"""Classification: probes, status decisions, labels, precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import text, utrim
from ..schema import AVAILABLE, ERROR, PENDING

#: Code points from which a container's text counts as a body.
BODY = 20
RANK = {"MISSING": 0, "UNEXPECTED": 1, "EMPTY": 2, "FOUND": 3}


def probe(present: Column, length: Column) -> Column:
    """FOUND, EMPTY, UNEXPECTED (too short) or MISSING."""
    return F.when(~present, "MISSING").when(length >= BODY, "FOUND").when(length == 0, "EMPTY").otherwise("UNEXPECTED")


def rank(p: Column) -> Column:
    out = F.lit(0)
    for name, r in RANK.items():
        out = F.when(p == name, r).otherwise(out)
    return out


def followup_probe(has_pre: Column, pre_len: Column, has_section: Column, has_marker: Column, missing_shell: Column) -> Column:
    """The verdict on a follow-up response.

    A body in its place within the section is FOUND if long enough.  No body,
    no section and no marker in an intact shell means nothing was registered
    yet: EMPTY.  Everything else is UNEXPECTED.
    """
    return (
        F.when(has_pre & has_section & (pre_len >= BODY), "FOUND")
        .when(~has_pre & ~has_section & ~has_marker & (F.size(missing_shell) == 0), "EMPTY")
        .otherwise("UNEXPECTED")
    )


def identity(key: Column, *claims: Column) -> Column:
    """MISMATCH if any non-empty claim differs from the key, CONFIRMED if one equals it, else UNCONFIRMED."""
    said = F.filter(F.array(*(text(c) for c in claims)), lambda x: x != "")
    return F.when(F.exists(said, lambda x: x != key), "MISMATCH").when(F.size(said) > 0, "CONFIRMED").otherwise("UNCONFIRMED")


def not_found(html: Column, markers: Sequence[str]) -> Column:
    bare = F.regexp_replace(text(html), r"[\s\p{Z}]+", "")
    out = F.lit(False)
    for m in markers:
        out = out | bare.contains(m)
    return out


def status(missing: Column, ident: Column, inline: Column, buildable: Column, later_missing: Column, later: Column) -> Column:
    """AVAILABLE, PENDING or ERROR, by the order of the checks."""
    return (
        F.when(missing | (ident == "MISMATCH"), ERROR)
        .when(inline == "FOUND", F.when(ident == "CONFIRMED", AVAILABLE).otherwise(ERROR))
        .when(~buildable | later_missing, ERROR)
        .when(later == "FOUND", AVAILABLE)
        .when(later == "EMPTY", PENDING)
        .otherwise(ERROR)
    )


def all_or_none(names: Sequence[str], values: Sequence[Column]) -> Column:
    """(label, value) rows if every value is non-empty, else none."""
    fine = F.lit(True)
    for v in values:
        fine = fine & (text(v) != "")
    rows = F.array(*(F.struct(F.lit(n).alias("label"), text(v).alias("value")) for n, v in zip(names, values, strict=True)))
    return F.when(fine, rows).otherwise(F.expr("cast(array() as array<struct<label:string,value:string>>)"))


def block(details: Column, summary: Column, body: Column, pending: Column) -> Column:
    """Which block a card shows: details before summary, body, the notice of a pending text, nothing."""
    return F.when(F.size(details) > 0, "details").when(F.size(summary) > 0, "summary").when(utrim(body) != "", "body").when(pending, "pending").otherwise("none")


def valid_lines(lines: Column, n: int, most: int) -> Column:
    """Exactly ``n`` lines, each with content and at most ``most`` code points once squished."""
    squished = lambda x: F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " "))
    return F.coalesce((F.size(lines) == n) & F.forall(lines, lambda x: x.isNotNull() & x.rlike("[0-9A-Za-z가-힣一-龥]") & (F.length(squished(x)) <= most)), F.lit(False))


def retryable(code: Column) -> Column:
    return code.isin(429, 500, 502, 503, 504)


def model_gone(code: Column, reason: Column, message: Column, fragments: Sequence[str]) -> Column:
    """Whether another model should be tried: never for authentication, quota or server errors."""
    hit = F.lit(False)
    for f in fragments:
        hit = hit | F.lower(text(message)).contains(f)
    return F.when(code.isin(401, 403, 429) | (code >= 500), False).otherwise((code == 404) | (reason == "NOT_FOUND") | hit)


def verdict(any_error: Column, any_ok: Column, sampled: Column) -> Column:
    """OK, PARTIAL or FAIL for a source: without rows or without a good one it fails."""
    return F.when((sampled == 0) | ~any_ok, "FAIL").when(any_error, "PARTIAL").otherwise("OK")
