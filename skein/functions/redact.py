"""Redaction of secret names and values as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

#: Name fragments of secrets, and names that are public whatever they contain.  Fixed values.
HINTS = ("csrf", "xsrf", "token", "session", "jsessionid", "wmonid", "auth", "secret", "passwd", "password", "nonce", "sid")
PUBLIC = ("billid", "bill_id", "billno", "agefrom", "ageto", "age", "tabnm")
#: Values that look secret: session ids, long hex runs, resident numbers, mobile numbers, e-mail addresses.  Fixed values.
PATTERNS = (
    r"(?i)JSESSIONID=[^;\"'\s&?]+",
    r"(?i)WMONID=[^;\"'\s&?]+",
    r"(?i)\b[0-9a-f]{32,}\b",
    r"\b[0-9]{6}-[1-4][0-9]{6}\b",
    r"\b01[016789]-?[0-9]{3,4}-?[0-9]{4}\b",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
)


def redact_values(c: Column | str, mark: str = "REDACTED", patterns: Sequence[str] = PATTERNS) -> Column:
    s = text(c)
    for p in patterns:
        s = F.regexp_replace(s, p, mark)
    return s


def secret_name(c: Column | str, hints: Sequence[str] = HINTS, public: Sequence[str] = PUBLIC) -> Column:
    low = F.lower(F.trim(text(c)))
    hit = F.lit(False)
    for h in hints:
        hit = hit | low.contains(h)
    return ~low.isin(list(public)) & hit


def redact_map(m: Column, mark: str = "REDACTED", hints: Sequence[str] = HINTS, public: Sequence[str] = PUBLIC) -> Column:
    """A header map: values of secret names become a mark, others are redacted by pattern."""
    return F.transform_values(m, lambda k, v: F.when(secret_name(k, hints, public), F.lit(mark)).otherwise(redact_values(v, mark)))


def _secret(name: str, hints: Sequence[str], public: Sequence[str]) -> bool:
    low = name.strip().lower()
    return low not in public and any(h in low for h in hints)


def redact_har(value: object, mark: str = "REDACTED", hints: Sequence[str] = HINTS, public: Sequence[str] = PUBLIC) -> object:
    """A HAR log, or any part of one: cookies go, values of secret-named pairs
    become a mark, so do secret parameters of URLs, and texts are redacted by
    their kind: JSON by member, else by pattern (for Arrow functions)."""
    redact = lambda x: redact_har(x, mark, hints, public)

    def url(s: str) -> str:
        head, q, query = s.partition("?")
        pairs = [k + "=" + (mark if _secret(k, hints, public) else v) if e else k for k, e, v in (x.partition("=") for x in query.split("&"))]
        return plain(head + q + "&".join(pairs))

    def plain(s: str) -> str:
        for p in PATTERNS:
            s = re.sub(p, mark, s)
        return s

    def body(s: str) -> str:
        try:
            return json.dumps(redact_json(json.loads(s), mark, hints, public), ensure_ascii=False)
        except ValueError:
            return plain(s)

    if isinstance(value, list):
        return [redact(x) for x in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for k, v in value.items():
        if k == "cookies":
            out[k] = []
        elif k in ("url", "redirectURL") and isinstance(v, str):
            out[k] = url(v)
        elif k == "text" and isinstance(v, str):
            out[k] = body(v)
        elif k == "value" and isinstance(v, str):
            out[k] = mark if _secret(str(value.get("name", "")), hints, public) else plain(v)
        else:
            out[k] = redact(v)
    return out


def redact_json(value: object, mark: str = "REDACTED", hints: Sequence[str] = HINTS, public: Sequence[str] = PUBLIC) -> object:
    """A JSON value with secret-named members masked at any depth (for Arrow functions)."""

    if isinstance(value, dict):
        return {k: mark if _secret(k, hints, public) else redact_json(v, mark, hints, public) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_json(v, mark, hints, public) for v in value]
    return value
