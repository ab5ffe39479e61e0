"""URLs: parameters, derived ids, canonical forms, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .redact import redact_values, secret_name
from .text import col, text, utrim


def part(url: Column | str, name: str) -> Column:
    """A component; empty where there is none or the URL can't be parsed."""
    return F.coalesce(F.try_parse_url(text(url), F.lit(name)), F.lit(""))


def raw_path(url: Column | str) -> Column:
    return F.regexp_extract(text(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def raw_query(url: Column | str) -> Column:
    return F.regexp_extract(text(url), r"^[^?#]*\?([^#]*)", 1)


def param(url: Column | str, name: str, ignore_case: bool = False) -> Column:
    """The first value of a query parameter, decoded; empty if absent."""
    raw = F.regexp_extract(F.concat(F.lit("&"), raw_query(url)), rf"{'(?i)' if ignore_case else ''}&{name}=([^&]*)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def first_param(url: Column | str, names: Sequence[str]) -> Column:
    """``name:value`` of the first parameter in ``names`` with a value; null without one."""
    return F.coalesce(*(F.when(param(url, n) != "", F.concat(F.lit(f"{n}:"), param(url, n))) for n in names))


def board_id(url: Column | str, board: str, keys: Sequence[str]) -> Column:
    """An id under a board's path: a key parameter, else a number of three or
    more digits in the path; empty outside the board or without either."""
    path = raw_path(url)
    digits = F.regexp_extract(path, r"/([0-9]{3,})(?:[/?#]|$)", 1)
    found = F.coalesce(first_param(url, keys), F.when(digits != "", F.concat(F.lit("path:"), digits)), F.lit(""))
    return F.when(path.startswith(board.rstrip("/")), found).otherwise("")


def file_id(url: Column | str, keys: Sequence[str], pair: tuple[str, str], file_key: str = "file") -> Column:
    """An id by key parameter, then by a pair of parameters, then by file name, then by path."""
    base = F.element_at(F.split(param(url, file_key), "/", -1), -1)
    return F.coalesce(
        first_param(url, keys),
        F.when(param(url, pair[0]) != "", F.concat(F.lit("exam:"), param(url, pair[0]), F.lit("_"), param(url, pair[1]))),
        F.when(param(url, file_key) != "", F.concat(F.lit("file:"), base)),
        F.concat(F.lit("url:"), raw_path(url)),
    )


def field_id(fields: dict[str, Column], *hashed: Column) -> Column:
    """``name:value`` of the first non-empty field, else ``h:`` and 16 hex digits
    of the MD5 of ``hashed`` joined by ``|``; empty if the first of these is blank."""
    named = [F.when(text(v) != "", F.concat(F.lit(f"{k}:"), text(v))) for k, v in fields.items()]
    digest = F.when(text(hashed[0]) != "", F.concat(F.lit("h:"), F.substring(F.md5(F.concat_ws("|", *(text(x) for x in hashed))), 1, 16)))
    return F.coalesce(*named, digest, F.lit(""))


def canonical(url: Column | str, key: Column | str, host: str, legacy: Sequence[str], template: tuple[str, str]) -> Column:
    """``template`` around the key for a link that isn't HTTP or has a legacy path on ``host``; otherwise the link."""
    link = utrim(url)
    made = F.concat(F.lit(template[0]), text(key), F.lit(template[1]))
    dead = (F.lower(part(link, "HOST")) == host) & F.lower(raw_path(link)).isin([x.lower() for x in legacy])
    return F.when(~F.lower(link).startswith("http") | dead, made).otherwise(link)


def page_url(url: Column | str, name: str, page: Column) -> Column:
    """``url`` with parameter ``name`` set to ``page``; page 1 is the URL itself.
    Of a repeated key the last value stays, at the first one's place."""
    pairs = F.filter(F.split(raw_query(url), "&", -1), lambda x: F.instr(x, "=") > 1)
    key = lambda x: F.regexp_extract(x, "^([^=]*)=", 1)
    names = F.array_distinct(F.transform(F.concat(pairs, F.array(F.lit(f"{name}="))), key))
    value = lambda k: F.when(k == name, F.concat(k, F.lit("="), page.cast("string"))).otherwise(F.element_at(F.filter(pairs, lambda x: key(x) == k), -1))
    query = F.array_join(F.transform(names, value), "&")
    base, fragment = F.regexp_extract(text(url), r"^([^?#]*)", 1), F.regexp_extract(text(url), r"(#.*)$", 1)
    return F.when(page <= 1, text(url)).otherwise(F.concat(base, F.lit("?"), query, fragment))


def redact_params(url: Column | str, hints: Sequence[str], public: Sequence[str], mark: str = "REDACTED") -> Column:
    """Values of secret-named parameters, and secret-looking values, become a mark; names stay."""
    parts = F.filter(F.split(raw_query(url), "&", -1), lambda x: x != "")
    name = lambda x: F.regexp_extract(x, "^([^=]*)=", 1)
    value = lambda x: F.regexp_extract(x, "^[^=]*=(.*)$", 1)
    done = F.transform(parts, lambda x: F.when(F.instr(x, "=") == 0, redact_values(x, mark)).otherwise(F.concat(name(x), F.lit("="), F.when(secret_name(name(x), hints, public), F.lit(mark)).otherwise(redact_values(value(x), mark)))))
    head, fragment = F.regexp_extract(text(url), r"^([^?#]*)", 1), F.regexp_extract(text(url), r"(#.*)$", 1)
    return F.when(F.instr(text(url), "?") > 0, F.concat(redact_values(head, mark), F.when(F.size(parts) > 0, "?").otherwise(""), F.array_join(done, "&"), fragment)).otherwise(text(url))


def is_script_link(href: Column | str) -> Column:
    return F.lower(utrim(href)).startswith("javascript")


def usable(href: Column | str) -> Column:
    return (text(href) != "") & ~is_script_link(href)


def file_link(href: Column | str, hints: Sequence[str]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | F.lower(text(href)).contains(h)
    return out


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(text(c), "/", -1), -1)


def resolve_simple(base: Column | str, href: Column | str) -> Column:
    """The absolute form of absolute, scheme-relative, root-relative and plain
    relative references without dot segments."""
    b, h = text(base), text(href)
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*)?/)", 1)
    return (
        F.when(h == "", b)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("#"), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), h))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), h))
    )


def dispatch_url(base: str, *parts: Column) -> Column:
    """A path whose components are percent-encoded."""
    enc = lambda c: F.replace(F.url_encode(text(c)), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(base), F.concat_ws("/", *(enc(col(p)) for p in parts)))


def redact_attribute(value: Column | str, hints: Sequence[str], public: Sequence[str], mark: str = "REDACTED") -> Column:
    """A URL attribute: by parameter names only if it has parameters, else only by values."""
    s = text(value)
    return F.when(F.instr(s, "?") > 0, redact_params(s, hints, public, mark)).otherwise(redact_values(s, mark))


def redact_free_text(c: Column | str, hints: Sequence[str], public: Sequence[str], mark: str = "REDACTED") -> Column:
    """Text with URLs in it: each by its parameters, and the rest by values."""
    url = r"https?://[^\s\"'<>]+"
    found, between = F.regexp_extract_all(text(c), F.lit(url), F.lit(0)), F.split(text(c), url, -1)
    pairs = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(redact_params(b, hints, public, mark), F.lit(""))))
    return redact_values(F.array_join(pairs, ""), mark)


def script_endpoints(js: Column | str, ending: str = r"\.do") -> Column:
    """Quoted URL paths of a script with this ending, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text(js), F.lit(rf"[\"'](/?[A-Za-z0-9_/.-]+{ending})[\"'?]"), F.lit(1))))
