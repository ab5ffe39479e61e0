"""JSON envelopes and model responses as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RESPONSE
from .text import first_non_empty, text, utrim


def field(j: Column | str, name: str) -> Column:
    return F.get_json_object(j, f"$.{name}")


def pick(j: Column | str, names: Sequence[str]) -> Column:
    """The first of several members that is neither null nor empty."""
    return first_non_empty(*(field(j, n) for n in names))


def envelope_rows(j: Column | str) -> Column:
    """Rows of ``{service: [{head}, {row: [...]}]}``, else of a flat ``row``."""
    nested = F.from_json(j, "map<string,array<struct<row:array<map<string,string>>>>>")
    rows = F.flatten(F.transform(F.flatten(F.map_values(nested)), lambda x: F.coalesce(x["row"], F.expr("cast(array() as array<map<string,string>>)"))))
    flat = F.from_json(j, "struct<row:array<map<string,string>>>")["row"]
    return F.when(F.size(F.coalesce(rows, F.expr("cast(array() as array<map<string,string>>)"))) > 0, rows).otherwise(F.coalesce(flat, F.expr("cast(array() as array<map<string,string>>)")))


def records(j: Column | str, names: Sequence[str] = ("data", "aaData", "list", "rows", "resultList")) -> Column:
    """The first member that is a list, as an array of JSON texts; else a top-level list; else empty."""
    none = F.expr("cast(array() as array<string>)")
    v = F.try_parse_json(text(j))
    lists = [F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names] + [F.try_variant_get(v, "$", "array<variant>")]
    return F.coalesce(*(F.transform(x, lambda y: F.to_json(y)) for x in lists), none)


def result_code(j: Column | str) -> Column:
    """``RESULT.CODE`` anywhere in a JSON text; empty if there is none."""
    return F.regexp_extract(text(j), r'"RESULT"\s*:\s*\{[^{}]*"CODE"\s*:\s*"([^"]*)"', 1)


def result_ok(code: Column, accepted: Sequence[str] = ("", "INFO-000", "INFO-200")) -> Column:
    return code.isin(list(accepted))


def response_text(j: Column | str) -> Column:
    """The joined parts of the first candidate whose text isn't blank."""
    c = F.from_json(j, RESPONSE)["candidates"]
    texts = F.transform(c, lambda x: utrim(F.array_join(F.transform(x["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "")))
    return F.coalesce(F.get(F.filter(texts, lambda t: t != ""), 0), F.lit(""))


def finish_reason(j: Column | str) -> Column:
    return F.coalesce(F.get(F.from_json(j, RESPONSE)["candidates"], 0)["finishReason"], F.lit(""))


def gate(j: Column | str) -> Column:
    """OK, SPLIT (out of tokens: halve the batch), EMPTY or FAILED."""
    reason = finish_reason(j)
    return F.when(reason == "MAX_TOKENS", "SPLIT").when(reason != "STOP", "FAILED").when(response_text(j) == "", "EMPTY").otherwise("OK")


def body_shape(body: Column | str) -> Column:
    """absent, json (an object), form (k=v pairs) or raw, with its keys or length."""
    s = text(body)
    keys = F.array_join(F.array_sort(F.json_object_keys(s)), ",")
    form = F.array_join(F.array_sort(F.transform(F.split(s, "&", -1), lambda p: F.regexp_extract(p, "^([^=]*)=", 1))), ",")
    return F.when(s == "", "absent").when(s.startswith("{") & F.json_object_keys(s).isNotNull(), F.concat(F.lit("json:"), keys)).when(s.rlike("^[^&=]+=[^&]*(?:&[^&=]+=[^&]*)*$"), F.concat(F.lit("form:"), form)).otherwise(F.concat(F.lit("raw:"), F.length(s).cast("string")))


def key_listing(j: Column | str) -> Column:
    """The names of an object's members, sorted and comma-joined; empty if it isn't one."""
    return F.coalesce(F.array_join(F.array_sort(F.json_object_keys(text(j))), ","), F.lit(""))


def names_only(j: Column | str) -> Column:
    """A JSON list of an object's member names, without any value."""
    return F.to_json(F.coalesce(F.array_sort(F.json_object_keys(text(j))), F.expr("cast(array() as array<string>)")))


def error_fields(body: Column | str) -> Column:
    """(status, message) of ``{"error": {...}}``; of a body that isn't JSON, no status and its first 200 characters."""
    s = text(body)
    json = F.try_parse_json(s).isNotNull()
    value = lambda name: F.coalesce(F.get_json_object(s, f"$.error.{name}"), F.lit(""))
    return F.struct(F.when(json, value("status")).otherwise("").alias("status"), F.when(json, value("message")).otherwise(F.substring(s, 1, 200)).alias("message"))


def metadata(body: Column | str, names: Sequence[str] = ("workflow_run_id", "run_url", "html_url")) -> Column:
    """The members of an object that are in ``names``, as text; empty for anything else."""
    made = F.from_json(F.when(text(body).rlike(r"^\s*\{"), text(body)), "map<string,string>")
    return F.map_filter(F.coalesce(made, F.expr("cast(map() as map<string,string>)")), lambda k, v: k.isin(list(names)))


def body_kind(body: Column | str, mime: Column | str) -> Column:
    """json by MIME type or by its first character, else html."""
    return F.when(F.lower(text(mime)).contains("json") | F.ltrim(text(body)).rlike(r"^[{\[]"), "json").otherwise("html")
