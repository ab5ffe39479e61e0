"""Personal data in DataFrame functions only: patterns propose spans, checksums
confirm them, context words nearby adjust their score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import count_kind, joined, matches, merged, spans


@dataclass(frozen=True)
class Kind:
    """A pattern with possessive repeats, so that a scan stays linear; the base
    score; what a checksum adds; and words that raise the score when nearby.
    ``base`` kinds are always reported, others from ``LEAST`` on."""

    name: str
    pattern: str
    score: float
    checked: float
    words: str
    base: bool = True


# A run may only begin where the class before it ends, or where the last match did.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, 0.0, "mail|contact|write to"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, 0.0, "ip|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.5, 0.3, "card|visa|mastercard|amex|credit|debit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.5, 0.0, "phone|call|tel|mobile|fax|cell"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.4, 0.4, "iban|account|bank|transfer|konto|cuenta|compte", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, 0.0, "ssn|social|security|insurance", False),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)
#: Code points looked at on either side, what a word there adds, and the least score of a kind that is not base.
NEAR, CONTEXT, LEAST = 48, 0.2, 0.6


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Luhn's check of a string of digits: from the right, every second digit counts double, less 9 above 9."""
    n = F.length(d)
    value = lambda i: F.substring(d, n - i + 1, F.lit(1)).cast("int")

    def step(acc: Column, i: Column) -> Column:
        double = value(i) * 2
        return acc + F.when(i % 2 == 0, double - F.when(double > 9, 9).otherwise(0)).otherwise(value(i))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0).otherwise(F.lit(False))


def mod97(s: Column) -> Column:
    """The IBAN check: the first four characters go last, letters count 10 to 35, and the number is 1 modulo 97."""
    bare = F.regexp_replace(s, "\x20", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # Leading zeros aside, three digits at most that don't exceed 255: equal lengths compare as numbers.
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    if kind == "card":
        n = F.length(digits(m))
        return F.when((n >= 14) & (n <= 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``; ``pii``, an array of (start, ord, end,
    kind, text, score) by start, then kind; and ``base``, those of the base
    kinds.  Positions are code points, ends exclusive.  A null text counts as
    empty.  Base kinds are reported whatever their score; the others from a
    score of ``LEAST`` on.  Spans of different kinds may overlap, and those with
    one start stand in the order of kinds.  A very long text is searched whole;
    repeated rows are searched each for itself.  An empty table gives no rows;
    other columns are ignored.
    """
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    for k in KINDS:
        df = matches(df, "t", k.name, k.pattern)
    df = df.select("id", "t", merged(*(spans(k.name, k.name, i, lambda m, k=k: _valid(k.name, m)) for i, k in enumerate(KINDS))).alias("found"))

    def scored(s: Column) -> Column:
        around = F.lower(F.concat(F.substring(F.col("t"), F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR))), F.lit(" "), F.substring(F.col("t"), s["end"] + 1, F.lit(NEAR))))
        score = F.lit(0.0)
        for i, k in enumerate(KINDS):
            score = F.when(s["ord"] == i, F.lit(k.score + k.checked) + F.when(around.rlike(rf"(?<![a-z])(?:{k.words})"), CONTEXT).otherwise(0.0)).otherwise(score)
        return F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

    df = df.select("id", F.when(F.size("found") > 0, F.transform("found", scored)).otherwise(F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,text:string,score:double>>)")).alias("all"))
    base = lambda s: s["ord"] < len(BASE_KINDS)
    return df.select(F.col("id").alias(id_col), F.filter("all", lambda s: base(s) | (s["score"] >= LEAST)).alias("pii"), F.filter("all", base).alias("base"))


def blanked(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with every span replaced by its label; of overlapping spans the first one's label stands."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, label(s))).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0)))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(whole)


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each finding in ``text_col`` replaced by ``<KIND>``; all other columns, rows and texts without findings stay as they are."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    found = find_pii(packed, "row", "text")
    text = blanked(F.col("row")[text_col], F.col("pii"), lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    return found.select(F.col("row"), text.alias("new")).select(*(F.col("new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract columns of a search, and the score of each span in their order."""
    return found.select(
        id_col,
        *(count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
        F.size(F.filter("pii", lambda s: s["ord"] >= len(BASE_KINDS))).cast("long").alias("n_more"),
    )
