"""Secret scan in DataFrame functions only.

Pattern rules propose assignments, access keys and long hex runs.  Besides
them, every run of token characters is a candidate: a window slides over it and
the Shannon entropy of its character class is kept up to date from counts, as
one character enters and one leaves.  Candidates on the allow-list are
suppressed; pattern findings stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import joined, matches, merged, spans

#: Pattern rules.  The hex and access rules scan whole runs of the class, whose lengths the rules ask for anyway.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
BASE_KINDS = ("assign", "access", "hex")
ENTROPY = "entropy"
#: A run of token characters of the least length looked at.
RUN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+"


@dataclass(frozen=True)
class EntropyClass:
    """A character class, the window's length, and the least entropy in bits of a window that counts."""

    name: str
    pattern: str
    window: int
    least: float


#: From narrow to wide; a candidate belongs to the first class that holds all of it.
CLASSES = (
    EntropyClass("hex", "^[0-9a-fA-F]+$", 20, 3.0),
    EntropyClass("alnum", "^[A-Za-z0-9]+$", 20, 3.6),
    EntropyClass("base64", "^[A-Za-z0-9+/=_-]+$", 20, 3.7),
)
#: Candidates that match one of these are no secrets: placeholders, UUIDs, path-like or hyphenated words, dates and numbers.
ALLOW = (
    "(?i)example|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9_+/=-]+$",
    "^[/=_-]*+[A-Za-z]++[0-9]{0,4}+(?:[/=_-]++[A-Za-z]*+[0-9]{0,4}+)*+$",
)


#: Codes from the first to the last character of a candidate; a window has fewer characters than this.
FIRST, LAST, MOST = 43, 122, 32
#: Bits of a count, counts in a long, and longs.
BITS = MOST.bit_length() - 1
PER_LONG = 63 // BITS
LONGS = -(-(LAST - FIRST + 1) // PER_LONG)


def window_entropy(s: Column, window: Column) -> Column:
    """The largest Shannon entropy, in bits, of a window of ``window`` (below
    ``MOST``) characters of codes ``FIRST`` to ``LAST`` sliding over ``s`` (of
    all of ``s`` if it is shorter).

    The fold holds the counts of the window's characters, packed into a few
    longs, and the sum of c * log2(c); a step changes both for the two
    characters that move.
    """
    size = F.least(F.length(s), window)
    bits = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)
    leaving = F.slice(F.concat(F.array_repeat(F.lit(-1), size), codes), 1, F.length(s))
    place = lambda c: F.floor(c / PER_LONG).cast("int")
    shift = lambda c: c % PER_LONG * BITS
    moves = F.zip_with(codes, leaving, lambda a, b: F.struct(a.alias("into"), place(a).alias("at"), shift(a).alias("by"), b.alias("out"), place(b).alias("out_at"), shift(F.greatest(b, F.lit(0))).alias("out_by")))
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)
    count = lambda counts, at, by: F.call_function("shiftright", F.get(counts, at), by).bitwiseAND(F.lit(MOST - 1).cast("long")).cast("int")

    def step(acc: Column, x: Column) -> Column:
        n, size = acc["n"] + 1, acc["size"]  # out is -1 until the window is full
        a = count(acc["counts"], x["at"], x["by"])
        b = F.when(x["out"] >= 0, count(acc["counts"], x["out_at"], x["out_by"])).otherwise(F.lit(0))
        same = x["into"] == x["out"]
        total = F.when(same, acc["sum"]).otherwise(acc["sum"] + bits(a + 1) - bits(a) + bits(b - 1) - bits(b))
        none = F.lit(0).cast("long")
        moved = F.transform(acc["counts"], lambda c, k: c + F.when(k == x["at"], one(x["by"])).otherwise(none) - F.when(k == x["out_at"], one(x["out_by"])).otherwise(none))
        entropy = F.when(n >= size, F.log2(size) - total / size).otherwise(F.lit(0.0))
        return F.struct(size.alias("size"), n.alias("n"), F.when(same, acc["counts"]).otherwise(moved).alias("counts"), total.alias("sum"), F.greatest(acc["best"], entropy).alias("best"))

    # What depends on all of the run is evaluated once, here, and not in each step.
    start = F.struct(size.alias("size"), F.lit(0).alias("n"), F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(moves, start, step, lambda acc: acc["best"])


def is_secret(s: Column) -> Column:
    """A candidate with a digit and a letter, off the allow-list, one of whose windows reaches its class's entropy."""
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | s.rlike(pattern)
    least, window = F.lit(99.0), F.lit(1)
    for c in reversed(CLASSES):
        own = s.rlike(c.pattern)
        least, window = F.when(own, F.lit(c.least)).otherwise(least), F.when(own, F.lit(c.window)).otherwise(window)
    return F.when(mixed & ~allowed, window_entropy(s, window) >= least).otherwise(F.lit(False))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``; ``secrets``, an array of (start, ord,
    end, kind, text) by start, then kind (assign, access, hex, entropy); and
    ``base``, those of the pattern rules.  Positions are code points, ends are
    exclusive.  A null text counts as empty and has no secrets; an entropy
    finding that lies within a pattern finding is not repeated.  Findings of
    different kinds may overlap; those with one start stand in the order of
    kinds.  A very long text is scanned whole, repeated rows each for itself.
    An empty table gives no rows; other columns are ignored.
    """
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", RUN)):
        df = matches(df, "t", name, pattern)
    df = df.select(
        "id",
        merged(
            spans("assign", "assign", 0, lambda m: F.length(F.regexp_replace(m, ASSIGN_HEAD, "")) >= 6),
            spans("access", "access", 1, lambda m: F.length(m) >= 20),
            spans("hex", "hex", 2, lambda m: F.length(m) >= 24),
        ).alias("base"),
        spans("run", ENTROPY, 3, is_secret).alias("more"),
    )
    new = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    return df.select(F.col("id").alias(id_col), merged(F.col("base"), new).alias("secrets"), "base")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` rows' ids with ``text_col`` in which each finding is ``<SECRET>``; overlapping findings are one."""
    found = scan_secrets(docs.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("row"), F.col(text_col).alias("text")), "row", "text")
    from .pii import blanked

    return found.select(F.col("row.id").alias(id_col), blanked(F.col("row.text"), F.col("secrets"), lambda s: F.lit("<SECRET>")).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract columns of a scan."""
    from .native_spans import count_kind

    return found.select(
        id_col,
        *(count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count_kind(F.col("secrets"), ENTROPY).alias("n_entropy"),
    )
