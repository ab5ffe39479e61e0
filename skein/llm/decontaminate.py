"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a window of tokens of which a fixed mask ignores some positions, so
windows that differ there still share its hash.  Training windows are joined to
benchmark windows on (mask, hash); wherever an overlap meets the rule one of the
seeds in it is left whole.  Around each hit the two token sequences are
laid over each other and compared position by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Masks: 1 is compared, 0 is ignored.  Fixed values: any two substitutions in WINDOW tokens leave one of these whole at some place.
MASKS = ("11101011", "11001111")
#: An overlap counts when some window of so many tokens (or the whole item, if shorter) has at least this share of equal tokens.
WINDOW, SHARE = 13, 0.8
#: Tokens of a shorter item -> equal tokens in a row that an overlap has at least; such runs are its seeds.
RUNS = {m: math.ceil(need / (m - need + 1)) for m in range(1, WINDOW) for need in [math.ceil(round(m * SHARE, 9))]}
#: Benchmarks of up to so many seeds, some 40 bytes each, are broadcast; larger ones are joined by shuffling.
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def _seeds(df: DataFrame, keep: list[str], text_col: str, runs: list[int] | None = None) -> DataFrame:
    """``keep`` columns with (hash, at): one row for each mask and window.  Items
    have the masks, or runs, of their length; documents those of any item, whose
    ``runs`` are given."""
    df = df.select(*keep, F.transform(tokens(F.col(text_col)), lambda t: F.xxhash64(t)).alias("h"))
    n = F.size("h")
    none = F.array().cast("array<struct<at:int,hash:bigint>>")

    def row(k: int, mask: str, fits: Column) -> Column:
        on = [i for i, c in enumerate(mask) if c == "1"]
        places = F.sequence(F.lit(0), n - len(mask))
        return F.when(fits, F.transform(places, lambda p: F.struct(p.alias("at"), F.xxhash64(F.lit(k), *(F.get(F.col("h"), p + i) for i in on)).alias("hash")))).otherwise(none)

    rows = [row(k, mask, n >= WINDOW) for k, mask in enumerate(MASKS)]
    for length in sorted(set(RUNS.values())) if runs is None else runs:
        fits = n.isin([m for m, r in RUNS.items() if r == length]) if runs is None else n >= length
        rows.append(row(-length, "1" * length, fits))
    return df.select(*keep, F.explode(F.concat(*rows)).alias("s")).select(*keep, "s.hash", "s.at")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``id_col``, ``item``, ``best``, ``equal``, ``of``): each document and
    benchmark item with a confirmed overlap.  ``best``: equal tokens of the best
    window; ``equal`` of ``of``: those of the whole overlap, best place first."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("t")).where("item IS NOT NULL")
    seeds = materialize(_seeds(items, ["item"], "t"), "seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    theirs = seeds.select("hash", "item", F.col("at").alias("item_at"))
    sizes = items.select(F.size(tokens(F.col("t"))).alias("m")).where(F.col("m").between(1, WINDOW - 1)).distinct().collect()
    hits = _seeds(src, ["id"], "t", sorted({RUNS[r["m"]] for r in sizes})).join(F.broadcast(theirs) if small else theirs, "hash")
    places = hits.select("id", "item", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    item_tokens = materialize(items.select("item", tokens(F.col("t")).alias("b")).withColumn("m", F.size("b")), "items")
    lengths = item_tokens.select("item", "m")
    places = places.join(F.broadcast(lengths) if small else lengths, "item")
    # A document's places hold numbers only; tokens are cut to the overlap before the item's come in.
    places = materialize(places.groupBy("id").agg(F.collect_list(F.struct("item", "offset", "m")).alias("places")), "places")
    # Always a merge join: the hits grow with the documents.
    met = src.join(places.withColumnRenamed("id", "hit").hint("merge"), F.col("id").eqNullSafe(F.col("hit")))
    met = met.select("id", tokens(F.col("t")).alias("a"), "places")
    # Where the two overlap, from the later start to the earlier end.
    skipped = lambda p: F.greatest(F.lit(0), -p["offset"])
    begin = lambda p: F.greatest(F.lit(0), p["offset"])
    length = lambda p: F.greatest(F.lit(0), F.least(p["m"] - skipped(p), F.size("a") - begin(p)))
    cut = F.transform("places", lambda p: F.struct(p["item"].alias("item"), p["m"].alias("items"), skipped(p).alias("skipped"), F.slice("a", begin(p) + 1, length(p)).alias("a")))
    met = met.select("id", F.explode(cut).alias("p")).select("id", "p.*")
    met = met.join(F.broadcast(item_tokens) if small else item_tokens, "item")
    met = met.select("id", "item", "items", F.zip_with("a", F.slice("b", F.col("skipped") + 1, F.size("a")), lambda x, y: (x == y).cast("int")).alias("same"))
    window = F.least(F.lit(WINDOW), F.col("items"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - window + 1), lambda i: F.aggregate(F.slice("same", i, window), F.lit(0), lambda s, x: s + x))
    met = met.select("id", "item", F.when(F.size("same") >= window, F.array_max(sums)).otherwise(0).alias("best"), F.aggregate("same", F.lit(0), lambda s, x: s + x).alias("equal"), F.size("same").alias("of"), window.alias("window"))
    met = met.where(F.col("best") >= F.ceil(F.col("window") * SHARE))
    met = met.groupBy("id", "item").agg(F.max(F.struct("best", "equal", "of")).alias("m"))
    return met.select(F.col("id").alias(id_col), "item", F.col("m.best").cast("long").alias("best"), F.col("m.equal").cast("long").alias("equal"), F.col("m.of").cast("long").alias("of"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``contaminated``, ``n_items``,
    ``items`` (ids in order, comma-joined), ``best`` (equal tokens of the best
    window, else 0).

    Documents and items without tokens have no hit.  Null texts
    count as empty, null item ids are ignored, rows of one id share their
    findings, and so do rows without id; so do repeated rows of an item.  Whole
    texts count, however long.  Of places with equally many equal tokens in the
    best window, that with the most in the overlap, then the longest, counts.
    Empty tables give no rows, or no findings.  Other columns are ignored.
    """
    found = overlaps(docs, benchmark, id_col, text_col, item_col, item_text)
    each = found.groupBy(F.col(id_col).alias("hit")).agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("best").alias("best"))
    out = docs.select(F.col(id_col)).join(each, F.col(id_col).eqNullSafe(F.col("hit")), "left")
    return out.select(
        id_col,
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), F.lit("")).alias("items"),
        F.coalesce("best", F.lit(0)).cast("long").alias("best"),
    )
