"""Ordered relational operators: dedupe, novelty, caps, scans with a boundary.

Order is part of the meaning everywhere here, so each operator takes the
columns that give it and never relies on the order of rows in a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import SEEN_CAP

Keys = Sequence[str]


def first_wins(df: DataFrame, keys: Keys, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def last_wins(df: DataFrame, keys: Keys, order: Sequence[str]) -> DataFrame:
    return first_wins(df, keys, [F.col(c).desc() for c in order])


def drop_all_duplicates(df: DataFrame, keys: Keys, valid: Column | None = None) -> DataFrame:
    """Rows whose key occurs once; a repeated key goes entirely, even if only one of its rows is valid."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").select(*keys)
    once = df.join(counted, list(keys), "left_semi")
    return once if valid is None else once.where(valid)


def new_items(df: DataFrame, seen: DataFrame, keys: Keys) -> DataFrame:
    """Rows whose key isn't in ``seen``."""
    return df.join(seen.select(*keys), list(keys), "left_anti")


def flag_seen(df: DataFrame, seen: DataFrame, keys: Keys, name: str = "seen") -> DataFrame:
    """All rows, with whether their key is in ``seen``."""
    marks = seen.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def union_cap(new: DataFrame, old: DataFrame, source: str, key: str, order: str, cap: int = SEEN_CAP) -> DataFrame:
    """Ids of a source, new ones before old ones, each once at its first place, at most ``cap``.  Adds ``ord``, from 1."""
    both = new.select(source, key, order, F.lit(0).alias("_side")).unionByName(old.select(source, key, order, F.lit(1).alias("_side")))
    each = both.groupBy(source, key).agg(F.min(F.struct("_side", order)).alias("_at"))
    ranked = each.withColumn("ord", F.row_number().over(W.partitionBy(source).orderBy("_at", key)))
    return ranked.where(F.col("ord") <= cap).select(source, key, "ord")


def newest(df: DataFrame, keys: Keys, order: Sequence[Column | str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= cap).drop("_rn")


#: Values of the order column that are ranked together.
BAND = 1 << 16


def ranked(df: DataFrame, key: str, order: str, name: str, band: int = BAND) -> DataFrame:
    """Adds ``name``, from 1: the row's place within its key by falling ``order``, a whole number.

    Bands of ``order`` are ranked each for itself, and moved by the number of
    rows in the bands above, so that a key with most of the rows is divided.
    """
    df = df.withColumn("_band", F.coalesce(F.floor(F.col(order) / band), F.lit(-(1 << 62))))
    above = F.sum("_n").over(W.partitionBy(key).orderBy(F.desc("_band")).rowsBetween(W.unboundedPreceding, -1))
    counts = df.groupBy(key, "_band").agg(F.count("*").alias("_n"))
    counts = counts.select(F.col(key).alias("_key"), F.col("_band").alias("_at"), F.coalesce(above, F.lit(0)).alias("_above"))
    df = df.withColumn("_rn", F.row_number().over(W.partitionBy(key, "_band").orderBy(F.desc(order))))
    df = df.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_band") == F.col("_at")))
    return df.withColumn(name, F.col("_rn") + F.col("_above")).drop("_band", "_rn", "_key", "_at", "_above")


def round_robin(df: DataFrame, group: str, group_order: Column | str, order: Sequence[Column | str], cap: int | None = None, name: str = "turn") -> DataFrame:
    """Rows in turn, one of each group after another: adds (``name``, group
    order) as sort keys; with ``cap`` keeps the first so many overall.

    Only rows whose turn can still be within the cap reach the single ordering
    step, ``cap`` of a group at most.
    """
    out = df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order)))
    if cap is None:
        return out
    return out.where(F.col(name) <= cap).orderBy(name, group_order).limit(cap)


def boundary_scan(posts: DataFrame, seen: DataFrame, source: str, key: str, page: str, max_pages: int, sources: DataFrame | None = None) -> DataFrame:
    """Scans pages 1, 2, ... of each source up to a boundary.

    The scan stops at an empty page, at one without an id not met before, or
    at one whose rows are all seen; a seen row among new ones doesn't stop it.
    Returns rows (source, key, page, is_new, reached, scanned): every id that
    the scan met, at its first page, whether it is new, whether the source's
    boundary was reached within ``max_pages`` and how many ids were met.
    Sources in ``sources`` without rows have none.
    """
    most = max(1, max_pages)
    marked = flag_seen(posts.where(F.col(page).between(1, most)), seen, [source, key], "_seen")
    first = F.min(page).over(W.partitionBy(source, key))
    marked = marked.withColumn("_first", first)
    each = marked.groupBy(source, page).agg(F.count_if(F.col("_first") == F.col(page)).alias("_fresh"), F.every("_seen").alias("_all"))
    # A page without rows stops the scan: the first number missing from a source's pages.
    run = each.withColumn("_gap", F.col(page) - F.row_number().over(W.partitionBy(source).orderBy(page)))
    stops = run.groupBy(source).agg(
        F.min(F.when((F.col("_fresh") == 0) | F.col("_all"), F.col(page))).alias("_stop"),
        F.max(F.when(F.col("_gap") == 0, F.col(page))).alias("_last"),
    )
    gap = F.when(F.coalesce("_last", F.lit(0)) < most, F.coalesce("_last", F.lit(0)) + 1)
    stops = stops.select(source, F.least("_stop", gap).alias("_stop"))
    met = marked.where(F.col("_first") == F.col(page)).join(stops, source)
    met = met.where(F.col(page) <= F.coalesce("_stop", F.lit(most)))
    met = met.groupBy(source, key, page).agg(F.every("_seen").alias("_seen"), F.min("_stop").alias("_stop"))
    scanned = F.count("*").over(W.partitionBy(source)).alias("scanned")
    return met.select(source, key, page, (~F.col("_seen")).alias("is_new"), F.col("_stop").isNotNull().alias("reached"), scanned)


def positional_zip(df: DataFrame, left: str, right: str, *names: str) -> DataFrame:
    """Explodes two arrays side by side up to the shorter one's end."""
    n = F.least(F.size(left), F.size(right))
    pair = F.zip_with(F.slice(left, 1, n), F.slice(right, 1, n), lambda a, b: F.struct(a.alias("label"), b.alias("value")))
    return df.select(*names, F.posexplode(pair).alias("pos", "_p")).select(*names, "pos", "_p.label", "_p.value")


def first_contained(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose key occurs in ``text``."""
    out = F.lit(default)
    for key, value in reversed(rules):
        out = F.when(text.contains(key), value).otherwise(out)
    return out
