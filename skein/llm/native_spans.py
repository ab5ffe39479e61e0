"""Matches of a pattern with code-point positions, from built-in functions.

``regexp_extract_all`` gives the matches of a pattern and ``split`` the text
between them; both scan alike, so their lengths add up to the positions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,ord:int,end:int,kind:string,text:string>"


def matches(df: DataFrame, text_col: str, name: str, pattern: str) -> DataFrame:
    """Adds ``<name>_m``, the matches, and ``<name>_g``, what lies between them (null without a match).  The pattern must not match the empty string."""
    df = df.withColumn(f"{name}_m", F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)))
    return df.withColumn(f"{name}_g", F.when(F.size(f"{name}_m") > 0, F.split(text_col, pattern, -1)))


#: Matches folded together; a fold copies what it has gathered, so it is kept short.
BLOCK = 64


def spans(name: str, kind: str, order: int, valid: Callable[[Column], Column]) -> Column:
    """The spans of the matches that ``valid`` accepts, in order; an empty array
    without any.  Blocks of matches are folded first, then the blocks, so the
    work grows with the number of matches and not with its square."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    pair = F.zip_with(F.slice(f"{name}_g", 1, F.size(f"{name}_m")), f"{name}_m", lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.length(x["m"])
        one = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("text"))
        return F.struct(end.alias("at"), F.when(valid(x["m"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def shift(acc: Column, x: Column) -> Column:
        moved = F.struct(acc["at"].alias("by"), x["out"].alias("out"))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def move(x: Column) -> Column:
        return F.transform(x["out"], lambda s: F.struct((s["start"] + x["by"]).alias("start"), s["ord"].alias("ord"), (s["end"] + x["by"]).alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))

    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<by:int,out:array<{SPAN}>>>)").alias("out"))
    blocks = F.transform(F.sequence(F.lit(1), F.size(pair), F.lit(BLOCK)), lambda i: fold(F.slice(pair, i, F.lit(BLOCK))))
    long = F.flatten(F.transform(F.aggregate(blocks, start, shift, lambda acc: acc["out"]), move))
    short = F.size(f"{name}_m") <= BLOCK
    return F.when(F.size(f"{name}_m") == 0, none).when(short, fold(pair)["out"]).otherwise(long)


def merged(*arrays: Column) -> Column:
    """All spans by start, then kind order."""
    return F.array_sort(F.concat(*arrays))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
