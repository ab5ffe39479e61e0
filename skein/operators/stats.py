"""Run statistics, outage flags and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detail_stats(df: DataFrame, source: str, outcome: str) -> DataFrame:
    """Attempts, successes, pending and failures: overall (null source) and for each source in one pass.  Pending comes before success."""
    df = df.select(source, F.col(outcome).alias("_o"))
    agg = df.rollup(source).agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("_o") == "ok").alias("succeeded"),
        F.count_if(F.col("_o") == "pending").alias("pending"),
        F.grouping(source).alias("_all"),
    )
    out = agg.withColumn("failed", F.col("attempted") - F.col("succeeded") - F.col("pending"))
    return out.select(F.when(F.col("_all") == 1, "*").otherwise(F.col(source)).alias(source), "attempted", "succeeded", "pending", "failed")


def outage(attempted: Column, succeeded: Column, pending: Column) -> Column:
    """ERROR if nothing succeeded though something that isn't pending was tried."""
    return F.when((succeeded == 0) & (attempted - pending > 0), "ERROR").otherwise("OK")


def strict_outage(attempted: Column, succeeded: Column, pending: Column, failed: Column) -> Column:
    """ERROR if neither success nor pending came of any attempt, WARN if some failed."""
    return F.when((attempted > 0) & (succeeded == 0) & (pending == 0), "ERROR").when(failed > 0, "WARN").otherwise("OK")


def top_first(df: DataFrame, name: str, count: str, order: str) -> DataFrame:
    """The name of largest count, the first in order among equals; and how many others there are."""
    return df.agg(F.max_by(name, F.struct(F.col(count), -F.col(order))).alias("top"), F.max(count).alias("top_n"), (F.count("*") - 1).alias("others"))


def ai_stats(df: DataFrame, target: Column, summarised: Column) -> DataFrame:
    return df.agg(F.count_if(target).alias("targets"), F.count_if(summarised).alias("summarised")).withColumn("fallback", F.greatest(F.col("targets") - F.col("summarised"), F.lit(0)))
