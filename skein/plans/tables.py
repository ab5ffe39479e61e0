"""Driver tables read as the monitoring data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relops import ranked

#: Rows of a listing page; ids with ``doc_id % 5`` below this are seen already.
PAGE, SEEN_BELOW = 10, 3

#: The same for DuckDB: posts with page and pos, and the seen set.
POSTS_SQL = f"""
posts AS (
    SELECT source AS source_key, doc_id, text, n_chars, lang,
           row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS pos,
           (row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1) // {PAGE} + 1 AS page
    FROM documents
)"""
SEEN_SQL = f"seen AS (SELECT source AS source_key, doc_id FROM documents WHERE doc_id % 5 < {SEEN_BELOW})"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def posts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents as posts, newest (largest id) first within a source, in pages of ``PAGE``."""
    df = read(spark, sf_dir, "documents", "source", "doc_id", *columns).withColumnRenamed("source", "source_key")
    df = ranked(df, "source_key", "doc_id", "pos")
    return df.withColumn("page", F.floor((F.col("pos") - 1) / PAGE).cast("int") + 1)


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents", "source", "doc_id")
    return df.where(F.col("doc_id") % 5 < SEEN_BELOW).withColumnRenamed("source", "source_key")
