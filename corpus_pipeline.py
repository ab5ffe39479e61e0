"""The corpus pipeline: five stages over ``documents``, each an operator of ``skein.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, language_id, near_dedup, pii, piece_codec
from skein.llm.queries import language_model
from skein.llm.storage import materialize, new_path

#: A document without a recognised language, or recognised with less certainty, goes.
LEAST_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` but for the ids in ``gone``; a merge join at every size, as these grow with the documents."""
    return docs.join(materialize(gone.select("doc_id").distinct(), name).hint("merge"), "doc_id", "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't recognised.  The model learns from
    these documents' own labels; rows without id can't be judged and stay."""
    said = language_id.predict(docs, language_model(docs))
    gone = said.where((F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LEAST_SCORE))
    return without(docs, gone, "unrecognised")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the smallest id; of repeated rows of an id one stays."""
    found = near_dedup.near_duplicates(docs)
    twice = materialize(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    rest = without(docs, found.where("NOT kept"), "duplicates")
    if twice.isEmpty():
        return rest
    one = rest.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.join(twice, "doc_id", "left_anti").unionByName(one).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate.overlaps(docs, benchmark), "contaminated")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by ``<KIND>`` and counts the characters anew."""
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document: doc_id, n_tokens, ids, lossless."""
    import public_tokenizers

    made = piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", "n_tokens", "ids", "lossless")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("pieces", encode_pieces),
]

#: SQL can't express the trained model, MinHash and merge-dropout stages: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
