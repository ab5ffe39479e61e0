"""Driver queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, decontaminate, language_id, near_dedup, neighbours, pii, piece_codec, secret_scan, simhash, token_counts, toxicity
from .storage import materialize
from .vectext import column


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.pages_through_archives(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def _compare(ids: list[int | None], texts: list[str], nexts: list[str]) -> list[pa.Array]:
    """Fingerprints of texts and their edited forms, and likenesses."""
    edited = []
    for a, b in zip(texts, nexts, strict=True):
        k = len(a) // 3
        edited.append(a[: len(a) - k] + b[:k])
    own, other, after = (simhash.fingerprints(*column(pa.array(x, pa.large_string()))) for x in (texts, edited, nexts))
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(simhash.to_hex(own)),
        pa.array(simhash.to_hex(other)),
        pa.array(np.asarray(simhash.likeness(own, other), float)),
        pa.array(np.asarray(simhash.likeness(own, after), float)),
    ]


#: Hamming radius of op4's search.
RADIUS = 3


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns, ``n_within``: for ids divisible by 20,
    the other documents within ``RADIUS`` bits; null for the rest."""
    docs = _table(spark, sf_dir, "documents")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    prints = materialize(neighbours.with_next(docs, _compare, schema), "prints")
    asked = prints.where("doc_id % 20 = 0")
    size = materialize(prints.groupBy("fingerprint").agg(F.count("*").alias("n")), "sizes")
    near = simhash.within_radius(asked, size, radius=RADIUS)
    near = near.join(size.withColumnRenamed("fingerprint", "found_fp"), "found_fp").groupBy(F.col("query_fp").alias("fingerprint")).agg((F.sum("n") - 1).alias("n_within"))
    near = materialize(near, "near")
    return prints.join(near, "fingerprint", "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.when(F.col("doc_id") % 20 == 0, F.col("n_within")).alias("n_within"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    known = docs.select("doc_id", "text").join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    chain = toxicity.train(known, "text", {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}, F.col("doc_id"))
    out = toxicity.predict(docs, chain)
    if chain is None:  # nothing to learn from
        return out.select("doc_id", F.lit(None).cast("double").alias("p_low_quality"), F.lit(None).cast("double").alias("p_toxic"), F.lit(False).alias("toxic"))
    return out.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.col("is_toxic").alias("toxic"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = piece_codec.encode(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))
    return made.select("doc_id", "n_tokens", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ids_sha256"), "lossless")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> language_id.LanguageModel | None:
    learn = docs.where(~_held_out() & F.col("doc_id").isNotNull())
    return language_id.train(learn, "text", "lang", F.col("doc_id"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_model(docs))
    return out.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_secrets, op2_warc, op3_near_dedup, op4_fingerprints, op5_token_counts, op6_toxicity, op7_pieces, op8_decontamination, op9_language_id, op10_pii)
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
