"""SimHash fingerprints and Hamming-radius search by permuted block tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectext import column, pieces, words

BITS = 64


def fingerprints(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit fingerprints (uint64) of the rows of a UTF-8 buffer.

    A term is a word; its weight, (1 + ln tf) * min(byte length, 12), goes to
    each bit of its hash with the sign of that bit.  A text without words has 0.
    """
    out = np.zeros(len(off) - 1, np.uint64)
    for i, j in pieces(off):
        hashes, first, size = words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if a == b:
                continue
            term, at, tf = np.unique(hashes[a:b], return_index=True, return_counts=True)
            weight = (1 + np.log(tf)) * np.minimum(size[a:b][at], 12)
            bits = np.unpackbits(term.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes = 2 * (weight @ bits) - weight.sum()
            out[i + r] = np.packbits(votes > 0).view(">u8")[0]
    return out


def to_hex(values: np.ndarray) -> list[str]:
    return [f"{x:016x}" for x in values.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - Hamming distance / 64."""
    x = (a ^ b).astype(">u8").view(np.uint8).reshape(-1, 8)
    return 1 - np.unpackbits(x, axis=1).sum(1) / BITS


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and ``fingerprint`` (16 hex digits).  A null text counts as empty and has only zeros; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_hex(fingerprints(*column(batch.column(1)))), pa.string())], names=["id", "fingerprint"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def _as_long(hex_col: Column) -> Column:
    """The signed 64-bit value of 16 hex digits."""
    hi, lo = (F.conv(F.substring(hex_col, a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def _tables(value: Column, radius: int, blocks: int) -> Column:
    """Keys of the permuted block tables: two fingerprints within ``radius``
    bits agree on ``blocks - radius`` blocks at least, so on one table's key."""
    cut = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [F.shiftrightunsigned(value, cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1)) for i in range(blocks)]
    return F.array(*(F.xxhash64(F.lit(t), *(block[i] for i in chosen)) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))))


def blocks_for(rows: int, radius: int) -> int:
    """The fewest blocks, from ``radius`` + 2, whose keys have a bit for each
    doubling of the rows: unlike fingerprints then share a key about once a
    query and table, at any size."""
    for blocks in range(radius + 2, 16):
        if (blocks - radius) * BITS // blocks >= rows.bit_length():
            return blocks
    return 16


def within_radius(queries: DataFrame, table: DataFrame, fp_col: str = "fingerprint", *, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(query_fp, found_fp, distance): all pairs of a distinct fingerprint of
    ``queries`` and one of ``table`` within ``radius`` bits, each once.  Null
    fingerprints are ignored.  ``blocks`` must exceed ``radius``; without it
    their number follows from the rows of ``table``, which are counted."""
    blocks = blocks_for(table.count(), radius) if blocks is None else blocks
    if not 0 <= radius < blocks <= 16:
        raise ValueError("need 0 <= radius < blocks <= 16")

    def keyed(df: DataFrame, name: str) -> DataFrame:
        fps = df.select(F.col(fp_col).alias(name)).where(F.col(name).isNotNull()).distinct().withColumn(f"{name}_v", _as_long(F.col(name)))
        return fps.select(name, f"{name}_v", F.explode(_tables(F.col(f"{name}_v"), radius, blocks)).alias("key"))

    distance = F.bit_count(F.col("query_fp_v").bitwiseXOR(F.col("found_fp_v"))).cast("int")
    met = keyed(queries, "query_fp").join(keyed(table, "found_fp"), "key").select("query_fp", "found_fp", distance.alias("distance"))
    return met.where(F.col("distance") <= radius).distinct()
