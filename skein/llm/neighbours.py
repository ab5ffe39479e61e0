"""Row-to-next-row computation over a global order, without one task for all.

Rows are range-partitioned and sorted; inside a partition the next row is at
hand.  The first and last row of each partition, two rows a partition, are set
aside and matched in a second small step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: pairs -> one Arrow array a declared result column.
PairFunction = Callable[[list[int | None], list[str], list[str]], list[pa.Array]]


def with_next(docs: DataFrame, compute: PairFunction, schema: str, id_col: str = "doc_id", text_col: str = "text", *, batch_bytes: int = 1 << 21) -> DataFrame:
    """One row per input row, with the columns of ``schema`` that ``compute``
    makes from (ids, texts, next texts).

    The next row is the one that follows in descending id; the last row's next
    is the first.  Null texts count as empty; null ids come last; equal ids are
    ordered by text.  A single row is its own next.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = max(int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = F.col("id").desc_nulls_last()
    names = [f.split()[0] for f in schema.split(",")]
    types = src.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def results(ids, texts, nexts) -> pa.RecordBatch:
        made = [a.cast(f.type) for a, f in zip(compute(ids, texts, nexts), arrow, strict=True)]
        m = len(ids)
        return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), *made], names=["part", "role", "edge_id", "edge_text", *names])

    def edges(rows) -> pa.RecordBatch:
        part, role, ids, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(role, pa.int32()), pa.array(ids, pa.int64()), pa.array(texts, pa.string()), *(pa.nulls(len(rows), f.type) for f in arrow)], names=["part", "role", "edge_id", "edge_text", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, head = TaskContext.get().partitionId(), None, None
        for batch in batches:
            at, size = 0, 0
            lengths = batch.column(1).to_pylist()
            ids = batch.column(0).to_pylist()
            block: list[tuple[int | None, str]] = [] if held is None else [held]
            for i, t in zip(ids, lengths, strict=True):
                if head is None:
                    head = (i, t)
                block.append((i, t))
                size += len(t)
                at += 1
                if size >= batch_bytes and len(block) > 1:
                    yield results(*zip(*((a[0], a[1], b[1]) for a, b in zip(block, block[1:], strict=False)), strict=True))
                    block, size = block[-1:], 0
            if len(block) > 1:
                yield results(*zip(*((a[0], a[1], b[1]) for a, b in zip(block, block[1:], strict=False)), strict=True))
            held = block[-1] if block else held
        if head is not None:
            yield edges([(part, 0, *head), (part, 1, *held)])

    both = materialize(
        src.repartitionByRange(n, order).sortWithinPartitions(order, F.col("text")).mapInArrow(run, f"part int, role int, edge_id long, edge_text string, {schema}"),
        "next",
        merge=False,
    )
    ends = both.where("role IS NOT NULL")
    parts = sorted(r["part"] for r in ends.where("role = 0").select("part").collect())  # one a partition
    if not parts:
        return both.where("role IS NULL").select(*names)
    follow = src.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    last = ends.where("role = 1").select("part", "edge_id", "edge_text").join(follow, "part")
    first = ends.where("role = 0").select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(compute(*(c.to_pylist() for c in b.columns)), arrow, strict=True)], names=names)

    tail = last.join(first, "next_part").select("edge_id", "edge_text", "next_text").mapInArrow(finish, schema)
    return both.where("role IS NULL").select(*names).unionByName(tail)
