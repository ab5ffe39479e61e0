"""Ordered folds: packing, budgets, breakers, throttles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fold(df: DataFrame, by: str, order: str, value: str, out: str, kind: str, arrow: pa.DataType, begin: Callable[[], list], step: Callable[[list, int | None], object]) -> DataFrame:
    """(by, order, value, ``out``): ``step(state, value)`` of each row, in order of
    (order, value) within ``by``.  A group is read as a sorted stream, in one
    task, as its fold is sequential by nature; only the state is held."""
    rows = df.select(by, order, F.col(value).cast("long").alias(value))
    names = [by, order, value, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), []
        for batch in batches:
            made = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != last:
                    last, state = key, begin()
                made.append(step(state, x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=names)

    schema = StructType([*rows.schema.fields]).add(out, kind)
    return rows.repartition(by).sortWithinPartitions(by, order, value).mapInArrow(run, schema)


def greedy_batches(df: DataFrame, by: str, order: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """(by, order, batch): rows packed in order.  A batch is closed when it has
    ``most_rows`` rows or the next row would exceed ``most_size``; a row larger
    than that is a batch alone.  Batches count from 0 within ``by``.  A null
    size counts as 0."""

    def step(state: list, x: int | None) -> int:
        batch, n, used = state
        x = x or 0
        if n and (n >= max(1, most_rows) or used + x > most_size):
            batch, n, used = batch + 1, 0, 0
        state[:] = batch, n + 1, used + x
        return batch

    return _fold(df, by, order, size, "batch", "integer", pa.int32(), lambda: [0, 0, 0], step).drop(size)


def first_fit(df: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """(by, order, size, included): a row is included if its size is positive and still fits; others are passed over."""

    def step(state: list, x: int | None) -> bool:
        fits = x is not None and 0 < x <= state[0]
        state[0] -= x if fits else 0
        return fits

    return _fold(df, by, order, size, "included", "boolean", pa.bool_(), lambda: [budget], step)


def circuit_breaker(df: DataFrame, by: str, order: str, failed: Column, limit: int) -> DataFrame:
    """Adds ``attempted``: rows up to and including the first that completes a
    run of ``limit`` failures within ``by``; all of them if ``limit`` is 0."""
    if limit <= 0:
        return df.withColumn("attempted", F.lit(True))
    w = W.partitionBy(by).orderBy(order)
    out = df.withColumn("_f", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_f")).over(w))
    out = out.withColumn("_run", F.sum("_f").over(W.partitionBy(by, "_island").orderBy(order)))
    before = F.max((F.col("_run") >= limit).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("attempted", F.coalesce(before, F.lit(0)) == 0).drop("_f", "_island", "_run")


def budget_cut(df: DataFrame, by: str, order: str, cost: str, budget: float, reserve: float = 0.0) -> DataFrame:
    """Adds ``spent`` (cost of the rows before) and ``started``: whether more than ``reserve`` of the budget was left."""
    before = F.sum(cost).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    out = df.withColumn("spent", F.coalesce(before, F.lit(0)))
    return out.withColumn("started", F.lit(budget) - F.col("spent") > reserve)


def throttle_wait(df: DataFrame, by: str, order: str, seconds: Column, per_minute: int) -> DataFrame:
    """Adds ``wait``: seconds until the interval since the previous row has passed."""
    last = F.lag(seconds).over(W.partitionBy(by).orderBy(order))
    interval = 60.0 / per_minute
    return df.withColumn("wait", F.coalesce(F.greatest(F.lit(0.0), F.lit(interval) - (seconds - last)), F.lit(0.0)))


def backoff(attempt: Column, base: float, left: Column) -> Column:
    """``base * 2 ** attempt`` seconds, or null if that overruns what is left."""
    wait = F.lit(base) * F.pow(F.lit(2.0), attempt)
    return F.when(wait < left, wait)
