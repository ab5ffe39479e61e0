"""Streaming novelty: batches against stored state, and stateful first-seen."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relops
from ..schema import SEEN_CAP


def _work_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skein-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def first_seen_stream(spark: SparkSession, path: str, keys: Sequence[str], order: str) -> DataFrame:
    """The earliest row, by ``order``, of each key of a Parquet table read as a
    stream: a running aggregate in the state store.  A batch writes the keys
    that it changed; of these versions the earliest counts."""
    work = _work_dir(spark)
    schema = spark.read.parquet(path).schema
    # A file source lists a folder: a table of one file is named by a pattern.
    found = path if _is_folder(spark, path) else f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).parquet(found).select(*keys, order)

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{work}/out/batch={batch}")

    q = stream.groupBy(*keys).agg(F.min(order).alias(order)).writeStream.outputMode("update").option("checkpointLocation", f"{work}/ck").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    kept = spark.read.parquet(path).select(*keys, order)
    if not _exists(spark, f"{work}/out"):
        return kept.limit(0)
    return spark.read.schema(kept.schema).parquet(f"{work}/out/batch=*").groupBy(*keys).agg(F.min(order).alias(order))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


class SeenState:
    """Seen ids as versions of a Parquet table; a version counts once its marker
    is in place, so a failed write leaves the last one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not self._fs().exists(p):
            return -1
        names = [s.getPath() for s in self._fs().listStatus(p)]
        done = [int(n.getName()[1:]) for n in names if n.getName().startswith("v") and self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
        return max(done, default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        if v < 0:
            return self.spark.createDataFrame([], "source_key string, post_id string, ord int")
        return self.spark.read.parquet(f"{self.path}/v{v}")

    def commit(self, new: DataFrame, order: str, cap: int = SEEN_CAP) -> None:
        """New ids go before the old ones, at most ``cap`` of a source."""
        old = self.read().withColumnRenamed("ord", order)
        made = relops.union_cap(new.withColumn(order, F.col(order).cast("int")), old, "source_key", "post_id", order, cap)
        made.write.mode("overwrite").parquet(f"{self.path}/v{self.version() + 1}")


def monitor_batch(state: SeenState, sink: Callable[[DataFrame, int], None], order: str = "pos", cap: int = 50, dry: bool = False) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: new posts of sources known to the state go to
    the sink, at most ``cap`` of a source; only then are all of them marked as
    seen.  A source's first batch is recorded without being sent.  Delivery is
    at least once: the sink should ignore a batch id that it has seen.  ``dry``:
    nothing is marked, so the next run sees the same posts.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = relops.first_wins(batch, ["source_key", "post_id"], [order]).persist()
        try:
            seen = state.read()
            fresh = relops.new_items(batch, seen, ["source_key", "post_id"])
            known = seen.select("source_key").distinct()
            sink(relops.newest(fresh.join(known, "source_key", "left_semi"), ["source_key"], [order, "post_id"], cap), batch_id)
            if not dry:
                state.commit(fresh.select("source_key", "post_id", order), order)
        finally:
            batch.unpersist()

    return run


def dedupe_stateful(stream: DataFrame, source: str, key: str, cap: int = SEEN_CAP) -> DataFrame:
    """(source, key) rows not seen before, with a bounded memory of each source:
    beyond ``cap`` ids the oldest are forgotten."""
    out = f"{source} string, {key} string"

    def run(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        known, new = set(held), []
        for pdf in frames:
            for k in pdf[key].tolist():
                if k not in known:
                    known.add(k)
                    new.append(k)
        state.update(((new[::-1] + held)[:cap],))
        yield pd.DataFrame({source: [group[0]] * len(new), key: new})

    return stream.select(F.col(source).cast("string"), F.col(key).cast("string")).groupBy(source).applyInPandasWithState(run, out, "seen array<string>", "append", "NoTimeout")


def eml_sink(folder: str, sender: str = "monitor@localhost") -> Callable[[DataFrame, int], None]:
    """A transport that writes a digest (subject, html) as an ``.eml`` file named by batch, so a repeated batch replaces its own."""
    from email.message import EmailMessage

    def send(df: DataFrame, batch_id: int) -> None:
        for row in df.limit(1).collect():
            m = EmailMessage()
            m["Subject"], m["From"], m["To"] = row["subject"], sender, "undisclosed-recipients:;"
            m.set_content("HTML only")
            m.add_alternative(row["html"], subtype="html")
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/digest-{batch_id}.eml", "wb") as f:
                f.write(m.as_bytes())

    return send
