"""Source snapshots as a stream: facts of files as they arrive, the latest version of each kept.

The engine behind the verbs is a batch engine; this is the same fact
extraction under Structured Streaming for a feed of (path, text, version).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeweave.plans.facts import facts


def latest(files: DataFrame) -> DataFrame:
    """The row of the highest version of each path."""
    rest = [c for c in files.columns if c not in ("path", "version")]
    best = files.groupBy("path").agg(F.max(F.struct("version", *rest)).alias("r"))
    return best.select("path", *(F.col(f"r.{c}").alias(c) for c in ("version", *rest))).select(*files.columns)


def stream_facts(files: DataFrame, table_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the facts of each micro-batch of ``files`` (path, text, version) to a Parquet table, batch by batch.

    A batch overwrites only its own folder, so one that runs again after a
    failure leaves no rows twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = latest(batch)
        rows = facts(newest).join(newest.select("path", "version"), "path")
        rows.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_facts(stored: DataFrame) -> DataFrame:
    """Facts of the newest version of each path among all batches."""
    newest = stored.groupBy("path").agg(F.max("version").alias("version"))
    return stored.join(newest, ["path", "version"], "left_semi")
