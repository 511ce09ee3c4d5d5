"""A progress log that a replayed batch does not change: each batch of a writer has a folder of its own, which it replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import new_folder

LOG = "job string, item string, status string, error string, tokens bigint, ts timestamp"
_FOLDERS = "writer string, batch bigint"


def log_batch(rows: DataFrame, path: str, writer: str, batch: int) -> None:
    """Write (job, item, status, error, tokens, ts) rows as a writer's batch of that number. Missing columns are null. The same batch
    written again, by a stream that restarts or a job that is tried again, stands in the log once."""
    if not writer or any(c in writer for c in "/=%:"):
        raise ValueError(f"{writer!r} names no folder")
    known = {c.lower() for c in rows.columns}
    fields = [part.split(" ") for part in LOG.split(", ")]
    shaped = rows.select(*[(F.col(name) if name in known else F.lit(None)).cast(kind).alias(name) for name, kind in fields])
    shaped.write.mode("overwrite").parquet(f"{path.rstrip('/')}/writer={writer}/batch={int(batch)}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log with ``writer`` and ``batch``."""
    return spark.read.schema(f"{LOG}, {_FOLDERS}").parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """The last row of each job and item: by time (none first), then by batch, then by writer and status."""
    last = F.max(F.struct("ts", "batch", "writer", "status", "error", "tokens"))
    return log.groupBy("job", "item").agg(last.alias("l")).select("job", "item", "l.status", "l.error", "l.tokens", "l.ts")


def compact(spark: SparkSession, path: str) -> DataFrame:
    """The latest rows, written to a folder of their own and read back; the log stays as it is, as batches may yet come again.

    What was compacted before need not be read again: pass the folder on as the log's first writer with ``log_batch``.
    """
    rows = latest(read_log(spark, path))
    folder = new_folder(spark, "progress")
    rows.write.parquet(folder)
    return spark.read.schema(LOG).parquet(folder)
