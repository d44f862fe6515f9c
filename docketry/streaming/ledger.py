"""Job states and content dedup, in batch and as streams.

The reference behaviour is a resumable batch; the streams are an extra and keep the same states.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "running", "completed", "failed", "interrupted")


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each job with its number of events. ``events``: job_id, ts, seq, status, more columns.

    An aggregation, not a window, so that a job with very many events is combined before the shuffle.
    """
    rest = [c for c in events.columns if c != "job_id"]
    last = F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("last")
    return events.groupBy("job_id").agg(last, F.count("*").alias("attempts")).select("job_id", *(f"last.{c}" for c in rest), "attempts")


def due(ledger: DataFrame, jobs: DataFrame, outputs_intact: Column | None = None) -> DataFrame:
    """Jobs to run: not in the ledger, or not completed, or completed with another fingerprint or damaged outputs."""
    j = jobs.join(ledger.select("job_id", "status", F.col("fingerprint").alias("done")), "job_id", "left")
    fine = (F.col("status") == "completed") & F.col("done").eqNullSafe(F.col("fingerprint"))
    fine = fine if outputs_intact is None else fine & outputs_intact
    return j.where(~F.coalesce(fine, F.lit(False))).select(*jobs.columns)


def new_contents(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first row of each content hash (page_id order) that ``known`` doesn't have."""
    df = pages.withColumn("content_sha256", F.sha2(F.col("html").cast("binary"), 256))
    once = df.groupBy("content_sha256").agg(F.min_by(F.struct(*pages.columns), "page_id").alias("p")).select("content_sha256", "p.*")
    return once if known is None else once.join(known.select("content_sha256"), "content_sha256", "left_anti")


def stream_new_contents(pages: DataFrame, arrived: str | None = None, within: str = "7 days") -> DataFrame:
    """Streaming dedup on content hash; the checkpoint keeps what was seen, so a restarted query goes on.

    With ``arrived``, a column of event time, hashes are forgotten ``within`` that time after the newest, which bounds the state;
    without it everything is remembered, as a collection that must never take a page twice needs.
    """
    df = pages.withColumn("content_sha256", F.sha2(F.col("html").cast("binary"), 256))
    if arrived is None:
        return df.dropDuplicates(["content_sha256"])
    return df.withWatermark(arrived, within).dropDuplicatesWithinWatermark(["content_sha256"])


def stream_ledger(events: DataFrame) -> DataFrame:
    """Streaming state of each job, to be written in update mode."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count("*").alias("attempts"))


def stream_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by window and state with a bound on lateness."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n"))


def upsert_batch(path: str):
    """A ``foreachBatch`` function that writes each batch once, whatever is repeated: the batch's number names its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def prepare_missing(variants: DataFrame, path: str, fingerprint: str, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows prepared under a configuration's ``fingerprint``; only variants (variant_id) that have none yet are prepared.

    Each run writes a folder of its own, which counts only with the marker that Spark's committer leaves in it last: a run that stopped
    halfway is as if it had not been, its variants are prepared again, and none of its rows is read. Another configuration
    starts anew. A variant for which ``prepare`` gives no row is asked for again.
    """
    spark = variants.sparkSession
    at = f"{path.rstrip('/')}/fingerprint={fingerprint}"
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(at)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs() -> list[str]:
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{at}/run-*/_SUCCESS"))
        return sorted(f.getPath().getParent().toString() for f in found or [])

    done = runs()
    todo = variants.join(spark.read.parquet(*done).select("variant_id").distinct(), "variant_id", "left_anti") if done else variants
    if not done or not todo.isEmpty():
        prepare(todo).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{at}/run-{uuid.uuid4().hex}")
    return spark.read.parquet(*runs())
