"""Shared folders, table access and digests used by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as the contracts spell them.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between Spark and Python; texts of any length then need little memory beside their own.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches of this session to BATCH_BYTES, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder is made and kept for the
    life of the session if driver and executors are one process, as in tests; on a cluster that is an error.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="docketry-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/docketry/{name}-{uuid.uuid4().hex}"


def trimmed(run):
    """``run`` of mapInArrow that hands freed memory back to the machine at its end.

    Python workers live on for other tasks, and the C library keeps what large arrays have freed.
    """

    def wrapped(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage; see ``discard``."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables once nothing reads them any more.

    Spark deletes the shuffle files behind them once the JVM has collected their plans, so it is asked to.
    """
    for t in tables:
        drop_path(t.sparkSession, t._settled_at)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.java.lang.System.gc()


#: Keys with more than one row in so many are spread by ``spread_join``: there are fewer such keys than this.
COMMON = 1000


def spread_join(rows: DataFrame, of_key: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``of_key`` (one row for each ``key``) in which no task gathers the rows of a common key.

    Keys with more than 1 / COMMON of all rows (``total``, if known) are counted with partial sums. Their rows are dealt by a
    further hash, as many ways as they have such shares, and what ``of_key`` says of them is copied as often: fewer than
    2 COMMON copies in all. The only thing broadcast are these keys, fewer than COMMON.
    """
    share = (rows.count() if total is None else total) / COMMON + 100
    common = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > share).select(F.col(key).alias("__of"), F.ceil(F.col("__n") / share).alias("__ways"))
    common = settle(common, "common")
    if common.isEmpty():
        discard(common)
        return rows.join(of_key, key)
    marked = [t.join(F.broadcast(common), F.col(key) == F.col("__of"), "left").drop("__of").withColumn("__ways", F.coalesce("__ways", F.lit(1))) for t in (rows, of_key)]
    dealt = marked[0].withColumn("__way", F.pmod(F.xxhash64(*rows.columns), "__ways")).drop("__ways")
    copied = marked[1].withColumn("__way", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__ways") - 1))).drop("__ways")
    return dealt.join(copied, [key, "__way"]).drop("__way")


def crc_bucket(column: str, buckets: int):
    """crc32 of the decimal text of an integer column, modulo ``buckets``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(buckets))
