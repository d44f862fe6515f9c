"""Intermediate tables in the shared folder, numbering without a sort in one task, and digests that add up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves if driver and executors are one process, as in tests; on a cluster that is
    an error.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="docketry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/docketry/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(t._settled_at)
        at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))


def _offsets(dealt: DataFrame, value: Column) -> DataFrame:
    """Sum of ``value`` over all ranges before each: as many rows as there are ranges."""
    sums = sorted((r["__p"], r.s) for r in dealt.groupBy("__p").agg(F.sum(value).alias("s")).collect())
    rows, seen = [], 0
    for p, s in sums:
        rows.append((p, float(seen)))
        seen += s or 0
    return dealt.sparkSession.createDataFrame(rows, "__p int, __from double")


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with numbers from 1 in the given order; rows are sorted in ranges, and equal rows in any order."""
    dealt = _ranges(df, order)
    nth = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return dealt.join(F.broadcast(_offsets(dealt, F.lit(1))), "__p").withColumn(name, (F.col("__from") + nth).cast("long")).drop("__p", "__from")


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row in the given order, which has to be unique."""
    dealt = _ranges(df, order)
    here = F.sum(value).over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.join(F.broadcast(_offsets(dealt, F.col(value))), "__p").withColumn(name, F.col("__from") + here).drop("__p", "__from")


def set_digest(line: Column) -> Column:
    """An aggregate: SHA-256 of the sums of four quarters of the rows' SHA-256 and of their number, so that their order doesn't matter.

    Sums combine before the shuffle; no task holds more than one row.
    """
    h = F.sha2(line.cast("binary"), 256)
    quarters = [F.sum(F.conv(F.substring(h, 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws(":", *(F.coalesce(q, F.lit("0")) for q in quarters), F.count(line).cast("string")).cast("binary"), 256)
