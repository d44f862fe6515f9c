"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, settle, spread_join, trimmed


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by a star for each of its components."""
    for b in batches:
        up: dict[int, int] = {}

        def top(x: int, up: dict[int, int] = up) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                up[max(u, v)] = min(u, v)
        pairs = [(x, top(x)) for x in up if top(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (its first two columns, longs); component is the smallest node.

    Each round is written to the shared folder, so no lineage grows and a lost executor costs one round at most. A
    round moves the edges a few times; the number of rounds grows with the logarithm of the longest path. The edges of a
    node with very many are spread over tasks. Nulls and loops are left out. An empty table gives an empty result.
    """
    u, v = edges.columns[:2]
    now = settle(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").mapInArrow(trimmed(_forest), "u long, v long"), "edges")
    seen, n = None, now.count()
    while n:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct(), "edges")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(down, least, "u", n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = settle(small.where("u <> v").distinct(), "edges")
        discard(now, large)
        n, mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = after
        if (n, mark) == seen:
            break
        seen = (n, mark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
