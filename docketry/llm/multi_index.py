"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and cut in two halves; each half has its own K centroids, fitted by k-means on a
bounded sample (``FIT_SAMPLE`` vectors; every vector is indexed). The K x K pairs of centroids are the cells; K grows with the
number of vectors, some ``FILL`` to a cell, up to what the sample can fit (``FIT_SAMPLE`` / ``PER_CENTROID``). A query walks the
cells by the sum of its two squared distances, smallest first, off a heap, until the cells it has seen hold a share of
all vectors; everything in these cells is ranked by its exact cosine, in double precision on the original vectors.

The share is measured: ``TRIALS`` vectors of the sample are searched by brute force among all vectors, and the share is that
at which their walks have met ``recall`` of their true neighbours. On clustered vectors that is a few cells, and less the more
vectors there are; on vectors without any structure, the hardest case, it is a large part of all.

Equal vectors are one entry of the index with their smallest ids, as many as a result can name; no result is lost.
Entries and queries meet in blocks of bounded size on both sides, so a cell that holds a third of all vectors is many
blocks.

Edge cases: vectors that are null, zero, hold null or non-finite components, or differ in length from most, take no
part, nor do rows with a null id; rows that repeat an id are left out of that id's results; with fewer candidates than
asked for all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.common import discard, settle, trimmed

FIT_SAMPLE, ROUNDS, FILL, PER_CENTROID, TRIALS = 20_000, 10, 16, 32, 256
DATA_BLOCK, QUERY_BLOCK = 32_768, 8_192


def usable(vector: str, dim: int) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def fit(sample: np.ndarray, k: int, seed: int = 3) -> list[np.ndarray]:
    """Centroids of the two halves of unit vectors; k is cut to the number of samples."""
    half, draw, out = sample.shape[1] // 2, np.random.default_rng(seed), []
    for part in (sample[:, :half], sample[:, half:]):
        c = part[draw.choice(len(part), min(k, len(part)), replace=False)].copy()
        for _ in range(ROUNDS):
            nearest = _distances(part, c).argmin(axis=1)
            n = np.bincount(nearest, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, nearest, part)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        out.append(c)
    return out


def walk(first: np.ndarray, second: np.ndarray, sizes: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """Cells (first centroid, second centroid, vectors seen before) by summed distance.

    ``first`` and ``second`` are a query's distances to the centroids. Pairs leave the heap smallest first, and each pair
    lets in those that may follow it.
    """
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    u, v = first[a].tolist(), second[b].tolist()
    seen, heap, done = 0, [(u[0] + v[0], 0, 0)], [0] * len(u)
    while heap:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j], seen
        seen += sizes[a[i]][b[j]]
        done[i] = j + 1
        if j + 1 < len(v) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (u[i] + v[j + 1], i, j + 1))
        if i + 1 < len(u) and done[i + 1] == j:
            heapq.heappush(heap, (u[i + 1] + v[j], i + 1, j))


def visited(first: np.ndarray, second: np.ndarray, sizes: list[list[int]], enough: float) -> np.ndarray:
    """Which cells (first x second centroids) a walk has seen once they hold ``enough`` vectors."""
    out = np.zeros((len(first), len(second)), bool)
    for i, j, seen in walk(first, second, sizes):
        if seen >= enough:
            break
        out[i, j] = True
    return out


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of each query with the vector beside it, the same for the same pair wherever it is computed."""
    dots = (queries * vectors).sum(axis=1)
    return dots / (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((vectors * vectors).sum(axis=1)))


def best_in_block(q: np.ndarray, open_: np.ndarray, x: np.ndarray, second: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) places of the ``k`` best visited vectors of a block for each query, ties by ``least``.

    ``open_``: queries x second centroids, whether a query visits a cell; ``second``: the vectors' second centroids.
    """
    out: tuple[list, list, list] = ([], [], [])
    uq, ux = _unit(q), _unit(x)
    for lo in range(0, len(q), 256):
        s = uq[lo : lo + 256] @ ux.T
        s[~open_[lo : lo + 256][:, second]] = -2.0
        border = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        row, col = np.nonzero((s >= border[:, None] - 1e-9) & (s > -1.5))
        score = exact(q[lo + row], x[col])
        order = np.lexsort((least[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        for part, add in zip(out, (row + lo, col, score), strict=True):
            part.append(add[nth < k])
    return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in out)


def needed_share(index: DataFrame, trials: np.ndarray, k: int, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, recall: float) -> float:
    """The share of all vectors that walks have to see to meet ``recall`` of the ``k`` true neighbours of the ``trials``.

    Each task gives the ``k`` best of its vectors for each trial (a trial itself left out), with their cells; the best of all
    are searched in the walks of the trials.
    """
    dim, half = trials.shape[1], trials.shape[1] // 2
    names = ["trial", "score", "i", "j"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = trials @ _unit(_matrix(b.column(0), dim)).T
                s[s > 1 - 1e-12] = -2.0  # the trial
                top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                row, col = np.repeat(np.arange(len(trials)), top.shape[1]), top.ravel()
                i, j = (b.column(n).to_numpy()[col] for n in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(s[row, col]), pa.array(i), pa.array(j)], names)

    by = W.partitionBy("trial").orderBy(F.desc("score"), "i", "j")
    true = index.select("vector", "i", "j").mapInArrow(trimmed(best), "trial int, score double, i int, j int").where("score > -1.5")
    true = true.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k).select("trial", "i", "j").collect()  # TRIALS x k
    da, db, held, need = _distances(trials[:, :half], one), _distances(trials[:, half:], two), sizes.tolist(), []
    wanted: dict[int, list] = {}
    for r in true:
        wanted.setdefault(r.trial, []).append((r.i, r.j))
    for t, cells in wanted.items():
        left = set(cells)
        for i, j, seen in walk(da[t], db[t], held):
            if (i, j) in left:
                need += [seen + 1] * cells.count((i, j))
                left.remove((i, j))
                if not left:
                    break
    return float(np.sort(need)[min(len(need) - 1, int(recall * len(need)))] / sizes.sum()) if need else 1.0


def search(rows: DataFrame, is_query: Column, k: int = 5, recall: float = 0.95, share: float | None = None, centroids: int | None = None) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest found of each row of ``rows`` (id, vector) that ``is_query`` (on id) admits.

    ``share`` and ``centroids`` fix what is otherwise measured or derived.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    usual = rows.where("vector is not null and size(vector) > 0").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return empty
    dim = usual.dim
    fine = rows.where(F.col("id").isNotNull() & usable("vector", dim)).select("id", "vector")
    named = fine.distinct().withColumn("nth", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("nth") <= k + 1)
    classes = named.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = settle(classes.select(F.monotonically_increasing_id().alias("entry"), "vector", "ids"), "entries")
    n = classes.count()
    if not n:
        return empty
    ticket = F.pmod(F.xxhash64("vector"), F.lit(1 << 30))
    drawn = classes.where(ticket < int(min(1.0, 1.1 * FIT_SAMPLE / n) * (1 << 30))).select(ticket.alias("t"), "vector").toArrow()
    sample = _matrix(drawn.column(1).combine_chunks(), dim)[np.argsort(drawn.column(0).to_numpy(), kind="stable")][:FIT_SAMPLE]
    if not len(sample):
        sample = _matrix(classes.select("vector").limit(1).toArrow().column(0).combine_chunks(), dim)
    sample = _unit(sample)
    one, two = fit(sample, centroids or max(1, min(int((n / FILL) ** 0.5), FIT_SAMPLE // PER_CENTROID)))
    half = dim // 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column(1), dim))
            i, j = _distances(x[:, :half], one).argmin(axis=1), _distances(x[:, half:], two).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], ["entry", "vector", "ids", "i", "j"])

    kind = classes.schema["vector"].dataType.simpleString()
    index = settle(classes.mapInArrow(trimmed(place), f"entry long, vector {kind}, ids array<long>, i int, j int"), "index")
    discard(classes)
    sizes = np.zeros((len(one), len(two)), np.int64)
    for r in index.groupBy("i", "j").count().collect():  # centroids x centroids at most
        sizes[r.i, r.j] = r["count"]
    if share is None:
        share = needed_share(index, sample[:TRIALS], k, one, two, sizes, recall)
    held, enough = sizes.tolist(), max(share * n, k + 1)
    blocks = np.maximum(1, -(-sizes.sum(axis=1) // DATA_BLOCK)).tolist()

    asked = fine.where(is_query).distinct()
    queries = asked.join(index.select("entry", F.col("vector").alias("v")), F.col("vector") == F.col("v")).select("id", "entry", "vector")
    queries = settle(queries, "queries")
    points = queries.select("entry", "vector").dropDuplicates(["entry"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                x = _unit(_matrix(b.column(1), dim))
                da, db = _distances(x[:, :half], one), _distances(x[:, half:], two)
                open_ = np.array([visited(p, q, held, enough) for p, q in zip(da, db, strict=True)])
                row, i = np.nonzero(open_.any(axis=2))
                masks = [m.tobytes() for m in np.packbits(open_[row, i], axis=1)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(i.astype(np.int32)), pa.array(masks, pa.binary())], ["entry", "vector", "i", "mask"])

    # both sides of a first centroid's cells are dealt to blocks; every pair of blocks meets once
    probes = settle(points.mapInArrow(trimmed(route), f"entry long, vector {kind}, i int, mask binary"), "probes")
    asking = [1] * len(one)
    for r in probes.groupBy("i").count().collect():
        asking[r.i] = -(-r["count"] // QUERY_BLOCK)
    ways = lambda counts: F.element_at(F.array(*map(F.lit, counts)), F.col("i") + 1).cast("int")
    own = lambda counts: F.pmod(F.xxhash64("entry"), ways(counts)).cast("int")
    every = lambda counts: F.explode(F.sequence(F.lit(0), ways(counts) - 1))
    probing = probes.select("*", own(asking).alias("qb"), every(blocks).alias("db"))
    data = index.select("entry", "vector", F.element_at("ids", 1).alias("least"), "i", "j", own(blocks).alias("db"), every(asking).alias("qb"))

    def meet(probed, stored):
        import pandas as pd

        out = {"entry": [], "hit": [], "score": [], "least": []}
        if len(probed) and len(stored):
            q, x = (np.array(list(t["vector"]), np.float64).reshape(-1, dim) for t in (probed, stored))
            open_ = np.unpackbits(np.frombuffer(b"".join(probed["mask"]), np.uint8).reshape(len(q), -1), axis=1)[:, : len(two)].astype(bool)
            least = stored["least"].to_numpy()
            a, b, s = best_in_block(q, open_, x, stored["j"].to_numpy(), least, k + 1)
            out = {"entry": probed["entry"].to_numpy()[a.astype(int)], "hit": stored["entry"].to_numpy()[b.astype(int)], "score": s, "least": least[b.astype(int)]}
        return pd.DataFrame(out)

    found = probing.groupBy("i", "db", "qb").cogroup(data.groupBy("i", "db", "qb")).applyInPandas(meet, "entry long, hit long, score double, least long")
    by = W.partitionBy("entry").orderBy(F.desc("score"), "least")
    best = found.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k + 1).select("entry", "hit", "score")
    hits = best.join(index.select(F.col("entry").alias("hit"), "ids"), "hit").select("entry", "score", F.explode("ids").alias("other"))
    pairs = queries.select(F.col("id").alias("query_id"), "entry").join(hits, "entry").where(F.col("other") != F.col("query_id"))
    last = W.partitionBy("query_id").orderBy(F.desc("score"), "other")
    # an id that several rows repeat with other vectors may be met twice: its best score counts
    once = pairs.groupBy("query_id", "other").agg(F.max("score").alias("score"))
    out = settle(once.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", F.col("other").alias("id"), "score"), "neighbours")
    discard(index, queries, probes)
    return out
