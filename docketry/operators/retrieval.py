"""Retrieval: exact lookup first, vectors second, reranking third; and recall at depths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of vectors and of queries that meet in one call; both sides are cut into as many blocks as needed.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 4_096


def check_depths(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(candidate, final) depths: not empty, positive, final within candidate, each once."""
    if not pairs:
        raise ValueError("no depths are given")
    for candidate, final in pairs:
        if not (isinstance(candidate, int) and isinstance(final, int)) or final < 1 or candidate < final:
            raise ValueError(f"depths have to be positive and final within candidate: {candidate}:{final}")
    if len(set(pairs)) != len(pairs):
        raise ValueError("a pair of depths is given twice")
    return pairs


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, exclude_same_id: bool = False, digits: int = 9) -> DataFrame:
    """query_id, id, score, rank: the ``k`` largest inner products of unit vectors for each query.

    ``queries`` and ``vectors`` have (id, vector). Scores are rounded to ``digits`` before ranking, ties go to the smaller id.
    Blocks of both sides meet in matrix products that keep ``k`` rows for each query, so what is shuffled grows with
    queries x blocks x k, and no task holds more than a block of each side. Rows that are no vectors are left out.
    """
    from docketry.functions.vectors import is_vector

    fine_q, fine_v = queries.where(is_vector("vector")), vectors.where(is_vector("vector"))
    nq, nv = max(1, -(-fine_q.count() // QUERY_BLOCK)), max(1, -(-fine_v.count() // VECTOR_BLOCK))
    q = fine_q.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"))
    v = fine_v.select("id", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vb"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "score": []}
        if len(a) and len(b):
            x, y = (np.array(list(t["vector"]), np.float64) for t in (a, b))
            x, y = (m / np.sqrt((m * m).sum(axis=1))[:, None] for m in (x, y))
            ids, own = b["id"].to_numpy(), a["id"].to_numpy()
            for lo in range(0, len(x), 256):
                s = np.round(x[lo : lo + 256] @ y.T, digits)
                if exclude_same_id:
                    s[own[lo : lo + 256, None] == ids[None, :]] = -np.inf
                need = min(k, s.shape[1])
                border = np.partition(s, s.shape[1] - need, axis=1)[:, s.shape[1] - need]
                row, col = np.nonzero((s >= border[:, None]) & np.isfinite(s))
                order = np.lexsort((ids[col], -s[row, col], row))
                row, col = row[order], col[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                out["query_id"].append(own[lo + row[keep]])
                out["id"].append(ids[col[keep]])
                out["score"].append(s[row[keep], col[keep]])
        return pd.DataFrame({n: np.concatenate(c) if c else np.zeros(0, float if n == "score" else np.int64) for n, c in out.items()})

    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(meet, "query_id long, id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, score: str = "reranker_score", by: str = "query_id") -> DataFrame:
    """New ranks by score, ties in the initial order; the old rank becomes initial_rank."""
    df = candidates.withColumnRenamed("rank", "initial_rank")
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), "initial_rank")))


def depth_slice(ranked: DataFrame, candidate: int, final: int, by: str = "query_id") -> DataFrame:
    """Rows among the first ``candidate`` of the initial order, then the first ``final`` of the present one."""
    check_depths([(candidate, final)])
    df = ranked.where(F.col("initial_rank") <= candidate)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("rank"))).where(F.col("rank") <= final)


def recall_at_depths(hits: DataFrame, gold: DataFrame, depths: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """depth, hits, gold, recall (micro; null without gold) of ``hits`` (query_id, item, rank) against ``gold`` (query_id, item).

    All depths come from one join: a gold item counts from the rank on at which it is first found.
    """
    first = hits.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    found = gold.select(*by, "query_id", "item").distinct().join(first, ["query_id", "item"], "left")
    each = F.array(*(F.struct(F.lit(d).alias("depth"), (F.col("rank") <= d).alias("hit")) for d in depths))
    rows = found.select(*by, F.explode(each).alias("e"))
    out = rows.groupBy(*by, F.col("e.depth").alias("depth")).agg(F.count(F.when(F.col("e.hit"), 1)).alias("hits"), F.count("*").alias("gold"))
    return out.withColumn("recall", F.try_divide(F.col("hits").cast("double"), F.col("gold").cast("double")))


def unit_ways(units: DataFrame) -> DataFrame:
    """``units`` (unit_id, code, article, part, point) under every citation that leads to them: four rows of a unit at most.

    A citation that leaves part or point open finds the rows where it is null, so that all are found by equality alone.
    """
    either = lambda c: F.explode(F.array_distinct(F.array(F.lit(None), F.col(c)))).alias(c)
    return units.select("unit_id", "code", "article", either("part"), "point").select("unit_id", "code", "article", "part", either("point"))


#: Units in one list of ``unit_lists``.
LISTED = 4096


def unit_lists(units: DataFrame) -> DataFrame:
    """code, article, part, point, listed: the rows of ``unit_ways`` as lists of some LISTED units, as many as a citation needs.

    Where a citation has very many units, a join meets a few lists for each key; the pairs are made by unfolding these.
    """
    by = ["code", "article", "part", "point"]
    ways = unit_ways(units)
    parts = ways.groupBy(*by).agg(F.ceil(F.count("*") / LISTED).alias("__parts"))
    dealt = led_by(ways.select("unit_id", *by), parts).withColumn("__part", F.pmod(F.xxhash64("unit_id"), "__parts"))
    return dealt.groupBy(*by, "__part").agg(F.collect_list(F.struct("unit_id")).alias("listed")).drop("__part")


def led_by(citations: DataFrame, ways: DataFrame) -> DataFrame:
    """``citations`` joined with ``ways`` by code, article, part and point, which ``ways`` loses."""
    named = ways.select(*(F.col(c).alias(f"__{c}") if c in ("code", "article", "part", "point") else F.col(c) for c in ways.columns))
    on = (F.col("code") == F.col("__code")) & (F.col("article") == F.col("__article")) & F.col("part").eqNullSafe(F.col("__part")) & F.col("point").eqNullSafe(F.col("__point"))
    return citations.join(named, on).drop("__code", "__article", "__part", "__point")


def exact_lookup(citations: DataFrame, units: DataFrame) -> DataFrame:
    """Citations resolved against structured units by code and article, narrowed by part and point where given.

    ``citations``: hypothesis_id, citation_no, code, article, part, point. ``units``: unit_id and the same four. A bare article
    or a bare point has to lead to one unit, else to none; a part may lead to many. Units are counted before they are joined:
    only those that are in the result become rows.
    """
    ways = unit_ways(units)
    counted = ways.groupBy("code", "article", "part", "point").agg(F.count("*").alias("__n"), F.min("unit_id").alias("__one"))
    n = F.sum("__n").over(W.partitionBy("hypothesis_id", "citation_no"))
    bare = led_by(citations, counted).withColumn("__n", n).where(F.col("part").isNull() & (F.col("__n") == 1)).select(*citations.columns, F.col("__one").alias("unit_id"))
    return bare.unionByName(led_by(citations.where(F.col("part").isNotNull()), ways.where(F.col("part").isNotNull())).select(*citations.columns, "unit_id"))


def route_rules_first(hypotheses: DataFrame, exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """hypothesis_id, unit_id, rank, score, method: exact hits where a hypothesis has any, all of them; else semantic ones.

    ``exact``: hypothesis_id, citation_no, unit_id. ``semantic``: hypothesis_id, unit_id, rank, score.
    """
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(exact.dtypes) | {f"s_{c}": k for c, k in semantic.dtypes}
    once = exact.select("hypothesis_id", "unit_id", "citation_no").repartition("hypothesis_id").groupBy("hypothesis_id", "unit_id").agg(F.min("citation_no").alias("citation_no"))
    both = once.select("*", none(kinds["s_rank"]).alias("rank"), none(kinds["s_score"]).alias("score"), F.lit(True).alias("exact"))
    both = both.unionByName(semantic.select("hypothesis_id", "unit_id", none(kinds["citation_no"]).alias("citation_no"), "rank", "score", F.lit(False).alias("exact")))
    by = W.partitionBy("hypothesis_id")
    rows = hypotheses.select("hypothesis_id").join(both, "hypothesis_id")
    rows = rows.withColumn("__n", F.row_number().over(by.orderBy(F.desc("exact"), "citation_no", "unit_id"))).withColumn("__any", F.max("exact").over(by)).where(F.col("exact") == F.col("__any"))
    return rows.select("hypothesis_id", "unit_id", F.when(F.col("exact"), F.col("__n")).otherwise(F.col("rank")).alias("rank"), F.when(~F.col("exact"), F.col("score").cast("double")).alias("score"), F.when(F.col("exact"), "exact").otherwise("semantic").alias("method"))


def fill_after_exact(exact: DataFrame, semantic: DataFrame, top_k: int, most: int) -> DataFrame:
    """Exact hits, then semantic ones until ``top_k``; a unit found both ways has both methods.

    Returns hypothesis_id, unit_id, rank, score, methods, overflow (more exact hits than ``most``: to be rejected).
    """
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(exact.dtypes) | {f"s_{c}": k for c, k in semantic.dtypes}
    e = exact.select("hypothesis_id", "unit_id", F.col("citation_no").alias("no"), none(kinds["s_rank"]).alias("s_rank"), none(kinds["s_score"]).alias("score"), F.lit(False).alias("__near"))
    s = semantic.select("hypothesis_id", "unit_id", none(kinds["citation_no"]).alias("no"), F.col("rank").alias("s_rank"), "score", F.lit(True).alias("__near"))
    # a pair's exact rows go if it has semantic ones, which take over its citation; else one of them stays
    pair = W.partitionBy("hypothesis_id", "unit_id", F.when(F.col("hypothesis_id").isNull() | F.col("unit_id").isNull(), F.col("__near")))
    both = e.unionByName(s).repartition("hypothesis_id").withColumn("__k", F.row_number().over(pair.orderBy(F.desc("__near")))).withColumn("no", F.min("no").over(pair)).where(F.col("__near") | (F.col("__k") == 1))
    exactly = F.col("no").isNotNull()
    by = W.partitionBy("hypothesis_id")
    ranked = both.withColumn("n_exact", F.count("no").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.col("no").asc_nulls_last(), F.col("s_rank").asc_nulls_last(), "unit_id")))
    methods = F.array_compact(F.array(F.when(exactly, "exact"), F.when(F.col("s_rank").isNotNull(), "semantic")))
    kept = ranked.where(exactly | (F.col("rank") <= F.greatest(F.lit(top_k), F.col("n_exact"))))
    return kept.select("hypothesis_id", "unit_id", "rank", "score", methods.alias("methods"), (F.col("n_exact") > most).alias("overflow"))


def context_in_order(candidates: DataFrame, keep: int = 5) -> DataFrame:
    """Nearest sentences of each hypothesis, one of each canonical text, without itself, put back in document order.

    ``candidates``: hypothesis_id, hypothesis, sentence, start, score. Returns hypothesis_id, context (array).
    """
    from docketry.functions.keys import loose_key

    df = candidates.withColumn("canon", loose_key("sentence")).where(F.col("canon") != loose_key("hypothesis"))
    order = [F.desc("score"), F.col("start")]
    once = df.withColumn("__d", F.row_number().over(W.partitionBy("hypothesis_id", "canon").orderBy(*order))).where("__d = 1")
    best = once.withColumn("__k", F.row_number().over(W.partitionBy("hypothesis_id").orderBy(*order))).where(F.col("__k") <= keep)
    return best.groupBy("hypothesis_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "sentence"))), lambda x: x["sentence"]).alias("context"))


def score_pairs(pairs: DataFrame, predict: Callable[[pd.Series, pd.Series], pd.Series], schema: str = "string", output: str = "prediction") -> DataFrame:
    """Pairs with the output of an injected predictor or reranker, which gets (premise, hypothesis) in Arrow batches."""

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for premise, hypothesis in batches:
            out = predict(premise, hypothesis)
            if len(out) != len(premise):
                raise ValueError("a predictor has to return one result for each pair")
            yield out

    return pairs.withColumn(output, run("premise", "hypothesis"))


def dense_rank_by(df: DataFrame, value: str, by: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """Dense rank, largest first; a null value has a null rank."""
    w = W.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.dense_rank().over(w)))


def against_baseline(df: DataFrame, value: str, is_baseline: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Difference from the baseline row's value, and whether a row is the best."""
    w = W.partitionBy(*by)
    return df.withColumn("delta", F.col(value) - F.max(F.when(is_baseline, F.col(value))).over(w)).withColumn("is_best", F.coalesce(F.col(value) == F.max(value).over(w), F.lit(False)))
