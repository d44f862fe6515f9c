"""Leakage between a training and a query side: nearest neighbours by character n-gram TF-IDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.shared import discard, settled

#: Rows of both sides that meet in one call.
QUERY_BLOCK, TRAIN_BLOCK = 1024, 1024


def char_grams(text: str, least: int = 3, most: int = 5) -> Column:
    """All character n-grams of the lower-cased text, runs of white space read as one blank."""
    flat = F.regexp_replace(F.lower(F.col(text)), r"\s+", " ")
    n = F.length(flat)

    def of(k: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
        return F.when(n >= k, F.transform(places, lambda i: F.substring(flat, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    each = [of(k) for k in range(least, most + 1)]
    return F.concat(*each)


def tfidf(rows: DataFrame, fit_on: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """id, gram, weight of ``rows`` (id, text): (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), unit length, vocabulary of ``fit_on``."""
    tf = lambda df: df.select("id", F.explode(char_grams("text", least, most)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    df = tf(fit_on).groupBy("gram").agg(F.count("*").alias("df"))
    n = fit_on.agg(F.count("*").alias("n"))
    # n is one row
    w = tf(rows).join(df, "gram").crossJoin(n).select("id", "gram", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    length = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return w.join(length, "id").select("id", "gram", (F.col("w") / F.col("length")).alias("weight"))


def _packed(rows: DataFrame, fit_on: DataFrame, least: int, most: int) -> DataFrame:
    """id, grams of ``rows``: the weighed n-grams of a text as one array of (hash, weight)."""
    return tfidf(rows, fit_on, least, most).groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("gram").alias("g"), F.col("weight").alias("w"))).alias("grams"))


def _postings(rows: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order with the row and the weight of each."""
    lists = [[] if x is None else x for x in rows]
    g = np.array([e["g"] for x in lists for e in x], np.int64)
    w = np.array([e["w"] for x in lists for e in x], np.float64)
    order = np.argsort(g, kind="stable")
    return g[order], np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order], w[order]


def _in_blocks(queries: DataFrame, train: DataFrame, fields: tuple[str, ...], digits: int, least: int, most: int) -> DataFrame:
    """id, measure, neighbour, score: the best row of ``train`` for each query by each field, and by their mean (``pair``).

    Blocks of both sides meet, so that an n-gram that very many rows share is neither a join key nor a product of rows: it
    adds to the scores of a block in place. A task holds a block of each side and gives one row for each query and measure.
    All rows meet all: for the queries that bounds on scores leave open.
    """
    sides = []
    for rows, name, size in ((queries, "id", QUERY_BLOCK), (train, "neighbour", TRAIN_BLOCK)):
        out = rows.select(F.col("id").alias(name))
        for f in fields:
            packed = _packed(rows.select("id", F.col(f).alias("text")), train.select("id", F.col(f).alias("text")), least, most)
            out = out.join(packed.select(F.col("id").alias(name), F.col("grams").alias(f)), name, "left")
        sides.append((out, max(1, -(-rows.count() // size))))
    (q, nq), (t, nt) = sides
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("*", block("id", nq).alias("qb"), every(nt).alias("tb"))
    t = t.select("*", block("neighbour", nt).alias("tb"), every(nq).alias("qb"))
    names = [*fields, "pair"] if len(fields) > 1 else list(fields)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("neighbour", ignore_index=True)
            held = [_postings(b[f]) for f in fields]
            for row in a.itertuples(index=False):
                found = []
                for f, (grams, of, weights) in zip(fields, held, strict=True):
                    g, _, w = _postings(pd.Series([getattr(row, f)]))
                    lo, hi = np.searchsorted(grams, g, "left"), np.searchsorted(grams, g, "right")
                    n = hi - lo
                    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    score = np.bincount(of[at], np.repeat(w, n) * weights[at], minlength=len(b))
                    found.append(np.clip(np.round(score, digits), 0.0, 1.0))
                if len(fields) > 1:
                    found.append(np.round(sum(found) / len(fields), digits))
                for name, score in zip(names, found, strict=True):
                    k = int(score.argmax())  # rows come by id: ties go to the first
                    out.append((row.id, name, b["neighbour"].iloc[k], score[k]))
        return pd.DataFrame(out, columns=["id", "measure", "neighbour", "score"])

    kind = dict(queries.dtypes)["id"]
    best = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInPandas(meet, f"id {kind}, measure string, neighbour {kind}, score double")
    return best.groupBy("id", "measure").agg(F.max_by(F.struct("neighbour", "score"), F.struct("score", -F.col("neighbour"))).alias("b")).select("id", "measure", "b.*")


#: Training rows that an n-gram has at most to be looked up by, and the rarest n-grams of a query that find its first guess.
LOOKED_UP, FIRST_GUESS = 1000, 8
#: Rows that a query is compared with one by one in any case; beyond, a twentieth of all.
FEW = 50
#: Products of rows on both sides up to which bounds aren't worth their joins.
SMALL = 1 << 16
#: N-grams of a query, on average, up to which all rows are compared in blocks.
SHORT = 200


@F.pandas_udf(T.DoubleType())
def _dot(g: pd.Series, w: pd.Series, h: pd.Series, x: pd.Series) -> pd.Series:
    """Scalar products of vectors: arrays of components, each once, with arrays of their weights."""

    def one(g, w, h, x) -> float:
        _, i, j = np.intersect1d(g, h, assume_unique=True, return_indices=True)
        return float(np.dot(w[i], x[j]))

    return pd.Series([one(*v) for v in zip(g, w, h, x, strict=True)], dtype="float64")


def _packed_vectors(v: DataFrame, key: str, name: str) -> DataFrame:
    """key, {name}_g, {name}_w: vectors (id, g, w) as two arrays."""
    both = v.groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("g", "w")).alias("v"))
    return both.select(key, F.col("v.g").alias(f"{name}_g"), F.col("v.w").alias(f"{name}_w"))


def best_matches(q: DataFrame, t: DataFrame, total: float, digits: int, looked_up: int = LOOKED_UP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact best scalar products of vectors, by looking up only what can win.

    ``q`` (id, g, w) and ``t`` (neighbour, g, w) are vectors by components, those of ``t`` of a squared length of ``total`` at
    most. A first guess, the row of ``t`` that shares most weight among a query's rarest components, gives a score to beat. A row that
    beats it shares a component of the query's rarest ones, up to where the rest of the query is so short that the rest alone
    can't reach the score (Cauchy-Schwarz). Rows met by these components are dropped again where what they share, and the lengths
    that are left on both sides, can't reach it; all others are compared.

    Returns the best (id, neighbour, score; rounded, ties to the first row), all pairs compared (id, neighbour, score), and the
    ids left open: those for which components that more than ``looked_up`` rows have would have to be looked up, and those
    with very many rows to compare.
    """
    margin = 4 * 10.0**-digits  # rows within this may be rounded to the same score
    df = t.groupBy("g").agg(F.count("*").alias("df"))
    ranked = settled(q.join(df, "g").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "g", "w"))).alias("v")))
    vectors = settled(_packed_vectors(q, "id", "q")), settled(_packed_vectors(t.withColumnRenamed("neighbour", "id"), "neighbour", "t"))
    rare = F.filter("v", lambda e: e["df"] <= looked_up)

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(vectors[0], "id").join(vectors[1], "neighbour").select("id", "neighbour", _dot("q_g", "q_w", "t_g", "t_w").alias("score"))

    guess = ranked.select("id", F.explode(F.slice(rare, 1, FIRST_GUESS)).alias("e")).select("id", "e.g", F.col("e.w").alias("qw")).join(t, "g")
    guess = guess.groupBy("id", "neighbour").agg(F.sum(F.col("qw") * F.col("w")).alias("part")).groupBy("id").agg(F.max_by("neighbour", F.struct("part", -F.col("neighbour"))).alias("neighbour"))
    beat = settled(scored(guess).select("id", (F.col("score") - margin).alias("beat")))

    # how many components have to be looked up: all before the first from which on the rest is too short
    need = F.col("beat") / F.lit(float(np.sqrt(total)))
    squares = F.transform("v", lambda e: e["w"] * e["w"])
    # the squared length of the rest is carried from component to component until it is short enough
    walk = F.aggregate(
        squares, F.struct(F.aggregate(squares, F.lit(0.0), lambda x, y: x + y).alias("rest"), F.lit(0).alias("n")),
        lambda x, y: F.when(x["rest"] < need * need - 1e-12, x).otherwise(F.struct((x["rest"] - y).alias("rest"), (x["n"] + 1).alias("n"))),
    )
    plan = ranked.join(beat, "id", "left").withColumn("walk", F.when(F.col("beat") > 0, walk))
    plan = plan.withColumn("open", F.col("walk").isNull() | F.exists(F.slice("v", F.lit(1), F.col("walk.n")), lambda e: e["df"] > looked_up))
    plan = settled(plan.select("id", "v", "beat", "open", F.col("walk.n").alias("n"), F.sqrt(F.greatest(F.col("walk.rest"), F.lit(0.0))).alias("rest")))
    probes = plan.where("not open").select("id", "beat", "rest", F.explode(F.slice("v", F.lit(1), F.col("n"))).alias("e")).select("id", "beat", "rest", "e.g", F.col("e.w").alias("qw"))
    met = probes.join(t, "g").groupBy("id", "neighbour").agg(F.sum(F.col("qw") * F.col("w")).alias("part"), F.sum(F.col("w") * F.col("w")).alias("used"), F.first("beat").alias("beat"), F.first("rest").alias("rest"))
    able = F.col("part") + F.col("rest") * F.sqrt(F.greatest(F.lit(total) - F.col("used"), F.lit(0.0))) + 1e-12 >= F.col("beat")
    pairs = settled(met.where(able).select("id", "neighbour"))
    # where a query is like nothing, bounds tell little, and a block of rows is the cheaper way to the same result
    crowded = settled(pairs.groupBy("id").count().where(F.col("count") > max(FEW, vectors[1].count() // 20)).select("id"))
    compared = settled(scored(pairs.join(F.broadcast(crowded) if crowded.count() <= FEW * 1000 else crowded, "id", "left_anti")))
    rounded = compared.withColumn("score", F.least(F.greatest(F.round("score", digits), F.lit(0.0)), F.lit(1.0)))
    best = rounded.groupBy("id").agg(F.max_by(F.struct("neighbour", "score"), F.struct("score", -F.col("neighbour"))).alias("b")).select("id", "b.*")
    open_ = settled(plan.where("open").select("id").unionByName(crowded))
    best = settled(best)
    discard(ranked, *vectors, beat, plan, pairs, crowded)
    return best, compared, open_


#: Rows that meet in one task of ``best_by_blocks``, queries and training rows, and the least number of tasks worth dealing.
TASK_QUERIES, TASK_TRAIN, TASKS = 8192, 16384, 32


def _columns(table: pa.Table, key: str, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, and of all components the row number, the hash and the weight, by row."""
    table = table.sort_by(key).combine_chunks()
    ids = table[key].to_numpy()
    lists = [table[f"{side}_{c}"].combine_chunks() for c in "gw"]
    lists = [x if isinstance(x, pa.ListArray) else pa.concat_arrays(x.chunks) for x in lists]
    n = np.diff(lists[0].offsets.to_numpy())
    return ids, np.repeat(np.arange(len(ids)), n), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)


def best_by_blocks(q: DataFrame, t: DataFrame, digits: int) -> DataFrame:
    """id, neighbour, score: the best scalar product of each vector of ``q`` (id, g, w) with those of ``t`` (neighbour, g, w), all compared.

    Rounded, ties to the first row; vectors without a common component give no row. A task holds a block of either side, the
    training rows by component, and adds up the products of one query at a time: no pair becomes a row, and a component
    that very many rows share costs a sum for each of them.
    """
    sides = settled(_packed_vectors(q, "id", "q")), settled(_packed_vectors(t.withColumnRenamed("neighbour", "id"), "neighbour", "t"))
    n, m = (s.count() for s in sides)
    nt = max(1, -(-m // TASK_TRAIN))
    nq = max(1, -(-n // TASK_QUERIES), min(-(-TASKS // nt), -(-n // 256)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = sides[0].select("*", block("id", nq).alias("qb"), every(nt).alias("tb"))
    b = sides[1].select("*", block("neighbour", nt).alias("tb"), every(nq).alias("qb"))
    kind = dict(q.dtypes)["id"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            ids, of, g, w = _columns(left, "id", "q")
            names, row, h, x = _columns(right, "neighbour", "t")
            order = np.argsort(h, kind="stable")
            h, row, x = h[order], row[order], x[order]
            lo = np.searchsorted(h, g, "left")
            many = np.searchsorted(h, g, "right") - lo
            edge = np.searchsorted(of, np.arange(len(ids) + 1))
            for i in range(len(ids)):
                k = slice(edge[i], edge[i + 1])
                c = many[k]
                total = int(c.sum())
                if not total:
                    continue
                at = np.repeat(lo[k] - (np.cumsum(c) - c), c) + np.arange(total)
                score = np.bincount(row[at], np.repeat(w[k], c) * x[at], minlength=len(names))
                near = np.flatnonzero(score >= score.max() - 4 * 10.0**-digits)  # more than these can't round to the same
                found = np.clip(np.round(score[near], digits), 0.0, 1.0)
                best = int(found.argmax())  # rows come by id: ties go to the first
                for out, value in zip(rows, (ids[i], names[near[best]], found[best]), strict=True):
                    out.append(value)
        id_type = left.schema.field("id").type if left.num_columns else right.schema.field("neighbour").type
        return pa.table([pa.array(rows[0], id_type), pa.array(rows[1], id_type), pa.array(rows[2], pa.float64())], names=["id", "neighbour", "score"])

    best = a.groupBy("qb", "tb").cogroup(b.groupBy("qb", "tb")).applyInArrow(meet, f"id {kind}, neighbour {kind}, score double")
    best = settled(best.groupBy("id").agg(F.max_by(F.struct("neighbour", "score"), F.struct("score", -F.col("neighbour"))).alias("b")).select("id", "b.*"))
    discard(*sides)
    return best


def _vectors(rows: DataFrame, fit_on: DataFrame, fields: tuple[str, ...], least: int, most: int) -> DataFrame:
    """id, field, g, w: the weighed n-grams of each field."""
    each = [tfidf(rows.select("id", F.col(f).alias("text")), fit_on.select("id", F.col(f).alias("text")), least, most).select("id", F.lit(f).alias("field"), F.xxhash64(F.lit(f), "gram").alias("g"), F.col("weight").alias("w")) for f in fields]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return settled(out)


def _nearest(queries: DataFrame, train: DataFrame, fields: tuple[str, ...], digits: int, least: int, most: int, looked_up: int = LOOKED_UP) -> DataFrame:
    """id, measure, neighbour, score: the best row of ``train`` for each query by each field, and by their mean (``pair``).

    By bounds on scores where they decide; queries that they leave open meet all rows in blocks. Queries that share no n-gram
    with any row get the first row with score 0.
    """
    if queries.count() * train.count() <= SMALL:
        return _in_blocks(queries, train, fields, digits, least, most)
    # equal texts are one: of training rows the first, of queries the first as well, whose result the others share
    text = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    first = lambda rows: rows.groupBy(text.alias("__text")).agg(F.min("id").alias("id"), *(F.first(f).alias(f) for f in fields))
    same, queries = queries.select(F.col("id").alias("__id"), text.alias("__text")), settled(first(queries))
    q, t = _vectors(queries, train, fields, least, most), _vectors(first(train), train, fields, least, most)
    measures = {f: (f,) for f in fields} | ({"pair": fields} if len(fields) > 1 else {})
    # of names and the like, sums over all common n-grams cost less than the joins that bounds on scores take
    short = q.count() <= SHORT * queries.count()
    # queries that share nothing have the first row; so have those whose best score is rounded to nothing
    none = queries.select("id").crossJoin(train.agg(F.min("id").alias("first")))  # one row
    found = None
    for name, own in measures.items():
        mine, theirs = q.where(F.col("field").isin(*own)), t.where(F.col("field").isin(*own))
        here = mine.select("id", "g", (F.col("w") / len(own)).alias("w"))
        if len(own) == len(fields) == 1 and short:
            best, compared, open_ = best_by_blocks(here, theirs.select(F.col("id").alias("neighbour"), "g", "w"), digits), None, None
        else:
            best, compared, open_ = best_matches(here, theirs.select(F.col("id").alias("neighbour"), "g", "w"), float(len(own)), digits, looked_up)
        if len(own) > 1:  # the mean of rounded scores: of all rows that may reach the best one, by their own products
            parts = [_scores(compared, mine.where(F.col("field") == f), theirs.where(F.col("field") == f), digits).withColumnRenamed("score", f) for f in own]
            joined = compared.select("id", "neighbour")
            for p in parts:
                joined = joined.join(p, ["id", "neighbour"])
            mean = joined.select("id", "neighbour", F.round(sum((F.col(f) for f in own[1:]), F.col(own[0])) / len(own), digits).alias("score"))
            best = mean.groupBy("id").agg(F.max_by(F.struct("neighbour", "score"), F.struct("score", -F.col("neighbour"))).alias("b")).select("id", "b.*")
        best = best.where("score > 0")
        if open_ is not None and not open_.isEmpty():
            some = queries.join(open_, "id", "left_semi")
            best = best.unionByName(_in_blocks(some, train, fields, digits, least, most).where(F.col("measure") == name).select("id", "neighbour", "score"))
        whole = none.join(best, "id", "left").select("id", F.lit(name).alias("measure"), F.coalesce("neighbour", "first").alias("neighbour"), F.coalesce("score", F.lit(0.0)).alias("score"))
        found = whole if found is None else found.unionByName(whole)
    by_text = queries.select("__text", "id").join(found.where("neighbour is not null"), "id").drop("id")
    return same.join(by_text, "__text").select(F.col("__id").alias("id"), "measure", "neighbour", "score")


def _scores(pairs: DataFrame, q: DataFrame, t: DataFrame, digits: int) -> DataFrame:
    """id, neighbour, score: rounded products of given pairs; 0 where one has no vector."""
    both = pairs.select("id", "neighbour").join(_packed_vectors(q, "id", "q"), "id", "left").join(_packed_vectors(t, "neighbour", "t"), "neighbour", "left")
    sides = [F.coalesce(c, F.array().cast(k)) for c, k in (("q_g", "array<long>"), ("q_w", "array<double>"), ("t_g", "array<long>"), ("t_w", "array<double>"))]
    return both.select("id", "neighbour", F.least(F.greatest(F.round(_dot(*sides), digits), F.lit(0.0)), F.lit(1.0)).alias("score"))


def nearest(queries: DataFrame, train: DataFrame, digits: int = 9, least: int = 3, most: int = 5) -> DataFrame:
    """id, neighbour, score: the most similar row of ``train`` for each row of ``queries`` (id, text).

    A query that shares no n-gram with any gets the first training row with score 0; ties go to the first row. Scores are
    rounded to ``digits`` before and limited to [0, 1].
    """
    best = _nearest(queries, train, ("text",), digits, least, most).drop("measure")
    return queries.select("id").join(best, "id", "left").select("id", "neighbour", F.coalesce("score", F.lit(0.0)).alias("score"))


def nearest_pairs(queries: DataFrame, train: DataFrame, digits: int = 9) -> DataFrame:
    """Premise, hypothesis and pair maxima of each query (id, premise, hypothesis) over ``train``.

    The two field maxima may come from different training rows; the pair's score is the mean of both on one row.
    """
    best = _nearest(queries, train, ("premise", "hypothesis"), digits, 3, 5)
    out = queries.select("id")
    for name in ("premise", "hypothesis", "pair"):
        own = best.where(F.col("measure") == name).select("id", F.col("neighbour").alias(f"{name}_neighbour"), F.col("score").alias(f"{name}_score"))
        out = out.join(own, "id", "left").withColumn(f"{name}_score", F.coalesce(f"{name}_score", F.lit(0.0)))
    return out


def distribution(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, median, p10, p90 (exact, linear), values of 1, of 0.95 and of 0.90 and more, by group and over all (null).

    One pass over grouping sets.
    """
    df = rows.rollup(*by) if by else rows.groupBy()
    v = F.col(value)
    return df.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.1)).alias("p10"), F.percentile(v, F.lit(0.9)).alias("p90"),
        F.count(F.when(v >= 1, 1)).alias("n_exact"), F.count(F.when(v >= 0.95, 1)).alias("n_95"), F.count(F.when(v >= 0.9, 1)).alias("n_90"),
    )


def unique_pairs(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
