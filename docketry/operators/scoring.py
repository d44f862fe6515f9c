"""Scores of predicted labels against gold: classification metrics, alignment, misses, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.schemas import INVALID, LABELS, RAG_MISS
from docketry.shared import running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def _f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def predicted(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(INVALID))


def precedence(labels: str | Column) -> Column:
    """One label of an array: contradiction, then entailment, then not mentioned, else invalid."""
    c = F.col(labels) if isinstance(labels, str) else labels
    out = F.when(F.array_contains(c, LABELS[0]), LABELS[0])
    for label in LABELS[1:]:
        out = out.when(F.array_contains(c, label), label)
    return out.otherwise(INVALID)


def _counts(gold: str, prediction: str) -> list[Column]:
    """Support, predictions and hits of each label as conditional sums: one aggregation, combined before the shuffle."""
    g, p = F.col(gold), predicted(prediction)
    out = [F.count("*").alias("n"), F.count(F.when(g == p, 1)).alias("right"), F.count(F.when(p == INVALID, 1)).alias("invalid_count")]
    for k, label in enumerate(LABELS):
        out += [F.count(F.when(g == label, 1)).alias(f"s{k}"), F.count(F.when(p == label, 1)).alias(f"p{k}"), F.count(F.when((g == label) & (p == label), 1)).alias(f"t{k}")]
    return out


def scores(rows: DataFrame, gold: str = "gold", prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """Support, accuracy, macro P/R/F1, weighted F1, contradiction P/R/F1 and invalid predictions; 0 where undefined."""
    c = rows.groupBy(*by).agg(*_counts(gold, prediction))
    p = [ratio(F.col(f"t{k}"), F.col(f"p{k}")) for k in range(3)]
    r = [ratio(F.col(f"t{k}"), F.col(f"s{k}")) for k in range(3)]
    f = [_f1(a, b) for a, b in zip(p, r, strict=True)]
    weighted = ratio(sum(x * F.col(f"s{k}") for k, x in enumerate(f)), sum(F.col(f"s{k}") for k in range(3)))
    return c.select(
        *by, F.col("n").alias("support"), ratio(F.col("right"), F.col("n")).alias("accuracy"), (sum(p) / 3).alias("macro_precision"), (sum(r) / 3).alias("macro_recall"),
        (sum(f) / 3).alias("macro_f1"), weighted.alias("weighted_f1"), p[0].alias("contradiction_precision"), r[0].alias("contradiction_recall"), f[0].alias("contradiction_f1"), "invalid_count",
    )


def per_class(rows: DataFrame, gold: str = "gold", prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each of the fixed labels, also where a label is absent."""
    c = rows.groupBy(*by).agg(*_counts(gold, prediction))
    each = F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"t{k}").alias("t"), F.col(f"p{k}").alias("p"), F.col(f"s{k}").alias("s")) for k, label in enumerate(LABELS)))
    c = c.select(*by, F.explode(each).alias("e")).select(*by, "e.*")
    p, r = ratio(F.col("t"), F.col("p")), ratio(F.col("t"), F.col("s"))
    return c.select(*by, "label", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), F.col("s").alias("support"))


def confusion(rows: DataFrame, gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """gold, prediction, n over the whole label grid with zero cells; other predicted labels are appended."""
    n = rows.groupBy(F.col(gold).alias("gold"), predicted(prediction).alias("prediction")).count().withColumnRenamed("count", "n")
    spark = rows.sparkSession
    labels = spark.createDataFrame([(x,) for x in LABELS], "gold string")
    columns = spark.createDataFrame([(x,) for x in LABELS], "prediction string").union(n.select("prediction")).distinct()
    # a grid of three labels by the labels that were predicted
    return labels.crossJoin(columns).join(n, ["gold", "prediction"], "left").select("gold", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def hypothesis_rows(pairs: DataFrame, key: str = "hypothesis_id") -> DataFrame:
    """One row per hypothesis: label by precedence, premises, sources of contradictions in rank order."""
    contra = F.when(F.col("prediction") == LABELS[0], F.struct("rank", "source"))
    return pairs.groupBy(key).agg(
        precedence(F.collect_set(predicted("prediction"))).alias("label"),
        F.count("*").alias("n_premises"),
        F.transform(F.array_sort(F.collect_list(contra)), lambda x: x["source"]).alias("contradiction_sources"),
    )


def align_gold(predictions: DataFrame, gold: DataFrame, seq: str = "seq") -> DataFrame:
    """Predictions with their gold label: by (hypothesis, premise, article) key, else by (hypothesis, premise).

    ``predictions``: seq, hypothesis, premise, article, prediction. ``gold``: gold_id, hypothesis, premise, article, label,
    legacy. The second key counts only for gold that is legacy or has no article, and each such gold once, for the
    first prediction that needs it and only if no prediction has it by the first key. What finds no gold is new: gold
    ``not mentioned``, source ``inferred``. All keys are plain strings; blank and null articles are alike.
    """
    g = gold.withColumn("article", F.coalesce("article", F.lit("")))
    p = predictions.withColumn("article", F.coalesce("article", F.lit("")))
    first = g.withColumn("__n", F.row_number().over(W.partitionBy("hypothesis", "premise", "article").orderBy("gold_id"))).where("__n = 1")
    exact = p.join(first.select("hypothesis", "premise", "article", "gold_id", "label"), ["hypothesis", "premise", "article"], "left")
    taken = exact.where("gold_id is not null").select("gold_id").distinct()
    loose = first.where(F.col("legacy") | (F.col("article") == "")).join(taken, "gold_id", "left_anti")
    loose = loose.withColumn("__k", F.row_number().over(W.partitionBy("hypothesis", "premise").orderBy("gold_id"))).where("__k = 1")
    open_ = exact.where("gold_id is null").withColumn("__k", F.row_number().over(W.partitionBy("hypothesis", "premise").orderBy(seq)))
    second = open_.drop("gold_id", "label").join(loose.select("hypothesis", "premise", "__k", "gold_id", "label"), ["hypothesis", "premise", "__k"], "left").drop("__k")
    source = F.when(F.col("gold_id").isNull(), "inferred").otherwise(F.col("__source"))
    both = exact.where("gold_id is not null").withColumn("__source", F.lit("exact")).unionByName(second.withColumn("__source", F.lit("fallback")))
    return both.select(seq, "hypothesis", "premise", "article", "prediction", "gold_id", F.coalesce("label", F.lit(LABELS[2])).alias("gold"), source.alias("gold_source"))


def misses(gold: DataFrame, aligned: DataFrame) -> DataFrame:
    """Reviewed rows that no prediction was aligned with; relevant labels are misses of retrieval."""
    left = gold.join(aligned.where("gold_id is not null").select("gold_id").distinct(), "gold_id", "left_anti")
    status = F.when(F.col("label").isin(*LABELS[:2]), RAG_MISS).otherwise("irrelevant_not_retrieved")
    return left.withColumn("status", status)


def total_scope(aligned: DataFrame, missed: DataFrame) -> DataFrame:
    """gold, prediction of aligned rows, and misses of retrieval as wrong predictions."""
    return aligned.select("gold", "prediction").unionByName(missed.where(F.col("status") == RAG_MISS).select(F.col("label").alias("gold"), F.lit(RAG_MISS).alias("prediction")))


def miss_summary(missed: DataFrame, by: str) -> DataFrame:
    """Misses by label and document, and of all documents (document null)."""
    return missed.where(F.col("status") == RAG_MISS).groupBy("label", F.col(by).alias("document")).count().unionByName(
        missed.where(F.col("status") == RAG_MISS).groupBy("label").count().select("label", F.lit(None).cast(missed.schema[by].dataType).alias("document"), "count")
    ).withColumnRenamed("count", "n")


def error_type(gold: str = "gold", prediction: str = "prediction") -> Column:
    """Taxonomy of a prediction: correct, invalid, missed, false and confused labels."""
    g, p = F.col(gold), predicted(prediction)
    return (
        F.when(p == RAG_MISS, "retrieval_miss").when(p == INVALID, "invalid_output").when(g == p, "correct")
        .when(p == LABELS[0], "false_contradiction").when(g == LABELS[0], "missed_contradiction")
        .when(p == LABELS[1], "false_entailment").otherwise("missed_entailment")
    )


def relevance(label: str = "label") -> Column:
    """1 for contradiction and entailment, 0 for not mentioned, null for anything else."""
    return F.when(F.col(label).isin(*LABELS[:2]), 1).when(F.col(label) == LABELS[2], 0)


def best_threshold(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """threshold, precision, recall, f1 with the largest F1 of "score >= threshold"; ties go to the largest threshold.

    Scores are summed up first; the sums run over ranges of distinct scores.
    """
    by = rows.groupBy((-F.col(score)).alias("__down")).agg(F.sum(F.col(positive).cast("long")).alias("tp"), F.count("*").alias("n"))
    c = running(running(by, ["__down"], "tp", "__tp"), ["__down"], "n", "__n")
    every = by.agg(F.coalesce(F.sum("tp"), F.lit(0))).first()[0]
    p, r = ratio(F.col("__tp"), F.col("__n")), ratio(F.col("__tp"), F.lit(every))
    c = c.select((-F.col("__down")).alias("threshold"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))
    return c.orderBy(F.desc(F.round("f1", 12)), F.desc("threshold")).limit(1)
