"""Differences between snapshots and runs, summaries, citation comparison and integrity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key with the key's row count as n_rows."""
    w = W.partitionBy(key)
    return rows.withColumn("n_rows", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy(order))).where("__n = 1").drop("__n")


def snapshot_diff(legacy: DataFrame, current: DataFrame, key: str = "pair_key", order: str = "seq", label: str = "label") -> DataFrame:
    """Full outer join of the first rows by key: status, both labels, both counts, whether the label changed."""
    a = first_per_key(legacy, key, order).select(key, F.col(label).alias("legacy_label"), F.col("n_rows").alias("legacy_rows"))
    b = first_per_key(current, key, order).select(key, F.col(label).alias("current_label"), F.col("n_rows").alias("current_rows"))
    status = F.when(F.col("current_rows").isNull(), "legacy_only").when(F.col("legacy_rows").isNull(), "current_only").otherwise("shared")
    out = a.join(b, key, "full").withColumn("status", status)
    return out.withColumn("label_changed", (F.col("status") == "shared") & ~F.col("legacy_label").eqNullSafe(F.col("current_label")))


def snapshot_summary(rows: DataFrame, key: str, label: str, workbook: str) -> DataFrame:
    """measure, value: rows, distinct keys, distinct workbooks, rows of each label."""
    base = rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_pairs"), F.count_distinct(workbook).alias("workbooks"))
    base = base.select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("rows", "distinct_pairs", "workbooks")))).alias("e")).select("e.*")
    return base.unionByName(rows.groupBy(F.concat(F.lit("label:"), F.coalesce(label, F.lit(""))).alias("measure")).agg(F.count("*").alias("value")))


def run_diff(before: DataFrame, after: DataFrame, key: str = "pair_key", order: str = "seq", value: str = "prediction") -> DataFrame:
    """Full outer join on key and running occurrence: status, both values, whether they differ."""
    numbered = lambda df, name: df.select(key, (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).alias("occurrence"), F.col(value).alias(name), F.lit(True).alias(f"in_{name}"))
    out = numbered(before, "before").join(numbered(after, "after"), [key, "occurrence"], "full")
    status = F.when(F.col("in_after").isNull(), "removed").when(F.col("in_before").isNull(), "added").otherwise("shared")
    out = out.withColumn("status", status).withColumn("changed", (F.col("status") == "shared") & ~F.col("before").eqNullSafe(F.col("after")))
    return out.drop("in_before", "in_after")


def run_diff_summary(diff: DataFrame) -> DataFrame:
    """measure, value in long form."""
    measures = {"shared": F.col("status") == "shared", "added": F.col("status") == "added", "removed": F.col("status") == "removed", "changed": F.col("changed"), "unchanged": (F.col("status") == "shared") & ~F.col("changed")}
    one = diff.agg(*(F.count(F.when(c, 1)).alias(m) for m, c in measures.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures))).alias("e")).select("e.*")


def alignment_summary(aligned: DataFrame, by: tuple[str, ...] = ("status", "gold_source", "error_type")) -> DataFrame:
    """Rows of each combination; nulls are values."""
    return aligned.groupBy(*by).agg(F.count("*").alias("n"))


def finding_notes(rows: DataFrame, label: str, gold: str, prediction: str, route: str) -> DataFrame:
    """True and false positives of a label by retrieval route, with a sentence for each."""
    hit = F.col(prediction) == label
    c = rows.groupBy(route).agg(F.count(F.when(hit & (F.col(gold) == label), 1)).alias("tp"), F.count(F.when(hit & (F.col(gold) != label), 1)).alias("fp"))
    return c.withColumn("note", F.format_string("%s: %d true and %d false positives", F.col(route), "tp", "fp"))


def annotation_alignment(occurrences: DataFrame, gold: DataFrame, key: str = "hypothesis_key") -> tuple[DataFrame, DataFrame]:
    """Document occurrences with gold by key, and the occurrences without."""
    both = occurrences.join(gold, key, "left_semi").join(gold, key)
    return both, occurrences.join(gold, key, "left_anti")


def fallback_merge(primary: DataFrame, extra: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Left-biased union of keyed arrays, and the keys at which both sides hold different sets (to be rejected)."""
    both = primary.select(key, F.col(value).alias("a")).join(extra.select(key, F.col(value).alias("b")), key, "full")
    clash = both.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.array_sort(F.array_distinct("a")) != F.array_sort(F.array_distinct("b"))))
    return both.select(key, F.coalesce("a", "b").alias(value)), clash.select(F.lit("conflicting_gold").alias("rule"), F.col(key).cast("string").alias("key"))


def first_duplicate(rows: DataFrame, value: str, location: str, order: str) -> DataFrame:
    """Rows that repeat a value, with the location that had it first."""
    w = W.partitionBy(value).orderBy(order)
    df = rows.where(F.col(value).isNotNull()).withColumn("first_location", F.first(location).over(w)).withColumn("__n", F.row_number().over(w))
    return df.where("__n > 1").drop("__n")


def pivot_metric(rows: DataFrame, row: str, column: str, values: list[str], metrics: dict[str, Column]) -> DataFrame:
    """One row for each ``row`` value and one column for each column value and metric, rounded half-even to two places."""
    return rows.groupBy(row).pivot(column, values).agg(*(F.bround(c, 2).alias(m) for m, c in metrics.items()))


def ordered(rows: DataFrame, column: str, values: list[str], *more: str) -> DataFrame:
    """Rows in the given order of values, others last."""
    place = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    return rows.orderBy(F.when(place == 0, len(values) + 1).otherwise(place), *more)


def saved_recall_check(saved: DataFrame, recomputed: DataFrame, keys: list[str], value: str = "recall", tolerance: float = 1e-12) -> DataFrame:
    """Keys whose saved value isn't within ``tolerance`` of the recomputed one, or is missing on a side."""
    j = saved.select(*keys, F.col(value).alias("a")).join(recomputed.select(*keys, F.col(value).alias("b")), keys, "full")
    return j.where(~(F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))))
