"""Lookups of saved results, job matrices, score tables and manifests of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.keys import digest_id, loose_key
from docketry.schemas import ConstraintError, reject


def saved_pair_recall(gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """faiss, rules and total recall of each dataset, from saved pairs.

    ``gold``: dataset, document, sentence_index, gold (array of citation keys); without gold an occurrence takes no part. ``pairs``:
    dataset, document, sentence_index, retrieval_method, key (citation key of the pair's source). An occurrence went by rules if
    all of its pairs are exact.
    """
    at = ["dataset", "document", "sentence_index"]
    held = pairs.groupBy(*at).agg(F.collect_set("key").alias("keys"), F.bool_and(F.col("retrieval_method") == "exact").alias("exact"))
    rows = gold.where(F.size("gold") > 0).withColumn("gold", F.array_distinct("gold")).join(held, at, "left")
    hits = F.coalesce(F.size(F.array_intersect("gold", "keys")), F.lit(0))
    rows = rows.select("dataset", hits.alias("hits"), F.size("gold").alias("n"), F.when(F.col("exact"), "rules").otherwise("faiss").alias("system"))
    part = lambda s: F.try_divide(F.sum(F.when(F.col("system") == s, F.col("hits"))).cast("double"), F.sum(F.when(F.col("system") == s, F.col("n"))).cast("double"))
    return rows.groupBy("dataset").agg(part("faiss").alias("faiss_recall"), part("rules").alias("rules_recall"), (F.sum("hits").cast("double") / F.sum("n")).alias("total_recall"))


def exactly_one(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each of ``wanted`` (keys): a key without a row, or with several, is an error."""
    asked = wanted.select(*keys).distinct()
    n = asked.join(rows.withColumn("__there", F.lit(1)), keys, "left").groupBy(*keys).agg(F.count("__there").alias("n"))
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    reject(n.where("n <> 1").select(F.when(F.col("n") == 0, "not_found").otherwise("found_more_than_once").alias("rule"), name.alias("key")))
    return rows.join(asked, keys)


def grid_winners(scores: DataFrame, winners: DataFrame) -> DataFrame:
    """The score row of each winner (model, recipe_id) of a grid, exactly one each."""
    return exactly_one(scores, winners, ["model", "recipe_id"])


def hypothesis_id(source: str, start: str, text: str) -> Column:
    return F.concat(F.lit("hyp_"), digest_id(source, start, text, length=20))


def find_target(targets: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Targets (source_id, target_id) with their original hypothesis (source_id, start, text), told by its recomputed id, exactly one."""
    named = hypotheses.withColumn("target_id", hypothesis_id("source_id", "start", "text"))
    return exactly_one(named, targets, ["source_id", "target_id"])


# variants and datasets


def select_variants(asked: list[str] | None, known: dict[str, str | None], rerankers: tuple[str, ...]) -> list[str]:
    """Names of retrieval variants in order: known, each once, their reranker there; all that can run, in the order known, if none are asked for."""
    if asked is None:
        return [v for v, needs in known.items() if needs is None or needs in rerankers]
    if not asked or len(set(asked)) != len(asked):
        raise ConstraintError("variants have to be named, each once")
    for v in asked:
        if v not in known:
            raise ConstraintError(f"unknown variant: {v}")
        if known[v] is not None and known[v] not in rerankers:
            raise ConstraintError(f"variant {v} needs the reranker {known[v]}")
    return asked


def scored_datasets(rows: DataFrame, datasets: tuple[str, ...]) -> DataFrame:
    """Rows (test_dataset, task, gold, prediction) to be scored by dataset and task; other datasets and datasets without rows are errors."""
    known = rows.sparkSession.createDataFrame([(d,) for d in datasets], "test_dataset string")
    other = rows.join(F.broadcast(known), "test_dataset", "left_anti").select(F.lit("unknown_dataset").alias("rule"), F.col("test_dataset").alias("key")).distinct()  # one row for each dataset named
    none = known.join(rows.select("test_dataset").distinct(), "test_dataset", "left_anti").select(F.lit("empty_dataset").alias("rule"), F.col("test_dataset").alias("key"))
    reject(other, none)
    return rows


def review_snapshot(rows: DataFrame) -> DataFrame:
    """One row for each reviewed row (document, hypothesis, premise, article_number, expert_label) with its key of collapsed texts."""
    return rows.select(F.struct(loose_key("hypothesis").alias("hypothesis"), loose_key("premise").alias("premise")).alias("pair_key"), "document", "hypothesis", "premise", "article_number", F.trim("expert_label").alias("label"))


def with_dataset(df: DataFrame, dataset: str, column: str = "test_dataset") -> DataFrame:
    """``df`` with the dataset's name as its first column."""
    return df.select(F.lit(dataset).alias(column), *[c for c in df.columns if c != column])


# jobs, scores and manifests


def job_matrix(families: DataFrame, models: DataFrame) -> DataFrame:
    """Every family with every model, named by a job id; both are small tables of a campaign."""
    return families.crossJoin(F.broadcast(models)).withColumn("job_id", F.concat_ws("/", "family", "model"))


def decorated(scores: DataFrame, **ids: str) -> DataFrame:
    """Scores with the ids of their job in front."""
    return scores.select(*(F.lit(v).alias(k) for k, v in ids.items()), *[c for c in scores.columns if c not in ids])


def compact_scores(scores: DataFrame, scope: str, dataset: str, task: str, names: dict[str, str], metrics: list[str], order: list[str]) -> DataFrame:
    """Scores of one scope, dataset and task: short names of models, metrics rounded half-even to two places, in the given order of models."""
    short = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("model")), F.col("model")) if names else F.col("model")
    df = scores.where((F.col("evaluation_scope") == scope) & (F.col("test_dataset") == dataset) & (F.col("task") == task)).select(short.alias("model"), *(F.bround(m, 2).alias(m) for m in metrics))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model")) if order else F.lit(0)
    return df.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), "model")


def export_manifest(rows: DataFrame, label: str = "label", source: str = "source_id") -> DataFrame:
    """measure, key, value: rows, rows of each label, sources, and a digest of all rows that doesn't depend on their order."""
    line = F.xxhash64(*(F.col(c).cast("string") for c in rows.columns)).cast("decimal(38,0)")
    one = rows.agg(F.count("*").cast("string").alias("rows"), F.count_distinct(source).cast("string").alias("sources"), F.sum(line).cast("string").alias("digest"))
    totals = one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.lit("").alias("key"), F.col(m).alias("value")) for m in ("rows", "sources", "digest")))).alias("e")).select("e.*")
    return totals.unionByName(rows.groupBy(F.col(label).alias("key")).agg(F.count("*").cast("string").alias("value")).select(F.lit("label").alias("measure"), "key", "value"))


def length_summary(rows: DataFrame, length: str | Column, most: int) -> DataFrame:
    """rows, shortest, longest, truncated: lengths by an injected count of tokens against the largest that a model takes."""
    n = F.col(length) if isinstance(length, str) else length
    return rows.agg(F.count("*").alias("rows"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.count_if(n > most).alias("truncated"))


def guard_lengths(rows: DataFrame, length: str, most: int, name: str) -> DataFrame:
    """``rows`` as they are, if none is longer than ``most`` tokens: nothing is cut, what is too long is named."""
    reject(rows.where(F.col(length) > most).select(F.lit("too_long").alias("rule"), F.col(name).cast("string").alias("key")))
    return rows
