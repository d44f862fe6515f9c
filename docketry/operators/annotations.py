"""Annotations of registry rows and of remarks: validation, actor rules, history, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.schemas import LABELS, RELEVANCE, reject

#: Statuses that an annotation may come with; the second stands for the first.
SUBMITTED = ("pending", "needs_review", "proposed", "approved", "excluded")
ACTIVE = ("proposed", "approved")
_EVENT = "struct<status:string,label:string,relevance:string,error_type:string,rule_id:string,rationale:string,actor:string,timestamp_utc:timestamp>"


def eligible_rules(split_rules: DataFrame | None, bundle_rules: DataFrame | None) -> DataFrame:
    """rule_id, name: the split's own copy of the rules if it has one, else the bundle's; both columns have to be filled."""
    rules = split_rules if split_rules is not None else bundle_rules
    if rules is None:
        raise FileNotFoundError("eligible expert rules are missing")
    rules = rules.select(F.col("rule_id").cast("string").alias("rule_id"), F.col("name").cast("string").alias("name"))
    gap = (F.coalesce("rule_id", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == "")
    reject(rules.where(gap).select(F.lit("invalid_rule").alias("rule"), F.coalesce("rule_id", "name").alias("key")))
    return rules


def _clean(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def normalised(annotations: DataFrame, rules: DataFrame) -> DataFrame:
    """Annotations with trimmed fields, lower-case status, label and relevance, and rule and error type told from each other.

    Adds problem: the first rule that an annotation breaks, null if none. An error type may be a rule's id or its name.
    """
    a = annotations.select(_clean("row_id").alias("row_id"), *(F.lower(_clean(c)).alias(c) for c in ("status", "label", "relevance")), *(_clean(c).alias(c) for c in ("error_type", "rule_id", "rationale")))
    a = a.withColumn("submitted_status", F.when(F.col("status") == "", "proposed").otherwise(F.col("status")))
    a = a.withColumn("status", F.when(F.col("submitted_status") == "needs_review", "pending").otherwise(F.col("submitted_status")))
    # as many rows as there are expert rules
    by_id = F.broadcast(rules.select(F.col("rule_id").alias("__id"), F.col("name").alias("__id_name")))
    by_name = F.broadcast(rules.groupBy(F.col("name").alias("__name")).agg(F.min("rule_id").alias("__name_id")))
    own = F.broadcast(rules.select(F.col("rule_id").alias("__own"), F.col("name").alias("__own_name")))
    a = a.join(by_id, F.col("error_type") == F.col("__id"), "left").join(by_name, F.col("error_type") == F.col("__name"), "left")
    told = F.coalesce("__id", "__name_id", F.lit(""))
    kind = F.coalesce("__id_name", "error_type")
    a = a.withColumn("__told", told).withColumn("error_type", kind).withColumn("__given", F.col("rule_id")).withColumn("rule_id", F.when(F.col("rule_id") != "", F.col("rule_id")).otherwise(F.col("__told")))
    a = a.join(own, F.col("rule_id") == F.col("__own"), "left")
    active, contra = F.col("status").isin(*ACTIVE), F.col("label") == LABELS[0]
    eligible = F.col("__id").isNotNull() | F.col("__name").isNotNull()
    problem = (
        F.when(F.col("row_id") == "", "no_row_id").when(~F.col("submitted_status").isin(*SUBMITTED), "unknown_status")
        .when((active | (F.col("status") == "pending")) & ~F.col("label").isin(*LABELS), "invalid_label").when((active | (F.col("status") == "pending")) & ~F.col("relevance").isin(*RELEVANCE), "invalid_relevance")
        .when(active & (F.col("rationale") == ""), "no_rationale").when(active & F.col("label").isin(*LABELS[:2]) & (F.col("relevance") != "related"), "has_to_be_related")
        .when((F.col("__given") != "") & (F.col("__told") != "") & (F.col("__given") != F.col("__told")), "rule_and_error_type_disagree")
        .when(active & contra & ~eligible, "no_eligible_error_type").when(active & contra & (F.col("rule_id") != "") & ~F.coalesce(F.col("__own_name") == F.col("error_type"), F.lit(False)), "rule_and_error_type_disagree")
        .when(active & ~contra & (F.col("error_type") != ""), "error_type_without_contradiction").when(active & (F.col("rule_id") != "") & F.col("__own").isNull(), "unknown_rule")
    )
    return a.withColumn("problem", problem).drop("__id", "__id_name", "__name", "__name_id", "__told", "__given", "__own", "__own_name")


def import_annotations(registry: DataFrame, annotations: DataFrame, rules: DataFrame, human: bool = False, skip_excluded: bool = False) -> DataFrame:
    """``registry`` after an import; every annotation is checked first, and one that breaks a rule stops all.

    ``registry``: row_id, status, label, relevance, error_type, rule_id, annotation_rationale, annotation_history (array of events).
    A human's proposal is an approval; only humans approve. Excluded rows take no annotation, or are skipped if asked. Active
    statuses set the row's label, relevance, error type, rule and rationale; every import adds an event to the history.
    """
    a = normalised(annotations, rules)
    state = registry.select(F.col("row_id").alias("__row"), F.col("status").alias("__status"))
    both = a.join(state, F.col("row_id") == F.col("__row"), "left")
    if skip_excluded:
        both = both.where(F.coalesce(F.col("__status") != "excluded", F.lit(True)))
    problem = F.coalesce("problem", F.when(F.col("__row").isNull(), "unknown_row").when(F.col("__status") == "excluded", "excluded_row").when(F.lit(not human) & (F.col("status") == "approved"), "only_humans_approve"))
    twice = a.groupBy("row_id").count().where("count > 1").select(F.lit("repeated_row").alias("rule"), F.col("row_id").alias("key"))
    reject(both.select(problem.alias("rule"), F.col("row_id").alias("key")).where("rule is not null"), twice)
    status = F.when(F.lit(human) & (F.col("status") == "proposed"), "approved").otherwise(F.col("status"))
    new = both.withColumn("status", status)
    fields = ("status", "label", "relevance", "error_type", "rule_id", "rationale")
    event = F.struct(*fields, F.lit("human" if human else "subagent").alias("actor"), F.current_timestamp().alias("timestamp_utc")).cast(_EVENT)
    new = new.select("row_id", event.alias("__e"))
    joined = registry.join(new, "row_id", "left")
    active = F.coalesce(F.col("__e.status").isin(*ACTIVE), F.lit(False))
    take = lambda column, of: F.when(active, F.col(f"__e.{of}")).otherwise(F.col(column)).alias(column)
    changed = {"label": "label", "relevance": "relevance", "error_type": "error_type", "rule_id": "rule_id", "annotation_rationale": "rationale"}
    history = F.when(F.col("__e").isNotNull(), F.concat(F.coalesce("annotation_history", F.array().cast(f"array<{_EVENT}>")), F.array("__e"))).otherwise(F.col("annotation_history"))
    out = {c: take(c, changed[c]) if c in changed else F.col(c) for c in registry.columns}
    out |= {"status": F.coalesce("__e.status", "status").alias("status"), "annotation_history": history.alias("annotation_history")}
    return joined.select(*(out[c] for c in registry.columns))


def merge_overrides(remarks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Suggested annotations of ``remarks`` (remark_id, remark_text, category, targets) with local overrides put in.

    ``overrides``: remark_id, text_sha256 (of the text that was annotated), category, targets; null fields leave the suggestion.
    Unknown ids, changed texts, unknown categories, targets of repealed remarks and missing targets are errors.
    """
    r = remarks.withColumn("text_sha256", F.sha2(F.col("remark_text").cast("binary"), 256))
    o = overrides.select(F.col("remark_id").alias("__id"), F.col("text_sha256").alias("__hash"), F.col("category").alias("__category"), F.col("targets").alias("__targets"))
    both = r.join(o, F.col("remark_id") == F.col("__id"), "full")
    out = both.withColumn("category", F.coalesce("__category", "category")).withColumn("targets", F.coalesce("__targets", "targets"))
    n = F.coalesce(F.size("targets"), F.lit(0))
    rule = (
        F.when(F.col("remark_id").isNull(), "unknown_remark").when(F.col("__id").isNotNull() & ~F.col("__hash").eqNullSafe(F.col("text_sha256")), "stale_annotation").when(~F.col("category").between(0, 9), "unknown_category")
        .when((F.col("category") == 9) & (n > 0), "repealed_with_targets").when((F.col("category") != 9) & (n == 0), "no_target")
    )
    reject(out.select(rule.alias("rule"), F.coalesce("remark_id", "__id").alias("key")).where("rule is not null"))
    return out.select(*r.columns)
