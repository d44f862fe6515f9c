"""Audit of citations: what a text cites against what experts cited and what the corpus has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.citations import article_reference, extract_citations
from docketry.functions.keys import loose_key
from docketry.operators.retrieval import exact_lookup, led_by, unit_lists, unit_ways
from docketry.schemas import violations

SCOPES = ("all", "rules", "faiss")


def full_keys(citations: str | Column) -> Column:
    """Distinct keys of citations: four collapsed lower-case strings each."""
    return _keys(citations, ("code", "article", "part", "point"))


def article_keys(citations: str | Column) -> Column:
    return _keys(citations, ("code", "article"))


def _keys(citations: str | Column, fields: tuple[str, ...]) -> Column:
    c = F.col(citations) if isinstance(citations, str) else citations
    return F.array_distinct(F.transform(c, lambda x: F.struct(*(loose_key(x[f]).alias(f) for f in fields))))


def comparison_status(annotated: Column, gold_full: Column, detected_full: Column, gold_articles: Column, detected_articles: Column) -> Column:
    """How the citations of a text compare with the experts': by articles first, then by parts and points."""
    missed, extra = (F.size(F.array_except(a, b)) > 0 for a, b in ((gold_articles, detected_articles), (detected_articles, gold_articles)))
    same = (F.size(F.array_except(gold_full, detected_full)) == 0) & (F.size(F.array_except(detected_full, gold_full)) == 0)
    return (
        F.when(~annotated, "missing_annotation").when((F.size(gold_full) == 0) & (F.size(detected_full) == 0), "no_articles").when(missed & extra, "mixed").when(missed, "missed_expert")
        .when(extra, "extracted_not_in_expert").when(same, "matched_full").otherwise("matched_article_subprovision_diff")
    )


def audit_occurrences(occurrences: DataFrame, gold: DataFrame, units: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Each of ``occurrences`` (dataset, document, sentence_index, hypothesis) with its citations and how they compare.

    ``gold``: hypothesis_key, gold (array of citations), which annotates all occurrences of that key. ``units``: unit_id, code,
    article, part, point. Adds retrieval_route (``rules`` if any citation leads to a unit), annotated, gold, detected, resolved,
    unresolved, their keys in full and by article, and comparison_status.
    """
    key = ["dataset", "document", "sentence_index"]
    none = F.array().cast("array<struct<code:string,article:string,part:string,point:string>>")
    rows = occurrences.withColumn("hypothesis_key", loose_key("hypothesis")).join(gold.select("hypothesis_key", "gold", F.lit(True).alias("annotated")), "hypothesis_key", "left")
    rows = rows.withColumn("annotated", F.coalesce("annotated", F.lit(False))).withColumn("gold", F.coalesce("gold", none)).withColumn("detected", extract_citations(aliases)("hypothesis"))
    rows = rows.withColumn("hypothesis_id", F.struct(*key))
    cited = rows.select("hypothesis_id", F.posexplode("detected").alias("citation_no", "c")).select("hypothesis_id", "citation_no", "c.*")
    own = units.select("unit_id", *(F.col(c).alias(f"own_{c}") for c in ("code", "article", "part", "point")))
    met = exact_lookup(cited, units).join(own, "unit_id")
    found = met.groupBy("hypothesis_id").agg(
        F.array_sort(F.collect_set(F.struct(*(F.col(f"own_{c}").alias(c) for c in ("code", "article", "part", "point"))))).alias("resolved"), F.collect_set("citation_no").alias("__nos")
    )
    out = rows.join(found, "hypothesis_id", "left").withColumn("resolved", F.coalesce("resolved", none))
    nos = F.coalesce("__nos", F.array().cast("array<int>"))
    out = out.withColumn("unresolved", F.filter("detected", lambda x, i: ~F.array_contains(nos, i))).withColumn("retrieval_route", F.when(F.size("resolved") > 0, "rules").otherwise("faiss"))
    for name in ("gold", "detected"):
        out = out.withColumn(f"{name}_full", full_keys(name))
    for name in ("gold", "detected", "resolved"):
        out = out.withColumn(f"{name}_articles", article_keys(name))
    status = comparison_status(F.col("annotated"), F.col("gold_full"), F.col("detected_full"), F.col("gold_articles"), F.col("detected_articles"))
    return out.withColumn("comparison_status", status).drop("__nos", "hypothesis_id")


def in_scope(audit: DataFrame, scope: str) -> DataFrame:
    """Rows of a routing scope: all, or those that went by rules or by vectors."""
    if scope not in SCOPES:
        raise ValueError(f"the routing scope has to be one of {', '.join(SCOPES)}")
    return audit if scope == "all" else audit.where(F.col("retrieval_route") == scope)


def references(citations: str) -> Column:
    """Labels of citations, a line each."""
    return F.array_join(F.filter(F.transform(F.col(citations), lambda c: F.concat_ws(" ", c["code"], F.concat(F.lit("ст. "), c["article"]), F.concat(F.lit("ч. "), c["part"]), F.concat(F.lit("п. "), c["point"]))), lambda x: x != ""), "\n")


def hypothesis_rows(audit: DataFrame) -> DataFrame:
    """One row for each occurrence: references as text, and counts of matched, missed and further articles."""
    g, d = F.col("gold_articles"), F.col("detected_articles")
    return audit.select(
        "dataset", "document", "sentence_index", "retrieval_route", "hypothesis", F.when(F.col("annotated"), "annotated").otherwise("missing").alias("annotation_status"), "comparison_status",
        references("gold").alias("expert_references"), references("detected").alias("detected_references"), references("resolved").alias("resolved_references"), references("unresolved").alias("unresolved_references"),
        F.size(F.array_intersect(g, d)).alias("matched_articles"), F.size(F.array_except(g, d)).alias("missed_expert_articles"), F.when(F.col("annotated"), F.size(F.array_except(d, g))).alias("detected_not_in_expert"),
    )


def article_rows(audit: DataFrame) -> DataFrame:
    """One row for each article that experts or the text cite: status, and whether the corpus has it."""
    rows = audit.withColumn("a", F.explode(F.array_sort(F.array_union("gold_articles", "detected_articles"))))
    of = lambda c: F.filter(F.col(c), lambda x: (x["code"] == F.col("a.code")) & (x["article"] == F.col("a.article")))
    g, d = F.array_sort(of("gold_full")), F.array_sort(of("detected_full"))
    status = (
        F.when(~F.col("annotated"), "unannotated_extraction").when((F.size(g) > 0) & (F.size(d) == 0), "missed_expert").when((F.size(d) > 0) & (F.size(g) == 0), "extracted_not_in_expert")
        .when(g == d, "matched_full").otherwise("matched_article_subprovision_diff")
    )
    lookup = F.when(F.size(d) == 0, "not_extracted").when(F.array_contains("resolved_articles", F.col("a")), "resolved").otherwise("unresolved")
    return rows.select("dataset", "document", "sentence_index", "retrieval_route", "hypothesis", "a.code", "a.article", status.alias("comparison_status"), lookup.alias("exact_lookup_status"))


def summary(audit: DataFrame, scope: str = "all") -> DataFrame:
    """Seventeen measures for each dataset and over all (ALL).

    ``audit`` needs dataset, annotated and the arrays gold_full, detected_full, gold_articles, detected_articles and
    resolved_articles, of whatever keys.
    """
    marked = F.col("annotated")
    n = lambda c, cond=None: F.sum(F.size(c) if cond is None else F.when(cond, F.size(c)).otherwise(0))
    counted = audit.rollup("dataset").agg(
        F.count("*").alias("pipeline_hypotheses"), F.count_if(marked).alias("annotated_hypotheses"), F.count_if(~marked).alias("missing_annotation_hypotheses"),
        F.count_if(marked & (F.size("gold_articles") > 0)).alias("hypotheses_with_expert_articles"), n(F.col("gold_articles"), marked).alias("expert_articles"), n(F.col("detected_articles")).alias("detected_articles"),
        n(F.array_intersect("gold_articles", "detected_articles"), marked).alias("matched_articles"), n(F.array_except("gold_articles", "detected_articles"), marked).alias("missed_expert_articles"),
        n(F.array_except("detected_articles", "gold_articles"), marked).alias("detected_not_in_expert"), n(F.col("detected_articles"), ~marked).alias("detected_with_missing_annotation"),
        n(F.col("gold_full"), marked).alias("expert_full_references"), n(F.array_intersect("gold_full", "detected_full"), marked).alias("matched_full_references"),
        n(F.array_intersect("gold_articles", "resolved_articles"), marked).alias("resolved_expert_articles"), n(F.array_except("detected_articles", "resolved_articles")).alias("unresolved_detected_articles"),
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    out = counted.withColumn("dataset", F.coalesce("dataset", F.lit("ALL"))).withColumn("routing_scope", F.lit(scope)).withColumn("article_extraction_recall", rate("matched_articles", "expert_articles"))
    return out.withColumn("full_reference_recall", rate("matched_full_references", "expert_full_references")).withColumn("rule_retrieval_recall", rate("resolved_expert_articles", "expert_articles"))


def unit_lookup(units: DataFrame, cited: DataFrame) -> DataFrame:
    """Units of an article, narrowed by part and point where given: all of them, however many. ``cited``: key, code, article, part, point."""
    return led_by(cited, unit_lists(units)).select(*cited.columns, F.explode("listed").alias("__u")).select(*cited.columns, "__u.unit_id")


def unit_classes(units: DataFrame, cited: DataFrame) -> DataFrame:
    """key, same_as, unit_id: what ``unit_lookup`` gives, written once for all keys of equal citations.

    ``same_as`` is the smallest key of the same code, article, part and point. This key has one row for each unit; any other
    one row, without a unit: its units are those of ``same_as``. Keys that lead to no unit have no row. The result grows
    with keys and units, not with their product: a unit is under four different citations at most.
    """
    by = ["code", "article", "part", "point"]
    firsts = cited.groupBy(*by).agg(F.min("key").alias("same_as"))
    ways = unit_ways(units)
    found = led_by(firsts, ways).select(F.col("same_as").alias("key"), "same_as", "unit_id")
    known = led_by(firsts, ways.select(*by).distinct())
    later = led_by(cited.select("key", *by), known).where("key <> same_as").select("key", "same_as", F.lit(None).cast(found.schema["unit_id"].dataType).alias("unit_id"))
    return found.unionByName(later.distinct())


def gold_citations(rows: DataFrame, reference: str = "reference") -> tuple[DataFrame, DataFrame]:
    """``rows`` with the one citation of their gold reference, and violations: a reference has to name one article."""
    df = rows.withColumn("__c", extract_citations()(reference))
    key = F.col(reference)
    bad = violations(df, key, {"no_article": F.size("__c") == 0, "several_articles": F.size("__c") > 1})
    return df.where(F.size("__c") == 1).withColumn("citation", F.col("__c")[0]).drop("__c"), bad


def corpus_aliases(sources: DataFrame, known: tuple[str, ...], source: str = "source") -> DataFrame:
    """Distinct rows of a corpus with their parsed citation, and as aliases the names of codes that the grammar doesn't know."""
    from docketry.functions.citations import parse_source

    df = sources.dropDuplicates([source]).withColumn("citation", parse_source(source)).withColumn("label", article_reference(source, "citation"))
    name = F.col("citation.code")
    return df.withColumn("alias", F.when(name.isNotNull() & ~name.isin(*known), name))
