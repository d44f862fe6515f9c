"""Variants, refreshes and release gates of a curated dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.operators.curation import apply_edits, edits_are_valid
from docketry.operators.laws import leaders, similar_pairs
from docketry.schemas import LABELS
from docketry.shared import settled


def apply_variants(documents: DataFrame, variants: DataFrame, caps: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Edited documents, and the violations of variants that can't be applied.

    ``documents``: source_id, split, text, active. ``variants``: source_id, variant_id, edits, seq. A variant needs an active source
    and edits whose offsets fit; of each source the first ``caps[split]`` are taken. Outside train a source that has a
    variant is no longer active itself.
    """
    v = variants.join(documents.select("source_id", "split", "text", F.col("active").alias("__source")), "source_id", "left")
    rule = F.when(F.col("text").isNull(), "unknown_source").when(~F.col("__source"), "inactive_source").when(~edits_are_valid("text", "edits"), "edits_do_not_fit")
    v = v.withColumn("rule", rule)
    cap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("split")), F.lit(0))
    nth = F.row_number().over(W.partitionBy("source_id").orderBy("seq", "variant_id"))
    taken = v.where("rule is null").withColumn("__n", nth).where(F.col("__n") <= cap)
    edited = taken.select("source_id", "variant_id", "split", apply_edits("text", "edits").alias("text"), F.lit(True).alias("active"))
    has = taken.select(F.col("source_id").alias("__s")).distinct()
    originals = documents.join(has, F.col("source_id") == F.col("__s"), "left").select(
        "source_id", F.lit("original").alias("variant_id"), "split", "text", (F.col("active") & (F.col("__s").isNull() | (F.col("split") == "train"))).alias("active")
    )
    bad = v.where("rule is not null").select("rule", F.concat_ws("/", "source_id", "variant_id").alias("key"))
    return originals.unionByName(edited), bad


def refresh_filter(rows: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Registry rows (id, doc_id, start, sentence, status) against a new extraction: rejected ones and repeats are excluded, with the reason.

    ``hypotheses``: doc_id, start, kept, reason as ``extract_hypotheses`` gives.
    """
    h = hypotheses.select("doc_id", "start", F.col("kept").alias("__kept"), F.col("reason").alias("__reason"))
    nth = F.row_number().over(W.partitionBy("doc_id", "sentence").orderBy("start", "id"))
    df = rows.join(h, ["doc_id", "start"], "left").withColumn("__n", nth)
    reason = F.when(F.col("__kept").isNull(), "not_extracted").when(~F.col("__kept"), F.col("__reason")).when(F.col("__n") > 1, "duplicate")
    return df.withColumn("exclusion", reason).withColumn("status", F.when(reason.isNotNull(), "excluded").otherwise(F.col("status"))).drop("__kept", "__reason", "__n")


def rules_changed(before: DataFrame, after: DataFrame, core: tuple[str, ...] = ("name", "kind", "weight_percent", "instruction")) -> DataFrame:
    """Violations of a rule refresh: rules that came, went or changed in a core column."""
    a, b = (df.select("rule_id", F.to_json(F.struct(*core), {"ignoreNullFields": "false"}).alias(n)) for df, n in ((before, "a"), (after, "b")))
    rule = F.when(F.col("b").isNull(), "rule_removed").when(F.col("a").isNull(), "rule_added").when(F.col("a") != F.col("b"), "core_changed")
    return a.join(b, "rule_id", "full").select(rule.alias("rule"), F.col("rule_id").cast("string").alias("key")).where("rule is not null")


def rebuild_validation(balanced: DataFrame, expert: DataFrame, keys: tuple[str, ...] = ("premise", "hypothesis")) -> tuple[DataFrame, DataFrame]:
    """Balanced and expert rows with their origin, and the expert rows whose pair is there already (to be rejected)."""
    out = balanced.withColumn("origin", F.lit("balanced")).unionByName(expert.withColumn("origin", F.lit("expert")), allowMissingColumns=True)
    twice = expert.join(balanced.select(*keys).distinct(), list(keys), "left_semi")
    return out, twice.select(F.lit("pair_exists").alias("rule"), F.concat_ws(" | ", *keys).alias("key"))


def enrich_errors(errors: DataFrame, variants: DataFrame, texts: DataFrame) -> DataFrame:
    """Errors (source_id, variant_id, ..) with their variant's edits and the text they refer to."""
    return errors.join(variants.select("source_id", "variant_id", "edits"), ["source_id", "variant_id"], "left").join(texts.select("source_id", "variant_id", "text"), ["source_id", "variant_id"], "left")


def release_gate(rows: DataFrame, plan_signature: str | None, population_signature: str) -> DataFrame:
    """Violations of a release: rows that aren't approved, but for proposed train rows under a plan of this very population."""
    fresh = plan_signature == population_signature
    ok = (F.col("status") == "approved") | (F.lit(fresh) & (F.col("split") == "train") & (F.col("status") == "proposed"))
    live = rows.where(F.col("active") & (F.col("status") != "excluded"))
    return live.where(~ok).select(F.when((F.col("split") == "train") & F.lit(not fresh), "stale_plan").otherwise("not_approved").alias("rule"), F.col("id").cast("string").alias("key"))


def bundle_violations(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Constraint suite of a bundle: repeated ids, unknown documents, changed text hashes, labels, error types, repeated pairs."""
    from docketry.functions.keys import text_digest
    from docketry.schemas import blank, label_domain, violations

    d = documents.select("source_id", text_digest("text").alias("__hash"))
    j = rows.join(d, "source_id", "left")
    contra = F.col("label") == LABELS[0]
    rules = violations(j, "id", {
        "unknown_document": F.col("__hash").isNull(), "changed_text": F.col("__hash") != F.col("text_sha256"), "unknown_label": label_domain("label"),
        "error_type": F.coalesce(contra == blank("error_type"), F.lit(False)), "blank_hypothesis": blank("hypothesis"), "blank_premise": blank("premise"),
    })
    ids = rows.groupBy("id").count().where("count > 1").select(F.lit("repeated_id").alias("rule"), F.col("id").cast("string").alias("key"))
    pairs = rows.groupBy("source_id", "hypothesis", "premise").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select(F.lit("repeated_pair").alias("rule"), F.col("id").cast("string").alias("key"))
    return rules.unionByName(ids).unionByName(pairs)


# laws that sentences mention


def title_key(title: str | Column) -> Column:
    """Lower case, yo as ye, the country's name for its abbreviation, letters and digits only; as ``laws.normal_title``."""
    c = F.lower(F.col(title) if isinstance(title, str) else title)
    c = F.regexp_replace(F.translate(c, "ё", "е"), r"(?U)\bрф\b", "российской федерации")
    return F.trim(F.regexp_replace(c, r"[^а-я0-9]+", " "))


def resolve_laws(mentions: DataFrame) -> DataFrame:
    """``mentions`` (mention_id, number, year, title, dated) with law: the first mention of their number in their year.

    Without a number, a title is the earliest law of the year with a like title; of the titles that are like none, the earliest
    are laws. The first dated mention of a law represents it (``chosen``).
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    df = settled(mentions.select("*", blank("year").alias("__in"), blank("number").alias("__no"), F.coalesce(title_key("title"), F.lit("")).alias("__title")))
    by_number = df.where("__no <> ''").groupBy("__in", "__no").agg(F.min("mention_id").alias("law"))
    numbered = df.where("__no <> ''").select("__in", "__no", "__title").distinct().join(by_number, ["__in", "__no"])
    known = numbered.groupBy("__in", F.col("__title").alias("title")).agg(F.min("law").alias("law"))
    bare = settled(df.where("__no = ''").groupBy("__in", F.col("__title").alias("title")).agg(F.min("mention_id").alias("id")))

    def earliest(pairs: DataFrame, laws: DataFrame) -> DataFrame:
        return pairs.join(laws.withColumnRenamed("title", "y"), ["__in", "y"]).groupBy("__in", F.col("x").alias("title")).agg(F.min("law").alias("law"))

    aliased = settled(earliest(similar_pairs(bare, known, ["__in"]), known))
    rest = settled(bare.join(aliased, ["__in", "title"], "left_anti"))
    like = settled(similar_pairs(rest, rest, ["__in"]).where("x <> y"))
    one, two = rest.withColumnRenamed("title", "x"), rest.select("__in", F.col("title").alias("y"), F.col("id").alias("before"))
    first = leaders(rest, like.join(one, ["__in", "x"]).join(two, ["__in", "y"]).where("before < id"))
    new = settled(rest.join(first, "id").select("__in", "title", F.col("id").alias("law")))
    later = earliest(like, new).join(new, ["__in", "title"], "left_anti")
    by_title = aliased.unionByName(new).unionByName(later)
    told = df.where("__no <> ''").join(by_number, ["__in", "__no"]).unionByName(df.where("__no = ''").join(by_title.withColumnRenamed("title", "__title"), ["__in", "__title"]))
    # a law's own first dated mention, found by an aggregate: a law may have any number of mentions
    best = told.groupBy("law").agg(F.min_by("mention_id", F.struct(~F.col("dated"), "mention_id")).alias("__best"))
    out = told.join(best, "law").withColumn("chosen", F.col("mention_id") == F.col("__best"))
    return out.select(*mentions.columns, "law", "chosen")
