"""Generation of edited variants: candidates, reservations, schedules, tasks.

Candidates, what is reserved and what has failed come from aggregations and anti-joins in Spark. Of a held-out split the driver reads
the first sources in order, as many as slots are open. The dealing of rules to a train split, one hypothesis after the other, runs on
the driver over one small row for each candidate.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.keys import digest_id
from docketry.schemas import LABELS, ConstraintError, reject
from docketry.shared import discard, settled

#: Variants that a train hypothesis may have; a source of another split has one.
PER_HYPOTHESIS = 2


def digest(values: Iterable[object]) -> str:
    return hashlib.sha256(json.dumps(list(values), ensure_ascii=False).encode()).hexdigest()


# candidates


def candidates(rows: DataFrame) -> DataFrame:
    """source_id, hypothesis_id, text, start, end, provisions of the live original hypotheses in a registry.

    ``rows``: row_id, source_id, hypothesis_id, variant_id, status, hypothesis, start, end, unit_id, premise, article_number. A
    hypothesis has one text and one span, else it is an error; provisions come by row, each unit once.
    """
    live = rows.where("variant_id = 'original' and status <> 'excluded' and hypothesis_id is not null")
    unit = F.coalesce(F.nullif(F.col("unit_id"), F.lit("")), digest_id("premise", "article_number", length=64))
    first = live.withColumn("__unit", unit).groupBy("source_id", "hypothesis_id", "__unit").agg(
        F.min_by(F.struct("row_id", "unit_id", F.col("premise").alias("text"), "article_number"), "row_id").alias("p"), F.collect_set(F.struct("hypothesis", "start", "end")).alias("__texts")
    )
    out = first.groupBy("source_id", "hypothesis_id").agg(F.array_sort(F.collect_list("p")).alias("provisions"), F.array_distinct(F.flatten(F.collect_list("__texts"))).alias("__texts"))
    rule = F.when(F.size("__texts") != 1, "inconsistent_hypothesis").when(F.col("__texts")[0]["start"].isNull() | F.col("__texts")[0]["end"].isNull(), "no_offsets")
    reject(out.select(rule.alias("rule"), F.concat_ws("/", "source_id", "hypothesis_id").alias("key")).where("rule is not null"))
    t = F.col("__texts")[0]
    return out.select("source_id", "hypothesis_id", t["hypothesis"].alias("text"), t["start"].alias("start"), t["end"].alias("end"), "provisions")


def confirmed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources with an approved live contradiction, and the number of such rows of each rule."""
    good = rows.where(F.coalesce("active", F.lit(True)) & (F.col("status") == "approved") & (F.col("label") == LABELS[0]))
    rules = good.where(F.coalesce("rule_id", F.lit("")) != "").groupBy("rule_id").agg(F.count("*").alias("n"))
    return good.select("source_id").distinct(), rules


def hint_hits(text: Column, terms: Column) -> Column:
    """How many of a rule's terms a hypothesis has."""
    return F.size(F.filter(terms, lambda x: F.contains(F.lower(text), x)))


# assignments


def assignment_id(split: str | Column, source: str, hypothesis: str, rule: str) -> Column:
    split = F.lit(split) if isinstance(split, str) else split
    return F.concat(F.lit("gen_"), F.substring(F.sha2(F.to_json(F.array(split, *(F.col(c).cast("string") for c in (source, hypothesis, rule)))), 256), 1, 20))


def track(rule: str, controls: tuple[str, ...]) -> Column:
    return F.when(F.col(rule).isin(*controls), "control").otherwise("contradiction_candidate") if controls else F.lit("contradiction_candidate")


@dataclass
class Pick:
    source_id: str
    hypothesis_id: str
    rule_id: str
    round: int = 1


@dataclass
class Schedule:
    """What a split's plan gets: new assignments, what was asked of each rule, and what is short of it."""

    picks: list[Pick] = field(default_factory=list)
    requested: Counter = field(default_factory=Counter)
    shortage: Counter = field(default_factory=Counter)


@dataclass(frozen=True)
class Candidate:
    """A hypothesis to be edited; ``hits``: how many terms of each rule it has."""

    source_id: str
    hypothesis_id: str
    hits: dict[str, int]

    @property
    def key(self) -> tuple[str, str]:
        return self.source_id, self.hypothesis_id


def quotas(weights: dict[str, float], total: int, minimum: int = 0) -> Counter:
    """Shares of ``total`` by weight with a minimum each: floors first, then the largest remainders, in the order given."""
    rest, out = max(0, total - minimum * len(weights)), Counter()
    whole = sum(weights.values())
    exact = {r: rest * w / whole if whole else 0.0 for r, w in weights.items()}
    out.update({r: (minimum if total >= minimum * len(weights) else 0) + int(x) for r, x in exact.items()})
    order = sorted(weights, key=lambda r: -round(exact[r] - int(exact[r]), 9))
    for r in order[: max(0, rest - sum(map(int, exact.values())))]:
        out[r] += 1
    return out


def _best(c: Candidate, left: Counter, used: set[str]) -> tuple[int, int, str] | None:
    """The open rule with most hits, then the largest rest, then the largest id."""
    return max(((c.hits.get(r, 0), n, r) for r, n in left.items() if n > 0 and r not in used), default=None)


def schedule_train(found: list[Candidate], weights: dict[str, float], reserved: Counter, used: dict[tuple[str, str], set[str]]) -> Schedule:
    """Deal rules to train hypotheses in two rounds, so that each has one variant before any has two.

    ``reserved``: variants that hypotheses have or wait for; ``used``: rules that they have had, also in vain.
    """
    out, reserved = Schedule(), Counter(reserved)
    out.requested = quotas(weights, sum(max(0, PER_HYPOTHESIS - reserved[c.key]) for c in found))
    left = Counter(out.requested)
    for nth in range(PER_HYPOTHESIS):
        for c in found:
            if reserved[c.key] <= nth and (best := _best(c, left, used.setdefault(c.key, set()))):
                rule = best[2]
                out.picks.append(Pick(*c.key, rule, reserved[c.key] + 1))
                used[c.key].add(rule)
                reserved[c.key] += 1
                left[rule] -= 1
    out.shortage = Counter({r: n for r, n in left.items() if n > 0})
    return out


def apply_feedback(plan: DataFrame, feedback: DataFrame, unusable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A plan (source_id, target_hypothesis_id, rule_id, planned_status, ...) as what still stands and what failed or is inactive.

    ``feedback``: source_id, target_hypothesis_id, rule_id, status, rationale, at; an assignment whose last word on failure is
    ``needs_review`` gives its slot back, so does one whose applied variant can't be used (``unusable``, by the same three columns).
    Failed ones keep their place in the saved plan, with failure_reason.
    """
    key = ["source_id", "target_hypothesis_id", "rule_id"]
    said = feedback.where("status = 'needs_review'").groupBy(*key).agg(F.coalesce(F.max_by("rationale", "at"), F.lit("")).alias("__said"))
    out = plan.join(said, key, "left").join(unusable.select(*key, F.lit(True).alias("__unusable")).distinct(), key, "left")
    reason = F.coalesce("__said", F.when(F.col("__unusable"), "Applied variant lacks a usable retrieved contradiction target"))
    out = out.withColumn("failure_reason", reason).withColumn("planned_status", F.when(reason.isNotNull(), "needs_review").otherwise(F.col("planned_status")))
    out = out.select(*plan.columns, "failure_reason")
    gone = F.coalesce(F.col("planned_status").isin("needs_review", "inactive"), F.lit(False))
    return out.where(~gone).drop("failure_reason"), out.where(gone)


def _choices(found: DataFrame, barred: DataFrame, rules: list[str], seed: int, widest: bool) -> DataFrame:
    """One row for each source, by ``seeded``: for each rule that a hypothesis of it may still have, that hypothesis and its hits.

    ``widest``: the hypothesis with most hits of the rule, else the first; ties go to the smaller id. A source's hypotheses combine
    before the shuffle, so one with very many of them is no hot group.
    """
    key = ["source_id", "hypothesis_id", "rule_id"]
    each = found.where("source_id is not null and hypothesis_id is not null").select("source_id", "hypothesis_id", "hits", F.explode(F.array(*map(F.lit, rules))).alias("rule_id"))
    each = each.withColumn("n", F.coalesce(F.try_element_at("hits", "rule_id"), F.lit(0))).join(barred.select(*key).distinct(), key, "left_anti")
    first = F.struct(-F.col("n"), "hypothesis_id") if widest else F.struct("hypothesis_id", -F.col("n"))
    best = each.groupBy("source_id", "rule_id").agg(F.min_by(F.struct("hypothesis_id", "n"), first).alias("c"))
    return best.groupBy("source_id").agg(F.collect_list(F.struct("rule_id", "c.hypothesis_id", "c.n")).alias("choices")).withColumn("place", F.struct(seeded(seed, "source_id").alias("h"), "source_id"))


def _deal(choices: DataFrame, left: Counter, taken: set[str], widest: bool) -> list[Pick]:
    """Sources in order, as many at a time as there are open slots: each takes the best of its open rules."""
    picks, last, table = [], None, settled(choices)
    while open_ := sum(left.values()):
        rest = table if last is None else table.where(F.col("place") > F.struct(F.lit(last[0]).alias("h"), F.lit(last[1]).alias("source_id")))
        rows = rest.orderBy("place").limit(open_ + len(taken)).collect()
        for row in rows:
            own = [c for c in row.choices if left[c.rule_id] > 0]
            if not own or row.source_id in taken:
                continue
            if not widest:
                start = min(c.hypothesis_id for c in own)
                own = [c for c in own if c.hypothesis_id == start]
            c = max(own, key=lambda c: (c.n, left[c.rule_id], c.rule_id))
            picks.append(Pick(row.source_id, c.hypothesis_id, c.rule_id))
            left[c.rule_id] -= 1
        if len(rows) < open_ + len(taken):
            break
        last = tuple(rows[-1].place)
    discard(table)
    return picks


def schedule_heldout(
    found: DataFrame, barred: DataFrame, closed: DataFrame, weights: dict[str, float], controls: dict[str, float], target: int, least: int, reached: int, controlled: int, seed: int
) -> Schedule:
    """Deal rules to val or test sources, one variant each: contradictions up to ``target`` documents, then controls in proportion.

    ``found``: source_id, hypothesis_id, hits (map of rule to terms found); ``barred``: source_id, hypothesis_id, rule_id that were
    planned, applied or failed before; ``closed``: source_id of sources that are reserved or have a confirmed contradiction;
    ``reached``: sources that count toward the target already; ``controlled``: sources that have a control; ``least``: documents that
    each rule gets if the target allows. Candidates without source or hypothesis take no part, nor do rules of hits that aren't
    asked for; repeated candidates count once.

    Spark reduces each source to one choice for each rule, drops what is barred and closed by anti-joins, and orders sources by a
    seeded hash. The driver reads as many of the first sources as there are open slots, so what it holds depends on ``target`` and
    the number of rules; it reads on only if sources were passed over.
    """
    out, open_ = Schedule(), max(0, target - reached)
    minimum = least if open_ >= least * len(weights) else 1 if open_ >= len(weights) else 0
    out.requested = quotas(weights, open_, minimum)
    free = found.join(closed.select("source_id").distinct(), "source_id", "left_anti")
    left = Counter(out.requested)
    out.picks = _deal(_choices(free, barred, list(weights), seed, True), left, set(), True)
    out.shortage = Counter({r: n for r, n in left.items() if n > 0})
    if controls:
        whole, share = sum(weights.values()), sum(controls.values())
        wanted = max(1, round(target * share / whole)) if target and share else 0
        left = quotas(controls, max(0, wanted - controlled))
        out.picks += _deal(_choices(free, barred, list(controls), seed, False), left, {p.source_id for p in out.picks}, False)
        out.shortage.update({f"control:{r}": n for r, n in left.items() if n > 0})
    return out


def seeded(seed: int, source: str) -> Column:
    """The place of a source in ``seeded_order``, as a column."""
    return F.sha2(F.concat(F.lit(f"[{seed}, "), F.expr(f"substring(to_json(array({source})), 2)")), 256)


def seeded_order(found: list[Candidate], seed: int) -> list[Candidate]:
    """Candidates by a seeded hash of their source, then by hypothesis."""
    return sorted(found, key=lambda c: (digest([seed, c.source_id]), c.hypothesis_id))


def revalidate_plan(plan: DataFrame, split: str, known: DataFrame, live: DataFrame, rules: DataFrame) -> DataFrame:
    """A saved plan (assignment_id, split, source_id, target_hypothesis_id, rule_id, planned_status) checked and brought up to date.

    Its split, hypotheses (``known``), rules and recomputed ids have to agree and ids be there once, else it is an error. An
    assignment whose pairs have all been excluded since (not in ``live``) is inactive.
    """
    key = ["source_id", "hypothesis_id"]
    p = plan.withColumn("hypothesis_id", F.col("target_hypothesis_id"))
    p = p.join(known.select(*key, F.lit(True).alias("__known")).distinct(), key, "left").join(live.select(*key, F.lit(True).alias("__live")).distinct(), key, "left")
    p = p.join(rules.select("rule_id", F.lit(True).alias("__rule")).distinct(), "rule_id", "left")
    bad = (F.col("split") != split) | F.col("__known").isNull() | F.col("__rule").isNull()
    fits = F.col("assignment_id") == assignment_id(F.col("split"), "source_id", "target_hypothesis_id", "rule_id")
    twice = plan.groupBy("assignment_id").count().where("count > 1").select(F.lit("repeated_assignment").alias("rule"), F.col("assignment_id").alias("key"))
    reject(p.where(bad | ~fits).select(F.lit("invalid_assignment").alias("rule"), F.col("assignment_id").alias("key")), twice)
    gone = F.col("__live").isNull()
    out = p.withColumn("planned_status", F.when(gone, "inactive").otherwise(F.col("planned_status"))).withColumn("inactive_reason", F.when(gone, "All original candidate pairs were excluded"))
    return out.select(*plan.columns, "inactive_reason")


def generation_tasks(plan: DataFrame, found: DataFrame, documents: DataFrame, rules: DataFrame, variants: DataFrame) -> DataFrame:
    """One task for each assignment: source text, target, expert rule, provisions and the source's other variants.

    ``found``: as ``candidates`` gives; ``documents``: source_id, text; ``rules``: rule_id and more; ``variants``: source_id,
    variant_id, edits. The text at the target's offsets has to be the target still.
    """
    p = plan.withColumnRenamed("target_hypothesis_id", "hypothesis_id").join(found.withColumnRenamed("text", "target_text"), ["source_id", "hypothesis_id"]).join(documents.select("source_id", F.col("text").alias("source_text")), "source_id")
    stale = F.substring(F.col("source_text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("target_text")
    reject(p.where(stale).select(F.lit("stale_offsets").alias("rule"), F.col("hypothesis_id").alias("key")))
    others = variants.where("variant_id <> 'original'").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in variants.columns if c != "source_id"]))).alias("existing_variants"))
    rule = rules.select("rule_id", F.struct(*rules.columns).alias("expert_rule"))
    target = F.struct("hypothesis_id", F.col("target_text").alias("text"), "start", "end").alias("target_hypothesis")
    return p.join(others, "source_id", "left").join(rule, "rule_id").select(F.col("assignment_id").alias("task_id"), F.lit("generate").alias("kind"), "split", "source_id", "source_text", target, "expert_rule", "provisions", "existing_variants")


def variants_of(variants: list[dict]) -> tuple[set[tuple[str, str, str]], Counter]:
    """(source, hypothesis, rule) of applied variants, and how many each has."""
    seen = Counter((v["source_id"], v["target_hypothesis_id"], v["rule_id"]) for v in variants if v["variant_id"] != "original" and v.get("target_hypothesis_id"))
    return set(seen), seen


def reservations(plan: list[Pick], applied: Counter) -> Counter:
    """Variants by hypothesis: a plan's assignment counts once, and so does each applied variant that no assignment stands for."""
    planned = {(p.source_id, p.hypothesis_id, p.rule_id) for p in plan}
    out = Counter((p.source_id, p.hypothesis_id) for p in plan)
    for signature, n in applied.items():
        out[signature[:2]] += max(0, n - (signature in planned))
    if any(n > PER_HYPOTHESIS for n in Counter((p.source_id, p.hypothesis_id) for p in plan).values()):
        raise ConstraintError("a saved plan has too many variants of a hypothesis")
    return out
