"""Dataset curation: groups, splits, quotas, weights, registry, review, edits and tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions.keys import permanent_id
from docketry.schemas import LABELS
from docketry.shared import discard, numbered, set_digest, settled

# groups and splits


def duplicate_groups(rows: DataFrame, id_column: str, keys: list[Column]) -> DataFrame:
    """id, group_id: the smallest id that shared keys lead to. Null and blank keys join nothing.

    Labels go to the key's smallest and on to the row's smallest until nothing changes, by halving paths: each round
    a row also takes its label's label, so long paths need few rounds. Rounds are written to the shared folder.
    """
    each = F.array(*(F.when(F.coalesce(k.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}:"), k.cast("string"))) for n, k in enumerate(keys)))
    links = settled(rows.select(F.col(id_column).alias("id"), F.explode(F.array_compact(each)).alias("key")).distinct())
    label = settled(rows.select(F.col(id_column).alias("id"), F.col(id_column).alias("g")).distinct())
    while True:
        by_key = links.join(label.select("id", "g"), "id").groupBy("key").agg(F.min("g").alias("k"))
        near = links.join(by_key, "key").groupBy("id").agg(F.min("k").alias("k"))
        once = label.select("id", "g").join(near, "id", "left").select("id", F.least("g", F.coalesce("k", "g")).alias("g"), F.col("g").alias("old"))
        once = settled(once)
        jump = once.select(F.col("id").alias("g"), F.col("g").alias("top"))
        after = settled(once.join(jump, "g", "left").select("id", F.least("g", F.coalesce("top", "g")).alias("g"), "old"))
        discard(once, label)
        if after.where("g <> old").isEmpty():
            discard(links)
            return after.select(F.col("id").alias(id_column), F.col("g").alias("group_id"))
        label = after


def deal_alike(k: int, lacks: dict[str, int], left: dict[str, int], n: int, step: int) -> dict[str, int]:
    """How many of ``k`` groups of ``n`` documents go to each split if each goes where most is lacking.

    A split's lack falls by ``step`` with each group, and a split with fewer than ``n`` places left takes none. So one after
    another means: the ``k`` largest of all lacks met on the way. A level is sought by halving that these reach; of those right at it,
    the splits with more places left come first, then in their order. The number of steps doesn't depend on ``k``.
    """
    most = {s: left[s] // n for s in lacks}
    if sum(most.values()) < k:
        raise ValueError(f"{k} groups of {n} don't fit into the splits")
    taken = lambda level: {s: min(most[s], max(0, (lacks[s] - level) // step + 1)) for s in lacks}
    low, high = min(lacks[s] - step * most[s] for s in lacks) - 1, max(lacks.values()) + 1  # enough at low, none at high
    while high - low > 1:
        level = (low + high) // 2
        low, high = (level, high) if sum(taken(level).values()) >= k else (low, level)
    out = taken(high)
    at = [s for s in lacks if out[s] < most[s] and lacks[s] - step * out[s] == low]
    for s in sorted(at, key=lambda s: -(left[s] - n * out[s]))[: k - sum(out.values())]:
        out[s] += 1
    return out


def grouped_split(groups: DataFrame, sizes: dict[str, int], seed: int = 0) -> DataFrame:
    """group_id, split: groups of documents dealt out so that the splits have exactly the wanted numbers of documents.

    ``groups``: group_id, stratum, n. Large groups go first, then those of small strata, each to the split with room for it that
    lacks most of its stratum, then most at all, then in order of ``sizes``; raises if one can't fit. Groups of one
    stratum and size are alike, so the driver deals numbers of them, from one row for each stratum and size (``deal_alike``);
    which groups these are is their hash order, numbered in Spark.
    """
    spark = groups.sparkSession
    groups = groups.withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("group_id").cast("string")), 256))
    classes = [(r.stratum, r.n, r.k) for r in groups.groupBy("stratum", "n").agg(F.count("*").alias("k")).collect()]
    of_stratum: dict = {}
    for g, n, k in classes:
        of_stratum[g] = of_stratum.get(g, 0) + n * k
    total = sum(of_stratum.values())
    if total != sum(sizes.values()):
        raise ValueError(f"{total} documents can't be split into {sizes}")
    left, cuts = dict(sizes), []
    lacks = {g: {s: m * sizes[s] for s in sizes} for g, m in of_stratum.items()}  # in parts of one document by all
    for g, n, k in sorted(classes, key=lambda c: (-c[1], of_stratum[c[0]], c[0] is None, c[0])):
        number = 0
        for s, m in deal_alike(k, lacks[g], left, n, n * total).items():
            left[s] -= n * m
            lacks[g][s] -= n * m * total
            cuts.append((g, n, s, number, number + m - 1))
            number += m
    kinds = dict(groups.dtypes)
    table = spark.createDataFrame(cuts, f"__g {kinds['stratum']}, __n {kinds['n']}, split string, __lo long, __hi long")
    # numbers run through all strata and sizes; each class begins after those before it
    each = settled(numbered(groups.select("group_id", "stratum", "n", "h"), ["stratum", "n", "h", "group_id"]))
    first = each.groupBy("stratum", "n").agg(F.min("number").alias("__first"))
    mine = F.col("stratum").eqNullSafe(F.col("__g")) & (F.col("n") == F.col("__n"))
    known = settled(first.join(table, mine).select("__g", "__n", "split", (F.col("__lo") + F.col("__first")).alias("__lo"), (F.col("__hi") + F.col("__first")).alias("__hi")))
    return each.join(F.broadcast(known) if len(cuts) <= 100_000 else known, mine & F.col("number").between(F.col("__lo"), F.col("__hi"))).select("group_id", "split")


# quotas, weights, samples


def largest_remainder(weights: DataFrame, total: int, minimum: int = 0, key: str = "key", weight: str = "weight", ordinal: str = "ordinal") -> DataFrame:
    """Quotas that add up to ``total``: a minimum each, floors of the shares of the rest, leftovers by largest remainder, then order."""
    every = W.partitionBy()
    rest = F.lit(total) - F.count("*").over(every) * minimum
    exact = rest * F.col(weight) / F.sum(weight).over(every)
    df = weights.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact")).withColumn("__left", rest - F.sum("__floor").over(every))
    extra = F.row_number().over(W.orderBy(F.desc(F.round(F.col("__exact") - F.col("__floor"), 9)), ordinal)) <= F.col("__left")
    return df.select(key, (F.lit(minimum) + F.col("__floor") + extra.cast("long")).cast("long").alias("quota"))


def weighted_rows(rows: DataFrame, label: str, classes: tuple[str, ...] = LABELS) -> DataFrame:
    """``rows`` with weight = all / (classes x own class), from one small table of counts; null if a class is missing."""
    counts = rows.where(F.col(label).isin(*classes)).groupBy(label).agg(F.count("*").alias("__mine"))
    # as many rows as there are classes
    total = counts.agg(F.sum("__mine").alias("__all"), F.count("*").alias("__kinds"))
    joined = rows.join(F.broadcast(counts), label, "left").crossJoin(F.broadcast(total))
    return joined.withColumn("weight", F.when(F.col("__kinds") == len(classes), F.col("__all") / (len(classes) * F.col("__mine")))).drop("__mine", "__all", "__kinds")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, fraction: float, seed: str) -> DataFrame:
    """Of each stratum the first max(1, ceil(n x fraction)) rows in the order of SHA-256 of seed and key."""
    w = W.partitionBy(*strata)
    df = rows.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256))
    take = F.greatest(F.lit(1), F.ceil(F.round(F.count("*").over(w) * fraction, 9)))
    return df.withColumn("__take", take).withColumn("__n", F.row_number().over(w.orderBy("__h", key))).where("__n <= __take").drop("__h", "__take", "__n")


def capped(rows: DataFrame, by: list[str], order: list[Column | str], cap: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")


def sample_with_replacement(rows: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` draws by weight: seeded points on the line of cumulative weights, joined by range in hash order of the rows.

    The line is cut at the rows' weights by range partitions and prefix sums, so no task sorts all rows.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    line = settled(rows.where(F.col(weight) > 0).repartitionByRange(parts, key).withColumn("__p", F.spark_partition_id()))
    sums = line.groupBy("__p").agg(F.sum(weight).alias("__s"))
    start = sums.select("__p", F.coalesce(F.sum("__s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("__from"))
    w = W.partitionBy("__p").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    line = line.join(F.broadcast(start), "__p").withColumn("__to", F.col("__from") + F.sum(weight).over(w)).withColumn("__lo", F.col("__to") - F.col(weight))
    total = sums.agg(F.sum("__s").alias("t")).first().t or 0.0
    points = spark.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 53)) / float(1 << 53) * total).alias("__x"))
    bins = max(1, min(n, 1 << 16))
    cell = lambda c: F.least(F.floor(c / F.lit(max(total, 1e-300)) * bins), F.lit(bins - 1))
    line = line.withColumn("__b", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__to")))))
    return points.withColumn("__b", cell(F.col("__x"))).join(line, "__b").where("__x >= __lo and __x < __to").drop("__b", "__x", "__lo", "__to", "__from", "__p")


# registry and review


def register(registry: DataFrame, incoming: DataFrame, split: str) -> DataFrame:
    """Incoming rows that the registry doesn't have, by stable_key, with permanent ids after the largest ever given.

    ``registry``: id, stable_key, split. ``incoming``: stable_key, seq. Ids are never given again, so rows may leave.
    """
    fresh = incoming.join(registry.select("stable_key"), "stable_key", "left_anti").withColumn("__n", F.row_number().over(W.partitionBy("stable_key").orderBy("seq"))).where("__n = 1").drop("__n")
    top = registry.where(F.col("split") == split).agg(F.coalesce(F.max(F.regexp_extract("id", r"_(\d+)$", 1).cast("long")), F.lit(0)).alias("top")).first().top
    return numbered(fresh, ["seq", "stable_key"], "__n").withColumn("id", permanent_id(F.lit(split), F.col("__n") + top)).withColumn("split", F.lit(split)).drop("__n")


def selected_rows(rows: DataFrame, released: bool = False) -> DataFrame:
    """Active rows that aren't excluded: approved, or proposed while unreleased; train rows are exempt from release."""
    ok = (F.col("status") == "approved") | ((F.col("status") == "proposed") & (F.lit(not released) | (F.col("split") == "train")))
    return rows.where(F.col("active") & (F.col("status") != "excluded") & ok)


def review_required(variant: str = "variant_id", verifications: str = "verifications", history: str = "history") -> Column:
    """Any variant but the original, any verdict but accept, anything once marked for review."""
    return (F.coalesce(F.col(variant), F.lit("original")) != "original") | F.exists(F.coalesce(F.col(verifications), F.array().cast("array<string>")), lambda v: v != "accept") | F.exists(F.coalesce(F.col(history), F.array().cast("array<string>")), lambda v: v == "needs_review")


def review_plan(rows: DataFrame, strata: list[str], key: str, fraction: float, seed: str, required: Column) -> DataFrame:
    """Mandatory rows and a stratified sample of the others, with the reason."""
    must = rows.where(required).withColumn("reason", F.lit("required"))
    return must.unionByName(stratified_sample(rows.where(~F.coalesce(required, F.lit(False))), strata, key, fraction, seed).withColumn("reason", F.lit("sampled")))


def population_signature(rows: DataFrame, *columns: str) -> DataFrame:
    """A digest of the rows, whatever their order: a plan is fresh while its population has this signature."""
    return rows.agg(set_digest(F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))).alias("signature"), F.count("*").alias("n"))


def split_report(rows: DataFrame, targets: DataFrame, by: tuple[str, ...] = ("split", "label")) -> DataFrame:
    """Rows and distinct documents of each split and label against targets: shortage and excess."""
    have = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("document").alias("documents"))
    out = targets.join(have, list(by), "full").select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("target", F.lit(0)).alias("target"))
    return out.withColumn("shortage", F.greatest(F.col("target") - F.col("n"), F.lit(0))).withColumn("excess", F.greatest(F.col("n") - F.col("target"), F.lit(0)))


def merge_pairs(rows: DataFrame, identity: list[str], variant: str = "variant_id") -> DataFrame:
    """One row of each identity with the sorted variants it occurs in."""
    return rows.groupBy(*identity).agg(F.array_sort(F.collect_set(variant)).alias("variants"))


def import_review(snapshot: DataFrame, review: DataFrame, immutable: tuple[str, ...] = ("hypothesis", "premise")) -> tuple[DataFrame, DataFrame]:
    """A returned review sheet against its snapshot (id, immutable columns, label): new rows and violations.

    Rows left out of the sheet are excluded; ids that the snapshot doesn't have and changed immutable columns are violations.
    """
    r = review.select(F.col("id").alias("r_id"), *(F.col(c).alias(f"r_{c}") for c in (*immutable, "label")))
    both = snapshot.join(r, F.col("id") == F.col("r_id"), "full")
    changed = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in immutable))
    rule = F.when(F.col("id").isNull(), "unknown_id").when(F.col("r_id").isNotNull() & changed, "immutable_changed").when(F.col("r_id").isNotNull() & ~F.coalesce(F.col("r_label").isin(*LABELS), F.lit(False)), "unknown_label")
    bad = both.select(rule.alias("rule"), F.coalesce("id", "r_id").cast("string").alias("key")).where("rule is not null")
    status = F.when(F.col("r_id").isNull(), "excluded").otherwise("approved")
    return both.where("id is not null").select(*snapshot.columns[:-1], F.coalesce("r_label", "label").alias("label"), status.alias("status")), bad


def apply_verifications(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Status after verification: disputed rows are pending again, with all rows of their variant; the rest is kept."""
    v = verdicts.groupBy("id").agg(F.max((F.col("verdict") == "dispute").cast("int")).alias("__disputed"))
    df = rows.join(v, "id", "left")
    cascade = F.max(F.coalesce("__disputed", F.lit(0))).over(W.partitionBy("source_id", "variant_id"))
    whole = F.when(F.col("variant_id") == "original", F.coalesce("__disputed", F.lit(0))).otherwise(cascade)
    return df.withColumn("status", F.when(whole == 1, "pending").otherwise(F.col("status"))).drop("__disputed")


def unusable_variants(targets: DataFrame) -> DataFrame:
    """source_id, variant_id, reason of variants with a dispute, a missing target, or no target but neutral ones.

    ``targets``: source_id, variant_id, disputed, found, label.
    """
    c = targets.groupBy("source_id", "variant_id").agg(F.bool_or("disputed").alias("d"), F.bool_and("found").alias("f"), F.bool_and(F.coalesce(F.col("label") == LABELS[2], F.lit(False))).alias("n"))
    reason = F.when(F.col("d"), "disputed").when(~F.col("f"), "missing_target").when(F.col("n"), "neutral_targets")
    return c.select("source_id", "variant_id", reason.alias("reason")).where("reason is not null")


# edits


def edits_are_valid(text: str, edits: str) -> Column:
    """Whether each edit's "before" stands at its offsets and no two edits overlap."""
    e = F.array_sort(F.col(edits))
    there = F.forall(e, lambda x: (x["start"] >= 0) & (x["end"] >= x["start"]) & (F.substring(F.col(text), x["start"] + 1, x["end"] - x["start"]) == x["before"]))
    apart = F.aggregate(e, F.struct(F.lit(True).alias("ok"), F.lit(0).alias("at")), lambda s, x: F.struct((s["ok"] & (x["start"] >= s["at"])).alias("ok"), x["end"].alias("at")))["ok"]
    return there & apart


def apply_edits(text: str, edits: str) -> Column:
    """Text after offset edits, from the last to the first, so that offsets stay valid."""
    down = F.reverse(F.array_sort(F.col(edits)))
    return F.aggregate(down, F.col(text), lambda t, x: F.concat(F.substring(t, F.lit(1), x["start"]), x["after"], F.substring(t, x["end"] + 1, F.greatest(F.length(t) - x["end"], F.lit(0)))))


def map_span(start: str, end: str, edits: str) -> Column:
    """struct(start, end) of a span after the edits: an edit before it moves it, one inside or at its start stretches it."""
    shift = lambda cond: F.aggregate(F.filter(F.col(edits), cond), F.lit(0), lambda s, x: s + F.length(x["after"]) - (x["end"] - x["start"]))
    return F.struct((F.col(start) + shift(lambda x: x["end"] <= F.col(start))).alias("start"), (F.col(end) + shift(lambda x: x["start"] < F.col(end))).alias("end"))


def _binned(spans: DataFrame, key: str, levels: DataFrame | None, own: bool, role: int) -> DataFrame:
    """``spans`` in each bin they touch, two at most of a level: on their own level, or on those of ``levels`` for their key that are
    longer (or as long, if ``own``)."""
    out = spans.withColumn("__level", F.col("__own"))
    if levels is not None:
        longer = F.col("__level") >= F.col("__own") if own else F.col("__level") > F.col("__own")
        out = spans.join(levels, key).where(longer)
    first, last = (F.call_function("shiftright", x, F.col("__level")) for x in (F.col("start"), F.greatest("start", F.col("end") - 1)))
    return out.withColumn("__role", F.lit(role)).withColumn("__bin", F.explode(F.sequence(first, last)))


def overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of spans (start, end; whole numbers) of one key that overlap: a.start < b.end and b.start < a.end.

    A binned interval join. A span's level is the least power of four that holds its length, and bins of a level are that wide, so a
    span touches two of them at most. A pair meets on the level of the longer span, where the shorter one is entered too, and only
    in the bin of the later start: once, with no pairs to make distinct. A key with very many spans is thereby spread over its
    bins; of a bin's pairs a good part overlaps. A span is entered only on levels (32 at most) that its key has on the other side.
    Spans that lack key or offset, or end before their start, take no part; an empty span overlaps one that holds its place inside.
    Repeated spans pair each.
    """
    sides, levels = [], []
    for side in (a, b):
        span = side.where(F.col(key).isNotNull() & (F.col("start") <= F.col("end"))).withColumns({c: F.col(c).cast("long") for c in ("start", "end")})
        bits = F.length(F.bin(F.greatest(F.col("end") - F.col("start") - 1, F.lit(0).cast("long"))))
        sides.append(span.withColumn("__own", bits + bits % 2))
        levels.append(sides[-1].select(key, F.col("__own").alias("__level")).distinct())
    left = _binned(sides[0], key, None, True, 0).unionByName(_binned(sides[0], key, levels[1], False, 1))
    right = _binned(sides[1], key, levels[0], True, 0).unionByName(_binned(sides[1], key, None, True, 1))
    met = [key, "__role", "__level", "__bin"]
    right = right.select(*met, *(F.col(c).alias(f"other_{c}") for c in b.columns if c != key))
    later = F.call_function("shiftright", F.greatest("start", "other_start"), F.col("__level"))
    pairs = left.join(right, met).where((F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end")) & (later == F.col("__bin")))
    types = {c: t for c, t in a.dtypes if c in ("start", "end")} | {f"other_{c}": t for c, t in b.dtypes if c in ("start", "end")}
    return pairs.select(key, *(c for c in a.columns if c != key), *(f"other_{c}" for c in b.columns if c != key)).withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def target_audit(targets: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Targets mapped through edits against the hypotheses extracted there: found, and gold units that weren't retrieved.

    ``targets``: variant_id, target_id, start, end, edits, gold_units. ``hypotheses``: variant_id, start, end, units.
    """
    moved = targets.withColumn("m", map_span("start", "end", "edits")).select("variant_id", "target_id", "gold_units", F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    met = overlapping(moved, hypotheses, "variant_id").groupBy("variant_id", "target_id").agg(F.count("*").alias("n"), F.flatten(F.collect_list("other_units")).alias("units"))
    out = moved.join(met, ["variant_id", "target_id"], "left")
    none = F.array().cast("array<string>")
    missing = F.array_except("gold_units", F.coalesce("units", none))
    status = F.when(F.col("n").isNull(), "no_hypothesis").when(F.size(missing) == 0, "retrieved").otherwise("missing")
    return out.select("variant_id", "target_id", "start", "end", F.coalesce("n", F.lit(0)).alias("n_hypotheses"), missing.alias("missing_units"), status.alias("status"))


# tasks


def task_batches(rows: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """``rows`` with batch: chunks of ``size`` rows of each group, from 0, in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1) / F.lit(size)))


def task_packages(rows: DataFrame, by: list[str], order: str, size: int, fields: list[str]) -> DataFrame:
    """One row for each batch with its rows as an array in order; an array holds ``size`` rows at most."""
    packed = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return task_batches(rows, by, order, size).groupBy(*by, "batch").agg(packed.alias("rows"))


def choose_rule(candidates: DataFrame, by: str) -> DataFrame:
    """Rule with most hint hits, then the largest remaining quota, then the largest id. ``candidates``: by, rule_id, hits, remaining."""
    return candidates.where("remaining > 0").groupBy(by).agg(F.max_by("rule_id", F.struct("hits", "remaining", "rule_id")).alias("rule_id"))
