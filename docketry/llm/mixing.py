"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is how often, on average, each of its documents is taken. The whole part is taken for
certain; the fraction is a probability that has to be rounded so that the source's words hardly change. Two documents
with fractional probabilities trade mass, in words: one gains what the other gives up, until one of them is at 0 or
1; which way is drawn so that no probability changes in expectation. Blocks of some ``BLOCK`` documents are rounded
this way at the leaves of a reduction tree, each leaves one fractional document at most, and these go up in blocks of
the same size until one block is left for each source. That block also gets a reserve, some ``RESERVE`` documents that no
leaf has rounded, from large to small, so that what is left in the end is a small document.

Draws are hashes of the documents' ids and content, so that reruns agree.

Edge cases: a null text has size 0, as has one of white space; such documents are never taken. A null source is a
source of its own, the last. Rows that agree in id, source and text are decided together and returned as often as they
occur. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.common import SPACE_CLASS, settle

BLOCK, RESERVE = 64, 1024
_UNIT = ["id", "source", "size", "print", "times"]


def n_words(text: str | Column) -> Column:
    """Number of runs of anything but white space."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE_CLASS), "")), F.lit(0)).cast("long")


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the place of each source by code point, null last, in ``rank``; sources are sorted in ranges, not in one task."""
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("source").asc_nulls_last()
    dealt = settle(sizes.repartitionByRange(n, by).withColumn("__part", F.spark_partition_id()), "sources")
    counts = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # one row for each range
    before, seen = {}, 0
    for part in sorted(counts):
        before[part], seen = seen, seen + counts[part]
    if not before:
        return dealt.drop("__part").withColumn("rank", F.lit(0))
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("__part"))
    return dealt.withColumn("rank", offset + F.row_number().over(W.partitionBy("__part").orderBy(by)) - 1).drop("__part")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """source, source_size, units, target, from rows (source, source_size, units).

    Weights go to the sources by code point, null last, over and over. A source above ``most`` times its size stays
    there and the others share the rest by weight, until none is above. Each round is a sum over the sources; the share of a
    weight only rises, so that who has stopped once has stopped for good.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    limits = _ranked(sizes).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most))
    per = F.col("limit") / F.col("weight")
    total, level, stopped = limits.agg(F.sum("source_size")).first()[0] or 0, -1.0, -1
    while True:
        stops = per < F.lit(level)
        fixed, free, n = limits.agg(F.sum(F.when(stops, F.col("limit"))), F.sum(F.when(~stops, F.col("weight"))), F.count_if(stops)).first()
        if n == stopped:
            break
        stopped = n
        if not free:  # all have stopped
            level = float("inf")
            break
        level = (total - (fixed or 0.0)) / free
    target = F.least("limit", F.lit(level) * F.col("weight"))
    return limits.select("source", "source_size", "units", target.cast("double").alias("target"))


def _round(units: Column, seed: int) -> Column:
    """Round an array of struct(mass, p, unit), largest mass first: struct(left, decided), left being the one still fractional."""

    def trade(state: Column, new: Column) -> Column:
        old = state["left"]
        a, p, b, q = old["mass"], old["p"], new["mass"], new["p"]
        up, down = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))
        rises = _draw(F.lit(seed), old["unit"]["id"], old["unit"]["print"], new["unit"]["id"], new["unit"]["print"]) * (up + down) < down
        settles = F.when(rises, a * (1 - p) <= b * q).otherwise(a * p <= b * (1 - q))  # the old one, else the new
        taken = rises == settles
        rest = F.when(settles, F.when(rises, q - a * (1 - p) / b).otherwise(q + a * p / b)).otherwise(F.when(rises, p + b * q / a).otherwise(p - b * (1 - q) / a))
        done = F.struct(F.when(settles, old["unit"]).otherwise(new["unit"]).alias("unit"), taken.cast("int").alias("extra"))
        left = F.struct(F.when(settles, b).otherwise(a).alias("mass"), F.least(F.greatest(rest, F.lit(0.0)), F.lit(1.0)).alias("p"), F.when(settles, new["unit"]).otherwise(old["unit"]).alias("unit"))
        return F.struct(left.alias("left"), F.concat(state["decided"], F.array(done)).alias("decided"))

    ordered = F.sort_array(units, asc=False)
    none = F.slice(F.transform(ordered, lambda x: F.struct(x["unit"].alias("unit"), F.lit(0).alias("extra"))), 1, 0)
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), F.struct(ordered[0].alias("left"), none.alias("decided")), trade)


def copies(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 1) -> DataFrame:
    """id, source, size, print, times, source_size, target, copies for each distinct row of ``docs`` (id, source, text).

    ``print`` is a hash of the text, ``times`` the number of equal rows, ``copies`` how often each of them is taken.
    """
    rows = docs.select("id", "source", n_words("text").alias("size"), F.xxhash64("text").alias("print"))
    units = settle(rows.groupBy("id", "source", "size", "print").agg(F.count("*").alias("times")), "units")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("units"))
    goal = settle(targets(sums, weights, most), "targets")
    named = units.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    named = named.withColumn("sure", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    unit = F.struct(*_UNIT, "source_size", "target", "sure")
    fields = ["source", "units", F.struct((F.col("size") * F.col("times")).cast("double").alias("mass"), "p", unit.alias("unit")).alias("item")]
    reserve = _draw(F.lit(seed + 1), F.col("id"), F.col("print")) * F.col("units") < RESERVE
    loose = named.where(open_)
    now, held = loose.where(~reserve).select(*fields), loose.where(reserve).select(*fields)
    decided = [named.where(~open_).select(unit.alias("unit"), F.lit(0).alias("extra"))]
    most_units = goal.agg(F.max("units")).first()[0] or 0
    share, level = BLOCK, 0
    while True:
        last = ceil(most_units / share) <= 1
        blocks = F.ceil(F.col("units") / F.lit(share))
        place = F.pmod(F.xxhash64(F.lit(seed + 2 + level), F.col("item.unit.id"), F.col("item.unit.print")), blocks) if not last else F.lit(0).cast("long")
        every = now.union(held) if last else now
        folded = every.groupBy("source", "units", place.alias("block")).agg(F.collect_list("item").alias("items")).select("source", "units", _round(F.col("items"), seed + level).alias("r"))
        folded = settle(folded, f"level{level}")
        decided.append(folded.select(F.explode("r.decided").alias("d")).select("d.unit", "d.extra"))
        now = folded.select("source", "units", F.col("r.left").alias("item"))
        if last:
            break
        share, level = share * BLOCK, level + 1
    final = _draw(F.lit(seed + 99), F.col("item.unit.id"), F.col("item.unit.print")) < F.col("item.p")
    decided.append(now.select("item.unit", final.cast("int").alias("extra")))
    out = decided[0]
    for d in decided[1:]:
        out = out.union(d)
    return out.select("unit.*", "extra").withColumn("copies", (F.col("sure") + F.col("extra")).cast("long")).drop("sure", "extra")


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """id, source, size, source_size, target, copies, taken for each row of ``docs`` (id, source, text)."""
    found = copies(docs, **options)
    each = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
    return each.select("id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken; columns as before."""
    base = docs.select(F.col(id_column).alias("id"), "source", "text")
    found = copies(base, **options).where("copies > 0").select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("print").alias("__print"), F.col("copies").alias("__copies"))
    same = F.col(id_column).eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64("text") == F.col("__print"))
    return docs.join(found, same).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "__copies")).alias("__nth")).drop("__nth")
