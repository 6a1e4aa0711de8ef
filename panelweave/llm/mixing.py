"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Sources share the total of all sizes by weight, none above ``most`` times its own size. Each
source deals its documents in a shuffled order, over and over, up to ``most`` times; a copy's virtual
finish time is the source's words up to its end, divided by the source's target. The copies of all
sources, globally sorted by that time, are taken until the budget (the total of all sizes) is spent.

No source and no budget goes through one task: order and running sums are kept in two levels. The
shuffle order is a hash; its remainder makes slices, sums per source and slice are added up
first, and then the rows of each slice. The sorted copies are ranges, whose sums are added up first
too. Slices and ranges are as many as their rows call for. Texts are read once, for their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, store


def word_count(col="text"):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source, size`` -> ``source, source_size, weight, target`` with one row per source.

    Sources in code point order, null last, weigh ``weights``, repeated. target is the source's
    share of the total by weight; where that is above ``most`` times its size it stops there and the
    rest is shared anew. Sources without words get 0. The window runs over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    n = F.row_number().over(order) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")))
    # filled in the order in which the rising level reaches each source's limit
    dec = "decimal(38,0)"
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumns({
        "words_left": F.sum("source_size").over(everything).cast(dec) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast(dec),
        "weight_left": (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("decimal(18,0)"),
    })
    full = F.col("source_size").cast("decimal(18,0)") * most * F.col("weight_left") <= F.col("weight").cast("decimal(9,0)") * F.col("words_left").cast("decimal(24,0)")
    per = per.withColumn("full", full)
    # the level at the first source that stays below its limit
    level = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), (F.col("words_left").cast("double") / F.col("weight_left").cast("double")).alias("level")))).over(everything)["level"]
    per = per.withColumn("level", level)
    target = F.when(F.col("full"), F.col("source_size").cast("double") * most).otherwise(F.col("weight") * F.col("level"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, taken``; taken is size times the copies
    that the mix has of the row.

    A null text has size 0 and is never taken; null is a source of its own. Rows repeated in full
    are rows of their own, in any order among themselves. Only ``doc_id, source, text`` are read;
    ``keep`` names the columns of ``docs`` to return (all, by default), of which those that bear one of
    the four names are replaced; other names do no harm. An empty table gives an empty
    table. The order depends on ``doc_id``, ``text`` and ``seed`` alone, so reruns agree.

    Each source takes whole copies while those before stay below its target, and the budget cuts the
    last of these off; in what a source then lacks the largest copy that fits is put.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("size", "source_size", "target", "taken")]
    return _mixed(docs, weights, most, seed, keep).select("row.*", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it, with the columns of ``docs``."""
    return _mixed(docs, weights, most, seed, docs.columns).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: About how many rows of all sources share a slice of the order, and how many copies a range of the queue.
SLICE, RANGE = 10_000, 100_000


def _mixed(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, keep: list[str]) -> DataFrame:
    """``row`` (a struct of ``keep``), ``size, source_size, target, copies`` of every row."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")  # null is a source like another
    order = F.xxhash64(F.lit(seed), "doc_id", "text").alias("order")
    # texts are read once; ids are settled where they are written
    rows = docs.select(F.struct(*keep).alias("row"), key, F.col("source").alias("source"), F.col("doc_id").alias("doc"), word_count().alias("size"), order, F.monotonically_increasing_id().alias("id"))
    rows = store(rows, "sized")
    narrow = rows.select("id", "key", "source", "doc", "size", "order")
    n, budget = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    slices = max(1, -(-n // SLICE))
    narrow = narrow.withColumn("slice", F.pmod("order", F.lit(slices)))
    per_slice = store(narrow.groupBy("key", "source", "slice").agg(F.sum("size").alias("size")), "slices")
    targets = store(source_targets(per_slice, weights, most).withColumn("key", key).drop("source", "weight"), "targets")
    # words of the source before each slice: a row per source and slice
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select("key", "slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start")).join(targets, "key")
    within = Window.partitionBy("key", "slice").orderBy("order", "doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = narrow.where("size > 0").withColumn("cum", F.sum("size").over(within)).join(starts, ["key", "slice"]).withColumn("cum", (F.col("cum") + F.col("start")).cast("double"))
    # virtual finish times of the copies that begin below the target
    ends = F.array(*[F.struct((F.col("cum") + F.lit(p) * F.col("source_size")).alias("end"), F.lit(p).alias("p")) for p in range(most)])
    begun = F.explode(F.filter(ends, lambda e: e["end"] - F.col("size") < F.col("target"))).alias("e")
    queue = placed.select("id", "key", "size", "order", "doc", "target", begun).select("id", "key", "size", "order", "doc", (F.col("e.end") / F.col("target")).alias("time"), F.col("e.p").alias("p"))
    taken = _until(queue, budget, max(1, -(-n // RANGE))).groupBy("id").agg(F.count("*").alias("copies"))
    counted = narrow.select("id", "key", "doc", "size", "order").join(taken, "id", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    counted = _filled(store(counted, "counted"), targets, budget, most)
    return rows.join(counted.select("id", "key", "copies"), ["id", "key"]).join(targets, "key").select("row", "size", "source_size", "target", "copies")


def _until(queue: DataFrame, budget: int, parts: int) -> DataFrame:
    """``id`` of the copies that come first in ``queue(time, order, doc, p, size)`` until their sizes
    would exceed the budget: a global sort by ranges; sums of whole ranges, a row each, are added up first."""
    by = ["time", "order", "doc", "p"]
    ranged = store(queue.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), "queue")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("words"))
    before = sums.select("part", F.coalesce(F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("size").over(Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("upto", upto).join(before, "part").where(F.col("upto") + F.col("before") <= budget).select("id")


def _filled(counted: DataFrame, targets: DataFrame, budget: int, most: int) -> DataFrame:
    """``counted(id, key, doc, size, order, copies)`` with one more copy, in each source that lacks
    words, of the largest row that fits; sources that lack most of their target come first, until
    the budget is spent."""
    words = counted.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
    left = budget - words.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    gaps = store(words.join(targets, "key").select("key", "target", (F.col("target") - F.col("words")).alias("gap")).where("gap >= 1"), "gaps")
    fits = counted.where((F.col("copies") < most) & (F.col("size") > 0)).join(gaps, "key").where("size <= gap")
    best = fits.groupBy("key", "gap", "target").agg(F.max(F.struct("size", "order", "doc", "id")).alias("best"))
    upto = F.sum("best.size").over(Window.orderBy(F.desc(F.col("gap") / F.col("target")), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    more = store(best.withColumn("upto", upto).where(F.col("upto") <= left).select(F.col("best.id").alias("id"), F.lit(1).alias("more")), "more")
    return counted.join(more, "id", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")
