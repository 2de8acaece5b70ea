"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]. Its targets come from
the integral of the schedule; a target stops at `most` times the source's size and the
excess goes to the other sources by weight until none is above. Within a source the
documents stand in a fixed pseudo-random order, so each copy of a document has an offset
in the source's demand; inverting the cumulative demand turns the offset into a training
position, and the mix is range-sorted by position.

No window runs over a whole source: documents fall into blocks by the hash of their id,
offsets are sums within a block plus the sums of the blocks before. Only the tables of
one row per source and of one row per block are ordered as a whole.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; rows with equal doc_id are ordered by text and then count as documents of their
own; documents of size 0 take nothing; an empty table gives an empty table; other columns
of the input aren't read by `assign`, and `mix` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights by order of source, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: A source's weight at t is w * (1 + slope * (2t - 1)): its integral over [0, 1] is w.
SLOPES = (0.5, 0.0, -0.5)
MOST_PASSES = 3
#: Bits of the hash that make a block of a source; one window partition orders a block.
BLOCK_BITS = 12


def n_words(text: Column) -> Column:
    """Words of a text: starts of runs of characters that aren't white space; 0 for null."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(blank, " "), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, most: int = MOST_PASSES) -> DataFrame:
    """sizes: mix_source, source_size (one row per source). Adds weight, slope and target.

    The capped sources are those with the least room per weight, so they are a prefix in
    that order: a source is capped if its cap is at most its share of what the sources
    before it leave.
    """
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (n % len(values) + 1).cast("int"))
    s = sizes.select("*", pick(weights).alias("weight"), pick(slopes).alias("slope"), (F.lit(most) * F.col("source_size")).cast("double").alias("cap"))
    room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    before = room.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    share = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    s = s.withColumn("level", share).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    # the first source that isn't capped sets the level of all that aren't
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("cap") / F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)
    return s.select("mix_source", "source_size", "weight", "slope", target.alias("target"))


def position(share: Column, slope: Column) -> Column:
    """Time t at which a source with this slope has met the share of its demand: the root
    of (1 - k) t + k t^2 = share, the integral of the schedule over its whole."""
    k, a = slope, 1 - slope
    root = (F.sqrt(a * a + 4 * k * share) - a) / (2 * k)
    return F.when(F.abs(k) < 1e-9, share).otherwise(root)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("mix_source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))


def assign(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, most: int = MOST_PASSES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies,
    position (of the first copy, null if not taken) and step (from one copy to the next)."""
    sized = _sized(docs)
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(7))
    sized = sized.withColumn("order_key", key).withColumn("block", F.shiftright("order_key", 64 - BLOCK_BITS).cast("int"))
    blocks = sized.groupBy("mix_source", "block").agg(F.sum("size").alias("block_size"))
    sources = source_targets(blocks.groupBy("mix_source").agg(F.sum("block_size").alias("source_size")), weights, slopes, most)
    before = Window.partitionBy("mix_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("mix_source", "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("start"))
    placed = starts.alias("b").join(sources.alias("s"), F.col("b.mix_source").eqNullSafe(F.col("s.mix_source"))).select("b.mix_source", "block", "start", "source_size", "slope", "target")
    within = Window.partitionBy("mix_source", "block").orderBy("order_key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = sized.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.alias("d").join(placed.alias("p"), F.col("d.mix_source").eqNullSafe(F.col("p.mix_source")) & (F.col("d.block") == F.col("p.block")))
    d = d.select("doc_id", "d.mix_source", "size", "source_size", "slope", "target", "tie", (F.col("start") + F.col("offset")).cast("double").alias("at"))
    # copy p lies at p * source_size + at; it is taken if its middle is within the target
    middle = F.col("at") + F.col("size") / 2
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(most), F.greatest(F.lit(0), F.floor((F.col("target") - middle) / F.col("source_size")) + 1))).cast("long")
    d = d.withColumn("copies", copies)
    share = F.least(F.lit(1.0), F.try_divide(middle, F.col("target")))
    return d.select(
        "doc_id", F.col("mix_source").alias("source"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies",
        F.when(F.col("copies") > 0, position(share, F.col("slope"))).alias("position"),
        "slope", middle.alias("middle"), "tie",
    )


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, most: int = MOST_PASSES) -> DataFrame:
    """The documents in training order, each as often as the mix takes it, with the
    columns of docs. Rows with equal doc_id are told apart by their rank."""
    a = assign(docs, weights, slopes, most)
    share = lambda p: F.least(F.lit(1.0), F.try_divide(F.col("middle") + p * F.col("source_size"), F.col("target")))
    at = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)), lambda p: position(share(p), F.col("slope")))
    rank = Window.partitionBy("__id").orderBy("__source", "__tie")
    a = a.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("tie").alias("__tie"), "copies", at.alias("__at"))
    a = a.select("__id", F.row_number().over(rank).alias("__n"), "copies", "__at").where("copies > 0").select(F.col("__id").alias("__i"), F.col("__n").alias("__k"), F.explode("__at").alias("__at"))
    d = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.xxhash64("text").alias("__tie"))
    d = d.withColumn("__n", F.row_number().over(rank))
    joined = d.join(a, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__n") == F.col("__k")))
    return joined.repartitionByRange("__at", "__id").sortWithinPartitions("__at", "__id").select("__row.*")
