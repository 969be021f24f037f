"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions alone.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share `total` times all words; a target
stops at `most` times its source's size, and the excess is shared again by weight until none is above.  Equal-token
blocks go to the highest quotients size / (2 s + 1): first to sources, then to groups of shards, then to the shards of
each group, so a shard has an integer quota and no window holds more than a group's shards or a source's groups.
Highest quotients are found without listing them: a divisor gives every party its rounded share, and the few blocks that
are then too many or too few go by the next quotients.

In a shard the quota first takes whole passes over all words.  Then its documents, in a seeded order, make one row of
blocks, of which the first ones are selected until the quota is full; so at most one document of a shard is cut.

Defined results: null or empty text has size 0 and none of it is taken; null is a source of its own, the last; rows that
repeat a doc_id count each, and which of equal rows gives a block doesn't matter; an empty table gives no rows; other
columns are ignored, whatever their names.  A shard holds some SHARD documents, but all rows of one doc_id and one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyline.llm.common import ROW, WORD_CLASS, durable, numbered, settled

#: The repeating weights, the share of all words, and how often a source may be taken.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
#: Words of a block; documents of a shard, about; shards of a group.
BLOCK, SHARD, GROUP = 64, 2048, 1024


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    return numbered(docs).select(
        F.col(ROW).alias("row"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("mark"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Rows (source, source_size, target), from rows (source, source_size): the level of `weight * level` that fills up.

    A capped source is one whose cap / weight is below the level; in rising order of that ratio, the level that the
    words left and the weights left give after each source tells where capping ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    rows = sources.withColumn("nth", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(F.lit(list(weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("words", F.sum("source_size").over(every) * F.lit(float(total)))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn(
        "weights_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    rows = rows.withColumn("level", F.col("left") / F.col("weights_left"))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    rows = rows.withColumn("level", F.first(free, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def apportion(parties: DataFrame, votes: str, seats: Column, within: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`: how many of `seats` (one number per `within`) each party gets by Sainte-Lague's highest quotients.

    round(votes / divisor), with the divisor that would give all seats on average, grants exactly the quotients over a
    threshold.  What is missing goes to the highest next quotients, what is too much comes off the lowest granted ones.
    """
    all_of = Window.partitionBy(*within)
    quota = F.col(votes) * seats / F.nullif(F.sum(votes).over(all_of), F.lit(0))
    rows = parties.withColumn("_seats", seats).withColumn(out, F.coalesce(F.floor(quota + 0.5), F.lit(0)).cast("long"))
    rows = rows.withColumn("_gap", F.col("_seats") - F.sum(out).over(all_of))
    n = F.count("*").over(all_of)
    up = F.row_number().over(all_of.orderBy((F.col(votes) / (2 * F.col(out) + 1)).desc(), *order)) - 1
    granted = F.when(F.col(out) > 0, F.col(votes) / (2 * F.col(out) - 1))
    down = F.row_number().over(all_of.orderBy(granted.asc_nulls_last(), *order)) - 1
    rows = rows.withColumn("_up", up).withColumn("_down", down).withColumn("_n", n)
    # the gap is spread in turns, so it may exceed the number of parties
    more = F.floor((F.col("_gap") - F.col("_up") + F.col("_n") - 1) / F.col("_n"))
    less = F.floor((-F.col("_gap") - F.col("_down") + F.col("_n") - 1) / F.col("_n"))
    change = F.when(F.col("_gap") > 0, more).when(F.col("_gap") < 0, -less).otherwise(0)
    rows = rows.withColumn(out, F.greatest(F.lit(0), F.col(out) + change).cast("long"))
    return rows.drop("_seats", "_gap", "_up", "_down", "_n")


def mixed(docs: DataFrame, seed: int = 42, block: int = BLOCK, per_shard: int = SHARD) -> DataFrame:
    """One row per row of docs: row, doc_id, source, size, source_size, target, taken, and copies, see mixture."""
    rows = durable(sizes(settled(docs), seed))
    n = max(1, -(-rows.count() // per_shard))
    rows = rows.withColumn("shard", F.pmod("mark", F.lit(n)))
    group = F.floor(F.col("shard") / F.lit(GROUP)).cast("long").alias("group")
    shards = durable(rows.groupBy("source", "shard", group).agg(F.sum("size").alias("shard_size")))
    groups = durable(shards.groupBy("source", "group").agg(F.sum("shard_size").alias("group_size")))
    goals = targets(groups.groupBy("source").agg(F.sum("group_size").alias("source_size")))
    blocks = F.ceil(F.sum("target").over(Window.partitionBy()) / block)
    goals = apportion(goals, "target", blocks, [], ["source"], "source_blocks").withColumnRenamed("source", "s")
    parts = groups.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    parts = apportion(parts, "group_size", F.col("source_blocks"), ["source"], ["group"], "group_blocks")
    parts = parts.select(F.col("source").alias("s"), F.col("group").alias("g"), "source_size", "target", "group_blocks")
    quotas = shards.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))).drop("s", "g")
    quotas = apportion(quotas, "shard_size", F.col("group_blocks"), ["source", "group"], ["shard"], "blocks")
    quotas = durable(
        quotas.select(
            F.col("source").alias("s"), F.col("shard").alias("k"), "source_size", "target", "shard_size",
            F.least(F.col("blocks") * block, MOST * F.col("shard_size")).alias("quota"),
        )
    )
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0)
    rows = rows.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("k")))
    rows = rows.withColumn("passes", passes.cast("long")).drop("s", "k")
    rest = F.col("quota") - F.col("passes") * F.col("shard_size")
    shard = Window.partitionBy("source", "shard")
    seeded = [F.xxhash64(F.lit(seed), "mark"), F.col("mark"), F.col("row")]
    before = F.coalesce(F.sum("size").over(shard.orderBy(*seeded).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("rest", rest).withColumn("before", before).withColumn("whole", F.col("before") + F.col("size") <= F.col("rest"))
    # documents in seeded order fill the quota; the words that are then still missing are as many as one other may have
    gap = F.col("rest") - F.coalesce(F.max(F.when(F.col("whole"), F.col("before") + F.col("size"))).over(shard), F.lit(0))
    far = F.when(~F.col("whole") & (F.abs(F.col("size") - gap) < gap), F.abs(F.col("size") - gap))
    rows = rows.withColumn("far", far)
    nearest = F.row_number().over(shard.orderBy(F.col("far").asc_nulls_last(), *seeded)) == 1
    extra = F.col("whole") | (nearest & F.col("far").isNotNull())
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    return rows.select(
        "row", "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + part).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("passes") + extra.cast("int")).otherwise(0).cast("int").alias("copies"),
    )


def mixture(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of docs in whole copies, none to two, so that each source has its target's words but for a few.

    Documents come in seeded order, whatever their length, until the next one goes over a shard's quota; one more may
    come whose size is the nearest to what is then missing.
    """
    docs = settled(docs)
    plan = mixed(docs, seed).where("copies > 0").select(F.col("row").alias(ROW), F.col("copies").alias("_rl_copies"))
    rows = numbered(docs).join(plan.hint("merge"), ROW)
    return rows.withColumn("_rl_copy", F.explode(F.sequence(F.lit(1), F.col("_rl_copies")))).select(docs.columns)
