"""Violations, quarantine verdicts, reconciliation and table fingerprints.

A check is a DataFrame of violations: empty is good.  Whether a finding stops a load or only quarantines is for the
caller, through `refuse` or `reasons`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rallyline.session import durable


class Violation(ValueError):
    """A check that must be empty isn't."""


def refuse(violations: DataFrame, what: str) -> None:
    if rows := violations.limit(3).collect():
        raise Violation(f"{what}: {', '.join(str(r.asDict()) for r in rows)}")


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in their order, as an array without nulls."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in checks.items()]))


def reason_mismatches(verdicts: DataFrame, flag: str, stored: str, recomputed: Column) -> DataFrame:
    """Violations: a flag without reasons or the reverse, or reasons other than the checks give."""
    return verdicts.where((F.col(flag) != (F.size(stored) > 0)) | ~F.col(stored).eqNullSafe(recomputed))


def count_differences(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, expected, actual, finding) where row counts per key differ: missing, extra or mismatched."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("expected"))
    a = actual.groupBy(*keys).agg(F.count("*").alias("actual"))
    finding = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("mismatched")
    both = e.join(a, keys, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))
    return both.withColumn("finding", finding)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with `side`; repeats don't count."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The join of two tables on keys that each must hold exactly once."""
    for side, name in ((left, "left"), (right, "right")):
        refuse(side.groupBy(*keys).count().where("count > 1"), f"repeated keys on the {name}")
    a, b = left.select(*keys).withColumn("l", F.lit(1)), right.select(*keys).withColumn("r", F.lit(1))
    refuse(a.join(b, keys, "full_outer").where("l IS NULL OR r IS NULL"), "keys of one side alone")
    return left.join(right, keys)


class JoinWatch:
    """Left joins that must neither lose nor repeat a row, counted by the job that runs them: no second job is needed.

    check() is for afterwards; it waits for a job that reads each join's result, so it must have been written by then.
    """

    def __init__(self) -> None:
        self.seen: list[tuple[str, Observation, Observation]] = []

    def left(self, left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
        before, after = Observation(), Observation()
        rows = left.observe(before, F.count("*").alias("n")).join(right, keys, "left")
        self.seen.append((what, before, after))
        return rows.observe(after, F.count("*").alias("n"))

    def check(self) -> None:
        """Violation unless each join gave as many rows as it was given."""
        for what, before, after in self.seen:
            if (a := before.get["n"]) != (b := after.get["n"]):
                raise Violation(f"{what}: {a} rows became {b}")


def reconciled(rebuilt: DataFrame, official: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Violations over the union of keys: rows (keys, rebuilt, official), a missing side counting zero."""
    both = rebuilt.select(*keys, F.col(value).alias("rebuilt")).join(official.select(*keys, F.col(value).alias("official")), keys, "full_outer")
    both = both.fillna(0, ["rebuilt", "official"])
    return both.where("rebuilt <> official")


def season_switch(candidates: DataFrame, raw: str, corrected: str, keys: list[str]) -> DataFrame:
    """One row per season: use_correction, true only if it strictly lowers the season's mismatches."""
    return candidates.groupBy(*keys).agg((F.sum(corrected) < F.sum(raw)).alias("use_correction"))


def ordered_fingerprint(df: DataFrame, row: Column, key: str, bits: int = 12, levels: int = 2) -> DataFrame:
    """md5 of the rows' md5s in the order of a whole-number key, which must be unique.

    Ranges of 2^bits keys are put in order and hashed by themselves, then ranges of ranges, `levels` times, and what is
    left in one place: so no task orders more than 2^bits rows, and the last one a 2^-(bits * levels) share of them.
    """
    rows = df.select(F.md5(row).alias("m"), F.col(key).cast("long").alias("k"), F.lit(1).cast("long").alias("n"))
    listed = F.md5(F.expr("listagg(m, '') WITHIN GROUP (ORDER BY k)"))
    for _ in range(levels):
        rows = rows.groupBy(F.shiftright("k", bits).alias("r")).agg(listed.alias("m"), F.sum("n").alias("n"))
        rows = rows.select("m", F.col("r").alias("k"), "n")
    return rows.agg(listed.alias("fingerprint"), F.sum("n").alias("n"))


def digest_levels(df: DataFrame, row: Column, key: str, bits: int = 10, levels: int = 2) -> list[DataFrame]:
    """A tree of digests over a whole-number key: rows (r, m, n) for each level, from ranges of 2^bits keys upwards.

    A range's digest is that of its parts' digests in the order of the key; rows that repeat a key are ordered by theirs.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.md5(row).alias("m"), F.lit(1).cast("long").alias("n"))
    made = []
    for _ in range(levels):
        listed = F.md5(F.expr("listagg(m, '') WITHIN GROUP (ORDER BY k, m)"))
        rows = durable(rows.groupBy(F.shiftright("k", bits).alias("r")).agg(listed.alias("m"), F.sum("n").alias("n")))
        made.append(rows)
        rows = rows.select(F.col("r").alias("k"), "m", "n")
    return made


def differing_ranges(a: list[DataFrame], b: list[DataFrame], bits: int = 10) -> DataFrame:
    """Rows (r): the lowest level's ranges that two trees of digests don't share, found from the top downwards.

    A level is only looked at below the ranges that differ on the level above it.
    """
    wrong = None
    for mine, other in zip(reversed(a), reversed(b), strict=True):
        sides = [mine.select("r", "m"), other.select("r", F.col("m").alias("o"))]
        if wrong is not None:
            above = wrong.select(F.col("r").alias("up"))
            sides = [side.join(above, F.shiftright("r", bits) == F.col("up"), "left_semi") for side in sides]
        wrong = durable(sides[0].join(sides[1], "r", "full_outer").where(~F.col("m").eqNullSafe(F.col("o"))).select("r"))
    return wrong


def row_differences(a: DataFrame, b: DataFrame, row: Column, key: str, ranges: DataFrame, bits: int = 10) -> DataFrame:
    """Rows (key, finding) of the keys in these ranges: missing in b, extra in b, or changed; no other range is compared."""
    within = ranges.select(F.col("r").alias("up"))

    def digests(df: DataFrame, out: str) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias(key), F.md5(row).alias("m"))
        rows = rows.join(within, F.shiftright(key, bits) == F.col("up"), "left_semi")
        return rows.groupBy(key).agg(F.expr("listagg(m, '') WITHIN GROUP (ORDER BY m)").alias(out))

    both = digests(a, "m").join(digests(b, "o"), key, "full_outer").where(~F.col("m").eqNullSafe(F.col("o")))
    finding = F.when(F.col("o").isNull(), "missing").when(F.col("m").isNull(), "extra").otherwise("changed")
    return both.select(key, finding.alias("finding"))


def distinct_by_width(ids: DataFrame, column: str) -> DataFrame:
    """Rows (bits, n_distinct, n_shared) for 1 to 128 bits: how many different ids, of 32 hexadecimal digits, stay so if cut.

    In their order an id is new at all widths beyond the bits that it shares with the one before it, so one pass over
    sorted ids tells for every width.  Ids are sorted within ranges of their first 12 bits, and the ranges among themselves.
    """
    half = lambda at: F.conv(F.substring("id", at, 16), 16, -10).cast("long")
    rows = ids.select(F.lower(F.col(column)).alias("id")).where("id IS NOT NULL").distinct()
    rows = rows.select("id", half(1).alias("hi"), half(17).alias("lo")).withColumn("range", F.shiftrightunsigned("hi", 52))
    order = Window.partitionBy("range").orderBy("id")
    length = lambda x: F.length(F.bin(x))
    hi, lo = F.col("hi").bitwiseXOR(F.lag("hi").over(order)), F.col("lo").bitwiseXOR(F.lag("lo").over(order))
    shared = F.when(hi.isNull(), None).when(hi != 0, 64 - length(hi)).otherwise(128 - length(lo))
    rows = durable(rows.select("range", shared.alias("shared")))
    inside = rows.where("shared IS NOT NULL").groupBy("shared").agg(F.count("*").alias("n"))
    # the first ids of the ranges, 4,096 at most
    first = F.col("range").bitwiseXOR(F.lag("range").over(Window.orderBy("range")))
    heads = rows.select("range").distinct().select(F.coalesce(12 - length(first), F.lit(-1)).alias("shared"), F.lit(1).cast("long").alias("n"))
    counts = inside.unionByName(heads).groupBy("shared").agg(F.sum("n").alias("n"))  # 130 rows at most
    whole = counts.agg(F.collect_list(F.struct("shared", "n")).alias("c"), F.sum("n").alias("total")).where("total > 0")
    new = F.expr("aggregate(filter(c, x -> x.shared < bits), 0L, (s, x) -> s + x.n)")
    rows = whole.withColumn("bits", F.explode(F.sequence(F.lit(1), F.lit(128)))).withColumn("n_distinct", new)
    return rows.select("bits", "n_distinct", (F.col("total") - F.col("n_distinct")).alias("n_shared"))


def table_fingerprint(df: DataFrame) -> tuple[int, int, int]:
    """Count, sum and exclusive or of row hashes over sorted columns: any order of rows, any size."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    got = df.select(row.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return int(got[0]), int(got[1] or 0), int(got[2] or 0)


def fingerprint_changes(before: dict[str, tuple], after: dict[str, tuple]) -> list[str]:
    """Tables whose fingerprints differ; a table that one side lacks differs."""
    return sorted(t for t in before.keys() | after.keys() if before.get(t) != after.get(t) or t not in before or t not in after)


def failure_clusters(games: DataFrame, failed: str, attributes: list[str]) -> DataFrame:
    """Per attribute and value: failed and played counts, most failures first."""
    items = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]))
    rows = games.select(failed, items.alias("i")).select(failed, "i.*")
    counts = rows.groupBy("attribute", "value").agg(F.count_if(F.col(failed)).alias("failed"), F.count("*").alias("played"))
    return counts.orderBy(F.desc("failed"), "attribute", "value")


def collision_probability(n: int, bits: int) -> float:
    """The chance that n random identifiers of so many bits aren't all different."""
    return -math.expm1(-n * (n - 1) / 2 / 2**bits)
