"""The registered queries of the library's own operators over the driver's tables, with SQL for the oracle.

The driver's tables stand in for the domain's: a user is a game, event_id the position, event_type the play, the parity
of event_id the team, and a day the period.  Where one SQL text runs on both engines it is written once, in RELATIONAL;
the ordered operators are DataFrame plans with SQL of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyline.functions.scalars import (
    at_or_null, elapsed_seconds, lineup_hash, matches_official, name_like, net_rate, official_seconds, rate, ratio, real_coordinate, shot_made, shot_type, winner,
)
from rallyline.operators import episodes, intervals, ordered, quality, rosters
from rallyline.operators.ordered import Stream

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Queries as one SQL text for both engines; {name} is a table.
RELATIONAL = {
    # team statistics: joins, sums, ratios of sums, nulls-last ranking
    "q_team_four_factors": """
        SELECT n_name AS team, count(*) AS n_rows, sum(CAST(l_quantity AS BIGINT)) AS quantity,
               CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS return_rate,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
                 / CAST(nullif(sum(CAST(l_quantity AS BIGINT)), 0) AS DOUBLE) AS cents_per_unit,
               CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        JOIN {nation} ON c_nationkey = n_nationkey
        GROUP BY n_name""",
    # the two sides of a game: here a customer's first two orders
    "q_opponent_self_join": """
        WITH r AS (
          SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS side
          FROM {orders}
        ), two AS (SELECT * FROM r WHERE side <= 2)
        SELECT a.o_custkey AS custkey, a.o_orderkey AS orderkey, b.o_orderkey AS opponent, a.cents - b.cents AS margin
        FROM two a JOIN two b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey""",
    "q_own_and_opponent_agg": """
        WITH t AS (
          SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q
          FROM {lineitem} GROUP BY l_returnflag, l_linestatus
        )
        SELECT own.f AS flag, own.s AS status, own.n AS n_own, coalesce(opp.n, 0) AS n_opponent, own.q AS q_own,
               coalesce(opp.q, 0) AS q_opponent
        FROM t own LEFT JOIN t opp ON own.f = opp.f AND own.s <> opp.s""",
    "q_box_total_and_residual": """
        SELECT 'total' AS row_kind, CAST(NULL AS BIGINT) AS suppkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q
        FROM {lineitem}
        UNION ALL
        SELECT 'part' AS row_kind, l_suppkey AS suppkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q
        FROM {lineitem} GROUP BY l_suppkey""",
    "q_dim_left_join_null_safe": """
        SELECT s_suppkey AS suppkey, n_name AS nation,
               s_nationkey IS NOT DISTINCT FROM n_nationkey AS same_key, n_name IS NULL AS without_name
        FROM {supplier} LEFT JOIN (SELECT * FROM {nation} WHERE n_regionkey <> 0) ON s_nationkey = n_nationkey""",
    "q_semi_exists": """
        SELECT c_custkey AS custkey, c_name AS name FROM {customer} c
        WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""",
    "q_anti_not_exists": """
        SELECT c_custkey AS custkey, c_name AS name FROM {customer} c
        WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""",
    "q_in_subquery_flag": """
        SELECT large, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
        FROM (SELECT o_totalprice, o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity >= 49) AS large FROM {orders}) o
        GROUP BY large""",
    "q_filter_aggregates": """
        SELECT o_orderpriority AS priority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_filled,
               count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
               CAST(min(CAST(o_orderdate AS DATE)) AS STRING) AS first_date, CAST(max(CAST(o_orderdate AS DATE)) AS STRING) AS last_date
        FROM {orders} GROUP BY o_orderpriority""",
    "q_having_floor": """
        SELECT l_partkey AS partkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity, max(l_returnflag) AS flag
        FROM {lineitem} GROUP BY l_partkey HAVING sum(CAST(l_quantity AS BIGINT)) >= 800""",
    "q_distinct_counts": """
        SELECT l_suppkey AS suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders
        FROM {lineitem} GROUP BY l_suppkey""",
    "q_symmetric_difference": """
        (SELECT o_orderkey AS k, 'order only' AS side FROM {orders} EXCEPT SELECT l_orderkey AS k, 'order only' AS side FROM {lineitem})
        UNION ALL
        (SELECT l_orderkey AS k, 'line only' AS side FROM {lineitem} WHERE l_quantity < 5
         EXCEPT SELECT o_orderkey AS k, 'line only' AS side FROM {orders} WHERE o_orderstatus = 'F')""",
    "q_union_intersect": """
        (SELECT c_custkey AS k FROM {customer} WHERE c_acctbal > 0 INTERSECT SELECT o_custkey AS k FROM {orders})
        UNION
        (SELECT o_custkey AS k FROM {orders} WHERE o_totalprice > 400000)""",
    "q_date_bounds": """
        SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers
        FROM {orders}
        WHERE CAST(o_orderdate AS DATE) >= DATE '1995-03-01' AND CAST(o_orderdate AS DATE) <= DATE '1996-02-29'
        GROUP BY o_orderstatus""",
    "q_topk_nulls_last": """
        SELECT c_custkey AS custkey, c_name AS name,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(round(c_acctbal * 100) AS BIGINT) END AS cents
        FROM {customer} ORDER BY 3 DESC NULLS LAST, 1 LIMIT 50""",
    "q_page_offset": """
        SELECT o_orderkey AS orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, o_orderstatus AS status
        FROM {orders} WHERE o_orderstatus <> 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100""",
    "q_conditional_divisor": """
        SELECT o_custkey AS custkey, count(*) AS games, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS total,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(nullif(count(*), 0) AS DOUBLE) AS per_game
        FROM {orders} GROUP BY o_custkey""",
    "q_two_sided_offense_defense": """
        WITH offense AS (
          SELECT l_suppkey AS s, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_suppkey
        ), defense AS (
          SELECT l_suppkey AS s, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_suppkey
        )
        SELECT s_suppkey AS suppkey, coalesce(o.n, 0) AS n_offense, coalesce(d.n, 0) AS n_defense,
               100.0e0 * CAST(o.q AS DOUBLE) / CAST(nullif(o.n, 0) AS DOUBLE)
                 - 100.0e0 * CAST(d.q AS DOUBLE) / CAST(nullif(d.n, 0) AS DOUBLE) AS net_rating
        FROM {supplier} LEFT JOIN offense o ON o.s = s_suppkey LEFT JOIN defense d ON d.s = s_suppkey
        WHERE coalesce(o.n, 0) >= 25""",
    "q_rank_teams": """
        SELECT s_suppkey AS suppkey, s_nationkey AS nation, CAST(round(s_acctbal * 100) AS BIGINT) AS cents,
               rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS place
        FROM {supplier}""",
    "q_grouping_sets": """
        SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q
        FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
}


def relational(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = RELATIONAL[name]
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})

    run.__name__ = name
    return run


#: User events as a play stream.
USERS = Stream(("user_id",), "event_id")
#: Fixed values of the analogy: plays by event type.
PLAY_OF = {"purchase": "2FGM", "error": "TO", "click": "O", "view": "D", "signup": "CM"}


def plays_of(events: DataFrame) -> DataFrame:
    play = F.element_at(F.create_map(*[F.lit(x) for pair in PLAY_OF.items() for x in pair]), F.col("event_type"))
    return events.select(
        "user_id", "event_id", play.alias("playtype"),
        F.when(F.col("event_id") % 2 == 0, "H").otherwise("A").alias("team"),
        F.lit("H").alias("home"), F.lit("A").alias("away"), F.lit(None).cast("string").alias("player"),
        F.to_date("ts").cast("string").alias("period"), "value",
    )


def found_possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.possessions(plays_of(table(spark, sf_dir, "events")), episodes.Plays(USERS))


def q_scalar_subquery_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ' | ') WITHIN GROUP (ORDER BY n_name)").alias("nations"))
    region = table(spark, sf_dir, "region")
    return region.join(names, region["r_regionkey"] == names["n_regionkey"], "left").select(F.col("r_name").alias("region"), "nations")


def q_lateral_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(c).alias("value")) for i, c in enumerate(("p_brand", "p_type", "p_name"), 1)])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(slots).alias("s"))
    return rows.select(F.col("p_partkey").alias("partkey"), "s.slot", "s.value")


def q_array_agg_ordered_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(kept.alias("k"))
    return rows.select("custkey", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("keys"))


def reasons_of(events: DataFrame) -> DataFrame:
    """Quarantine verdicts of users: rows (user_id, reasons), reasons in the fixed order of the checks."""
    counts = events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("value") < 1).alias("small"),
        F.count("*").alias("n"),
    )
    return counts.select("user_id", quality.reasons({"errors": F.col("errors") > 2, "small_values": F.col("small") > 3, "few_rows": F.col("n") < 5}).alias("reasons"))


def q_unnest_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons_of(table(spark, sf_dir, "events")).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def q_quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reasons_of(table(spark, sf_dir, "events"))
    return rows.select("user_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") > 0).alias("excluded"))


def q_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long"))
    filled = ordered.forward_fill(points, USERS, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", filled.alias("score"))


def q_clock_backwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("clock", F.round(F.col("value") * 100).cast("long"))
    return ordered.backwards_report(rows, USERS, "clock")


def q_running_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "event_id", ordered.running_maximum(clock, USERS).alias("clamped"))


def q_clock_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.islands(table(spark, sf_dir, "events"), USERS, "run", F.col("event_type"))
    return rows.groupBy("user_id", "run").agg(
        F.max("event_type").alias("event_type"), F.min("event_id").alias("start"), F.max("event_id").alias("end"), F.count("*").alias("n")
    )


def q_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), day.alias("start"), (day + 60).alias("end"))
    return intervals.merged(spans, ("custkey",))


def q_running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = ordered.running_state(table(spark, sf_dir, "events"), USERS, kind == "signup", kind == "error", F.lit(False))
    return rows.select("user_id", "event_id", "state", "was", "changed", "issue")


def q_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    play = F.when(kind == "click", F.when(F.col("event_id") % 3 == 0, "FTA").otherwise("FTM")).when(kind == "error", "CM").when(kind == "view", "RV").otherwise("2FGM")
    rows = events.select("user_id", "event_id", play.alias("playtype"), F.lit("H").alias("team"), F.when(F.col("value") > 10, "p").alias("player"))
    made = episodes.trips(rows, episodes.Plays(USERS)).where("trip IS NOT NULL")
    return made.select("user_id", "event_id", F.col("trip_position").cast("long"), F.col("trip_size").cast("long"), "trip_long")


def q_possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_possessions(spark, sf_dir)
    return found.select("user_id", F.col("possession_index").cast("long"), "team", "period", "start", "end", "end_reason", "points")


def q_possession_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_possessions(spark, sf_dir).groupBy("team", "end_reason").agg(
        F.count("*").alias("n"), F.sum("points").alias("points"), F.count_if(F.col("end") > F.col("start")).alias("n_long")
    )


def q_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    marks = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start"), F.col("event_id").alias("end"))
    rows = intervals.segment_index(events, marks, ("user_id",), "event_id", "stint")
    return rows.groupBy("user_id", F.col("stint").cast("long").alias("stint")).agg(
        F.min("event_id").alias("start"), F.max("event_id").alias("end"), F.count("*").alias("n")
    )


def q_event_stint_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its possession: the lowest-numbered one that covers it."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    rows = episodes.attach(events, found_possessions(spark, sf_dir), ("user_id",), "event_id")
    return rows.select("user_id", "event_id", F.col("possession_index").cast("long"))


def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return quality.ordered_fingerprint(orders, F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), "o_orderkey")


def q_lineup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.sort_array(F.array("p_name", "p_brand", "p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), lineup_hash(F.col("p_brand"), unit).alias("lineup_id"))


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = at_or_null(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.sum(k).alias("total"), F.count_if(k.isNull()).alias("without"), F.max(k).cast("long").alias("largest")
    )


def q_settlement_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each fiftieth of a user's events as a game: the checks that are due after the last fetch."""
    from rallyline.streaming.settlement import due

    game = F.col("user_id") * 1000 + F.col("event_id") % 50
    seen = table(spark, sf_dir, "events").select(game.alias("game"), F.col("ts").alias("fetched_at"))
    return due(seen, F.lit("2024-12-31 00:00:00").cast("timestamp_ntz")).select("game", "label", "hours")


def q_incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Possessions of two batches of users, put together, against a single pass: per user, and rows that only one has."""
    events = plays_of(table(spark, sf_dir, "events"))
    found = [episodes.possessions(events.where(part), episodes.Plays(USERS)) for part in ("user_id % 2 = 0", "user_id % 2 = 1", "true")]
    parts, whole = found[0].unionByName(found[1]), found[2]
    odd = quality.differences(parts, whole).groupBy("user_id").agg(F.count("*").alias("n_odd"))
    rows = parts.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("points").alias("points"), F.max("end").alias("last"))
    return rows.join(odd, "user_id", "left").fillna(0, ["n_odd"])


def q_seconds_played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time on court of each listed player by team, from substitutions; who never leaves plays to the game's end."""
    s = stand_in(spark, sf_dir)
    return rosters.seconds_played(s.courts, s.length).select("game", "team", "player_id", F.col("seconds").cast("long"))


@dataclass(frozen=True)
class StandIn:
    """The events table as games: a user is a game, event_id position and clock at once, seven players a side."""

    events: DataFrame
    players: DataFrame
    games: DataFrame
    length: DataFrame
    moves: DataFrame
    courts: DataFrame
    spans: DataFrame


def stand_in(spark: SparkSession, sf_dir: str) -> StandIn:
    kind, at = F.col("event_type"), F.col("event_id")
    play = F.when(kind == "signup", "IN").when(kind == "error", "OUT").when(kind == "click", "2FGA").when(kind == "view", "D").otherwise("2FGM")
    side = F.when(at % 2 == 0, "H").otherwise("A")
    events = table(spark, sf_dir, "events").select(
        F.lit("S").alias("season"), F.col("user_id").alias("game"), at.alias("pos"), play.alias("playtype"), side.alias("team"),
        F.concat(F.lit("p"), (F.shiftright(at, 1) % 7).cast("string")).alias("player_id"), F.lit(1).alias("period"),
        (F.shiftright(at, 6)).cast("string").alias("clock"), at.alias("elapsed"), F.lit("H").alias("home"), F.lit("A").alias("away"),
        F.sum(F.when((kind == "purchase") & (at % 2 == 0), 2).otherwise(0)).over(USERS.so_far).alias("score_a"),
        F.sum(F.when((kind == "purchase") & (at % 2 == 1), 2).otherwise(0)).over(USERS.so_far).alias("score_b"),
    )
    games = events.select("season", "game", "home", "away").distinct()
    each = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")
    sides = F.explode(F.array(F.lit("H"), F.lit("A"))).alias("team")
    players = games.select("season", "game", sides).select("season", "game", "team", each).select(
        "season", "game", "team", F.concat(F.lit("p"), F.col("i").cast("string")).alias("player_id"), (F.col("i") < 5).alias("is_starter")
    )
    length = events.groupBy("season", "game").agg((F.max("pos") + 1).alias("game_length"))
    moves = rosters.transitions(events, players)
    courts = rosters.court_intervals(moves, players)
    return StandIn(events, players, games, length, moves, courts, rosters.substitution_spans(events))


def q_not_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams that don't have five players after a substitution span."""
    s = stand_in(spark, sf_dir)
    return rosters.not_five(s.courts, s.spans, s.games).select("game", F.col("end").alias("at_pos"), "team", "n")


def q_substitution_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By team: batches with unequal ins and outs, repeated states, and players whose moves don't add up.

    Rebuilt states always conserve players, so for that check the spells of one player that are open at the end are lost.
    """
    s = stand_in(spark, sf_dir)
    lost = s.courts.where("NOT (player_id = 'p6' AND exit_pos IS NULL)")
    found = {
        "unpaired": rosters.unpaired_substitutions(s.events), "repeated_state": rosters.state_issues(s.moves),
        "conservation": rosters.conservation(s.moves, s.players, lost),
        "team_minutes": rosters.team_minutes(rosters.seconds_played(s.courts, s.length), s.length),
    }
    rows = [bad.select(F.lit(name).alias("finding"), "team") for name, bad in found.items()]
    return functools.reduce(DataFrame.unionByName, rows).groupBy("finding", "team").agg(F.count("*").alias("n"))


def q_off_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays of listed players who aren't on the floor at any time of the play's clock run or substitution span."""
    s = stand_in(spark, sf_dir)
    return rosters.off_court(s.events, s.courts, s.spans, s.players).select("game", "pos", "team", "player_id")


def q_roster_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stints with their times, points and both units; a unit of five has a lineup id."""
    s = stand_in(spark, sf_dir)
    made = rosters.stints(s.events, s.spans, s.courts, s.length, s.games)
    text = lambda c: F.array_join(c, ",")
    return made.select(
        "game", F.col("stint").cast("long"), "start_pos", "end_pos", "start_at", "end_at", "points_a", "points_b",
        text("unit_home").alias("unit_home"), text("unit_away").alias("unit_away"), "lineup_home", "lineup_away",
    )


def q_elapsed_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the start from a countdown clock, or from a period's begin or end."""
    kind, ts = F.col("event_type"), F.col("ts")
    period = (F.dayofmonth(ts) % 6 + 1).cast("int")
    clock = F.when(kind == "view", "").when(kind == "click", None).otherwise(F.date_format(ts, "mm:ss"))
    play = F.when(kind == "view", "BP").when(kind == "signup", "EP").otherwise("TO")
    return table(spark, sf_dir, "events").select("event_id", elapsed_seconds(period, play, clock).cast("long").alias("elapsed"))


def q_official_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes as text against seconds as numbers: null for DNP, which only zero seconds match."""
    n = F.pmod(F.col("o_orderkey"), F.lit(2400))
    text = F.when(n % 5 == 0, "DNP").when(n % 7 == 0, " ").otherwise(F.format_string("%02d:%02d", F.floor(n / 60), n % 60))
    official = official_seconds(text)
    rebuilt = F.when(n % 3 == 0, n).when(n % 2 == 0, 0).otherwise(n + 1)
    rows = table(spark, sf_dir, "orders").select(matches_official(rebuilt, official).alias("agrees"), official.alias("official"))
    return rows.groupBy("agrees").agg(F.count("*").alias("n"), F.count("official").alias("n_known"), F.sum("official").cast("long").alias("seconds"))


def q_winner_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    best = lambda s: F.max(F.when(F.col("o_orderstatus") == s, cents))
    games = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(best("F").alias("home"), best("O").alias("away"))
    return games.select("custkey", winner(F.lit("home"), F.lit("away"), F.col("home"), F.col("away")).alias("winner"))


def q_shot_case_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots by type, and how many have a real coordinate: -1, -1 is the sentinel for none."""
    flag = F.col("l_returnflag")
    action = F.when(flag == "A", "2FGM").when(flag == "R", F.when(F.col("l_linenumber") % 2 == 0, "3FGM").otherwise("3FGA")).otherwise("AS")
    none = F.col("l_discount") == 0.0
    x, y = F.when(none, -1).otherwise(F.col("l_linenumber")), F.when(none, -1).when(F.col("l_tax") == 0.0, -1).otherwise(F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select(
        shot_type(action).alias("shot_type"), shot_made(action).alias("made"), real_coordinate(x, y, x).alias("real"), F.lit(1).alias("one")
    )
    return rows.groupBy("shot_type", "made").agg(F.count("*").alias("n"), F.count("real").alias("n_real"))


def q_name_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    names = names.where(name_like(F.col("name"), "an") | name_like(F.col("name"), "1"))
    more = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = names.unionByName(more.where(name_like(F.col("name"), "#%077")))
    return rows.select("id", "name", F.upper("name").alias("code"))


def q_clutch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings by team over possessions that begin late in their stream and follow a close one."""
    found = found_possessions(spark, sf_dir)
    last = F.max("end").over(USERS.whole)
    rows = found.withColumn("left", last - F.col("start")).where("left <= 30000 AND points <= 2")
    made = rows.groupBy("team").agg(F.count("*").alias("possessions"), F.sum("points").alias("points"))
    return made.select("team", "possessions", "points", rate(F.col("points"), F.col("possessions"), 2, 100).cast("double").alias("rating"))


def q_on_off_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for 100 possessions with a player on the floor at their beginning and off it, net of the opponent's."""
    s = stand_in(spark, sf_dir)
    found = found_possessions(spark, sf_dir).select(F.lit("S").alias("season"), F.col("user_id").alias("game"), F.col("team").alias("offense"), "start", "possession_index", "points")
    on = rosters.on_court(s.courts.where("player_id = 'p2' AND team = 'H'"), found, "start").select("game", "possession_index", F.lit(True).alias("on"))
    rows = found.join(on, ["game", "possession_index"], "left").withColumn("split", F.when(F.col("on"), "on").otherwise("off"))
    side = lambda t: (F.sum(F.when(F.col("offense") == t, F.col("points"))), F.count_if(F.col("offense") == t))
    (points, n), (against, m) = side("H"), side("A")
    made = rows.groupBy("split").agg(points.alias("points"), n.alias("possessions"), against.alias("opp_points"), m.alias("opp_possessions"))
    net = net_rate(F.col("points"), F.col("possessions"), F.col("opp_points"), F.col("opp_possessions"))
    return made.withColumn("net_rating", net.cast("double"))


def q_quarantine_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts without the users that a check excludes, and with them."""
    events = table(spark, sf_dir, "events")
    checks = events.groupBy("user_id").agg(quality.reasons({"errors": F.count_if(F.col("event_type") == "error") > 13}).alias("reasons"))
    bad = checks.where(F.size("reasons") > 0).select("user_id")
    counts = [F.count("*").alias("n"), F.count_distinct("user_id").alias("users")]
    seen = events.join(bad, "user_id", "left_anti").agg(*counts).select(F.lit("default").alias("mode"), "n", "users")
    return seen.unionByName(events.agg(*counts).select(F.lit("include_quarantined").alias("mode"), "n", "users"))


def q_gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over orders and lines: counts against what is expected, sums against official ones, verdicts against checks."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    expected = orders.select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 4 + 3).cast("int"))).alias("i"))
    counts = quality.count_differences(expected, lines.select(F.col("l_orderkey").alias("k")), ["k"])
    found = [counts.select(F.concat(F.lit("count_"), "finding").alias("gate"))]
    units = lambda df, key, by: df.groupBy(F.col(key).alias("k")).agg(F.sum(by).alias("v"))
    sums = quality.reconciled(units(lines, "l_orderkey", F.col("l_quantity").cast("long")), units(orders, "o_orderkey", F.col("o_orderkey") % 150), ["k"], "v")
    found.append(sums.select(F.lit("sum_differs").alias("gate")))
    checks = {"late": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 300_000}
    stored = F.array_compact(F.array(F.when(F.col("o_orderkey") % 3 > 0, F.when(checks["late"], "late")), F.when(checks["large"], "large")))
    verdicts = orders.select((checks["late"] | checks["large"]).alias("flag"), stored.alias("stored"), quality.reasons(checks).alias("again"))
    found.append(quality.reason_mismatches(verdicts, "flag", "stored", F.col("again")).select(F.lit("verdict_differs").alias("gate")))
    found.append(ordered.repeated_order(lines, Stream(("l_orderkey",), "l_linenumber")).select(F.lit("repeated_line").alias("gate")))
    return functools.reduce(DataFrame.unionByName, found).groupBy("gate").agg(F.count("*").alias("n"))


def q_failure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("failed", F.col("o_totalprice") > 300_000)
    return quality.failure_clusters(orders, "failed", ["o_orderstatus", "o_orderpriority"])


def q_possession_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams whose sides' possession counts differ by more than four."""
    found = found_possessions(spark, sf_dir)
    sides = found.select("user_id", F.lit("H").alias("home"), F.lit("A").alias("away")).distinct()
    return episodes.possession_gate(found, episodes.Plays(USERS), sides, 4)


def q_score_decreases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose known score is below the last known one."""
    score = F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", score.alias("score"))
    return ordered.decreases(rows, USERS, "score").select("user_id", "event_id", "score")


def q_ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, tried = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type").isin("purchase", "error"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(ratio(made, tried).alias("rate"), tried.alias("tried"))


_STREAM = "PARTITION BY user_id ORDER BY event_id"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_POSSESSIONS = f"""
    WITH rows AS (
      SELECT user_id, event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS period, CASE WHEN event_id % 2 = 0 THEN 'H' ELSE 'A' END AS team,
             event_type AS t, max(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS last_id
      FROM events
    ), effects AS (
      SELECT user_id, event_id, period, last_id, team, CASE WHEN t = 'purchase' THEN 2 ELSE 0 END AS points,
             CASE t WHEN 'purchase' THEN 'made_shot' WHEN 'error' THEN 'turnover' END AS reason
      FROM rows WHERE t <> 'signup'
      UNION ALL
      SELECT user_id, event_id, period, last_id, CASE team WHEN 'H' THEN 'A' ELSE 'H' END, 0, 'defensive_rebound' FROM rows WHERE t = 'view'
    ), numbered AS (
      SELECT *, count(reason) OVER (PARTITION BY user_id, team, period ORDER BY event_id {_BEFORE}) AS n FROM effects
    ), found AS (
      SELECT user_id, team, period, n, min(event_id) AS start, coalesce(max(event_id) FILTER (reason IS NOT NULL), max(last_id)) AS "end",
             coalesce(max(reason), 'end_of_period') AS end_reason, sum(points)::BIGINT AS points
      FROM numbered GROUP BY user_id, team, period, n
    ), p AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end", start, team) - 1 AS possession_index FROM found
    )"""
_REASONS = """
    WITH c AS (
      SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value < 1) AS small, count(*) AS n
      FROM events GROUP BY user_id
    ), r AS (
      SELECT user_id, list_filter([CASE WHEN errors > 2 THEN 'errors' END, CASE WHEN small > 3 THEN 'small_values' END,
                                   CASE WHEN n < 5 THEN 'few_rows' END], lambda x: x IS NOT NULL) AS reasons FROM c
    )"""
_STATE = f"""
    WITH m AS (
      SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END AS told FROM events
    ), s AS (
      SELECT *, coalesce(last_value(told IGNORE NULLS) OVER ({_STREAM} ROWS UNBOUNDED PRECEDING), false) AS state,
             coalesce(last_value(told IGNORE NULLS) OVER ({_STREAM} {_BEFORE}), false) AS was FROM m
    ), st AS (SELECT user_id, event_id, state, was, told IS NOT NULL AND state <> was AS changed, told IS NOT NULL AND state = was AS issue FROM s)"""
_COURTS = f"""
    WITH e AS (
      SELECT user_id AS game, event_id, CASE WHEN event_id % 2 = 0 THEN 'H' ELSE 'A' END AS team, 'p' || ((event_id >> 1) % 7) AS player_id,
             CASE event_type WHEN 'signup' THEN 'IN' WHEN 'error' THEN 'OUT' WHEN 'click' THEN '2FGA' WHEN 'view' THEN 'D' ELSE '2FGM' END AS play FROM events
    ), length AS (SELECT game, max(event_id) + 1 AS game_length FROM e GROUP BY game),
    state AS (
      SELECT game, team, player_id, event_id, play = 'IN' AS told,
             coalesce(lag(play = 'IN') OVER (PARTITION BY game, team, player_id ORDER BY event_id), player_id < 'p5') AS was FROM e WHERE play IN ('IN', 'OUT')
    ), turns AS (
      SELECT game, team, player_id, event_id AS moment, told FROM state WHERE told <> was
      UNION ALL SELECT game, t.team, 'p' || i, -1, true FROM (SELECT DISTINCT game FROM e), (VALUES ('H'), ('A')) t(team), range(5) r(i)
    ), courts AS (
      SELECT * FROM (SELECT game, team, player_id, told, moment AS enter_pos, lead(moment) OVER (PARTITION BY game, team, player_id ORDER BY moment) AS exit_pos FROM turns) WHERE told
    ), batches AS (
      SELECT game, min(event_id) AS start, max(event_id) AS "end" FROM e WHERE play IN ('IN', 'OUT') GROUP BY game, team, event_id >> 6
    ), marked AS (
      SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY game ORDER BY start, "end" {_BEFORE}) THEN 0 ELSE 1 END AS new FROM batches
    ), spans AS (
      SELECT game, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY game ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS span FROM marked) GROUP BY game, span
    )"""

#: SQL for the DataFrame queries.
ORACLES = {
    "q_scalar_subquery_listagg": """SELECT r_name AS region, (SELECT string_agg(n_name, ' | ' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region""",
    "q_lateral_unpivot": """SELECT p_partkey AS partkey, unnest([1, 2, 3])::INT AS slot, unnest([p_brand, p_type, p_name]) AS value FROM part""",
    "q_array_agg_ordered_filter": """SELECT o_custkey AS custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'), '') AS keys FROM orders GROUP BY o_custkey""",
    "q_unnest_reason_counts": f"""{_REASONS} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason""",
    "q_quarantine_reasons": f"""{_REASONS} SELECT user_id, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS excluded FROM r""",
    "q_forward_fill": f"""SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN round(value * 100)::BIGINT END IGNORE NULLS) OVER ({_STREAM} ROWS UNBOUNDED PRECEDING), 0) AS score FROM events""",
    "q_clock_backwards": f"""WITH b AS (SELECT user_id, coalesce(lag(round(value * 100)::BIGINT) OVER ({_STREAM}), 0) - round(value * 100)::BIGINT AS back FROM events)
        SELECT user_id, count(*) FILTER (back > 0) AS n_backwards, coalesce(max(back) FILTER (back > 0), 0) AS largest_back FROM b GROUP BY user_id""",
    "q_running_maximum": f"""SELECT user_id, event_id, max(round(value * 100)::BIGINT) OVER ({_STREAM} ROWS UNBOUNDED PRECEDING) AS clamped FROM events""",
    "q_clock_islands": f"""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER ({_STREAM}) = event_type THEN 0 ELSE 1 END AS new FROM events),
        r AS (SELECT *, sum(new) OVER ({_STREAM} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m)
        SELECT user_id, run, max(event_type) AS event_type, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM r GROUP BY user_id, run""",
    "q_interval_merge": f"""WITH d AS (SELECT o_custkey AS custkey, (o_orderdate::DATE - DATE '1992-01-01')::INT AS start, (o_orderdate::DATE - DATE '1992-01-01')::INT + 60 AS "end" FROM orders),
        m AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY custkey ORDER BY start, "end" {_BEFORE}) THEN 0 ELSE 1 END AS new FROM d),
        s AS (SELECT *, sum(new) OVER (PARTITION BY custkey ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS span FROM m)
        SELECT custkey, min(start) AS start, max("end") AS "end", count(*) AS parts FROM s GROUP BY custkey, span""",
    "q_running_state": f"""{_STATE} SELECT user_id, event_id, state, was, changed, issue FROM st""",
    "q_seconds_played": f"""{_COURTS} SELECT c.game, team, player_id, sum(coalesce(exit_pos, game_length) - greatest(enter_pos, 0))::BIGINT AS seconds
        FROM courts c JOIN length l ON l.game = c.game GROUP BY c.game, team, player_id""",
    "q_not_five": f"""{_COURTS} SELECT s.game, s."end" AS at_pos, t.team, count(c.player_id) AS n FROM spans s, (VALUES ('H'), ('A')) t(team)
        LEFT JOIN courts c ON c.game = s.game AND c.team = t.team AND c.enter_pos <= s."end" AND coalesce(c.exit_pos, 9e18::BIGINT) > s."end"
        GROUP BY s.game, s."end", t.team HAVING count(c.player_id) <> 5""",
    "q_substitution_issues": f"""{_COURTS}, unpaired AS (
          SELECT team FROM e WHERE play IN ('IN', 'OUT') GROUP BY game, team, event_id >> 6
          HAVING count(*) FILTER (play = 'IN') <> count(*) FILTER (play = 'OUT')
        ), sums AS (
          SELECT team FROM courts c JOIN length l ON l.game = c.game GROUP BY c.game, team, game_length
          HAVING sum(coalesce(exit_pos, game_length) - greatest(enter_pos, 0)) <> 5 * game_length
        ), every AS (SELECT 'unpaired' AS finding, team FROM unpaired UNION ALL SELECT 'team_minutes', team FROM sums
                     UNION ALL SELECT 'conservation', team FROM courts WHERE player_id = 'p6' AND exit_pos IS NULL
                     UNION ALL SELECT 'repeated_state', team FROM state WHERE told = was)
        SELECT finding, team, count(*) AS n FROM every GROUP BY finding, team""",
    "q_off_court": f"""{_COURTS}, runs AS (
          SELECT *, sum(new) OVER (PARTITION BY game ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, CASE WHEN lag(event_id >> 6) OVER (PARTITION BY game ORDER BY event_id) = event_id >> 6 THEN 0 ELSE 1 END AS new FROM e)
        ), wide AS (SELECT *, min(event_id) OVER (PARTITION BY game, run) AS ws, max(event_id) OVER (PARTITION BY game, run) AS we FROM runs),
        plays AS (
          SELECT w.game, w.event_id, w.team, w.player_id, least(ws, coalesce(s.start, ws)) AS ws, greatest(we, coalesce(s."end", we)) AS we
          FROM wide w LEFT JOIN spans s ON s.game = w.game AND w.event_id BETWEEN s.start AND s."end" WHERE play NOT IN ('IN', 'OUT')
        )
        SELECT game, event_id AS pos, team, player_id FROM plays p WHERE NOT EXISTS (
          SELECT 1 FROM courts c WHERE c.game = p.game AND c.team = p.team AND c.player_id = p.player_id AND enter_pos <= we AND coalesce(exit_pos, 9e18::BIGINT) >= ws)""",
    "q_roster_stints": f"""{_COURTS}, nth AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY start) AS stint FROM spans),
        rows AS (
          SELECT e.game, event_id, (SELECT count(*) FROM spans s WHERE s.game = e.game AND s."end" < e.event_id) AS stint,
                 sum(CASE WHEN play = '2FGM' AND team = 'H' THEN 2 ELSE 0 END) OVER (PARTITION BY e.game ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS a,
                 sum(CASE WHEN play = '2FGM' AND team = 'A' THEN 2 ELSE 0 END) OVER (PARTITION BY e.game ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b FROM e
        ), s AS (
          SELECT r.game, r.stint, min(event_id) AS start_pos, max(event_id) AS end_pos, max_by(a, event_id) AS a, max_by(b, event_id) AS b,
                 coalesce(any_value(n.start), 0) AS start_at, coalesce(any_value(n."end"), -1) AS after
          FROM rows r LEFT JOIN nth n ON n.game = r.game AND n.stint = r.stint GROUP BY r.game, r.stint
        ), u AS (
          SELECT s.game, s.stint, c.team, list_sort(list(c.player_id)) AS unit FROM s JOIN courts c
            ON c.game = s.game AND c.enter_pos <= s.after AND coalesce(c.exit_pos, 9e18::BIGINT) > s.after GROUP BY s.game, s.stint, c.team
        ), h AS (SELECT *, CASE WHEN len(unit) = 5 THEN substr(sha256(team || chr(0) || array_to_string(unit, chr(0))), 1, 32) END AS lineup FROM u)
        SELECT s.game, s.stint, start_pos, end_pos, start_at, coalesce(lead(start_at) OVER w, game_length) AS end_at,
               (a - coalesce(lag(a) OVER w, 0))::BIGINT AS points_a, (b - coalesce(lag(b) OVER w, 0))::BIGINT AS points_b,
               array_to_string(x.unit, ',') AS unit_home, array_to_string(y.unit, ',') AS unit_away, x.lineup AS lineup_home, y.lineup AS lineup_away
        FROM s JOIN length l ON l.game = s.game LEFT JOIN h x ON x.game = s.game AND x.stint = s.stint AND x.team = 'H'
        LEFT JOIN h y ON y.game = s.game AND y.stint = s.stint AND y.team = 'A' WINDOW w AS (PARTITION BY s.game ORDER BY s.stint)""",
    "q_elapsed_seconds": """WITH p AS (SELECT event_id, event_type AS t, extract(day FROM ts) % 6 + 1 AS period, extract(minute FROM ts) * 60 + extract(second FROM ts)::BIGINT AS clock FROM events),
        s AS (SELECT *, CASE WHEN period <= 4 THEN 600 * (period - 1) ELSE 2400 + 300 * (period - 5) END AS start, CASE WHEN period <= 4 THEN 600 ELSE 300 END AS length FROM p)
        SELECT event_id, CASE t WHEN 'view' THEN start WHEN 'signup' THEN start + length - clock WHEN 'click' THEN NULL ELSE start + length - clock END::BIGINT AS elapsed FROM s""",
    "q_official_minutes": """WITH n AS (SELECT o_orderkey % 2400 AS n FROM orders),
        o AS (SELECT n, CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN NULL ELSE n END AS official, CASE WHEN n % 3 = 0 THEN n WHEN n % 2 = 0 THEN 0 ELSE n + 1 END AS rebuilt FROM n)
        SELECT CASE WHEN official IS NULL THEN rebuilt = 0 ELSE rebuilt = official END AS agrees, count(*) AS n, count(official) AS n_known, sum(official)::BIGINT AS seconds FROM o GROUP BY 1""",
    "q_winner_case": """WITH g AS (SELECT o_custkey AS custkey, max(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = 'F') AS home, max(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = 'O') AS away FROM orders GROUP BY 1)
        SELECT custkey, CASE WHEN home > away THEN 'home' WHEN away > home THEN 'away' END AS winner FROM g""",
    "q_shot_case_null": """SELECT CASE l_returnflag WHEN 'A' THEN '2P' WHEN 'R' THEN '3P' END AS shot_type,
               CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN l_linenumber % 2 = 0 END AS made, count(*) AS n, count(*) FILTER (l_discount <> 0) AS n_real FROM lineitem GROUP BY 1, 2""",
    "q_name_resolve": """SELECT n_nationkey::BIGINT AS id, n_name AS name, upper(n_name) AS code FROM nation WHERE n_name ILIKE '%an%' OR n_name ILIKE '%1%'
        UNION ALL SELECT c_custkey, c_name, upper(c_name) FROM customer WHERE c_name ILIKE '%#%077%'""",
    "q_clutch_filter": f"""{_POSSESSIONS}, l AS (SELECT *, max("end") OVER (PARTITION BY user_id) - start AS left_ FROM p)
        SELECT team, count(*) AS possessions, sum(points)::BIGINT AS points, round(100 * sum(points) / count(*), 2)::DOUBLE AS rating FROM l WHERE left_ <= 30000 AND points <= 2 GROUP BY team""",
    "q_on_off_split": f"""{_POSSESSIONS}, {_COURTS.lstrip().removeprefix("WITH ")},
        f AS (SELECT p.*, EXISTS (SELECT 1 FROM courts c WHERE c.game = p.user_id AND c.team = 'H' AND player_id = 'p2' AND enter_pos <= p.start AND coalesce(exit_pos, 9e18::BIGINT) > p.start) AS is_on FROM p),
        t AS (SELECT CASE WHEN is_on THEN 'on' ELSE 'off' END AS split, sum(points) FILTER (team = 'H')::BIGINT AS points, count(*) FILTER (team = 'H') AS possessions,
                sum(points) FILTER (team = 'A')::BIGINT AS opp_points, count(*) FILTER (team = 'A') AS opp_possessions FROM f GROUP BY 1)
        SELECT *, round(100.0 * points / possessions - 100.0 * opp_points / opp_possessions, 2)::DOUBLE AS net_rating FROM t""",
    "q_quarantine_default": """WITH good AS (SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') <= 13)
        SELECT 'default' AS mode, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE user_id IN (FROM good)
        UNION ALL SELECT 'include_quarantined', count(*), count(DISTINCT user_id) FROM events""",
    "q_gate_violations": """
        WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1),
        o AS (SELECT o_orderkey AS k, o_orderkey % 4 + 3 AS n, o_orderkey % 150 AS q, o_orderstatus = 'O' AS late, o_totalprice > 300000 AS large FROM orders),
        g AS (
          SELECT CASE WHEN l.n IS NULL THEN 'count_missing' WHEN o.n IS NULL THEN 'count_extra' ELSE 'count_mismatched' END AS gate FROM o FULL JOIN l ON l.k = o.k WHERE l.n IS DISTINCT FROM o.n
          UNION ALL SELECT 'sum_differs' FROM o FULL JOIN l ON l.k = o.k WHERE coalesce(l.q, 0) <> coalesce(o.q, 0)
          UNION ALL SELECT 'verdict_differs' FROM o WHERE late AND k % 3 = 0
          UNION ALL SELECT 'repeated_line' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        ) SELECT gate, count(*) AS n FROM g GROUP BY gate""",
    "q_failure_clusters": """WITH a AS (SELECT o_totalprice > 300000 AS failed, unnest(['o_orderstatus', 'o_orderpriority']) AS attribute, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders)
        SELECT attribute, value, count(*) FILTER (failed) AS failed, count(*) AS played FROM a GROUP BY 1, 2""",
    "q_possession_gate": f"""{_POSSESSIONS}, c AS (SELECT user_id, count(*) FILTER (team = 'H') AS n_home, count(*) FILTER (team = 'A') AS n_away FROM p GROUP BY 1)
        SELECT * FROM c WHERE abs(n_home - n_away) > 4""",
    "q_score_decreases": f"""WITH s AS (SELECT user_id, event_id, round(value * 100)::BIGINT AS score, lag(round(value * 100)::BIGINT) OVER ({_STREAM}) AS before FROM events WHERE event_type = 'purchase')
        SELECT user_id, event_id, score FROM s WHERE score < before""",
    "q_trips": f"""
        WITH p AS (
          SELECT user_id, event_id, event_type = 'click' AS free, CASE WHEN value > 10 THEN 'p' END AS player FROM events WHERE event_type <> 'view'
        ), f AS (
          SELECT *, free AND NOT (coalesce(lag(free) OVER ({_STREAM}), false) AND lag(player) OVER ({_STREAM}) IS NOT DISTINCT FROM player) AS new FROM p
        ), n AS (SELECT *, sum(new::INT) OVER ({_STREAM} ROWS UNBOUNDED PRECEDING) AS trip FROM f)
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, trip ORDER BY event_id) AS trip_position,
               count(*) OVER (PARTITION BY user_id, trip) AS trip_size, count(*) OVER (PARTITION BY user_id, trip) > 3 AS trip_long FROM n WHERE free""",
    "q_possessions": f"""{_POSSESSIONS} SELECT user_id, possession_index, team, period, start, "end", end_reason, points FROM p""",
    "q_possession_aggregate": f"""{_POSSESSIONS} SELECT team, end_reason, count(*) AS n, sum(points)::BIGINT AS points, count(*) FILTER ("end" > start) AS n_long FROM p GROUP BY team, end_reason""",
    "q_event_stint_attach": f"""{_POSSESSIONS} SELECT e.user_id, e.event_id, min(possession_index) AS possession_index FROM events e
        LEFT JOIN p ON p.user_id = e.user_id AND e.event_id BETWEEN p.start AND p."end" GROUP BY e.user_id, e.event_id""",
    "q_incremental_equals_full": f"""{_POSSESSIONS} SELECT user_id, count(*) AS n, sum(points)::BIGINT AS points, max("end") AS last, 0::BIGINT AS n_odd FROM p GROUP BY user_id""",
    "q_stints": f"""WITH s AS (SELECT user_id, event_id, coalesce(sum((event_type = 'signup')::INT) OVER ({_STREAM} {_BEFORE}), 0)::BIGINT AS stint FROM events)
        SELECT user_id, stint, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM s GROUP BY user_id, stint""",
    "q_fingerprint": """WITH r AS (SELECT o_orderkey AS k, md5(o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority) AS m FROM orders),
        a AS (SELECT k >> 12 AS k, md5(string_agg(m, '' ORDER BY k)) AS m, count(*) AS n FROM r GROUP BY k >> 12),
        b AS (SELECT k >> 12 AS k, md5(string_agg(m, '' ORDER BY k)) AS m, sum(n) AS n FROM a GROUP BY k >> 12)
        SELECT md5(string_agg(m, '' ORDER BY k)) AS fingerprint, sum(n)::BIGINT AS n FROM b""",
    "q_lineup_hash": """SELECT p_partkey AS partkey, substr(sha256(p_brand || chr(0) || array_to_string(list_sort([p_name, p_brand, p_type]), chr(0))), 1, 32) AS lineup_id FROM part""",
    "q_json_props": """SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (props->>'$.k' IS NULL) AS without, max((props->>'$.k')::BIGINT) AS largest FROM events GROUP BY event_type""",
    "q_settlement_due": """
        WITH g AS (SELECT user_id * 1000 + event_id % 50 AS game, ts FROM events),
        s AS (SELECT game, min(ts) AS first_at, max(ts) AS last_at FROM g GROUP BY game),
        c AS (SELECT * FROM (VALUES ('+6h', 6), ('+24h', 24), ('+72h', 72), ('+7d', 168)) AS v(label, hours))
        SELECT game, label, hours FROM s, c WHERE TIMESTAMP '2024-12-31' >= first_at + hours * INTERVAL 1 HOUR AND last_at < first_at + hours * INTERVAL 1 HOUR""",
    "q_ratio_of_sums": """SELECT user_id, count(*) FILTER (event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0)::DOUBLE AS rate,
        count(*) FILTER (event_type IN ('purchase', 'error')) AS tried FROM events GROUP BY user_id""",
}


def queries() -> dict[str, Query]:
    from rallyline import audit_queries

    return {name: relational(name) for name in RELATIONAL} | {name: globals()[name] for name in ORACLES} | audit_queries.queries()


def oracle_sql() -> dict[str, str]:
    from rallyline import audit_queries

    return {name: text.format(**{t: t for t in TABLES}) for name, text in RELATIONAL.items()} | ORACLES | audit_queries.ORACLES
