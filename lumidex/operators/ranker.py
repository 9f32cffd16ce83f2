"""Ranking by pairwise preference: tiers, orders, queues, from append-only logs of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.expressions import queue_key, tier_for_score

#: The score a tier is about, and where a run of verdicts against anchors leads (ask a tier, or place in one).
TIER_MIDDLE = {1: 10, 2: 9, 3: 8, 4: 7, 5: 5}
STEPS = {
    "": ("ask", 3), "better": ("ask", 2), "better,better": ("place", 1), "better,worse": ("place", 2), "worse": ("ask", 4),
    "worse,better": ("place", 3), "worse,worse": ("ask", 5), "worse,worse,better": ("place", 4), "worse,worse,worse": ("place", 5),
}


def next_steps(comparisons: DataFrame) -> DataFrame:
    """(session_id, film_id, action, tier): what the log of a title's verdicts says comes next; a log that leads nowhere raises."""
    spark = comparisons.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, *v) for k, v in STEPS.items()], "run string, action string, tier int"))
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "verdict"))), lambda x: x["verdict"]), ",")
    runs = comparisons.groupBy("session_id", "film_id").agg(run.alias("run")).join(table, "run", "left")
    action = F.when(F.col("action").isNull(), F.raise_error(F.concat(F.lit("no step follows "), F.col("run"))).cast("string")).otherwise(F.col("action"))
    return runs.select("session_id", "film_id", action.alias("action"), "tier")


def insertion_bounds(order: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(session_id, tier, film_id, low, high, probe): where a title can stand in its tier's order, from its verdicts.

    better than a title caps the slot at its place, worse lifts it past that; slots count
    from 0. probe is the title to compare with next, null when the slot is pinned. Bounds
    that cross raise.
    """
    places = order.select("session_id", "tier", F.col("film_id").alias("other_film_id"), (F.col("position") - 1).alias("at"))
    sizes = order.groupBy("session_id", "tier").agg(F.count("*").alias("n"))
    known = verdicts.join(places, ["session_id", "tier", "other_film_id"], "left")
    bounds = known.groupBy("session_id", "tier", "film_id").agg(F.min(F.when(F.col("verdict") == "better", F.col("at"))).alias("cap"), F.max(F.when(F.col("verdict") == "worse", F.col("at") + 1)).alias("floor"))
    bounds = bounds.join(sizes, ["session_id", "tier"], "left").select("session_id", "tier", "film_id", F.coalesce("floor", F.lit(0)).alias("low"), F.coalesce("cap", "n", F.lit(0)).alias("high"))
    crossed = F.raise_error(F.lit("verdicts contradict each other")).cast("int")
    middle = F.when(F.col("low") > F.col("high"), crossed).when(F.col("low") < F.col("high"), F.floor((F.col("low") + F.col("high")) / 2).cast("int"))
    bounds = bounds.withColumn("middle", middle)
    at = places.select(F.col("session_id").alias("p_session"), F.col("tier").alias("p_tier"), F.col("other_film_id").alias("probe"), "at")
    on = (F.col("session_id") == F.col("p_session")) & (F.col("tier") == F.col("p_tier")) & (F.col("middle") == F.col("at"))
    return bounds.join(at, on, "left").select("session_id", "tier", "film_id", "low", "high", "probe")


def anchors(seeded: DataFrame) -> DataFrame:
    """(tier, film_id) nearest to each tier's middle among seeded (film_id, title, score, imdb)."""
    middle = F.create_map(*[F.lit(x) for pair in TIER_MIDDLE.items() for x in pair])
    placed = seeded.withColumn("tier", tier_for_score(F.col("score"))).where("tier is not null")
    key = F.struct(F.abs(F.col("score") - middle[F.col("tier")]), -F.coalesce("imdb", F.lit(-1.0)), "title", "film_id")
    return placed.groupBy("tier").agg(F.min_by("film_id", key).alias("film_id"))


def queue(pool: DataFrame, seed: int, deferred: DataFrame, *excluded: DataFrame) -> DataFrame:
    """(film_id, place): a session's titles in its shuffle, deferred ones last by the day, without those of excluded."""
    left = pool.select("film_id").distinct()
    for gone in excluded:
        left = left.join(gone.select("film_id"), "film_id", "left_anti")
    late = deferred.groupBy("film_id").agg(F.max("deferred_on").alias("deferred_on"))
    key = F.when(F.col("deferred_on").isNull(), queue_key(seed, F.col("film_id")))
    # places are counted within slices of the shuffle (a hash, so slices are even) and of the days, and slices by prefix sums
    placed = left.join(late, "film_id", "left").withColumn("key", key).withColumn("slice", F.shiftright("key", 20).cast("int"))
    slices = placed.groupBy("deferred_on", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.col("deferred_on").asc_nulls_first(), F.col("slice").asc_nulls_last())) - F.col("n")
    slices = slices.select(F.col("deferred_on").alias("s_day"), F.col("slice").alias("s_slice"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy("deferred_on", "slice").orderBy(F.col("key").asc_nulls_last(), "film_id"))
    joined = placed.withColumn("own", own).join(slices, F.col("deferred_on").eqNullSafe(F.col("s_day")) & F.col("slice").eqNullSafe(F.col("s_slice")))
    return joined.select("film_id", (F.col("before") + F.col("own")).alias("place"))


def rank_pool(owned: DataFrame, marked: DataFrame, ratings: DataFrame, dispositions: DataFrame, unseen: DataFrame) -> DataFrame:
    """Titles to rank: owned, marked or rated 6 and more, without those hidden, unseen or rated below."""
    found = owned.select("film_id").union(marked.select("film_id")).union(ratings.where("score >= 6").select("film_id")).distinct()
    for gone in (dispositions, unseen, ratings.where("score < 6")):
        found = found.join(gone.select("film_id"), "film_id", "left_anti")
    return found


def without_last(log: DataFrame, session_id: int) -> DataFrame:
    """The log without a session's last entry."""
    last = log.where(F.col("session_id") == session_id).agg(F.max("id").alias("last"))
    return log.join(F.broadcast(last), F.col("id") == F.col("last"), "left_anti")


def session_state(placements: DataFrame, anchors: DataFrame, pool: DataFrame, gone: DataFrame) -> DataFrame:
    """(tier, tally, anchor, needs_anchor, placed, remaining) of a session, a row for each of anchors (tier, film_id).

    gone (film_id): titles that are unseen or hidden; an anchor among them is to be replaced,
    and none of them is left to place.
    """
    tally = placements.groupBy("tier").agg(F.count("*").alias("tally"))
    out = gone.select(F.col("film_id").alias("g_film")).distinct()
    rows = anchors.select("tier", F.col("film_id").alias("anchor")).join(tally, "tier", "left").join(out, F.col("anchor") == F.col("g_film"), "left")
    left = pool.select("film_id").distinct().join(placements.select("film_id"), "film_id", "left_anti").join(out, F.col("film_id") == F.col("g_film"), "left_anti")
    placed = placements.agg(F.count("*").alias("placed"))
    remaining = left.agg(F.count("*").alias("remaining"))
    rows = rows.join(F.broadcast(placed)).join(F.broadcast(remaining))  # one row each
    needs = F.col("anchor").isNull() | F.col("g_film").isNotNull()
    return rows.select("tier", F.coalesce("tally", F.lit(0)).alias("tally"), "anchor", needs.alias("needs_anchor"), "placed", "remaining")
