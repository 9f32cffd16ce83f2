"""Currency of listings: frontiers, arrivals, departures, carry-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.expressions import NEW_DAYS


def frontiers(listings: DataFrame) -> DataFrame:
    """(source, frontier): the last day on which a source was read."""
    return listings.groupBy("source").agg(F.max("last_seen").alias("frontier"))


def with_currency(listings: DataFrame, stamps: DataFrame | None = None) -> DataFrame:
    """listings with is_current: seen at the source's frontier, or since its stamp (source, stamp) where it has one.

    One small row per source comes from an aggregation with map-side combine and joins back.
    """
    limits = frontiers(listings).select(F.col("source").alias("f_source"), "frontier")
    if stamps is not None:
        own = stamps.select(F.col("source").alias("s_source"), "stamp")
        limits = limits.join(own, F.col("f_source") == F.col("s_source"), "left").select("f_source", F.coalesce("stamp", "frontier").alias("frontier"))
    joined = listings.join(limits, listings["source"] == F.col("f_source"), "left")
    return joined.withColumn("is_current", F.coalesce(F.col("last_seen") >= F.col("frontier"), F.lit(False))).drop("f_source", "frontier")


def departed(listings: DataFrame) -> DataFrame:
    return with_currency(listings).where("not is_current").drop("is_current")


def undisposed(films: DataFrame, dispositions: DataFrame) -> DataFrame:
    return films.join(dispositions.select("film_id"), "film_id", "left_anti")


def arrivals(batch: DataFrame, listings: DataFrame, quiet: bool = False) -> DataFrame:
    """Transitions (film_id, source, appeared_on) that a day's batch (film_id, source, url, seen) causes.

    A listing arrives when it is new, or was last seen before the source's frontier as it
    stood before the batch. quiet: none, as for a first reading of a source.
    """
    if quiet:
        return batch.select("film_id", "source", F.col("seen").alias("appeared_on")).limit(0)
    held = listings.select(F.col("film_id").alias("h_film"), F.col("source").alias("h_source"), "last_seen")
    limit = frontiers(listings).select(F.col("source").alias("f_source"), "frontier")
    joined = batch.dropDuplicates(["film_id", "source"]).join(held, (F.col("film_id") == F.col("h_film")) & (F.col("source") == F.col("h_source")), "left")
    joined = joined.join(limit, F.col("source") == F.col("f_source"), "left")
    return joined.where(F.col("h_film").isNull() | (F.col("last_seen") < F.col("frontier"))).select("film_id", "source", F.col("seen").alias("appeared_on"))


def seen_again(listings: DataFrame, batch: DataFrame, parts: int | None = None) -> DataFrame:
    """listings after a batch: first_seen stays, last_seen and url are the batch's.

    parts: partitions that the rows are dealt to by their key, each of which is sorted in one
    task; without it they are sorted where they lie, once more after Spark's own shuffle.
    """
    old = listings.select("film_id", "source", "url", "first_seen", "last_seen", F.lit(0).alias("is_new"))
    new = batch.select("film_id", "source", "url", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), F.lit(1).alias("is_new"))
    rows = old.unionByName(new)
    return (
        (rows.repartition(parts, "film_id", "source") if parts else rows).groupBy("film_id", "source")
        .agg(F.max_by("url", F.struct("last_seen", "is_new")).alias("url"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    )


def carried_forward(listings: DataFrame, failed: DataFrame, day) -> DataFrame:
    """listings where those current of films whose lookup failed are stamped with day: no answer is no departure."""
    flagged = with_currency(listings).join(failed.select(F.col("film_id").alias("x_film")).distinct(), F.col("film_id") == F.col("x_film"), "left")
    stamp = F.when(F.col("is_current") & F.col("x_film").isNotNull(), F.lit(day).cast("date")).otherwise(F.col("last_seen"))
    return flagged.withColumn("last_seen", stamp).drop("x_film", "is_current")


def new_on(transitions: DataFrame, services: DataFrame, today, days: int = NEW_DAYS) -> DataFrame:
    """(film_id, source, appeared_on): the latest arrival within days on each subscribed streaming service."""
    mine = services.where("subscribed and kind = 'svod'").select(F.col("slug").alias("source"))
    recent = transitions.where(F.col("appeared_on") >= F.date_sub(F.lit(today).cast("date"), days))
    return recent.join(mine, "source").groupBy("film_id", "source").agg(F.max("appeared_on").alias("appeared_on"))


def reappearances(events: DataFrame, keys: list[str], at: str, gap: str) -> DataFrame:
    """Rows that come more than gap after the one before of their keys, with that one's time."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return events.withColumn("before", before).where(F.col(at) > F.col("before") + F.expr(f"INTERVAL {gap}"))
