"""Work still to do, as semi- and anti-joins over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISS_RETRY_DAYS = 30


def holding(ids: DataFrame, authority: str) -> DataFrame:
    """(film_id, value): the smallest id of an authority, as text, for each title."""
    return ids.where(F.col("authority") == authority).groupBy("film_id").agg(F.min("value").alias("value"))


def lacking(films: DataFrame, ids: DataFrame, has: str, lacks: str) -> DataFrame:
    """Movies with an id of one authority and none of another."""
    movies = films.where("kind = 'movie'")
    return movies.join(holding(ids, has), "film_id").join(holding(ids, lacks).select("film_id"), "film_id", "left_anti")


def needing_store_id(films: DataFrame, ids: DataFrame, asked: DataFrame, retry_misses: bool = False) -> DataFrame:
    found = lacking(films, ids, "imdb", "itunes")
    return found if retry_misses else found.join(asked.select("film_id"), "film_id", "left_anti")


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def stale(wanted: DataFrame, done: DataFrame, key: str, stamp: str, made: str) -> DataFrame:
    """wanted (key, stamp) that done (key, made) lacks or holds from before stamp, or made under another stamp."""
    have = done.select(F.col(key).alias("d_key"), F.col(made).alias("d_made"))
    joined = wanted.join(have, wanted[key] == F.col("d_key"), "left")
    return joined.where(F.col("d_key").isNull() | F.coalesce(F.col("d_made") < F.col(stamp), F.lit(False))).drop("d_key", "d_made")


def other_version(wanted: DataFrame, done: DataFrame, key: str, column: str) -> DataFrame:
    """wanted whose column differs from done's for the key, null being a value like any other, or that done lacks."""
    have = done.select(F.col(key).alias("d_key"), F.col(column).alias("d_value"))
    joined = wanted.join(have, wanted[key] == F.col("d_key"), "left")
    return joined.where(F.col("d_key").isNull() | ~F.col(column).eqNullSafe(F.col("d_value"))).drop("d_key", "d_value")


def needing_lookup(films: DataFrame, omdb: DataFrame, today, retry_days: int = MISS_RETRY_DAYS) -> DataFrame:
    """Titles never looked up, marked for it, or missed without a year's help or long enough ago."""
    state = omdb.select("film_id", "found", "needs_refresh", "year_fallback", "looked_up", F.lit(True).alias("asked"))
    joined = films.join(state, "film_id", "left")
    old = F.col("looked_up") <= F.date_sub(F.lit(today).cast("date"), retry_days)
    due = F.col("asked").isNull() | F.col("needs_refresh") | (~F.col("found") & (~F.col("year_fallback") | old))
    return joined.where(F.coalesce(due, F.lit(False))).select(*films.columns)


def refresh_order(films: DataFrame, checks: DataFrame, skip_on=None) -> DataFrame:
    """Titles by when they were checked last, never first; skip_on: not those checked on that day."""
    joined = films.join(checks.select("film_id", "providers_checked_at"), "film_id", "left")
    if skip_on is not None:
        joined = joined.where(~F.col("providers_checked_at").eqNullSafe(F.lit(skip_on).cast("date")))
    return joined.orderBy(F.col("providers_checked_at").asc_nulls_first(), "film_id")


def wanted_trailers(films: DataFrame, ids: DataFrame, trailers: DataFrame) -> DataFrame:
    """(film_id, tmdb_id, itunes_id) where no trailer row stands under just these ids: ids are pivoted in one aggregation."""
    pair = ids.groupBy("film_id").agg(F.min(F.when(F.col("authority") == "tmdb", F.col("value"))).alias("tmdb_id"), F.min(F.when(F.col("authority") == "itunes", F.col("value"))).alias("itunes_id"))
    have = trailers.select(F.col("film_id").alias("t_film"), F.col("tmdb_id").cast("string").alias("t_tmdb"), F.col("itunes_id").alias("t_itunes"))
    joined = films.select("film_id").join(pair.where("tmdb_id is not null or itunes_id is not null"), "film_id").join(have, F.col("film_id") == F.col("t_film"), "left")
    same = F.col("tmdb_id").eqNullSafe(F.col("t_tmdb")) & F.col("itunes_id").eqNullSafe(F.col("t_itunes"))
    return joined.where(F.col("t_film").isNull() | ~same).select("film_id", "tmdb_id", "itunes_id")


def stale_years(films: DataFrame, omdb: DataFrame) -> DataFrame:
    """(film_id, year, omdb_year) where a record's year is another than the title's."""
    year = F.try_to_number(F.substring(F.get_json_object("payload", "$.Year"), 1, 4), F.lit("9999")).cast("int")
    return films.join(omdb.select("film_id", year.alias("omdb_year")), "film_id").where((F.col("omdb_year") != F.coalesce("year", F.lit(-1)))).select("film_id", "year", "omdb_year")


def key_disagreements(films: DataFrame, omdb: DataFrame, ids: DataFrame, facts: DataFrame) -> DataFrame:
    """Titles whose record names another imdb id than they hold."""
    held = holding(ids, "imdb").withColumnRenamed("value", "own")
    joined = films.select("film_id").join(omdb.select("film_id", F.get_json_object("payload", "$.imdbID").alias("omdb_id")), "film_id")
    joined = joined.join(held, "film_id", "left").join(facts.select("film_id", "imdb_id"), "film_id", "left")
    return joined.withColumn("known_id", F.coalesce("own", "imdb_id")).where(F.col("omdb_id") != F.col("known_id")).select("film_id", "omdb_id", "known_id")
