"""Consistency checks of a title against what two sources say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.functions.text import audit_title, surnames

#: The checks, and how much each counts.
WEIGHTS = {"mc-score": 3, "imdb-id": 3, "tmdb-title": 3, "omdb-title": 2, "director": 2, "runtime": 2, "shared-imdb": 2, "year": 1, "stub": 1}
RUNTIME_GAP, YEAR_GAP = 10, 1


def _pair(a: str, b: str) -> Column:
    return F.concat_ws(" vs ", F.col(a).cast("string"), F.col(b).cast("string"))


def conditions() -> dict[str, tuple[Column, Column]]:
    """By check: (whether it fails, what is said), over the columns of an audit subject."""
    other = F.col("omdb_director").isNotNull() & (F.col("omdb_director") != "N/A")
    theirs = F.filter(F.array(audit_title(F.col("tmdb_title")), audit_title(F.col("tmdb_original_title"))), lambda t: t.isNotNull())
    stub = (F.col("omdb_type") != "movie") | ((F.col("omdb_director") == "N/A") & (F.col("omdb_imdb_rating") == "N/A"))
    return {
        "director": (other & (F.coalesce("director", F.lit("")) != "") & ~F.arrays_overlap(surnames(F.col("director")), surnames(F.col("omdb_director"))), _pair("omdb_director", "director")),
        "imdb-id": (F.col("omdb_imdb_id") != F.col("tmdb_imdb_id"), _pair("omdb_imdb_id", "tmdb_imdb_id")),
        "mc-score": (F.col("mc_score") != F.col("omdb_metascore"), _pair("omdb_metascore", "mc_score")),
        "omdb-title": (audit_title(F.col("title")) != audit_title(F.col("omdb_title")), _pair("omdb_title", "title")),
        "runtime": (F.abs(F.col("omdb_runtime_min") - F.col("tmdb_runtime_min")) > RUNTIME_GAP, _pair("omdb_runtime_min", "tmdb_runtime_min")),
        "shared-imdb": (F.size("shared_imdb_film_ids") > 0, F.array_join(F.transform("shared_imdb_film_ids", lambda i: i.cast("string")), ", ")),
        "stub": (F.col("omdb_title").isNotNull() & stub, F.coalesce("omdb_type", F.lit(""))),
        "tmdb-title": (F.col("tmdb_title").isNotNull() & ~F.array_contains(theirs, audit_title(F.col("title"))), _pair("title", "tmdb_title")),
        "year": (F.abs(F.col("year") - F.col("omdb_year")) > YEAR_GAP, _pair("omdb_year", "year")),
    }


def flags(subjects: DataFrame) -> DataFrame:
    """(film_id, reason, detail, score), a row for each check that fails; a check on a missing value does not."""
    return subjects.select("film_id", F.explode(flag_array(conditions())).alias("flag")).select("film_id", "flag.*")


def flag_array(checks: dict[str, tuple[Column, Column]], weights: dict[str, int] | None = None) -> Column:
    """The failing checks as structs, in the checks' order."""
    score = weights or WEIGHTS
    made = [F.when(bad, F.struct(F.lit(k).alias("reason"), detail.alias("detail"), F.lit(score[k]).alias("score"))) for k, (bad, detail) in checks.items()]
    return F.array_compact(F.array(*made))


def with_shared_ids(subjects: DataFrame, id_col: str = "omdb_imdb_id") -> DataFrame:
    """subjects with shared_imdb_film_ids, the other titles that hold the same id.

    Ids held by several titles are rare: they are found by an aggregation, and only these are joined back.
    """
    shared = subjects.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("s_id")).agg(F.array_sort(F.collect_set("film_id")).alias("holders")).where(F.size("holders") > 1)
    joined = subjects.join(shared, F.col(id_col) == F.col("s_id"), "left")
    others = F.filter(F.col("holders"), lambda i: i != F.col("film_id"))
    return joined.withColumn("shared_imdb_film_ids", F.coalesce(others, F.array().cast("array<long>"))).drop("s_id", "holders")


def worst(found: DataFrame, k: int = 20) -> DataFrame:
    """The k titles with the highest total score."""
    return found.groupBy("film_id").agg(F.sum("score").alias("total"), F.count("*").alias("n_flags")).orderBy(F.desc("total"), "film_id").limit(k)


def by_reason(found: DataFrame) -> DataFrame:
    return found.groupBy("reason").agg(F.count("*").alias("n"))


def archive_problems(titles: DataFrame, per_page: int = 24) -> DataFrame:
    """(page, problem) of scraped pages: cards missing, scores that rise with rank, slugs seen twice."""
    from pyspark.sql import Window

    last = titles.agg(F.max("page").alias("last"))
    pages = titles.groupBy("page").agg(F.count("*").alias("n")).join(F.broadcast(last))
    short = pages.where((F.col("n") != per_page) & (F.col("page") != F.col("last"))).select("page", F.lit("cards").alias("problem"))
    before = F.lag("score").over(Window.partitionBy("page").orderBy("rank"))
    rising = titles.withColumn("before", before).where("score > before").select("page", F.lit("order").alias("problem"))
    twice = titles.groupBy("slug").agg(F.count("*").alias("n"), F.min("page").alias("page")).where("n > 1").select("page", F.lit("slug").alias("problem"))
    return short.unionByName(rising).unionByName(twice).distinct()
