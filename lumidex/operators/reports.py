"""Reports and payloads: row status, score cards, review details, the ledger of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVIEW = "reason string, candidates array<struct<tt:string,title:string,year:int,reasons:array<string>>>, query struct<title:string,year:int,source:string,director:string,runtime_min:int>"


def status() -> Column:
    """pending (never looked up), rated or unmatched, from found."""
    return F.when(F.col("found").isNull(), "pending").when(F.col("found"), "rated").otherwise("unmatched")


def scorecard(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """One row with the count of each kind, in the order given, and of all."""
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in kinds], F.count("*").alias("total"))


def agreement(rows: DataFrame) -> DataFrame:
    """(agree, disagree, supplied, compared) of reconciled ids."""
    same, other = F.count_if(F.col("agreement") == "agree"), F.count_if(F.col("agreement") == "disagree")
    return rows.agg(same.alias("agree"), other.alias("disagree"), F.count_if(F.col("agreement") == "supplied").alias("supplied"), (same + other).alias("compared"))


def review_json(reason: Column, candidates: Column, query: Column) -> Column:
    return F.to_json(F.struct(reason.alias("reason"), F.slice(candidates, 1, 3).alias("candidates"), query.alias("query")))


def read_review(detail: Column) -> Column:
    """The struct of a review's JSON, up to its last brace; older free text is null."""
    text = F.regexp_extract(detail, r"(?s)^(\{.*\})", 1)
    return F.when(text != "", F.from_json(text, REVIEW))


def ratified(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger (film_id, source, expected_tt, status, note) with human verdicts put in: a verified row that says the same stays, others are replaced."""
    new = entries.select(*[F.col(c).alias(f"n_{c}") for c in ledger.columns])
    joined = ledger.join(new, (F.col("film_id") == F.col("n_film_id")) & (F.col("source") == F.col("n_source")), "full")
    stays = F.col("n_film_id").isNull() | F.coalesce((F.col("status") == "verified") & F.col("expected_tt").eqNullSafe(F.col("n_expected_tt")), F.lit(False))
    return joined.select(*[F.when(stays, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c) for c in ledger.columns])


def film_json(view: DataFrame) -> DataFrame:
    """(film_id, body): each row of a view as a JSON document, nested arrays and all."""
    return view.select("film_id", F.to_json(F.struct("*")).alias("body"))


def writers(credits: DataFrame, persons: DataFrame) -> DataFrame:
    """(film_id, writers): one label a person, with the jobs unless they are plain writing."""
    plain = ("Screenplay", "Writer")
    jobs = credits.where((F.col("kind") == "crew") & (F.col("department") == "Writing")).groupBy("film_id", "person_id").agg(F.array_sort(F.collect_set("job")).alias("jobs"), F.min("ord").alias("ord"))
    named = jobs.join(persons.select(F.col("id").alias("person_id"), "name"), "person_id")
    label = F.when(F.arrays_overlap("jobs", F.array(*map(F.lit, plain))), F.col("name")).otherwise(F.concat("name", F.lit(" ("), F.array_join(F.transform("jobs", F.lower), "/"), F.lit(")")))
    return named.groupBy("film_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", label.alias("label")))), lambda x: x["label"]).alias("writers"))


def directors(credits: DataFrame, persons: DataFrame) -> DataFrame:
    """(film_id, director): names of a title's directors, in order."""
    crew = credits.where("job = 'Director'").join(persons.select(F.col("id").alias("person_id"), "name"), "person_id")
    return crew.groupBy("film_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("director"))


def shaped_credits(credits: DataFrame) -> DataFrame:
    """(film_id, director, cast, writers) of credits (film_id, name, kind, job, department, character, ord).

    The first director; the cast in billing order without uncredited players; writers in the
    order in which they come, one entry a person, with the jobs unless they are plain writing.
    """
    crew = F.col("kind") == "crew"
    directs = crew & (F.col("job") == "Director")
    billed = (F.col("kind") == "cast") & ~F.lower("character").contains("uncredited")
    writes = crew & (F.col("department") == "Writing") & ~directs
    person = credits.groupBy("film_id", "name").agg(
        F.min(F.when(directs, F.col("ord"))).alias("directs"), F.min(F.when(writes, F.col("ord"))).alias("writes"),
        F.array_sort(F.collect_list(F.when(billed, F.struct("ord", "character")))).alias("roles"),
        F.transform(F.array_sort(F.collect_list(F.when(writes, F.struct("ord", "job")))), lambda x: x["job"]).alias("jobs"),
    )
    tags = F.array_join(F.array_distinct(F.transform(F.filter("jobs", lambda j: j != ""), F.lower)), "/")
    label = F.when(F.arrays_overlap("jobs", F.array(F.lit("Screenplay"), F.lit("Writer"))) | (tags == ""), F.col("name")).otherwise(F.concat("name", F.lit(" ("), tags, F.lit(")")))
    roles = F.flatten(F.collect_list(F.transform("roles", lambda r: F.struct(r["ord"].alias("ord"), F.col("name"), r["character"].alias("character")))))
    return person.groupBy("film_id").agg(
        F.min_by("name", F.when(F.col("directs").isNotNull(), F.struct("directs", "name"))).alias("director"),
        F.transform(F.array_sort(roles), lambda r: F.struct(r["name"].alias("name"), r["character"].alias("character"))).alias("cast"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("writes").isNotNull(), F.struct("writes", "name", label.alias("label"))))), lambda w: F.struct(w["name"].alias("name"), w["label"].alias("label"))).alias("writers"),
    )


def tier_tally(placements: DataFrame) -> DataFrame:
    """(session_id, tier, n, share) of placements."""
    counted = placements.groupBy("session_id", "tier").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("session_id")))
