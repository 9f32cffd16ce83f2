"""Small aggregates, corpora and states that reports, jobs and ranking sessions read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.expressions import NEW_DAYS
from lumidex.operators.currency import with_currency
from lumidex.operators.views import canon_scores, source_order

#: Thresholds that clients show with the chips' labels.
THRESHOLDS = {"new_arrival_days": NEW_DAYS, "multi_list": 1}


def credits_summary(credits: DataFrame, keywords: DataFrame) -> DataFrame:
    """(credits, films, keywords): rows of credits, titles that have some, distinct keywords."""
    one = credits.agg(F.count("*").alias("credits"), F.count_distinct("film_id").alias("films"))
    return one.join(F.broadcast(keywords.agg(F.count_distinct("keyword").alias("keywords"))))


def claim_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("authority").agg(F.count("*").alias("n"))


def rating_coverage(old: DataFrame) -> DataFrame:
    """(linked, total) of old ratings."""
    return old.agg(F.count("film_id").alias("linked"), F.count("*").alias("total"))


def service_weights(services: DataFrame, listings: DataFrame) -> DataFrame:
    """(slug, name, weight): current listings of each service, none being 0."""
    live = with_currency(listings).where("is_current").groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("n"))
    return services.select("slug", "name").join(live, "slug", "left").select("slug", "name", F.coalesce("n", F.lit(0)).alias("weight"))


def display_order(services: DataFrame) -> DataFrame:
    """Services as they are shown: subscribed, by quality, with a television app, by name. Services are a few hundred rows."""
    return services.orderBy(*source_order())


def resolver_tally(outcomes: DataFrame, least_auto: float = 0.9) -> DataFrame:
    """(grp, n, correct, wrong, review, passes) of a resolver's outcomes (grp, kind, tt, expected_tt): none may be wrong, and least_auto of them decided."""
    right = (F.col("kind") == "match") & F.col("tt").eqNullSafe(F.col("expected_tt"))
    counts = outcomes.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if((F.col("kind") == "match") & ~right).alias("wrong"), F.count_if(F.col("kind") != "match").alias("review"))
    return counts.withColumn("passes", (F.col("wrong") == 0) & (F.col("correct") >= least_auto * F.col("n")))


def canon_members(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """(film_id) of titles that are on enough lists to count as canon."""
    return canon_scores(entries, lists).where(F.col("n_lists") >= THRESHOLDS["multi_list"]).select("film_id")


def alerts(transitions: DataFrame, watchlist: DataFrame, films: DataFrame, services: DataFrame, day) -> DataFrame:
    """(film_id, title, service) of a day's arrivals of watchlisted titles on subscribed streaming services."""
    mine = services.where("subscribed and kind = 'svod'").select(F.col("slug").alias("source"), F.col("name").alias("service"))
    today = transitions.where(F.col("appeared_on") == F.lit(day).cast("date"))
    return today.join(watchlist.select("film_id"), "film_id", "left_semi").join(mine, "source").join(films.select("film_id", "title"), "film_id").select("film_id", "title", "service")


def provider_plan(films: DataFrame, ids: DataFrame, checks: DataFrame, watchlist: DataFrame, today, refreshed_on=None, first_batch: int = 500, every_days: int = 7) -> DataFrame:
    """(film_id, step) of a night's provider lookups: watchlist, then first checks (first_batch of them), then, if the last full refresh is over every_days old, all not checked today.

    The batch of first checks is the feature's own limit; the rest waits for the next night.
    """
    keyed = films.select("film_id").join(ids.where("authority = 'tmdb'").select("film_id").distinct(), "film_id").join(checks.select("film_id", "providers_checked_at"), "film_id", "left")
    listed = keyed.join(watchlist.select("film_id"), "film_id", "left_semi").select("film_id", F.lit("watchlist").alias("step"))
    rest = keyed.join(watchlist.select("film_id"), "film_id", "left_anti")
    first = rest.where("providers_checked_at is null").orderBy("film_id").limit(first_batch).select("film_id", F.lit("first").alias("step"))
    plan = listed.unionByName(first)
    due = F.lit(refreshed_on).cast("date").isNull() | (F.datediff(F.lit(today).cast("date"), F.lit(refreshed_on).cast("date")) > every_days) | (F.lit(refreshed_on).cast("date") > F.lit(today).cast("date"))
    full = rest.where(due).where(~F.col("providers_checked_at").eqNullSafe(F.lit(today).cast("date"))).join(first.select("film_id"), "film_id", "left_anti").select("film_id", F.lit("full").alias("step"))
    return plan.unionByName(full)


def audit_fold(flags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(film_id, codes, score, verdict, shown): a title's flags and its last verdict; fine hides the flags only while they are the same ones."""
    marked = flags.groupBy("film_id").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("codes"), F.sum("score").alias("score"))
    last = verdicts.groupBy("film_id").agg(F.max_by(F.struct("verdict", "reasons"), "id").alias("v")).select("film_id", "v.verdict", "v.reasons")
    rows = marked.join(last, "film_id", "full")
    hidden = (F.col("verdict") == "fine") & (F.col("reasons") == F.col("codes"))
    return rows.select("film_id", "codes", "score", "verdict", (F.col("codes").isNotNull() & ~F.coalesce(hidden, F.lit(False))).alias("shown"))


def verdicts_added(ledger: DataFrame, new: DataFrame, dispositions: DataFrame) -> DataFrame:
    """The ledger (film_id, verdict, reasons and more) with new verdicts, whose reasons are arrays, of titles that are not disposed; reasons are sorted."""
    rows = new.join(dispositions.select("film_id"), "film_id", "left_anti")
    return ledger.unionByName(rows.withColumn("reasons", F.array_join(F.array_sort("reasons"), ",")).select(*ledger.columns))


def repair_corpus(films: DataFrame, dispositions: DataFrame, ids: DataFrame, listings: DataFrame, ratings: DataFrame, owned: DataFrame, watchlist: DataFrame, omdb: DataFrame) -> DataFrame:
    """(film_id, tmdb, criterion, rated, owned, watchlisted, omdb_found) of titles that are not disposed: each flag is a join with distinct keys."""
    rows = films.select("film_id").join(dispositions.select("film_id"), "film_id", "left_anti")
    rows = rows.join(ids.where("authority = 'tmdb'").groupBy("film_id").agg(F.min("value").alias("tmdb")), "film_id", "left")
    flags = {"criterion": listings.where("source = 'criterion'"), "rated": ratings, "owned": owned, "watchlisted": watchlist, "omdb_found": omdb.where("found")}
    for name, df in flags.items():
        rows = rows.join(df.select("film_id", F.lit(True).alias(name)).distinct(), "film_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows


def matching_corpus(films: DataFrame, dispositions: DataFrame, omdb: DataFrame) -> DataFrame:
    """(film_id, title, year, director, runtime_min) that titles are matched with: not disposed, with a record's running time where it has one."""
    found = omdb.where("found").select("film_id", F.nullif(F.regexp_extract(F.get_json_object("payload", "$.Runtime"), r"([0-9]+) min", 1), F.lit("")).cast("int").alias("runtime_min"))
    return films.join(dispositions.select("film_id"), "film_id", "left_anti").join(found, "film_id", "left").select("film_id", "title", "year", "director", "runtime_min")


def audit_corpus(films: DataFrame, dispositions: DataFrame, omdb: DataFrame, ids: DataFrame, scores: DataFrame, facts: DataFrame) -> DataFrame:
    """The subjects of the consistency checks: a title with its record's fields, its score on the other site and its facts; ids that titles share are joined after."""
    o = lambda name, alias: F.get_json_object("payload", f"$.{name}").alias(alias)
    record = omdb.where("found").select(
        "film_id", o("Title", "omdb_title"), o("imdbID", "omdb_imdb_id"), o("Type", "omdb_type"), o("Director", "omdb_director"), o("imdbRating", "omdb_imdb_rating"),
        F.get_json_object("payload", "$.Metascore").try_cast("int").alias("omdb_metascore"), F.substring(F.get_json_object("payload", "$.Year"), 1, 4).try_cast("int").alias("omdb_year"),
        F.nullif(F.regexp_extract(F.get_json_object("payload", "$.Runtime"), r"([0-9]+) min", 1), F.lit("")).try_cast("int").alias("omdb_runtime_min"),
    )
    slug = ids.where("authority = 'metacritic'").groupBy("film_id").agg(F.min("value").alias("slug"))
    scored = slug.join(scores.select("slug", F.col("score").alias("mc_score")), "slug").select("film_id", "mc_score")
    known = facts.select("film_id", F.col("title").alias("tmdb_title"), F.col("original_title").alias("tmdb_original_title"), F.col("imdb_id").alias("tmdb_imdb_id"), F.col("runtime_min").alias("tmdb_runtime_min"))
    rows = films.select("film_id", "title", "year", "director").join(dispositions.select("film_id"), "film_id", "left_anti")
    return rows.join(record, "film_id", "left").join(scored, "film_id", "left").join(known, "film_id", "left")


def id_holders(ids: DataFrame, canon: DataFrame, authority: str, urls: bool = False) -> DataFrame:
    """(value, film_id): who holds an authority's ids, followed to where it was merged and blind to what else became of it; urls: addresses too."""
    rows = ids.where(F.col("authority") == authority)
    rows = rows if urls else rows.where(~F.startswith("value", F.lit("http")))
    to = canon.select(F.col("film_id").alias("c_film"), "canonical_id")
    return rows.join(to, rows["film_id"] == F.col("c_film"), "left").groupBy("value").agg(F.min(F.coalesce("canonical_id", "film_id")).alias("film_id"))


def live_vectors(vectors: DataFrame, model: str, dispositions: DataFrame) -> DataFrame:
    """The vectors (film_id, model, dim, vector) of a model of titles that are not disposed; a wrong length raises."""
    rows = vectors.where(F.col("model") == model).join(dispositions.select("film_id"), "film_id", "left_anti")
    return rows.withColumn("vector", F.when(F.size("vector") == F.col("dim"), F.col("vector")).otherwise(F.raise_error(F.lit("a vector is not of its length")).cast("array<float>")))


def pool_seeds(pool: DataFrame, ratings: DataFrame, omdb: DataFrame) -> DataFrame:
    """(film_id, score, imdb) of titles to rank that are rated 6 and more."""
    return pool.select("film_id").join(ratings.where("score >= 6").select("film_id", "score"), "film_id").join(omdb.select("film_id", "imdb"), "film_id", "left")


def marks_left(marks: DataFrame, placements: DataFrame, order: DataFrame, session_id: int, order_tiers: tuple[int, ...]) -> DataFrame:
    """marks without those that a session has served: placed, and in a tier that is ordered also inserted there."""
    placed = placements.where(F.col("session_id") == session_id)
    inserted = order.where(F.col("session_id") == session_id).select("film_id", "tier", F.lit(True).alias("inserted"))
    rows = placed.join(inserted, ["film_id", "tier"], "left")
    served = rows.where(~F.col("tier").isin(*order_tiers) | F.col("inserted")) if order_tiers else rows
    return marks.join(served.select("film_id"), "film_id", "left_anti")


def rank_status(films: DataFrame, placements: DataFrame, order: DataFrame, session_id: int) -> DataFrame:
    """(film_id, tier, how, awaiting_order) of each title in a session: where it stands, and whether its tier's order lacks it."""
    placed = placements.where(F.col("session_id") == session_id).select("film_id", "tier", "how")
    inserted = order.where(F.col("session_id") == session_id).select("film_id", "tier", F.lit(True).alias("inserted"))
    rows = films.select("film_id").join(placed, "film_id", "left").join(inserted, ["film_id", "tier"], "left")
    return rows.select("film_id", "tier", "how", (F.col("tier").isNotNull() & F.col("inserted").isNull()).alias("awaiting_order"))


def order_state(order: DataFrame, queue: DataFrame, bounds: DataFrame) -> DataFrame:
    """(session_id, tier, ordered, remaining, film_id, other_id, slot) of each tier: the head of its queue (session_id, tier, film_id, place) and the title to compare it with, or the slot it goes to.

    bounds: ranker.insertion_bounds of what is queued; a title that was never compared is
    asked about the middle of the order, and the first of an empty order goes to slot 0.
    """
    sizes = order.groupBy("session_id", "tier").agg(F.count("*").alias("ordered"))
    heads = queue.groupBy("session_id", "tier").agg(F.count("*").alias("remaining"), F.min_by("film_id", F.struct("place", "film_id")).alias("film_id"))
    rows = heads.join(sizes, ["session_id", "tier"], "left").withColumn("ordered", F.coalesce("ordered", F.lit(0)))
    rows = rows.join(bounds.select("session_id", "tier", "film_id", "low", "high"), ["session_id", "tier", "film_id"], "left")
    rows = rows.withColumns({"low": F.coalesce("low", F.lit(0)), "high": F.coalesce("high", F.col("ordered"))}).withColumn("middle", F.when(F.col("low") < F.col("high"), F.floor((F.col("low") + F.col("high")) / 2) + 1))
    at = order.select(F.col("session_id").alias("o_session"), F.col("tier").alias("o_tier"), F.col("position").alias("o_position"), F.col("film_id").alias("other_id"))
    rows = rows.join(at, (F.col("session_id") == F.col("o_session")) & (F.col("tier") == F.col("o_tier")) & (F.col("middle") == F.col("o_position")), "left")
    return rows.select("session_id", "tier", "ordered", "remaining", "film_id", "other_id", F.when(F.col("low") >= F.col("high"), F.col("low")).alias("slot"))


def order_queue(placements: DataFrame, order: DataFrame, deferred: DataFrame, key) -> DataFrame:
    """(session_id, tier, film_id, place): placed titles that their tier's order lacks, in the session's shuffle by key, deferred ones last by the day."""
    left = placements.select("session_id", "tier", "film_id").join(order.select("session_id", "tier", "film_id"), ["session_id", "tier", "film_id"], "left_anti")
    late = deferred.groupBy("session_id", "film_id").agg(F.max("deferred_on").alias("deferred_on"))
    rows = left.join(late, ["session_id", "film_id"], "left")
    window = Window.partitionBy("session_id", "tier").orderBy(F.col("deferred_on").asc_nulls_first(), F.when(F.col("deferred_on").isNull(), key), "film_id")
    return rows.select("session_id", "tier", "film_id", F.row_number().over(window).alias("place"))


def viewing_lines(viewings: DataFrame, said: DataFrame, today) -> DataFrame:
    """viewings (film_id, watched_on, service, logged_on, study) after what was said (pos, film_id, watched_on, service, study).

    One line a title and day; the first service that is known stays, and study is never taken back.
    """
    old = viewings.select("film_id", "watched_on", "service", "logged_on", F.coalesce("study", F.lit(False)).alias("study"), F.lit(-1).cast("long").alias("pos"))
    new = said.select("film_id", "watched_on", "service", F.lit(today).cast("date").alias("logged_on"), F.coalesce("study", F.lit(False)).alias("study"), F.col("pos").cast("long").alias("pos"))
    first = F.min_by("service", F.when(F.col("service").isNotNull(), F.col("pos")))
    return old.unionByName(new).groupBy("film_id", "watched_on").agg(first.alias("service"), F.min_by("logged_on", "pos").alias("logged_on"), F.max("study").alias("study"))
