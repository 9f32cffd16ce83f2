"""Schemas of the catalogue's tables, as DDL that Spark reads.

Dates are dates, flags booleans, vectors arrays; JSON documents stay strings until a
source parser types them. A table's rows are validated by the checks beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "films": "film_id long, guid string, title string, year int, director string, key string, title_norm string, kind string",
    "listings": "film_id long, source string, url string, first_seen date, last_seen date, leaving_date string",
    "omdb": "film_id long, found boolean, imdb double, rt int, language string, looked_up date, year_fallback boolean, needs_refresh boolean, payload string, metacritic int",
    "my_ratings": "film_id long, score int, rated_at date",
    "meta": "key string, value string",
    "movie_service": "slug string, name string, kind string, subscribed boolean, region string, quality int, has_apple_app boolean, search_url string",
    "service_provider": "tmdb_provider_id long, service_slug string, label string",
    "external_ids": "film_id long, authority string, value string, first_seen date",
    "metacritic": "slug string, title string, year int, score int, rank int, page int, fetched_at date",
    "match_review": "id long, authority string, film_id long, value string, reason string, detail string, created_at date, resolved boolean",
    "tmdb": "film_id long, found boolean, looked_up date, providers_checked_at date, payload string",
    "watchlist": "film_id long, added_on date, position int",
    "availability_transitions": "id long, film_id long, source string, appeared_on date",
    "owned": "film_id long, source string, first_imported date",
    "film_disposition": "film_id long, kind string, survivor_id long, note string, created_at date",
    "needs_revisit": "film_id long, marked_on date, note string",
    "audit_flags": "film_id long, reason string, detail string, score int, run_on date",
    "audit_verdict": "id long, film_id long, verdict string, reasons string, note string, marked_on date",
    "tmdb_facts": "film_id long, tmdb_id long, imdb_id string, title string, original_title string, alt_titles string, release_year int, runtime_min int, fetched_on date, overview string, tagline string, genres string, credits_fetched_on date",
    "claim": "id long, film_id long, authority string, value string, title_ingested string, year_claimed int, edition_label string, edition_year int, runtime_min int, first_seen date",
    "film_list": "slug string, name string, curator string, published_year int, source_url string, ordered boolean, imported_at date, trust int",
    "film_list_entry": "list_slug string, rank int, film_id long, title_listed string, director_listed string, tt_listed string, rank_label string, year_listed int",
    "person": "id long, tmdb_person_id long, name string, first_seen date",
    "film_credit": "film_id long, person_id long, kind string, job string, department string, character string, ord int",
    "film_keyword": "film_id long, keyword string",
    "film_text": "film_id long, title string, overview string, plot string",
    "film_embedding": "film_id long, model string, dim int, vector array<float>, embedded_on date",
    "rank_session": "id long, source string, seed int, started_on date, finished_on date, list_slug string, last_action string",
    "rank_anchor": "session_id long, tier int, film_id long, set_on date",
    "rank_placement": "session_id long, film_id long, tier int, how string, placed_on date",
    "rank_comparison": "id long, session_id long, film_id long, anchor_film_id long, anchor_tier int, verdict string, decided_on date",
    "rank_deferral": "session_id long, film_id long, deferred_on date",
    "unseen": "film_id long, marked_on date, note string",
    "rank_order": "session_id long, tier int, film_id long, position int, ordered_on date",
    "rank_order_comparison": "id long, session_id long, tier int, film_id long, other_film_id long, verdict string, decided_on date",
    "rank_order_deferral": "session_id long, film_id long, deferred_on date",
    "rank_mark": "film_id long, marked_on date",
    "old_rating": "source string, line int, title string, year int, stars int, rented_on date, film_id long, linked_by string, linked_on date",
    "cheapcharts_wishlist": "film_id long, added_on date",
    "film_trailer": "film_id long, tmdb_id long, itunes_id string, trailers string, fetched_on date",
    "store_lookup": "film_id long, asked_on date",
    "viewing": "id long, film_id long, watched_on date, service string, logged_on date, study boolean",
    "artefact": "id long, viewing_id long, kind string, text string, added_on date",
}

#: What a row of a table has to satisfy, and the columns that identify it.
CHECKS: dict[str, str] = {
    "films": "kind IN ('movie', 'series')",
    "my_ratings": "score BETWEEN 0 AND 10",
    "movie_service": "kind IN ('svod', 'store')",
    "film_disposition": "kind IN ('merged', 'tombstoned') AND (kind = 'merged') = (survivor_id IS NOT NULL)",
    "film_credit": "kind IN ('cast', 'crew')",
    "rank_anchor": "tier BETWEEN 1 AND 5",
    "rank_placement": "tier BETWEEN 1 AND 5 AND how IN ('seed', 'compared', 'anchor', 'moved')",
    "rank_comparison": "anchor_tier BETWEEN 1 AND 5 AND verdict IN ('better', 'worse')",
    "rank_order": "tier BETWEEN 1 AND 5 AND position >= 1",
    "rank_order_comparison": "tier BETWEEN 1 AND 5 AND verdict IN ('better', 'worse')",
    "old_rating": "stars BETWEEN 1 AND 5 AND (film_id IS NULL) = (linked_by IS NULL) AND (linked_by IS NULL OR linked_by IN ('resolver', 'created', 'hand'))",
    "artefact": "kind = 'dictation' AND length(trim(text)) > 0",
}
KEYS: dict[str, tuple[str, ...]] = {
    "films": ("film_id",), "listings": ("film_id", "source"), "omdb": ("film_id",), "my_ratings": ("film_id",), "meta": ("key",),
    "movie_service": ("slug",), "external_ids": ("film_id", "authority", "value"), "metacritic": ("slug",), "tmdb": ("film_id",),
    "watchlist": ("film_id",), "owned": ("film_id",), "film_disposition": ("film_id",), "audit_flags": ("film_id", "reason"),
    "claim": ("authority", "value"), "film_list": ("slug",), "film_list_entry": ("list_slug", "rank"), "person": ("tmdb_person_id",),
    "film_credit": ("film_id", "person_id", "kind", "job", "character"), "film_keyword": ("film_id", "keyword"), "film_embedding": ("film_id",),
    "rank_placement": ("session_id", "film_id"), "rank_order": ("session_id", "film_id"), "old_rating": ("source", "line"), "viewing": ("film_id", "watched_on"),
}


def struct(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def is_valid(name: str) -> Column:
    """Whether a row passes the table's check; a check that is unknown because of a null passes, as in SQL."""
    return F.coalesce(F.expr(CHECKS[name]), F.lit(True)) if name in CHECKS else F.lit(True)


def split_rejects(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows)."""
    ok = is_valid(name)
    return df.where(ok), df.where(~ok)


def key_violations(df: DataFrame, name: str) -> DataFrame:
    """Keys that more than one row has, with how many."""
    return df.groupBy(*KEYS[name]).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
