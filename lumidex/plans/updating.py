"""Queries of the writes of single tables, of ranking actions, and of search by phrase, character and keyword."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.functions import expressions as X
from lumidex.functions import text as T
from lumidex.operators import matching, ranker, resolution, search, updates, vectors, worklists
from lumidex.plans import adapters as A
from lumidex.plans.identity import shared_dir
from lumidex.plans.searching import search_tables
from lumidex.sources import parsers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _rows(spark: SparkSession, d: str, name: str, key: str) -> tuple[DataFrame, Column]:
    return A.table(spark, d, name), F.col(key)


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


# sources and sinks


@query("""SELECT 'm' || p_partkey AS mediaid, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS title_original, CASE WHEN p_partkey % 3 <> 0 THEN '2001-02-03' END AS release_date,
CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'A, B' END AS directors, '2026-10-31T04:00:00Z' AS license_end, 'film' AS content_type FROM part""")
def media_parse(spark: SparkSession, d: str) -> DataFrame:
    p, k = _rows(spark, d, "part", "p_partkey")
    item = F.struct(
        F.when(k % 4 == 0, _text("m", k)).alias("mediaid"), F.col("p_name").alias("title"), F.when(k % 2 == 0, F.col("p_type")).otherwise(" ").alias("title_original"), F.when(k % 3 == 0, "").otherwise("2001-02-03").alias("release_date"),
        F.when(k % 5 == 0, "nobody").otherwise('["A","B"]').alias("director"), F.lit("2026-10-31T04:00:00Z").alias("license_end_date_time"), F.lit("film").alias("contentType"),
    )
    raw = p.select(_text("m", k).alias("mediaid"), F.to_json(F.struct(F.array(item).alias("playlist"))).alias("payload"))
    return parsers.media_records(raw).select("mediaid", "title", "title_original", "release_date", F.array_join("directors", ", ").alias("directors"), "license_end", "content_type")


@query(f"WITH {A.FILMS_SQL} SELECT row_number() OVER (ORDER BY metacritic DESC NULLS LAST, rt DESC NULLS LAST, imdb DESC NULLS LAST, lower(title), title, year, director) AS line, title, CAST(year AS VARCHAR) AS year, director, CAST(metacritic AS VARCHAR) AS metacritic, CAST(rt AS VARCHAR) AS rt FROM films")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """The export written and read again; its lines are numbered as they stand in the file."""
    path = f"{shared_dir(spark)}/catalogue-export-{uuid.uuid4().hex}"
    parsers.export_csv(A.films(spark, d), path)
    lines = parsers.numbered_lines(spark, path).where("line > 1").select(F.from_csv("value", "title string, year string, director string, metacritic string, rt string, imdb string").alias("x"), "line")
    return lines.select((F.col("line") - 1).alias("line"), "x.title", "x.year", "x.director", "x.metacritic", "x.rt")


# writes of single tables


@query(f"WITH {A.LISTINGS_SQL} SELECT film_id, source, CASE WHEN source <> 'criterion' THEN leaving_date WHEN film_id % 4 = 0 THEN 'May 1' END AS leaving_date FROM listings")
def leaving_by_key(spark: SparkSession, d: str) -> DataFrame:
    films = A.films(spark, d).select("film_id", _text("k", F.col("film_id")).alias("key"))
    labels = films.where("film_id % 4 = 0").select("key", F.lit("May 1").alias("label"))
    return updates.leaving_by_key(A.listings(spark, d), films, labels, "criterion").select("film_id", "source", "leaving_date")


@query("""SELECT p_partkey AS film_id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS overview FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def facts_upsert(spark: SparkSession, d: str) -> DataFrame:
    p, k = _rows(spark, d, "part", "p_partkey")
    old = p.where(k % 2 == 0).select(k.alias("film_id"), F.lit("old").alias("title"), F.col("p_type").alias("overview"))
    return updates.facts_fetched(old, p.where(k % 3 == 0).select(k.alias("film_id"), F.lit("new").alias("title")))


@query("SELECT vec_id AS film_id, CASE WHEN label < 3 THEN 'b' ELSE 'a' END AS model, CASE WHEN label < 3 THEN 2 ELSE 1 END AS at FROM embeddings WHERE label < 3 OR vec_id % 2 = 0")
def embeddings_written(spark: SparkSession, d: str) -> DataFrame:
    """A title has one vector: a batch of another model replaces its row whole."""
    e = A.table(spark, d, "embeddings")
    row = lambda df, model, at: df.select(F.col("vec_id").alias("film_id"), F.lit(model).alias("model"), F.lit(at).alias("at"))
    return updates.replaced_by_key(row(e.where("vec_id % 2 = 0"), "a", 1), row(e.where("label < 3"), "b", 2), ["film_id"])


@query("SELECT count(*) AS n, max(CAST(label AS INT)) AS latest, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE vec_id % 3 = 0")
def embedding_stamp(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("film_id"), F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("model"), F.col("label").cast("int").alias("embedded_on"))
    return vectors.stamp(e, "a")


@query("SELECT slug, max(score) AS score, bool_or(fresh) AS fresh FROM (SELECT 's' || p_partkey AS slug, CAST(p_partkey % 101 AS INT) AS score, false AS fresh FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0 UNION ALL SELECT 's' || p_partkey, CAST(p_size AS INT), true FROM part WHERE p_partkey % 3 = 0) GROUP BY slug")
def staging_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Scraped titles by their slugs: what is scraped again replaces the row."""
    p, k = _rows(spark, d, "part", "p_partkey")
    row = lambda df, score, fresh: df.select(_text("s", k).alias("slug"), score.cast("int").alias("score"), F.lit(fresh).alias("fresh"))
    return updates.replaced_by_key(row(p.where(k % 2 == 0), k % 101, False), row(p.where(k % 3 == 0), F.col("p_size"), True), ["slug"])


@query("""SELECT p_partkey AS film_id, p_partkey % 3 = 0 OR p_partkey % 4 = 0 AS found, CASE WHEN p_partkey % 2 = 0 THEN '2001-01-01' ELSE '2001-10-31' END AS looked_up, CASE WHEN p_partkey % 3 = 0 THEN '2001-10-31' END AS checked,
CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS payload FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def provider_results(spark: SparkSession, d: str) -> DataFrame:
    p, k = _rows(spark, d, "part", "p_partkey")
    old = p.where(k % 2 == 0).select(k.alias("film_id"), (k % 4 == 0).alias("found"), _day("2001-01-01").alias("looked_up"), F.lit(None).cast("date").alias("providers_checked_at"), F.lit("old").alias("payload"))
    found = updates.providers_checked(old, p.where(k % 3 == 0).select(k.alias("film_id"), _day(A.TODAY).alias("day"), F.lit("new").alias("payload")))
    return found.select("film_id", "found", F.col("looked_up").cast("string").alias("looked_up"), F.col("providers_checked_at").cast("string").alias("checked"), "payload")


_OFFERS = """o AS (SELECT user_id AS provider_id, CASE WHEN user_id % 7 = 0 THEN '!!' ELSE event_type || ' Channel ' || (user_id % 20) END AS name FROM events), s AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'click-channel-' || s_suppkey ELSE 's' || s_suppkey END AS slug, s_name AS name, s_acctbal > 0 AS subscribed FROM supplier),
m AS (SELECT DISTINCT user_id AS provider_id FROM events WHERE user_id % 5 = 0), n AS (SELECT provider_id, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM o WHERE name <> '!!' AND provider_id NOT IN (SELECT provider_id FROM m))"""


def _registered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u, s = F.col("user_id"), F.col("s_suppkey")
    offers = A.table(spark, d, "events").select(u.alias("provider_id"), F.when(u % 7 == 0, "!!").otherwise(_text(F.col("event_type"), " Channel ", u % 20)).alias("name"))
    services = A.table(spark, d, "supplier").select(F.when(s % 2 == 0, _text("click-channel-", s)).otherwise(_text("s", s)).alias("slug"), F.col("s_name").alias("name"), F.lit("svod").alias("kind"), (F.col("s_acctbal") > 0).alias("subscribed"))
    mapped = offers.where("provider_id % 5 = 0").select(F.col("provider_id").alias("tmdb_provider_id"), F.lit("old").alias("service_slug"), F.lit("old").alias("label")).distinct()
    return updates.providers_registered(services, mapped, offers)


@query(f"WITH {_OFFERS} SELECT slug, name, subscribed FROM s UNION ALL SELECT slug, arg_min(name, (provider_id, name)), false FROM n WHERE slug NOT IN (SELECT slug FROM s) GROUP BY slug")
def services_registered(spark: SparkSession, d: str) -> DataFrame:
    return _registered(spark, d)[0].select("slug", "name", "subscribed")


@query(f"WITH {_OFFERS} SELECT provider_id, 'old' AS service_slug FROM m UNION ALL SELECT provider_id, min(slug) FROM n GROUP BY provider_id")
def providers_mapped(spark: SparkSession, d: str) -> DataFrame:
    return _registered(spark, d)[1].select(F.col("tmdb_provider_id").alias("provider_id"), "service_slug")


@query("SELECT p_partkey AS film_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 10 AS INT) ELSE 5 END AS score FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND NOT (p_partkey % 3 = 0 AND p_partkey % 4 = 0)")
def ratings_set(spark: SparkSession, d: str) -> DataFrame:
    """Ratings given and taken away; unknown titles get none."""
    p, k = _rows(spark, d, "part", "p_partkey")
    old = p.where(k % 2 == 0).select(k.alias("film_id"), F.lit(5).alias("score"), _day("2001-01-01").alias("rated_at"))
    asked = p.where(k % 3 == 0).select(k.alias("film_id"), F.when(k % 4 != 0, (k % 10).cast("int")).alias("score"), _day(A.TODAY).alias("rated_at"))
    unknown = asked.withColumn("film_id", F.col("film_id") + 5000000)
    return updates.ratings_set(old, asked.unionByName(unknown), A.films(spark, d)).select("film_id", "score")


@query("SELECT p_brand AS slug, CASE WHEN length(p_brand) % 2 = 0 THEN 'new' ELSE 'old' END AS name, CASE WHEN min(p_partkey) % 2 = 0 THEN 4 ELSE 1 END AS trust FROM part WHERE true GROUP BY p_brand HAVING min(p_partkey) % 2 = 0 OR length(p_brand) % 2 = 0")
def list_registry(spark: SparkSession, d: str) -> DataFrame:
    """Lists imported again keep the trust in them."""
    brands = A.table(spark, d, "part").groupBy(F.col("p_brand").alias("slug")).agg(F.min("p_partkey").alias("k"))
    old = brands.where("k % 2 = 0").select("slug", F.lit("old").alias("name"), F.lit(4).alias("trust"))
    return updates.lists_registered(old, brands.where(F.length("slug") % 2 == 0).select("slug", F.lit("new").alias("name")))


@query("SELECT p_type AS list_slug, p_partkey AS rank, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 10 END AS film_id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS title_listed FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def list_entry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Lines imported again keep the titles they are linked to."""
    p, k = _rows(spark, d, "part", "p_partkey")
    line = lambda df, title: df.select(F.col("p_type").alias("list_slug"), k.alias("rank"), F.lit(title).alias("title_listed"))
    old = line(p.where(k % 2 == 0), "old").withColumn("film_id", F.col("rank") * 10).select("list_slug", "rank", "film_id", "title_listed")
    return updates.entries_imported(old, line(p.where(k % 3 == 0), "new"))


@query("""SELECT o_orderpriority AS source, o_orderkey AS line, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS stars, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_custkey WHEN o_orderkey % 2 = 0 THEN CAST(9 AS BIGINT) END AS film_id,
CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'hand' WHEN o_orderkey % 2 = 0 THEN 'resolver' END AS linked_by FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def old_rating_links(spark: SparkSession, d: str) -> DataFrame:
    """Old ratings imported again keep their links; links are then set and taken away."""
    o, k = _rows(spark, d, "orders", "o_orderkey")
    key = [F.col("o_orderpriority").alias("source"), k.alias("line")]
    old = o.where(k % 2 == 0).select(*key, F.lit(2).alias("stars"), F.lit(9).cast("long").alias("film_id"), F.lit("resolver").alias("linked_by"), _day("2001-01-01").alias("linked_on"))
    rows = updates.old_ratings_imported(old, o.where(k % 3 == 0).select(*key, F.lit(1).alias("stars")))
    links = o.where((k % 5 == 0) | (k % 7 == 0)).select(*key, F.when(k % 7 != 0, F.col("o_custkey")).alias("film_id"), F.lit("hand").alias("linked_by"))
    return updates.old_ratings_linked(rows, links, A.TODAY).select("source", "line", "stars", "film_id", "linked_by")


@query("SELECT user_id AS film_id, event_type AS reason, CAST(count(*) AS INT) AS score FROM events GROUP BY ALL")
def audit_replace(spark: SparkSession, d: str) -> DataFrame:
    """A run of the audit replaces all flags."""
    flags = A.table(spark, d, "events").groupBy(F.col("user_id").alias("film_id"), F.col("event_type").alias("reason")).agg(F.count("*").cast("int").alias("score"))
    old = flags.withColumn("film_id", F.col("film_id") + 1000)
    from lumidex.operators.writes import replace_where

    return replace_where(old, F.lit(True), flags)


_OPEN = "r AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'tmdb' ELSE 'list' END AS authority, event_type AS reason, user_id AS film_id, 'd' || event_id AS detail, event_id % 3 = 0 AS resolved FROM events)"


def _review_rows(spark: SparkSession, d: str) -> DataFrame:
    e, k = _rows(spark, d, "events", "event_id")
    return e.select(k.alias("id"), F.when(k % 4 == 0, "tmdb").otherwise("list").alias("authority"), F.col("event_type").alias("reason"), F.col("user_id").alias("film_id"), F.lit(None).cast("string").alias("value"), _text("d", k).alias("detail"), (k % 3 == 0).alias("resolved"))


@query(f"""WITH {_OPEN}, n AS (SELECT 'click' AS reason, c_custkey AS film_id FROM customer)
SELECT id, authority, reason, film_id, resolved FROM r WHERE NOT (authority = 'tmdb' AND NOT resolved AND reason = 'click') UNION ALL SELECT (SELECT max(id) FROM r) + row_number() OVER (ORDER BY film_id), 'tmdb', reason, film_id, false FROM n""")
def review_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """One reason's open rows of an authority made anew, with numbers after the last."""
    entries = A.table(spark, d, "customer").select(F.lit("click").alias("reason"), F.col("c_custkey").alias("film_id"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("detail"))
    return updates.reviews_rebuilt(_review_rows(spark, d), entries, "tmdb", "click").select("id", "authority", "reason", "film_id", "resolved")


@query(f"""WITH {_OPEN} SELECT id, CASE WHEN id % 10 = 1 AND NOT (resolved OR id % 5 = 0) THEN 'asked' ELSE reason END AS reason, CASE WHEN id % 5 = 0 THEN detail || ' [dismissed]' WHEN id % 10 = 1 AND NOT resolved THEN 'more' ELSE detail END AS detail, resolved OR id % 5 = 0 AS resolved FROM r""")
def review_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Rows resolved with a note, others promoted in place; what is resolved is not promoted."""
    rows = _review_rows(spark, d)
    rows = updates.reviews_resolved(rows, rows.where("id % 5 = 0").select("id", F.lit("dismissed").alias("note")))
    return updates.reviews_promoted(rows, rows.where("id % 10 = 1").select("id", F.lit("more").alias("detail")), "asked").select("id", "reason", "detail", "resolved")


@query("""WITH g AS (SELECT p_partkey AS film_id FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 4 <> 0)
SELECT 'film_disposition' AS name, film_id, 'tombstoned' AS kind FROM g UNION ALL SELECT 'film_disposition', p_partkey, 'merged' FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT 'needs_revisit', p_partkey, '' FROM part WHERE p_partkey % 3 = 0 AND p_partkey NOT IN (SELECT film_id FROM g) UNION ALL SELECT 'rank_placement', p_partkey, '' FROM part WHERE p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT film_id FROM g)""")
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Titles hidden: they leave revisits and the ranker; merged ones are refused."""
    p, k = _rows(spark, d, "part", "p_partkey")
    film = k.alias("film_id")
    held = {
        "film_disposition": p.where(k % 4 == 0).select(film, F.lit("merged").alias("kind"), (k + 1).alias("survivor_id"), F.lit(None).cast("string").alias("note"), _day("2001-01-01").alias("created_at")),
        "needs_revisit": p.where(k % 3 == 0).select(film), "rank_placement": p.where(k % 2 == 0).select(film),
    }
    after = updates.tombstoned(p.where(k % 6 == 0).select(film, F.lit("hidden").alias("note")), held, A.TODAY)
    one = lambda name: after[name].select(F.lit(name).alias("name"), "film_id", "kind" if name == "film_disposition" else F.lit("").alias("kind"))
    return one("film_disposition").unionByName(one("needs_revisit")).unionByName(one("rank_placement"))


@query("SELECT p_partkey AS film_id, 'itunes' AS authority, 'i' || p_partkey AS value FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'imdb', 'i' || p_partkey FROM part")
def store_ids_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Ids of one authority that were found wrong go, exactly as they were named."""
    p, k = _rows(spark, d, "part", "p_partkey")
    row = lambda name: p.select(k.alias("film_id"), F.lit(name).alias("authority"), _text("i", k).alias("value"))
    wrong = p.where(k % 5 == 0).select(k.alias("film_id"), _text("i", k).alias("value")).union(p.where(k % 7 == 0).select(k, F.lit("other")))
    return updates.retired_links(wrong, row("itunes").unionByName(row("imdb")), "itunes")


# worklists


@query("SELECT p_partkey AS film_id, 'a' || p_partkey AS value FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 <> 0")
def held_store_ids(spark: SparkSession, d: str) -> DataFrame:
    """The store ids of titles that have no imdb id, the smallest of each."""
    p, k = _rows(spark, d, "part", "p_partkey")
    row = lambda df, name, mark: df.select(k.alias("film_id"), F.lit(name).alias("authority"), _text(mark, k).alias("value"))
    ids = row(p.where(k % 3 == 0), "itunes", "b").unionByName(row(p.where(k % 3 == 0), "itunes", "a")).unionByName(row(p.where(k % 2 == 0), "imdb", "tt"))
    return worklists.lacking(A.films(spark, d), ids, "itunes", "imdb").select("film_id", "value")


@query("SELECT p_partkey AS film_id, 'i' || p_partkey AS value FROM part WHERE p_partkey % 3 = 0")
def every_store_id(spark: SparkSession, d: str) -> DataFrame:
    p, k = _rows(spark, d, "part", "p_partkey")
    ids = p.select(k.alias("film_id"), F.when(k % 3 == 0, "itunes").otherwise("imdb").alias("authority"), _text("i", k).alias("value"))
    return worklists.holding(ids, "itunes")


@query("SELECT p_partkey AS film_id FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 = 0 AND p_partkey % 101 <> 0")
def year_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Titles without a year that hold an id and are not disposed of."""
    films = A.films(spark, d).withColumn("year", F.when(F.col("film_id") % 4 != 0, F.col("year")))
    keyed = films.where("year is null").join(A.every(spark, d, 3), "film_id", "left_semi")
    return worklists.missing(keyed, A.every(spark, d, 101), "film_id").select("film_id")


@query("SELECT p_partkey AS film_id, 'D' || p_partkey AS director FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 2 = 0")
def director_fill(spark: SparkSession, d: str) -> DataFrame:
    """Directors that a source names for titles that have none; what is known is never overwritten."""
    films = A.films(spark, d).withColumn("director", F.when(F.col("film_id") % 5 != 0, F.col("director")))
    said = A.every(spark, d, 2, _text("D", F.col("p_partkey")).alias("said"))
    return films.where("coalesce(director, '') = ''").select("film_id").join(said, "film_id").select("film_id", F.col("said").alias("director"))


# matching


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'match' ELSE 'review' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 10 + 1 END AS film_id, CASE WHEN c_custkey % 3 <> 0 THEN 'ambiguous' END AS reason FROM customer")
def popularity_tie(spark: SparkSession, d: str) -> DataFrame:
    """Two titles of one name and year: the one that is clearly more popular wins, equals are asked about."""
    c, k = _rows(spark, d, "customer", "c_custkey")
    title = _text("Work ", k)
    none = lambda kind: F.lit(None).cast(kind)
    asked = c.select(k.alias("id"), title.alias("title"), F.lit(1990).alias("year"), F.lit(matching.DATABASE).alias("year_kind"), none("string").alias("director"), none("int").alias("runtime_min"), F.lit(False).alias("edition_hint"))
    film = lambda n, popularity: c.select((k * 10 + n).alias("id"), title.alias("title"), F.lit(1990).alias("year"), none("string").alias("director"), none("int").alias("runtime_min"), popularity.cast("double").alias("popularity"))
    found = film(1, F.when(k % 3 == 0, 9).otherwise(5)).unionByName(film(2, F.lit(5)))
    return matching.verdicts(asked, found, popularity=True).select("id", "kind", "film_id", "reason")


@query("""SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS form, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN 'match' ELSE 'review' END AS kind, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN 'tt' || o_orderkey END AS tt FROM orders""")
def entry_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Three forms of a line's title: the first that resolves counts, else the first form's verdict."""
    o, k = _rows(spark, d, "orders", "o_orderkey")
    form = lambda n, hit: o.select(k.alias("entry_id"), F.lit(n).alias("form"), F.when(hit, "match").otherwise("review").alias("kind"), F.when(hit, _text("tt", k)).alias("tt"), F.lit("r").alias("reason"))
    return resolution.best_form(form(0, F.lit(False)).unionByName(form(1, k % 3 == 0)).unionByName(form(2, k % 4 == 0))).select("entry_id", "form", "kind", "tt")


@query("SELECT p_partkey AS film_id, CASE WHEN p_partkey % 2 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'another imdb id' WHEN p_partkey % 5 = 0 THEN NULL ELSE 'unverified' END AS refused FROM part")
def store_refusal(spark: SparkSession, d: str) -> DataFrame:
    p, k = _rows(spark, d, "part", "p_partkey")
    filed = F.when(k % 2 == 0, _text("tt", k)).when(k % 3 == 0, "tt0")
    same = T.same_director(F.lit("Some Body"), F.when(k % 5 == 0, "Somé BODY").when(k % 7 == 0, "Other One"))
    return p.select(k.alias("film_id"), updates.refusal(_text("tt", k), filed, same).alias("refused"))


@query("""SELECT p_partkey AS film_id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' (Director''s Cut)' ELSE p_name END AS title, p_partkey % 2 = 0 AS edition, p_name AS base, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 'A ' || p_name END AS prefix FROM part""")
def resolver_forms(spark: SparkSession, d: str) -> DataFrame:
    """What a resolver is asked with: the title, whether an edition is named, the base title, and what stands before a colon."""
    p, k = _rows(spark, d, "part", "p_partkey")
    title = F.when(k % 2 == 0, _text(F.col("p_name"), " (Director's Cut)")).otherwise(F.col("p_name"))
    colon = F.when((k % 3 == 0) & (k % 2 == 1), _text("A ", F.col("p_name"), ": the rest")).otherwise(title)
    return p.select(k.alias("film_id"), title.alias("title"), T.has_edition(title).alias("edition"), T.without_editions(title).alias("base"), T.colon_prefix(colon).alias("prefix"))


# ranking actions


_PLACED = "placed AS (SELECT p_partkey % 3 AS session_id, p_partkey AS film_id, CAST(p_size % 5 + 1 AS INT) AS tier FROM part), o AS (SELECT session_id, tier, film_id, row_number() OVER (PARTITION BY session_id, tier ORDER BY film_id) AS position FROM placed WHERE film_id % 4 < 2)"


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from lumidex.operators.writes import renumbered

    p, k = _rows(spark, d, "part", "p_partkey")
    placed = p.select((k % 3).alias("session_id"), k.alias("film_id"), (F.col("p_size") % 5 + 1).cast("int").alias("tier"), F.lit("seed").alias("how"), _day("2001-01-01").alias("placed_on"))
    return placed, renumbered(placed.where("film_id % 4 < 2").select("session_id", "tier", "film_id"), ["session_id", "tier"], [F.col("film_id")])


@query("""WITH p AS (SELECT p_partkey AS film_id, CAST(p_size % 5 + 1 AS INT) AS tier FROM part), s AS (SELECT film_id, CASE film_id % 3 WHEN 0 THEN 2 ELSE 5 END AS tier FROM p WHERE film_id % 3 < 2 AND film_id % 2 = 0)
SELECT p.film_id, coalesce(s.tier, p.tier) AS tier, CASE WHEN s.film_id IS NULL THEN 'seed' ELSE 'compared' END AS how FROM p LEFT JOIN s USING (film_id)""")
def rank_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that lead to a place: better, worse to tier 2; worse three times to tier 5; one alone only asks on."""
    p, k = _rows(spark, d, "part", "p_partkey")
    placed = _ranked(spark, d)[0].withColumn("session_id", F.lit(1).cast("long"))
    run = F.when(k % 3 == 0, F.array(F.lit("better"), F.lit("worse"))).when(k % 3 == 1, F.array(F.lit("worse"), F.lit("worse"), F.lit("worse"))).otherwise(F.array(F.lit("better")))
    log = p.where(k % 2 == 0).select(F.lit(1).cast("long").alias("session_id"), k.alias("film_id"), F.posexplode(run).alias("id", "verdict"))
    return updates.compared(log, placed, ranker.next_steps(log), A.TODAY).select("film_id", "tier", "how")


@query(f"""WITH {_PLACED}, m AS (SELECT session_id, film_id, CASE WHEN film_id % 2 = 0 THEN 1 ELSE tier END AS tier FROM placed WHERE film_id % 5 = 0), l AS (SELECT o.* FROM o LEFT JOIN m ON m.session_id = o.session_id AND m.film_id = o.film_id WHERE m.film_id IS NULL OR m.tier = o.tier)
SELECT session_id, tier, film_id, row_number() OVER (PARTITION BY session_id, tier ORDER BY position) AS position FROM l""")
def rank_moves(spark: SparkSession, d: str) -> DataFrame:
    """Orders after moves: who changes tier leaves, and the gap closes."""
    placed, order = _ranked(spark, d)
    moves = placed.where("film_id % 5 = 0").select("session_id", "film_id", F.when(F.col("film_id") % 2 == 0, 1).otherwise(F.col("tier")).alias("tier"))
    return updates.moved(placed, order, moves, A.TODAY)[1].select("session_id", "tier", "film_id", F.col("position").cast("long").alias("position"))


@query(f"WITH {_PLACED} SELECT session_id, film_id, tier FROM placed WHERE film_id % 7 <> 0")
def rank_again(spark: SparkSession, d: str) -> DataFrame:
    placed, _ = _ranked(spark, d)
    log = placed.select("session_id", "film_id", F.lit("better").alias("verdict"))
    return updates.reranked(log, placed, placed.where("film_id % 7 = 0"))[1].select("session_id", "film_id", "tier")


@query("SELECT user_id % 3 AS session_id, user_id AS film_id, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS deferred_on FROM events GROUP BY ALL")
def rank_passes(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select((F.col("user_id") % 3).alias("session_id"), F.col("user_id").alias("film_id"), F.to_date("ts").alias("deferred_on"), "event_id")
    found = updates.deferred(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1"))
    return found.withColumn("deferred_on", F.col("deferred_on").cast("string"))


# search by field


@query("SELECT DISTINCT l_partkey AS film_id FROM lineitem WHERE contains(CAST(l_shipdate AS VARCHAR), '1997-06-1')")
def search_character(spark: SparkSession, d: str) -> DataFrame:
    """Titles with a character, of cast or crew, whose name holds the text."""
    return search.characters_holding(search_tables(spark, d)["credits"], " 1997-06-1")


@query("SELECT DISTINCT l_partkey AS film_id FROM lineitem WHERE CAST(l_shipdate AS VARCHAR) = '1997-06-11 00:00:00' AND l_linenumber % 2 = 0")
def search_character_named(spark: SparkSession, d: str) -> DataFrame:
    """The field character: titles with a member of the cast as a character of just that name."""
    return search.field_filter("character", " 1997-06-11 00:00:00", **search_tables(spark, d))


@query("SELECT p_partkey AS film_id FROM part WHERE lower(p_brand) = 'brand#12' OR lower(p_type) = 'brand 12'")
def search_plot(spark: SparkSession, d: str) -> DataFrame:
    """Titles whose overview or plot have the words in a row; a sign inside is no part of them."""
    return search.field_filter("plot", "Brand#12", **search_tables(spark, d))


@query("SELECT p_partkey AS film_id FROM part WHERE regexp_matches(p_name, '(^| )(ring|rings)( |$)')")
def search_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Keywords by their stems: a plural finds the singular."""
    return search.field_filter("keyword", "Rings", **search_tables(spark, d))


@query("SELECT DISTINCT p_partkey AS film_id, CAST(0.0 AS DOUBLE) AS score FROM part WHERE contains(p_name, 'ring') AND p_type IN ('SMALL', 'ECONOMY') AND p_size + 1950 >= 1960")
def search_grammar(spark: SparkSession, d: str) -> DataFrame:
    """A query line with quoted values, an alias, an open range and two values of one field."""
    return search.search('title:"ring" genre:small genre:"Economy" year:1960-', **search_tables(spark, d))


@query("SELECT l_partkey AS film_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey = 4 GROUP BY l_partkey")
def search_misspelled(spark: SparkSession, d: str) -> DataFrame:
    """A person that nothing is named by is taken for the most similar name."""
    return search.field_filter("person", "Suplier#000000004", **search_tables(spark, d))


@query("SELECT event_id, grams FROM (SELECT event_id, CASE WHEN value < 50 THEN list_transform(range(1, length(event_type) - 1), lambda i: substr(event_type, i, 3)) ELSE [] END AS g, array_to_string(g, '|') AS grams FROM events)")
def trigram_windows(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("value") < 50, F.upper("event_type")).otherwise("ab")
    return A.table(spark, d, "events").select("event_id", F.array_join(X.trigrams(text), "|").alias("grams"))
