"""Queries of decisions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.functions import expressions as X
from lumidex.operators import reports, resolution
from lumidex.plans import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_RECONCILED = "r AS (SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'tt' || (o_custkey % 900) END AS resolved, CASE WHEN o_orderkey % 4 <> 0 THEN 'tt' || (CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END % 900) END AS listed, o_orderpriority AS list_slug, o_orderkey AS rank FROM orders), c AS (SELECT *, CASE WHEN resolved IS NULL OR listed IS NULL OR resolved = listed THEN coalesce(resolved, listed) END AS tt, CASE WHEN listed IS NULL THEN '' WHEN resolved IS NULL THEN 'supplied' WHEN resolved = listed THEN 'agree' ELSE 'disagree' END AS agreement FROM r)"


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tt = lambda n: F.concat(F.lit("tt"), (n % 900).cast("string"))
    rows = A.table(spark, d, "orders").select(k.alias("entry_id"), F.when(k % 3 != 0, tt(c)).alias("resolved"), F.when(k % 4 != 0, tt(F.when(k % 5 == 0, c + 1).otherwise(c))).alias("listed"), F.col("o_orderpriority").alias("list_slug"), k.alias("rank"))
    return rows.withColumn("x", resolution.reconciled(F.col("resolved"), F.col("listed"))).select("entry_id", "list_slug", "rank", "resolved", "listed", "x.*")


@query(f"WITH {_RECONCILED} SELECT entry_id, tt, agreement FROM c")
def reconcile_ids(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).select("entry_id", "tt", "agreement")


@query(f"WITH {_RECONCILED} SELECT count(*) FILTER (WHERE agreement = 'agree') AS agree, count(*) FILTER (WHERE agreement = 'disagree') AS disagree, count(*) FILTER (WHERE agreement = 'supplied') AS supplied, count(*) FILTER (WHERE agreement IN ('agree', 'disagree')) AS compared FROM c")
def id_agreement(spark: SparkSession, d: str) -> DataFrame:
    return reports.agreement(_reconciled(spark, d))


_GATED = f"{_RECONCILED}, h AS (SELECT 'tt' || p_partkey AS tt, CASE WHEN p_partkey % 6 = 0 THEN p_partkey // 2 ELSE p_partkey END AS holder FROM part WHERE p_partkey % 2 = 0), g AS (SELECT c.*, holder, CASE WHEN holder IS NOT NULL THEN 'held' WHEN entry_id % 11 = 0 THEN 'tombstoned' WHEN entry_id % 13 = 0 THEN 'blocked' ELSE 'clear' END AS gate FROM c LEFT JOIN h USING (tt))"


def _gated(spark: SparkSession, d: str) -> DataFrame:
    rows = _reconciled(spark, d).withColumn("key", F.concat(F.lit("k"), F.col("entry_id").cast("string")))
    p = A.table(spark, d, "part").where("p_partkey % 2 = 0")
    ids = p.select(F.col("p_partkey").alias("film_id"), F.lit("imdb").alias("authority"), F.concat(F.lit("tt"), F.col("p_partkey").cast("string")).alias("value"))
    canon = p.where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("film_id"), F.floor(F.col("p_partkey") / 2).alias("canonical_id"))
    gone = rows.where("entry_id % 11 = 0").select("key")
    return resolution.gates(rows, ids, gone, rows.where("entry_id % 13 = 0"), canon)


@query(f"WITH {_GATED} SELECT entry_id, gate, holder FROM g")
def gate_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("entry_id", "gate", "holder")


_OUTCOMES = f"{_GATED}, n AS (SELECT *, coalesce(CAST(holder AS VARCHAR), tt) AS target FROM g), m AS (SELECT *, CASE WHEN target IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY list_slug, target ORDER BY rank) END AS nth FROM n), o AS (SELECT *, CASE WHEN agreement = 'disagree' OR tt IS NULL THEN 'review' WHEN nth > 1 THEN 'duplicate-entry' WHEN gate = 'held' THEN 'linked' WHEN gate = 'clear' THEN 'would-create' ELSE 'blocked' END AS outcome FROM m)"


@query(f"WITH {_OUTCOMES} SELECT entry_id, outcome FROM o")
def list_import(spark: SparkSession, d: str) -> DataFrame:
    return resolution.import_outcomes(_gated(spark, d)).select("entry_id", "outcome")


@query(f"WITH {_OUTCOMES} SELECT " + ", ".join(f"count(*) FILTER (WHERE outcome = '{k}') AS {k.replace('-', '_')}" for k in ("linked", "would-create", "review", "blocked", "duplicate-entry")) + ", count(*) AS total FROM o")
def import_scorecard(spark: SparkSession, d: str) -> DataFrame:
    rows = resolution.import_outcomes(_gated(spark, d)).withColumn("kind", F.col("outcome"))
    return reports.scorecard(rows, ["linked", "would-create", "review", "blocked", "duplicate-entry"])


@query("WITH g AS (SELECT p_name AS group_id, p_partkey AS film_id, p_partkey % 5 = 0 AS on_stream, p_partkey % 3 = 0 AS rated, p_partkey % 7 = 0 AS owned, p_partkey % 2 = 0 AS watchlisted, p_size > 25 AS found FROM part) SELECT group_id, arg_max(film_id, (on_stream, rated, owned, watchlisted, found, -film_id)) AS film_id FROM g GROUP BY group_id")
def survivor_policy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return resolution.survivors(A.table(spark, d, "part").select(F.col("p_name").alias("group_id"), k.alias("film_id"), (k % 5 == 0).alias("on_stream"), (k % 3 == 0).alias("rated"), (k % 7 == 0).alias("owned"), (k % 2 == 0).alias("watchlisted"), (F.col("p_size") > 25).alias("found")))


@query("WITH v AS (SELECT user_id AS film_id, event_id AS pos, CASE event_type WHEN 'click' THEN 'Trailer' WHEN 'view' THEN 'Teaser' ELSE 'Clip' END AS type, 'key' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS key, CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN NULL ELSE 'de' END AS lang, event_id % 3 = 0 AS official, CAST(floor(value) AS INT) % 3 * 360 AS size FROM events), r AS (SELECT film_id, key, row_number() OVER (PARTITION BY film_id ORDER BY CASE type WHEN 'Trailer' THEN 0 ELSE 1 END, CASE WHEN coalesce(lang, 'en') = 'en' THEN 0 ELSE 1 END, CASE WHEN official THEN 0 ELSE 1 END, size DESC, pos) AS n FROM v WHERE type IN ('Trailer', 'Teaser') AND coalesce(lang, 'en') IN ('en', 'fr')) SELECT film_id, string_agg(key, ',' ORDER BY n) AS keys FROM r WHERE n <= 3 GROUP BY film_id")
def trailer_pick(spark: SparkSession, d: str) -> DataFrame:
    e, k = A.table(spark, d, "events"), F.col("event_id")
    videos = e.select(
        F.col("user_id").alias("film_id"), k.alias("pos"), F.lit("YouTube").alias("site"), F.when(F.col("event_type") == "click", "Trailer").when(F.col("event_type") == "view", "Teaser").otherwise("Clip").alias("type"),
        F.concat(F.lit("key"), F.lpad(k.cast("string"), 8, "0")).alias("key"), F.lit(None).cast("string").alias("name"), F.when(k % 4 == 0, "en").when(k % 4 == 1, "fr").when(k % 4 == 3, "de").alias("language"),
        (k % 3 == 0).alias("official"), (F.floor("value").cast("int") % 3 * 360).alias("size"), F.lit("fr").alias("original_language"),
    )
    return resolution.trailers(videos).select("film_id", F.array_join(F.transform("trailers", lambda t: t["key"]), ",").alias("keys"))


@query(f"WITH {A.FILMS_SQL} SELECT film_id, title, year FROM films WHERE contains(lower(title), 'bolt') AND contains(lower(director), 'brand#1') AND year BETWEEN 1955 AND 1990 AND metacritic >= 40")
def row_filter(spark: SparkSession, d: str) -> DataFrame:
    return resolution.row_filter(A.films(spark, d), title="Bolt", director="brand#1", ranges={"year": (1955, 1990), "metacritic": (40, None)}).select("film_id", "title", "year")


@query("""WITH f AS (SELECT p_partkey AS film_id, CAST(1950 + p_size AS INT) AS year, list_filter(string_split(lower(p_name), ' '), lambda w: w NOT IN ('', 'the', 'a', 'an', 'of', 'and')) AS w FROM part),
p AS (SELECT q.film_id AS query_id, f.film_id, row_number() OVER (PARTITION BY q.film_id ORDER BY f.year, f.film_id) AS n FROM f q JOIN f ON list_has_all(f.w, q.w) WHERE len(q.w) > 0) SELECT query_id, film_id, CAST(1 AS INT) AS stage FROM p WHERE n <= 5""")
def nearest_titles(spark: SparkSession, d: str) -> DataFrame:
    asked = A.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("The "), F.col("p_name")).alias("title"), F.lit(None).cast("int").alias("year"))
    return resolution.nearest_titles(A.films(spark, d), asked)


@query("SELECT CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'rated' ELSE 'unmatched' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def row_status(spark: SparkSession, d: str) -> DataFrame:
    found = A.table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("found"))
    return A.table(spark, d, "documents").select("doc_id").join(found, "doc_id", "left").groupBy(reports.status().alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type AS reason, user_id AS year, len(ts) AS n_candidates FROM (SELECT event_id, event_type, user_id, ['a', 'b', 'c'] AS ts FROM events)")
def review_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Review details written as JSON and read back: four candidates, of which three are kept."""
    e = A.table(spark, d, "events")
    one = lambda t: F.struct(F.lit(t).alias("tt"), F.col("event_type").alias("title"), F.col("user_id").cast("int").alias("year"), F.array(F.lit("r")).alias("reasons"))
    asked = F.struct(F.col("event_type").alias("title"), F.col("user_id").cast("int").alias("year"), F.lit("list").alias("source"), F.lit(None).cast("string").alias("director"), F.lit(None).cast("int").alias("runtime_min"))
    detail = reports.review_json(F.col("event_type"), F.array(*map(one, "abcd")), asked)
    back = reports.read_review(F.concat(detail, F.lit(" [seen]")))
    return e.select("event_id", back.alias("b")).select("event_id", "b.reason", F.col("b.query.year").cast("long").alias("year"), F.size("b.candidates").cast("long").alias("n_candidates"))


@query("SELECT p_partkey AS film_id, round(least(p_retailprice, p_retailprice + 1, p_size + 0.99), 2) AS low, round(least(p_retailprice, p_retailprice + 1, p_size + 0.99) + 1, 2) AS target FROM part WHERE p_partkey > 0")
def price_targets(spark: SparkSession, d: str) -> DataFrame:
    price = lambda c: c.cast("decimal(10,2)").cast("string")
    history = F.concat(F.lit("2001-01-01:+"), price(F.col("p_retailprice")), F.lit("~2001-02-01:-"), price(F.col("p_retailprice") + 1), F.lit("~bad~2001-03-01:+"), price(F.col("p_size") + F.lit(0.99)))
    rows = A.table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("film_id"), X.lowest_price(history).alias("low"))
    return rows.select("film_id", F.col("low").cast("double").alias("low"), X.target_price(F.col("low")).cast("double").alias("target"))


@query("WITH n AS (SELECT o_custkey AS session_id, CAST(o_orderkey % 5 + 1 AS INT) AS tier, count(*) AS n FROM orders GROUP BY ALL) SELECT session_id, tier, n, round(n / sum(n) OVER (PARTITION BY session_id), 6) AS share FROM n")
def tier_tally(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("tier"))
    return reports.tier_tally(rows).withColumn("share", F.round("share", 6))


@query("WITH d AS (SELECT DISTINCT l_partkey, l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber % 2 = 1) SELECT l_partkey AS film_id, string_agg(s_name, ', ' ORDER BY l_linenumber, s_name) AS director FROM d GROUP BY l_partkey")
def directors(spark: SparkSession, d: str) -> DataFrame:
    from lumidex.plans.searching import search_tables

    t = search_tables(spark, d)
    return reports.directors(t["credits"], t["persons"])
