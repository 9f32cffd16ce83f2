"""Queries of currency, arrivals, worklists and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.operators import currency, worklists, writes
from lumidex.plans import adapters as A
from lumidex.streaming import sync

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {A.LISTINGS_SQL}, {A.CURRENT_SQL} SELECT film_id, source, first_seen, last_seen FROM flagged WHERE NOT is_current")
def currency_departed(spark: SparkSession, d: str) -> DataFrame:
    return currency.departed(A.listings(spark, d)).select("film_id", "source", "first_seen", "last_seen")


@query(f"WITH {A.LISTINGS_SQL}, {A.CURRENT_SQL} SELECT source, count(*) FILTER (WHERE is_current) AS n_current, count(*) AS n FROM flagged GROUP BY source")
def currency_by_source(spark: SparkSession, d: str) -> DataFrame:
    return currency.with_currency(A.listings(spark, d)).groupBy("source").agg(F.count_if("is_current").alias("n_current"), F.count("*").alias("n"))


@query(f"WITH {A.TRANSITIONS_SQL}, {A.SERVICES_SQL} SELECT film_id, source, max(appeared_on) AS appeared_on FROM transitions JOIN services ON slug = source WHERE subscribed AND kind = 'svod' AND appeared_on >= DATE '{A.TODAY}' - 30 GROUP BY film_id, source")
def arrivals_30d(spark: SparkSession, d: str) -> DataFrame:
    return currency.new_on(A.transitions(spark, d), A.services(spark, d), A.TODAY)


@query("WITH e AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events) SELECT * FROM e WHERE ts > before + INTERVAL 7 DAY")
def reappearance_transitions(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select("user_id", "event_type", "ts")
    return currency.reappearances(e, ["user_id", "event_type"], "ts", "7 DAYS")


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """A day's reading: the listings of every third film, and what was never listed."""
    seen = A.listings(spark, d).where("film_id % 3 = 0").select("film_id", "source", F.concat("url", F.lit("?new")).alias("url"))
    extra = A.every(spark, d, 50, F.lit("s3").alias("source"), F.lit("new").alias("url")).join(seen.where("source = 's3'").select("film_id"), "film_id", "left_anti")
    return seen.unionByName(extra.select("film_id", "source", "url")).withColumn("seen", F.lit(A.TODAY).cast("date"))


_BATCH = f"""seen AS (SELECT film_id, source, url || '?new' AS url FROM listings WHERE film_id % 3 = 0),
batch AS (SELECT * FROM seen UNION ALL SELECT p_partkey, 's3', 'new' FROM part WHERE p_partkey % 50 = 0 AND p_partkey NOT IN (SELECT film_id FROM seen WHERE source = 's3'))"""


@query(f"WITH {A.LISTINGS_SQL}, {_BATCH}, f AS (SELECT source, max(last_seen) AS frontier FROM listings GROUP BY source) SELECT b.film_id, b.source, DATE '{A.TODAY}' AS appeared_on FROM batch b LEFT JOIN listings l ON l.film_id = b.film_id AND l.source = b.source LEFT JOIN f ON f.source = b.source WHERE l.film_id IS NULL OR l.last_seen < f.frontier")
def batch_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return currency.arrivals(_batch(spark, d), A.listings(spark, d))


@query(f"WITH {A.LISTINGS_SQL}, {_BATCH} SELECT coalesce(l.film_id, b.film_id) AS film_id, coalesce(l.source, b.source) AS source, coalesce(b.url, l.url) AS url, CASE WHEN b.film_id IS NULL THEN l.first_seen ELSE least(coalesce(l.first_seen, DATE '{A.TODAY}'), DATE '{A.TODAY}') END AS first_seen, CASE WHEN b.film_id IS NULL THEN l.last_seen ELSE DATE '{A.TODAY}' END AS last_seen FROM listings l FULL JOIN batch b ON l.film_id = b.film_id AND l.source = b.source")
def batch_listings(spark: SparkSession, d: str) -> DataFrame:
    return currency.seen_again(A.listings(spark, d), _batch(spark, d), A.parts(spark, d, "lineitem"))


@query(f"WITH {A.LISTINGS_SQL}, {A.CURRENT_SQL} SELECT film_id, source, CASE WHEN is_current AND film_id % 5 = 0 THEN DATE '{A.TODAY}' ELSE last_seen END AS last_seen FROM flagged")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return currency.carried_forward(A.listings(spark, d), A.every(spark, d, 5), A.TODAY).select("film_id", "source", "last_seen")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def worklist_missing(spark: SparkSession, d: str) -> DataFrame:
    return worklists.missing(A.table(spark, d, "documents").select("doc_id", "source"), A.table(spark, d, "labels"), "doc_id")


@query("SELECT w.doc_id, w.n_chars FROM documents w LEFT JOIN labels l ON l.doc_id = w.doc_id WHERE l.doc_id IS NULL OR l.quality * 1000 < w.n_chars")
def worklist_stale(spark: SparkSession, d: str) -> DataFrame:
    done = A.table(spark, d, "labels").select("doc_id", (F.col("quality") * 1000).cast("long").alias("made"))
    return worklists.stale(A.table(spark, d, "documents").select("doc_id", "n_chars"), done, "doc_id", "n_chars", "made")


@query("WITH c AS (SELECT p_partkey AS film_id FROM part), o AS (SELECT p_partkey AS film_id, p_partkey % 4 <> 0 AS found, p_partkey % 10 = 0 AS needs_refresh, p_partkey % 6 = 0 AS year_fallback, DATE '2001-10-31' - CAST(p_partkey % 60 AS INT) AS looked_up FROM part WHERE p_partkey % 3 <> 0) SELECT c.film_id FROM c LEFT JOIN o USING (film_id) WHERE o.found IS NULL OR needs_refresh OR (NOT found AND (NOT year_fallback OR looked_up <= DATE '2001-10-31' - 30))")
def worklist_lookups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    omdb = A.table(spark, d, "part").where(k % 3 != 0).select(k.alias("film_id"), (k % 4 != 0).alias("found"), (k % 10 == 0).alias("needs_refresh"), (k % 6 == 0).alias("year_fallback"), F.date_sub(F.lit(A.TODAY).cast("date"), (k % 60).cast("int")).alias("looked_up"))
    return worklists.needing_lookup(A.films(spark, d).select("film_id"), omdb, A.TODAY)


def _ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    one = lambda step, name: A.table(spark, d, "part").where(k % step == 0).select(k.alias("film_id"), F.lit(name).alias("authority"), F.concat(F.lit(name[:2]), (k % 500).cast("string")).alias("value"))
    return one(2, "imdb").unionByName(one(3, "itunes")).unionByName(one(5, "tmdb"))


_IDS = "ids AS (" + " UNION ALL ".join(f"SELECT p_partkey AS film_id, '{n}' AS authority, '{n[:2]}' || (p_partkey % 500) AS value FROM part WHERE p_partkey % {s} = 0" for s, n in ((2, "imdb"), (3, "itunes"), (5, "tmdb"))) + ")"


@query(f"WITH {_IDS} SELECT film_id, min(value) AS value FROM ids i WHERE authority = 'imdb' AND NOT EXISTS (SELECT 1 FROM ids x WHERE x.film_id = i.film_id AND x.authority = 'itunes') AND film_id % 8 <> 0 GROUP BY film_id")
def worklist_store_ids(spark: SparkSession, d: str) -> DataFrame:
    return worklists.needing_store_id(A.films(spark, d), _ids(spark, d), A.every(spark, d, 8)).select("film_id", "value")


@query(f"WITH {_IDS}, p AS (SELECT film_id, min(value) FILTER (WHERE authority = 'tmdb') AS tmdb_id, min(value) FILTER (WHERE authority = 'itunes') AS itunes_id FROM ids GROUP BY film_id), t AS (SELECT * FROM p WHERE film_id % 4 = 0) SELECT p.* FROM p LEFT JOIN t ON t.film_id = p.film_id WHERE (p.tmdb_id IS NOT NULL OR p.itunes_id IS NOT NULL) AND t.film_id IS NULL")
def worklist_trailers(spark: SparkSession, d: str) -> DataFrame:
    ids = _ids(spark, d)
    have = ids.where("film_id % 4 = 0").groupBy("film_id").agg(F.min(F.when(F.col("authority") == "tmdb", F.col("value"))).alias("tmdb_id"), F.min(F.when(F.col("authority") == "itunes", F.col("value"))).alias("itunes_id"))
    return worklists.wanted_trailers(A.films(spark, d), ids, have)


@query("SELECT c_custkey AS film_id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey) ON o_custkey = c_custkey ORDER BY m NULLS FIRST, c_custkey LIMIT 200")
def worklist_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The 200 titles to refresh first: the limit is the batch's size, and each partition sends that many."""
    checks = A.table(spark, d, "orders").where("o_custkey % 10 <> 0").groupBy(F.col("o_custkey").alias("film_id")).agg(F.max("o_orderdate").alias("providers_checked_at"))
    return worklists.refresh_order(A.table(spark, d, "customer").select(F.col("c_custkey").alias("film_id")), checks).limit(200).select("film_id")


@query("SELECT coalesce(b.o_custkey, a.c_custkey) AS film_id, coalesce(b.status, a.c_mktsegment) AS segment, a.c_acctbal AS balance FROM customer a FULL JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey) b ON b.o_custkey = a.c_custkey")
def upsert_keep_old(spark: SparkSession, d: str) -> DataFrame:
    old = A.table(spark, d, "customer").select(F.col("c_custkey").alias("film_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    new = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("film_id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("segment")).withColumn("balance", F.lit(None).cast("double"))
    return writes.upsert(old, new, ["film_id"], prefer_new_if_known=("balance",))


@query("WITH f AS (SELECT p_name AS title, CASE WHEN p_partkey % 4 <> 0 THEN CAST(1950 + p_size % 2 AS INT) END AS year, p_partkey % 2 = 0 AS here, p_partkey FROM part), b AS (SELECT * FROM f WHERE here), t AS (SELECT lower(trim(title)) AS twin, count(DISTINCT year) AS n, min(year) AS y, bool_or(here) AS h FROM f WHERE year IS NOT NULL GROUP BY 1 HAVING count(DISTINCT year) = 1) SELECT p_partkey, title, coalesce(year, y) AS year FROM b LEFT JOIN t ON twin = lower(trim(title)) AND year IS NULL WHERE twin IS NULL OR NOT h")
def fold_yearless(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 4 != 0, (1950 + F.col("p_size") % 2).cast("int")).alias("year"))
    return writes.fold_yearless(rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 = 1"))


@query(f"WITH {_IDS}, n AS (SELECT p_partkey AS film_id, 'imdb' AS authority, 'im' || (p_partkey % 500) AS value FROM part WHERE p_partkey % 7 = 0) SELECT DISTINCT n.film_id, n.value FROM n JOIN ids ON ids.authority = n.authority AND ids.value = n.value AND ids.film_id <> n.film_id")
def refused_ids(spark: SparkSession, d: str) -> DataFrame:
    new = A.every(spark, d, 7, F.lit("imdb").alias("authority"), F.concat(F.lit("im"), (F.col("p_partkey") % 500).cast("string")).alias("value"))
    return writes.set_ids(_ids(spark, d), new)[1].select("film_id", "value")


@query("SELECT date_trunc('hour', ts) AS from_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_activity(spark: SparkSession, d: str) -> DataFrame:
    return sync.activity(A.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS from_ts, max(ts) + INTERVAL 6 HOUR AS to_ts, count(*) AS n FROM s GROUP BY user_id, g")
def activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sync.sessions(A.table(spark, d, "events").select("user_id", "ts"), "6 hours")
