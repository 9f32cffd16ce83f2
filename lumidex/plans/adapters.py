"""The catalogue's tables seen in the star-schema tables that queries run on, as DataFrames and as the same SQL.

film: part; service: supplier; listing: the first and last shipment of a part by a
supplier; list: a part type and thousand, its parts ranked by price; viewing: an order of a customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TODAY = "2001-10-31"
#: Rows of a partition, where as many partitions are made as a table needs.
ROWS_A_PART = 500_000


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Into how many partitions a table goes, by its rows, which its files' footers tell: a task's share stays the same as it grows."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // ROWS_A_PART))


def films(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("film_id"), F.col("p_name").alias("title"), (F.lit(1950) + F.col("p_size")).cast("int").alias("year"), F.col("p_brand").alias("director"),
        F.lit("movie").alias("kind"), F.col("p_type").alias("genre"),
        F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 101).cast("int")).alias("metacritic"),
        F.when(F.col("p_partkey") % 4 != 0, (F.col("p_partkey") * 7 % 101).cast("int")).alias("rt"),
        F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") * 3 % 100) / 10.0).alias("imdb"),
    )


FILMS_SQL = """films AS (SELECT p_partkey AS film_id, p_name AS title, CAST(1950 + p_size AS INT) AS year, p_brand AS director, p_type AS genre,
  CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 101 AS INT) END AS metacritic,
  CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey * 7 % 101 AS INT) END AS rt,
  CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey * 3 % 100) / 10.0 END AS imdb FROM part)"""


def services(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.when(key == 1, "criterion").otherwise(F.concat(F.lit("s"), key.cast("string"))).alias("slug"), F.col("s_name").alias("name"),
        F.when(key % 4 == 0, "store").otherwise("svod").alias("kind"), (F.col("s_acctbal") > 5000).alias("subscribed"),
        (key % 3).cast("int").alias("quality"), (F.col("s_nationkey") % 2 == 0).alias("has_apple_app"),
    )


SERVICES_SQL = """services AS (SELECT CASE WHEN s_suppkey = 1 THEN 'criterion' ELSE 's' || s_suppkey END AS slug, s_name AS name,
  CASE WHEN s_suppkey % 4 = 0 THEN 'store' ELSE 'svod' END AS kind, s_acctbal > 5000 AS subscribed, CAST(s_suppkey % 3 AS INT) AS quality, s_nationkey % 2 = 0 AS has_apple_app FROM supplier)"""


def listings(spark: SparkSession, d: str) -> DataFrame:
    """A listing is current if it was seen within its source's last 400 days: last_seen is cut to whole such spans.

    Nearly every shipment is a listing of its own, so shipments are dealt out by their keys and not summed up before.
    """
    shipped = table(spark, d, "lineitem").select(F.col("l_partkey").alias("film_id"), F.col("l_suppkey").alias("supp"), F.to_date("l_shipdate").alias("day"))
    seen = shipped.repartition(parts(spark, d, "lineitem"), "film_id", "supp").groupBy("film_id", "supp").agg(F.min("day").alias("first_seen"), F.max("day").alias("last"))
    walk = F.date_add(F.lit("1994-12-31").cast("date"), (F.floor(F.datediff("last", F.lit("1994-12-31").cast("date")) / 800) * 800).cast("int"))
    return seen.select(
        "film_id", F.when(F.col("supp") == 1, "criterion").otherwise(F.concat(F.lit("s"), F.col("supp").cast("string"))).alias("source"),
        F.concat(F.lit("https://w.example/"), F.col("film_id").cast("string"), F.lit("/"), F.col("supp").cast("string")).alias("url"),
        "first_seen", walk.alias("last_seen"), F.when((F.col("film_id") % 9 == 0) & (F.col("supp") == 1), "October 31").alias("leaving_date"),
    )


LISTINGS_SQL = """listings AS (SELECT l_partkey AS film_id, CASE WHEN l_suppkey = 1 THEN 'criterion' ELSE 's' || l_suppkey END AS source,
  'https://w.example/' || l_partkey || '/' || l_suppkey AS url, CAST(min(l_shipdate) AS DATE) AS first_seen,
  DATE '1994-12-31' + CAST(floor(date_diff('day', DATE '1994-12-31', CAST(max(l_shipdate) AS DATE)) / 800.0) * 800 AS INT) AS last_seen,
  CASE WHEN l_partkey % 9 = 0 AND l_suppkey = 1 THEN 'October 31' END AS leaving_date FROM lineitem GROUP BY l_partkey, l_suppkey)"""

CURRENT_SQL = "flagged AS (SELECT l.*, l.last_seen >= max(l.last_seen) OVER (PARTITION BY l.source) AS is_current FROM listings l)"


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """A shipment is an arrival."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("film_id"), F.when(F.col("l_suppkey") == 1, "criterion").otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("source"), F.to_date("l_shipdate").alias("appeared_on"))


TRANSITIONS_SQL = "transitions AS (SELECT l_partkey AS film_id, CASE WHEN l_suppkey = 1 THEN 'criterion' ELSE 's' || l_suppkey END AS source, CAST(l_shipdate AS DATE) AS appeared_on FROM lineitem)"


def _slug() -> Column:
    return F.concat("p_type", F.lit("-"), F.floor(F.col("p_partkey") / 1000).cast("string"))


def lists(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("slug")
    return table(spark, d, "part").select(_slug().alias("slug")).distinct().select("slug", F.col("slug").alias("name"), (size % 2 == 0).alias("ordered"), (size % 4 + 1).cast("int").alias("trust"))


LISTS_SQL = "lists AS (SELECT slug, slug AS name, length(slug) % 2 = 0 AS ordered, CAST(length(slug) % 4 + 1 AS INT) AS trust FROM (SELECT DISTINCT p_type || '-' || (p_partkey // 1000) AS slug FROM part))"


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Half the parts of a type, by thousands, the dearest first; a third of the lines are not linked."""
    rank = F.row_number().over(Window.partitionBy("list_slug").orderBy(F.desc("p_retailprice"), "p_partkey"))
    ranked = table(spark, d, "part").where("p_partkey % 2 = 0").select(_slug().alias("list_slug"), "p_retailprice", "p_partkey", F.col("p_name").alias("title_listed")).withColumn("rank", rank)
    return ranked.select("list_slug", "rank", F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("film_id"), F.when(F.col("rank") % 5 == 0, F.concat(F.lit("="), (F.col("rank") - 1).cast("string"))).alias("rank_label"), "title_listed")


ENTRIES_SQL = """keyed AS (SELECT p_type || '-' || (p_partkey // 1000) AS list_slug, p_retailprice, p_partkey FROM part WHERE p_partkey % 2 = 0),
ranked AS (SELECT list_slug, row_number() OVER (PARTITION BY list_slug ORDER BY p_retailprice DESC, p_partkey) AS rank, p_partkey FROM keyed),
entries AS (SELECT list_slug, rank, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS film_id, CASE WHEN rank % 5 = 0 THEN '=' || (rank - 1) END AS rank_label FROM ranked)"""


def every(spark: SparkSession, d: str, step: int, *columns) -> DataFrame:
    """Film ids divisible by step, with columns."""
    return table(spark, d, "part").where(F.col("p_partkey") % step == 0).select(F.col("p_partkey").alias("film_id"), *columns)


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return every(spark, d, 4, (F.col("p_partkey") % 11).cast("int").alias("score"))


def viewings(spark: SparkSession, d: str) -> DataFrame:
    """An order is a viewing of the part with the customer's number."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("film_id"), F.to_date("o_orderdate").alias("watched_on"), (F.col("o_orderpriority") == "1-URGENT").alias("study"), F.col("o_orderstatus").alias("service"))


VIEWINGS_SQL = "viewings AS (SELECT o_orderkey AS id, o_custkey AS film_id, CAST(o_orderdate AS DATE) AS watched_on, o_orderpriority = '1-URGENT' AS study, o_orderstatus AS service FROM orders)"


def view(spark: SparkSession, d: str) -> DataFrame:
    from lumidex.operators.views import film_view

    return film_view(
        films(spark, d), listings(spark, d), services(spark, d), ratings=ratings(spark, d), owned=every(spark, d, 7), watchlist=every(spark, d, 13), entries=entries(spark, d), lists=lists(spark, d),
        transitions=transitions(spark, d), viewings=viewings(spark, d), store_ids=every(spark, d, 5, F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("value")), wishlist=every(spark, d, 17),
        dispositions=every(spark, d, 101), today=TODAY,
    )


VIEW_SQL = f"""{FILMS_SQL}, {SERVICES_SQL}, {LISTINGS_SQL}, {CURRENT_SQL}, {TRANSITIONS_SQL}, {LISTS_SQL}, {ENTRIES_SQL}, {VIEWINGS_SQL},
sized AS (SELECT e.*, count(*) OVER (PARTITION BY list_slug) AS size FROM entries e),
canon AS (SELECT film_id, count(*) AS n_lists, sum(CASE WHEN l.ordered THEN l.trust * (1.0 - (coalesce(try_cast(nullif(regexp_extract(coalesce(rank_label, ''), '^=?([0-9]+)$', 1), '') AS BIGINT), rank) - 1) / CAST(size AS DOUBLE)) ELSE CAST(l.trust AS DOUBLE) END) AS canon_score
  FROM sized JOIN lists l ON l.slug = list_slug WHERE film_id IS NOT NULL GROUP BY film_id),
opts AS (SELECT f.film_id, s.slug, s.kind, s.subscribed FROM flagged f JOIN services s ON s.slug = f.source WHERE f.is_current AND s.slug <> 'criterion'),
stream AS (SELECT film_id, bool_or(is_current) AS on_stream, max(leaving_date) AS leaving_date FROM flagged WHERE source = 'criterion' GROUP BY film_id),
serv AS (SELECT film_id, count(*) AS n_services, bool_or(kind = 'svod' AND subscribed) AS mine FROM opts GROUP BY film_id),
fresh AS (SELECT film_id, bool_or(source = 'criterion') AS new_stream, count(DISTINCT source) AS n_new FROM transitions WHERE appeared_on >= DATE '{TODAY}' - 30 GROUP BY film_id),
seen AS (SELECT film_id, max(watched_on) AS last_viewing, count(*) AS viewing_count, bool_or(study) AS study FROM viewings GROUP BY film_id),
view AS (SELECT f.*, coalesce(st.on_stream, false) AS on_stream, st.leaving_date, coalesce(sv.n_services, 0) AS n_services, coalesce(sv.mine, false) AS svc_mine, coalesce(fr.new_stream, false) AS new_stream, coalesce(fr.n_new, 0) AS n_new,
  c.canon_score, coalesce(c.n_lists, 0) AS n_lists, se.last_viewing, coalesce(se.viewing_count, 0) AS viewing_count, coalesce(se.study, false) AS study,
  CASE WHEN f.film_id % 4 = 0 THEN CAST(f.film_id % 11 AS INT) END AS my_rating, f.film_id % 7 = 0 AS owned, f.film_id % 13 = 0 AS watchlisted, f.film_id % 17 = 0 AS wishlisted,
  CASE WHEN f.film_id % 5 = 0 THEN 'i' || f.film_id END AS store_id
  FROM films f LEFT JOIN stream st USING (film_id) LEFT JOIN serv sv USING (film_id) LEFT JOIN fresh fr USING (film_id) LEFT JOIN canon c USING (film_id) LEFT JOIN seen se USING (film_id) WHERE f.film_id % 101 <> 0)"""
