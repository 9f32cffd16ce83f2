"""Queries of the read model: best source, view, chips, orders, lists, canon, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.functions import expressions as X
from lumidex.operators import audit, ranker, views, writes
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


_RANKED = f"""WITH {A.SERVICES_SQL}, {A.LISTINGS_SQL}, {A.CURRENT_SQL},
o AS (SELECT f.film_id, s.slug, s.name, s.subscribed, s.quality, row_number() OVER (PARTITION BY f.film_id ORDER BY CASE WHEN s.subscribed THEN 0 ELSE 1 END, s.quality DESC, CASE WHEN s.has_apple_app THEN 0 ELSE 1 END, s.name) AS n
  FROM flagged f JOIN services s ON s.slug = f.source WHERE f.is_current AND s.kind = 'svod')"""


@query(_RANKED + " SELECT film_id, slug, name, subscribed, quality FROM o WHERE n = 1")
def best_source(spark: SparkSession, d: str) -> DataFrame:
    return views.best_source(A.listings(spark, d), A.services(spark, d))


@query(_RANKED + " SELECT film_id, slug, name, subscribed, quality FROM o WHERE n = 1 AND film_id % 7 <> 0 UNION ALL SELECT p_partkey, slug, name, subscribed, quality FROM part, services WHERE p_partkey % 7 = 0 AND slug = 's4'")
def best_source_owned(spark: SparkSession, d: str) -> DataFrame:
    return views.best_source(A.listings(spark, d), A.services(spark, d), A.every(spark, d, 7), "s4")


@query(f"WITH {A.SERVICES_SQL}, {A.LISTINGS_SQL}, {A.CURRENT_SQL} SELECT film_id, string_agg(s.slug, ',' ORDER BY CASE WHEN s.subscribed THEN 0 ELSE 1 END, s.quality DESC, CASE WHEN s.has_apple_app THEN 0 ELSE 1 END, s.name) AS slugs, count(*) AS n FROM flagged f JOIN services s ON s.slug = f.source WHERE is_current AND s.slug <> 'criterion' GROUP BY film_id")
def services_by_film(spark: SparkSession, d: str) -> DataFrame:
    found = views.services_by_film(A.listings(spark, d), A.services(spark, d))
    return found.select("film_id", F.array_join(F.transform("services", lambda s: s["slug"]), ",").alias("slugs"), F.size("services").cast("long").alias("n"))


@query(f"WITH {A.VIEW_SQL} SELECT film_id, title, year, on_stream, leaving_date, n_services, n_new, round(canon_score, 6) AS canon_score, n_lists, last_viewing, viewing_count, study, my_rating, owned, watchlisted, wishlisted, store_id FROM view")
def film_view(spark: SparkSession, d: str) -> DataFrame:
    v = A.view(spark, d)
    return v.select(
        "film_id", "title", "year", "on_stream", "leaving_date", F.size("services").cast("long").alias("n_services"), F.size("new_on").cast("long").alias("n_new"), F.round("canon_score", 6).alias("canon_score"),
        "n_lists", "last_viewing", "viewing_count", "study", "my_rating", "owned", "watchlisted", "wishlisted", "store_id",
    )


_REACH = "(on_stream OR n_services > 0 OR owned OR store_id IS NOT NULL)"
_SHOP = "(NOT owned AND my_rating IS NULL AND NOT on_stream AND NOT svc_mine AND store_id IS NOT NULL AND NOT wishlisted)"
_CHIPS = {
    "reachable": _REACH, "unreachable": f"NOT {_REACH}", "unrated": "my_rating IS NULL", "mine": "my_rating >= 1", "criterion": "on_stream", "leaving": "leaving_date IS NOT NULL", "criterion_new": "new_stream",
    "not_criterion": "NOT on_stream", "watchlist": "watchlisted", "owned": "owned", "not_owned": "NOT owned", "multi_list": "n_lists >= 1", "shop": _SHOP, "watched": "viewing_count > 0", "study": "study",
}


@query(f"WITH {A.VIEW_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS chip, count(*) FILTER (WHERE {v}) AS n FROM view" for k, v in _CHIPS.items()))
def chip_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.chip_counts(A.view(spark, d), A.TODAY)


@query(f"WITH {A.VIEW_SQL} SELECT film_id, title FROM view WHERE {_REACH} AND my_rating IS NULL AND n_lists >= 1")
def chips_reachable(spark: SparkSession, d: str) -> DataFrame:
    return views.matching(A.view(spark, d), ["reachable", "unrated", "multi_list"], A.TODAY).select("film_id", "title")


@query(f"WITH {A.VIEW_SQL} SELECT film_id, title FROM view WHERE {_SHOP}")
def chips_shop(spark: SparkSession, d: str) -> DataFrame:
    return views.matching(A.view(spark, d), ["shop"], A.TODAY).select("film_id", "title")


@query(f"WITH {A.VIEW_SQL}, o AS (SELECT film_id, title, row_number() OVER (ORDER BY round(canon_score, 9) DESC NULLS LAST, last_viewing DESC NULLS LAST, metacritic DESC NULLS LAST, rt DESC NULLS LAST, imdb DESC NULLS LAST, lower(title) NULLS LAST, film_id) AS place FROM view) SELECT * FROM o WHERE place <= 50")
def default_sort_topk(spark: SparkSession, d: str) -> DataFrame:
    v = A.view(spark, d).withColumn("canon_score", F.round("canon_score", 9))
    return views.top_k(v, views.default_order(), 50).select("film_id", "title", F.col("place").cast("long").alias("place"))


@query(f"WITH {A.LISTS_SQL}, {A.ENTRIES_SQL}, sized AS (SELECT e.*, count(*) OVER (PARTITION BY list_slug) AS size FROM entries e) SELECT film_id, count(*) AS n_lists, round(sum(CASE WHEN l.ordered THEN l.trust * (1.0 - (coalesce(try_cast(nullif(regexp_extract(coalesce(rank_label, ''), '^=?([0-9]+)$', 1), '') AS BIGINT), rank) - 1) / CAST(size AS DOUBLE)) ELSE CAST(l.trust AS DOUBLE) END), 6) AS canon_score FROM sized JOIN lists l ON l.slug = list_slug WHERE film_id IS NOT NULL GROUP BY film_id")
def canon_score(spark: SparkSession, d: str) -> DataFrame:
    return views.canon_scores(A.entries(spark, d), A.lists(spark, d)).select("film_id", "n_lists", F.round("canon_score", 6).alias("canon_score"))


@query(f"WITH {A.LISTS_SQL}, {A.ENTRIES_SQL} SELECT film_id, string_agg(l.slug || ':' || rank, ',' ORDER BY l.trust DESC, l.name, rank) AS lists FROM entries JOIN lists l ON l.slug = list_slug WHERE film_id IS NOT NULL GROUP BY film_id")
def lists_by_film(spark: SparkSession, d: str) -> DataFrame:
    found = views.lists_by_film(A.entries(spark, d), A.lists(spark, d))
    return found.select("film_id", F.array_join(F.transform("lists", lambda x: F.concat(x["list_slug"], F.lit(":"), x["rank"].cast("string"))), ",").alias("lists"))


@query(f"WITH {A.VIEWINGS_SQL} SELECT film_id, max(watched_on) AS last_viewing, count(*) AS viewing_count, bool_or(study) AS study FROM viewings GROUP BY film_id")
def viewing_stats(spark: SparkSession, d: str) -> DataFrame:
    return views.viewing_stats(A.viewings(spark, d))


@query("SELECT o_custkey AS film_id, arg_max(CAST(o_orderkey % 5 + 1 AS INT), (o_orderdate, o_orderkey)) AS stars, CAST(max(o_orderdate) AS DATE) AS rented_on FROM orders GROUP BY o_custkey")
def latest_rating(spark: SparkSession, d: str) -> DataFrame:
    old = A.table(spark, d, "orders").select(F.col("o_custkey").alias("film_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("stars"), F.to_date("o_orderdate").alias("rented_on"), F.col("o_orderkey").alias("line"))
    return views.latest_rating(old).select("film_id", "old_rating.*")


@query("SELECT l_partkey AS film_id, min(l_shipdate) AS first_seen, arg_min(l_suppkey, (l_shipdate, l_suppkey, l_orderkey, l_linenumber)) AS supplier FROM lineitem GROUP BY l_partkey")
def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    seen = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("film_id"), F.col("l_shipdate").alias("first_seen"), F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber")
    return views.first_per_group(seen, ["film_id"], ["first_seen", "supplier", "l_orderkey", "l_linenumber"]).select("film_id", "first_seen", "supplier")


_PLACED = "placed AS (SELECT p_partkey // 100 AS session_id, CAST(p_size % 5 + 1 AS INT) AS tier, p_partkey AS film_id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS INT) END AS position FROM part)"


@query(f"WITH {_PLACED}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tier, position NULLS LAST, lower(title), film_id) AS line FROM placed) SELECT session_id, line, tier, film_id, title, CASE WHEN position IS NULL AND count(*) FILTER (WHERE position IS NULL) OVER (PARTITION BY session_id, tier) > 1 THEN '=' || min(CASE WHEN position IS NULL THEN line END) OVER (PARTITION BY session_id, tier) END AS rank_label FROM n")
def tie_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    placed = A.table(spark, d, "part").select(F.floor(k / 100).alias("session_id"), (F.col("p_size") % 5 + 1).cast("int").alias("tier"), k.alias("film_id"), F.col("p_name").alias("title"), F.when(k % 3 == 0, k.cast("int")).alias("position"))
    return views.tie_labels(placed)


#: The checksum that shuffles a session, as SQL: a table of 256 values from its polynomial, folded over a text's bytes.
_CRC = """crc AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(n))),
keyed AS (SELECT p_partkey AS film_id, '20010819:' || p_partkey AS s, CASE WHEN p_partkey % 10 = 0 THEN DATE '2001-01-01' + CAST(p_partkey % 30 AS INT) END AS day FROM part WHERE p_partkey % 101 <> 0),
q AS (SELECT film_id, day, list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) AS c FROM keyed, crc)"""


@query(f"WITH {_CRC} SELECT film_id, row_number() OVER (ORDER BY day NULLS FIRST, CASE WHEN day IS NULL THEN xor(c, 4294967295) END, film_id) AS place FROM q")
def seeded_queue(spark: SparkSession, d: str) -> DataFrame:
    deferred = A.every(spark, d, 10, F.date_add(F.lit("2001-01-01").cast("date"), (F.col("p_partkey") % 30).cast("int")).alias("deferred_on"))
    return ranker.queue(A.films(spark, d), 20010819, deferred, A.every(spark, d, 101))


@query("WITH s AS (SELECT p_partkey AS film_id, p_name AS title, CAST(p_partkey % 11 AS INT) AS score, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey * 3 % 100) / 10.0 END AS imdb FROM part), t AS (SELECT *, greatest(1, 11 - score) AS tier FROM s WHERE score >= 6) SELECT tier, arg_min(film_id, (abs(score - CASE tier WHEN 1 THEN 10 WHEN 2 THEN 9 WHEN 3 THEN 8 WHEN 4 THEN 7 ELSE 5 END), -coalesce(imdb, -1.0), title, film_id)) AS film_id FROM t GROUP BY tier")
def rank_anchors(spark: SparkSession, d: str) -> DataFrame:
    return ranker.anchors(A.films(spark, d).withColumn("score", (F.col("film_id") % 11).cast("int")).select("film_id", "title", "score", "imdb"))


@query("SELECT session_id, tier, film_id, CAST(greatest(floor_at, 0) AS INT) AS low, CAST(least(cap_at, 20) AS INT) AS high FROM (SELECT CAST(1 AS BIGINT) AS session_id, CAST(user_id % 5 + 1 AS INT) AS tier, user_id AS film_id, coalesce(max(CASE WHEN value < 40 THEN CAST(floor(value / 8) AS INT) END) + 1, 0) AS floor_at, coalesce(min(CASE WHEN value >= 60 THEN least(CAST(floor(value / 8) AS INT), 19) END), 20) AS cap_at FROM (SELECT user_id, floor(value) AS value FROM events WHERE value < 40 OR value >= 60) GROUP BY user_id) ")
def rank_insertion(spark: SparkSession, d: str) -> DataFrame:
    order = spark.range(5).crossJoin(spark.range(20).withColumnRenamed("id", "at")).select(F.lit(1).cast("long").alias("session_id"), (F.col("id") + 1).cast("int").alias("tier"), F.col("at").alias("film_id"), (F.col("at") + 1).cast("int").alias("position"))
    v = F.floor("value")
    log = A.table(spark, d, "events").where((v < 40) | (v >= 60)).select(
        F.lit(1).cast("long").alias("session_id"), (F.col("user_id") % 5 + 1).cast("int").alias("tier"), F.col("user_id").alias("film_id"),
        F.when(v < 40, F.floor(v / 8)).otherwise(F.least(F.floor(v / 8), F.lit(19))).cast("long").alias("other_film_id"), F.when(v < 40, "worse").otherwise("better").alias("verdict"),
    )
    return ranker.insertion_bounds(order, log).select("session_id", "tier", "film_id", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"))


_AUDIT = """t AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount)) AS total, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o_orderkey AS film_id, o_totalprice, o_orderdate, o_orderstatus, t.* FROM orders LEFT JOIN t ON k = o_orderkey),
f AS (SELECT film_id, unnest([CASE WHEN k IS NULL THEN 'empty' END, CASE WHEN first_ship < o_orderdate THEN 'early' END, CASE WHEN abs(o_totalprice - total) > 100000 THEN 'total' END]) AS reason FROM j),
g AS (SELECT film_id, reason, CASE reason WHEN 'total' THEN 3 WHEN 'early' THEN 2 ELSE 1 END AS score FROM f WHERE reason IS NOT NULL)"""


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Orders checked against their lines."""
    lines = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total"), F.min("l_shipdate").alias("first_ship"))
    joined = A.table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("k"), "left")
    nothing = F.lit("")
    checks = {"empty": (F.col("k").isNull(), nothing), "early": (F.col("first_ship") < F.col("o_orderdate"), nothing), "total": (F.abs(F.col("o_totalprice") - F.col("total")) > 100000, nothing)}
    found = joined.select(F.col("o_orderkey").alias("film_id"), F.explode(audit.flag_array(checks, {"total": 3, "early": 2, "empty": 1})).alias("flag"))
    return found.select("film_id", "flag.reason", "flag.score")


@query(f"WITH {_AUDIT} SELECT film_id, reason, CAST(score AS INT) AS score FROM g")
def audit_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


@query(f"WITH {_AUDIT}, w AS (SELECT film_id, CAST(sum(score) AS BIGINT) AS total, count(*) AS n_flags, row_number() OVER (ORDER BY sum(score) DESC, film_id) AS n FROM g GROUP BY film_id) SELECT film_id, total, n_flags FROM w WHERE n <= 20")
def audit_top(spark: SparkSession, d: str) -> DataFrame:
    return audit.worst(_flags(spark, d))


@query(f"WITH {_AUDIT} SELECT reason, count(*) AS n FROM g GROUP BY reason")
def audit_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return audit.by_reason(_flags(spark, d))


@query("SELECT event_id, lower(trim(event_type)) || ' (' || coalesce(CAST(user_id AS VARCHAR), 'None') || ')' AS film_key, trim(regexp_replace(lower(event_type || ' & Co. ' || user_id), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    return e.select("event_id", X.film_key(F.col("event_type"), F.col("user_id")).alias("film_key"), X.service_slug(F.concat(F.col("event_type"), F.lit(" & Co. "), F.col("user_id").cast("string"))).alias("slug"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query(f"WITH {A.VIEW_SQL} SELECT count(*) AS films, count(my_rating) AS rated, count(*) FILTER (WHERE leaving_date IS NOT NULL) AS leaving, count(*) FILTER (WHERE my_rating >= 1) AS mine, count(*) FILTER (WHERE owned) AS owned, count(*) FILTER (WHERE n_services = 0 AND NOT on_stream) AS nowhere FROM view")
def summary(spark: SparkSession, d: str) -> DataFrame:
    v = A.view(spark, d)
    return v.agg(F.count("*").alias("films"), F.count("my_rating").alias("rated"), F.count_if(F.col("leaving_date").isNotNull()).alias("leaving"), F.count_if(F.col("my_rating") >= 1).alias("mine"), F.count_if("owned").alias("owned"), F.count_if((F.size("services") == 0) & ~F.col("on_stream")).alias("nowhere"))


@query("SELECT o_custkey AS list, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position, o_orderkey AS film_id FROM orders")
def watchlist_order(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders").select(F.col("o_custkey").alias("list"), F.col("o_orderkey").alias("film_id"), "o_orderdate")
    return writes.renumbered(rows, ["list"], [F.desc("o_orderdate"), F.col("film_id")]).select("list", F.col("position").cast("long").alias("position"), "film_id")
