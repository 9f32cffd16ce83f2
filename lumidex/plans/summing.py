"""Queries of catalogue writes, summaries, corpora and states of ranking sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.functions import expressions as X
from lumidex.operators import audit, ranker, reports, resolution, summaries, vectors, views, worklists, writes
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


def _text(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _rows(spark: SparkSession, d: str, name: str, key: str) -> tuple[DataFrame, Column]:
    return A.table(spark, d, name), F.col(key)


# writes


@query("""SELECT p_partkey AS film_id, 'part ' || p_partkey || ' (' || CAST(1950 + p_size AS INT) || ')' AS key, 'old' AS made FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT min(p_partkey) + 1000000, 'part ' || p_partkey || ' (' || CAST(1950 + p_size AS INT) || ')', 'new' FROM part WHERE p_partkey % 2 = 1 GROUP BY p_partkey, p_size""")
def film_create(spark: SparkSession, d: str) -> DataFrame:
    """Films whose keys are held stay as they are, others are created once."""
    p, k = _rows(spark, d, "part", "p_partkey")
    row = lambda df, film, made: df.select(film.alias("film_id"), X.film_key(_text(" PART ", k, " "), (F.col("p_size") + 1950).cast("int")).alias("key"), F.lit(made).alias("made"))
    old = row(p.where(k % 2 == 0), k, "old")
    return writes.insert_missing(old, row(p, k + 1000000, "new"), ["key"])


@query("""SELECT authority, value, min(film_id) AS film_id FROM (SELECT event_type AS authority, CAST(user_id % 50 AS VARCHAR) AS value, CAST(-1 AS BIGINT) AS film_id FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_type, CAST(user_id % 50 AS VARCHAR), CAST(7 AS BIGINT) FROM events) GROUP BY ALL""")
def claims_added(spark: SparkSession, d: str) -> DataFrame:
    """A claim counts as it was first made."""
    e, k = _rows(spark, d, "events", "event_id")
    claim = lambda df, film: df.select(F.col("event_type").alias("authority"), (F.col("user_id") % 50).cast("string").alias("value"), F.lit(film).cast("long").alias("film_id")).distinct()
    return writes.insert_missing(claim(e.where(k % 2 == 0), -1), claim(e, 7), ["authority", "value"])


_HELD = "h AS (SELECT p_partkey AS film_id, 'imdb' AS authority, 'tt' || p_partkey AS value FROM part UNION ALL SELECT p_partkey, 'slug', 'a' || p_partkey FROM part WHERE p_partkey % 2 = 0)"


def _held(spark: SparkSession, d: str) -> DataFrame:
    p, k = _rows(spark, d, "part", "p_partkey")
    one = lambda df, name, mark: df.select(k.alias("film_id"), F.lit(name).alias("authority"), _text(mark, k).alias("value"))
    return one(p, "imdb", "tt").unionByName(one(p.where(k % 2 == 0), "slug", "a"))


@query(f"""WITH {_HELD}, n AS (SELECT p_partkey AS film_id, 'imdb' AS authority, CASE WHEN p_partkey % 6 = 0 THEN 'tt' || (p_partkey - 1) ELSE 'new' || p_partkey END AS value FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 1),
ok AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.authority = n.authority AND h.value = n.value AND h.film_id <> n.film_id))
SELECT film_id, authority, value FROM h WHERE NOT (authority = 'imdb' AND film_id IN (SELECT film_id FROM ok)) UNION ALL SELECT * FROM ok""")
def ids_swapped(spark: SparkSession, d: str) -> DataFrame:
    """Titles have one imdb id, which is replaced unless another title holds the new one."""
    p, k = _rows(spark, d, "part", "p_partkey")
    new = p.where((k % 3 == 0) & (k > 1)).select(k.alias("film_id"), F.lit("imdb").alias("authority"), F.when(k % 6 == 0, _text("tt", k - 1)).otherwise(_text("new", k)).alias("value"))
    return writes.set_ids(_held(spark, d), new)[0]


@query(f"WITH {_HELD} SELECT * FROM h WHERE NOT (authority = 'slug' AND film_id % 4 = 0)")
def ids_dropped(spark: SparkSession, d: str) -> DataFrame:
    held = _held(spark, d)
    return writes.replace_where(held, (F.col("authority") == "slug") & (F.col("film_id") % 4 == 0), held.limit(0))


@query("SELECT l_orderkey AS film_id, l_suppkey AS person_id, 'old' AS kind FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_orderkey % 3 = 0")
def credits_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The credits of titles that were fetched again go as a whole."""
    old = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("film_id"), F.col("l_suppkey").alias("person_id"), F.lit("old").alias("kind"))
    new = A.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("film_id"), F.col("o_custkey").alias("person_id"), F.lit("new").alias("kind"))
    return writes.replace_where(old, F.col("film_id") % 3 == 0, new)


@query("SELECT o_custkey AS film_id, CASE WHEN o_custkey % 2 = 0 THEN '2000-01-01' ELSE '2001-10-31' END AS added_on FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def wishlist_mirror(spark: SparkSession, d: str) -> DataFrame:
    """The wishlist becomes what the shop says; titles that were on it keep their day."""
    old = A.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("film_id"), F.lit("2000-01-01").cast("date").alias("added_on"))
    wanted = A.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("film_id"))
    return writes.replace_keeping(old, wanted, "film_id", "added_on", A.TODAY).withColumn("added_on", F.col("added_on").cast("string"))


_ORDER = "o AS (SELECT p_size AS session_id, p_partkey AS film_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INT) AS position FROM part)"


def _order(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "part").select(F.col("p_size").alias("session_id"), F.col("p_partkey").alias("film_id"))
    return writes.renumbered(rows, ["session_id"], [F.col("film_id")])


@query(f"""WITH {_ORDER}, a AS (SELECT session_id, film_id, position * 2.0 AS w FROM o UNION ALL SELECT DISTINCT session_id, 5000000 + session_id, 3.0 FROM o)
SELECT session_id, film_id, row_number() OVER (PARTITION BY session_id ORDER BY w, film_id) AS position FROM a""")
def ordered_insert(spark: SparkSession, d: str) -> DataFrame:
    """A title put into each order at slot 1, which is after the first."""
    order = _order(spark, d)
    new = order.select("session_id", (F.lit(5000000) + F.col("session_id")).cast("long").alias("film_id"), F.lit(1).alias("slot")).distinct()
    return writes.inserted_at(order, new, ["session_id"]).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_ORDER} SELECT session_id, film_id, row_number() OVER (PARTITION BY session_id ORDER BY position) AS position FROM o WHERE film_id % 3 <> 0")
def ordered_remove(spark: SparkSession, d: str) -> DataFrame:
    left = _order(spark, d).where("film_id % 3 <> 0").withColumn("tier", F.lit(1))
    return writes.close_gaps(left).select("session_id", "film_id", F.col("position").cast("long").alias("position"))


@query(f"WITH {_ORDER}, k AS (SELECT session_id, film_id, position FROM o WHERE film_id % 4 <> 0 UNION ALL SELECT p_size, p_partkey + 7000000, 2000000 + p_partkey FROM part WHERE p_partkey % 9 = 0) SELECT session_id, film_id, row_number() OVER (PARTITION BY session_id ORDER BY position, film_id) AS position FROM k")
def watchlist_toggle(spark: SparkSession, d: str) -> DataFrame:
    """Titles that were on the list leave it, others are put at its end."""
    order, (p, k) = _order(spark, d), _rows(spark, d, "part", "p_partkey")
    toggled = order.where("film_id % 4 = 0").select("film_id")
    added = p.where(k % 9 == 0).select(F.col("p_size").alias("session_id"), (k + 7000000).alias("film_id"), (k + 2000000).cast("int").alias("position"))
    both = order.join(toggled, "film_id", "left_anti").select(*order.columns).unionByName(added)
    return writes.renumbered(both, ["session_id"], [F.col("position"), F.col("film_id")]).select("session_id", "film_id", F.col("position").cast("long").alias("position"))


@query("SELECT p_type AS list_slug, p_partkey AS film_id, 'old' AS made FROM part WHERE length(p_type) % 2 = 1 UNION ALL SELECT p_type, p_partkey, 'new' FROM part WHERE length(p_type) % 2 = 0 AND p_partkey % 2 = 0")
def list_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A list that is imported again is replaced line by line; other lists stay."""
    p, k = _rows(spark, d, "part", "p_partkey")
    lines = lambda df, made: df.select(F.col("p_type").alias("list_slug"), k.alias("film_id"), F.lit(made).alias("made"))
    again = F.length("list_slug") % 2 == 0
    return writes.replace_where(lines(p, "old"), again, lines(p.where((F.length("p_type") % 2 == 0) & (k % 2 == 0)), "new"))


@query("SELECT event_id AS id, user_id AS film_id, 'fine' AS verdict, 'early,total' AS reasons FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id + 10000000, user_id, 'wrong', 'a,' || event_type FROM events WHERE event_id % 3 = 0 AND user_id % 5 <> 0 AND event_type <> 'a'")
def verdict_append(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts are only added, with sorted reasons, and none to titles that are gone."""
    e, k = _rows(spark, d, "events", "event_id")
    ledger = e.where(k % 2 == 0).select(k.alias("id"), F.col("user_id").alias("film_id"), F.lit("fine").alias("verdict"), F.lit("early,total").alias("reasons"))
    new = e.where(k % 3 == 0).select((k + 10000000).alias("id"), F.col("user_id").alias("film_id"), F.lit("wrong").alias("verdict"), F.array("event_type", F.lit("a")).alias("reasons"))
    gone = e.where("user_id % 5 = 0").select(F.col("user_id").alias("film_id")).distinct()
    return summaries.verdicts_added(ledger, new, gone)


@query("""WITH f AS (SELECT user_id AS film_id, event_type AS reason, CAST(count(*) AS INT) AS score FROM events GROUP BY ALL), g AS (SELECT film_id, string_agg(reason, ',' ORDER BY reason) AS codes, CAST(sum(score) AS BIGINT) AS score FROM f GROUP BY film_id),
v AS (SELECT c_custkey AS film_id, c_custkey * 2 + n AS id, CASE WHEN (c_custkey + n) % 3 = 0 THEN 'fine' ELSE 'wrong' END AS verdict, CASE WHEN c_custkey % 2 = 0 THEN 'click,error,purchase,signup,view' ELSE 'click' END AS reasons FROM customer, range(0, 2) t(n)),
l AS (SELECT film_id, arg_max(verdict, id) AS verdict, arg_max(reasons, id) AS reasons FROM v GROUP BY film_id)
SELECT coalesce(g.film_id, l.film_id) AS film_id, codes, score, verdict, codes IS NOT NULL AND NOT coalesce(verdict = 'fine' AND reasons = codes, false) AS shown FROM g FULL JOIN l ON l.film_id = g.film_id""")
def audit_fold(spark: SparkSession, d: str) -> DataFrame:
    flags = A.table(spark, d, "events").groupBy(F.col("user_id").alias("film_id"), F.col("event_type").alias("reason")).agg(F.count("*").cast("int").alias("score"))
    k = F.col("c_custkey")
    said = A.table(spark, d, "customer").select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    verdicts = said.select(k.alias("film_id"), (k * 2 + F.col("n")).alias("id"), F.when((k + F.col("n")) % 3 == 0, "fine").otherwise("wrong").alias("verdict"), F.when(k % 2 == 0, "click,error,purchase,signup,view").otherwise("click").alias("reasons"))
    return summaries.audit_fold(flags, verdicts)


@query("""WITH o AS (SELECT user_id % 40 AS film_id, CAST(ts AS DATE) AS watched_on, event_id AS pos, event_type AS t FROM events), u AS (SELECT film_id, watched_on, CASE WHEN t IN ('click', 'view') THEN t END AS service, DATE '2001-10-31' AS logged_on, t = 'error' AS study, pos FROM o
UNION ALL SELECT DISTINCT film_id, watched_on, CASE WHEN film_id % 2 = 0 THEN 'held' END, DATE '2000-01-01', false, -1 FROM o WHERE film_id % 3 = 0)
SELECT film_id, CAST(watched_on AS VARCHAR) AS watched_on, arg_min(service, pos) FILTER (WHERE service IS NOT NULL) AS service, CAST(arg_min(logged_on, pos) AS VARCHAR) AS logged_on, bool_or(study) AS study FROM u GROUP BY film_id, watched_on""")
def viewing_add(spark: SparkSession, d: str) -> DataFrame:
    """What was said about viewings, put into the lines that are held: one a title and day."""
    e = A.table(spark, d, "events")
    film, day = (F.col("user_id") % 40).alias("film_id"), F.to_date("ts").alias("watched_on")
    said = e.select(F.col("event_id").alias("pos"), film, day, F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).alias("service"), (F.col("event_type") == "error").alias("study"))
    held = e.select(film, day).where("film_id % 3 = 0").distinct().select("film_id", "watched_on", F.when(F.col("film_id") % 2 == 0, "held").alias("service"), F.lit("2000-01-01").cast("date").alias("logged_on"), F.lit(False).alias("study"))
    found = summaries.viewing_lines(held, said, A.TODAY)
    return found.withColumns({"watched_on": F.col("watched_on").cast("string"), "logged_on": F.col("logged_on").cast("string")})


@query("""WITH l AS (SELECT c_custkey AS film_id, 'list' AS source, 'tt' || c_custkey AS expected_tt, CASE WHEN c_custkey % 2 = 0 THEN 'verified' ELSE 'open' END AS status, 'old' AS note FROM customer),
n AS (SELECT c_custkey AS film_id, 'list' AS source, CASE WHEN c_custkey % 3 = 0 THEN 'tt' || c_custkey ELSE 'tt0' END AS expected_tt FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 1000000, 'list', 'tt1' FROM customer WHERE c_custkey % 7 = 0)
SELECT coalesce(l.film_id, n.film_id) AS film_id, 'list' AS source, CASE WHEN n.film_id IS NULL OR (l.status = 'verified' AND l.expected_tt = n.expected_tt) THEN l.expected_tt ELSE n.expected_tt END AS expected_tt,
CASE WHEN n.film_id IS NULL OR (l.status = 'verified' AND l.expected_tt = n.expected_tt) THEN l.status ELSE 'verified' END AS status, CASE WHEN n.film_id IS NULL OR (l.status = 'verified' AND l.expected_tt = n.expected_tt) THEN l.note ELSE 'new' END AS note FROM l FULL JOIN n ON n.film_id = l.film_id""")
def ledger_ratified(spark: SparkSession, d: str) -> DataFrame:
    c, k = _rows(spark, d, "customer", "c_custkey")
    row = lambda df, film, tt, status, note: df.select(film.alias("film_id"), F.lit("list").alias("source"), tt.alias("expected_tt"), status.alias("status"), F.lit(note).alias("note"))
    ledger = row(c, k, _text("tt", k), F.when(k % 2 == 0, "verified").otherwise("open"), "old")
    said = row(c.where(k % 5 == 0), k, F.when(k % 3 == 0, _text("tt", k)).otherwise("tt0"), F.lit("verified"), "new")
    return reports.ratified(ledger, said.unionByName(row(c.where(k % 7 == 0), k + 1000000, F.lit("tt1"), F.lit("verified"), "new")))


@query("""WITH r AS (SELECT event_id AS id, event_type AS reason, CASE WHEN event_id % 5 <> 0 THEN user_id END AS film_id, CASE WHEN event_id % 2 = 0 THEN 'v' END AS value FROM events WHERE event_id % 4 = 0),
e AS (SELECT DISTINCT event_type AS reason, user_id AS film_id, CAST(NULL AS VARCHAR) AS value FROM events UNION SELECT DISTINCT event_type, CAST(NULL AS BIGINT), 'v' FROM events UNION SELECT DISTINCT event_type, user_id, 'v' FROM events)
SELECT reason, film_id, value FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.reason = e.reason AND r.film_id IS NOT DISTINCT FROM e.film_id AND r.value IS NOT DISTINCT FROM e.value)""")
def suppress_resolved(spark: SparkSession, d: str) -> DataFrame:
    """What was decided is not asked again, nulls being values like others."""
    e, k = _rows(spark, d, "events", "event_id")
    reviews = e.where(k % 4 == 0).select(F.lit("list").alias("authority"), F.lit(True).alias("resolved"), F.col("event_type").alias("reason"), F.when(k % 5 != 0, F.col("user_id")).alias("film_id"), F.when(k % 2 == 0, "v").alias("value"))
    row = lambda film, value: e.select(F.col("event_type").alias("reason"), film.alias("film_id"), value.cast("string").alias("value"))
    none = F.lit(None)
    entries = row(F.col("user_id"), none).union(row(none.cast("long"), F.lit("v"))).union(row(F.col("user_id"), F.lit("v"))).distinct()
    return writes.not_yet_resolved(entries, reviews, "list")


# summaries and corpora


@query("SELECT count(*) AS credits, count(DISTINCT l_partkey) AS films, (SELECT count(DISTINCT p_type) FROM part) AS keywords FROM lineitem")
def credits_summary(spark: SparkSession, d: str) -> DataFrame:
    credits = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("film_id"))
    return summaries.credits_summary(credits, A.table(spark, d, "part").select(F.col("p_type").alias("keyword")))


@query("SELECT event_type AS authority, count(*) AS n FROM events GROUP BY event_type")
def claim_counts(spark: SparkSession, d: str) -> DataFrame:
    return summaries.claim_counts(A.table(spark, d, "events").select(F.col("event_type").alias("authority")))


@query("SELECT count(*) FILTER (WHERE o_custkey % 3 = 0) AS linked, count(*) AS total FROM orders")
def old_rating_coverage(spark: SparkSession, d: str) -> DataFrame:
    return summaries.rating_coverage(A.table(spark, d, "orders").select(F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("film_id")))


@query(f"WITH {A.SERVICES_SQL}, {A.LISTINGS_SQL}, {A.CURRENT_SQL} SELECT slug, name, count(f.film_id) AS weight FROM services LEFT JOIN flagged f ON f.source = slug AND f.is_current GROUP BY slug, name")
def service_weights(spark: SparkSession, d: str) -> DataFrame:
    return summaries.service_weights(A.services(spark, d), A.listings(spark, d))


@query(f"WITH {A.SERVICES_SQL} SELECT slug, row_number() OVER (ORDER BY CASE WHEN subscribed THEN 0 ELSE 1 END, quality DESC, CASE WHEN has_apple_app THEN 0 ELSE 1 END, name) AS place FROM services")
def service_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of services; they are few, and one window numbers them."""
    from pyspark.sql import Window

    return A.services(spark, d).select("slug", F.row_number().over(Window.orderBy(*views.source_order())).cast("long").alias("place"))


@query("""WITH r AS (SELECT o_orderpriority AS grp, CASE WHEN o_orderkey % 20 = 0 THEN 'review' ELSE 'match' END AS kind, o_orderkey % 400 = 7 AS bad FROM orders)
SELECT grp, count(*) AS n, count(*) FILTER (WHERE kind = 'match' AND NOT bad) AS correct, count(*) FILTER (WHERE kind = 'match' AND bad) AS wrong, count(*) FILTER (WHERE kind <> 'match') AS review,
count(*) FILTER (WHERE kind = 'match' AND bad) = 0 AND count(*) FILTER (WHERE kind = 'match' AND NOT bad) >= 0.9 * count(*) AS passes FROM r GROUP BY grp""")
def resolver_tally(spark: SparkSession, d: str) -> DataFrame:
    o, k = _rows(spark, d, "orders", "o_orderkey")
    return summaries.resolver_tally(o.select(F.col("o_orderpriority").alias("grp"), F.when(k % 20 == 0, "review").otherwise("match").alias("kind"), _text("tt", F.when(k % 400 == 7, -k).otherwise(k)).alias("tt"), _text("tt", k).alias("expected_tt")))


@query(f"WITH {A.LISTS_SQL}, {A.ENTRIES_SQL} SELECT DISTINCT film_id FROM entries WHERE film_id IS NOT NULL")
def canon_members(spark: SparkSession, d: str) -> DataFrame:
    return summaries.canon_members(A.entries(spark, d), A.lists(spark, d))


@query("SELECT 'new_arrival_days' AS name, CAST(30 AS BIGINT) AS value UNION ALL SELECT 'multi_list', 1")
def thresholds(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(summaries.THRESHOLDS.items()), "name string, value long")


@query(f"WITH {A.TRANSITIONS_SQL}, {A.SERVICES_SQL} SELECT film_id, p_name AS title, s.name AS service FROM transitions t JOIN services s ON s.slug = t.source JOIN part ON p_partkey = film_id WHERE s.subscribed AND s.kind = 'svod' AND film_id % 2 = 0 AND appeared_on = DATE '1998-06-15'")
def watch_alerts(spark: SparkSession, d: str) -> DataFrame:
    return summaries.alerts(A.transitions(spark, d), A.every(spark, d, 2), A.films(spark, d), A.services(spark, d), "1998-06-15")


_PLAN = """keyed AS (SELECT p_partkey AS film_id, CASE WHEN p_partkey % 5 <> 0 THEN DATE '2001-10-31' - CAST(p_partkey % 4 AS INT) END AS checked FROM part WHERE p_partkey % 3 <> 0),
listed AS (SELECT film_id FROM keyed WHERE film_id % 13 = 0), first AS (SELECT film_id FROM keyed WHERE checked IS NULL AND film_id % 13 <> 0 ORDER BY film_id LIMIT 10)"""


@query(f"WITH {_PLAN} SELECT film_id, 'watchlist' AS step FROM listed UNION ALL SELECT film_id, 'first' FROM first UNION ALL SELECT film_id, 'full' FROM keyed WHERE film_id % 13 <> 0 AND checked IS DISTINCT FROM DATE '2001-10-31' AND film_id NOT IN (SELECT film_id FROM first)")
def provider_plan(spark: SparkSession, d: str) -> DataFrame:
    """A night whose last full refresh is over a week old; ten first checks are its batch."""
    return _provider_plan(spark, d, "2001-10-20")


@query(f"WITH {_PLAN} SELECT film_id, 'watchlist' AS step FROM listed UNION ALL SELECT film_id, 'first' FROM first")
def provider_plan_fresh(spark: SparkSession, d: str) -> DataFrame:
    return _provider_plan(spark, d, "2001-10-29")


def _provider_plan(spark: SparkSession, d: str, refreshed: str) -> DataFrame:
    p, k = _rows(spark, d, "part", "p_partkey")
    keyed = p.where(k % 3 != 0).select(k.alias("film_id"), F.lit("tmdb").alias("authority"))
    checks = p.where(k % 5 != 0).select(k.alias("film_id"), F.date_sub(F.lit(A.TODAY).cast("date"), (k % 4).cast("int")).alias("providers_checked_at"))
    return summaries.provider_plan(A.films(spark, d), keyed, checks, A.every(spark, d, 13), A.TODAY, refreshed, first_batch=10)


@query(f"""WITH {A.LISTINGS_SQL} SELECT p_partkey AS film_id, CASE WHEN p_partkey % 3 = 0 THEN 't' || p_partkey END AS tmdb, EXISTS (SELECT 1 FROM listings WHERE film_id = p_partkey AND source = 'criterion') AS criterion,
p_partkey % 4 = 0 AS rated, p_partkey % 7 = 0 AS owned, p_partkey % 13 = 0 AS watchlisted, p_partkey % 2 = 0 AND p_partkey % 4 <> 0 AS omdb_found FROM part WHERE p_partkey % 101 <> 0""")
def repair_corpus(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ids = A.every(spark, d, 3, F.lit("tmdb").alias("authority"), _text("t", k).alias("value"))
    return summaries.repair_corpus(A.films(spark, d), A.every(spark, d, 101), ids, A.listings(spark, d), A.ratings(spark, d), A.every(spark, d, 7), A.every(spark, d, 13), A.every(spark, d, 2, (k % 4 != 0).alias("found")))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Records of every second part: the year is one or five off, the running time and the score are a number or none."""
    p, k = _rows(spark, d, "part", "p_partkey")
    payload = F.to_json(F.struct(
        F.when(k % 3 == 0, "Another").otherwise(F.col("p_name")).alias("Title"), _text("tt", F.floor(k / 4)).alias("imdbID"), F.when(k % 10 == 0, "series").otherwise("movie").alias("Type"),
        F.when(k % 7 == 0, "Some One Else").otherwise(F.col("p_brand")).alias("Director"), F.lit("7.0").alias("imdbRating"), F.when(k % 6 == 0, "N/A").otherwise((k % 97).cast("string")).alias("Metascore"),
        (F.col("p_size") + F.when(k % 8 == 0, 1955).otherwise(1951)).cast("string").alias("Year"), F.when(k % 12 == 0, "N/A").otherwise(_text(k % 90 + 60, " min")).alias("Runtime"),
    ))
    return p.where(k % 2 == 0).select(k.alias("film_id"), (k % 14 != 0).alias("found"), payload.alias("payload"))


def _audit_corpus(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ids = A.every(spark, d, 3, F.lit("metacritic").alias("authority"), _text("s", k).alias("value"))
    scores = A.every(spark, d, 3).select(_text("s", F.col("film_id")).alias("slug"), (F.col("film_id") % 95).cast("int").alias("score"))
    facts = A.every(spark, d, 5, F.col("p_name").alias("title"), F.lit(None).cast("string").alias("original_title"), _text("tt", F.floor(k / 4) + F.when(k % 15 == 0, 1).otherwise(0)).alias("imdb_id"), (k % 90 + 60 + F.when(k % 20 == 0, 11).otherwise(10)).cast("int").alias("runtime_min"))
    return summaries.audit_corpus(A.films(spark, d), A.every(spark, d, 101), _records(spark, d), ids, scores, facts)


_SUBJECTS = """o AS (SELECT p_partkey AS film_id, CASE WHEN p_partkey % 3 = 0 THEN 'Another' ELSE p_name END AS omdb_title, 'tt' || (p_partkey // 4) AS omdb_imdb_id, CASE WHEN p_partkey % 10 = 0 THEN 'series' ELSE 'movie' END AS omdb_type,
  CASE WHEN p_partkey % 7 = 0 THEN 'Some One Else' ELSE p_brand END AS omdb_director, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 97 AS INT) END AS omdb_metascore, CAST(p_size + CASE WHEN p_partkey % 8 = 0 THEN 1955 ELSE 1951 END AS INT) AS omdb_year,
  CASE WHEN p_partkey % 12 <> 0 THEN CAST(p_partkey % 90 + 60 AS INT) END AS omdb_runtime_min FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 14 <> 0),
s AS (SELECT p_partkey AS film_id, p_name AS title, CAST(1950 + p_size AS INT) AS year, p_brand AS director, o.* EXCLUDE (film_id), CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 95 AS INT) END AS mc_score, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS tmdb_title,
  CASE WHEN p_partkey % 5 = 0 THEN 'tt' || (p_partkey // 4 + CASE WHEN p_partkey % 15 = 0 THEN 1 ELSE 0 END) END AS tmdb_imdb_id, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 90 + 60 + CASE WHEN p_partkey % 20 = 0 THEN 11 ELSE 10 END AS INT) END AS tmdb_runtime_min
  FROM part LEFT JOIN o ON o.film_id = p_partkey WHERE p_partkey % 101 <> 0)"""


@query(f"WITH {_SUBJECTS} SELECT film_id, title, year, omdb_title, omdb_imdb_id, omdb_type, omdb_director, omdb_metascore, omdb_year, omdb_runtime_min, mc_score, tmdb_title, tmdb_imdb_id, tmdb_runtime_min FROM s")
def audit_corpus(spark: SparkSession, d: str) -> DataFrame:
    return _audit_corpus(spark, d).select("film_id", "title", "year", "omdb_title", "omdb_imdb_id", "omdb_type", "omdb_director", "omdb_metascore", "omdb_year", "omdb_runtime_min", "mc_score", "tmdb_title", "tmdb_imdb_id", "tmdb_runtime_min")


@query(f"""WITH {_SUBJECTS}, h AS (SELECT omdb_imdb_id AS id, count(*) AS n FROM s WHERE omdb_imdb_id IS NOT NULL GROUP BY 1), c AS (SELECT s.film_id, [CASE WHEN omdb_director = 'Some One Else' THEN 'director' END, CASE WHEN omdb_imdb_id <> tmdb_imdb_id THEN 'imdb-id' END, CASE WHEN mc_score <> omdb_metascore THEN 'mc-score' END,
  CASE WHEN lower(omdb_title) <> lower(title) THEN 'omdb-title' END, CASE WHEN abs(omdb_runtime_min - tmdb_runtime_min) > 10 THEN 'runtime' END, CASE WHEN h.n > 1 THEN 'shared-imdb' END, CASE WHEN omdb_type <> 'movie' THEN 'stub' END, CASE WHEN abs(year - omdb_year) > 1 THEN 'year' END] AS r FROM s LEFT JOIN h ON h.id = omdb_imdb_id),
u AS (SELECT film_id, unnest(r) AS reason FROM c) SELECT film_id, reason, CAST(CASE reason WHEN 'mc-score' THEN 3 WHEN 'imdb-id' THEN 3 WHEN 'year' THEN 1 WHEN 'stub' THEN 1 ELSE 2 END AS INT) AS score FROM u WHERE reason IS NOT NULL""")
def consistency_checks(spark: SparkSession, d: str) -> DataFrame:
    """The nine checks of a title against its record, facts and score."""
    return audit.flags(audit.with_shared_ids(_audit_corpus(spark, d))).select("film_id", "reason", "score")


@query("SELECT p_partkey AS film_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 14 <> 0 AND p_partkey % 12 <> 0 THEN CAST(p_partkey % 90 + 60 AS INT) END AS runtime_min FROM part WHERE p_partkey % 101 <> 0")
def matching_corpus(spark: SparkSession, d: str) -> DataFrame:
    return summaries.matching_corpus(A.films(spark, d), A.every(spark, d, 101), _records(spark, d)).select("film_id", "title", "runtime_min")


@query("SELECT 'm' || p_partkey AS value, CASE WHEN p_partkey % 8 = 0 THEN p_partkey - 1 ELSE p_partkey END AS film_id FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 12 <> 0")
def mediaid_holders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ids = A.every(spark, d, 4, F.lit("criterion").alias("authority"), F.when(k % 12 == 0, "https://x.example").otherwise(_text("m", k)).alias("value"))
    return summaries.id_holders(ids, A.every(spark, d, 8, (k - 1).alias("canonical_id")), "criterion")


@query("SELECT vec_id AS film_id, CAST(len(embedding) AS BIGINT) AS n FROM embeddings WHERE label < 5 AND vec_id % 7 <> 0")
def live_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("film_id"), F.when(F.col("label") < 5, "small").otherwise("large").alias("model"), F.lit(64).alias("dim"), F.col("embedding").alias("vector"))
    found = summaries.live_vectors(e, "small", e.where("film_id % 7 = 0"))
    return found.select("film_id", F.size("vector").cast("long").alias("n"))


@query(f"WITH {_SUBJECTS} SELECT s.film_id, s.year, omdb_year FROM s WHERE omdb_year IS NOT NULL AND omdb_year <> year UNION ALL SELECT film_id, CAST(1950 + p_size AS INT), omdb_year FROM o JOIN part ON p_partkey = film_id WHERE film_id % 101 = 0 AND omdb_year <> 1950 + p_size UNION ALL SELECT p_partkey, CAST(1950 + p_size AS INT), CAST(p_size + CASE WHEN p_partkey % 8 = 0 THEN 1955 ELSE 1951 END AS INT) FROM part WHERE p_partkey % 14 = 0")
def stale_years(spark: SparkSession, d: str) -> DataFrame:
    return worklists.stale_years(A.films(spark, d), _records(spark, d))


@query("""SELECT p_partkey AS film_id, 'tt' || (p_partkey // 4) AS omdb_id, CASE WHEN p_partkey % 6 = 0 THEN 'tt' || (p_partkey // 4 + p_partkey % 5) ELSE 'tt' || (p_partkey // 4 + 1) END AS known_id FROM part
WHERE p_partkey % 2 = 0 AND ((p_partkey % 6 = 0 AND p_partkey % 5 <> 0) OR (p_partkey % 6 <> 0 AND p_partkey % 10 = 0))""")
def key_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Records under another id than the title's own, or than its facts say."""
    k = F.col("p_partkey")
    ids = A.every(spark, d, 6, F.lit("imdb").alias("authority"), _text("tt", F.floor(k / 4) + k % 5).alias("value"))
    facts = A.every(spark, d, 10, _text("tt", F.floor(k / 4) + 1).alias("imdb_id"))
    return worklists.key_disagreements(A.films(spark, d), _records(spark, d), ids, facts)


@query("SELECT p_partkey AS film_id, p_partkey - 1 AS twin_id FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 < 3 AND p_partkey > 0")
def twins(spark: SparkSession, d: str) -> DataFrame:
    """Odd titles with a year in them, and the even one before of that name, one year apart or two."""
    p, k = _rows(spark, d, "part", "p_partkey")
    pair, year = F.floor(k / 2), (F.floor(k / 2) % 60 + 1940).cast("int")
    title = F.when(k % 2 == 0, _text("Work ", pair)).otherwise(_text("Work ", pair, " (", year + F.when(k % 5 < 3, 1).otherwise(2), ")"))
    return resolution.twins(p.select(k.alias("film_id"), title.alias("title"), F.when(k % 2 == 0, year).alias("year")))


@query("""WITH t AS (SELECT p_partkey AS slug_id, (p_partkey - 1) // 24 + 1 AS page, CASE WHEN p_partkey % 50 = 0 THEN 'twice' ELSE 's' || p_partkey END AS slug, CASE WHEN p_partkey % 40 = 0 THEN 1000 ELSE 500 - p_partkey % 24 END AS score, p_partkey AS rank FROM part WHERE p_partkey > 0 AND p_partkey % 31 <> 0),
l AS (SELECT max(page) AS last FROM t), b AS (SELECT *, lag(score) OVER (PARTITION BY page ORDER BY rank) AS before FROM t)
SELECT page, 'cards' AS problem FROM t, l GROUP BY page, last HAVING count(*) <> 24 AND page <> last UNION SELECT page, 'order' FROM b WHERE score > before UNION SELECT min(page), 'slug' FROM t GROUP BY slug HAVING count(*) > 1""")
def archive_check(spark: SparkSession, d: str) -> DataFrame:
    p, k = _rows(spark, d, "part", "p_partkey")
    titles = p.where((k > 0) & (k % 31 != 0)).select((F.floor((k - 1) / 24) + 1).alias("page"), F.when(k % 50 == 0, "twice").otherwise(_text("s", k)).alias("slug"), F.when(k % 40 == 0, 1000).otherwise(500 - k % 24).alias("score"), k.alias("rank"))
    return audit.archive_problems(titles)


@query("""SELECT l_partkey AS film_id, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY l_partkey""")
def writer_labels(spark: SparkSession, d: str) -> DataFrame:
    """How many writers a title names; one label a person, whatever their jobs."""
    line = A.table(spark, d, "lineitem").where("l_linenumber % 2 = 0")
    job = F.when(F.col("l_linenumber") % 4 == 0, "Screenplay").otherwise("Story")
    credits = line.select(F.col("l_partkey").alias("film_id"), F.col("l_suppkey").alias("person_id"), F.lit("crew").alias("kind"), F.lit("Writing").alias("department"), job.alias("job"), F.col("l_linenumber").alias("ord"))
    persons = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return reports.writers(credits, persons).select("film_id", F.size("writers").cast("long").alias("n"))


@query("SELECT vec_id, CAST(256 AS BIGINT) AS n_bytes, round(CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS DOUBLE), 6) + 0.0 AS total FROM embeddings")
def vector_packing(spark: SparkSession, d: str) -> DataFrame:
    """Vectors packed into bytes and read again."""
    blobs = A.table(spark, d, "embeddings").select("vec_id", vectors.of_length(vectors.packed(F.col("embedding")), 64).alias("blob"))
    back = blobs.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), vectors.unpacked(F.col("blob")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", "n_bytes", (F.round(total, 6) + F.lit(0.0)).alias("total"))


@query("SELECT p_partkey AS film_id, p_partkey % 2 = 0 AS kept, true AS sound FROM part")
def guid_fill(spark: SparkSession, d: str) -> DataFrame:
    """Titles without an identifier get a random one; those that have one keep it."""
    p, k = _rows(spark, d, "part", "p_partkey")
    films = p.select(k.alias("film_id"), F.when(k % 2 == 0, _text("held-", k)).alias("guid"))
    filled = writes.with_guids(films)
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return filled.select("film_id", F.startswith("guid", F.lit("held-")).alias("kept"), (F.col("guid").rlike(form) | (F.col("guid") == _text("held-", F.col("film_id")))).alias("sound"))


@query("SELECT p_partkey AS film_id, CASE WHEN p_partkey % 4 = 0 THEN 99 WHEN p_partkey % 14 <> 0 AND p_partkey % 6 <> 0 THEN CAST(p_partkey % 97 AS INT) WHEN p_partkey % 14 = 0 AND p_partkey % 6 <> 0 THEN CAST(p_partkey % 97 AS INT) END AS metacritic FROM part WHERE p_partkey % 2 = 0")
def json_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A column that is new is filled from the stored records; what is known stays."""
    records = _records(spark, d).withColumn("metacritic", F.when(F.col("film_id") % 4 == 0, 99))
    return writes.backfilled(records, "metacritic", "$.Metascore", "int").select("film_id", "metacritic")


@query("SELECT 's' || p_partkey AS slug, CAST(place AS INT) AS place FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part WHERE p_partkey % 3 <> 0) WHERE place <= 100")
def top_staged(spark: SparkSession, d: str) -> DataFrame:
    """The hundred staged titles that rank first: the number is the feature's."""
    p, k = _rows(spark, d, "part", "p_partkey")
    staged = p.where(k % 3 != 0).select(_text("s", k).alias("slug"), F.col("p_retailprice").alias("score"), k.alias("k"))
    return views.top_k(staged, [F.desc("score"), F.col("k")], 100).select("slug", F.col("place").cast("int").alias("place"))


# ranking sessions


_SESSION = """rated AS (SELECT p_partkey AS film_id, CAST(p_partkey % 11 AS INT) AS score FROM part WHERE p_partkey % 4 = 0),
pool AS (SELECT p_partkey AS film_id FROM part WHERE (p_partkey % 7 = 0 OR p_partkey % 9 = 0 OR p_partkey IN (SELECT film_id FROM rated WHERE score >= 6)) AND p_partkey % 101 <> 0 AND p_partkey % 10 <> 0 AND p_partkey NOT IN (SELECT film_id FROM rated WHERE score < 6))"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return ranker.rank_pool(A.every(spark, d, 7), A.every(spark, d, 9), A.ratings(spark, d), A.every(spark, d, 101), A.every(spark, d, 10))


@query(f"WITH {_SESSION} SELECT film_id FROM pool")
def rank_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)


@query(f"WITH {_SESSION}, {A.FILMS_SQL} SELECT pool.film_id, score, imdb FROM pool JOIN rated USING (film_id) JOIN films USING (film_id) WHERE score >= 6")
def pool_seeds(spark: SparkSession, d: str) -> DataFrame:
    return summaries.pool_seeds(_pool(spark, d), A.ratings(spark, d), A.films(spark, d))


_PLACED = "placed AS (SELECT p_partkey AS film_id, CAST(p_size % 5 + 1 AS INT) AS tier, CAST(p_partkey % 3 AS BIGINT) AS session_id FROM part), ordered AS (SELECT session_id, tier, film_id, row_number() OVER (PARTITION BY session_id, tier ORDER BY film_id) AS position FROM placed WHERE film_id % 4 < 2)"


def _session(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, k = _rows(spark, d, "part", "p_partkey")
    placed = p.select(k.alias("film_id"), (F.col("p_size") % 5 + 1).cast("int").alias("tier"), (k % 3).alias("session_id"), F.lit("compared").alias("how"))
    return placed, writes.renumbered(placed.where("film_id % 4 < 2").select("session_id", "tier", "film_id"), ["session_id", "tier"], [F.col("film_id")])


@query(f"WITH {_PLACED} SELECT p_partkey AS film_id FROM part WHERE p_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.film_id = p_partkey AND session_id = 1 AND (tier NOT IN (1, 2) OR p.film_id % 4 < 2))")
def marks_left(spark: SparkSession, d: str) -> DataFrame:
    placed, order = _session(spark, d)
    return summaries.marks_left(A.every(spark, d, 2), placed, order, 1, (1, 2))


@query(f"WITH {_PLACED} SELECT p_partkey AS film_id, tier, CASE WHEN tier IS NOT NULL THEN 'compared' END AS how, tier IS NOT NULL AND p_partkey % 4 >= 2 AS awaiting_order FROM part LEFT JOIN placed p ON p.film_id = p_partkey AND session_id = 1")
def rank_status(spark: SparkSession, d: str) -> DataFrame:
    return summaries.rank_status(A.films(spark, d), *_session(spark, d), 1)


_QUEUED = f"""{_PLACED}, q AS (SELECT session_id, tier, film_id, row_number() OVER (PARTITION BY session_id, tier ORDER BY CASE WHEN film_id % 10 = 2 THEN 1 ELSE 0 END, film_id % 17, film_id) AS place FROM placed WHERE film_id % 4 >= 2)"""


def _queued(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    placed, order = _session(spark, d)
    late = placed.where("film_id % 10 = 2").select("session_id", "film_id", F.date_add(F.lit("2001-01-01").cast("date"), (F.col("film_id") % 17).cast("int")).alias("deferred_on"))
    return order, summaries.order_queue(placed, order, late, F.col("film_id") % 17)


@query(f"WITH {_QUEUED} SELECT session_id, tier, film_id, place FROM q")
def order_queue(spark: SparkSession, d: str) -> DataFrame:
    return _queued(spark, d)[1].withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {_QUEUED}, n AS (SELECT session_id, tier, count(*) AS ordered FROM ordered GROUP BY ALL), h AS (SELECT session_id, tier, count(*) AS remaining, arg_min(film_id, place) AS film_id FROM q GROUP BY ALL),
v AS (SELECT h.*, coalesce(ordered, 0) AS ordered, CASE WHEN h.film_id % 3 = 0 THEN least(1, coalesce(ordered, 0)) ELSE 0 END AS low, coalesce(ordered, 0) AS high FROM h LEFT JOIN n USING (session_id, tier))
SELECT v.session_id, v.tier, v.ordered, remaining, v.film_id, o.film_id AS other_id, CASE WHEN low >= high THEN low END AS slot FROM v LEFT JOIN ordered o ON low < high AND o.session_id = v.session_id AND o.tier = v.tier AND o.position = (low + high) // 2 + 1""")
def order_state(spark: SparkSession, d: str) -> DataFrame:
    """Heads of the queues: every third was found worse than the first of its order."""
    order, queue = _queued(spark, d)
    first = order.where("position = 1").select("session_id", "tier", F.col("film_id").alias("other_film_id"))
    log = queue.where("film_id % 3 = 0").join(first, ["session_id", "tier"]).select("session_id", "tier", "film_id", "other_film_id", F.lit("worse").alias("verdict"))
    found = summaries.order_state(order, queue, ranker.insertion_bounds(order, log))
    return found.withColumn("slot", F.col("slot").cast("long"))


@query("""WITH r AS (SELECT user_id, string_agg(CASE WHEN value < 50 THEN 'better' ELSE 'worse' END, ',' ORDER BY event_id) AS run, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 2 GROUP BY user_id)
SELECT user_id AS film_id, CASE WHEN run IN ('better,better', 'better,worse', 'worse,better') THEN 'place' ELSE 'ask' END AS action, CASE run WHEN 'better' THEN 2 WHEN 'worse' THEN 4 WHEN 'better,better' THEN 1 WHEN 'better,worse' THEN 2 WHEN 'worse,better' THEN 3 ELSE 5 END AS tier FROM r""")
def tier_search(spark: SparkSession, d: str) -> DataFrame:
    """What the first two verdicts on a title say comes next."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    log = A.table(spark, d, "events").withColumn("n", nth).where("n <= 2").select(F.lit(1).alias("session_id"), F.col("user_id").alias("film_id"), F.col("event_id").alias("id"), F.when(F.col("value") < 50, "better").otherwise("worse").alias("verdict"))
    return ranker.next_steps(log).select("film_id", "action", "tier")


@query("SELECT event_id AS id, user_id % 3 AS session_id FROM events WHERE event_id <> (SELECT max(event_id) FROM events WHERE user_id % 3 = 1)")
def rank_undo(spark: SparkSession, d: str) -> DataFrame:
    return ranker.without_last(A.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("session_id")), 1)


@query(f"WITH {A.LISTINGS_SQL}, b AS (SELECT film_id, source, url || '!' AS url, DATE '{A.TODAY}' AS seen FROM listings WHERE film_id % 3 = 0), k AS (SELECT film_id, source, url, first_seen, last_seen FROM listings WHERE source <> 's3') SELECT source, count(*) AS n, count(*) FILTER (WHERE last_seen = DATE '{A.TODAY}') AS today FROM (SELECT coalesce(k.film_id, b.film_id) AS film_id, coalesce(k.source, b.source) AS source, coalesce(b.seen, k.last_seen) AS last_seen FROM k FULL JOIN b ON b.film_id = k.film_id AND b.source = k.source) GROUP BY source")
def nightly_sync(spark: SparkSession, d: str) -> DataFrame:
    """Listings by source after a night's batch, in which one source is read for the first time."""
    held = A.listings(spark, d)
    batch = held.where("film_id % 3 = 0").select("film_id", "source", F.concat("url", F.lit("!")).alias("url"), F.lit(A.TODAY).cast("date").alias("seen"))
    after, _ = sync.sync_batch(held.where("source <> 's3'").select("film_id", "source", "url", "first_seen", "last_seen"), batch)
    return after.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("last_seen") == F.lit(A.TODAY).cast("date")).alias("today"))
