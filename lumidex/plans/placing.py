"""Queries of the jobs that place titles: imports, promotions, keying, walks, bridges and audits of keys.

Parts are films; orders, customers and events are what comes in. Evidence that a resolver or
the corpus would give is derived from keys, alike in the query and its SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.functions import expressions as X
from lumidex.operators import placement as P
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


def _text(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _rows(spark: SparkSession, d: str, name: str, key: str) -> tuple[DataFrame, Column]:
    return A.table(spark, d, name), F.col(key)


def _films(spark: SparkSession, d: str) -> DataFrame:
    """Parts under unique titles and keys."""
    p, k = _rows(spark, d, "part", "p_partkey")
    title, year = _text("Film ", k), (F.col("p_size") + 1950).cast("int")
    return p.where(k > 0).select(k.alias("film_id"), title.alias("title"), year.alias("year"), X.film_key(title, year).alias("key"), F.lit("movie").alias("kind"), F.col("p_brand").alias("director"))


def _canon(spark: SparkSession, d: str) -> DataFrame:
    """Every eighth part is merged into the one before it."""
    p, k = _rows(spark, d, "part", "p_partkey")
    return p.where((k % 8 == 0) & (k > 0)).select(k.alias("film_id"), (k - 1).alias("canonical_id"))


def _gone(spark: SparkSession, d: str) -> DataFrame:
    """Merged parts, and every fifteenth, which is tombstoned unless it was merged."""
    p, k = _rows(spark, d, "part", "p_partkey")
    return p.where(((k % 8 == 0) | (k % 15 == 0)) & (k > 0)).select(k.alias("film_id"), F.when(k % 8 == 0, "merged").otherwise("tombstoned").alias("kind"))


def _ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that parts hold: imdb every second, tmdb every third, a stream's every fifth, a store's every seventh."""
    p, k = _rows(spark, d, "part", "p_partkey")
    one = lambda step, name, mark: p.where((k % step == 0) & (k > 0)).select(k.alias("film_id"), F.lit(name).alias("authority"), _text(mark, k).alias("value"))
    return one(2, "imdb", "tt").unionByName(one(3, "tmdb", "")).unionByName(one(5, "criterion", "m")).unionByName(one(7, "itunes", ""))


def _held(spark: SparkSession, d: str) -> DataFrame:
    return P.holders(_ids(spark, d), _canon(spark, d), _gone(spark, d))


_BASE = """films AS (SELECT p_partkey AS film_id, 'Film ' || p_partkey AS title, CAST(1950 + p_size AS INT) AS year, 'film ' || p_partkey || ' (' || CAST(1950 + p_size AS INT) || ')' AS key FROM part WHERE p_partkey > 0),
gone AS (SELECT film_id, CASE WHEN film_id % 8 = 0 THEN 'merged' ELSE 'tombstoned' END AS kind FROM films WHERE film_id % 8 = 0 OR film_id % 15 = 0),
canon AS (SELECT film_id, film_id - 1 AS canonical_id FROM films WHERE film_id % 8 = 0),
ids AS (SELECT film_id, 'imdb' AS authority, 'tt' || film_id AS value FROM films WHERE film_id % 2 = 0 UNION ALL SELECT film_id, 'tmdb', CAST(film_id AS VARCHAR) FROM films WHERE film_id % 3 = 0
  UNION ALL SELECT film_id, 'criterion', 'm' || film_id FROM films WHERE film_id % 5 = 0 UNION ALL SELECT film_id, 'itunes', CAST(film_id AS VARCHAR) FROM films WHERE film_id % 7 = 0),
held AS (SELECT authority, value, coalesce(canonical_id, i.film_id) AS holder, coalesce(g.kind = 'tombstoned', false) AS hidden FROM ids i LEFT JOIN canon c ON c.film_id = i.film_id LEFT JOIN gone g ON g.film_id = coalesce(canonical_id, i.film_id))"""


@query(f"WITH {_BASE} SELECT authority, value, holder, hidden FROM held")
def id_owners(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d)


#: What comes in: orders, each about the part with its number modulo 400, resolved two times out of three.
def _incoming(spark: SparkSession, d: str) -> DataFrame:
    o, k = _rows(spark, d, "orders", "o_orderkey")
    n = F.col("o_custkey") % 400
    return o.select(
        k.alias("item_id"), n.alias("n"), _text("Film ", F.when(k % 4 == 0, n).otherwise(k)).alias("title"), (1950 + n % 50).cast("int").alias("year"), F.when(k % 3 == 0, _text("tt", n)).alias("tt"), F.when(k % 5 == 0, n.cast("string")).alias("tmdb_id"),
    )


_INCOMING = """incoming AS (SELECT o_orderkey AS item_id, o_custkey % 400 AS n, 'Film ' || CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 400 ELSE o_orderkey END AS title, CAST(1950 + o_custkey % 400 % 50 AS INT) AS year,
  CASE WHEN o_orderkey % 3 = 0 THEN 'tt' || (o_custkey % 400) END AS tt, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey % 400 AS VARCHAR) END AS tmdb_id FROM orders),
placed AS (SELECT i.*, lower(title) || ' (' || year || ')' AS key, coalesce(a.holder, b.holder) AS holder, CASE WHEN a.holder IS NOT NULL THEN a.hidden ELSE coalesce(b.hidden, false) END AS hidden
  FROM incoming i LEFT JOIN held a ON a.authority = 'imdb' AND a.value = i.tt LEFT JOIN held b ON b.authority = 'tmdb' AND b.value = i.tmdb_id)"""


@query(f"""WITH {_BASE}, {_INCOMING}, e AS (SELECT p.*, p.item_id % 13 = 0 AS tied, CASE WHEN p.item_id % 11 = 0 THEN p.n END AS winner, CASE WHEN p.item_id % 17 = 0 THEN 'year-gap' END AS reason,
  k.film_id AS k_film, p.key IN (SELECT key FROM films WHERE film_id % 15 = 0) AS gone FROM placed p LEFT JOIN films k ON k.key = p.key),
f AS (SELECT *, holder IS NOT NULL AND NOT hidden AS resolved, NOT (holder IS NOT NULL AND NOT hidden) AND NOT tied AND winner IS NULL AND reason IS NULL AND NOT gone AND k_film IS NULL AS fresh FROM e),
g AS (SELECT *, CASE WHEN fresh THEN row_number() OVER (PARTITION BY fresh, key ORDER BY item_id) END AS nth FROM f),
o AS (SELECT *, CASE WHEN resolved THEN 'resolved' WHEN tied THEN 'ambiguous-owned' WHEN winner IS NOT NULL THEN 'matched' WHEN reason IS NOT NULL THEN 'year-drift' WHEN gone THEN 'skipped' WHEN k_film IS NOT NULL OR nth > 1 THEN 'matched' ELSE 'created' END AS outcome FROM g)
SELECT item_id, outcome, CASE WHEN outcome = 'resolved' THEN holder WHEN outcome = 'matched' THEN coalesce(winner, k_film) END AS film_id FROM o""")
def owned_import(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("item_id"), F.col("n")
    titles = _incoming(spark, d).withColumns({"tied": k % 13 == 0, "winner": F.when(k % 11 == 0, n), "reason": F.when(k % 17 == 0, "year-gap")})
    films = _films(spark, d)
    return P.owned_outcomes(titles, _held(spark, d), films, films.where("film_id % 15 = 0"))


@query(f"""WITH {_BASE}, {_INCOMING}, e AS (SELECT 'slug-' || p.item_id AS slug, p.item_id % 10 = 0 AS claimed, p.item_id % 7 = 0 AS asked, p.key IN (SELECT key FROM films WHERE film_id % 15 = 0) AS gone, holder IS NOT NULL AND NOT hidden AS linked, holder, k.film_id AS k_film, p.key, p.item_id
  FROM placed p LEFT JOIN films k ON k.key = p.key), f AS (SELECT *, NOT claimed AND NOT asked AND NOT gone AND NOT linked AND k_film IS NULL AS fresh FROM e),
g AS (SELECT *, CASE WHEN fresh THEN row_number() OVER (PARTITION BY fresh, key ORDER BY item_id) END AS nth FROM f),
o AS (SELECT *, CASE WHEN claimed THEN 'already-linked' WHEN asked OR gone THEN 'skipped' WHEN linked THEN 'linked' WHEN k_film IS NOT NULL OR nth > 1 THEN 'key-conflict' ELSE 'promoted' END AS outcome FROM g)
SELECT slug, outcome, CASE outcome WHEN 'linked' THEN holder WHEN 'key-conflict' THEN k_film END AS film_id FROM o""")
def top_promotion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id")
    staged = _incoming(spark, d).withColumns({"slug": _text("slug-", k), "rank": k})
    films = _films(spark, d)
    return P.promotion_outcomes(staged, staged.where(k % 10 == 0), staged.where(k % 7 == 0), _held(spark, d), films, films.where("film_id % 15 = 0"))


@query(f"""WITH {_BASE}, {_INCOMING}, o AS (SELECT item_id AS line, holder, CASE WHEN item_id % 19 = 0 THEN 'error' WHEN item_id % 6 = 1 OR tt IS NULL THEN 'unresolved' WHEN holder IS NOT NULL AND hidden THEN 'blocked' WHEN holder IS NOT NULL THEN 'linked'
  WHEN item_id % 5 + 1 < 4 THEN 'absent' WHEN item_id % 12 = 0 THEN 'blocked' ELSE 'would-create' END AS outcome FROM placed) SELECT line, outcome, CASE WHEN outcome = 'linked' THEN holder END AS film_id FROM o""")
def old_rating_placement(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id")
    rows = _incoming(spark, d).withColumns({"line": k, "stars": (k % 5 + 1).cast("int"), "kind": F.when(k % 19 == 0, None).otherwise(F.when(k % 6 == 1, "review").otherwise("match"))})
    return P.rating_outcomes(rows, _held(spark, d), rows.where(k % 12 == 0))


@query(f"""WITH {_BASE}, {_INCOMING}, e AS (SELECT p.*, o.o_orderpriority AS list_slug, CASE WHEN p.item_id % 9 = 0 THEN n END AS own, CASE WHEN p.item_id % 19 = 0 THEN NULL WHEN p.item_id % 6 = 1 THEN 'review' ELSE 'match' END AS kind,
  CASE WHEN p.item_id % 14 = 0 THEN 'disagree' ELSE 'agree' END AS agreement FROM placed p JOIN orders o ON o.o_orderkey = p.item_id),
t AS (SELECT DISTINCT list_slug, own FROM e WHERE own IS NOT NULL), w AS (SELECT e.*, t.own IS NOT NULL AS taken, e.item_id % 12 = 0 AS vetoed FROM e LEFT JOIN t ON t.list_slug = e.list_slug AND t.own = e.holder WHERE e.own IS NULL AND e.item_id % 16 <> 0),
a AS (SELECT *, coalesce(kind IS NOT NULL AND agreement <> 'disagree' AND tt IS NOT NULL AND NOT (holder IS NOT NULL AND hidden) AND NOT taken AND (holder IS NOT NULL OR NOT vetoed), false) AS able, coalesce(CAST(holder AS VARCHAR), tt) AS target FROM w),
b AS (SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able, list_slug, target ORDER BY item_id) END AS nth FROM a),
o AS (SELECT *, CASE WHEN kind IS NULL THEN 'error' WHEN agreement = 'disagree' OR tt IS NULL OR (holder IS NOT NULL AND hidden) THEN 'blocked' WHEN taken OR nth > 1 THEN 'duplicate-entry' WHEN holder IS NOT NULL THEN 'linked' WHEN vetoed THEN 'blocked' ELSE 'created' END AS outcome FROM b)
SELECT list_slug, item_id AS rank, outcome, CASE WHEN outcome = 'linked' THEN holder END AS film_id FROM o""")
def list_creation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id")
    slug = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("list_slug"))
    rows = _incoming(spark, d).join(slug, "item_id").withColumns(
        {"rank": k, "film_id": F.when(k % 9 == 0, F.col("n")), "kind": F.when(k % 19 == 0, None).otherwise(F.when(k % 6 == 1, "review").otherwise("match")), "agreement": F.when(k % 14 == 0, "disagree").otherwise("agree")}
    )
    value = rows.select("item_id", _text(F.col("list_slug"), "#", F.col("rank")).alias("value"))
    return P.creation_outcomes(rows, value.where(k % 16 == 0), _held(spark, d), value.where(k % 12 == 0))


@query(f"""WITH {_BASE}, n AS (SELECT film_id, 'film ' || CASE WHEN film_id % 2 = 1 AND film_id % 8 = 7 THEN film_id + 1 WHEN film_id % 2 = 1 AND film_id % 5 = 0 THEN film_id + 2 ELSE film_id END AS name,
  CASE WHEN film_id % 8 = 7 THEN film_id + 1 WHEN film_id % 5 = 0 THEN film_id + 2 ELSE film_id END AS target FROM films WHERE film_id % 2 = 1),
u AS (SELECT n.film_id, CAST(coalesce(t.year, f.year) AS INT) AS year, name || ' (' || coalesce(t.year, f.year) || ')' AS key FROM n JOIN films f ON f.film_id = n.film_id LEFT JOIN films t ON t.film_id = n.target),
h AS (SELECT f.film_id, f.key, CASE WHEN g.film_id IS NOT NULL THEN coalesce(canonical_id, f.film_id) ELSE f.film_id END AS live FROM films f LEFT JOIN gone g ON g.film_id = f.film_id LEFT JOIN canon c ON c.film_id = f.film_id)
SELECT u.film_id, u.year, u.key, CASE WHEN h.live <> u.film_id THEN h.live END AS clash, CASE WHEN h.live = u.film_id THEN h.film_id END AS retired FROM u LEFT JOIN h ON h.key = u.key AND h.film_id <> u.film_id""")
def year_update(spark: SparkSession, d: str) -> DataFrame:
    """Odd films take the year of a title they are named like: their own merged loser's, or another's."""
    return P.year_updates(*_year_case(spark, d))


def _year_case(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k = F.col("film_id")
    films = _films(spark, d)
    target = F.when((k % 2 == 1) & (k % 8 == 7), k + 1).when((k % 2 == 1) & (k % 5 == 0), k + 2).otherwise(k)
    named = films.withColumn("title", _text("Film ", target)).withColumn("target", target)
    theirs = films.select(F.col("film_id").alias("target"), F.col("year").alias("theirs"))
    updates = named.where(k % 2 == 1).join(theirs, "target", "left").select("film_id", F.coalesce("theirs", "year").alias("year"))
    return named.drop("target"), _gone(spark, d), _canon(spark, d), updates


@query(f"""WITH {_BASE}, n AS (SELECT film_id, CASE WHEN film_id % 8 = 7 THEN film_id + 1 WHEN film_id % 5 = 0 THEN film_id + 2 ELSE film_id END AS target FROM films WHERE film_id % 2 = 1),
t AS (SELECT n.film_id, CASE WHEN n.film_id % 4 = 1 THEN NULL ELSE f.year END AS year, n.film_id % 3 = 0 AS commerce, CAST(CASE WHEN n.film_id % 11 = 0 THEN 3 ELSE n.film_id END AS VARCHAR) AS tmdb_id, CASE WHEN n.film_id % 7 <> 0 THEN CAST(coalesce(x.year, f.year) AS INT) END AS winner_year, target
  FROM n JOIN films f ON f.film_id = n.film_id LEFT JOIN films x ON x.film_id = n.target),
c AS (SELECT t.*, coalesce(h.film_id <> t.film_id, false) AS conflict FROM t LEFT JOIN ids h ON h.authority = 'tmdb' AND h.value = t.tmdb_id),
a AS (SELECT *, NOT conflict AND winner_year IS NOT NULL AND (year IS NULL OR (commerce AND winner_year <> year)) AS adopts FROM c),
h AS (SELECT f.film_id, f.key, CASE WHEN g.film_id IS NOT NULL THEN coalesce(canonical_id, f.film_id) ELSE f.film_id END AS live FROM films f LEFT JOIN gone g ON g.film_id = f.film_id LEFT JOIN canon c ON c.film_id = f.film_id)
SELECT a.film_id, CASE WHEN conflict THEN 'id-conflict' WHEN NOT coalesce(adopts, false) THEN 'matched' WHEN h.live <> a.film_id THEN 'collision' ELSE 'adopted' END AS outcome
FROM a LEFT JOIN h ON adopts AND h.key = 'film ' || target || ' (' || winner_year || ')' AND h.film_id <> a.film_id""")
def match_write(spark: SparkSession, d: str) -> DataFrame:
    """Matches of odd films, some with an id that another holds; years are adopted where they are missing or a shop's."""
    k = F.col("film_id")
    films, gone, canon, updates = _year_case(spark, d)
    years = updates.select("film_id", F.when(k % 7 != 0, F.col("year")).alias("winner_year"))
    targets = films.where(k % 2 == 1).select("film_id", F.when(k % 4 == 1, None).otherwise(F.col("year")).alias("year"), (k % 3 == 0).alias("commerce"), F.when(k % 11 == 0, "3").otherwise(k.cast("string")).alias("tmdb_id")).join(years, "film_id")
    return P.match_outcomes(targets, _ids(spark, d), films, gone, canon)


@query(f"""WITH {_BASE}, w AS (SELECT film_id, film_id + 2 AS named, CAST(CASE WHEN film_id % 4 = 1 THEN film_id + 1 ELSE film_id + 100000 END AS BIGINT) AS n FROM films WHERE film_id % 2 = 1),
r AS (SELECT w.film_id, 'film ' || CASE WHEN w.film_id % 3 = 0 THEN w.named ELSE w.film_id END || ' (' || CASE WHEN w.film_id % 3 = 0 THEN coalesce(t.year, 1999) ELSE 1999 END || ')' AS key, n FROM w LEFT JOIN films t ON t.film_id = w.named),
h AS (SELECT f.film_id, f.key, CASE WHEN g.film_id IS NOT NULL THEN coalesce(canonical_id, f.film_id) ELSE f.film_id END AS live FROM films f LEFT JOIN gone g ON g.film_id = f.film_id LEFT JOIN canon c ON c.film_id = f.film_id)
SELECT r.film_id, r.key, coalesce(h.live <> r.film_id, false) OR EXISTS (SELECT 1 FROM ids WHERE authority = 'imdb' AND value = 'tt' || r.n AND ids.film_id <> r.film_id) AS refused FROM r LEFT JOIN h ON h.key = r.key AND h.film_id <> r.film_id""")
def key_work(spark: SparkSession, d: str) -> DataFrame:
    """Odd films become works of another title and year, under ids that others may hold."""
    k = F.col("film_id")
    films = _films(spark, d)
    theirs = films.select((k - 2).alias("film_id"), F.col("year").alias("theirs"))
    works = films.where(k % 2 == 1).join(theirs, "film_id", "left").select(
        "film_id", _text("Film ", F.when(k % 3 == 0, k + 2).otherwise(k)).alias("title"), F.when(k % 3 == 0, F.coalesce("theirs", F.lit(1999))).otherwise(1999).alias("year"),
        _text("tt", F.when(k % 4 == 1, k + 1).otherwise(k + 100000)).alias("tt"), F.lit(None).cast("string").alias("tmdb_id"),
    )
    return P.retitled(works, films, _gone(spark, d), _canon(spark, d), _ids(spark, d))


_REVIEWS = """reviews AS (SELECT event_id AS id, 'tmdb' AS authority, CASE event_id % 3 WHEN 0 THEN 'no-match' WHEN 1 THEN 'no-match-reviewed' ELSE 'id-conflict' END AS reason, user_id AS film_id, CAST(event_id % 4 AS VARCHAR) AS value, event_type = 'click' AS resolved FROM events WHERE event_id % 2 = 0)"""


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    e, k = _rows(spark, d, "events", "event_id")
    reason = F.when(k % 3 == 0, "no-match").when(k % 3 == 1, "no-match-reviewed").otherwise("id-conflict")
    return e.where(k % 2 == 0).select(k.alias("id"), F.lit("tmdb").alias("authority"), reason.alias("reason"), F.col("user_id").alias("film_id"), (k % 4).cast("string").alias("value"), (F.col("event_type") == "click").alias("resolved"))


@query(f"""WITH {_REVIEWS}, e AS (SELECT DISTINCT 'id-conflict' AS reason, c_custkey AS film_id, CAST(c_custkey % 4 AS VARCHAR) AS value FROM customer)
SELECT reason, film_id, value FROM e WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE NOT resolved AND r.reason = e.reason AND r.film_id = e.film_id) AND NOT EXISTS (SELECT 1 FROM reviews r WHERE resolved AND r.reason = e.reason AND r.film_id = e.film_id AND r.value = e.value)""")
def review_queue_once(spark: SparkSession, d: str) -> DataFrame:
    c, k = _rows(spark, d, "customer", "c_custkey")
    entries = c.select(F.lit("id-conflict").alias("reason"), k.alias("film_id"), (k % 4).cast("string").alias("value"))
    return P.queue_once(entries, _reviews(spark, d), "tmdb")


@query(f"""WITH {_REVIEWS} SELECT c_custkey AS film_id FROM customer WHERE c_custkey NOT IN (SELECT film_id FROM reviews WHERE NOT resolved AND reason <> 'no-match') AND c_custkey NOT IN (SELECT film_id FROM reviews WHERE resolved AND reason IN ('no-match', 'no-match-reviewed'))""")
def no_match_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return P.rebuilt_no_match(A.table(spark, d, "customer").select(F.col("c_custkey").alias("film_id")), _reviews(spark, d))


_WORK = f"""{_BASE}, {_REVIEWS}, work AS (SELECT id AS review_id, film_id, reason = 'no-match-reviewed' AS promoted FROM reviews r WHERE NOT resolved AND (reason = 'no-match' OR (reason = 'no-match-reviewed' AND NOT EXISTS (SELECT 1 FROM reviews x WHERE x.film_id = r.film_id AND x.reason = 'no-match' AND NOT x.resolved)))
  AND film_id IN (SELECT film_id FROM films) AND film_id NOT IN (SELECT film_id FROM gone))"""


@query(f"WITH {_WORK} SELECT review_id, film_id, promoted FROM work")
def no_match_worklist(spark: SparkSession, d: str) -> DataFrame:
    return P.no_match_worklist(_films(spark, d), _reviews(spark, d), _gone(spark, d))


@query(f"""WITH {_WORK}, w AS (SELECT film_id, bool_and(promoted) AS promoted FROM work GROUP BY film_id), e AS (SELECT w.*, i.value AS own_tt, t.value AS own_tmdb, w.film_id % 6 = 0 AS found, CASE WHEN w.film_id % 4 = 0 THEN w.film_id + w.film_id % 5 END AS look, CASE WHEN w.film_id % 9 = 0 THEN 'review' ELSE 'match' END AS kind,
  w.film_id + w.film_id % 7 AS n FROM w LEFT JOIN ids i ON i.film_id = w.film_id AND i.authority = 'imdb' LEFT JOIN ids t ON t.film_id = w.film_id AND t.authority = 'tmdb')
SELECT film_id, CASE WHEN promoted THEN 'review-open' WHEN own_tt IS NOT NULL AND own_tmdb IS NOT NULL AND found THEN 'linked' WHEN own_tt IS NOT NULL THEN CASE WHEN look IS NULL THEN 'unlinked'
  WHEN EXISTS (SELECT 1 FROM ids WHERE authority = 'tmdb' AND value = CAST(look AS VARCHAR) AND ids.film_id <> e.film_id) THEN 'conflict' ELSE 'keyed' END
  WHEN kind <> 'match' THEN 'review' WHEN EXISTS (SELECT 1 FROM ids WHERE ids.film_id <> e.film_id AND ((authority = 'imdb' AND value = 'tt' || n) OR (authority = 'tmdb' AND value = CAST(n AS VARCHAR)))) THEN 'conflict' ELSE 'match' END AS verdict FROM e""")
def no_match_audit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("film_id")
    work = P.no_match_worklist(_films(spark, d), _reviews(spark, d), _gone(spark, d)).groupBy("film_id").agg(F.min("promoted").alias("promoted"))
    n = k + k % 7
    work = work.select("film_id", "promoted", F.when(k % 4 == 0, (k + k % 5).cast("string")).alias("lookup_tmdb"), F.when(k % 9 == 0, "review").otherwise("match").alias("kind"), _text("tt", n).alias("tt"), n.cast("string").alias("tmdb_id"))
    return P.no_match_verdicts(work, _ids(spark, d), _films(spark, d).where(k % 6 == 0))


@query(f"""WITH {_BASE}, t AS (SELECT film_id, CASE WHEN film_id % 10 = 0 THEN NULL WHEN film_id % 9 = 0 THEN 'review' ELSE 'match' END AS kind, film_id + film_id % 7 AS n, film_id % 4 <> 0 AS known FROM films)
SELECT film_id, CASE WHEN kind IS NULL THEN 'failed' WHEN kind <> 'match' THEN 'reviewed' WHEN EXISTS (SELECT 1 FROM ids WHERE ids.film_id <> t.film_id AND ((authority = 'imdb' AND value = 'tt' || n) OR (known AND authority = 'tmdb' AND value = CAST(n AS VARCHAR)))) THEN 'held' WHEN known THEN 'keyed' ELSE 'unlinked' END AS outcome FROM t""")
def keying_pass(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("film_id")
    n = k + k % 7
    targets = _films(spark, d).select("film_id", F.when(k % 10 == 0, None).otherwise(F.when(k % 9 == 0, "review").otherwise("match")).alias("kind"), _text("tt", n).alias("tt"), F.when(k % 4 != 0, n.cast("string")).alias("tmdb_id"))
    return P.keying_outcomes(targets, _ids(spark, d))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    e, k = _rows(spark, d, "events", "event_id")
    source = F.when(F.col("event_type") == "click", "metacritic").when(F.col("event_type") == "view", "apple-tv").when(F.col("event_type") == "error", "criterion").otherwise("other")
    return e.select(k.alias("id"), F.col("user_id").alias("film_id"), source.alias("authority"), _text("Said ", k).alias("title_ingested"), F.when(k % 3 != 0, (1900 + k % 100).cast("int")).alias("year_claimed"), F.when(k % 2 == 0, (k % 90).cast("int")).alias("runtime_min"))


@query(f"""WITH {_BASE}, c AS (SELECT event_id AS id, user_id AS film_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 1 END AS place, CASE event_type WHEN 'click' THEN 'metacritic' WHEN 'view' THEN 'apple-tv' WHEN 'error' THEN 'criterion' END AS authority, 'Said ' || event_id AS said,
  CASE WHEN event_id % 3 <> 0 THEN CAST(1900 + event_id % 100 AS INT) END AS y, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 90 AS INT) END AS runtime FROM events WHERE event_type IN ('click', 'view', 'error')),
b AS (SELECT film_id, arg_min(id, (place, id)) AS id FROM c GROUP BY film_id), r AS (SELECT film_id, min(id) AS id FROM c WHERE authority = 'apple-tv' GROUP BY film_id)
SELECT f.film_id, coalesce(c.said, f.title) AS title, coalesce(c.y, f.year) AS year, coalesce(c.authority, 'unknown') AS source, p.p_brand AS director, a.runtime AS runtime_min
FROM films f JOIN part p ON p.p_partkey = f.film_id LEFT JOIN b ON b.film_id = f.film_id LEFT JOIN c ON c.id = b.id LEFT JOIN r ON r.film_id = f.film_id LEFT JOIN c a ON a.id = r.id""")
def film_queries(spark: SparkSession, d: str) -> DataFrame:
    return P.film_queries(_films(spark, d), _claims(spark, d))


@query(f"""WITH {_BASE}, {A.LISTINGS_SQL}, e AS (SELECT l.film_id, 'criterion' AS authority, l.url AS value FROM listings l JOIN films USING (film_id) WHERE source = 'criterion'
  UNION ALL SELECT film_id, 'metacritic', 's' || film_id FROM films WHERE film_id % 4 = 0 AND film_id % 3 <> 0 UNION ALL SELECT film_id, 'apple-tv', title FROM films WHERE film_id % 6 = 0)
SELECT film_id, authority, value FROM e WHERE NOT (authority = 'apple-tv' AND film_id % 12 = 0)""")
def claims_backfill(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("film_id")
    films = _films(spark, d)
    ids = films.where(k % 4 == 0).select("film_id", F.lit("metacritic").alias("authority"), _text("s", k).alias("value"))
    staged = films.where(k % 3 != 0).select(_text("s", k).alias("slug"), "title", "year")
    claims = films.where(k % 12 == 0).select(F.lit("apple-tv").alias("authority"), F.col("title").alias("value"))
    return P.claims_from_evidence(ids, A.listings(spark, d), staged, films.where(k % 6 == 0), films, claims).select("film_id", "authority", "value")


@query("""SELECT c_custkey AS query_id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 3 <> 0 AND c_custkey % 4 < 2 END AS answer FROM customer""")
def arbiter(spark: SparkSession, d: str) -> DataFrame:
    """Whether a title of the name within a year of the claimed one was found; editions do not count as other names."""
    c, k = _rows(spark, d, "customer", "c_custkey")
    asked = c.select(k.alias("query_id"), _text("Film ", k, " (Director's Cut)").alias("title"), (1900 + k % 100).cast("int").alias("year"))
    results = c.select(k.alias("query_id"), F.lit("Other").alias("title"), F.when(k % 3 != 0, _text("FILM ", k)).alias("original_title"), (1900 + k % 100 + k % 4).cast("int").alias("year"))
    return P.arbitrated(asked, results, c.where(k % 10 == 0).select(k.alias("query_id")))


@query(f"WITH {_BASE} SELECT film_id FROM films WHERE film_id % 2 = 0 AND film_id % 3 <> 0 AND film_id % 5 <> 0 AND film_id % 7 <> 0")
def link_audit(spark: SparkSession, d: str) -> DataFrame:
    """Links of even films where neither TMDB's title nor its original nor another one of its titles is ours."""
    k, title = F.col("film_id"), F.col("title")
    linked = _films(spark, d).where(k % 2 == 0).select(
        "film_id", "title", F.when(k % 3 == 0, F.upper(title)).otherwise("Another").alias("tmdb_title"), F.when(k % 5 == 0, title).alias("tmdb_original"),
        F.when(k % 7 == 0, F.array(F.lit("A third"), F.concat(title, F.lit("!")))).alias("alternatives"),
    )
    return P.link_suspects(linked).select("film_id")


@query(f"""WITH {_BASE}, k AS (SELECT film_id, film_id // 4 AS work FROM films), c AS (SELECT film_id, work, film_id % 4 AS part FROM k WHERE film_id % 4 > 0 AND film_id % 3 <> 2)
SELECT film_id, CASE WHEN part = 3 AND work % 5 = 0 THEN 'csv-mismatch' WHEN work % 7 = 0 THEN 'conflict' WHEN EXISTS (SELECT 1 FROM films f WHERE f.film_id = work * 4) AND work > 0 THEN 'twin' ELSE 'no-twin' END AS verdict,
  CASE WHEN NOT (part = 3 AND work % 5 = 0) AND work % 7 <> 0 AND work > 0 THEN work * 4 END AS twin_id FROM c""")
def edition_audit(spark: SparkSession, d: str) -> DataFrame:
    """Four films to a work, of which the first is the work itself and holds its id; some works' ids are third films', some rows are no editions."""
    k = F.col("film_id")
    work, part = F.floor(k / 4), k % 4
    title = F.when(part == 0, _text("Work ", work)).when((part == 3) & (work % 5 == 0), _text("Unlike ", k)).otherwise(_text("Work ", work, F.when(part == 1, " (Final Cut)").when(part == 2, " (Uncut)").otherwise(" (Restored)")))
    films = _films(spark, d).withColumn("title", title).withColumn("year", F.when(part == 0, 1980).otherwise((1990 + k % 4).cast("int")))
    films = films.withColumn("key", X.film_key(F.col("title"), F.col("year")))
    named = films.where((part > 0) & (k % 3 != 2)).select("film_id", _text("Work ", work).alias("work_title"), F.lit(1980).alias("work_year"), _text("tt", work * 4).alias("tt"), _text("w", work).alias("tmdb_id"))
    ids = films.where((part == 0) & (work > 0)).select("film_id", F.lit("tmdb").alias("authority"), _text("w", work).alias("value"))
    third = films.where((part == 0) & (work % 7 == 0)).select((k + 1000000).alias("film_id"), F.lit("imdb").alias("authority"), _text("tt", k).alias("value"))
    # the work that no film stands for
    third = third.union(spark.createDataFrame([(1000000, "imdb", "tt0")], "film_id long, authority string, value string"))
    none = films.select("film_id", F.lit("").alias("kind")).limit(0)
    return P.edition_groups(named, films, ids.unionByName(third), none, none.select("film_id", F.col("film_id").alias("canonical_id")))


@query(f"""WITH {_BASE}, f AS (SELECT event_id AS pos, user_id AS film_id, 'https://old.example/' || event_id AS url, CASE WHEN event_type = 'error' THEN 'gone' WHEN event_type = 'signup' THEN 'supplement' ELSE 'film' END AS answer, CASE WHEN event_type NOT IN ('error', 'signup') THEN 'm' || (event_id % 400) END AS mediaid, user_id % 15 = 0 AS is_hidden FROM events),
h AS (SELECT f.*, holder FROM f LEFT JOIN held ON authority = 'criterion' AND value = mediaid), c AS (SELECT mediaid, min(pos) AS first_pos, arg_min(film_id, pos) AS first_film FROM h WHERE answer = 'film' AND NOT is_hidden AND holder IS NULL GROUP BY mediaid)
SELECT h.film_id, url, CASE WHEN answer <> 'film' THEN answer WHEN is_hidden THEN 'tombstoned' WHEN holder IS NULL AND pos = first_pos THEN 'film' WHEN coalesce(holder, first_film) = h.film_id THEN 'same-film' ELSE 'held' END AS kind FROM h LEFT JOIN c USING (mediaid)""")
def bridge(spark: SparkSession, d: str) -> DataFrame:
    e, k = _rows(spark, d, "events", "event_id")
    answer = F.when(F.col("event_type") == "error", "gone").when(F.col("event_type") == "signup", "supplement").otherwise("film")
    forwards = e.select(F.col("user_id").alias("film_id"), k.alias("pos"), _text("https://old.example/", k).alias("url"), answer.alias("answer"), F.when(answer == "film", _text("m", k % 400)).alias("mediaid"), (F.col("user_id") % 15 == 0).alias("is_hidden"))
    return P.bridge_outcomes(forwards, _held(spark, d).where("authority = 'criterion'"))


@query(f"""WITH {A.LISTINGS_SQL}, b AS (SELECT event_id AS pos, user_id % 200 + 1 AS film_id, CASE WHEN event_id % 3 = 0 THEN 'https://w.example/' || (user_id % 200 + 1) || '/1' ELSE 'x' END AS old_url, 'https://new.example/' || event_id AS url FROM events)
SELECT b.film_id, arg_min(b.url, (CASE WHEN old_url = l.url THEN 0 ELSE 1 END, pos)) AS url FROM b JOIN listings l ON l.film_id = b.film_id AND l.source = 'criterion' GROUP BY b.film_id""")
def bridge_urls(spark: SparkSession, d: str) -> DataFrame:
    e, k = _rows(spark, d, "events", "event_id")
    film = F.col("user_id") % 200 + 1
    bindings = e.select(k.alias("pos"), film.alias("film_id"), F.when(k % 3 == 0, _text("https://w.example/", film, "/1")).otherwise("x").alias("old_url"), _text("https://new.example/", k).alias("url"))
    return P.bridged_urls(A.listings(spark, d), bindings)


@query("""SELECT p_partkey AS film_id, CASE WHEN p_partkey % 3 = 0 THEN 'https://s.example/films/b' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/slug' ELSE '' END ELSE 'https://s.example/films/a' || p_partkey END AS url FROM part""")
def walk_urls(spark: SparkSession, d: str) -> DataFrame:
    """A stored address stays if it names any of the two ids; a longer id that only begins alike does not count."""
    p, k = _rows(spark, d, "part", "p_partkey")
    path = F.when(k % 3 == 0, F.concat(_text("https://s.example/films/b", k), F.when(k % 2 == 0, "/slug").otherwise(""))).when(k % 3 == 1, _text("https://s.example/films/b", k, "0")).otherwise("old")
    ids = p.select(k.alias("film_id"), F.posexplode(F.array(_text("a", k), _text("b", k))).alias("pos", "mediaid"))
    return P.listing_urls(p.where(k % 5 != 7).select(k.alias("film_id"), path.alias("url")), ids, "https://s.example/films/{}")


def _walk_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = A.listings(spark, d).withColumn("last_seen", F.when(F.col("film_id") % 2 == 0, F.lit(A.TODAY).cast("date")).otherwise(F.col("last_seen"))).withColumn("leaving_date", F.when(F.col("film_id") % 3 == 0, "October 31"))
    ids = A.table(spark, d, "part").select(F.col("p_partkey").alias("film_id"), F.lit("criterion").alias("authority"), _text("m", F.col("p_partkey")).alias("value"))
    return rows, ids, ids.where("film_id % 5 = 0").select(F.col("value").alias("mediaid"), F.lit("November 30").alias("label"))


_WALK = f"{A.LISTINGS_SQL}, w AS (SELECT film_id, source, CASE WHEN film_id % 2 = 0 THEN DATE '{A.TODAY}' ELSE last_seen END AS last_seen, CASE WHEN film_id % 3 = 0 THEN 'October 31' END AS leaving_date FROM listings)"


@query(f"WITH {_WALK} SELECT film_id, source, CASE WHEN source <> 'criterion' THEN leaving_date WHEN last_seen = DATE '{A.TODAY}' AND film_id % 5 = 0 THEN 'November 30' END AS leaving_date FROM w")
def walk_labels(spark: SparkSession, d: str) -> DataFrame:
    rows, ids, labels = _walk_tables(spark, d)
    return P.walk_leaving(rows, ids, labels, A.TODAY).select("film_id", "source", "leaving_date")


@query(f"WITH {_WALK} SELECT film_id, source, CASE WHEN source = 'criterion' AND last_seen < DATE '{A.TODAY}' THEN NULL ELSE leaving_date END AS leaving_date FROM w")
def walk_labels_unread(spark: SparkSession, d: str) -> DataFrame:
    rows, ids, _ = _walk_tables(spark, d)
    return P.walk_leaving(rows, ids, None, A.TODAY).select("film_id", "source", "leaving_date")


@query(f"""WITH {A.LISTINGS_SQL}, s AS (SELECT p_partkey AS film_id FROM part WHERE p_partkey % 2 = 0), l AS (SELECT s.film_id, x.last_seen FROM s LEFT JOIN listings x ON x.film_id = s.film_id AND x.source = 'criterion')
SELECT 'relaunch' AS kind, film_id FROM l WHERE last_seen IS NULL OR last_seen < DATE '1997-03-10' UNION ALL SELECT 'plain', film_id FROM l WHERE last_seen IS NULL OR last_seen < DATE '2001-01-01'""")
def walk_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Tonight's arrivals with and without the grace window of a relaunch."""
    seen, rows = A.every(spark, d, 2), A.listings(spark, d)
    one = lambda kind, relaunch: P.walk_arrivals(seen, rows, "2001-01-01", relaunch).select(F.lit(kind).alias("kind"), "film_id")
    return one("relaunch", "1997-03-10").union(one("plain", None))


@query("SELECT event_id, CAST(ts AS DATE) <= DATE '2024-01-10' + 30 AS quiet FROM events")
def relaunch_window(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select("event_id", P.in_relaunch(F.lit("2024-01-10").cast("date"), F.to_date("ts")).alias("quiet"))


@query(f"""WITH {_BASE}, {_INCOMING}, e AS (SELECT p.*, 'm' || (item_id % 3000) AS mediaid, item_id % 21 <> 0 AS record, CASE WHEN item_id % 19 = 0 THEN NULL WHEN item_id % 6 = 1 THEN 'review' ELSE 'match' END AS kind, item_id % 22 = 0 AS vetoed, item_id % 17 = 0 AS covered FROM placed p),
h AS (SELECT e.*, o.holder AS own, k.key IS NOT NULL AS k_held FROM e LEFT JOIN held o ON o.authority = 'criterion' AND o.value = e.mediaid LEFT JOIN films k ON k.key = e.key),
a AS (SELECT *, coalesce(own IS NULL AND NOT covered AND kind = 'match' AND record AND tt IS NOT NULL AND holder IS NULL AND NOT vetoed AND NOT k_held, false) AS able FROM h),
b AS (SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able, tt ORDER BY item_id) END = 1 AS first FROM a), c AS (SELECT *, coalesce(first, false) AS f1 FROM b),
f AS (SELECT *, CASE WHEN f1 THEN row_number() OVER (PARTITION BY f1, key ORDER BY item_id) END AS by_key FROM c), g AS (SELECT *, bool_or(by_key = 1) OVER (PARTITION BY tt) AS made FROM f)
SELECT item_id, CASE WHEN own IS NOT NULL THEN 'listed' WHEN covered THEN 'waiting' WHEN NOT record THEN 'no-record' WHEN kind IS NULL THEN 'skipped' WHEN kind <> 'match' OR tt IS NULL THEN 'no-match' WHEN holder IS NOT NULL AND hidden THEN 'blocked' WHEN holder IS NOT NULL THEN 'held'
  WHEN vetoed THEN 'blocked' WHEN k_held THEN 'key-collision' WHEN by_key = 1 THEN 'created' WHEN made THEN 'joins' ELSE 'key-collision' END AS decision FROM g""")
def catalog_walk(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id")
    items = _incoming(spark, d).withColumns(
        {"pos": k, "mediaid": _text("m", k % 3000), "record": k % 21 != 0, "kind": F.when(k % 19 == 0, None).otherwise(F.when(k % 6 == 1, "review").otherwise("match")), "vetoed": k % 22 == 0}
    )
    # an id of the catalogue stands once: the item's own number makes it so, its last digits are what titles may hold
    named = items.withColumn("mediaid", _text(F.col("mediaid"), "/", k))
    ids = P.holders(_ids(spark, d), _canon(spark, d), _gone(spark, d))
    own = items.select(F.col("mediaid").alias("value"), _text(F.col("mediaid"), "/", k).alias("full")).join(ids.where("authority = 'criterion'"), "value").select("authority", F.col("full").alias("value"), "holder", "hidden")
    found = P.walk_decisions(named, ids.where("authority <> 'criterion'").unionByName(own), named.where(k % 17 == 0), _films(spark, d))
    return found.select(F.split_part("mediaid", F.lit("/"), F.lit(2)).cast("long").alias("item_id"), "decision")


@query(f"""WITH {_BASE}, t AS (SELECT film_id FROM films WHERE film_id % 7 <> 0), e AS (SELECT t.film_id, CASE WHEN film_id % 3 = 0 AND film_id % 4 <> 0 THEN film_id + film_id % 5 END AS one, CASE WHEN film_id % 2 = 0 THEN film_id + film_id % 6 END AS two, CASE WHEN film_id % 2 = 0 THEN CASE WHEN film_id % 8 = 0 THEN 2 ELSE 1 END ELSE 0 END AS n FROM t),
h AS (SELECT e.*, coalesce(one % 7 = 0 AND one <> film_id AND EXISTS (SELECT 1 FROM films f WHERE f.film_id = one), false) AS one_taken, coalesce(two % 7 = 0 AND two <> film_id AND EXISTS (SELECT 1 FROM films f WHERE f.film_id = two), false) AS two_taken FROM e),
o AS (SELECT *, CASE WHEN one IS NOT NULL AND NOT one_taken THEN 'by-imdb' WHEN n = 1 AND NOT two_taken THEN 'by-search' WHEN one_taken OR (n = 1 AND two_taken) THEN 'held' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome FROM h)
SELECT film_id, CASE outcome WHEN 'by-imdb' THEN CAST(one AS VARCHAR) WHEN 'by-search' THEN CAST(two AS VARCHAR) END AS itunes_id, outcome FROM o""")
def store_resolve(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("film_id")
    targets = _films(spark, d).where(k % 7 != 0).select("film_id", _text("tt", k).alias("imdb_id"))
    by_imdb = targets.where(k % 3 == 0).select("imdb_id", (k + k % 5).cast("string").alias("itunes_id"), (k % 4 == 0).alias("removed"))
    by_search = targets.where(k % 2 == 0).select("film_id", (k + k % 6).cast("string").alias("itunes_id"), F.when(k % 8 == 0, 2).otherwise(1).alias("n"))
    return P.store_outcomes(targets, by_imdb, by_search, _ids(spark, d))


@query(f"""WITH {_BASE}, live AS (SELECT ids.* FROM ids WHERE film_id NOT IN (SELECT film_id FROM gone)), w AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS itunes_id, c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT value FROM live WHERE authority = 'itunes')),
e AS (SELECT w.*, CASE WHEN c_custkey % 5 <> 0 THEN 'tt' || (c_custkey % 300) END AS tt FROM w), r AS (SELECT e.*, l.film_id FROM e LEFT JOIN live l ON l.authority = 'imdb' AND l.value = e.tt)
SELECT itunes_id, CASE WHEN tt IS NOT NULL AND film_id IS NOT NULL AND itunes_id NOT IN (SELECT value FROM ids WHERE authority = 'itunes') THEN film_id END AS film_id, CASE WHEN tt IS NULL THEN 'no-imdb' WHEN film_id IS NULL OR itunes_id IN (SELECT value FROM ids WHERE authority = 'itunes') THEN 'not-in-catalogue' ELSE 'resolved' END AS outcome FROM r""")
def wishlist_resolve(spark: SparkSession, d: str) -> DataFrame:
    c, k = _rows(spark, d, "customer", "c_custkey")
    known = c.select(k.cast("string").alias("itunes_id"), F.when(k % 5 != 0, _text("tt", k % 300)).alias("imdb_id"))
    return P.wishlist_outcomes(known, known, _ids(spark, d), _gone(spark, d))


@query(f"""WITH {_BASE}, n AS (SELECT film_id, CASE WHEN film_id % 8 = 7 THEN film_id + 1 WHEN film_id % 5 = 0 THEN film_id + 2 ELSE film_id END AS target FROM films WHERE film_id % 2 = 1),
u AS (SELECT n.film_id, f.year AS own, CAST(coalesce(x.year, f.year) AS INT) AS theirs, target FROM n JOIN films f ON f.film_id = n.film_id LEFT JOIN films x ON x.film_id = n.target),
h AS (SELECT f.film_id, f.key, CASE WHEN g.film_id IS NOT NULL THEN coalesce(canonical_id, f.film_id) ELSE f.film_id END AS live FROM films f LEFT JOIN gone g ON g.film_id = f.film_id LEFT JOIN canon c ON c.film_id = f.film_id)
SELECT u.film_id, 'match' AS turn, CASE WHEN u.film_id % 3 = 0 THEN 'still-missed' WHEN u.film_id % 11 = 0 AND u.film_id <> 3 THEN 'id-conflict' WHEN h.live <> u.film_id THEN 'collision' ELSE 'adopted' END AS outcome
FROM u LEFT JOIN h ON h.key = 'film ' || target || ' (' || theirs || ')' AND h.film_id <> u.film_id WHERE u.film_id % 4 = 1
UNION ALL SELECT u.film_id, 'year', CASE WHEN u.film_id % 7 = 0 OR theirs = own THEN 'unchanged' WHEN h.live <> u.film_id THEN 'collision' ELSE 'adopted' END
FROM u LEFT JOIN h ON h.key = 'film ' || target || ' (' || theirs || ')' AND h.film_id <> u.film_id WHERE u.film_id % 4 = 3""")
def rematch(spark: SparkSession, d: str) -> DataFrame:
    """Misses looked up again, without a year so that one is adopted, and years of shops' titles checked."""
    k = F.col("film_id")
    films, gone, canon, updates = _year_case(spark, d)
    missed = updates.where(k % 4 == 1).select("film_id", F.lit(None).cast("int").alias("year"), F.lit(True).alias("commerce"), F.when(k % 3 == 0, None).otherwise(F.when(k % 11 == 0, "3").otherwise(k.cast("string"))).alias("tmdb_id"), F.col("year").alias("winner_year"))
    keyed = updates.where(k % 4 == 3).select("film_id", F.when(k % 7 != 0, F.col("year")).alias("tmdb_year")).join(films.select("film_id", "year"), "film_id")
    return P.rematch_outcomes(missed, keyed, _ids(spark, d), films, gone, canon)


_VERBS = ("film", "tmdb-id", "create", "dismiss", "tt", "none")


@query(f"""WITH {_BASE}, r AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'tmdb' WHEN 1 THEN 'metacritic' WHEN 2 THEN 'list' WHEN 3 THEN 'apple-tv' ELSE 'criterion' END AS authority,
  CASE WHEN event_id % 5 = 1 THEN CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'year-gap' END WHEN event_id % 3 = 0 THEN 'id-conflict' WHEN event_id % 3 = 1 THEN 'year-collision' ELSE 'no-match' END AS reason,
  CASE WHEN event_id % 4 <> 3 THEN user_id END AS own, CAST(event_id % 60 AS VARCHAR) AS about FROM events WHERE event_type <> 'error'),
a AS (SELECT event_id AS id, ['film', 'tmdb-id', 'create', 'dismiss', 'tt', 'none'][CAST(event_id // 7 % 6 AS INT) + 1] AS verb, event_id % 230 AS asked, event_id % 90 AS n FROM events),
j AS (SELECT a.*, r.id AS r_id, authority, reason, own, about, coalesce(canonical_id, asked) AS target FROM a LEFT JOIN r ON r.id = a.id LEFT JOIN canon c ON c.film_id = asked),
k AS (SELECT j.*, g.film_id IS NOT NULL AS gone, f.film_id IS NOT NULL AS known, t.holder AS tt_holder, i.holder AS id_holder, b.holder AS about_id FROM j LEFT JOIN gone g ON g.film_id = target AND g.kind = 'tombstoned' LEFT JOIN films f ON f.film_id = target
  LEFT JOIN held t ON verb = 'tt' AND t.authority = 'imdb' AND t.value = 'tt' || n LEFT JOIN held i ON verb = 'tmdb-id' AND i.authority = 'tmdb' AND i.value = CAST(n AS VARCHAR) LEFT JOIN held b ON b.authority = 'tmdb' AND b.value = about),
o AS (SELECT *, CASE WHEN id % 50 = 0 OR r_id IS NULL OR (verb = 'film' AND (gone OR NOT known)) THEN 'refused' WHEN verb = 'dismiss' THEN 'dismissed'
  WHEN authority = 'criterion' THEN CASE verb WHEN 'film' THEN 'linked' WHEN 'create' THEN 'created' WHEN 'tt' THEN 'keyed' ELSE 'refused' END
  WHEN verb IN ('tt', 'none') THEN CASE WHEN authority <> 'tmdb' OR own IS NULL THEN 'refused' WHEN verb = 'none' THEN 'unkeyed' WHEN tt_holder <> own THEN 'refused' ELSE 'keyed' END
  WHEN authority = 'tmdb' AND verb = 'tmdb-id' AND own IS NOT NULL THEN CASE WHEN id_holder <> own THEN 'refused' ELSE 'matched' END
  WHEN authority = 'tmdb' AND verb = 'film' AND reason <> 'no-match' AND own IS NOT NULL THEN CASE WHEN target = CASE reason WHEN 'year-collision' THEN CAST(about AS BIGINT) ELSE about_id END THEN 'merged' ELSE 'refused' END
  WHEN authority = 'metacritic' AND reason = 'year-gap' THEN CASE verb WHEN 'film' THEN 'linked' WHEN 'create' THEN 'created' ELSE 'refused' END
  WHEN authority = 'list' THEN CASE verb WHEN 'film' THEN 'linked' WHEN 'create' THEN 'created' ELSE 'refused' END
  WHEN authority = 'apple-tv' THEN CASE verb WHEN 'film' THEN 'owned' WHEN 'create' THEN 'created' ELSE 'refused' END ELSE 'refused' END AS outcome FROM k)
SELECT id, outcome, CASE WHEN outcome IN ('linked', 'merged', 'owned') THEN target WHEN outcome IN ('matched', 'keyed', 'unkeyed') THEN own END AS film_id FROM o""")
def review_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on reviews of five authorities; two on one row, or on a closed one, are refused."""
    e, k = _rows(spark, d, "events", "event_id")
    authority = F.element_at(F.array(*map(F.lit, ("tmdb", "metacritic", "list", "apple-tv", "criterion"))), (k % 5 + 1).cast("int"))
    reason = F.when(k % 5 == 1, F.when(k % 3 == 0, "other").otherwise("year-gap")).when(k % 3 == 0, "id-conflict").when(k % 3 == 1, "year-collision").otherwise("no-match")
    reviews = e.select(k.alias("id"), authority.alias("authority"), reason.alias("reason"), F.when(k % 4 != 3, F.col("user_id")).alias("film_id"), (k % 60).cast("string").alias("value"), (F.col("event_type") == "error").alias("resolved"))
    verb = F.element_at(F.array(*map(F.lit, _VERBS)), (F.floor(k / 7) % 6 + 1).cast("int"))
    actions = e.select(k.alias("id"), verb.alias("verb"), (k % 230).alias("film_id"), F.when(verb == "tt", _text("tt", k % 90)).otherwise((k % 90).cast("string")).alias("value"))
    twice = actions.where(k % 50 == 0)
    return P.review_outcomes(reviews, actions.unionByName(twice), _held(spark, d), _films(spark, d), _canon(spark, d), _gone(spark, d))


@query(f"WITH {_BASE} SELECT key FROM films WHERE CASE WHEN film_id % 16 = 0 THEN 15 WHEN film_id % 8 = 0 THEN film_id - 1 ELSE film_id END IN (SELECT film_id FROM gone WHERE kind = 'tombstoned')")
def tombstoned_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are not created again: of hidden titles, and of those merged into hidden ones."""
    k = F.col("film_id")
    canon = _canon(spark, d).withColumn("canonical_id", F.when(k % 16 == 0, 15).otherwise(F.col("canonical_id")).cast("long"))
    return P.tombstoned_keys(_films(spark, d), _gone(spark, d), canon)


def _recheck(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("film_id")
    films = _films(spark, d)
    one = films.select("film_id", _text("tt", k).alias("imdb_id"), _text("a", k).alias("itunes_id"))
    stored = one.unionByName(one.where(k % 3 == 0).withColumn("itunes_id", _text("b", k)))
    states = stored.select("itunes_id", ((F.startswith("itunes_id", F.lit("b")) & (k % 2 == 0)) | (k % 9 == 0)).alias("removed"))
    filed = one.where(k % 10 != 0).select("imdb_id", (k % 4 == 0).alias("removed"))
    relisted = films.where(k % 8 == 0).select("film_id", F.when(k % 16 == 0, _text("a", k + 1)).otherwise(_text("c", k)).alias("new_id"), F.when(k % 5 == 0, 2).otherwise(1).alias("n"))
    ids = stored.select("film_id", F.lit("itunes").alias("authority"), F.col("itunes_id").alias("value"))
    return P.recheck_outcomes(stored, filed, relisted, states, ids)


@query(f"""WITH {_BASE} SELECT film_id, CASE WHEN film_id % 3 = 0 AND (film_id % 9 <> 0) THEN 'live' WHEN film_id % 10 = 0 THEN 'unknown' WHEN film_id % 4 <> 0 THEN 'live' WHEN film_id % 8 <> 0 OR film_id % 5 = 0 THEN 'dead'
  WHEN film_id % 16 = 0 AND film_id + 1 IN (SELECT film_id FROM films) THEN 'held' ELSE 'replaced' END AS outcome FROM films""")
def store_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Stored ids asked about again: some products were removed, of which some are listed anew, some under another title's id."""
    return _recheck(spark, d)[0].select("film_id", "outcome")


@query(f"WITH {_BASE} SELECT film_id, 'b' || film_id AS itunes_id FROM films WHERE film_id % 6 = 0 AND film_id % 9 <> 0")
def store_ids_removed(spark: SparkSession, d: str) -> DataFrame:
    return _recheck(spark, d)[1]


@query(f"""WITH {A.LISTINGS_SQL}, s AS (SELECT * FROM listings WHERE source = 'criterion'), t AS (SELECT p_partkey AS film_id FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(s.film_id, t.film_id) AS film_id, CASE WHEN t.film_id IS NOT NULL THEN 'https://s.example/films/x' || t.film_id ELSE s.url END AS url, CAST(coalesce(s.first_seen, DATE '{A.TODAY}') AS VARCHAR) AS first_seen, CAST(CASE WHEN t.film_id IS NOT NULL THEN DATE '{A.TODAY}' ELSE s.last_seen END AS VARCHAR) AS last_seen
FROM s FULL JOIN t ON t.film_id = s.film_id""")
def walk_write(spark: SparkSession, d: str) -> DataFrame:
    """Listings after a walk that saw every second film under two ids."""
    p, k = _rows(spark, d, "part", "p_partkey")
    items = p.where(k % 2 == 0).select(F.posexplode(F.array(_text("x", k), _text("y", k))).alias("pos", "mediaid"), k.alias("film_id"))
    after = P.walk_listings(A.listings(spark, d), items.select("mediaid", "film_id"), items.select("mediaid", "pos"), A.TODAY, "https://s.example/films/{}")
    return after.withColumns({"first_seen": F.col("first_seen").cast("string"), "last_seen": F.col("last_seen").cast("string")})
