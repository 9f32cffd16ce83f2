"""Queries of the index, of answers to query lines, of writes of several tables at once and of jobs that may stop."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.operators import embedding, fuzzy, ranker, refresh, reports, search, transactions, updates, vectors, views
from lumidex.operators.commits import Tables
from lumidex.operators.text_index import TextIndex
from lumidex.plans import adapters as A
from lumidex.plans.identity import saved, shared_dir
from lumidex.plans.searching import search_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/catalogue-{label}-{uuid.uuid4().hex}"


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def _index(spark: SparkSession, d: str) -> TextIndex:
    """All documents, and a batch in which every seventh changed and every eleventh of the others went; made once a session and folder."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        docs = A.table(spark, d, "documents").select("doc_id", "text")
        index = TextIndex.create(docs, _path(spark, "index"), "doc_id", ["text"])
        changed = docs.where("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("Thonre of the "), F.coalesce("text", F.lit("")), F.lit(" of thonre of")))
        index.apply(changed, docs.where("doc_id % 11 = 0 AND doc_id % 7 <> 0").select("doc_id"), 1)
        _INDEXES[key] = index
    return _INDEXES[key]


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_NOW = f"now AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Thonre of the ' || coalesce(text, '') || ' of thonre of' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 7 = 0), t AS (SELECT doc_id, {_WORDS} AS w FROM now)"


@query(f"""WITH {_NOW}, c AS (SELECT doc_id, len(w) AS length, len(list_filter(w, lambda x: x = 'of')) AS a, len(list_filter(w, lambda x: x = 'thonre')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(length) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / m)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / m)), 6) AS bm25 FROM c, s WHERE a > 0 AND b > 0""")
def index_bm25(spark: SparkSession, d: str) -> DataFrame:
    """bm25 from the index, after a batch of changes."""
    return _index(spark, d).bm25(["of", "thonre"], {"text": 1.0}).select(F.col("key").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(f"""WITH {_NOW}, p AS (SELECT doc_id, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'thonre' AND w[i + 2] = 'of') AS spots FROM t) SELECT doc_id, len(spots) AS n, spots[1] AS first FROM p WHERE len(spots) > 0""")
def index_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Where two words stand in a row, by their positions."""
    found = _index(spark, d).phrase("thonre of")
    return found.select(F.col("key").alias("doc_id"), F.size("at").cast("long").alias("n"), F.get("at", F.lit(0)).cast("long").alias("first"))


@query(f"WITH {_NOW} SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY term")
def index_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of words, kept up by batches and never made anew."""
    return _index(spark, d).vocabulary()


@query("""SELECT p_partkey AS film_id FROM part WHERE list_contains(string_split(lower(p_brand || ' ' || p_type), ' '), 'small') AND regexp_matches(lower(p_brand), '(^|[^a-z0-9])brand([^a-z0-9]|$)')""")
def plot_words(spark: SparkSession, d: str) -> DataFrame:
    """Titles whose overview or plot have all words, in any order and as whole words."""
    return search.field_filter("plot", "Small brand", **search_tables(spark, d))


@query()
def fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every part's name, with its third letter gone, against the names of all parts, in one join."""
    parts = A.table(spark, d, "part")
    names = parts.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("weight")).withColumn("key", F.col("name"))
    terms = names.select(F.col("name").alias("term_id"), F.concat(F.substring("name", 1, 2), F.substring("name", 4, 100)).alias("value"))
    return fuzzy.similar(terms, names)


@query("""SELECT 'correction' AS kind, 'director' AS field, 'Suplier#000000004' AS typed, s_name AS name, CAST(1 AS INT) AS place FROM supplier WHERE s_suppkey = 4
UNION ALL SELECT 'hint', '', '', 'no field is named nofield', 1
UNION ALL SELECT 'hint', 'character', 'xy', '''xy'' is too short to correct: three characters or more are needed', 1""")
def search_notes(spark: SparkSession, d: str) -> DataFrame:
    """What a query line says beside its rows: a name used for another, and hints."""
    return search.answer("nofield: z director: Suplier#000000004 character: xy", **search_tables(spark, d)).notes


@query("""WITH k AS (SELECT DISTINCT p_name AS keyword FROM part) SELECT keyword AS key FROM k WHERE keyword = 'small ring'""")
def keyword_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The keyword that a free text is taken for where no stem joins them."""
    return search.keyword_ladder(search_tables(spark, d)["keywords"], "small rring").select("key")


# writes of several tables


def _catalogue(spark: SparkSession, d: str) -> Tables:
    """A store of the tables that a walk writes."""
    tables = Tables(spark, _path(spark, "store"))
    part = A.table(spark, d, "part")
    k = F.col("p_partkey")
    name = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    tables.commit({
        "films": part.select(k.alias("film_id"), name("k").alias("key"), F.col("p_name").alias("title"), (F.col("p_size") + 1950).cast("int").alias("year"), F.col("p_brand").alias("director")),
        "listings": A.listings(spark, d),
        "external_ids": part.where("p_partkey % 4 = 0").select(k.alias("film_id"), F.lit("criterion").alias("authority"), name("m").alias("value")),
        "claims": part.where("p_partkey % 8 = 0").select(k.alias("film_id"), F.lit("criterion").alias("authority"), name("m").alias("value"), F.col("p_name").alias("title"), F.lit(None).cast("int").alias("year"), F.lit("1999-01-01").cast("date").alias("made_on")),
    })
    tables.commit(declared={"transitions": "film_id long, source string, appeared_on date", "reviews": "film_id long, value string, reason string, detail string"})
    return tables


@query(f"""WITH {A.LISTINGS_SQL}, own AS (SELECT * FROM listings WHERE source = 'criterion'), n AS (SELECT max(p_partkey) AS last, max(film_id) AS x FROM part, own), f AS (SELECT max(last_seen) AS frontier FROM own),
new AS (SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY 'new' || p_partkey) AS film_id, p_partkey FROM part WHERE p_partkey % 20 = 0),
seen AS (SELECT p_partkey AS film_id FROM part WHERE p_partkey % 3 = 0 UNION SELECT film_id FROM new),
arrived AS (SELECT s.film_id FROM seen s LEFT JOIN own o ON o.film_id = s.film_id WHERE o.last_seen IS NULL OR o.last_seen < (SELECT frontier FROM f))
SELECT 'films' AS name, count(*) + (SELECT count(*) FROM new) AS n, CAST(sum(p_partkey) + (SELECT sum(film_id) FROM new) AS BIGINT) AS total FROM part
UNION ALL SELECT 'listings', count(*), CAST(sum(film_id) AS BIGINT) FROM (SELECT film_id, source FROM listings UNION SELECT film_id, 'criterion' FROM seen)
UNION ALL SELECT 'today', count(*), CAST(sum(film_id) AS BIGINT) FROM seen
UNION ALL SELECT 'external_ids', (SELECT count(*) FROM part WHERE p_partkey % 4 = 0) + count(*), CAST((SELECT sum(p_partkey) FROM part WHERE p_partkey % 4 = 0) + sum(film_id) AS BIGINT) FROM new
UNION ALL SELECT 'claims', count(*), CAST(sum(film_id) AS BIGINT) FROM (SELECT p_partkey AS film_id, 'm' || p_partkey AS value FROM part WHERE p_partkey % 8 = 0 OR p_partkey % 3 = 0 UNION SELECT film_id, 'n' || p_partkey FROM new)
UNION ALL SELECT 'transitions', count(*), CAST(coalesce(sum(film_id), 0) AS BIGINT) FROM (SELECT film_id FROM arrived WHERE film_id NOT IN (SELECT s.film_id FROM seen s JOIN own o ON o.film_id = s.film_id WHERE o.last_seen >= (SELECT frontier FROM f)))""")
def walk_commit(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a store after a walk that saw every third title and made new ones, all in one commit that a rerun leaves alone."""
    tables = _catalogue(spark, d)
    part, k = A.table(spark, d, "part"), F.col("p_partkey")
    mediaid = F.when(k % 20 == 0, F.concat(F.lit("n"), k.cast("string"))).otherwise(F.concat(F.lit("m"), k.cast("string")))
    old = part.where("p_partkey % 3 = 0").select(k.alias("film_id"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.concat(F.lit("m"), k.cast("string")).alias("mediaid"), F.col("p_name").alias("title"), F.lit(1999).alias("year"), F.lit(False).alias("bind"))
    created = part.where("p_partkey % 20 = 0").select(F.concat(F.lit("new"), k.cast("string")).alias("key"), F.col("p_name").alias("title"), F.lit(2001).alias("year"), F.lit("").alias("director"))
    new = part.where("p_partkey % 20 = 0").select(F.lit(None).cast("long").alias("film_id"), F.concat(F.lit("new"), k.cast("string")).alias("key"), mediaid.alias("mediaid"), F.col("p_name").alias("title"), F.lit(2001).alias("year"), F.lit(True).alias("bind"))
    decided = old.unionByName(new)
    items = decided.select("mediaid", F.xxhash64("mediaid").alias("pos"))
    for _ in range(2):
        state = transactions.record_walk(tables, decided, items, created, tables.read("reviews"), None, A.TODAY, "https://s.example/films/{}", number=1)
    read = lambda n: tables.read(n, state)
    today = read("listings").where((F.col("source") == "criterion") & (F.col("last_seen") == F.lit(A.TODAY).cast("date")))
    rows = {"films": read("films"), "listings": read("listings"), "today": today, "external_ids": read("external_ids"), "claims": read("claims"), "transitions": read("transitions")}
    total = None
    for name, df in rows.items():
        one = df.agg(F.count("*").alias("n"), F.coalesce(F.sum("film_id"), F.lit(0)).alias("total")).select(F.lit(name).alias("name"), "n", "total")
        total = one if total is None else total.unionByName(one)
    return total


@query("""WITH m AS (SELECT p_partkey AS film_id, p_partkey - 1 AS survivor FROM part WHERE p_partkey % 6 = 0), w AS (SELECT DISTINCT coalesce(survivor, p_partkey) AS film_id FROM part LEFT JOIN m ON film_id = p_partkey WHERE p_partkey % 5 <= 1),
k AS (SELECT DISTINCT coalesce(survivor, p_partkey) AS film_id, p_type AS keyword FROM part LEFT JOIN m ON film_id = p_partkey)
SELECT 'dispositions' AS name, count(*) AS n, CAST(sum(film_id) AS BIGINT) AS total FROM m UNION ALL SELECT 'film_keyword', count(*), CAST(sum(film_id) AS BIGINT) FROM k UNION ALL SELECT 'watchlist', count(*), CAST(sum(film_id) AS BIGINT) FROM w""")
def merge_commit(spark: SparkSession, d: str) -> DataFrame:
    """Every table of a store after merges, all in one commit."""
    tables = Tables(spark, _path(spark, "store"))
    part, k = A.table(spark, d, "part"), F.col("p_partkey").alias("film_id")
    tables.commit({"watchlist": part.where("p_partkey % 5 <= 1").select(k, F.lit("2001-01-01").cast("date").alias("added_on")), "film_keyword": part.select(k, F.col("p_type").alias("keyword"))}, declared={"dispositions": "film_id long, kind string, survivor_id long"})
    state = transactions.merge_films(tables, part.where("p_partkey % 6 = 0").select(k, (F.col("p_partkey") - 1).alias("survivor_id")), saved, number=1)
    total = None
    for name in ("dispositions", "film_keyword", "watchlist"):
        one = tables.read(name, state).agg(F.count("*").alias("n"), F.sum("film_id").alias("total")).select(F.lit(name).alias("name"), "n", "total")
        total = one if total is None else total.unionByName(one)
    return total


# jobs that may stop

_LOOKUPS = "l AS (SELECT CAST(event_id % 3 AS INT) AS pass, event_id // 3 + 1 AS pos, user_id AS film_id, CASE WHEN event_id > 450 AND event_id % 3 = 1 AND value < 97 THEN 'failed' WHEN value < 20 THEN 'failed' WHEN value < 22 THEN 'invalid' WHEN value < 24 THEN 'gone' ELSE 'answered' END AS outcome FROM events)"


@query(f"""WITH {_LOOKUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY pos) AS rank FROM l WHERE outcome <> 'invalid'),
f AS (SELECT pass, pos, sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY pass ORDER BY rank ROWS 4 PRECEDING) AS n FROM r),
stops AS (SELECT pass, min(pos) + 1 AS stop FROM f WHERE n = 5 GROUP BY pass), e AS (SELECT pass, stop FROM stops WHERE stop <= (SELECT max(pos) FROM l x WHERE x.pass = stops.pass) ORDER BY pass LIMIT 1)
SELECT l.pass, l.pos, film_id, CASE WHEN l.pass > (SELECT pass FROM e) OR (l.pass = (SELECT pass FROM e) AND l.pos >= (SELECT stop FROM e)) THEN 'stopped' WHEN outcome = 'invalid' THEN 'skipped' WHEN outcome = 'failed' THEN 'carried' ELSE 'refreshed' END AS state FROM l""")
def provider_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A refresh in three passes whose lookups begin to fail in the second."""
    k, v = F.col("event_id"), F.col("value")
    outcome = F.when((k > 450) & (k % 3 == 1) & (v < 97), "failed").when(v < 20, "failed").when(v < 22, "invalid").when(v < 24, "gone").otherwise("answered")
    return refresh.refresh_outcomes(A.table(spark, d, "events").select((k % 3).cast("int").alias("pass"), (F.floor(k / 3) + 1).alias("pos"), F.col("user_id").alias("film_id"), outcome.alias("outcome")))


# single rows of the survey


@query("""WITH o AS (SELECT p_partkey AS film_id, CAST(p_partkey * 10 AS INT) AS tmdb_id, '[]' AS trailers FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey AS film_id, CAST(p_partkey * 11 AS INT) AS tmdb_id, '["t' || p_partkey || '"]' AS trailers FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(n.film_id, o.film_id) AS film_id, CASE WHEN n.film_id IS NULL THEN o.tmdb_id ELSE n.tmdb_id END AS tmdb_id, CASE WHEN n.film_id IS NULL THEN o.trailers ELSE n.trailers END AS trailers FROM o FULL JOIN n ON n.film_id = o.film_id""")
def trailers_written(spark: SparkSession, d: str) -> DataFrame:
    """Trailers found, in place of what was known of their titles."""
    part, k = A.table(spark, d, "part"), F.col("p_partkey")
    row = lambda where, times, trailers: part.where(where).select(k.alias("film_id"), (k * times).cast("int").alias("tmdb_id"), trailers.alias("trailers"))
    return updates.replaced_by_key(row("p_partkey % 2 = 0", 10, F.lit("[]")), row("p_partkey % 3 = 0", 11, F.concat(F.lit('["t'), k.cast("string"), F.lit('"]'))), ["film_id"])


@query("""WITH lines AS (SELECT p_partkey, (p_partkey % 4) AS session_id, CAST(p_size % 5 + 1 AS INT) AS tier, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS INT) END AS position FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tier, position NULLS LAST, lower(title), p_partkey) AS rank FROM lines),
l AS (SELECT *, count(*) FILTER (WHERE position IS NULL) OVER (PARTITION BY session_id, tier) AS loose, min(CASE WHEN position IS NULL THEN rank END) OVER (PARTITION BY session_id, tier) AS first FROM n)
SELECT 'mine' AS list_slug, rank, p_partkey AS film_id, title AS title_listed, CASE WHEN position IS NULL AND loose > 1 THEN '=' || first END AS rank_label FROM l WHERE session_id = 2
UNION ALL SELECT 'other', row_number() OVER (ORDER BY p_partkey), p_partkey, p_name, NULL FROM part WHERE p_partkey % 50 = 0""")
def tiered_list_saved(spark: SparkSession, d: str) -> DataFrame:
    """List entries after a session's tiers were saved as a list, in place of its lines before."""
    from pyspark.sql import Window

    part, k = A.table(spark, d, "part"), F.col("p_partkey")
    placed = part.select((k % 4).alias("session_id"), (F.col("p_size") % 5 + 1).cast("int").alias("tier"), k.alias("film_id"), F.col("p_name").alias("title"), F.when(k % 3 == 0, k.cast("int")).alias("position"))
    kept = part.where("p_partkey % 50 = 0").select(F.lit("other").alias("list_slug"), F.row_number().over(Window.orderBy("p_partkey")).cast("long").alias("rank"), k.alias("film_id"), F.col("p_name").alias("title_listed"), F.lit(None).cast("string").alias("rank_label"))
    before = kept.unionByName(kept.withColumn("list_slug", F.lit("mine")))
    return views.save_tiered_list(before, placed, 2, "mine")


@query("""WITH p AS (SELECT user_id AS film_id, min(CAST(floor(value) AS INT) % 5 + 1) AS tier FROM events WHERE event_type = 'purchase' GROUP BY user_id), pool AS (SELECT DISTINCT user_id AS film_id FROM events), t AS (SELECT tier, count(*) AS n FROM p GROUP BY tier)
SELECT x.tier, coalesce(t.n, 0) AS tally, CASE WHEN x.tier = 4 THEN NULL ELSE CAST(x.tier AS BIGINT) END AS anchor, x.tier = 4 OR x.tier = 2 AS needs_anchor, (SELECT count(*) FROM p) AS placed, (SELECT count(*) FROM pool WHERE film_id NOT IN (SELECT film_id FROM p) AND film_id <> 2) AS remaining
FROM (SELECT CAST(range AS INT) AS tier FROM range(1, 6)) x LEFT JOIN t USING (tier)""")
def session_state(spark: SparkSession, d: str) -> DataFrame:
    """A ranking session by tier: how many are placed, its anchor and whether it needs another, and what is left."""
    events = A.table(spark, d, "events")
    placed = events.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("film_id")).agg(F.min(F.floor("value").cast("int") % 5 + 1).alias("tier"))
    anchors = spark.range(1, 6).select(F.col("id").cast("int").alias("tier"), F.when(F.col("id") != 4, F.col("id")).alias("film_id"))
    unseen = spark.range(2, 3).select(F.col("id").alias("film_id"))
    return ranker.session_state(placed, anchors, events.select(F.col("user_id").alias("film_id")).distinct(), unseen)


@query("""WITH c AS (SELECT l_partkey AS film_id, s_name AS name, l_linenumber AS ord, l_linenumber % 2 = 0 AS is_cast, l_returnflag AS flag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
d AS (SELECT film_id, arg_min(name, (ord, name)) AS director FROM c WHERE NOT is_cast AND flag = 'A' GROUP BY film_id), b AS (SELECT film_id, count(*) AS n_cast FROM c WHERE is_cast AND flag <> 'R' GROUP BY film_id),
w AS (SELECT film_id, count(DISTINCT name) AS n_writers FROM c WHERE NOT is_cast AND flag = 'N' GROUP BY film_id)
SELECT x.film_id, director, coalesce(n_cast, 0) AS n_cast, coalesce(n_writers, 0) AS n_writers FROM (SELECT DISTINCT film_id FROM c) x LEFT JOIN d USING (film_id) LEFT JOIN b USING (film_id) LEFT JOIN w USING (film_id)""")
def credits_shaped(spark: SparkSession, d: str) -> DataFrame:
    """Each title's director, cast without uncredited players, and writers, one entry a person."""
    lines = A.table(spark, d, "lineitem").join(A.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    flag, is_cast = F.col("l_returnflag"), F.col("l_linenumber") % 2 == 0
    rows = lines.select(
        F.col("l_partkey").alias("film_id"), F.col("s_name").alias("name"), F.col("l_linenumber").alias("ord"), F.when(is_cast, "cast").otherwise("crew").alias("kind"),
        F.when(is_cast & (flag == "R"), "Guest (uncredited)").otherwise("Role").alias("character"), F.when(~is_cast & (flag == "A"), "Director").when(flag == "N", "Novel").otherwise("Editor").alias("job"), F.when(~is_cast & (flag == "N"), "Writing").otherwise("").alias("department"),
    )
    return reports.shaped_credits(rows).select("film_id", "director", F.size("cast").cast("long").alias("n_cast"), F.size("writers").cast("long").alias("n_writers"))


# vectors that change


_VECTORS: dict[tuple[str, str], embedding.VectorIndex] = {}


def _vector_index(spark: SparkSession, d: str) -> embedding.VectorIndex:
    """All embeddings in blocks, of which a refresh then turned every fiftieth around and dropped every thirtieth."""
    key = spark.sparkContext.applicationId, d
    if key not in _VECTORS:
        rows = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("film_id"), "embedding")
        index = embedding.VectorIndex(Tables(spark, _path(spark, "vectors")), 64)
        index.refresh(rows.select("film_id", vectors.packed("embedding").alias("vector")))
        turned = F.when(F.col("film_id") % 50 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
        index.refresh(rows.where("film_id % 30 <> 1").select("film_id", vectors.packed(turned).alias("vector")))
        _VECTORS[key] = index
    return _VECTORS[key]


_Q = "list_transform(range(0, 64), lambda i: CAST(((i * 7) % 13) - 6 AS DOUBLE) / 30.0)"


@query(f"""WITH n AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN -1.0 ELSE 1.0 END AS sign, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 30 <> 1),
x AS (SELECT vec_id, 1 - sign * list_dot_product(v, {_Q}) / sqrt(list_dot_product(v, v)) AS distance FROM n), r AS (SELECT vec_id, round(distance, 5) + 0.0 AS distance, row_number() OVER (ORDER BY distance, vec_id) AS place FROM x WHERE distance <= 0.8) SELECT vec_id, distance FROM r WHERE place <= 10""")
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors from packed blocks, after some changed."""
    found = _vector_index(spark, d).nearest([((i * 7) % 13 - 6) / 30.0 for i in range(64)])
    return found.select(F.col("film_id").alias("vec_id"), (F.round("distance", 5) + F.lit(0.0)).alias("distance"))


@query("""SELECT doc_id, count(*) AS n FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY doc_id""")
def embedding_job(spark: SparkSession, d: str) -> DataFrame:
    """Titles with a vector after a job over half of the texts and one over all: those of the first are not made again."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("film_id"), F.col("text").alias("overview"), F.lit(None).cast("string").alias("plot"), F.lit(None).cast("string").alias("tagline"))
    tables = Tables(spark, _path(spark, "embedded"))
    for part in (docs.where("film_id % 2 = 0"), docs):
        embedding.embed(tables, part, embedding.ConceptEmbedder, "concepts", embedding.DIMENSIONS, A.TODAY, slices=2)
    return tables.read("film_embedding").groupBy(F.col("film_id").alias("doc_id")).agg(F.count("*").alias("n"))
