"""Queries of entity resolution, duplicates and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.functions import text as T
from lumidex.operators import matching, writes
from lumidex.operators.graph import connected_components
from lumidex.plans import adapters as A
from lumidex.shared import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def saved(df: DataFrame, label: str) -> DataFrame:
    """df by way of the shared folder that the session names for checkpoints."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/catalogue-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query("SELECT key, min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key FROM documents) GROUP BY key HAVING count(*) > 1")
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(F.btrim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")))
    return A.table(spark, d, "documents").select("doc_id", key.alias("key")).groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query("WITH f AS (SELECT p_partkey AS film_id, p_name || ' ' || p_brand || ' ' || p_size AS t, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 4 END AS tmdb FROM part) SELECT t AS title_norm, count(*) AS n, CASE WHEN count(tmdb) = count(*) AND count(DISTINCT tmdb) = 1 THEN 'twin' WHEN count(tmdb) = count(*) AND count(DISTINCT tmdb) = count(*) THEN 'distinct' ELSE 'undecided' END AS verdict FROM f GROUP BY t HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    films = p.select(F.col("p_partkey").alias("film_id"), F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")).alias("title_norm"))
    ids = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("film_id"), F.lit("tmdb").alias("authority"), (F.col("p_partkey") % 4).cast("string").alias("value"))
    return writes.duplicate_groups(films, ids).select("title_norm", "n", "verdict")


def _merges(spark: SparkSession, d: str) -> DataFrame:
    """Parts of which every other chain link is merged into the part half its number."""
    return A.table(spark, d, "part").where("p_partkey > 0 and p_partkey % 3 <> 1").select(F.col("p_partkey").alias("film_id"), F.lit("merged").alias("kind"), F.floor(F.col("p_partkey") / 2).alias("survivor_id"))


_CLOSURE = "RECURSIVE m AS (SELECT p_partkey AS film_id, p_partkey // 2 AS survivor FROM part WHERE p_partkey > 0 AND p_partkey % 3 <> 1), c(film_id, top, depth) AS (SELECT film_id, survivor, 1 FROM m UNION ALL SELECT c.film_id, m.survivor, depth + 1 FROM c JOIN m ON m.film_id = c.top)"


@query(f"WITH {_CLOSURE} SELECT film_id, arg_max(top, depth) AS canonical_id FROM c GROUP BY film_id")
def merge_closure(spark: SparkSession, d: str) -> DataFrame:
    return writes.canonical(_merges(spark, d), saved)


@query(f"WITH {_CLOSURE}, k AS (SELECT film_id, arg_max(top, depth) AS canonical_id FROM c GROUP BY film_id), {A.LISTINGS_SQL} SELECT coalesce(canonical_id, l.film_id) AS film_id, source, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM listings l LEFT JOIN k USING (film_id) GROUP BY ALL")
def merged_listings(spark: SparkSession, d: str) -> DataFrame:
    canon = writes.canonical(_merges(spark, d), saved)
    return writes.merged_rows(A.listings(spark, d), "listings", canon, A.parts(spark, d, "lineitem")).select("film_id", "source", "first_seen", "last_seen")


@query(f"WITH {_CLOSURE}, k AS (SELECT film_id, arg_max(top, depth) AS canonical_id FROM c GROUP BY film_id), r AS (SELECT p_partkey AS film_id, CAST(p_partkey % 11 AS INT) AS score FROM part WHERE p_partkey % 4 = 0) SELECT coalesce(canonical_id, r.film_id) AS film_id, count(*) AS n_folded FROM r LEFT JOIN k USING (film_id) GROUP BY 1")
def merged_ratings(spark: SparkSession, d: str) -> DataFrame:
    """How many ratings each surviving title's one rating stands for."""
    canon = writes.canonical(_merges(spark, d), saved).withColumnRenamed("film_id", "m_film")
    rows = A.ratings(spark, d)
    folded = rows.join(canon, rows["film_id"] == F.col("m_film"), "left").select(F.coalesce("canonical_id", "film_id").alias("film_id"))
    one = writes.merged_rows(rows, "my_ratings", canon.withColumnRenamed("m_film", "film_id"))
    return one.select("film_id").join(folded.groupBy("film_id").agg(F.count("*").alias("n_folded")), "film_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, 10000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS b FROM lineitem), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, component) USING KEY (node) AS (SELECT DISTINCT a AS node, a AS component FROM w
  UNION (SELECT u.node, min(v.component) AS component FROM recurring.r AS u JOIN w ON w.a = u.node JOIN r AS v ON v.node = w.b WHERE v.component < u.component GROUP BY u.node))
SELECT node, component FROM r""")
def linked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Orders that have the same part in the same quantity, and what they have, in connected components."""
    e = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") * 100 + F.col("l_quantity").cast("long") + 10000000).alias("b")).distinct()
    return connected_components(e, saved)


def _title(key: F.Column) -> F.Column:
    return F.concat(F.lit("Film "), F.floor(key / 2).cast("string"))


def _match_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as films, two to a title; customers as queries, some with editions in their titles."""
    p = A.table(spark, d, "part")
    films = p.select(F.col("p_partkey").alias("id"), _title(F.col("p_partkey")).alias("title"), (1950 + F.col("p_size")).cast("int").alias("year"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("director"), F.lit(None).cast("int").alias("runtime_min"), F.lit(None).cast("double").alias("popularity"))
    c, key = A.table(spark, d, "customer"), F.col("c_custkey")
    queries = c.select(
        key.alias("id"), F.concat(_title(key), F.when(key % 5 == 0, " (Director's Cut)").otherwise("")).alias("title"), (1950 + key % 50).cast("int").alias("year"),
        F.when(key % 2 == 0, matching.DATABASE).otherwise(matching.COMMERCE).alias("year_kind"), F.lit(None).cast("string").alias("director"), F.lit(None).cast("int").alias("runtime_min"),
    ).withColumn("edition_hint", T.has_edition(F.col("title")))
    return queries, films


@query("""WITH f AS (SELECT p_partkey AS id, 'Film ' || (p_partkey // 2) AS title, CAST(1950 + p_size AS INT) AS year FROM part),
q AS (SELECT c_custkey AS id, 'Film ' || (c_custkey // 2) AS title, CAST(1950 + c_custkey % 50 AS INT) AS year, c_custkey % 2 = 0 AS strict, c_custkey % 5 = 0 AS hint FROM customer),
p AS (SELECT q.id AS q_id, f.id AS c_id, q.year - f.year AS delta, strict, hint FROM q JOIN f ON f.title = q.title),
s AS (SELECT *, CASE WHEN abs(delta) <= 1 THEN NULL WHEN strict THEN 'other' WHEN delta < -1 THEN 'early' END AS out, CASE WHEN abs(delta) <= 1 THEN 2 ELSE 0 END AS yp, (NOT strict AND delta > 1) AS gap FROM p),
t AS (SELECT *, max(CASE WHEN out IS NULL THEN yp END) OVER (PARTITION BY q_id) AS top FROM s),
g AS (SELECT q_id, bool_or(hint) AS hint, count(*) FILTER (WHERE out IS NULL) AS alive, count(*) FILTER (WHERE out = 'other') AS other, coalesce(bool_or(gap) FILTER (WHERE out IS NULL), false) AS any_gap, count(*) FILTER (WHERE out IS NULL AND yp = top) AS n_top, max(c_id) FILTER (WHERE out IS NULL AND yp = top) AS best, max(top) AS top FROM t GROUP BY q_id),
r AS (SELECT q.id, g.*, CASE WHEN q_id IS NULL THEN NULL WHEN alive = 0 AND other > 0 THEN 'conflict' WHEN alive > 0 AND n_top > 1 THEN 'ambiguous' WHEN g.hint AND top = 2 AND any_gap THEN 'rerelease-ambiguous' WHEN top = 0 AND any_gap AND NOT g.hint THEN 'year-gap' END AS reason FROM q LEFT JOIN g ON q_id = q.id)
SELECT id, CASE WHEN q_id IS NULL OR (alive = 0 AND other = 0) THEN 'create' WHEN reason IS NOT NULL THEN 'review' ELSE 'match' END AS kind, CASE WHEN q_id IS NOT NULL AND alive > 0 AND reason IS NULL THEN best END AS film_id, reason FROM r""")
def blocking_match(spark: SparkSession, d: str) -> DataFrame:
    queries, films = _match_tables(spark, d)
    return matching.verdicts(queries, films).select("id", "kind", "film_id", "reason")


@query("""WITH p AS (SELECT c_custkey AS q_id, 1950 + c_custkey % 50 AS qy, c_custkey % 3 = 0 AS late, c_custkey % 4 = 0 AS told, p_partkey AS c_id, 1950 + p_size AS cy, p_partkey % 3000 AS votes, p_partkey % 2 = 0 AS keyed, p_partkey % 4 = 0 AS agrees, c_custkey % 4 = 0 AND p_partkey % 3 = 0 AND p_brand <> 'Brand#3' AS conflict, c_custkey % 4 = 0 AND p_partkey % 3 = 0 AND p_brand = 'Brand#3' AS same
  FROM customer JOIN part ON p_partkey // 2 = c_custkey // 2),
a AS (SELECT *, NOT conflict AND (same OR abs(cy - qy) <= 2 OR (late AND cy < qy)) AS alive, CASE WHEN abs(cy - qy) <= 1 THEN 2 WHEN abs(cy - qy) <= 2 THEN 1 ELSE 0 END AS yp, abs(cy - qy) > 2 AND NOT same AND late AND cy < qy AS older FROM p),
k AS (SELECT a.*, alive AND (keyed OR votes >= 10 OR NOT EXISTS (SELECT 1 FROM a b WHERE b.q_id = a.q_id AND b.alive AND b.keyed AND b.cy = a.cy)) AS stays FROM a),
n AS (SELECT *, stays AND yp >= 1 AS near, stays AND older AS old FROM k),
g AS (SELECT q_id, any_value(late) AS late, any_value(told) AS told, bool_or(conflict) AS c, max(c_id) FILTER (WHERE same) AS s_id, count(*) FILTER (WHERE alive) AS n_alive, count(*) FILTER (WHERE near) AS n_near, count(*) FILTER (WHERE old) AS n_old, bool_or(yp = 2) FILTER (WHERE near) AS near1,
  arg_min(c_id, (-yp - CAST(agrees AS INT), c_id)) FILTER (WHERE near) AS n_id, arg_min(agrees, (-yp - CAST(agrees AS INT), c_id)) FILTER (WHERE near) AS n_agrees, arg_min(votes, (-yp - CAST(agrees AS INT), c_id)) FILTER (WHERE near) AS n_votes, arg_min(yp, (-yp - CAST(agrees AS INT), c_id)) FILTER (WHERE near) AS n_yp,
  arg_min(c_id, (-CAST(agrees AS INT), c_id)) FILTER (WHERE old) AS o_id, arg_min(agrees, (-CAST(agrees AS INT), c_id)) FILTER (WHERE old) AS o_agrees,
  max((votes, c_id, agrees)) FILTER (WHERE near) AS nv, min(votes) FILTER (WHERE near) AS nv2, max((votes, c_id, agrees)) FILTER (WHERE old) AS ov, min(votes) FILTER (WHERE old) AS ov2 FROM n GROUP BY q_id),
d AS (SELECT *, n_near > 0 AND nv[1] >= 1000 AND (n_near = 1 OR nv[1] >= 20 * greatest(1, nv2)) AS dom_near, n_old > 0 AND ov[1] >= 1000 AND (n_old = 1 OR ov[1] >= 20 * greatest(1, ov2)) AND ov[3] AS dom_old FROM g),
r AS (SELECT *, CASE WHEN n_alive = 0 THEN CASE WHEN c THEN 'director conflicts only' ELSE 'no candidates' END WHEN s_id IS NOT NULL THEN 'director corroborated' WHEN n_old > 0 AND n_near > 0 AND late AND NOT near1 THEN 'rerelease-ambiguous'
  WHEN n_near = 1 AND (n_agrees OR n_votes >= 1000 OR (told AND n_yp = 2)) THEN 'exact title + year' || CASE WHEN n_agrees THEN ' + agreement' ELSE '' END WHEN dom_near THEN 'votes dominate among year-near exact titles' WHEN n_near > 0 THEN 'ambiguous'
  WHEN n_old = 1 AND late AND o_agrees THEN 'unique older exact title (commerce year = re-release)' WHEN dom_old AND late THEN 'votes dominate among older exact titles' WHEN n_old > 0 AND late THEN 'ambiguous (older candidates)' ELSE 'weak' END AS reason FROM d),
i AS (SELECT q_id, reason, CASE WHEN reason = 'director corroborated' THEN s_id WHEN starts_with(reason, 'exact') THEN n_id WHEN starts_with(reason, 'votes dominate among year') THEN nv[2] WHEN starts_with(reason, 'unique') THEN o_id WHEN starts_with(reason, 'votes dominate among older') THEN ov[2] END AS c FROM r)
SELECT q_id, CASE WHEN c IS NULL THEN 'review' ELSE 'match' END AS kind, CAST(c AS VARCHAR) AS c_id, reason FROM i""")
def resolver(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's title resolved among the parts of that title.

    They are merged, never broadcast: a file of few splits would pair and sort all of them in as few tasks.
    """
    queries, films = _match_tables(spark, d)
    q = queries.select(F.col("id").alias("q_id"), T.without_editions(F.col("title")).alias("q_title"), F.array(T.without_editions(F.col("title"))).alias("q_forms"), F.col("year").alias("q_year"), F.when(F.col("id") % 3 == 0, "mc").otherwise("database").alias("q_class"), F.when(F.col("id") % 4 == 0, "Brand#3").alias("q_director"), F.array().cast("array<string>").alias("q_editions"))
    c = films.select(F.col("id").alias("c_id"), F.col("title").alias("c_title"), F.array("title").alias("c_titles"), F.col("year").alias("c_year"), F.col("director").alias("c_directors"), (F.col("id") % 3000).cast("int").alias("c_votes"), F.lit("movie").alias("c_kind"), (F.col("id") % 2 == 0).alias("c_in_tmdb"), (F.col("id") % 4 == 0).alias("c_in_omdb"), F.col("title").alias("c_omdb_title"))
    return matching.resolve(q.hint("merge").join(c, F.col("q_title") == F.col("c_title")).drop("c_title"))


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def evidence_left_join(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id").join(A.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))
