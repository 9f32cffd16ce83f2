"""Queries of text search and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumidex.functions.expressions import trigrams, words
from lumidex.operators import search, vectors
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


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(rf"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, len(w) AS length, len(list_filter(w, lambda x: x = 'of')) AS a, len(list_filter(w, lambda x: x = 'thonre')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(length) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / m)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / m)), 6) AS bm25 FROM c, s WHERE a > 0 AND b > 0""")
def bm25_freeform(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(A.table(spark, d, "documents"), ["of", "thonre"], "doc_id", {"text": 1.0}).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(rf"SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term")
def keyword_vocab(spark: SparkSession, d: str) -> DataFrame:
    return search.vocabulary(A.table(spark, d, "documents"), ["text"])


@query("SELECT p_partkey AS film_id FROM part WHERE contains(lower(p_name), 'ring')")
def title_hits(spark: SparkSession, d: str) -> DataFrame:
    return A.films(spark, d).where(F.lower("title").contains("ring")).select("film_id")


@query("WITH n AS (SELECT p_name AS name, count(*) AS weight FROM part GROUP BY p_name) SELECT name, weight FROM n WHERE len(list_intersect(list_transform(range(1, greatest(length(name) - 1, 1)), lambda i: substr(lower(name), i, 3)), ['sma', 'mal', 'all', 'll ', 'l b', ' bo', 'bol', 'olt'])) > 0")
def trigram_candidates(spark: SparkSession, d: str) -> DataFrame:
    names = A.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("weight"))
    return search.trigram_candidates(names, "small bolt")


@query()
def fuzzy_rank(spark: SparkSession, d: str) -> DataFrame:
    names = A.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("weight"))
    return search.ranked(names, "smal blot", search.SUGGESTION_FLOOR)


_Q = "list_transform(range(0, 64), lambda i: CAST(((i * 7) % 13) - 6 AS DOUBLE) / 30.0)"
QUERY_VECTOR = [((i * 7) % 13 - 6) / 30.0 for i in range(64)]


@query(f"WITH x AS (SELECT vec_id, 1 - list_dot_product(CAST(embedding AS DOUBLE[]), {_Q}) AS distance FROM embeddings), r AS (SELECT vec_id, round(distance, 6) + 0.0 AS distance, row_number() OVER (ORDER BY distance, vec_id) AS n FROM x WHERE distance <= 0.8) SELECT vec_id, distance FROM r WHERE n <= 10")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings")
    return vectors.nearest(e, QUERY_VECTOR, key="vec_id", column="embedding").withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT query_id, vec_id, 1 - list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS dist FROM embeddings, q), r AS (SELECT query_id, vec_id, round(dist, 6) + 0.0 AS distance, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS place FROM x) SELECT query_id, vec_id, distance, CAST(place AS INT) AS place FROM r WHERE place <= 10")
def knn_of_each(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.nearest_of_each(e, asked).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(f"WITH x AS (SELECT vec_id, 1 - list_dot_product(CAST(embedding AS DOUBLE[]), {_Q}) AS distance FROM embeddings), near AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS n FROM x WHERE distance <= 0.8) WHERE n <= 10), hits AS (SELECT vec_id, CAST(label AS DOUBLE) AS score FROM embeddings WHERE label >= 5) SELECT h.vec_id AS film_id, round(h.score + coalesce(5.0 * (1 - n.distance), 0), 6) AS score, CAST(0 AS INT) AS stage FROM hits h LEFT JOIN near n USING (vec_id) UNION ALL SELECT vec_id, round(-distance, 6), 1 FROM near WHERE vec_id NOT IN (SELECT vec_id FROM hits)")
def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("film_id"), F.col("embedding").alias("vector"), "label")
    hits = e.where("label >= 5").select("film_id", F.col("label").cast("double").alias("score"))
    return vectors.hybrid(hits, vectors.nearest(e, QUERY_VECTOR)).select("film_id", F.round("score", 6).alias("score"), "stage")


@query("WITH a AS (SELECT DISTINCT l_partkey AS film_id FROM lineitem WHERE l_suppkey IN (3, 5)), b AS (SELECT p_partkey AS film_id FROM part WHERE p_type IN ('SMALL', 'ECONOMY')), c AS (SELECT p_partkey AS film_id FROM part WHERE 1950 + p_size BETWEEN 1955 AND 1990) SELECT film_id FROM a INTERSECT SELECT film_id FROM b INTERSECT SELECT film_id FROM c")
def membership_filter(spark: SparkSession, d: str) -> DataFrame:
    """Values of one field are alternatives, fields all have to hold."""
    found = A.films(spark, d).where(search.in_years(F.col("year"), "1955-1990") & F.col("genre").isin("SMALL", "ECONOMY"))
    held = A.table(spark, d, "lineitem").where(F.col("l_suppkey").isin(3, 5)).select(F.col("l_partkey").alias("film_id"))
    return found.select("film_id").join(held, "film_id", "left_semi")


@query("SELECT o_custkey AS film_id FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("film_id")).union(A.table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey")).distinct()


def search_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parts as films, suppliers as the people of what they ship."""
    films = A.films(spark, d)
    lines = A.table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "cast").otherwise("crew")
    credits = lines.select(F.col("l_partkey").alias("film_id"), F.col("l_suppkey").alias("person_id"), kind.alias("kind"), F.when(kind == "crew", "Director").otherwise("").alias("job"), F.col("l_shipdate").cast("string").alias("character"), F.col("l_linenumber").alias("ord"))
    persons = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    texts = films.select("film_id", "title", F.col("director").alias("overview"), F.col("genre").alias("plot"))
    return {"films": films, "credits": credits, "persons": persons, "genres": films.select("film_id", "genre"), "keywords": films.select("film_id", F.col("title").alias("keyword")), "texts": texts, "options": A.services(spark, d).select(F.lit(0).cast("long").alias("film_id"), "slug", "name")}


@query("WITH k AS (SELECT DISTINCT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE lower(s_name) = 'supplier#000000003' AND l_linenumber % 2 = 1) SELECT p_partkey AS film_id, CAST(0.0 AS DOUBLE) AS score FROM part WHERE p_partkey IN (SELECT l_partkey FROM k) AND 1950 + p_size BETWEEN 1960 AND 1985")
def search_fields(spark: SparkSession, d: str) -> DataFrame:
    return search.search("director:Supplier#000000003 year:1960-1985", **search_tables(spark, d))


_SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_COUNT = "(10 * len(list_filter(t, lambda w: w = '{0}')) + 2 * len(list_filter(o, lambda w: w = '{0}')) + len(list_filter(p, lambda w: w = '{0}')))"


@query(f"""WITH w AS (SELECT p_partkey AS film_id, lower(p_name) AS title, lower(p_type) AS genre, {_SPLIT.format('p_name')} AS t, {_SPLIT.format('p_brand')} AS o, {_SPLIT.format('p_type')} AS p FROM part),
c AS (SELECT film_id, title, genre, len(t) + len(o) + len(p) AS length, {_COUNT.format('small')} AS a, {_COUNT.format('ring')} AS b FROM w), s AS (SELECT count(*) AS n, avg(length) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c),
r AS (SELECT film_id, genre, CASE WHEN a > 0 AND b > 0 THEN greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / m)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / m)) END AS words,
  CASE WHEN contains(title, 'small ring') THEN 10.0 END AS inside, CASE WHEN title = 'small ring' THEN 3.0 END AS keyword FROM c, s)
SELECT film_id, round(coalesce(words, 0) + coalesce(inside, 0) + coalesce(keyword, 0), 6) AS score FROM r WHERE genre = 'economy' AND coalesce(words, inside, keyword) IS NOT NULL""")
def search_freeform(spark: SparkSession, d: str) -> DataFrame:
    return search.search("small ring genre:economy", **search_tables(spark, d)).withColumn("score", F.round("score", 6))


@query(r"SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT item_id, len(list_distinct(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(lower(text), i, 3)))) AS n_trigrams FROM benchmark")
def trigram_sizes(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "benchmark").select("item_id", F.size(F.array_distinct(trigrams(F.col("text")))).cast("long").alias("n_trigrams"))


@query(rf"WITH t AS (SELECT doc_id, {_WORDS} AS w, source FROM documents), r AS (SELECT source, doc_id, len(w) AS n, row_number() OVER (PARTITION BY source ORDER BY len(w) DESC, doc_id) AS place FROM t) SELECT source, doc_id, n, CAST(place AS INT) AS place FROM r WHERE place <= 3")
def longest_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The top three of each group: Spark limits each partition to three rows of a group before it shuffles them, so a hot group stays small."""
    counted = A.table(spark, d, "documents").select("source", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n"))
    best = counted.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "doc_id")))
    return best.where("place <= 3")
