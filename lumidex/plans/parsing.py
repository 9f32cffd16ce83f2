"""Queries of the source parsers: payloads are built from the tables as a source would send them, and parsed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumidex.functions import expressions as X
from lumidex.functions import text as T
from lumidex.plans import adapters as A
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


def _part(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    return A.table(spark, d, "part"), F.col("p_partkey")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


@query("""SELECT p_partkey AS film_id, p_partkey % 7 <> 0 AS found,
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 THEN CAST((p_partkey % 10) || '.' || (p_partkey % 9) AS DOUBLE) END AS imdb,
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 6 <> 0 THEN CAST(p_partkey % 101 AS INT) END AS rt,
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 4 <> 0 THEN CAST(p_partkey % 97 AS INT) END AS metacritic,
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN p_brand END AS language FROM part""")
def omdb_parse(spark: SparkSession, d: str) -> DataFrame:
    p, k = _part(spark, d)
    none = F.lit("N/A")
    other = F.struct(F.lit("Internet Movie Database").alias("Source"), F.lit("7.0/10").alias("Value"))
    tomato = F.struct(F.lit("Rotten Tomatoes").alias("Source"), _text(k % 101, "%").alias("Value"))
    payload = _json(
        Response=F.when(k % 7 != 0, "True").otherwise("False"), imdbRating=F.when(k % 3 == 0, none).otherwise(_text(k % 10, ".", k % 9)),
        Metascore=F.when(k % 4 == 0, none).otherwise((k % 97).cast("string")), Language=F.when(k % 5 == 0, none).otherwise(F.col("p_brand")),
        Ratings=F.when(k % 6 == 0, F.array(other)).otherwise(F.array(other, tomato)),
    )
    return parsers.omdb_records(p.select(k.alias("film_id"), payload.alias("payload"))).drop("payload")


def _credit_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Two actors, one of them twice, a director and a writer; the genre and two keywords, one of them twice."""
    p, k = _part(spark, d)
    person = lambda i, name, **more: F.struct(i.alias("id"), _text(name, " ", i).alias("name"), *[c.alias(n) for n, c in more.items()])
    named = lambda c: F.struct(c.alias("name"))
    star = person(k % 50, "Actor", character=F.lit("Lead"), order=F.lit(0))
    cast = F.array(star, person(k % 70 + 100, "Actor", character=F.lit(None).cast("string"), order=F.lit(1)), star)
    crew = F.array(person(k % 30 + 200, "Maker", job=F.lit("Director"), department=F.lit("Directing")), person(k % 20 + 300, "Maker", job=F.lit("Writer"), department=F.lit("Writing")))
    payload = _json(
        id=k * 10, imdb_id=_text("tt", k), title=F.col("p_name"), original_title=F.when(k % 2 == 0, F.col("p_name")),
        release_date=F.when(k % 5 == 0, "").otherwise(_text(k % 200 + 1850, "-01-02")), runtime=(k % 4 * 30).cast("int"), overview=F.col("p_type"), tagline=F.lit(""),
        genres=F.array(named(F.col("p_type"))), keywords=F.struct(F.array(*[named(c) for c in (F.col("p_brand"), F.lit("night"), F.col("p_brand"))]).alias("keywords")),
        alternative_titles=F.struct(F.array(F.struct(_text("Alt ", k).alias("title"))).alias("titles")), credits=F.struct(cast.alias("cast"), crew.alias("crew")),
    )
    return p.select(k.alias("film_id"), payload.alias("payload"))


_YEAR = "CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 200 + 1850 BETWEEN 1880 AND 2102 THEN CAST(p_partkey % 200 + 1850 AS INT) END"


@query(f"""SELECT p_partkey AS film_id, p_partkey * 10 AS tmdb_id, 'tt' || p_partkey AS imdb_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS original_title,
  {_YEAR} AS release_year, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 4 * 30 AS INT) END AS runtime_min, p_type AS genres, 'Alt ' || p_partkey AS alt_titles FROM part""")
def facts_parse(spark: SparkSession, d: str) -> DataFrame:
    facts = parsers.credit_payloads(_credit_payloads(spark, d))["facts"]
    return facts.select("film_id", "tmdb_id", "imdb_id", "title", "original_title", "release_year", "runtime_min", F.array_join("genres", ",").alias("genres"), F.array_join("alt_titles", ",").alias("alt_titles"))


@query("""SELECT p_partkey AS film_id, p_partkey % 50 AS tmdb_person_id, 'Actor ' || (p_partkey % 50) AS name, 'cast' AS kind, '' AS job, '' AS department, 'Lead' AS character, 0 AS ord FROM part
  UNION ALL SELECT p_partkey, p_partkey % 70 + 100, 'Actor ' || (p_partkey % 70 + 100), 'cast', '', '', '', 1 FROM part
  UNION ALL SELECT p_partkey, p_partkey % 30 + 200, 'Maker ' || (p_partkey % 30 + 200), 'crew', 'Director', 'Directing', '', 0 FROM part
  UNION ALL SELECT p_partkey, p_partkey % 20 + 300, 'Maker ' || (p_partkey % 20 + 300), 'crew', 'Writer', 'Writing', '', 1 FROM part""")
def credits_parse(spark: SparkSession, d: str) -> DataFrame:
    return parsers.credit_payloads(_credit_payloads(spark, d))["credits"]


@query("SELECT p_partkey AS film_id, p_brand AS keyword FROM part UNION ALL SELECT p_partkey, 'night' FROM part")
def keywords_parse(spark: SparkSession, d: str) -> DataFrame:
    return parsers.credit_payloads(_credit_payloads(spark, d))["keywords"]


@query(f"""SELECT p_partkey AS film_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS original_title, 'tt' || p_partkey AS imdb_id, {_YEAR} AS release_year,
  CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 4 * 30 AS INT) END AS runtime_min, 'Maker ' || (p_partkey % 30 + 200) AS director FROM part""")
def movie_facts(spark: SparkSession, d: str) -> DataFrame:
    return parsers.movie_facts(_credit_payloads(spark, d))


@query("""SELECT p_partkey AS film_id, CAST(n AS INT) AS pos, 'YouTube' AS site, CASE n WHEN 0 THEN 'Trailer' ELSE 'Clip' END AS type, 'key' || (p_partkey * 2 + n) AS key, CASE WHEN p_partkey % 3 = 0 THEN 'fr' END AS language, n = 0 AS official, CAST(720 AS INT) AS size FROM part, range(0, 2) t(n) WHERE p_partkey % 4 <> 0 OR n = 0""")
def videos_parse(spark: SparkSession, d: str) -> DataFrame:
    p, k = _part(spark, d)
    one = lambda n, kind: F.struct(F.lit("YouTube").alias("site"), F.lit(kind).alias("type"), _text("key", k * 2 + n).alias("key"), F.when(k % 3 == 0, "fr").alias("iso_639_1"), F.lit(n == 0).alias("official"), F.lit(720).alias("size"))
    raw = p.select(k.alias("film_id"), _json(results=F.when(k % 4 == 0, F.array(one(0, "Trailer"))).otherwise(F.array(one(0, "Trailer"), one(1, "Clip")))).alias("payload"))
    return parsers.video_payloads(raw).drop("name")


@query("""SELECT p_partkey AS film_id, CAST(p_size AS BIGINT) AS provider_id, 'Service ' || p_size AS name, 'flatrate' AS offer FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, p_size + 100, 'Service ' || (p_size + 100), 'rent' FROM part UNION ALL SELECT p_partkey, p_size, 'Service ' || p_size, 'buy' FROM part""")
def providers_parse(spark: SparkSession, d: str) -> DataFrame:
    """Offers of one region; those of another are not read."""
    p, k = _part(spark, d)
    one = lambda c: F.array(F.struct(c.cast("long").alias("provider_id"), _text("Service ", c).alias("provider_name")))
    size = F.col("p_size")
    here = F.struct(F.lit("https://x.example").alias("link"), F.when(k % 2 == 0, one(size)).alias("flatrate"), one(size + 100).alias("rent"), one(size).alias("buy"))
    payload = _json(results=F.struct(here.alias("US"), F.struct(one(F.lit(7)).alias("flatrate")).alias("FR")))
    return parsers.provider_payloads(p.select(k.alias("film_id"), payload.alias("payload")))


@query("""WITH c AS (SELECT *, (p_partkey - 1) // 24 + 1 AS page, row_number() OVER (PARTITION BY (p_partkey - 1) // 24 ORDER BY p_partkey) AS nth FROM part WHERE p_partkey > 0)
SELECT 'slug-' || p_partkey AS slug, p_name AS title, CAST(1950 + p_size AS INT) AS year, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 101 AS INT) END AS score,
  CAST((page - 1) * 24 + nth AS INT) AS rank, CAST(page AS INT) AS page FROM c""")
def page_cards_parse(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 24 cards whose values are places in one array, as a script in the page carries them."""
    p, k = _part(spark, d)
    cards = p.where(k > 0).groupBy((F.floor((k - 1) / 24) + 1).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), "p_name", "p_size"))).alias("cards"))

    def cells(card: Column, i: Column) -> Column:
        at = lambda n: (i * 6 + n + 1).cast("string")
        pointers = _text('{"title":', at(1), ',"slug":', at(2), ',"premiereYear":', at(3), ',"criticScoreSummary":', at(4), "}")
        score = F.when(card["k"] % 3 != 0, (card["k"] % 101).cast("string")).otherwise("null")
        return F.concat_ws(",", pointers, _text('"', card["p_name"], '"'), _text('"slug-', card["k"], '"'), (card["p_size"] + 1950).cast("string"), _text('{"score":', at(5), "}"), score)

    island = F.concat(F.lit('["head",'), F.array_join(F.transform("cards", cells), ","), F.lit("]"))
    html = F.concat(F.lit('<html><body><script type="application/json" id="__NUXT_DATA__">'), island, F.lit("</script></body></html>"))
    return parsers.page_cards(cards.select("page", html.alias("html")))


@query("SELECT DISTINCT CAST((p_partkey - 1) // 24 + 1 AS INT) AS page FROM part WHERE p_partkey > 0")
def archive_index(spark: SparkSession, d: str) -> DataFrame:
    p, k = _part(spark, d)
    page = (F.floor((k - 1) / 24) + 1).cast("string")
    return parsers.archived_pages(p.where(k > 0).select(_text("file:/archive/page-", page, ".html").alias("path")).union(p.select(F.lit("file:/archive/notes.txt"))))


def _list_texts(spark: SparkSession, d: str) -> DataFrame:
    """A file a brand: its parts by key, each with a printed rank, a director, an id and a year where it has them."""
    p, k = _part(spark, d)
    label = F.when(F.col("n") % 4 == 0, _text("=", F.col("n") - 1)).otherwise(F.col("n").cast("string"))
    cells = F.concat_ws("\t", label, F.col("p_name"), F.when(k % 2 == 0, F.col("p_type")).otherwise(""), F.when(k % 3 == 0, _text("tt", k)).otherwise(""), F.when(k % 5 == 0, "").otherwise((F.col("p_size") + 1950).cast("string")))
    numbered = p.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy(k)))
    body = numbered.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", cells.alias("cells")))), lambda x: x["cells"]), "\n").alias("body"))
    brand = F.col("p_brand")
    head = F.concat(F.lit("# name: List of "), brand, F.lit("\n# curator: nobody\n# published: 2001\n# ordered: "), F.when(F.length(brand) % 2 == 0, "yes").otherwise("no"), F.lit("\n\n"))
    return body.select(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "-").alias("file"), F.concat(head, "body", F.lit("\n")).alias("value"))


@query("""SELECT DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS slug, 'List of ' || p_brand AS name, 'nobody' AS curator, 2001 AS published_year,
  CAST(NULL AS VARCHAR) AS source_url, length(p_brand) % 2 = 0 AS ordered FROM part""")
def list_files_parse(spark: SparkSession, d: str) -> DataFrame:
    return parsers.parsed_lists(_list_texts(spark, d))[0]


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS list_slug, CAST(n AS INT) AS rank, CASE WHEN n % 4 = 0 THEN '=' || (n - 1) END AS rank_label, p_name AS title_listed,
  CASE WHEN p_partkey % 2 = 0 THEN p_type END AS director_listed, CASE WHEN p_partkey % 3 = 0 THEN 'tt' || p_partkey END AS tt_listed, CASE WHEN p_partkey % 5 <> 0 THEN CAST(1950 + p_size AS INT) END AS year_listed FROM n""")
def list_entries_parse(spark: SparkSession, d: str) -> DataFrame:
    return parsers.parsed_lists(_list_texts(spark, d))[1]


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_brand AS source, CAST(n AS INT) AS line, p_name || ', or "' || p_size || '"' AS title, CASE WHEN p_partkey % 3 <> 0 THEN CAST(1950 + p_size AS INT) END AS year,
  CAST(p_partkey % 5 + 1 AS INT) AS stars, CASE WHEN p_partkey % 4 = 0 THEN '2001-02-03' END AS rented_on FROM n""")
def ratings_parse(spark: SparkSession, d: str) -> DataFrame:
    """Files whose columns stand in another order and among others, with quoted commas and quotes."""
    p, k = _part(spark, d)
    title = F.concat(F.lit('"'), "p_name", F.lit(', or \\"'), F.col("p_size").cast("string"), F.lit('\\""'))
    row = F.concat_ws(",", title, F.lit("x"), F.when(k % 4 == 0, "2001-02-03").otherwise(""), (k % 5 + 1).cast("string"), F.when(k % 3 == 0, "unknown").otherwise((F.col("p_size") + 1950).cast("string")))
    body = p.select("p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy(k)).alias("line"), row.alias("value"))
    heads = p.select("p_brand").distinct().select("p_brand", F.lit(0).alias("line"), F.lit("Title,Shelf,Rented,Rating,Year").alias("value"))
    lines = heads.union(body).select(F.col("p_brand").alias("file"), F.col("p_brand").alias("source"), "line", "value")
    return parsers.parsed_ratings(lines).withColumn("rented_on", F.col("rented_on").cast("string"))


@query("""SELECT p_name AS title, CASE WHEN p_partkey % 3 <> 0 THEN CAST(1950 + p_size AS INT) END AS year,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 90 + 1 AS INT) END AS runtime_min FROM part""")
def library_parse(spark: SparkSession, d: str) -> DataFrame:
    p, k = _part(spark, d)
    year = F.when(k % 3 == 0, F.when(k % 2 == 0, "0").otherwise("missing value")).otherwise((F.col("p_size") + 1950).cast("string"))
    seconds = F.when(k % 5 == 0, "missing value").otherwise(_text((k % 90 + 1) * 60 + 7, ".5"))
    lines = p.select(F.concat_ws("\t", "p_name", year, seconds).alias("value")).union(spark.createDataFrame([("no columns",)], "value string"))
    return parsers.library_export(lines)


@query("""SELECT 'm' || p_partkey AS mediaid, p_name AS title, CASE WHEN p_partkey % 3 <> 0 THEN CAST(1950 + p_size AS INT) END AS year,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'A ' || p_brand || ', B' END AS director FROM part WHERE p_partkey % 6 <> 0""")
def catalog_parse(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue pages of 50 items; each page begins with a card of the page before, and some items are no films."""
    p, k = _part(spark, d)
    card = F.struct(
        F.when(k % 6 == 0, "series").otherwise("film").alias("contentType"), _text("m", k).alias("mediaid"), F.col("p_name").alias("title"),
        F.when(k % 3 == 0, "soon").otherwise(_text(F.col("p_size") + 1950, "-05-06")).alias("release_date"), F.when(k % 4 == 0, "none").otherwise(_text('["A ', F.col("p_brand"), '","B"]')).alias("director"),
    )
    paged = p.select(F.floor(k / 50).alias("page"), F.lit(1).alias("own"), k.alias("k"), card.alias("c"))
    again = p.where(k % 50 == 49).select((F.floor(k / 50) + 1).alias("page"), F.lit(0).alias("own"), k.alias("k"), card.withField("title", F.lit("a later card")).alias("c"))
    pages = paged.union(again).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("own", "k", "c"))), lambda x: x["c"]).alias("items"))
    return parsers.catalog_items(pages.select("page", _json(items=F.col("items")).alias("payload")))


@query("""SELECT 'https://o.example/' || (event_id % 700) AS url, arg_max(user_id, event_id) AS film_id, CAST(arg_max(CASE WHEN event_id % 2 = 0 THEN 301 ELSE 404 END, event_id) AS INT) AS status
FROM events WHERE event_id % 13 <> 0 GROUP BY 1""")
def observations_parse(spark: SparkSession, d: str) -> DataFrame:
    """A log of answers of which the last for an address holds; every thirteenth line is broken off."""
    e, k = A.table(spark, d, "events"), F.col("event_id")
    line = _json(url=_text("https://o.example/", k % 700), film_id=F.col("user_id"), status=F.when(k % 2 == 0, 301).otherwise(404), location=F.lit("/films/x"), asked_at=F.lit("2001-01-01"), applied=F.lit(False))
    lines = e.select(F.when(k % 13 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"), k.alias("line"))
    return parsers.parsed_observations(lines).select("url", "film_id", "status")


@query("""SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS itunes_id, p_name AS title, CAST(1950 + p_size AS INT) AS year, 'tt' || (p_partkey % 1500) AS imdb_id, p_brand AS director, p_partkey % 10 = 0 AS removed
FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0""")
def store_parse(spark: SparkSession, d: str) -> DataFrame:
    return parsers.store_products(_store_answers(spark, d))


def _store_answers(spark: SparkSession, d: str) -> DataFrame:
    """One product an answer: some are no movies, some ids are no numbers, some titles are marked as removed."""
    p, k = _part(spark, d)
    product = F.struct(
        F.when(k % 7 == 0, _text("id", k)).otherwise(k.cast("string")).alias("id"), F.when(k % 10 == 0, _text("[removed] ", F.col("p_name"))).otherwise(F.col("p_name")).alias("title"),
        (F.col("p_size") + 1950).cast("int").alias("year"), F.when(k % 4 == 0, "season").otherwise("movie").alias("kind"), _text("tt", k % 1500).alias("imdb_id"), F.col("p_brand").alias("director"),
    )
    return p.select(k.alias("pos"), _json(results=F.array(product)).alias("payload"))


@query("""WITH s AS (SELECT p_partkey AS id, 'tt' || (p_partkey % 1500) AS tt FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 10 <> 0),
g AS (SELECT tt, count(DISTINCT id) AS n, min(CAST(id AS VARCHAR)) AS one FROM s GROUP BY tt)
SELECT p_partkey AS film_id, CASE WHEN n = 1 THEN one END AS itunes_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome FROM part LEFT JOIN g ON tt = 'tt' || p_partkey""")
def store_confirm(spark: SparkSession, d: str) -> DataFrame:
    targets = A.table(spark, d, "part").select(F.col("p_partkey").alias("film_id"), _text("tt", F.col("p_partkey")).alias("imdb_id"))
    return parsers.confirmed_product(targets, parsers.store_products(_store_answers(spark, d)))


_LEGACY = """f AS (SELECT lower(trim(p_name)) || ' (' || CAST(1950 + p_size AS INT) || ')' AS key, p_partkey FROM part),
films AS (SELECT DISTINCT key FROM f WHERE p_partkey % 2 = 0), asked AS (SELECT key FROM f WHERE p_partkey % 3 = 0 UNION SELECT key FROM f WHERE p_partkey % 5 = 0)"""


def _legacy(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """An older catalogue as three documents a brand."""
    p, k = _part(spark, d)
    year = (F.col("p_size") + 1950).cast("int")
    film = F.struct(F.col("p_name").alias("title"), year.alias("year"), F.col("p_brand").alias("director"), _text("https://f.example/", k).alias("url"))
    catalog = p.where(k % 2 == 0).groupBy("p_brand").agg(_json(films_fetched_at=F.lit("2001-01-01"), films=F.collect_list(film)).alias("value"))
    found = F.struct((k % 7 != 0).alias("found"), F.lit(7.5).alias("imdb"), (k % 101).cast("int").alias("rt"), F.lit("English").alias("language"), F.lit("2001-01-01").alias("looked_up"))
    # one part of a title, as a key stands once in a document
    once = p.withColumn("key", X.film_key(F.col("p_name"), year)).withColumn("n", F.row_number().over(Window.partitionBy("key", k % 15).orderBy(k))).where("n = 1")
    keyed = lambda step, value: once.where(k % step == 0).groupBy("key").agg(F.min_by(value, k).alias("v")).select(F.to_json(F.create_map("key", "v")).alias("value"))
    return parsers.parsed_legacy(catalog.select("value"), keyed(3, found), keyed(5, (k % 11).cast("int")))


@query(f"WITH {_LEGACY} SELECT 'films' AS kind, key FROM films UNION ALL SELECT 'omdb', key FROM (SELECT DISTINCT key FROM f WHERE p_partkey % 3 = 0) JOIN films USING (key) UNION ALL SELECT 'ratings', key FROM (SELECT DISTINCT key FROM f WHERE p_partkey % 5 = 0) JOIN films USING (key) UNION ALL SELECT 'unmatched', key FROM asked WHERE key NOT IN (SELECT key FROM films)")
def legacy_parse(spark: SparkSession, d: str) -> DataFrame:
    """Keys of each table of a legacy import, and those that match no film."""
    found = _legacy(spark, d)
    one = lambda name: found[name].select(F.lit(name).alias("kind"), "key")
    return one("films").union(one("omdb")).union(one("ratings")).union(one("unmatched"))


@query("""WITH r AS (SELECT c_custkey AS query_id, n, CASE WHEN n = 1 AND c_custkey % 4 = 0 THEN c_custkey * 10 ELSE c_custkey * 10 + n END AS tmdb_id, 1900 + c_custkey % 100 + (c_custkey % 7) + n AS year, n AS pos FROM customer, range(0, 3) t(n)),
q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 5 <> 0 THEN 1900 + c_custkey % 100 END AS q_year FROM customer),
a AS (SELECT query_id FROM q WHERE q_year IS NOT NULL AND query_id NOT IN (SELECT query_id FROM r JOIN q USING (query_id) WHERE abs(r.year - q_year) <= 1)),
u AS (SELECT query_id, tmdb_id, pos, 0 AS turn FROM r UNION ALL SELECT query_id, query_id * 10 + 9, 0, 1 FROM a UNION ALL SELECT query_id, query_id * 10, 1, 1 FROM a)
SELECT query_id, tmdb_id, CAST(min(turn) AS INT) AS turn FROM u GROUP BY ALL""")
def search_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Answers of three results; a query with a year that none is near is asked again by year, and ids count once."""
    k = F.col("c_custkey")
    c = A.table(spark, d, "customer")
    result = lambda i, year: F.struct(i.alias("id"), F.lit("T").alias("title"), F.lit("T").alias("original_title"), _text(year, "-01-01").alias("release_date"), F.lit(1.5).alias("popularity"))
    three = F.array(*[result(k * 10 + n if n != 1 else F.when(k % 4 == 0, k * 10).otherwise(k * 10 + 1), 1900 + k % 100 + k % 7 + n) for n in range(3)])
    again = F.array(result(k * 10 + 9, 1900 + k % 100), result(k * 10, 1900 + k % 100))
    queries = c.select(k.alias("query_id"), F.when(k % 5 != 0, (1900 + k % 100).cast("int")).alias("year"))
    answer = lambda a: parsers.search_results(c.select(k.alias("query_id"), _json(results=a).alias("payload")))
    return parsers.reduced_search(queries, answer(three), answer(again)).select("query_id", "tmdb_id", "turn")


@query("SELECT CAST(p_partkey AS VARCHAR) AS itunes_id, 'https://video-ssl.itunes.apple.com/' || p_partkey AS url FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 <> 0")
def preview_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of asked ids; those of other hosts and without encryption are refused."""
    p, k = _part(spark, d)
    url = F.when(k % 5 == 0, F.when(k % 2 == 0, _text("https://apple.com.example/", k)).otherwise(_text("http://video-ssl.itunes.apple.com/", k))).otherwise(_text("https://video-ssl.itunes.apple.com/", k))
    answers = p.where(k % 2 == 0).select(_json(results=F.array(F.struct(k.alias("trackId"), url.alias("previewUrl")))).alias("payload"))
    return parsers.previews(p.where(k % 3 == 0).select(k.cast("string").alias("itunes_id")), answers)


@query("""WITH s AS (SELECT user_id AS query_id, event_id AS pos, 'tt' || (event_id % 9) AS tt, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS turn, event_id FROM events WHERE event_type IN ('click', 'view', 'purchase')),
g AS (SELECT query_id, tt, min((turn, pos)) AS w, arg_min('T' || event_id % 4, (turn, pos)) AS title, arg_min(CASE WHEN event_id % 3 = 0 THEN CAST(1950 + event_id % 50 AS INT) END, (turn, pos)) FILTER (WHERE event_id % 3 = 0) AS year,
  string_agg(DISTINCT 'T' || event_id % 4, ',' ORDER BY 'T' || event_id % 4) AS titles, CAST(max(event_id % 1000) AS INT) AS votes, bool_or(turn < 2) AS in_tmdb, bool_or(turn = 2) AS in_omdb FROM s GROUP BY query_id, tt),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w, tt) AS place FROM g) SELECT query_id, tt, title, year, titles, votes, in_tmdb, in_omdb, CAST(place AS INT) AS place FROM n WHERE place <= 6""")
def candidate_pools(spark: SparkSession, d: str) -> DataFrame:
    """Three searches of a query in one pool; six candidates of a query are the feature's limit."""
    e, k = A.table(spark, d, "events"), F.col("event_id")
    rows = lambda kind: e.where(F.col("event_type") == kind).select(
        F.col("user_id").alias("query_id"), k.alias("pos"), _text("tt", k % 9).alias("tt"), F.lit(None).cast("long").alias("tmdb_id"), _text("T", k % 4).alias("title"),
        F.when(k % 3 == 0, (1950 + k % 50).cast("int")).alias("year"), F.lit(None).cast("string").alias("director"), (k % 1000).cast("int").alias("votes"),
    )
    pool = parsers.candidate_pool({"tmdb": rows("click"), "tmdb_year": rows("view"), "omdb": rows("purchase")})
    return pool.select("query_id", "tt", "title", "year", F.array_join("titles", ",").alias("titles"), "votes", "in_tmdb", "in_omdb", "place")


@query("""SELECT p_partkey AS film_id, CASE WHEN p_partkey % 4 = 0 THEN 'gone' WHEN p_partkey % 4 = 1 THEN 'film' WHEN p_partkey % 4 = 2 THEN 'supplement' ELSE 'retry' END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN 'October ' || (p_partkey % 28 + 1) END AS label, 'March ' || (p_partkey % 27 + 1) AS expiry, CAST((10 - 3 + 12) % 12 AS INT) AS ahead,
  CASE WHEN p_partkey % 5 = 0 THEN 'https://s.example/?q=' || replace(p_name, ' ', '%20') ELSE 'https://l.example/' || p_partkey END AS watch, 'com.apple.tv://tv.apple.com/movie/' || p_partkey AS app FROM part""")
def link_functions(spark: SparkSession, d: str) -> DataFrame:
    """Redirects, leaving labels, expiry dates and links of a title."""
    p, k = _part(spark, d)
    status = F.when(k % 4 == 0, 404).when(k % 4 == 3, 500).otherwise(302)
    location = F.when(k % 4 == 1, _text("https://w.example/films/", k)).when(k % 4 == 2, "https://w.example/extras/1")
    slug = F.when(k % 3 == 0, _text("leaving-october-", k % 28 + 1)).otherwise("arriving-soon")
    # an instant soon after midnight by UTC is on the evening before
    instant = _text("2001-03-", F.lpad((k % 27 + 2).cast("string"), 2, "0"), "T03:30:00Z")
    template = F.when(k % 5 == 0, "https://s.example/?q={title}")
    return p.select(
        k.alias("film_id"), X.redirect_kind(status, location).alias("kind"), X.leaving_label(slug).alias("label"), X.expiry_label(instant).alias("expiry"), X.soonest_key(F.lit(10), k % 28, F.lit(3))["ahead"].cast("int").alias("ahead"),
        X.watch_url(template, _text("https://l.example/", k), F.col("p_name")).alias("watch"), X.app_url(k.cast("string")).alias("app"),
    )


@query("""SELECT p_partkey AS film_id, CASE WHEN p_size + 1860 BETWEEN 1880 AND 2028 THEN CAST(p_size + 1860 AS INT) END AS year, CAST(p_size + 1950 AS INT) AS lead_year, CAST(p_partkey * 1000 AS INT) AS votes,
  CAST(p_size AS INT) AS minutes, CAST(round_even((p_size * 60 + 30) / 60.0, 0) AS INT) AS from_seconds, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|B' ELSE '' END AS names, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS genre,
  nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN p_type || ' ' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END), '') AS embedding_text, CASE WHEN p_partkey % 11 >= 6 THEN CAST(greatest(1, 11 - p_partkey % 11) AS INT) END AS tier FROM part""")
def value_functions(spark: SparkSession, d: str) -> DataFrame:
    """Years, votes, running times, string lists, genres, embedding texts and tiers as sources spell them."""
    p, k = _part(spark, d)
    size = F.col("p_size").cast("string")
    thousands = F.when(k * 1000 < 1000, (k * 1000).cast("string")).otherwise(F.format_number(k * 1000, 0))
    return p.select(
        k.alias("film_id"), X.sane_year(_text(F.col("p_size") + 1860, "-01-01"), 2026).alias("year"), X.leading_year(_text(F.col("p_size") + 1950, "–2001")).alias("lead_year"), X.votes(thousands).alias("votes"), X.minutes(_text(size, " min")).alias("minutes"),
        X.minutes_of_seconds((F.col("p_size") * 60 + 30).cast("string")).alias("from_seconds"), F.array_join(X.string_list(F.when(k % 2 == 0, _text('["', F.col("p_brand"), '","B"]')).otherwise("none")), "|").alias("names"),
        X.norm_genre(F.col("p_type")).alias("genre"), X.embedding_text(F.when(k % 3 == 0, F.col("p_type")), F.lit(" "), F.when(k % 2 == 0, F.col("p_brand"))).alias("embedding_text"), X.tier_for_score(k % 11).cast("int").alias("tier"),
    )


@query("""SELECT p_partkey AS film_id, 'The ' || p_name AS base, p_partkey % 2 = 0 AS edition, CASE WHEN p_partkey % 3 = 0 THEN CAST(1950 + p_size AS BIGINT) END AS said, 'The ' || p_name AS clean,
  lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS bare, lower(p_name) AS audit, lower(regexp_replace('The ' || p_name, '[^A-Za-z0-9]', '', 'g')) AS norm FROM part""")
def title_functions(spark: SparkSession, d: str) -> DataFrame:
    """Editions, years and articles of titles such as "The X (1999) (Director's Cut)"."""
    p, k = _part(spark, d)
    base = F.concat(F.lit("The "), "p_name")
    dated = F.concat(base, F.when(k % 3 == 0, _text(" (", F.col("p_size") + 1950, ")")).otherwise(""))
    title = F.concat(dated, F.when(k % 2 == 0, F.when(k % 4 == 0, " (Director's Cut)").otherwise(" [4K Restoration]")).otherwise(""))
    return p.select(
        k.alias("film_id"), T.clean_title(T.without_editions(base)).alias("base"), T.has_edition(title).alias("edition"), T.embedded_year(title).cast("long").alias("said"), T.clean_title(title).alias("clean"),
        T.article_norm(base).alias("bare"), T.audit_title(base).alias("audit"), T.norm_title(T.clean_title(title)).alias("norm"),
    )
