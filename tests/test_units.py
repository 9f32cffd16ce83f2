"""Functions, operators and parsers on small inputs with known answers."""

from __future__ import annotations

import datetime as dt
import json
import random
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from lumidex import schemas
from lumidex.functions import expressions as X
from lumidex.functions import text as T
from lumidex.functions.stemming import stem
from lumidex.operators import audit, currency, matching, ranker, reports, resolution, search, views, worklists, writes
from lumidex.operators.graph import connected_components
from lumidex.plans import adapters, catalogue
from lumidex.sources import parsers
from lumidex.streaming import sync

DAY = dt.date(2026, 8, 19)


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def saver(spark):
    folder = spark.conf.get("spark.checkpoint.dir")

    def save(df, label):
        path = f"{folder}/test-{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def test_scalars(spark):
    lit = F.lit
    assert one(spark, X.film_key(lit(" Alpha "), lit(None).cast("int")), X.service_slug(lit("-A & B+ ")), X.norm_genre(lit("Film-Noir"))) == ("alpha (None)", "a-b", "filmnoir")
    assert one(spark, X.printed_rank(lit("=6"), lit(9)), X.printed_rank(lit(None), lit(9)), X.printed_rank(lit("x"), lit(9))) == (6, 9, 9)
    assert one(spark, X.minutes_of_seconds(lit("150")), X.minutes_of_seconds(lit("210")), X.minutes(lit("95 min")), X.votes(lit("1,234")), X.votes(lit("?"))) == (2, 4, 95, 1234, 0)
    low, none = one(spark, X.lowest_price(lit("2020-01-01:+9.99~x:-4.99~y:bad~z:0")), X.lowest_price(lit("")))
    assert str(low) == "4.99" and none is None
    assert one(spark, X.tier_for_score(lit(10)), X.tier_for_score(lit(6)), X.tier_for_score(lit(5)), X.queue_key(20260819, lit(42))) == (1, 5, None, 993965849)
    assert one(spark, X.watch_url(lit("https://s/?q={title}"), lit("u"), lit("Two & One")), X.watch_url(lit(None), lit("u"), lit("t"))) == ("https://s/?q=Two%20%26%20One", "u")
    assert one(spark, X.leaving_label(lit("leaving-october-31")), X.expiry_label(lit("2026-11-01T03:00:00Z")), X.sane_year(lit("1879-01-01"), 2026)) == ("October 31", "October 31", None)
    assert one(spark, X.trigrams(lit("Abcd")), X.trigrams(lit("ab")), X.string_list(lit('["a","b"]')), X.string_list(lit("x"))) == (["abc", "bcd"], [], ["a", "b"], [])


def test_titles(spark):
    lit = F.lit
    assert one(spark, T.norm_title(lit("Tête & $ Vol. 2: “Volcano”")), T.without_editions(lit("Alpha (Director's Cut) [4K]")), T.without_editions(lit("(4K)")), T.clean_title(lit("Alpha (1988) – Special Edition"))) == ("teteandsvolume2volcano", "Alpha", "(4K)", "Alpha")
    assert one(spark, T.embedded_year(lit("Alpha (1954) (Restored)")), T.colon_prefix(lit("Alpha Beta: Gamma")), T.colon_prefix(lit("Alpha: Gamma")), T.article_norm(lit("The Ring")), T.audit_title(lit("Les Été (uncut)"))) == (1954, "Alpha Beta", None, "ring", "ete")
    assert one(spark, T.same_director(lit("Jane Bogart"), lit("Bogart, Jane and Al Xu")), T.same_director(lit("Jane Bogart"), lit("Al Xuan")), T.same_director(lit(""), lit("A"))) == (True, False, None)
    a, b, bound = one(spark, T.similarity(lit("bogrt"), lit("Humphrey Bogart")), T.similarity(lit("bogrt"), lit("Lena Brogren")), T.length_bound(lit("bogrt"), lit("Humphrey Bogart")))
    assert round(a, 3) == 0.853 and b < 0.6 and bound >= a


def test_stems():
    known = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "falling": "fall", "sky": "sky", "happy": "happi", "adjustment": "adjust", "agreed": "agre", "motoring": "motor", "generalizations": "gener", "controlling": "control", "hopeful": "hope", "cats": "cat"}
    assert {w: stem(w) for w in known} == known


def test_query_language():
    q = search.read_query('alpha by:"Howard Hawks" year:1940-1950 nofield:x genre:')
    assert q.free == "alpha" and q.fields["director"] == ["Howard Hawks"] and q.fields["year"] == ["1940-1950 nofield: x"] and len(q.hints) == 2
    assert search.year_range("1950") == (1950, 1950) and search.year_range("1950-") == (1950, None) and search.year_range("1960-1950") is None and search.year_range("-") is None


def corpus(spark):
    films = spark.createDataFrame([(1, "Alpha", 1946), (2, "Beta", 1950), (3, "Gamma", 1960)], "film_id long, title string, year int")
    texts = spark.createDataFrame([(1, "Alpha", "A private eye.", "Sternwood."), (2, "Beta", "A nurse in the alpha ward.", "Alpha shift."), (3, "Gamma", None, None)], "film_id long, title string, overview string, plot string")
    persons = spark.createDataFrame([(1, "Humphrey Bogart"), (2, "Jane Bogart"), (3, "Howard Hawks")], "id long, name string")
    credits = spark.createDataFrame([(1, 1, "cast", "", "", "Philip Marlowe", 0), (2, 2, "cast", "", "", "Nurse", 0), (1, 3, "crew", "Director", "Directing", "", 0), (2, 3, "crew", "Director", "Directing", "", 0)], "film_id long, person_id long, kind string, job string, department string, character string, ord int")
    genres = spark.createDataFrame([(1, "Film-Noir"), (1, "Crime")], "film_id long, genre string")
    keywords = spark.createDataFrame([(1, "film noir"), (2, "hospitals")], "film_id long, keyword string")
    options = spark.createDataFrame([(1, "Stream")], "film_id long, name string")
    return {"films": films, "texts": texts, "persons": persons, "credits": credits, "genres": genres, "keywords": keywords, "options": options}


def test_search(spark):
    t = corpus(spark)
    ids = lambda q: [r["film_id"] for r in search.search(q, **t).collect()]
    assert ids("alpha") == [1, 2] and ids("director:Howard Hawks year:1950") == [2] and ids("genre:film noir") == [1] and ids("keyword:hospital") == [2] and ids("actor:Jane Bogart actor:Humphrey Bogart") == [1, 2] and ids("year:bad") == []
    names = t["persons"].withColumns({"key": F.col("id"), "weight": F.lit(1)})
    assert search.corrected(names, "Humphry Bogart") == ("Humphrey Bogart", [])
    assert search.corrected(names, "zzz") == (None, [])
    credits = reports.directors(t["credits"], t["persons"]).collect()
    assert {tuple(r) for r in credits} == {(1, "Howard Hawks"), (2, "Howard Hawks")}


def test_search_corrects_names(spark):
    t = corpus(spark)
    t["options"] = spark.createDataFrame([(1, "kino", "Kino Film Collection"), (3, "mu", "Stream")], "film_id long, slug string, name string")
    t["keywords"] = t["keywords"].union(spark.createDataFrame([(3, "dystopia"), (1, "distant future")], "film_id long, keyword string"))
    ids = lambda q: [r["film_id"] for r in search.search(q, **t).collect()]
    assert ids("actor:Humphry Bogart") == [1] and ids("director:Howard Hwaks year:1950") == [2] and ids("director:Jane Bogart") == []
    assert ids('actor:"Humphry Bogart"') == [] and ids("actor:zz") == []
    assert ids("character:Phillip Marlowe") == [1] and ids("keyword:hospitl") == [2] and ids('keyword:"hospitl"') == []
    assert ids("service:kino") == [1] and ids("service:MU") == [3] and ids("service:Streem") == [3] and ids("service:kino film colection") == [1] and ids('service:"Streem"') == []
    assert ids("dystopian") == [3] and ids("dystopian future") == []
    assert search.search("service:Streem", **corpus(spark)).first()["film_id"] == 1


def test_hybrid_search(spark):
    t = corpus(spark)
    near = spark.createDataFrame([(2, 0.2), (3, 0.4)], "film_id long, distance double")
    got = lambda q: [(r["film_id"], r["stage"]) for r in search.hybrid_search(q, near, **t).collect()]
    assert got("ward") == [(2, 0), (3, 1)] and got("ward year:1950") == [(2, 0)] and got("nothing year:1960") == [(3, 1)]
    assert {x[1] for x in got("alpha")} == {0} and {x[0] for x in got("alpha")} == {1, 2} and got("year:1946") == [(1, 0)]


def test_currency(spark):
    listings = spark.createDataFrame([(1, "a", "u", dt.date(2026, 1, 1), dt.date(2026, 8, 1)), (2, "a", "u", dt.date(2026, 1, 1), dt.date(2026, 7, 1)), (3, "b", "u", dt.date(2026, 1, 1), dt.date(2026, 2, 1))], "film_id long, source string, url string, first_seen date, last_seen date")
    assert {r["film_id"] for r in currency.departed(listings).collect()} == {2}
    batch = spark.createDataFrame([(1, "a", "n", DAY), (2, "a", "n", DAY), (4, "a", "n", DAY)], "film_id long, source string, url string, seen date")
    assert {r["film_id"] for r in currency.arrivals(batch, listings).collect()} == {2, 4}
    assert currency.arrivals(batch, listings, quiet=True).count() == 0
    carried = currency.carried_forward(listings, spark.createDataFrame([(1,), (2,)], "film_id long"), DAY).collect()
    assert {r["film_id"]: r["last_seen"] for r in carried} == {1: DAY, 2: dt.date(2026, 7, 1), 3: dt.date(2026, 2, 1)}
    after = {r["film_id"]: (r["url"], r["first_seen"], r["last_seen"]) for r in currency.seen_again(listings, batch).collect()}
    assert after[1] == ("n", dt.date(2026, 1, 1), DAY) and after[4] == ("n", DAY, DAY) and after[3][0] == "u"


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", None)], "k long, v string, payload string")
    new = spark.createDataFrame([(1, "c", None), (3, "d", "q")], "k long, v string, payload string")
    assert {tuple(r) for r in writes.upsert(old, new, ["k"], prefer_new_if_known=("payload",)).collect()} == {(1, "c", "p"), (2, "b", None), (3, "d", "q")}
    assert {tuple(r) for r in writes.upsert(old, new, ["k"], keep_old=("v",)).collect()} == {(1, "a", None), (2, "b", None), (3, "d", "q")}
    assert {r["k"] for r in writes.insert_missing(old, new, ["k"]).collect()} == {1, 2, 3}
    d = spark.createDataFrame([(1, "merged", 2), (2, "merged", 3), (4, "tombstoned", None), (8, "merged", 9), (9, "merged", 8)], "film_id long, kind string, survivor_id long")
    assert {tuple(r) for r in writes.canonical(d, saver(spark)).collect()} == {(1, 3), (2, 3), (8, 8), (9, 8)}
    films = spark.createDataFrame([("A", None), ("A", 1950), ("B", None), ("C", None)], "title string, year int")
    known = spark.createDataFrame([("b", 1960), ("c", 1970), ("c", 1971)], "title string, year int")
    assert {tuple(r) for r in writes.fold_yearless(films, known).collect()} == {("A", 1950), ("B", 1960), ("C", None)}
    order = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "tier int, film_id long, position int")
    put = spark.createDataFrame([(1, 7, 1)], "tier int, film_id long, slot int")
    assert {tuple(r) for r in writes.inserted_at(order, put.withColumn("slot", F.col("slot")), ["tier"]).collect()} == {(1, 5, 1), (1, 7, 2), (1, 6, 3)}


def test_schemas(spark):
    assert all(schemas.struct(t) for t in schemas.TABLES)
    rows = spark.createDataFrame([(1, 11, DAY), (2, 3, DAY)], schemas.TABLES["my_ratings"])
    good, bad = schemas.split_rejects(rows, "my_ratings")
    assert [r["film_id"] for r in good.collect()] == [2] and [r["film_id"] for r in bad.collect()] == [1]
    assert schemas.key_violations(rows.union(rows), "my_ratings").count() == 2


def test_ranker(spark):
    log = [(1, 1, 7, "worse"), (2, 1, 7, "worse"), (3, 1, 7, "better"), (4, 1, 8, "better")]
    steps = ranker.next_steps(spark.createDataFrame(log, "id long, session_id long, film_id long, verdict string")).collect()
    assert {(r["film_id"], r["action"], r["tier"]) for r in steps} == {(7, "place", 4), (8, "ask", 2)}
    with pytest.raises(Exception, match="no step follows"):
        ranker.next_steps(spark.createDataFrame([(i, 1, 7, "better") for i in range(3)], "id long, session_id long, film_id long, verdict string")).collect()
    order = spark.createDataFrame([(1, 1, 10 + i, i + 1) for i in range(5)], "session_id long, tier int, film_id long, position int")
    verdicts = spark.createDataFrame([(1, 1, 99, 13, "better"), (1, 1, 99, 10, "worse"), (1, 1, 98, 11, "worse"), (1, 1, 98, 12, "better")], "session_id long, tier int, film_id long, other_film_id long, verdict string")
    assert {(r["film_id"], r["low"], r["high"], r["probe"]) for r in ranker.insertion_bounds(order, verdicts).collect()} == {(99, 1, 3, 12), (98, 2, 2, None)}


def test_queue_order(spark):
    late = {3: dt.date(2026, 1, 2), 9: dt.date(2026, 1, 1), 4: dt.date(2026, 1, 2)}
    pool = spark.range(300).withColumnRenamed("id", "film_id")
    deferred = spark.createDataFrame(list(late.items()), "film_id long, deferred_on date")
    got = [r["film_id"] for r in ranker.queue(pool, 7, deferred, pool.where("film_id % 50 = 1")).orderBy("place").collect()]
    fresh = sorted((i for i in range(300) if i not in late and i % 50 != 1), key=lambda i: (zlib.crc32(f"7:{i}".encode()), i))
    assert got == [*fresh, 9, 3, 4]


PAIR = "q_id string, q_title string, q_forms array<string>, q_year int, q_class string, q_director string, q_editions array<string>, c_id string, c_titles array<string>, c_year int, c_directors string, c_votes int, c_kind string, c_in_tmdb boolean, c_in_omdb boolean, c_omdb_title string"


def test_resolver_rules(spark):
    def pair(q, title, year, cls, director, c, c_title, c_year, c_dir, votes, keyed=True, kind="movie"):
        return (q, title, [title], year, cls, director, [], c, [c_title], c_year, c_dir, votes, kind, keyed, keyed, c_title)

    rows = [
        pair("a", "Alpha", 1950, "database", "Jane Bogart", "t1", "Alpha", 1950, "Jane Bogart", 5), pair("a", "Alpha", 1950, "database", "Jane Bogart", "t2", "Alpha", 1950, "Al Xuan", 9000),
        pair("b", "Beta", 1950, "database", None, "t3", "Beta", 1951, None, 10), pair("c", "Gamma", 1950, "database", "Jane Bogart", "t4", "Gamma", 1950, "Al Xuan", 10),
        pair("d", "Delta", 1990, "mc", None, "t5", "Delta", 1950, None, 10), pair("e", "Epsilon", 1990, "apple-field", None, "t6", "Epsilon", 1950, None, 10), pair("e", "Epsilon", 1990, "apple-field", None, "t7", "Epsilon", 1990, None, 10),
        pair("f", "Bride of Kino", 1935, "database", None, "t8", "The Bride of Kino", 1935, None, 10), pair("g", "Zeta", 1950, "database", None, "t9", "Omega", 1950, None, 10),
        pair("h", "Kappa", 1950, "database", None, "t10", "Kappa", 1950, None, 50000, False), pair("h", "Kappa", 1950, "database", None, "t11", "Kappa", 1951, None, 100, False),
    ]
    got = {r["q_id"]: (r["kind"], r["c_id"], r["reason"]) for r in matching.resolve(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == {
        "a": ("match", "t1", "director corroborated"), "b": ("match", "t3", "exact title + year + agreement"), "c": ("review", None, "director conflicts only"),
        "d": ("match", "t5", "unique older exact title (commerce year = re-release)"), "e": ("review", None, "rerelease-ambiguous"), "f": ("match", "t8", "exact title + year + agreement"),
        "g": ("review", None, "no candidates"), "h": ("match", "t10", "votes dominate among year-near exact titles"),
    }


def test_match_verdicts(spark):
    films = spark.createDataFrame([(1, "Alpha", 1946, "A B", 100, None), (2, "Beta", 1950, None, None, 3.0), (3, "Beta", 1950, None, None, 1.0), (4, "Gamma Ray: One", 1960, None, None, None)], "id long, title string, year int, director string, runtime_min int, popularity double")
    queries = spark.createDataFrame(
        [(1, "Álpha (Restored)", 1947, "database", None, None, True), (2, "Beta", 1950, "database", None, None, False), (3, "Gamma Ray", None, "commerce", None, None, False), (4, "Nothing", 1950, "database", None, None, False), (5, "Alpha", 1990, "database", None, None, False), (6, "Alpha", 1990, "commerce", None, None, False), (7, "Alpha", 1990, "commerce", "x, a b", None, False)],
        "id long, title string, year int, year_kind string, director string, runtime_min int, edition_hint boolean",
    )
    got = {r["id"]: (r["kind"], r["film_id"], r["reason"]) for r in matching.verdicts(queries, films).collect()}
    assert got == {1: ("match", 1, None), 2: ("review", None, "ambiguous"), 3: ("review", None, "weak-title"), 4: ("create", None, None), 5: ("review", None, "conflict"), 6: ("review", None, "year-gap"), 7: ("match", 1, None)}
    assert {r["id"]: r["film_id"] for r in matching.verdicts(queries, films, popularity=True).collect()}[2] == 2


def test_audit(spark):
    row = (1, "Alpha", 1946, "Jane Bogart", 80, "Alpha", 1950, "Al Xuan", 100, "tt1", "movie", "7.0", 81, "tt2", "Beta", None, 120)
    subject = spark.createDataFrame([row], "film_id long, title string, year int, director string, mc_score int, omdb_title string, omdb_year int, omdb_director string, omdb_runtime_min int, omdb_imdb_id string, omdb_type string, omdb_imdb_rating string, omdb_metascore int, tmdb_imdb_id string, tmdb_title string, tmdb_original_title string, tmdb_runtime_min int")
    found = audit.flags(audit.with_shared_ids(subject))
    assert [r["reason"] for r in found.collect()] == ["director", "imdb-id", "mc-score", "runtime", "tmdb-title", "year"]
    assert audit.worst(found).first()["total"] == 14


def test_worklists(spark):
    films = spark.createDataFrame([(i, "movie") for i in range(1, 6)], "film_id long, kind string")
    omdb = spark.createDataFrame([(1, True, False, False, DAY), (2, False, False, True, DAY), (3, False, False, False, DAY), (4, True, True, False, DAY)], "film_id long, found boolean, needs_refresh boolean, year_fallback boolean, looked_up date")
    assert {r["film_id"] for r in worklists.needing_lookup(films, omdb, DAY).collect()} == {3, 4, 5}
    assert {r["film_id"] for r in worklists.needing_lookup(films, omdb, DAY + dt.timedelta(30)).collect()} == {2, 3, 4, 5}


def test_row_filter(spark):
    rows = [(1, "Alpha", "Jane B", "English, French", 1946), (2, "Beta", None, None, None), (3, "alphabet", "Al", "French", 1990)]
    view = spark.createDataFrame(rows, "film_id long, title string, director string, language string, year int")
    ids = lambda **k: [r["film_id"] for r in resolution.row_filter(view, **k).collect()]
    assert ids(title="ALPHA") == [1, 3] and ids(languages=("French",)) == [1, 3] and ids(languages=("English",)) == [1] and ids(ranges={"year": (1950, None)}) == [3] and ids(director="jane") == [1] and ids() == [1, 2, 3]


def test_nearest_titles(spark):
    films = corpus(spark)["films"].union(spark.createDataFrame([(4, "Alpha", 1990), (5, "The Blue Alpha", 1970)], "film_id long, title string, year int"))
    asked = spark.createDataFrame([(1, "alpha", 1946), (2, "Alpha (1990)", None), (3, "alpha blue", None), (4, "the", None)], "query_id long, title string, year int")
    got = {(r["query_id"], r["film_id"], r["stage"]) for r in resolution.nearest_titles(films, asked).collect()}
    assert {x for x in got if x[0] != 2} == {(1, 1, 0), (3, 5, 1)}


def test_nearest_titles_inside_others(spark):
    """A query that no title's words hold is found inside normalised titles, in any year; equal queries each get their rows."""
    films = spark.createDataFrame([(1, "The Blue Angel", 1930), (2, "Blue", 1993), (3, "Bluebeard", 1972), (4, None, None), (5, "!", 1950), *[(10 + i, f"Xylo{i}phone", 2000 - i) for i in range(7)]], "film_id long, title string, year int")
    asked = spark.createDataFrame([(1, "blueang", None), (2, "blueang", 1950), (3, "blueang", None), (4, "u", None), (5, "th", None), (6, "blue", None), (7, "the", None), (8, None, None), (9, "xylo", None), (10, "zzz", None), (11, "bluean gelx", None)], "query_id long, title string, year int")
    got: dict = {}
    for r in resolution.nearest_titles(films, asked).collect():
        got.setdefault(r["query_id"], []).append((r["film_id"], r["stage"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 2)], 2: [(1, 2)], 3: [(1, 2)], 4: [(1, 2), (2, 2), (3, 2)], 5: [(1, 2)], 6: [(2, 0)], 9: [(12 + i, 2) for i in range(5)]}


def test_nearest_titles_of_many_films(spark, tmp_path):
    """An ambiguous title gives all its films, a near one its first five by year and number; films and queries are not broadcast, however small their files are."""
    spark.createDataFrame([(i, "Alpha Two", 1900 + i % 3) for i in range(30)] + [(100, "Beta Two", None), (101, "Two Alpha", 1899)], "film_id long, title string, year int").write.parquet(f"{tmp_path}/films")
    spark.createDataFrame([(i, t, None) for i in range(50) for t in ("alpha two", "the alpha", "two")], "n long, title string, year int").withColumn("query_id", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/asked")
    films, asked = spark.read.parquet(f"{tmp_path}/films"), spark.read.parquet(f"{tmp_path}/asked")
    found = resolution.nearest_titles(films, asked)
    assert found._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") >= 2
    title = {r["query_id"]: r["title"] for r in asked.collect()}
    got: dict = {}
    for r in found.collect():
        got.setdefault((r["query_id"], title[r["query_id"]]), set()).add((r["film_id"], r["stage"]))
    want = {"alpha two": {(i, 0) for i in range(30)}, "the alpha": {(101, 1), (0, 1), (3, 1), (6, 1), (9, 1)}, "two": {(100, 1), (101, 1), (0, 1), (3, 1), (6, 1)}}
    assert len(got) == 150 and all(v == want[k[1]] for k, v in got.items())


def test_rows_without_a_key_are_dealt_out(spark):
    """Titles without ids, and rows that a place within equal keys does not concern, do not meet in one task."""
    from lumidex.operators import placement

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    rows = spark.range(2000).select(F.col("id").alias("pos"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("tt"), "id")).alias("tt"), F.lit(None).cast("string").alias("tmdb_id"), F.lit(None).cast("long").alias("holder"))
    held = spark.createDataFrame([("imdb", "tt100", 7, False), ("tmdb", "5", 8, True)], "authority string, value string, holder long, hidden boolean")
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        largest = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        found = placement.with_holder(rows.drop("holder"), held)
        numbered = rows.withColumn("nth", placement._nth(F.col("tt").isNotNull(), "tmdb_id", order=["pos"]))
        assert largest(found) < 1000 and largest(numbered) < 1000
        assert [(r["pos"], r["holder"]) for r in found.where("holder is not null").collect()] == [(100, 7)] and found.count() == 2000
        assert {(r["pos"], r["nth"]) for r in numbered.where("nth is not null").collect()} == {(100 * i, i + 1) for i in range(20)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_registered_queries_ask_all(spark):
    """Each part's title and each customer's title is asked, whatever its number."""
    from lumidex.plans import catalogue

    data = "/root/testdata/sf0.001"
    ids = lambda name, key: {r[0] for r in catalogue.QUERIES[name](spark, data).select(key).distinct().collect()}
    assert ids("nearest_titles", "query_id") == {r[0] for r in spark.read.parquet(f"{data}/part.parquet").select("p_partkey").collect()}
    asked = {r[0] for r in spark.read.parquet(f"{data}/customer.parquet").select("c_custkey").collect()}
    assert ids("resolver", "q_id") == asked


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), saver(spark)).collect()
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got} == {k: v for k, v in label.items() if k not in alone}


def test_list_files(spark, tmp_path):
    (tmp_path / "best.tsv").write_text("# slug: best\n# name: The Best\n# published: 2020\n# ordered: yes\n1\tAlpha\tJane\ttt12\t1946\n=1\tBeta\n\n3\tGamma\t\t\t1960\n")
    lists, entries = parsers.list_files(spark, str(tmp_path))
    assert lists.first().asDict() == {"slug": "best", "name": "The Best", "curator": None, "published_year": 2020, "source_url": None, "ordered": True}
    assert [tuple(r)[1:] for r in entries.orderBy("rank").collect()] == [(1, None, "Alpha", "Jane", "tt12", 1946), (2, "=1", "Beta", None, None, None), (3, None, "Gamma", None, None, 1960)]


def test_payloads(spark):
    omdb = {"Response": "True", "imdbRating": "7.5", "Metascore": "N/A", "Language": "N/A", "Ratings": [{"Source": "Rotten Tomatoes", "Value": "91%"}]}
    rows = parsers.omdb_records(spark.createDataFrame([(1, json.dumps(omdb)), (2, '{"Response":"False"}')], "film_id long, payload string")).collect()
    assert (rows[0]["found"], rows[0]["imdb"], rows[0]["rt"], rows[0]["metacritic"], rows[0]["language"], rows[1]["found"]) == (True, 7.5, 91, None, None, False)
    one_p = {"provider_id": 8, "provider_name": "S"}
    got = parsers.provider_payloads(spark.createDataFrame([(1, json.dumps({"results": {"US": {"flatrate": [one_p], "buy": [one_p]}}}))], "film_id long, payload string")).collect()
    assert {(r["provider_id"], r["offer"]) for r in got} == {(8, "flatrate"), (8, "buy")}
    credit = {"id": 5, "title": "A", "runtime": 0, "release_date": "1946-01-01", "genres": [{"name": "Crime"}], "keywords": {"keywords": [{"name": "k"}]}, "credits": {"cast": [{"id": 1, "name": "B", "character": "C", "order": 0}], "crew": [{"id": 2, "name": "D", "job": "Director", "department": "Directing"}] * 2}}
    out = parsers.credit_payloads(spark.createDataFrame([(1, json.dumps(credit))], "film_id long, payload string"))
    assert out["facts"].first()["runtime_min"] is None and out["credits"].count() == 2 and out["keywords"].first()["keyword"] == "k"
    island = [0, {"title": 2, "slug": 3, "premiereYear": 4, "criticScoreSummary": 5}, "Alpha", "alpha", 1946, {"score": 6}, 80, {"title": 99, "slug": 3, "premiereYear": 4, "criticScoreSummary": 5}]
    html = f'<html><script type="application/json" id="__NUXT_DATA__">{json.dumps(island)}</script></html>'
    assert [tuple(r) for r in parsers.page_cards(spark.createDataFrame([(2, html)], "page int, html string")).collect()] == [("alpha", "Alpha", 1946, 80, 25, 2)]
    lines = spark.createDataFrame([("Alpha\t1946\t5430",), ("Beta\tmissing value\t",), ("no tab",)], "value string")
    assert [tuple(r) for r in parsers.library_export(lines).collect()] == [("Alpha", 1946, 90), ("Beta", None, None)]


def test_legacy_import(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps({"films_fetched_at": "2026-01-01", "films": [{"title": "Alpha", "year": 1946, "director": "J", "url": "u"}]}))
    (tmp_path / "cache.json").write_text(json.dumps({"alpha (1946)": {"found": True, "imdb": 7.5}, "beta (None)": {"found": False}}))
    (tmp_path / "annotations.json").write_text(json.dumps({"alpha (1946)": 8}))
    out = parsers.legacy_import(spark, str(tmp_path))
    assert out["films"].count() == 1 and out["omdb"].first()["imdb"] == 7.5 and out["ratings"].first()["score"] == 8 and [r["key"] for r in out["unmatched"].collect()] == ["beta (None)"]


def test_store_products(spark):
    items = [{"id": "1", "title": "A", "kind": "movie", "imdb_id": "t1"}, {"id": "2", "title": "[removed] A", "kind": "movie", "imdb_id": "t1"}, {"id": "x", "title": "B", "kind": "movie"}, {"id": "3", "title": "C", "kind": "movie", "imdb_id": "t2"}, {"id": "4", "title": "C", "kind": "movie", "imdb_id": "t2"}]
    products = parsers.store_products(spark.createDataFrame([(0, json.dumps({"results": items}))], "pos int, payload string"))
    targets = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "film_id long, imdb_id string")
    assert {tuple(r) for r in parsers.confirmed_product(targets, products).collect()} == {(1, "1", "matched"), (2, None, "ambiguous"), (3, None, "unmatched")}
    assert one(spark, X.embedding_text(F.lit(" a "), F.lit(None), F.lit("b")), X.embedding_text(F.lit(""), F.lit(None), F.lit(None)), X.app_url(F.lit("5"))) == ("a b", None, "com.apple.tv://tv.apple.com/movie/5")


def test_ratings_csv_by_lines(spark, tmp_path):
    """Each file has its own header and its own numbers, blank lines counted; a file is read in splits and never as one row."""
    (tmp_path / "a.csv").write_text('Title,Rated,Rating,Year\r\n"A, B",x,4,1946\r\n\r\nC,y,1,n/a\r\n')
    (tmp_path / "b.csv").write_text("year,RATING ,title\n1950,2,D\n" + "".join(f"{1900 + i % 100},{i % 5 + 1},T{i}\n" for i in range(400)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = parsers.ratings_csv(spark, str(tmp_path), "s")
        assert found.rdd.getNumPartitions() > 1
        got = {(r["line"], r["title"], r["year"], r["stars"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {(1, "A, B", 1946, 4), (3, "C", None, 1), (1, "D", 1950, 2), *[(i + 2, f"T{i}", 1900 + i % 100, i % 5 + 1) for i in range(400)]}
    lines = spark.createDataFrame([("f", "s", 0, "rating,title"), ("f", "s", 1, "9,A")], "file string, source string, line int, value string")
    with pytest.raises(Exception, match="not from 1 to 5"):
        parsers.parsed_ratings(lines).collect()


def test_observations(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"url":"u","film_id":1,"status":301}\n{"url":"u","film_id":2,"status":404}\n{"url":"v","fil')
    assert [(r["url"], r["film_id"]) for r in parsers.observations(spark, str(tmp_path)).collect()] == [("u", 2)]


def test_view_of_nothing(spark):
    empty = {t: spark.createDataFrame([], schemas.struct(t)) for t in schemas.TABLES}
    films = empty["films"].withColumns({"metacritic": F.lit(1), "rt": F.lit(1), "imdb": F.lit(1.0)})
    view = views.film_view(films, empty["listings"], empty["movie_service"], ratings=empty["my_ratings"], owned=empty["owned"], watchlist=empty["watchlist"], entries=empty["film_list_entry"], lists=empty["film_list"], transitions=empty["availability_transitions"], viewings=empty["viewing"], store_ids=empty["external_ids"], wishlist=empty["cheapcharts_wishlist"], dispositions=empty["film_disposition"], today=DAY)
    assert view.count() == 0 and views.chip_counts(view, DAY).count() == 15
    with pytest.raises(KeyError):
        views.matching(view, ["no such chip"], DAY)


def test_vocabulary(spark):
    texts = spark.createDataFrame([("b a b", None), ("B c", "a a"), (None, None)], "x string, y string")
    assert sorted(map(tuple, search.vocabulary(texts, ["x", "y"]).collect())) == [("a", 2, 3), ("b", 2, 3), ("c", 1, 1)]


def test_sync_stream(spark, tmp_path):
    batches = [[(1, "a", "u", DAY)], [(1, "a", "v", DAY + dt.timedelta(1)), (2, "a", "u", DAY + dt.timedelta(1)), (3, "b", "u", DAY)]]
    write = sync.writer(str(tmp_path / "out"))
    for i, rows in enumerate(batches):
        for _ in range(2):  # a batch that runs again changes nothing
            write(spark.createDataFrame(rows, "film_id long, source string, url string, seen date"), i)
    assert {(r["film_id"], r["url"]) for r in sync.listings(spark, str(tmp_path / "out"), 1).collect()} == {(1, "v"), (2, "u"), (3, "u")}
    moved = [spark.read.parquet(str(tmp_path / f"out/transitions/{i}")).collect() for i in (0, 1)]
    assert not moved[0] and [(r["film_id"], r["source"]) for r in moved[1]] == [(2, "a")]


def test_sync_leaves_other_sources_where_they_are(spark, tmp_path):
    write, path = sync.writer(str(tmp_path / "out")), tmp_path / "out"
    for i in range(5):
        rows = [(i, "a", f"u{i}", DAY + dt.timedelta(i))] + [(9, "b/c", "w", DAY)] * (i == 0)
        write(spark.createDataFrame(rows, "film_id long, source string, url string, seen date"), i)
    assert {(r["film_id"], r["source"]) for r in sync.listings(spark, str(path), 4).collect()} == {(9, "b/c"), *[(i, "a") for i in range(5)]}
    assert sorted(p.name for p in (path / "listings").iterdir()) == ["0", "3", "4"]


def test_reappearances_stream(spark, tmp_path):
    seen = [dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 5), dt.datetime(2026, 3, 1), dt.datetime(2027, 9, 1)]
    spark.createDataFrame([(1, "a", t) for t in seen] + [(2, "a", seen[0])], "film_id long, source string, seen timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("film_id long, source string, seen timestamp").parquet(str(tmp_path / "in"))
    query = sync.reappearances(stream).writeStream.format("memory").queryName("returns").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert [(r["film_id"], r["seen"], r["kind"]) for r in spark.sql("SELECT * FROM returns ORDER BY seen").collect()] == [(1, seen[2], "return"), (1, seen[3], "return")]


def test_late_return_in_a_later_batch(spark, tmp_path):
    """A title that comes back after many times the gap, when the watermark has long passed it, still gives an event."""
    days = [dt.datetime(2026, 1, 1), dt.datetime(2026, 6, 1), dt.datetime(2027, 1, 1), dt.datetime(2027, 1, 2)]
    schema, films = "film_id long, source string, seen timestamp", (1, 2, 2, 1)
    for day, film in zip(days, films, strict=True):
        spark.createDataFrame([(film, "a", day)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = sync.reappearances(stream).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).start()
        query.awaitTermination()
    assert sorted((r["film_id"], r["seen"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(1, days[3]), (2, days[2])]


@pytest.mark.parametrize("name", ["batch_listings", "merged_listings"])
def test_listings_of_a_task_do_not_grow(spark, monkeypatch, name):
    monkeypatch.setattr(adapters, "ROWS_A_PART", 500)
    sizes = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] < 0.15 * sizes[1]


def test_resolver_merges_titles(spark):
    plan = catalogue.QUERIES["resolver"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [q_title" in plan


def test_components_write_little(spark):
    """Chains and a star: what is written stays below six rows for each edge, however many rounds it takes."""
    names = random.Random(5).sample(range(100_000), 3001)
    edges = [(names[i], names[i + 1]) for i in range(2000) if i % 40] + [(names[2000], names[i]) for i in range(2001, 3001)]
    written, save = [], saver(spark)

    def counting(df, label):
        table = save(df, label)
        written.append(table.count())
        return table

    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), counting).collect()}
    want = {n: n for e in edges for n in e}
    for _ in want:
        before = dict(want)
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    assert got == want and sum(written) < 6 * len(edges)
