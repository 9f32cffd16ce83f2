"""Query lines: rows, corrections, suggestions and hints; the index; many terms against many names."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lumidex.operators import fuzzy, search
from lumidex.operators.text_index import TextIndex

TEXTS = "film_id long, title string, overview string, plot string"
TITLES = [(1, "Alpha", "A private eye.", "Sternwood."), (2, "Beta", "A nurse in the alpha ward.", "Alpha shift."), (3, "Gamma", None, None), (4, "Party", "A party of one.", None)]


@pytest.fixture(scope="module")
def corpus(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema).persist()

    credits = [
        (1, 1, "cast", "", "Philip Marlowe", 0), (2, 2, "cast", "", "Nurse", 0), (1, 3, "crew", "Director", "", 0), (2, 3, "crew", "Director", "", 0), (3, 4, "cast", "", "Ward", 7), (3, 3, "cast", "", "Himself", 12),
    ]
    return {
        "films": frame([(1, "Alpha", "Alpha", 1946), (2, "Beta", "Bêta", 1950), (3, "Gamma", None, 1960), (4, "Party", "La Fête", 1970)], "film_id long, title string, original_title string, year int"),
        "texts": frame(TITLES, TEXTS),
        "persons": frame([(1, "Humphrey Bogart"), (2, "Jane Bogart"), (3, "Howard Hawks"), (4, "Ann Marlowe")], "id long, name string"),
        "credits": frame(credits, "film_id long, person_id long, kind string, job string, character string, ord int"),
        "genres": frame([(1, "Film-Noir"), (1, "Crime")], "film_id long, genre string"),
        "keywords": frame([(1, "film noir"), (2, "hospital"), (1, "dystopia"), (1, "distant future")], "film_id long, keyword string"),
        "options": frame([(1, "kino", "Kino Film Collection"), (3, "mu", "Stream")], "film_id long, slug string, name string"),
    }


def said(notes, kind):
    return sorted((r["field"], r["typed"], r["name"]) for r in notes if r["kind"] == kind)


def ids(found):
    return [r["film_id"] for r in found.rows.collect()]


#: A line, its titles (in order if ranked), corrections, suggestions and whether a hint holds a text.
LINES = [
    ("character: philip marlowe", {1}, [], [], None),
    ("actor: bogrt", {1}, [("actor", "bogrt", "Humphrey Bogart")], [], None),
    ('actor: "bogrt"', set(), [], [], None),
    ("actor: bogxrtq", set(), [], [("actor", "bogxrtq", "Humphrey Bogart"), ("actor", "bogxrtq", "Jane Bogart")], None),
    ("director: humphrey bogart", set(), [], [], None),
    ("person: hawks", {1, 2, 3}, [("person", "hawks", "Howard Hawks")], [], None),
    ("alpha director: hawks", [1, 2], [("director", "hawks", "Howard Hawks")], [], None),
    ("foo: gamma", [], [], [], "no field is named foo"),
    ("genre: film noir", {1}, [], [], None),
    ("keyword: hospitl", {2}, [("keyword", "hospitl", "hospital")], [], None),
    ("keyword: hospitals", {2}, [], [], None),
    ("dystopian", [1], [], [], None),
    ("service: Kino Film Collection", {1}, [], [], None),
    ("on: kino director: hawks", {1}, [("director", "hawks", "Howard Hawks")], [], None),
    ("service: kino film", set(), [], [("service", "kino film", "Kino Film Collection")], None),
    ("year: 1940-1949", {1}, [], [], None),
    ("year: 1946 year: 1950", {1, 2}, [], [], None),
    ("actor: humphrey bogart actor: bacalllzz", {1}, [], [], None),
    ("character: xy", set(), [], [], "too short to correct"),
    ("purple elephant parade", [], [], [], "matches all 3 words"),
    ("private eye actor: bacalllzz", [], [], [], None),
    ("character: marlow", {1}, [("character", "marlow", "Philip Marlowe")], [], None),
    ("character: philip", {1}, [("character", "philip", "Philip Marlowe")], [], None),
    ("plot: ward nurse", {2}, [], [], None),
    ("plot: art", set(), [], [], None),
    ("plot: party", {4}, [], [], None),
    ("about: shift ward", {2}, [], [], None),
    ("title: fête", {4}, [], [], None),
    ("title: alph", {1}, [], [], None),
    ("title: gama", set(), [], [("title", "gama", "Gamma")], None),
    ("Bogart Humphrey", [1], [], [], None),
    ("ward", [3, 2], [], [], None),
    ("marlowe", [1, 3], [], [], None),
]


@pytest.mark.parametrize("line, titles, corrections, suggestions, hint", LINES, ids=[x[0] for x in LINES])
def test_lines(corpus, line, titles, corrections, suggestions, hint):
    found = search.answer(line, **corpus)
    got = ids(found)
    assert found.ranked == isinstance(titles, list)
    assert (got if isinstance(titles, list) else set(got)) == titles
    notes = found.notes.collect()
    assert said(notes, "correction") == corrections and said(notes, "suggestion") == suggestions
    hints = " ".join(x[2] for x in said(notes, "hint"))
    assert hint in hints if hint else not hints


def test_no_credits_say_so(corpus):
    found = search.answer("actor: anyone", **(corpus | {"credits": corpus["credits"].limit(0)}))
    assert ids(found) == [] and ("actor", "", "no credits are loaded") in said(found.notes.collect(), "hint")


def test_words_with_signs_are_phrases(corpus, spark):
    texts = spark.createDataFrame([(1, "Sci-Fi", "a b", None), (2, "Fi", "sci of fi", None)], TEXTS)
    assert [r["film_id"] for r in search.bm25(texts, ["sci-fi"]).collect()] == [1]
    assert {r["film_id"] for r in search.texts_with(texts, "fi sci", ["title", "overview"]).collect()} == {1, 2}
    assert [r["film_id"] for r in search.texts_with(texts, '"of"  !!', ["overview"]).collect()] == [2]
    assert search.texts_with(texts, "!! -", ["overview"]).isEmpty()


def test_index_answers_alike(corpus, spark, tmp_path):
    index = TextIndex.create(corpus["texts"], f"{tmp_path}/index", "film_id", ["title", "overview", "plot"], buckets=4)
    for line in ("plot: ward nurse", "plot: art", "about: shift ward", "ward", "alpha director: hawks", "private eye"):
        plain, by_index = search.answer(line, **corpus).rows.collect(), search.answer(line, **corpus, index=index).rows.collect()
        assert [r["film_id"] for r in plain] == [r["film_id"] for r in by_index] and all(abs(a["score"] - b["score"]) < 1e-9 for a, b in zip(plain, by_index, strict=True))


# the index

WORDS = "alpha beta gamma delta ward nurse art party of one forward".split()


def random_text(rng, key):
    return (key, " ".join(rng.choices(WORDS, k=rng.randrange(3))) or None, " ".join(rng.choices(WORDS, k=rng.randrange(9))))


def brute_phrase(texts, phrase):
    asked = phrase.split()
    out = {}
    for key, *columns in texts:
        for name, text in zip(("title", "overview"), columns, strict=True):
            w = (text or "").lower().split()
            at = [i for i in range(len(w)) if w[i : i + len(asked)] == asked]
            if at:
                out[key, name] = at
    return out


def test_index_follows_its_texts(spark, tmp_path):
    """After batches of inserted, changed and removed texts, with reruns and a compaction between: equal to one made anew."""
    rng = random.Random(9)
    schema = "film_id long, title string, overview string"
    now = {i: random_text(rng, i) for i in range(50)}
    index = TextIndex.create(spark.createDataFrame(list(now.values()), schema), f"{tmp_path}/i", "film_id", ["title", "overview"], buckets=8)
    for n in range(3):
        changed = {i: random_text(rng, i) for i in rng.sample(range(70), 10)}
        removed = [i for i in rng.sample(range(80), 8) if i not in changed]
        for _ in range(2 if n == 1 else 1):  # a batch that runs again does nothing
            index.apply(spark.createDataFrame(list(changed.values()), schema), spark.createDataFrame([(i,) for i in removed], "film_id long"), n)
        now = {k: v for k, v in (now | changed).items() if k not in removed}
        if n == 1:
            index.compact()
            assert index.tables.read("gone").isEmpty() and len(index.tables.state().tables["postings"]["folders"]) == 1
    texts = spark.createDataFrame(list(now.values()), schema)
    fresh = TextIndex.create(texts, f"{tmp_path}/f", "film_id", ["title", "overview"], buckets=8)

    def postings(i):
        return sorted(map(tuple, i._live(i.tables.read("postings"), i.tables.state()).select("term", "key", "col", "positions").collect()))

    assert postings(index) == postings(fresh) and index.totals() == fresh.totals()
    assert sorted(map(tuple, index.vocabulary().collect())) == sorted(map(tuple, search.vocabulary(texts, ["title", "overview"]).collect()))
    weights = {"title": 10.0, "overview": 2.0}
    want = {r["film_id"]: r["bm25"] for r in search.bm25(texts, ["ward", "of"], weights=weights).collect()}
    got = {r["key"]: r["bm25"] for r in index.bm25(["Ward", "of"], weights).collect()}
    assert got.keys() == want.keys() and len(got) > 0 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    for phrase in ("ward nurse", "of one", "alpha", "of of", "one of one"):
        assert {(r["key"], r["col"]): r["at"] for r in index.phrase(phrase).collect()} == brute_phrase(now.values(), phrase)
    reopened = TextIndex(spark, f"{tmp_path}/i")
    assert reopened.columns == ["title", "overview"] and reopened.phrase("ward nurse", ["title"]).where("col <> 'title'").isEmpty()
    assert index.bm25([]).isEmpty() and index.phrase("  ").isEmpty() and index.matching(["nowhere"]).isEmpty()


def test_index_reads_only_its_terms(spark, tmp_path):
    """A query's scan is narrowed to its terms' folders, and gives few of all rows."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 900}" for k in range(12)) + (" rare" if i == 5 else "")) for i in range(600)]
    index = TextIndex.create(spark.createDataFrame(rows, "id long, text string"), f"{tmp_path}/i", "id", ["text"], buckets=16)
    found = index.bm25(["rare"])
    assert [r["key"] for r in found.collect()] == [5]
    plan = index.hits(["rare"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("`", "") or "bucket#" in plan and "PushedFilters" in plan
    postings = index.tables.read("postings")
    bucket = postings.where("term = 'rare'").first()["bucket"]
    read = {f.rsplit("/", 2)[-2] for f in index.tables.read("postings").where(F.col("bucket") == bucket).inputFiles()}
    assert f"bucket={bucket}" in read and postings.where(F.col("bucket") == bucket).count() < postings.count() / 4


def test_index_as_a_sink_of_a_stream(spark, tmp_path):
    index = TextIndex.create(spark.createDataFrame([(1, "old words")], "id long, text string"), f"{tmp_path}/i", "id", ["text"], buckets=2)
    schema = "id long, text string, removed boolean, seq long"
    spark.createDataFrame([(2, "new words", False, 1), (1, "other", False, 1), (1, "last", False, 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(2, None, True, 3)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(index.follow).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, index.vocabulary().collect())) == [("last", 1, 1)] and index.totals() == (1, {"text": 1})


# many terms, many names


def brute_similarity(term, name):
    q, n = term.lower().strip(), name.lower()
    scores = [SequenceMatcher(None, q, n).ratio()]
    for word in n.split():
        scores.append(SequenceMatcher(None, q, word).ratio() * (min(len(q), len(word)) / max(len(q), len(word))) ** 0.35)
    return max(scores)


def test_terms_meet_the_names_that_brute_force_finds(spark):
    rng = random.Random(3)
    syllables = "bo gart hum phrey haw ks lau ren ba call in grid berg man é ö".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))

    def mistyped(text):
        letters = list(text)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(letters) + 1)
            letters[k : k + rng.randrange(2)] = rng.choice(["", "a", "x", "r"])
        return "".join(letters)

    names = [(i, " ".join(word().capitalize() for _ in range(rng.randrange(1, 4))), rng.randrange(5)) for i in range(250)]
    terms = [(i, mistyped(rng.choice([*rng.choice(names)[1].split(), rng.choice(names)[1]]))) for i in range(100)] + [(900, ""), (901, None), (902, " X ")]
    asked, held = spark.createDataFrame(terms, "term_id long, value string"), spark.createDataFrame(names, "key long, name string, weight long")
    for gate in (False, True):
        want = []
        for i, value in terms:
            windows = {value.strip().lower()[k : k + 3] for k in range(len(value.strip()) - 2)} if value else set()
            ranked = sorted((-brute_similarity(value, n), -w, n, k) for k, n, w in names if value and value.strip() and (not gate or any(x in n.lower() for x in windows)))
            want += [(i, place + 1, k, round(-s, 9)) for place, (s, _, _, k) in enumerate([x for x in ranked if -x[0] >= 0.6][:3])]
        got = [(r["term_id"], r["place"], r["key"], round(r["score"], 9)) for r in fuzzy.similar(asked, held, sharing_trigram=gate).collect()]
        assert sorted(got) == sorted(want) and len(want) > 100
    strings = fuzzy.strings_of(held)
    met = fuzzy.pairs(asked.select(F.lower(F.trim("value")).alias("q")).where("q <> ''"), strings, 0.6).count()
    assert met < 0.1 * asked.count() * strings.select("s", "part").distinct().count()  # the share that is compared letter by letter


def test_characters_holding(spark):
    """The registered query finds all whose character holds the text, cast and crew; the field goes by whole names of the cast."""
    from lumidex.plans import catalogue

    data = "/root/testdata/sf0.001"
    line = spark.read.parquet(f"{data}/lineitem.parquet").select("l_partkey", F.col("l_shipdate").cast("string").alias("name"), "l_linenumber").collect()
    got = {r[0] for r in catalogue.QUERIES["search_character"](spark, data).collect()}
    assert got == {r[0] for r in line if "1997-06-1" in r[1]}
    assert got > {r[0] for r in line if r[1] == "1997-06-11 00:00:00" and r[2] % 2 == 0} == {r[0] for r in catalogue.QUERIES["search_character_named"](spark, data).collect()}


def test_postings_without_shuffle(spark):
    """A text's postings are made in its own row, however long it is, with every place of a word."""
    index = object.__new__(TextIndex)
    index.columns, index.buckets = ["x"], 4
    long = ["w%d" % (i * i % 37) for i in range(900)]
    texts = spark.createDataFrame([(1, "b a B  a!"), (2, " ".join(long)), (3, None), (4, "")], "key long, x string")
    made = index._postings(texts, 5)
    assert "Exchange" not in made._jdf.queryExecution().sparkPlan().toString()
    got = {(r["key"], r["term"]): [sum(r["positions"][: i + 1]) for i in range(len(r["positions"]))] for r in made.collect()}
    assert got == {(1, "a"): [1, 3], (1, "b"): [0, 2], **{(2, w): [i for i, x in enumerate(long) if x == w] for w in set(long)}}


ODD = ["", None, " - ", "\u0130stanbul \u0391\u03a3 \u00df \ufb01", "x_y X\u0000Y", "\U0001f600a\U0001d7d8", "e\u0301 \u00bdx \u2167", "\u65e5\u672c\u8a9e  a\u3000a", "b a B  a!"]


def test_postings_of_odd_texts_are_those_of_their_words(spark, monkeypatch):
    """Words as words() has them, in every column, whether texts are sorted alone or together."""
    import pyarrow as pa

    from lumidex.functions.expressions import spaced, words
    from lumidex.operators import text_index

    rows = [(i, x, y) for i, x in enumerate(ODD) for y in (ODD[i - 1], " ".join(f"w{k * k % 37}" for k in range(300)))]
    texts = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "key long, x string, y string")
    want, lengths = {}, {}
    for r in texts.select("key", *[F.coalesce(words(F.col(c)), F.array().cast("array<string>")).alias(c) for c in "xy"]).collect():
        lengths[r["key"]] = (len(r["x"]), len(r["y"]))
        for c in "xy":
            for at, w in enumerate(r[c]):
                want.setdefault((w, r["key"], c), []).append(at)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in texts.select("key", *[spaced(F.coalesce(c, F.lit(""))).alias(c) for c in "xy"]).collect()])
    for size in (1, 1000, 1 << 22):
        monkeypatch.setattr(text_index, "PART", size)
        made = list(text_index.inverted(iter([batch]), ["x", "y"]))
        got = [x for b in made for x in b.to_pylist()]
        assert all(tuple(x["lengths"].values()) == lengths[x["key"]] for x in got) and len(got) == len(want) and len(made) >= min(len(rows), 30_000 // size)
        assert {(x["term"], x["key"], x["col"]): [sum(x["positions"][: k + 1]) for k in range(len(x["positions"]))] for x in got} == want
        assert all([x["term"] for x in b.to_pylist()] == sorted((x["term"] for x in b.to_pylist()), key=str.encode) for b in made)


def test_places_of_many_steps(spark):
    """Positions come from steps by running sums, in time that grows with their number; an array that is copied for each of them would take minutes."""
    from lumidex.operators.text_index import places

    rows = [(0, [3, 1, 5]), (1, []), (2, [0]), (3, [0, *[2] * 300_000]), (4, [7, 7])]
    got = dict(spark.createDataFrame(rows, "k int, s array<int>").where("k <> 0").select("k", places(F.col("s"))).collect())
    assert got == {1: [], 2: [0], 3: list(range(0, 600_001, 2)), 4: [7, 14]}


def test_index_makes_its_words_once(spark, tmp_path):
    """A batch finds the words of its texts once, for their lengths and for their postings; counts are not one task's, and no two buckets."""
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    texts = spark.createDataFrame([(i, f"w{i} of") for i in range(40)], "id long, text string")
    index = TextIndex.create(texts.withColumn("text", F.udf(told)("text")), f"{tmp_path}/i", "id", ["text"], buckets=4)
    assert seen.value == 40
    assert {(r["term"], r["n_docs"]) for r in index.vocabulary().collect()} == {("of", 40), *[(f"w{i}", 1) for i in range(40)]}
    plan = index._laid_out(index.tables.read("terms"), ["term"])._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE" in plan and "rangepartitioning" not in plan
    dealt = spark.range(4).select(F.col("id").cast("int").alias("bucket"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, index._laid_out(dealt, []).select("bucket", F.spark_partition_id()).collect())) == [(i, i) for i in range(4)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nearest_memory_does_not_grow_with_a_frame():
    """Many queries against a large frame of vectors: a part of it is measured at once; ties go to the smaller key."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from lumidex.operators import vectors

    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (6000, 4)).astype(float)
    frame, q = pd.DataFrame({"vec_id": np.arange(6000), "embedding": list(v)}), v[:1000]
    tracemalloc.start()
    (got,) = list(vectors.nearest_in(iter([frame]), list(range(1000)), q, 3, "vec_id", "embedding"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 1000 * 8 / 2
    for i in (0, 7, 999):
        want = sorted((1 - float(q[i] @ x), j) for j, x in enumerate(v))[:3]
        assert [(r.distance, r.vec_id) for r in got[got.query_id == i].itertuples()] == want
