"""Search: postings, BM25 over weighted columns, freeform scores, fields, fuzzy resolution.

A query line gives rows and notes, both of them plans: notes say which names were used for
what was typed, which are offered instead, and hints. Where tables has an index
(text_index.TextIndex over title, overview and plot), words are looked up there; else texts
are scanned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.functions.expressions import trigrams, words
from lumidex.functions.stemming import stem, stems
from lumidex.functions.text import length_bound, similarity
from lumidex.operators import fuzzy, vectors
from lumidex.operators.text_index import TextIndex

#: Okapi's constants and the weights of columns and of signals.
K1, B = 1.2, 0.75
COLUMN_WEIGHTS = {"title": 10.0, "overview": 2.0, "plot": 1.0}
TITLE_SUBSTRING, LEAD_CAST, BILLED_CAST, CHARACTER, GENRE, KEYWORD = 10.0, 5.0, 2.5, 4.0, 3.0, 3.0
LEAD_BILLING, MAX_BILLING = 5, 10
CORRECTION_FLOOR, SUGGESTION_FLOOR, KEYWORD_FLOOR, MAX_SUGGESTIONS, CANDIDATE_LIMIT = fuzzy.CORRECTION_FLOOR, fuzzy.SUGGESTION_FLOOR, 0.9, fuzzy.MAX_SUGGESTIONS, 2000
#: Fields of the query language, and their other names.
FIELDS = ("title", "actor", "character", "director", "writer", "cinematographer", "editor", "composer", "producer", "crew", "person", "genre", "keyword", "year", "plot", "service")
ALIASES = {"cast": "actor", "with": "actor", "by": "director", "dp": "cinematographer", "score": "composer", "on": "service", "tag": "keyword", "about": "plot"}
JOBS = {
    "director": ("Director",), "writer": ("Screenplay", "Writer", "Story", "Novel", "Author"), "cinematographer": ("Director of Photography",),
    "editor": ("Editor",), "composer": ("Original Music Composer",), "producer": ("Producer", "Executive Producer"),
}


def postings(texts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, term, col, tf): how often each word is in each column of a text."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), words(F.coalesce(c, F.lit(""))).alias("terms")) for c in columns])
    flat = texts.select(key, F.explode(each).alias("x")).select(key, "x.col", F.explode("x.terms").alias("term"))
    return flat.groupBy(key, "term", "col").agg(F.count("*").alias("tf"))


def vocabulary(texts: DataFrame, columns: list[str]) -> DataFrame:
    """(term, n_docs, n): in how many texts a word is, and how often.

    Words are sorted in their row, where the first of equal ones stands for the text; so one
    shuffle, by word and after a map-side sum, gives both.
    """
    every = F.sort_array(F.flatten(F.array(*[words(F.coalesce(c, F.lit(""))) for c in columns])))
    marked = F.transform("w", lambda w, i: F.struct(w.alias("term"), (~w.eqNullSafe(F.get("w", i - 1))).cast("long").alias("first")))
    spread = texts.select(every.alias("w")).select(F.explode(marked).alias("x")).select("x.term", "x.first")
    return spread.groupBy("term").agg(F.sum("first").alias("n_docs"), F.count("*").alias("n"))


def bm25(texts: DataFrame, query: list[str], key: str = "film_id", weights: dict[str, float] | None = None) -> DataFrame:
    """(key, bm25) of texts that hold all of query: Okapi over weighted columns, length over all columns. What query has with signs inside are words in a row.

    Only counts of the query's words leave the scan: each row is narrowed to its length and
    one count per word and column before anything is shuffled, and what is shuffled are the
    rows with a word and one row of totals.
    """
    weight = weights or COLUMN_WEIGHTS
    terms = list(dict.fromkeys(t for t in map(_tokens, query) if t))
    if not terms:
        return texts.select(key).limit(0).withColumn("bm25", F.lit(0.0))
    split = {c: words(F.coalesce(c, F.lit(""))) for c in weight}
    cols = texts.select(key, *[v.alias(f"w_{c}") for c, v in split.items()])

    def count(column: str, term: tuple[str, ...]) -> Column:
        if len(term) == 1:
            return F.size(F.filter(column, lambda w: w == term[0]))
        return F.size(F.filter(F.transform(column, lambda w, i: reduce(lambda a, b: a & b, [F.get(column, i + k) == t for k, t in enumerate(term)])), lambda x: x))

    tf = {t: reduce(lambda a, b: a + b, [F.lit(weight[c]) * count(f"w_{c}", t) for c in weight]) for t in terms}
    counted = cols.select(key, reduce(lambda a, b: a + b, [F.size(f"w_{c}") for c in weight]).alias("length"), *[v.alias(f"tf_{i}") for i, v in enumerate(tf.values())])
    totals = counted.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))])
    hit = counted.where(reduce(lambda a, b: a & b, [F.col(f"tf_{i}") > 0 for i in range(len(terms))]))
    scored = hit.join(F.broadcast(totals))  # one row
    parts = []
    for i in range(len(terms)):
        df, f = F.col(f"df_{i}"), F.col(f"tf_{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        parts.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))))
    return scored.select(key, reduce(lambda a, b: a + b, parts).alias("bm25"))


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.lower()))


def _asked(text: str) -> list[str]:
    """What a text asks for: what blanks separate, without quotes around it."""
    return [w for w in (x.strip('"') for x in text.split()) if w]


def holds(text: Column, phrase: str) -> Column:
    """Whether a text has a phrase's words in a row."""
    return F.concat(F.lit(" "), F.array_join(words(F.coalesce(text, F.lit(""))), " "), F.lit(" ")).contains(f" {' '.join(_tokens(phrase))} ")


def texts_with(texts: DataFrame, asked: str, columns: list[str], index: TextIndex | None = None) -> DataFrame:
    """film_id of the texts with every word of asked, each in any of columns."""
    phrases = [p for p in _asked(asked) if _tokens(p)]
    if index is not None:
        return index.matching(phrases, columns).select(F.col("key").alias("film_id"))
    if not phrases:
        return texts.select("film_id").limit(0)
    return texts.where(reduce(lambda a, b: a & b, [reduce(lambda x, y: x | y, [holds(F.col(c), p) for c in columns]) for p in phrases])).select("film_id")


def named_by(name: Column, asked: str) -> Column:
    """Whether a name has every word of asked of three letters or more somewhere in it; false if there is none."""
    parts = [w.lower() for w in _asked(asked) if len(w) >= 3]
    return reduce(lambda a, b: a & b, [F.lower(name).contains(w) for w in parts]) if parts else F.lit(False)


def freeform_scores(query: str, *, texts: DataFrame, credits: DataFrame, persons: DataFrame, genres: DataFrame, keywords: DataFrame, films: DataFrame | None = None, index: TextIndex | None = None) -> DataFrame:
    """(film_id, score): the sum of the signals a free text gives for a title.

    People and characters count if their names hold all words of three letters or more, in
    any order; crew and deep cast do not. films: where titles are, of which some may have no texts.
    """
    text = query.strip().lower()
    if index is not None and all(len(_tokens(w)) < 2 for w in _asked(text)):
        ranked_texts = index.bm25([t for w in _asked(text) for t in _tokens(w)], COLUMN_WEIGHTS).select(F.col("key").alias("film_id"), F.col("bm25").alias("w"))
    else:
        ranked_texts = bm25(texts, _asked(text)).select("film_id", F.col("bm25").alias("w"))
    signals = [ranked_texts, (texts if films is None else films).where(F.lower("title").contains(text)).select("film_id", F.lit(TITLE_SUBSTRING).alias("w"))]
    cast = credits.where((F.col("kind") == "cast") & (F.col("ord") < MAX_BILLING)).join(persons.where(named_by(F.col("name"), text)).select(F.col("id").alias("person_id")), "person_id")
    signals.append(cast.groupBy("film_id").agg(F.when(F.min("ord") < LEAD_BILLING, LEAD_CAST).otherwise(BILLED_CAST).alias("w")))
    signals.append(credits.where(named_by(F.col("character"), text)).select("film_id").distinct().withColumn("w", F.lit(CHARACTER)))
    if re.search("[a-z0-9]", text):
        signals.append(genres.where(F.regexp_replace(F.lower("genre"), "[^a-z0-9]", "") == re.sub("[^a-z0-9]", "", text)).select("film_id").distinct().withColumn("w", F.lit(GENRE)))
        tagged = keywords_matching(keywords, text).select("film_id")
        # what stems cannot join; never beside a hit by stems
        ladder = keyword_ladder(keywords, text).select(F.col("key").alias("l_keyword"))
        none = tagged.limit(1).agg(F.count("*").alias("n_tagged")).where("n_tagged = 0")
        nearest = keywords.join(F.broadcast(ladder), F.col("keyword") == F.col("l_keyword")).join(F.broadcast(none)).select("film_id")  # a row each
        signals.append(tagged.union(nearest).distinct().withColumn("w", F.lit(KEYWORD)))
    return reduce(lambda a, b: a.unionByName(b), signals).groupBy("film_id").agg(F.sum("w").alias("score"))


def keyword_ladder(keywords: DataFrame, text: str) -> DataFrame:
    """(key, score): the one keyword that a free text is taken for, if it is as near as KEYWORD_FLOOR."""
    names = named(keywords, "keyword").where(_may_reach(F.col("name"), [text], KEYWORD_FLOOR))
    asked = keywords.sparkSession.createDataFrame([(0, text)], "term_id int, value string")
    return fuzzy.similar(asked, names, KEYWORD_FLOOR, most=1).select("key", "score")


def _may_reach(name: Column, values: list[str], floor: float) -> Column:
    """Whether a name can be as similar as floor to any of values, by lengths alone."""
    return reduce(lambda a, b: a | b, [length_bound(F.lit(v.lower().strip()), F.lower(name)) >= floor for v in values if v.strip()] or [F.lit(False)])


def keywords_matching(keywords: DataFrame, phrase: str) -> DataFrame:
    """Keywords that hold the phrase's words in a row, compared by their stems."""
    wanted = " ".join(stem(w) for w in re.findall(r"[^\W_]+", phrase.lower()))
    if not wanted:
        return keywords.limit(0)
    held = F.concat(F.lit(" "), F.array_join(stems(words(F.col("keyword"))), " "), F.lit(" "))
    return keywords.where(held.contains(f" {wanted} "))


def trigram_candidates(names: DataFrame, query: str, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Names (key, name, weight) that share a window of three characters with query, the heaviest first."""
    q = query.lower()
    wanted = [q[i : i + 3] for i in range(len(q) - 2)]
    if not wanted:
        return names.limit(0)
    return names.where(F.arrays_overlap(trigrams(F.col("name")), F.array(*map(F.lit, wanted)))).orderBy(F.desc("weight"), "name").limit(limit)


def ranked(names: DataFrame, query: str, floor: float | None = None) -> DataFrame:
    """names with their similarity to query, best first; what cannot reach floor by its length is not compared."""
    q = F.lit(query.lower().strip())
    near = names if floor is None else names.where(length_bound(q, F.lower("name")) >= floor)
    out = near.withColumn("score", similarity(q, F.col("name")))
    return (out if floor is None else out.where(F.col("score") >= floor)).orderBy(F.desc("score"), F.desc("weight"), "name")


def corrected(names: DataFrame, query: str) -> tuple[str | None, list[str]]:
    """(the name that query is taken for, or None; suggestions if none): at most MAX_SUGGESTIONS rows reach the driver."""
    best = ranked(trigram_candidates(names, query), query, SUGGESTION_FLOOR).limit(MAX_SUGGESTIONS).collect()
    if best and best[0]["score"] >= CORRECTION_FLOOR:
        return best[0]["name"], []
    return None, [r["name"] for r in best]


def named(rows: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """(key, name, weight): the names in a column, or a key's name, and how many rows carry them."""
    rows = rows.where(F.col(column) != "")
    return rows.groupBy(F.col(key or column).alias("key")).agg(F.min(column).alias("name"), F.count("*").alias("weight"))


@dataclass(frozen=True)
class Query:
    """What a query line says: free text, values by field, hints for the writer, and the (field, value) that are quoted, so never corrected."""

    free: str = ""
    fields: dict[str, list[str]] = field(default_factory=dict)
    hints: tuple[str, ...] = ()
    exact: frozenset[tuple[str, str]] = frozenset()


_PIECE = re.compile(r'"((?:[^"]|"")*)"|(?<!\S)([A-Za-z_]+):|(\S+)')


def read_query(line: str) -> Query:
    """A query line: field: takes what follows up to the next field; quotes keep words together."""
    fields: dict[str, list[str]] = {}
    free: list[str] = []
    hints: list[str] = []
    exact: set[tuple[str, str]] = set()
    current, held, begins_quoted = None, free, False

    def close() -> None:
        if current is not None:
            if held:
                fields.setdefault(current, []).append(" ".join(held))
                if begins_quoted:
                    exact.add((current, " ".join(held)))
            else:
                hints.append(f"{current}: has no value")

    for quoted, name, bare in _PIECE.findall(line):
        if name:
            known = ALIASES.get(name.lower(), name.lower())
            if known in FIELDS:
                close()
                current, held, begins_quoted = known, [], False
                continue
            hints.append(f"no field is named {name}")
            bare = f"{name}:"
        begins_quoted = begins_quoted or bool(quoted and not held)
        held.append(quoted.replace('""', '"') if quoted else bare)
    close()
    return Query(" ".join(x for x in free if x), fields, tuple(hints), frozenset(exact))


def year_range(text: str) -> tuple[int | None, int | None] | None:
    """1950, 1950-1960, 1950- or -1960; None for anything else."""
    m = re.fullmatch(r"(\d{4})|(\d{4})?-(\d{4})?", text.strip())
    if not m or not any(m.groups()):
        return None
    low, high = (m[1], m[1]) if m[1] else (m[2], m[3])
    span = int(low) if low else None, int(high) if high else None
    return None if None not in span and span[0] > span[1] else span


def in_years(year: Column, text: str) -> Column:
    span = year_range(text)
    if span is None:
        return F.lit(False)
    return F.coalesce((F.lit(True) if span[0] is None else year >= span[0]) & (F.lit(True) if span[1] is None else year <= span[1]), F.lit(False))


NOTES = "kind string, field string, typed string, name string, place int"


@dataclass(frozen=True)
class Taken:
    """What one field's values came to: film_id of the titles that hold for any of them, and notes."""

    films: DataFrame
    notes: DataFrame


def _notes(spark, rows: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame(list(rows), NOTES)


def _keys(field_name: str, values: list[tuple[str, bool]], equal: DataFrame, names: DataFrame, gate: bool) -> tuple[DataFrame, DataFrame]:
    """(key of the names that values stand for, notes): names (key, name, weight); equal (term_id, key) are those typed as they are.

    gate: a name is only offered if it shares three letters in a row with what was typed, so
    shorter values are not corrected.
    """
    spark = names.sparkSession
    terms = spark.createDataFrame([(i, v, e) for i, (v, e) in enumerate(values)], "term_id int, value string, exact boolean")
    open_ = terms.where("not exact").join(equal.select("term_id").distinct(), "term_id", "left_anti")
    loose = [v for v, exact in values if not exact]
    near = names.where(_may_reach(F.col("name"), loose, SUGGESTION_FLOOR))
    if gate:
        windows = sorted({v[i : i + 3] for v in (x.strip().lower() for x in loose) for i in range(len(v) - 2)})
        near = near.where(F.arrays_overlap(trigrams(F.col("name")), F.array(*map(F.lit, windows)))) if windows else near.limit(0)
    found = fuzzy.resolved(open_, near, gate)
    notes = found.join(terms, "term_id").select(F.when(F.col("used"), "correction").otherwise("suggestion").alias("kind"), F.lit(field_name).alias("field"), F.col("value").alias("typed"), "name", "place")
    if gate:
        short = open_.where(F.length(F.trim("value")) < 3)
        hint = F.concat(F.lit("'"), F.col("value"), F.lit("' is too short to correct: three characters or more are needed"))
        notes = notes.unionByName(short.select(F.lit("hint").alias("kind"), F.lit(field_name).alias("field"), F.col("value").alias("typed"), hint.alias("name"), F.lit(1).alias("place")))
    return equal.select("key").union(found.where("used").select("key")).distinct(), notes


def _equal(names: DataFrame, columns: list[str], values: list[tuple[str, bool]]) -> DataFrame:
    """(term_id, key) of names where one of columns is a value, however it is capitalised."""
    typed = F.array(*[F.struct(F.lit(i).alias("term_id"), F.lit(v.strip().lower()).alias("v")) for i, (v, _) in enumerate(values)])
    same = names.select("key", *columns, F.explode(typed).alias("t")).where(reduce(lambda a, b: a | b, [F.lower(c) == F.col("t.v") for c in columns]))
    return same.select("t.term_id", "key").distinct()


def field_values(name: str, values: list[tuple[str, bool]], *, films: DataFrame, credits: DataFrame, persons: DataFrame, genres: DataFrame, keywords: DataFrame, texts: DataFrame, options: DataFrame, index: TextIndex | None = None) -> Taken:
    """What the values (text, whether quoted, so never corrected) of one field come to.

    A person, character, keyword or service that nothing is named by is taken for the most
    similar name from CORRECTION_FLOOR on, and below it names are offered; titles are only
    offered. options may have the slug of a service beside its name; films may have original titles.
    """
    spark = films.sparkSession
    plain = [v.strip().lower() for v, _ in values]
    notes = _notes(spark)

    def any_of(conditions: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, conditions)

    if name == "title":
        columns = ["title", *[c for c in ("original_title",) if c in films.columns]]
        found = films.where(any_of([F.coalesce(F.lower(c).contains(v), F.lit(False)) for v in plain for c in columns]))
        loose = [(v, e) for v, e in values if not e]
        if loose:
            typed = F.array(*[F.struct(F.lit(i).alias("term_id"), F.lit(v.strip().lower()).alias("v")) for i, (v, _) in enumerate(loose)])
            hit = films.select("title", F.explode(typed).alias("t")).where(F.lower("title").contains(F.col("t.v"))).select("t.term_id", F.lit("").alias("key")).distinct()
            names = films.select(F.col("film_id").alias("key"), F.col("title").alias("name"), F.lit(0).alias("weight"))
            _, offered = _keys(name, loose, hit, names.select(F.col("key").cast("string").alias("key"), "name", "weight"), False)
            notes = offered.withColumn("kind", F.lit("suggestion"))
    elif name == "year":
        found = films.where(any_of([in_years(F.col("year"), v) for v, _ in values]))
    elif name == "genre":
        found = genres.where(F.regexp_replace(F.lower("genre"), "[^a-z0-9]", "").isin([re.sub("[^a-z0-9]", "", v) for v in plain]))
    elif name == "plot":
        found = reduce(lambda a, b: a.union(b), [texts_with(texts, v, ["overview", "plot"], index) for v in plain])
    elif name == "keyword":
        wanted = {i: " ".join(stem(w) for w in _tokens(v)) for i, v in enumerate(plain)}
        tags = named(keywords, "keyword")
        held = F.concat(F.lit(" "), F.array_join(stems(words(F.col("name"))), " "), F.lit(" "))
        stemmed = tags.select("key", held.alias("held"), F.explode(F.array(*[F.struct(F.lit(i).alias("term_id"), F.lit(f" {w} ").alias("v")) for i, w in wanted.items()])).alias("t"))
        equal = stemmed.where(F.col("held").contains(F.col("t.v")) & (F.trim("t.v") != "")).select("t.term_id", "key")
        keys, notes = _keys(name, values, equal, tags, False)
        # a keyword that is used stands for all that hold its words
        used = keys.select(F.concat(F.lit(" "), F.array_join(stems(words(F.col("key"))), " "), F.lit(" ")).alias("used"))
        all_tags = tags.select("key", held.alias("held")).join(F.broadcast(used.distinct()), F.col("held").contains(F.col("used"))).select(F.col("key").alias("t_key")).distinct()
        found = keywords.join(all_tags, F.col("keyword") == F.col("t_key"), "left_semi")
    elif name == "service":
        slugged = options.withColumn("slug", F.col("slug") if "slug" in options.columns else F.lower("name"))
        registry = named(slugged, "name", "slug")
        keys, notes = _keys(name, values, _equal(registry, ["name", "key"], values), registry, False)
        found = slugged.join(keys.select(F.col("key").alias("s_key")), F.col("slug") == F.col("s_key"), "left_semi")
    elif name == "character":
        cast = credits.where("kind = 'cast'")
        keys, notes = _keys(name, values, _equal(named(cast, "character"), ["name"], values), named(credits, "character"), True)
        found = cast.join(keys.select(F.col("key").alias("c_key")), F.col("character") == F.col("c_key"), "left_semi")
    else:
        kind = F.lit(True) if name == "person" else F.col("kind") == ("cast" if name == "actor" else "crew")
        held = credits.where(kind & (F.col("job").isin(*JOBS[name]) if name in JOBS else F.lit(True)))
        counts = held.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("weight"))
        people = persons.join(counts, "id").select(F.col("id").alias("key"), "name", "weight")
        keys, notes = _keys(name, values, _equal(people, ["name"], values), people, True)
        found = held.join(keys.select(F.col("key").alias("p_key")), F.col("person_id") == F.col("p_key"), "left_semi")
        bare = credits.limit(1).agg(F.count("*").alias("n")).where("n = 0")
        notes = notes.unionByName(bare.select(F.lit("hint").alias("kind"), F.lit(name).alias("field"), F.lit("").alias("typed"), F.lit("no credits are loaded").alias("name"), F.lit(1).alias("place")))
    return Taken(found.select("film_id").distinct(), notes)


def field_filter(name: str, value: str, *, exact: bool = False, **tables: DataFrame) -> DataFrame:
    """film_id of the titles that one field's value holds for."""
    return field_values(name, [(value, exact)], **tables).films


def characters_holding(credits: DataFrame, text: str) -> DataFrame:
    """film_id of the titles with a character whose name holds the text anywhere, in any case; a field's value is a whole name instead."""
    return credits.where(F.lower("character").contains(text.strip().lower())).select("film_id").distinct()


@dataclass(frozen=True)
class Answer:
    """rows (film_id, score), best first; whether a free text ranked them; notes (kind, field, typed, name, place): corrections with the name used, suggestions with those offered, hints with their text."""

    rows: DataFrame
    ranked: bool
    notes: DataFrame


def fielded(query: Query, tables: dict) -> tuple[DataFrame, DataFrame]:
    """((film_id, title) of the titles that all fields of a query hold for, notes); values of one field are alternatives."""
    found, notes = tables["films"].select("film_id", "title"), _notes(tables["films"].sparkSession)
    for name, values in query.fields.items():
        taken = field_values(name, [(v, (name, v) in query.exact) for v in values], **tables)
        found, notes = found.join(taken.films, "film_id", "left_semi"), notes.unionByName(taken.notes)
    return found, notes


def scored(query: Query, found: DataFrame, tables: dict) -> DataFrame:
    """(film_id, score) of those found that the free text, if any, gives a score, best first."""
    if query.free:
        names = ("films", "texts", "credits", "persons", "genres", "keywords", "index")
        found = found.join(freeform_scores(query.free, **{k: tables[k] for k in names if k in tables}), "film_id")
    else:
        found = found.withColumn("score", F.lit(0.0))
    return found.orderBy(F.desc("score"), F.lower("title"), "film_id").select("film_id", "score")


def answer(line: str, **tables) -> Answer:
    """A query line's rows and notes; nothing runs before one of them is read."""
    query = read_query(line)
    spark = tables["films"].sparkSession
    found, notes = fielded(query, tables)
    rows = scored(query, found, tables)
    notes = _notes(spark, [("hint", "", "", h, i + 1) for i, h in enumerate(query.hints)]).unionByName(notes)
    n = len(query.free.split())
    if n >= 2 and not query.fields:  # a field that emptied the result explains itself
        none = rows.limit(1).agg(F.count("*").alias("n")).where("n = 0")
        hint = f"no title matches all {n} words: try fewer, or quote a phrase"
        notes = notes.unionByName(none.select(F.lit("hint").alias("kind"), F.lit("").alias("field"), F.lit(query.free).alias("typed"), F.lit(hint).alias("name"), F.lit(1).alias("place")))
    return Answer(rows, bool(query.free), notes)


def search(line: str, **tables) -> DataFrame:
    """(film_id, score) of a query line, best first: values of one field are alternatives, fields all have to hold."""
    return answer(line, **tables).rows


def title_hits(free: str, *, films: DataFrame, texts: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """film_id of the titles that hold each word of a free text; of a title without texts, the text anywhere in it."""
    text = free.strip().lower()
    if not _tokens(text):
        return films.select("film_id").limit(0)
    whole = texts_with(texts, text, ["title"], index)
    bare = films.join(texts.select("film_id"), "film_id", "left_anti").where(F.lower("title").contains(text))
    return whole.select("film_id").unionByName(bare.select("film_id")).distinct()


def hybrid_search(line: str, near: DataFrame, **tables: DataFrame) -> DataFrame:
    """(film_id, score, stage) of a query line with near (film_id, distance) of its free text: meaning adds titles that all fields hold for, and none beside a title hit."""
    query = read_query(line)
    found, _ = fielded(query, tables)
    hits = scored(query, found, tables)
    if not query.free:
        return hits.withColumn("stage", F.lit(0))
    return vectors.hybrid(hits, near, title_hits(query.free, films=tables["films"], texts=tables["texts"], index=tables.get("index")), found if query.fields else None)
