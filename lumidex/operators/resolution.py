"""Decisions around identity: reconciling ids, gates, nearest titles, survivors, trailers, list imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.text import embedded_year, norm_title, without_editions

NEAREST = 5
AGREE, DISAGREE, SUPPLIED = "agree", "disagree", "supplied"


def reconciled(resolved: Column, listed: Column) -> Column:
    """struct(tt, agreement) from the resolver's id and the one a list prints: with both and different ones neither holds."""
    agreement = (
        F.when(listed.isNull(), "").when(resolved.isNull(), SUPPLIED).when(resolved == listed, AGREE).otherwise(DISAGREE)
    )
    return F.struct(F.when(resolved.isNull() | listed.isNull() | (resolved == listed), F.coalesce(resolved, listed)).alias("tt"), agreement.alias("agreement"))


def best_form(verdicts: DataFrame) -> DataFrame:
    """Of the verdicts (entry_id, form, kind, tt, reason) on an entry's forms the first match, else that on the first form."""
    order = F.struct(F.when(F.col("kind") == "match", 0).otherwise(1), "form")
    return verdicts.groupBy("entry_id").agg(F.min_by(F.struct("form", "kind", "tt", "reason"), order).alias("v")).select("entry_id", "v.*")


def gates(verdicts: DataFrame, ids: DataFrame, tombstoned: DataFrame, vetoed: DataFrame, canon: DataFrame) -> DataFrame:
    """verdicts (entry_id, tt, key) with gate and holder: held, tombstoned, blocked or clear, in this order.

    held: a title has the id already, followed to where it was merged; blocked: the corpus
    has a title of the same form (vetoed: entry_id).
    """
    held = ids.where("authority = 'imdb'").select(F.col("value").alias("h_tt"), F.col("film_id").alias("holder"))
    to = canon.select(F.col("film_id").alias("c_film"), "canonical_id")
    held = held.join(to, F.col("holder") == F.col("c_film"), "left").select("h_tt", F.coalesce("canonical_id", "holder").alias("holder"))
    rows = verdicts.join(held, F.col("tt") == F.col("h_tt"), "left")
    rows = rows.join(tombstoned.select(F.col("key").alias("t_key")), F.col("key") == F.col("t_key"), "left").join(vetoed.select(F.col("entry_id").alias("v_id")).distinct(), F.col("entry_id") == F.col("v_id"), "left")
    gate = F.when(F.col("holder").isNotNull(), "held").when(F.col("t_key").isNotNull(), "tombstoned").when(F.col("v_id").isNotNull(), "blocked").otherwise("clear")
    return rows.select(*verdicts.columns, gate.alias("gate"), "holder")


def import_outcomes(gated: DataFrame) -> DataFrame:
    """gated (list_slug, rank, entry_id, tt, agreement, gate, holder) with outcome: what an import would do with each line.

    Of lines that lead to one title or id the first by rank has it, the others are duplicates.
    """
    target = F.coalesce(F.col("holder").cast("string"), F.col("tt"))
    nth = F.row_number().over(Window.partitionBy("list_slug", target).orderBy("rank"))
    rows = gated.withColumn("nth", F.when(target.isNotNull(), nth).otherwise(1))
    outcome = (
        F.when(F.col("agreement") == DISAGREE, "review").when(F.col("tt").isNull(), "review").when(F.col("nth") > 1, "duplicate-entry")
        .when(F.col("gate") == "held", "linked").when(F.col("gate") == "clear", "would-create").otherwise("blocked")
    )
    return rows.withColumn("outcome", outcome).drop("nth")


def nearest_titles(films: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, film_id, stage) of queries (query_id, title, year): the one title, all of an ambiguous title, or up to NEAREST near ones.

    Stages: 0 the same normalised title and year; 1 all words in the title; 2 the normalised
    query inside the title's, whatever the year. Only a query's first stage with hits counts,
    and a query without words has stage 0 alone. Words meet by an equi-join on the query's
    rarest word and substrings on its rarest window of three characters (the whole of a
    shorter query), so titles are not paired with queries. Equal queries are answered once,
    and equal titles of a year are one title with its first NEAREST films, which are all that
    stages 1 and 2 may return of it; only stage 0 goes back to the films. Films and queries
    themselves are merged, never broadcast: their files are far smaller than their rows.
    """
    def parts(title: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda w: ~w.isin("", "the", "a", "an", "of", "and")))

    def windows(text: Column, n: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))
        return F.when((n > 0) & (F.length(text) >= n), F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    def rarest(asked: DataFrame, held: DataFrame, piece: str) -> DataFrame:
        """asked (a row for each piece) narrowed to each query's piece that the fewest titles hold."""
        counts = held.groupBy(piece).agg(F.count("*").alias("df"))
        return asked.join(counts, piece, "left").groupBy("q_key").agg(F.min_by(piece, F.struct(F.coalesce("df", F.lit(0)), piece)).alias("r_piece"), *[F.any_value(c).alias(c) for c in ("q_norm", "q_words", "q_year")])

    def first(pairs: DataFrame, stage: int) -> DataFrame:
        """The first NEAREST films of each query by year and number, of pairs (q_key, f_year, ids)."""
        order = F.row_number().over(Window.partitionBy("q_key").orderBy(F.coalesce("f_year", F.lit(0)), "film_id"))
        each = pairs.select("q_key", "f_year", F.explode("ids").alias("film_id"))
        return each.withColumn("place", order).where(F.col("place") <= NEAREST).select("q_key", "film_id", F.lit(stage).alias("stage"))

    key = F.to_json(F.struct("title", "year"))
    named = queries.select("query_id", "title", "year").withColumn("q_key", key)
    q = named.groupBy("title", "year").agg(F.first("q_key").alias("q_key")).withColumns({"q_norm": norm_title(without_editions(F.col("title"))), "q_words": parts(F.col("title")), "q_year": F.coalesce("year", embedded_year(F.col("title")))}).select("q_key", "q_norm", "q_words", "q_year")
    nth = F.row_number().over(Window.partitionBy("title", "year").orderBy("film_id"))
    titles = films.select("title", "year", "film_id").withColumn("nth", nth).where(F.col("nth") <= NEAREST).groupBy("title", "year").agg(F.collect_list("film_id").alias("ids"))
    f = titles.withColumns({"f_norm": norm_title(without_editions(F.col("title"))), "f_words": parts(F.col("title"))}).select("title", F.col("year").alias("f_year"), "ids", "f_norm", "f_words")
    fits = F.col("q_year").isNull() | F.coalesce(F.col("q_year") == F.col("f_year"), F.lit(False))
    same = q.join(f, F.col("q_norm") == F.col("f_norm")).where(fits & (F.col("q_norm") != "")).select("q_key", F.col("title").alias("s_title"), F.col("f_year").alias("s_year"))
    same_films = films.select("title", "year", "film_id").hint("merge").join(same, F.col("title").eqNullSafe(F.col("s_title")) & F.col("year").eqNullSafe(F.col("s_year"))).select("q_key", "film_id", F.lit(0).alias("stage"))
    left = q.join(same.select("q_key").distinct(), "q_key", "left_anti")
    by_word = f.select("f_year", "ids", "f_words", F.explode("f_words").alias("word"))
    rare = rarest(left.select("*", F.explode("q_words").alias("word")), by_word, "word")
    near = rare.join(by_word, F.col("r_piece") == F.col("word")).where(fits & (F.size(F.array_except("q_words", "f_words")) == 0)).select("q_key", "f_year", "ids")
    left = left.where((F.size("q_words") > 0) & (F.col("q_norm") != "")).join(near.select("q_key").distinct(), "q_key", "left_anti")
    by_window = f.select("f_year", "ids", "f_norm", F.explode(F.concat(*[windows(F.col("f_norm"), F.lit(n)) for n in (1, 2, 3)])).alias("window"))
    rare = rarest(left.select("*", F.explode(windows(F.col("q_norm"), F.least(F.lit(3), F.length("q_norm")))).alias("window")), by_window, "window")
    inside = rare.join(by_window, F.col("r_piece") == F.col("window")).where(F.col("f_norm").contains(F.col("q_norm"))).select("q_key", "f_year", "ids")
    found = same_films.unionByName(first(near, 1)).unionByName(first(inside, 2))
    return named.select("query_id", "q_key").hint("merge").join(found, "q_key").select("query_id", "film_id", "stage")


def survivors(groups: DataFrame) -> DataFrame:
    """(group_id, film_id): which of a group's titles stays, by (on stream, rated, owned, watchlisted, found), then the smallest id."""
    order = F.struct("on_stream", "rated", "owned", "watchlisted", "found", -F.col("film_id"))
    return groups.groupBy("group_id").agg(F.max_by("film_id", order).alias("film_id"))


def trailers(videos: DataFrame, keep: int = 3) -> DataFrame:
    """The first keep videos of a title (film_id, pos, site, type, key, name, language, official, size, original_language): trailers before teasers, English before the original language."""
    kind = F.when(F.col("type") == "Trailer", 0).when(F.col("type") == "Teaser", 1)
    tongue = F.when(F.coalesce("language", F.lit("")).isin("en", "", "xx"), 0).when(F.col("language") == F.col("original_language"), 1)
    able = videos.where((F.col("site") == "YouTube") & F.col("key").rlike("^[A-Za-z0-9_-]{11}$") & kind.isNotNull() & tongue.isNotNull())
    order = F.struct(kind.alias("kind"), tongue.alias("tongue"), (~F.coalesce("official", F.lit(False))).alias("other"), (-F.coalesce("size", F.lit(0))).alias("smaller"), "pos", "key", F.coalesce("name", F.lit("Trailer")).alias("name"))
    ranked = able.groupBy("film_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, keep).alias("best"))
    return ranked.select("film_id", F.transform("best", lambda v: F.struct(v["key"].alias("key"), v["name"].alias("name"))).alias("trailers"))


def twins(films: DataFrame) -> DataFrame:
    """(film_id, twin_id): titles with a year in them and another title of that name within a year of it.

    An equi-join on (name, year) with the year spread to three.
    """
    dated = films.withColumn("said", embedded_year(F.col("title"))).where("said is not null").select("film_id", norm_title(F.regexp_replace("title", r"\s*\([0-9]{4}\)\s*$", "")).alias("name"), F.explode(F.array(F.col("said") - 1, F.col("said"), F.col("said") + 1)).alias("at"))
    plain = films.select(F.col("film_id").alias("twin_id"), norm_title(F.col("title")).alias("t_name"), F.col("year").alias("t_year"))
    return dated.join(plain, (F.col("name") == F.col("t_name")) & (F.col("at") == F.col("t_year")) & (F.col("film_id") != F.col("twin_id"))).select("film_id", "twin_id")


def row_filter(view: DataFrame, *, title: str = "", director: str = "", languages: tuple[str, ...] = (), ranges: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Rows whose title and director hold the texts in any case, with any of the languages, inside all ranges; a null is in no range."""
    tests = []
    for column, text in (("title", title), ("director", director)):
        if text:
            tests.append(F.coalesce(F.lower(column).contains(text.lower()), F.lit(False)))
    if languages:
        spoken = F.transform(F.split(F.coalesce("language", F.lit("")), ","), lambda t: F.trim(t))
        tests.append(F.arrays_overlap(spoken, F.array(*map(F.lit, languages))))
    for column, (low, high) in (ranges or {}).items():
        tests += [F.coalesce(F.col(column) >= low, F.lit(False))] * (low is not None) + [F.coalesce(F.col(column) <= high, F.lit(False))] * (high is not None)
    return view.where(reduce(lambda a, b: a & b, tests, F.lit(True)))
