"""Jobs that place incoming titles in the catalogue: imports, promotions, keying, walks, bridges, audits of keys.

Each takes rows with the evidence that was gathered for them (a resolver's verdict, a
corpus match, a forwarded address) and says what becomes of each row. Decisions are ordered
conditions over equi-joins; what an earlier row of the same run does to a later one is a
place within equal keys. Nothing is written here: the write operators take the outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.expressions import film_key
from lumidex.functions.text import norm_title, without_editions

#: Ratings below it never create a title; days in which a return after a relaunch is no arrival.
MINT_MIN_STARS = 4
RELAUNCH_GRACE_DAYS = 30
#: Which source's claim says how a title was met, and the year kinds of sources.
CLAIM_PRECEDENCE = ("criterion", "metacritic", "apple-tv")


#: Numbers of rows themselves, which are never null; groups that rows without a key are dealt to.
_OWN, _GROUPS = ("film_id", "item_id", "line"), 4096


def _dealt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(_GROUPS)).cast("int")


def _spread(rows: DataFrame, column: str) -> Column:
    """column as a text key; a null, which equals nothing, is a hash of its row, so that rows without a key do not meet in one task."""
    return F.coalesce(F.col(column).cast("string"), F.concat(F.lit("\0"), _dealt(*rows.columns).cast("string")))


def _left(rows: DataFrame, found: DataFrame, on: dict[str, str]) -> DataFrame:
    """rows with found's columns, joined by {row's column: found's column}; the latter go."""
    mine = {a: f"_key_{a}" for a in on if a not in _OWN}
    keyed = rows.withColumns({m: _spread(rows, a) for a, m in mine.items()})
    condition = [keyed[mine[a]] == found[b].cast("string") if a in mine else keyed[a] == found[b] for a, b in on.items()]
    return keyed.join(found, condition, "left").drop(*[found[b] for b in on.values()], *mine.values())


def holders(ids: DataFrame, canon: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(authority, value, holder, hidden): who holds an id, followed to where it was merged; hidden: that title is tombstoned."""
    to = canon.select(F.col("film_id").alias("c_film"), "canonical_id")
    gone = dispositions.where("kind = 'tombstoned'").select(F.col("film_id").alias("d_film"), F.lit(True).alias("gone"))
    held = ids.join(to, ids["film_id"] == F.col("c_film"), "left").select("authority", "value", F.coalesce("canonical_id", "film_id").alias("holder"))
    held = held.dropDuplicates(["authority", "value"])
    return held.join(gone, F.col("holder") == F.col("d_film"), "left").select("authority", "value", "holder", F.coalesce("gone", F.lit(False)).alias("hidden"))


def with_holder(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows (tt, tmdb_id) with holder and hidden: of the imdb id, else of the tmdb id."""
    by = lambda name, key: held.where(F.col("authority") == name).select(F.col("value").alias(key), F.col("holder").alias(f"{key}_holder"), F.col("hidden").alias(f"{key}_hidden"))
    joined = _left(_left(rows, by("imdb", "h_tt"), {"tt": "h_tt"}), by("tmdb", "h_tmdb"), {"tmdb_id": "h_tmdb"})
    hidden = F.when(F.col("h_tt_holder").isNotNull(), F.col("h_tt_hidden")).otherwise(F.coalesce("h_tmdb_hidden", F.lit(False)))
    return joined.select(*rows.columns, F.coalesce("h_tt_holder", "h_tmdb_holder").alias("holder"), hidden.alias("hidden"))


def tombstoned_keys(films: DataFrame, dispositions: DataFrame, canon: DataFrame) -> DataFrame:
    """(key) of titles that are hidden, or merged into hidden ones."""
    hidden = dispositions.where("kind = 'tombstoned'").select(F.col("film_id").alias("live"))
    to = canon.select(F.col("film_id").alias("c_film"), "canonical_id")
    rows = films.join(to, films["film_id"] == F.col("c_film"), "left").select("key", F.coalesce("canonical_id", "film_id").alias("live"))
    return rows.join(hidden, "live", "left_semi").select("key").distinct()


def _nth(condition: Column, *keys: str, order: list[str]) -> Column:
    """A row's place among those of its keys that meet condition, from 1; null for others, which are dealt out by a hash of their own."""
    met = F.coalesce(condition, F.lit(False))
    return F.when(condition, F.row_number().over(Window.partitionBy(*[F.when(met, F.col(k)) for k in keys], F.when(~met, _dealt(*order))).orderBy(*order)))


def owned_outcomes(titles: DataFrame, held: DataFrame, keys: DataFrame, tombstoned: DataFrame) -> DataFrame:
    """(item_id, outcome, film_id) of an owned library's titles (item_id, title, year, tt, tmdb_id, winner, tied, reason).

    In this order: resolved (an id's holder, unless hidden), ambiguous-owned (the corpus
    ties), matched (the corpus' winner), year-drift (its evidence conflicts), skipped (the
    key was tombstoned), matched (the key is held, or created by an earlier row), created.
    """
    rows = with_holder(titles, held).withColumn("key", film_key(F.col("title"), F.col("year")))
    rows = _left(rows, keys.select(F.col("key").alias("k_key"), F.col("film_id").alias("k_film")), {"key": "k_key"})
    rows = _left(rows, tombstoned.select(F.col("key").alias("t_key"), F.lit(True).alias("t_gone")), {"key": "t_key"})
    resolved = F.col("holder").isNotNull() & ~F.col("hidden")
    fresh = ~resolved & ~F.coalesce("tied", F.lit(False)) & F.col("winner").isNull() & F.col("reason").isNull() & F.col("t_gone").isNull() & F.col("k_film").isNull()
    rows = rows.withColumn("fresh", fresh).withColumn("nth", _nth(F.col("fresh"), "key", order=["item_id"]))
    outcome = (
        F.when(resolved, "resolved").when(F.col("tied"), "ambiguous-owned").when(F.col("winner").isNotNull(), "matched").when(F.col("reason").isNotNull(), "year-drift")
        .when(F.col("t_gone"), "skipped").when(F.col("k_film").isNotNull(), "matched").when(F.col("nth") > 1, "matched").otherwise("created")
    )
    film = F.when(resolved, F.col("holder")).when(F.coalesce("tied", F.lit(False)), None).otherwise(F.coalesce("winner", F.when(F.col("reason").isNull() & F.col("t_gone").isNull(), F.col("k_film"))))
    return rows.select("item_id", outcome.alias("outcome"), film.alias("film_id"))


def promotion_outcomes(staged: DataFrame, claimed: DataFrame, open_reviews: DataFrame, held: DataFrame, keys: DataFrame, tombstoned: DataFrame) -> DataFrame:
    """(slug, outcome, film_id) of staged titles (slug, title, year, rank, tt, tmdb_id): already-linked, skipped, linked, key-conflict or promoted.

    claimed: slugs some title holds; open_reviews: slugs a human is asked about.
    """
    rows = with_holder(staged, held).withColumn("key", film_key(F.col("title"), F.col("year")))
    flag = lambda df, column, name: df.select(F.col(column).alias(f"x_{name}"), F.lit(True).alias(name)).distinct()
    rows = _left(_left(_left(rows, flag(claimed, "slug", "is_claimed"), {"slug": "x_is_claimed"}), flag(open_reviews, "slug", "asked"), {"slug": "x_asked"}), flag(tombstoned, "key", "gone"), {"key": "x_gone"})
    rows = _left(rows, keys.select(F.col("key").alias("k_key"), F.col("film_id").alias("k_film")), {"key": "k_key"})
    linked = F.col("holder").isNotNull() & ~F.col("hidden")
    fresh = F.col("is_claimed").isNull() & F.col("asked").isNull() & F.col("gone").isNull() & ~linked & F.col("k_film").isNull()
    rows = rows.withColumn("fresh", fresh).withColumn("nth", _nth(F.col("fresh"), "key", order=["rank", "slug"]))
    outcome = (
        F.when(F.col("is_claimed"), "already-linked").when(F.col("asked") | F.col("gone"), "skipped").when(linked, "linked")
        .when(F.col("k_film").isNotNull() | (F.col("nth") > 1), "key-conflict").otherwise("promoted")
    )
    film = F.when(outcome == "linked", F.col("holder")).when(outcome == "key-conflict", F.col("k_film"))
    return rows.select("slug", outcome.alias("outcome"), film.alias("film_id"))


def rating_outcomes(ratings: DataFrame, held: DataFrame, vetoed: DataFrame) -> DataFrame:
    """(line, outcome, film_id) of old ratings (line, stars, kind, tt, tmdb_id): error, unresolved, blocked, linked, absent or would-create.

    kind is the resolver's, null where its lookup failed; vetoed: lines whose title the
    corpus has. What is rated below MINT_MIN_STARS is never created.
    """
    rows = _left(with_holder(ratings, held), vetoed.select(F.col("line").alias("v_line"), F.lit(True).alias("vetoed")).distinct(), {"line": "v_line"})
    outcome = (
        F.when(F.col("kind").isNull(), "error").when((F.col("kind") != "match") | F.col("tt").isNull(), "unresolved").when(F.col("holder").isNotNull() & F.col("hidden"), "blocked")
        .when(F.col("holder").isNotNull(), "linked").when(F.col("stars") < MINT_MIN_STARS, "absent").when(F.col("vetoed"), "blocked").otherwise("would-create")
    )
    return rows.select("line", outcome.alias("outcome"), F.when(outcome == "linked", F.col("holder")).alias("film_id"))


def creation_outcomes(entries: DataFrame, reviews: DataFrame, held: DataFrame, vetoed: DataFrame) -> DataFrame:
    """(list_slug, rank, outcome, film_id) of a list's lines (list_slug, rank, film_id, kind, agreement, tt, tmdb_id) that no title and no review row holds.

    error (every lookup failed), blocked (the ids disagree, nothing resolves, a tombstone or
    the corpus holds it), duplicate-entry (another line of the list has the title, or an
    earlier one makes it), linked, or created.
    """
    value = F.concat("list_slug", F.lit("#"), F.col("rank").cast("string"))
    work = entries.where("film_id is null").withColumn("value", value).drop("film_id").join(reviews.select("value").distinct(), "value", "left_anti")
    taken = entries.where("film_id is not null").select(F.col("list_slug").alias("e_slug"), F.col("film_id").alias("e_film"), F.lit(True).alias("taken")).distinct()
    rows = _left(with_holder(work, held), taken, {"list_slug": "e_slug", "holder": "e_film"})
    rows = _left(rows, vetoed.select(F.col("value").alias("v_value"), F.lit(True).alias("vetoed")).distinct(), {"value": "v_value"})
    sure = F.col("kind").isNotNull() & (F.col("agreement") != "disagree") & F.col("tt").isNotNull() & ~(F.col("holder").isNotNull() & F.col("hidden")) & F.col("taken").isNull()
    able = F.coalesce(sure & (F.col("holder").isNotNull() | F.col("vetoed").isNull()), F.lit(False))
    rows = rows.withColumn("able", able).withColumn("target", F.coalesce(F.col("holder").cast("string"), F.col("tt"))).withColumn("nth", _nth(F.col("able"), "list_slug", "target", order=["rank"]))
    outcome = (
        F.when(F.col("kind").isNull(), "error").when((F.col("agreement") == "disagree") | F.col("tt").isNull() | (F.col("holder").isNotNull() & F.col("hidden")), "blocked")
        .when(F.col("taken") | (F.col("nth") > 1), "duplicate-entry").when(F.col("holder").isNotNull(), "linked").when(F.col("vetoed"), "blocked").otherwise("created")
    )
    return rows.select("list_slug", "rank", outcome.alias("outcome"), F.when(outcome == "linked", F.col("holder")).alias("film_id"))


def year_updates(films: DataFrame, dispositions: DataFrame, canon: DataFrame, updates: DataFrame) -> DataFrame:
    """(film_id, year, key, clash, retired) of updates (film_id, year): the new natural key, and who holds it.

    A live holder, or one merged into another title, clashes (by its canonical id); a title
    that was merged into this very one gives its key up and is retired. Films have unique keys.
    """
    new = films.select("film_id", "title").join(updates, "film_id").select("film_id", "year", film_key(F.col("title"), F.col("year")).alias("key"))
    to = canon.select(F.col("film_id").alias("c_film"), "canonical_id")
    gone = dispositions.select(F.col("film_id").alias("d_film"), F.lit(True).alias("disposed")).distinct()
    held = films.select(F.col("film_id").alias("h_film"), F.col("key").alias("h_key")).join(to, F.col("h_film") == F.col("c_film"), "left").join(gone, F.col("h_film") == F.col("d_film"), "left")
    held = held.select("h_film", "h_key", F.when(F.col("disposed"), F.coalesce("canonical_id", "h_film")).otherwise(F.col("h_film")).alias("h_live"))
    joined = new.join(held, (F.col("key") == F.col("h_key")) & (F.col("film_id") != F.col("h_film")), "left")
    own = F.col("h_live") == F.col("film_id")
    return joined.select("film_id", "year", "key", F.when(~own, F.col("h_live")).alias("clash"), F.when(own, F.col("h_film")).alias("retired"))


def match_outcomes(targets: DataFrame, ids: DataFrame, films: DataFrame, dispositions: DataFrame, canon: DataFrame) -> DataFrame:
    """(film_id, outcome) of matches (film_id, year, commerce, tmdb_id, winner_year) with TMDB: matched, adopted, collision or id-conflict.

    A missing year, or another one where the title came from a shop, is adopted; a key that
    another title holds makes that a collision.
    """
    held = ids.where("authority = 'tmdb'").select(F.col("value").alias("h_value"), F.col("film_id").alias("h_film")).dropDuplicates(["h_value"])
    rows = _left(targets, held, {"tmdb_id": "h_value"}).withColumn("conflict", F.coalesce(F.col("h_film") != F.col("film_id"), F.lit(False)))
    adopts = F.col("winner_year").isNotNull() & (F.col("year").isNull() | (F.col("commerce") & (F.col("winner_year") != F.col("year"))))
    rows = rows.withColumn("adopts", ~F.col("conflict") & adopts)
    moved = year_updates(films, dispositions, canon, rows.where("adopts").select("film_id", F.col("winner_year").alias("year"))).select(F.col("film_id").alias("u_film"), "clash")
    rows = _left(rows, moved, {"film_id": "u_film"})
    outcome = F.when(F.col("conflict"), "id-conflict").when(~F.col("adopts"), "matched").when(F.col("clash").isNotNull(), "collision").otherwise("adopted")
    return rows.select("film_id", outcome.alias("outcome"))


def retitled(works: DataFrame, films: DataFrame, dispositions: DataFrame, canon: DataFrame, ids: DataFrame) -> DataFrame:
    """(film_id, key, refused) of editions that become works (film_id, title, year, tt, tmdb_id): refused where the key or an id is another's."""
    renamed = films.join(works.select(F.col("film_id").alias("w_film"), F.col("title").alias("w_title")), F.col("film_id") == F.col("w_film"), "left").withColumn("title", F.coalesce("w_title", "title")).drop("w_film", "w_title")
    keys = year_updates(renamed, dispositions, canon, works.select("film_id", "year")).select(F.col("film_id").alias("y_film"), "key", "clash")
    wanted = works.select("film_id", F.explode(F.create_map(F.lit("imdb"), "tt", F.lit("tmdb"), "tmdb_id")).alias("authority", "value")).where("value is not null")
    other = ids.select("authority", "value", F.col("film_id").alias("o_film"))
    taken = wanted.join(other, ["authority", "value"]).where("film_id <> o_film").select(F.col("film_id").alias("t_film"), F.lit(True).alias("taken")).distinct()
    rows = _left(_left(works, keys, {"film_id": "y_film"}), taken, {"film_id": "t_film"})
    return rows.select("film_id", "key", (F.col("clash").isNotNull() | F.coalesce("taken", F.lit(False))).alias("refused"))


def queue_once(entries: DataFrame, reviews: DataFrame, authority: str) -> DataFrame:
    """entries (reason, film_id, value) to append: none with an open row of its reason and title, none that was decided as it is, and one of equal ones."""
    rows = reviews.where(F.col("authority") == authority)
    open_rows = rows.where("not resolved").select(F.col("reason").alias("o_reason"), F.col("film_id").alias("o_film"))
    done = rows.where("resolved").select(F.col("reason").alias("d_reason"), F.col("film_id").alias("d_film"), F.col("value").alias("d_value"))
    left = entries.dropDuplicates(["reason", "film_id"]).join(open_rows, (F.col("reason") == F.col("o_reason")) & F.col("film_id").eqNullSafe(F.col("o_film")), "left_anti")
    return left.join(done, (F.col("reason") == F.col("d_reason")) & F.col("film_id").eqNullSafe(F.col("d_film")) & F.col("value").eqNullSafe(F.col("d_value")), "left_anti")


def rebuilt_no_match(missed: DataFrame, reviews: DataFrame) -> DataFrame:
    """The titles of missed (film_id) to ask about: none with another open row of TMDB's, none whose no-match was decided."""
    rows = reviews.where("authority = 'tmdb'")
    flagged = rows.where("not resolved and reason <> 'no-match'").select("film_id")
    decided = rows.where("resolved and reason in ('no-match', 'no-match-reviewed')").select("film_id")
    return missed.join(flagged, "film_id", "left_anti").join(decided, "film_id", "left_anti")


def no_match_worklist(films: DataFrame, reviews: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(review_id, film_id, promoted): open no-match rows, and promoted ones whose title has no open no-match row, of movies that are not disposed."""
    rows = reviews.where("authority = 'tmdb' and not resolved and reason in ('no-match', 'no-match-reviewed')")
    plain = rows.where("reason = 'no-match'")
    promoted = rows.where("reason = 'no-match-reviewed'").join(plain.select("film_id"), "film_id", "left_anti")
    both = plain.select(F.col("id").alias("review_id"), "film_id", F.lit(False).alias("promoted")).unionByName(promoted.select(F.col("id").alias("review_id"), "film_id", F.lit(True).alias("promoted")))
    return both.join(films.where("kind = 'movie'").select("film_id"), "film_id", "left_semi").join(dispositions.select("film_id"), "film_id", "left_anti")


def no_match_verdicts(work: DataFrame, ids: DataFrame, found: DataFrame) -> DataFrame:
    """(film_id, verdict) of a no-match worklist (film_id, promoted, lookup_tmdb, kind, tt, tmdb_id): review-open, linked, unlinked, conflict, keyed, review or match.

    found: titles whose TMDB record is known; lookup_tmdb: the TMDB id of the imdb id that
    the title holds itself; kind, tt and tmdb_id: the resolver's, for titles without one.
    """
    own = ids.groupBy(F.col("film_id").alias("i_film")).agg(F.min(F.when(F.col("authority") == "imdb", F.col("value"))).alias("own_tt"), F.min(F.when(F.col("authority") == "tmdb", F.col("value"))).alias("own_tmdb"))
    by = lambda name, key: ids.where(F.col("authority") == name).groupBy(F.col("value").alias(f"{key}_value")).agg(F.min("film_id").alias(key))
    rows = _left(_left(work, own, {"film_id": "i_film"}), found.select(F.col("film_id").alias("f_film"), F.lit(True).alias("found")).distinct(), {"film_id": "f_film"})
    rows = _left(_left(_left(rows, by("tmdb", "looked"), {"lookup_tmdb": "looked_value"}), by("imdb", "tt_holder"), {"tt": "tt_holder_value"}), by("tmdb", "id_holder"), {"tmdb_id": "id_holder_value"})
    other = lambda c: F.coalesce(F.col(c) != F.col("film_id"), F.lit(False))
    keyed = F.when(F.col("lookup_tmdb").isNull(), "unlinked").when(other("looked"), "conflict").otherwise("keyed")
    free = F.when((F.coalesce("kind", F.lit("")) != "match") | F.col("tt").isNull(), "review").when(other("tt_holder") | other("id_holder"), "conflict").otherwise("match")
    linked = F.col("own_tt").isNotNull() & F.col("own_tmdb").isNotNull() & F.coalesce("found", F.lit(False))
    return rows.select("film_id", F.when(F.col("promoted"), "review-open").when(linked, "linked").when(F.col("own_tt").isNotNull(), keyed).otherwise(free).alias("verdict"))


def keying_outcomes(targets: DataFrame, ids: DataFrame) -> DataFrame:
    """(film_id, outcome) of titles that were never looked up (film_id, kind, tt, tmdb_id): failed, reviewed, held, unlinked or keyed."""
    by = lambda name, key: ids.where(F.col("authority") == name).groupBy(F.col("value").alias(f"{key}_value")).agg(F.min("film_id").alias(key))
    rows = _left(_left(targets, by("imdb", "tt_holder"), {"tt": "tt_holder_value"}), by("tmdb", "id_holder"), {"tmdb_id": "id_holder_value"})
    other = lambda c: F.coalesce(F.col(c) != F.col("film_id"), F.lit(False))
    outcome = (
        F.when(F.col("kind").isNull(), "failed").when((F.col("kind") != "match") | F.col("tt").isNull(), "reviewed").when(other("tt_holder") | other("id_holder"), "held")
        .when(F.col("tmdb_id").isNull(), "unlinked").otherwise("keyed")
    )
    return rows.select("film_id", outcome.alias("outcome"))


def film_queries(films: DataFrame, claims: DataFrame) -> DataFrame:
    """(film_id, title, year, source, director, runtime_min): how a title was met, by its claim of the highest precedence, else as it is held."""
    place = F.array_position(F.array(*map(F.lit, CLAIM_PRECEDENCE)), F.col("authority"))
    able = claims.where(F.col("authority").isin(*CLAIM_PRECEDENCE)).select("film_id", F.struct(place.alias("place"), "id", "authority", "title_ingested", "year_claimed").alias("c"), F.when(F.col("authority") == "apple-tv", F.struct("id", "runtime_min")).alias("r"))
    one = able.groupBy(F.col("film_id").alias("c_film")).agg(F.min("c").alias("c"), F.min("r").alias("r"))
    rows = _left(films, one, {"film_id": "c_film"})
    return rows.select("film_id", F.coalesce("c.title_ingested", "title").alias("title"), F.coalesce("c.year_claimed", "year").alias("year"), F.coalesce("c.authority", F.lit("unknown")).alias("source"), "director", F.col("r.runtime_min").alias("runtime_min"))


def claims_from_evidence(ids: DataFrame, listings: DataFrame, staged: DataFrame, owned: DataFrame, films: DataFrame, claims: DataFrame) -> DataFrame:
    """(film_id, authority, value, title_ingested, year_claimed) that evidence in hand supports and claims lack: stream listings, staged titles by their slug, owned titles."""
    listed = listings.where("source = 'criterion'").join(films, "film_id").select("film_id", F.lit("criterion").alias("authority"), F.col("url").alias("value"), F.col("title").alias("title_ingested"), F.col("year").alias("year_claimed"))
    slugs = ids.where("authority = 'metacritic'").select("film_id", F.col("value").alias("slug"))
    scored = slugs.join(staged.select("slug", F.col("title").alias("title_ingested"), F.col("year").alias("year_claimed")), "slug").select("film_id", F.lit("metacritic").alias("authority"), F.col("slug").alias("value"), "title_ingested", "year_claimed")
    bought = owned.select("film_id").join(films, "film_id").select("film_id", F.lit("apple-tv").alias("authority"), F.col("title").alias("value"), F.col("title").alias("title_ingested"), F.col("year").alias("year_claimed"))
    found = listed.unionByName(scored).unionByName(bought).dropDuplicates(["authority", "value"])
    return found.join(claims.select("authority", "value"), ["authority", "value"], "left_anti")


def arbitrated(asked: DataFrame, results: DataFrame, failed: DataFrame) -> DataFrame:
    """(query_id, answer): whether a search found a title of the same name within a year of the one claimed; null where it failed.

    asked (query_id, title, year), results (query_id, title, original_title, year).
    """
    near = results.select("query_id", F.col("year").alias("r_year"), F.explode(F.array("title", "original_title")).alias("name")).where("name is not null")
    same = norm_title(without_editions(F.col("title"))) == norm_title(without_editions(F.col("name")))
    hits = asked.join(near, "query_id").where(F.abs(F.col("year") - F.col("r_year")) <= 1).where(same).select(F.col("query_id").alias("h_id"), F.lit(True).alias("hit")).distinct()
    rows = _left(_left(asked, hits, {"query_id": "h_id"}), failed.select(F.col("query_id").alias("x_id"), F.lit(True).alias("failed")).distinct(), {"query_id": "x_id"})
    return rows.select("query_id", F.when(F.col("failed").isNull(), F.coalesce("hit", F.lit(False))).alias("answer"))


def link_suspects(linked: DataFrame) -> DataFrame:
    """linked (film_id, title, tmdb_title, tmdb_original, alternatives) where none of TMDB's titles is ours."""
    known = F.array_compact(F.concat(F.array("tmdb_title", "tmdb_original"), F.coalesce("alternatives", F.array().cast("array<string>"))))
    each = linked.select("film_id", norm_title(F.col("title")).alias("own"), F.explode_outer(known).alias("name")).select("film_id", F.coalesce(F.col("own") == norm_title(F.col("name")), F.lit(False)).alias("same"))
    return linked.join(each.groupBy("film_id").agg(F.max("same").alias("same")).where("not same").select("film_id"), "film_id", "left_semi")


def edition_groups(contract: DataFrame, films: DataFrame, ids: DataFrame, dispositions: DataFrame, canon: DataFrame) -> DataFrame:
    """(film_id, verdict, twin_id) of editions that a contract names works of (film_id, work_title, work_year, tt, tmdb_id).

    csv-mismatch: the title is no edition and not the work's. twin: one title of the work's
    name and year holds its tmdb id, or, if none does, one without an id that the contract
    gives the same work. Several, or ids and keys of third titles, are a conflict; with no
    twin the edition becomes the work itself.
    """
    keyed = _left(films, ids.where("authority = 'tmdb'").groupBy(F.col("film_id").alias("i_film")).agg(F.min("value").alias("own_tmdb")), {"film_id": "i_film"})
    keyed = keyed.withColumns({"bare": norm_title(without_editions(F.col("title"))), "whole": norm_title(F.col("title"))})
    rows = contract.join(keyed.select("film_id", "bare", "whole"), "film_id").withColumns({"name": norm_title(F.col("work_title")), "edition": F.col("bare") != F.col("whole")})
    named = contract.select(F.col("film_id").alias("n_film"), F.col("tt").alias("n_tt"))
    pool = _left(keyed, named, {"film_id": "n_film"}).select(F.col("film_id").alias("p_film"), F.col("bare").alias("p_name"), F.col("year").alias("p_year"), F.col("own_tmdb").alias("p_tmdb"), "n_tt")
    near = rows.join(pool, (F.col("name") == F.col("p_name")) & (F.col("work_year") == F.col("p_year")) & (F.col("film_id") != F.col("p_film")))
    by_id = F.col("p_tmdb") == F.col("tmdb_id")
    agree = near.groupBy(F.col("film_id").alias("a_film")).agg(
        F.collect_set(F.when(by_id, F.col("p_film"))).alias("with_id"), F.collect_set(F.when(F.col("p_tmdb").isNull() & (F.col("n_tt") == F.col("tt")), F.col("p_film"))).alias("fellows")
    )
    rows = _left(rows, agree, {"film_id": "a_film"}).withColumn("agreeing", F.coalesce(F.when(F.size("with_id") > 0, F.col("with_id")).otherwise(F.col("fellows")), F.array().cast("array<long>")))
    rows = rows.withColumn("twin_id", F.when(F.size("agreeing") == 1, F.element_at("agreeing", 1)))
    wanted = rows.select("film_id", "twin_id", F.explode(F.create_map(F.lit("imdb"), "tt", F.lit("tmdb"), "tmdb_id")).alias("authority", "value")).where("value is not null")
    third = wanted.join(ids.select("authority", "value", F.col("film_id").alias("o_film")), ["authority", "value"]).where("o_film <> film_id and (twin_id is null or o_film <> twin_id)").select(F.col("film_id").alias("b_film"), F.lit(True).alias("blocked")).distinct()
    becomes = retitled(rows.where(F.size("agreeing") == 0).select("film_id", F.col("work_title").alias("title"), F.col("work_year").alias("year"), "tt", "tmdb_id"), films, dispositions, canon, ids).select(F.col("film_id").alias("w_film"), "refused")
    rows = _left(_left(rows, third, {"film_id": "b_film"}), becomes, {"film_id": "w_film"})
    mismatch = ~F.col("edition") & (F.col("whole") != F.col("name"))
    verdict = (
        F.when(mismatch, "csv-mismatch").when(F.size("agreeing") > 1, "conflict").when(F.col("blocked") | F.coalesce("refused", F.lit(False)), "conflict")
        .when(F.size("agreeing") == 1, "twin").otherwise("no-twin")
    )
    return rows.select("film_id", verdict.alias("verdict"), F.when(verdict == "twin", F.col("twin_id")).alias("twin_id"))


def bridge_outcomes(forwards: DataFrame, held: DataFrame) -> DataFrame:
    """(film_id, url, kind) of forwarded old links (film_id, pos, url, answer, mediaid): tombstoned, same-film, held or film, else the answer's own kind.

    held: holders() of the stream's ids with the titles' own hidden state. Of links to one
    unheld id the first by place claims it, and the others compare with that title.
    """
    rows = _left(forwards, held.select(F.col("value").alias("h_value"), "holder"), {"mediaid": "h_value"})
    able = (F.col("answer") == "film") & ~F.col("is_hidden")
    first = F.min(F.when(able & F.col("holder").isNull(), F.struct("pos", "film_id"))).over(Window.partitionBy("mediaid", F.when(F.col("mediaid").isNull(), _dealt("pos", "film_id"))))
    rows = rows.withColumn("first", F.when(F.col("mediaid").isNotNull(), first))
    owner = F.coalesce("holder", "first.film_id")
    claims = F.col("holder").isNull() & (F.col("pos") == F.col("first.pos"))
    kind = F.when(F.col("answer") != "film", F.col("answer")).when(F.col("is_hidden"), "tombstoned").when(claims, "film").when(owner == F.col("film_id"), "same-film").otherwise("held")
    return rows.select("film_id", "url", kind.alias("kind"))


def bridged_urls(listings: DataFrame, bindings: DataFrame) -> DataFrame:
    """(film_id, url): the stream listing's address after bindings (film_id, pos, old_url, url): of the binding whose old link it shows, else the first."""
    stream = listings.where("source = 'criterion'").select("film_id", F.col("url").alias("now"))
    rows = bindings.join(stream, "film_id")
    return rows.groupBy("film_id").agg(F.min_by("url", F.struct(F.coalesce(F.col("old_url") != F.col("now"), F.lit(True)), "pos")).alias("url"))


def listing_urls(stream: DataFrame, tonight: DataFrame, template: str) -> DataFrame:
    """(film_id, url): the stored address (film_id, url) if its path names one of tonight's ids (film_id, pos, mediaid), else the address of the first."""
    ids = tonight.groupBy(F.col("film_id").alias("t_film")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mediaid"))), lambda x: x["mediaid"]).alias("ids"))
    rows = ids.join(stream, F.col("film_id") == F.col("t_film"), "left")
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    own = F.exists("ids", lambda m: (path == F.concat(F.lit("/films/"), m)) | F.startswith(path, F.concat(F.lit("/films/"), m, F.lit("/"))))
    return rows.select(F.col("t_film").alias("film_id"), F.when(own, F.col("url")).otherwise(F.replace(F.lit(template), F.lit("{}"), F.element_at("ids", 1))).alias("url"))


def walk_leaving(listings: DataFrame, ids: DataFrame, labels: DataFrame | None, day) -> DataFrame:
    """listings after a walk on day: what it did not see loses its label; labels (mediaid, label) replace the rest, None (not read tonight) keeps it."""
    stream = F.col("source") == "criterion"
    today = F.col("last_seen") == F.lit(day).cast("date")
    if labels is None:
        return listings.withColumn("leaving_date", F.when(stream & (F.col("last_seen") < F.lit(day).cast("date")), None).otherwise(F.col("leaving_date")))
    said = ids.where("authority = 'criterion'").join(labels, F.col("value") == F.col("mediaid")).groupBy(F.col("film_id").alias("s_film")).agg(F.max_by("label", "mediaid").alias("label"))
    rows = _left(listings, said, {"film_id": "s_film"})
    return rows.withColumn("leaving_date", F.when(stream, F.when(today, F.col("label"))).otherwise(F.col("leaving_date"))).drop("label")


def in_relaunch(first_walk: Column, day: Column) -> Column:
    """Whether a return on day is not an arrival, as the source was relaunched within RELAUNCH_GRACE_DAYS."""
    return day <= F.date_add(first_walk, RELAUNCH_GRACE_DAYS)


def walk_arrivals(seen: DataFrame, listings: DataFrame, frontier, relaunch_frontier) -> DataFrame:
    """(film_id) of tonight's stream titles seen (film_id) that arrive: new, or last seen before the frontier; within the grace window, before the relaunch's frontier."""
    held = listings.where("source = 'criterion'").select(F.col("film_id").alias("h_film"), "last_seen")
    rows = _left(seen.select("film_id").distinct(), held, {"film_id": "h_film"})
    limit = F.least(F.lit(frontier).cast("date"), F.coalesce(F.lit(relaunch_frontier).cast("date"), F.lit(frontier).cast("date")))
    return rows.where(F.col("last_seen").isNull() | (F.col("last_seen") < limit)).select("film_id")


def walk_decisions(items: DataFrame, held: DataFrame, covered: DataFrame, keys: DataFrame) -> DataFrame:
    """(mediaid, decision, film_id) of a catalogue's items (pos, mediaid, record, kind, tt, tmdb_id, title, year, vetoed), in their order.

    listed (the id is held), waiting (a review names it), skipped (no resolver answer),
    no-record, no-match, held (an id's holder), blocked (hidden holder or vetoed), joins (an
    earlier item creates the same work), key-collision (the key is held or being created), created.
    """
    own = held.where("authority = 'criterion'").select(F.col("value").alias("o_value"), F.col("holder").alias("own"))
    rows = _left(with_holder(items, held), own, {"mediaid": "o_value"})
    rows = _left(rows, covered.select(F.col("mediaid").alias("c_id"), F.lit(True).alias("covered")).distinct(), {"mediaid": "c_id"})
    rows = rows.withColumn("key", film_key(F.col("title"), F.col("year")))
    rows = _left(rows, keys.select(F.col("key").alias("k_key"), F.lit(True).alias("k_held")), {"key": "k_key"})
    asked = F.col("own").isNull() & F.col("covered").isNull() & F.col("kind").isNotNull() & F.col("record") & (F.col("kind") == "match") & F.col("tt").isNotNull()
    able = F.coalesce(asked & F.col("holder").isNull() & ~F.col("vetoed") & F.col("k_held").isNull(), F.lit(False))
    rows = rows.withColumn("able", able).withColumn("by_tt", _nth(F.col("able"), "tt", order=["pos"]))
    rows = rows.withColumn("first", F.col("able") & (F.col("by_tt") == 1)).withColumn("by_key", _nth(F.col("first"), "key", order=["pos"]))
    # a work joins its first item only if that one was created; items without an id join none
    made = F.max(F.when(F.col("by_key") == 1, True)).over(Window.partitionBy("tt", F.when(F.col("tt").isNull(), _dealt("pos"))))
    rows = rows.withColumn("made", made)
    decision = (
        F.when(F.col("own").isNotNull(), "listed").when(F.col("covered"), "waiting").when(F.col("record") == F.lit(False), "no-record").when(F.col("kind").isNull(), "skipped")
        .when((F.col("kind") != "match") | F.col("tt").isNull(), "no-match").when(F.col("holder").isNotNull() & F.col("hidden"), "blocked").when(F.col("holder").isNotNull(), "held")
        .when(F.col("vetoed"), "blocked").when(F.col("k_held"), "key-collision").when(F.col("by_key") == 1, "created").when(F.col("made"), "joins").otherwise("key-collision")
    )
    return rows.select("mediaid", decision.alias("decision"), F.when(decision == "listed", F.col("own")).when(decision == "held", F.col("holder")).alias("film_id"))


def store_outcomes(targets: DataFrame, by_imdb: DataFrame, by_search: DataFrame, ids: DataFrame) -> DataFrame:
    """(film_id, itunes_id, outcome) of titles without a store id (film_id, imdb_id): by-imdb, by-search, held, ambiguous or unmatched.

    by_imdb (imdb_id, itunes_id, removed): a removed product, or one another title holds, is
    a miss, and the search's answer (film_id, itunes_id, n) counts. A held answer that the
    search does not better stays held.
    """
    holder = ids.where("authority = 'itunes'").groupBy(F.col("value").alias("h_value")).agg(F.min("film_id").alias("h_film"))
    first = by_imdb.where("not removed").groupBy("imdb_id").agg(F.min("itunes_id").alias("one")).join(holder, F.col("one") == F.col("h_value"), "left").select(F.col("imdb_id").alias("o_id"), "one", F.col("h_film").alias("one_film"))
    second = by_search.join(holder, F.col("itunes_id") == F.col("h_value"), "left").select(F.col("film_id").alias("s_film"), F.col("itunes_id").alias("two"), "n", F.col("h_film").alias("two_film"))
    rows = _left(_left(targets, first, {"imdb_id": "o_id"}), second, {"film_id": "s_film"})
    taken = lambda c: F.coalesce(F.col(c) != F.col("film_id"), F.lit(False))
    exact, answer = F.col("one").isNotNull() & ~taken("one_film"), F.coalesce(F.col("n") == 1, F.lit(False))
    outcome = (
        F.when(exact, "by-imdb").when(answer & ~taken("two_film"), "by-search").when(taken("one_film") | (answer & taken("two_film")), "held")
        .when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    )
    return rows.select("film_id", F.when(outcome == "by-imdb", F.col("one")).when(outcome == "by-search", F.col("two")).alias("itunes_id"), outcome.alias("outcome"))


def wishlist_outcomes(wanted: DataFrame, known: DataFrame, ids: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(itunes_id, film_id, outcome) of a wishlist's store ids that no live title holds: resolved, no-imdb or not-in-catalogue.

    known (itunes_id, imdb_id): what the store says of a product.
    """
    live = ids.join(dispositions.select("film_id"), "film_id", "left_anti")
    unknown = wanted.select("itunes_id").distinct().join(live.where("authority = 'itunes'").select(F.col("value").alias("itunes_id")), "itunes_id", "left_anti")
    spoken = ids.where("authority = 'itunes'").select(F.col("value").alias("x_value"), F.lit(True).alias("spoken")).distinct()
    place = live.where("authority = 'imdb'").groupBy(F.col("value").alias("p_value")).agg(F.min("film_id").alias("film_id"))
    rows = _left(_left(_left(unknown, known.select(F.col("itunes_id").alias("k_id"), "imdb_id"), {"itunes_id": "k_id"}), place, {"imdb_id": "p_value"}), spoken, {"itunes_id": "x_value"})
    outcome = F.when(F.col("imdb_id").isNull(), "no-imdb").when(F.col("film_id").isNull() | F.col("spoken"), "not-in-catalogue").otherwise("resolved")
    return rows.select("itunes_id", F.when(outcome == "resolved", F.col("film_id")).alias("film_id"), outcome.alias("outcome"))


def rematch_outcomes(missed: DataFrame, keyed: DataFrame, ids: DataFrame, films: DataFrame, dispositions: DataFrame, canon: DataFrame) -> DataFrame:
    """(film_id, turn, outcome) of a rematch: missed titles that are looked up again, then years of those that hold an id.

    missed (film_id, year, commerce, tmdb_id, winner_year), tmdb_id null where the search
    still finds nothing: still-missed, or match_outcomes' kinds. keyed (film_id, year,
    tmdb_year) of titles from shops: unchanged, adopted or collision.
    """
    again = match_outcomes(missed.where("tmdb_id is not null"), ids, films, dispositions, canon).select("film_id", F.lit("match").alias("turn"), "outcome")
    none = missed.where("tmdb_id is null").select("film_id", F.lit("match").alias("turn"), F.lit("still-missed").alias("outcome"))
    differs = F.coalesce(~F.col("year").eqNullSafe(F.col("tmdb_year")), F.lit(False)) & F.col("tmdb_year").isNotNull()
    moved = year_updates(films, dispositions, canon, keyed.where(differs).select("film_id", F.col("tmdb_year").alias("year")))
    years = moved.select("film_id", F.lit("year").alias("turn"), F.when(F.col("clash").isNull(), "adopted").otherwise("collision").alias("outcome"))
    same = keyed.where(~differs).select("film_id", F.lit("year").alias("turn"), F.lit("unchanged").alias("outcome"))
    return again.unionByName(none).unionByName(years).unionByName(same)


#: Reasons of a slug's review, and of one whose titles are twins.
SLUG_REASONS, MERGE_REASONS = ("year-gap", "ambiguous-title"), ("id-conflict", "year-collision")


def review_outcomes(reviews: DataFrame, actions: DataFrame, held: DataFrame, films: DataFrame, canon: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(id, outcome, film_id) of what people decided about open reviews (id, verb, film_id, value): one decision a row, or none of it is done.

    verb is film, tmdb-id, create, dismiss, pick, tt or none; value is the id that pick, tt
    and tmdb-id name. outcome is what is written: dismissed, matched, merged, linked,
    created, owned, keyed or unkeyed; refused, with nothing written, where the row is closed,
    the title is gone, or the id or slug is another's. Picks are of ids that a search ranked.
    """
    to = canon.select(F.col("film_id").alias("c_film"), "canonical_id")
    dead = dispositions.where("kind = 'tombstoned'").select(F.col("film_id").alias("d_film"), F.lit(True).alias("gone")).distinct()
    one = actions.groupBy("id").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("verb", "film_id", "value")]).withColumnsRenamed({"film_id": "asked", "value": "said"})
    rows = one.join(reviews.where("not resolved").select(F.col("id").alias("r_id"), "authority", "reason", F.col("film_id").alias("own"), F.col("value").alias("about")), F.col("id") == F.col("r_id"), "left")
    rows = _left(rows, to, {"asked": "c_film"}).withColumn("target", F.coalesce("canonical_id", "asked"))
    rows = _left(_left(rows, dead, {"target": "d_film"}), films.select(F.col("film_id").alias("f_film"), F.lit(True).alias("known")), {"target": "f_film"})
    ids = lambda name, key: held.where(F.col("authority") == name).select(F.col("value").alias(f"{key}_value"), F.col("holder").alias(key))
    rows = _left(_left(_left(rows, ids("imdb", "tt_holder"), {"said": "tt_holder_value"}), ids("tmdb", "id_holder"), {"said": "id_holder_value"}), ids("metacritic", "slug_holder"), {"about": "slug_holder_value"})
    rows = _left(_left(rows, ids("imdb", "about_tt"), {"about": "about_tt_value"}), ids("tmdb", "about_id"), {"about": "about_id_value"})
    verb, by = F.col("verb"), lambda *names: F.col("authority").isin(*names)
    other = lambda c: F.coalesce(F.col(c) != F.col("own"), F.lit(False))
    twin = F.when(F.col("reason") == "year-collision", F.col("about").try_cast("long")).when(F.col("about").rlike("^tt[0-9]+$"), F.col("about_tt")).otherwise(F.col("about_id"))
    lost = (verb == "film") & (F.coalesce("gone", F.lit(False)) | F.col("known").isNull())
    refused = F.lit("refused")
    thumb = F.when(~by("tmdb") | F.col("own").isNull(), refused).when(verb == "none", "unkeyed").when(other("tt_holder"), refused).otherwise("keyed")
    outcome = (
        F.when((F.col("n") > 1) | F.col("r_id").isNull() | lost, refused).when(verb == "dismiss", "dismissed")
        .when(by("criterion"), F.when(verb == "film", "linked").when(verb == "create", "created").when(verb == "tt", "keyed").otherwise(refused))
        .when(verb.isin("pick", "tt", "none"), thumb)
        .when(by("tmdb") & (verb == "tmdb-id") & F.col("own").isNotNull(), F.when(other("id_holder"), refused).otherwise("matched"))
        .when(by("tmdb") & (verb == "film") & F.col("reason").isin(*MERGE_REASONS) & F.col("own").isNotNull(), F.when(twin == F.col("target"), "merged").otherwise(refused))
        .when(by("metacritic") & F.col("reason").isin(*SLUG_REASONS) & F.col("about").isNotNull() & F.col("slug_holder").isNull(), F.when(verb == "film", "linked").when(verb == "create", "created").otherwise(refused))
        .when(by("list") & F.col("about").isNotNull(), F.when(verb == "film", "linked").when(verb == "create", "created").otherwise(refused))
        .when(by("apple-tv") & F.col("about").isNotNull(), F.when(verb == "film", "owned").when(verb == "create", "created").otherwise(refused))
        .otherwise(refused)
    )
    film = F.when(outcome.isin("linked", "merged", "owned"), F.col("target")).when(outcome.isin("matched", "keyed", "unkeyed"), F.col("own"))
    return rows.select("id", outcome.alias("outcome"), film.alias("film_id"))


def recheck_outcomes(stored: DataFrame, filed: DataFrame, relisted: DataFrame, states: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((film_id, outcome, itunes_id), dropped ids (film_id, itunes_id)) of titles that hold store ids (film_id, imdb_id, itunes_id).

    Of a title with several ids those that states (itunes_id, removed) call removed are
    dropped if another is live, and the title is live. Else filed (imdb_id, removed) decides:
    unknown, live, or, where the product was removed, replaced by the search's answer
    (relisted: film_id, new_id, n), held if that is another title's, or dead.
    """
    state = states.select(F.col("itunes_id").alias("t_id"), F.col("removed").alias("t_removed"))
    each = _left(stored, state, {"itunes_id": "t_id"})
    whole = each.groupBy("film_id").agg(F.count("*").alias("n_ids"), F.count_if(F.col("t_removed") == F.lit(False)).alias("n_live"), F.min("itunes_id").alias("own"), F.min("imdb_id").alias("imdb_id"))
    several = (F.col("n_ids") > 1) & (F.col("n_live") > 0)
    dropped = each.where("t_removed").join(whole.where(several).select("film_id"), "film_id", "left_semi").select("film_id", "itunes_id")
    holder = ids.where("authority = 'itunes'").groupBy(F.col("value").alias("h_value")).agg(F.min("film_id").alias("h_film"))
    rows = _left(whole, filed.select(F.col("imdb_id").alias("f_id"), F.col("removed").alias("gone")), {"imdb_id": "f_id"})
    rows = _left(_left(rows, relisted.select(F.col("film_id").alias("r_film"), "new_id", "n"), {"film_id": "r_film"}), holder, {"new_id": "h_value"})
    found = F.coalesce((F.col("n") == 1) & (F.col("new_id") != F.col("own")), F.lit(False))
    outcome = (
        F.when(several, "live").when(F.col("gone").isNull(), "unknown").when(~F.col("gone"), "live").when(~found, "dead")
        .when(F.coalesce(F.col("h_film") != F.col("film_id"), F.lit(False)), "held").otherwise("replaced")
    )
    return rows.select("film_id", outcome.alias("outcome"), F.when(outcome == "replaced", F.col("new_id")).otherwise(F.col("own")).alias("itunes_id")), dropped


def walk_listings(listings: DataFrame, decided: DataFrame, items: DataFrame, day, template: str) -> DataFrame:
    """The stream's listings (film_id, url, first_seen, last_seen) after a walk's decisions (mediaid, film_id) on its items (pos, mediaid): seen on day, under a stored address if it names one of tonight's ids; others stay as they were."""
    stream = listings.where("source = 'criterion'").select("film_id", "url", "first_seen", "last_seen")
    tonight = decided.where("film_id is not null").join(items.select("mediaid", "pos"), "mediaid").select("film_id", "pos", "mediaid")
    urls = listing_urls(stream.select("film_id", "url"), tonight, template).select(F.col("film_id").alias("u_film"), F.col("url").alias("now"))
    rows = stream.join(urls, F.col("film_id") == F.col("u_film"), "full")
    seen = F.col("u_film").isNotNull()
    return rows.select(F.coalesce("film_id", "u_film").alias("film_id"), F.coalesce("now", "url").alias("url"), F.coalesce("first_seen", F.lit(day).cast("date")).alias("first_seen"), F.when(seen, F.lit(day).cast("date")).otherwise(F.col("last_seen")).alias("last_seen"))
