"""Catalogue writes as plans: upserts, appends, replacements and the merge of two titles.

Parquet has no MERGE: each function returns the table after the write, built by one
aggregation over old and new rows or by anti-joins, to be written to a new folder that
replaces the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), prefer_new_if_known: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows put in by keys; the last of new's rows wins.

    keep_old: columns that stay as they were; prefer_new_if_known: columns that a null of
    new does not overwrite. One aggregation: a key's rows, two in most cases, are folded.
    """
    value = [c for c in old.columns if c not in keys]
    tagged = old.withColumn("turn", F.lit(0)).unionByName(new.select(*old.columns).withColumn("turn", F.lit(1)))
    out = []
    for c in value:
        if c in keep_old:
            out.append(F.min_by(c, "turn").alias(c))
        elif c in prefer_new_if_known:
            out.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn"))).alias(c))
        else:
            out.append(F.max_by(c, "turn").alias(c))
    return tagged.groupBy(*keys).agg(*out).select(*old.columns)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those of new whose keys it lacks: the first sighting wins."""
    return old.unionByName(new.select(*old.columns).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_where(old: DataFrame, condition: Column, new: DataFrame) -> DataFrame:
    """old without the rows of condition, with new's instead."""
    return old.where(~F.coalesce(condition, F.lit(False))).unionByName(new.select(*old.columns))


def replace_keeping(old: DataFrame, wanted: DataFrame, key: str, keep: str, today) -> DataFrame:
    """The set becomes wanted's keys; those that stay keep their date."""
    return wanted.select(key).distinct().join(old.select(key, keep), key, "left").withColumn(keep, F.coalesce(keep, F.lit(today).cast("date")))


def set_ids(old: DataFrame, new: DataFrame, single: tuple[str, ...] = ("tmdb", "imdb")) -> tuple[DataFrame, DataFrame]:
    """(ids after the write, refused rows) of (film_id, authority, value, first_seen).

    Of the authorities in single a title has one id, which is replaced; of others it
    gathers them. A value that another title holds is refused.
    """
    held = old.select(F.col("authority").alias("h_authority"), F.col("value").alias("h_value"), F.col("film_id").alias("h_film"))
    same = (F.col("authority") == F.col("h_authority")) & (F.col("value") == F.col("h_value"))
    refused = new.join(held, same & (F.col("film_id") != F.col("h_film")), "left_semi")
    accepted = new.join(held, same & (F.col("film_id") != F.col("h_film")), "left_anti")
    replaced = accepted.where(F.col("authority").isin(*single)).select("film_id", "authority").distinct()
    return insert_missing(old.join(replaced, ["film_id", "authority"], "left_anti"), accepted, ["film_id", "authority", "value"]), refused


def fold_yearless(films: DataFrame, known: DataFrame) -> DataFrame:
    """films where a title without a year goes, or takes the year, of its only dated twin.

    Twins have the same lower-cased title. With one distinct year among them the yearless
    row goes if the twin is in the batch, else it takes that year; with none or several it
    stays as it is.
    """
    name = F.lower(F.trim("title"))
    batch_years = films.where("year is not null").select(name.alias("twin"), "year", F.lit(True).alias("here"))
    years = batch_years.unionByName(known.where("year is not null").select(name.alias("twin"), "year", F.lit(False).alias("here")))
    twins = years.groupBy("twin").agg(F.count_distinct("year").alias("n"), F.min("year").alias("twin_year"), F.max("here").alias("here")).where("n = 1")
    joined = films.join(twins, (name == F.col("twin")) & F.col("year").isNull(), "left")
    stays = joined.where(F.col("twin").isNull() | ~F.col("here"))
    return stays.withColumn("year", F.coalesce("year", "twin_year")).select(*films.columns)


def with_guids(films: DataFrame) -> DataFrame:
    """films where each row has a guid: its own, or a new random one. Write the result before use, as a plan that runs again draws others."""
    return films.withColumn("guid", F.coalesce("guid", F.uuid()))


def backfilled(rows: DataFrame, column: str, path: str, kind: str) -> DataFrame:
    """rows whose column, where it is null, comes from a path of their JSON payload; what is not of its kind stays null."""
    return rows.withColumn(column, F.coalesce(column, F.get_json_object("payload", path).try_cast(kind)))


def renumbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Positions from 1 without gaps in each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def inserted_at(order: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """order (keys, film_id, position) with new (keys, film_id, slot) before what stood at slot, counted from 0."""
    both = order.withColumn("at", F.col("position") * 2.0).unionByName(new.select(*keys, "film_id", F.lit(None).cast("int").alias("position"), (F.col("slot") * 2.0 + 1).alias("at")))
    return renumbered(both, keys, [F.col("at"), F.col("film_id")]).select(*order.columns)


def canonical(dispositions: DataFrame, save) -> DataFrame:
    """(film_id, canonical_id): where chains of merges end; rows of a cycle lead to its smallest member.

    Pointer doubling: after k rounds a pointer spans 2**k merges; rounds end when none moves.
    """
    at = dispositions.where("kind = 'merged'").select("film_id", F.col("survivor_id").alias("canonical_id"))
    for _ in range(40):
        up = at.select(F.col("film_id").alias("u_film"), F.col("canonical_id").alias("u_next"))
        moved = at.join(up, at["canonical_id"] == F.col("u_film"), "left")
        cyclic = F.col("u_next") == F.col("film_id")
        step = F.when(cyclic, F.least("film_id", "canonical_id")).otherwise(F.coalesce("u_next", "canonical_id"))
        at = save(moved.select("film_id", step.alias("canonical_id"), (~step.eqNullSafe(F.col("canonical_id"))).alias("moved")), "canonical")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("film_id", "canonical_id")


#: How each table folds when a title is merged into another: the survivor's row wins, rows are widened, or rows are unions.
SURVIVOR_WINS = {"omdb": (), "my_ratings": (), "watchlist": (), "owned": (), "tmdb": (), "tmdb_facts": (), "film_text": (), "film_embedding": (), "film_trailer": (), "unseen": (), "needs_revisit": (), "rank_mark": (), "rank_placement": ("session_id",), "rank_order": ("session_id",)}
UNIONS = {"film_keyword": ("keyword",), "external_ids": ("authority", "value"), "claim": ("authority", "value"), "film_credit": ("person_id", "kind", "job", "character")}


def merged_rows(table: DataFrame, name: str, canon: DataFrame, parts: int | None = None) -> DataFrame:
    """A table after merges: film_id becomes the survivor's, and what collides is folded by the table's rule.

    parts: partitions that listings are dealt to by their new key.
    """
    to = canon.select(F.col("film_id").alias("m_film"), "canonical_id")
    moved = table.join(to, table["film_id"] == F.col("m_film"), "left").withColumn("own", F.col("m_film").isNull()).withColumn("film_id", F.coalesce("canonical_id", "film_id")).drop("m_film", "canonical_id")
    if name == "listings":  # the widest span, the url last seen
        dealt = moved.repartition(parts, "film_id", "source") if parts else moved
        return dealt.groupBy("film_id", "source").agg(F.max_by("url", F.struct("last_seen", "own")).alias("url"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("leaving_date", F.struct("last_seen", "own")).alias("leaving_date")).select(*table.columns)
    if name == "viewing":  # one a day; a service that is known stays, and study is kept
        return moved.groupBy("film_id", "watched_on").agg(F.min("id").alias("id"), F.min_by("service", F.when(F.col("service").isNotNull(), F.struct(~F.col("own"), "id"))).alias("service"), F.min("logged_on").alias("logged_on"), F.max("study").alias("study")).select(*table.columns)
    if name in UNIONS:
        return moved.dropDuplicates(["film_id", *UNIONS[name]]).select(*table.columns)
    keys = ["film_id", *SURVIVOR_WINS[name]]
    rest = [c for c in table.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(~F.col("own"), F.xxhash64(*rest))).alias("row")
    return moved.groupBy(*keys).agg(first).select(*keys, "row.*").select(*table.columns)


def close_gaps(order: DataFrame) -> DataFrame:
    """rank_order with positions from 1 in each session and tier."""
    return renumbered(order, ["session_id", "tier"], [F.col("position"), F.col("film_id")])


def duplicate_groups(films: DataFrame, ids: DataFrame) -> DataFrame:
    """(title_norm, films, verdict) of titles held twice: twin if they share one id, distinct if all differ, else undecided."""
    tmdb = ids.where("authority = 'tmdb'").groupBy("film_id").agg(F.min("value").alias("tmdb"))
    grouped = films.join(tmdb, "film_id", "left").groupBy("title_norm").agg(
        F.array_sort(F.collect_set("film_id")).alias("film_ids"), F.count("*").alias("n"), F.count("tmdb").alias("n_keyed"), F.count_distinct("tmdb").alias("n_ids")
    )
    verdict = F.when((F.col("n_keyed") == F.col("n")) & (F.col("n_ids") == 1), "twin").when((F.col("n_keyed") == F.col("n")) & (F.col("n_ids") == F.col("n")), "distinct").otherwise("undecided")
    return grouped.where("n > 1").select("title_norm", "film_ids", "n", verdict.alias("verdict"))


def not_yet_resolved(entries: DataFrame, reviews: DataFrame, authority: str) -> DataFrame:
    """entries (reason, film_id, value) without those that were resolved before; nulls equal nulls."""
    done = reviews.where((F.col("authority") == authority) & F.col("resolved")).select(F.col("reason").alias("d_reason"), F.col("film_id").alias("d_film"), F.col("value").alias("d_value"))
    same = F.col("reason").eqNullSafe(F.col("d_reason")) & F.col("film_id").eqNullSafe(F.col("d_film")) & F.col("value").eqNullSafe(F.col("d_value"))
    return entries.join(done, same, "left_anti")
