"""The wide view of a title: nested options, lists and arrivals, best source, canon score, chips, order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.expressions import NEW_DAYS, listing_weight, printed_rank
from lumidex.operators.currency import with_currency

STREAM = "criterion"


def first_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each group that is first in order: one aggregation, no join of the table with itself."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])


def source_order() -> list[Column]:
    """Subscribed first, then quality, a television app, the name."""
    app = F.coalesce("has_apple_app", F.lit(False))
    return [(~F.coalesce("subscribed", F.lit(False))).alias("unsubscribed"), (-F.coalesce("quality", F.lit(0))).alias("worse"), (~app).alias("no_app"), F.coalesce("name", F.lit("")).alias("label")]


def options(listings: DataFrame, services: DataFrame) -> DataFrame:
    """The current listings with their service's columns."""
    live = with_currency(listings).where("is_current").select("film_id", F.col("source").alias("slug"), F.col("url").alias("listing_url"))
    return live.join(services, "slug")


def best_source(listings: DataFrame, services: DataFrame, owned: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """(film_id, slug, name, subscribed, quality): the best streaming option; of owned titles the store they are from."""
    ranked = F.min(F.struct(*source_order(), "slug", "name", "subscribed", "quality")).alias("best")
    best = options(listings, services).where("kind = 'svod'").groupBy("film_id").agg(ranked).select("film_id", "best.slug", "best.name", "best.subscribed", "best.quality")
    if owned is None or store is None:
        return best
    row = services.where(F.col("slug") == store).select("slug", "name", "subscribed", "quality")
    have = owned.select("film_id").distinct()
    from_store = have.join(F.broadcast(row.limit(1)))
    return best.join(have, "film_id", "left_anti").unionByName(from_store) if not row.isEmpty() else best


def services_by_film(listings: DataFrame, services: DataFrame) -> DataFrame:
    """(film_id, services): all current options of a title, best first."""
    option = F.struct(*source_order(), "slug", "kind", F.col("listing_url").alias("url"))
    listed = options(listings, services).where(F.col("slug") != STREAM).groupBy("film_id").agg(F.array_sort(F.collect_list(option)).alias("ordered"))
    return listed.select("film_id", F.transform("ordered", lambda o: F.struct(o["slug"].alias("slug"), o["label"].alias("name"), o["kind"].alias("kind"), (~o["unsubscribed"]).alias("subscribed"))).alias("services"))


def with_list_size(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """Linked entries with their list's name, order, trust and size; the size counts unlinked lines too."""
    sizes = entries.groupBy("list_slug").agg(F.count("*").alias("size"))
    about = lists.select(F.col("slug").alias("list_slug"), "name", "ordered", "trust").join(sizes, "list_slug")
    return entries.where("film_id is not null").join(about, "list_slug")


def lists_by_film(entries: DataFrame, lists: DataFrame) -> DataFrame:
    on = F.struct((-F.col("trust")).alias("less"), "name", "rank", "list_slug", "rank_label")
    return with_list_size(entries, lists).groupBy("film_id").agg(F.array_sort(F.collect_list(on)).alias("lists"))


def canon_scores(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """(film_id, canon_score, n_lists)."""
    weight = listing_weight(F.col("ordered"), F.col("trust"), printed_rank(F.col("rank_label"), F.col("rank")), F.col("size"))
    return with_list_size(entries, lists).groupBy("film_id").agg(F.sum(weight).alias("canon_score"), F.count("*").alias("n_lists"))


def viewing_stats(viewings: DataFrame) -> DataFrame:
    return viewings.groupBy("film_id").agg(F.max("watched_on").alias("last_viewing"), F.count("*").alias("viewing_count"), F.max("study").alias("study"))


def latest_rating(old: DataFrame) -> DataFrame:
    """The latest old rating of a title; of one day's the later line."""
    when = F.struct(F.coalesce(F.col("rented_on").cast("string"), F.lit("")), "line")
    return old.where("film_id is not null").groupBy("film_id").agg(F.max_by(F.struct("stars", "rented_on"), when).alias("old_rating"))


def _on_mine() -> Column:
    return F.col("on_stream") | F.exists("services", lambda s: (s["kind"] == "svod") & s["subscribed"])


def chips(today) -> dict[str, Column]:
    """Predicates over the columns of film_view, by key; all are true or false, never null."""
    day = F.lit(today).cast("date")
    reachable = F.col("on_stream") | (F.size("services") > 0) | F.col("owned") | F.col("store_id").isNotNull()
    recent = F.exists("new_on", lambda n: (n["source"] == STREAM) & (n["appeared_on"] >= F.date_sub(day, NEW_DAYS)))
    found = {
        "reachable": reachable,
        "unreachable": ~reachable,
        "unrated": F.col("my_rating").isNull(),
        "mine": F.col("my_rating") >= 1,
        "criterion": F.col("on_stream"),
        "leaving": F.col("leaving_date").isNotNull(),
        "criterion_new": recent,
        "not_criterion": ~F.col("on_stream"),
        "watchlist": F.col("watchlisted"),
        "owned": F.col("owned"),
        "not_owned": ~F.col("owned"),
        "multi_list": F.col("n_lists") >= 1,
        "shop": ~F.col("owned") & F.col("my_rating").isNull() & ~_on_mine() & F.col("store_id").isNotNull() & ~F.col("wishlisted"),
        "watched": F.col("viewing_count") > 0,
        "study": F.col("study"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def matching(view: DataFrame, keys: list[str], today) -> DataFrame:
    """Rows of the view that all chips hold for; an unknown chip raises KeyError."""
    known = chips(today)
    return view.where(reduce(and_, [known[k] for k in keys], F.lit(True)))


def chip_counts(view: DataFrame, today) -> DataFrame:
    """(chip, n) for all chips, in one pass."""
    found = chips(today)
    counts = view.agg(*[F.count_if(v).alias(k) for k, v in found.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in found]), F.array(*found))).alias("chip", "n"))


def film_view(films: DataFrame, listings: DataFrame, services: DataFrame, *, ratings: DataFrame, owned: DataFrame, watchlist: DataFrame, entries: DataFrame, lists: DataFrame, transitions: DataFrame, viewings: DataFrame, store_ids: DataFrame, wishlist: DataFrame, dispositions: DataFrame, today) -> DataFrame:
    """One row per title that is not disposed of, with what chips and orders need.

    Each side is aggregated to a row per title before it joins, so no join fans out.
    """
    stream = with_currency(listings).where(F.col("source") == STREAM).groupBy("film_id").agg(F.max("is_current").alias("on_stream"), F.max("leaving_date").alias("leaving_date"))
    arrived = transitions.where(F.col("appeared_on") >= F.date_sub(F.lit(today).cast("date"), NEW_DAYS)).groupBy("film_id", "source").agg(F.max("appeared_on").alias("appeared_on"))
    arrived = arrived.groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("source", "appeared_on"))).alias("new_on"))
    flag = lambda df, name: df.select("film_id").distinct().withColumn(name, F.lit(True))
    view = films.join(dispositions.select("film_id"), "film_id", "left_anti")
    for side in (
        stream, services_by_film(listings, services), arrived, canon_scores(entries, lists), viewing_stats(viewings), ratings.select("film_id", F.col("score").alias("my_rating")),
        flag(owned, "owned"), flag(watchlist, "watchlisted"), flag(wishlist, "wishlisted"), store_ids.groupBy("film_id").agg(F.min("value").alias("store_id")),
    ):
        view = view.join(side, "film_id", "left")
    none = {
        "on_stream": F.lit(False), "owned": F.lit(False), "watchlisted": F.lit(False), "wishlisted": F.lit(False), "study": F.lit(False), "viewing_count": F.lit(0), "n_lists": F.lit(0),
        "services": F.array().cast(view.schema["services"].dataType), "new_on": F.array().cast(view.schema["new_on"].dataType),
    }
    return view.withColumns({k: F.coalesce(F.col(k), v) for k, v in none.items()})


def default_order() -> list[Column]:
    """Canon score, then scores, nulls last, then the title."""
    down = ("canon_score", "last_viewing", "metacritic", "rt", "imdb")
    return [*[F.col(c).desc_nulls_last() for c in down], F.lower("title").asc_nulls_last(), F.col("film_id").asc()]


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their place; only k rows of each partition travel."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def tie_labels(placed: DataFrame) -> DataFrame:
    """Lines of tiered lists from (session_id, tier, film_id, title, position): ordered titles first, then the others by title.

    Line numbers run over a session's tiers; unordered titles of a tier share a label =N of
    their first line if they are two or more. Tiers are counted first, so that each is
    numbered by itself.
    """
    key = [F.col("position").asc_nulls_last(), F.lower("title"), F.col("film_id")]
    tier = Window.partitionBy("session_id", "tier")
    sizes = placed.groupBy("session_id", "tier").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("session_id").orderBy("tier")) - F.col("n")
    before = sizes.select("session_id", "tier", before.alias("before"))
    numbered = placed.join(before, ["session_id", "tier"]).withColumn("line", F.col("before") + F.row_number().over(tier.orderBy(*key)))
    loose = F.col("position").isNull()
    numbered = numbered.withColumns({"n_loose": F.count_if(loose).over(tier), "first_loose": F.min(F.when(loose, F.col("line"))).over(tier)})
    label = F.when(loose & (F.col("n_loose") > 1), F.concat(F.lit("="), F.col("first_loose").cast("string")))
    return numbered.select("session_id", "line", "tier", "film_id", "title", label.alias("rank_label"))


def save_tiered_list(entries: DataFrame, placed: DataFrame, session_id, slug: str) -> DataFrame:
    """entries (list_slug, rank, film_id, title_listed, rank_label) with a session's tiers (as for tie_labels) as the lines of slug, in place of those it had."""
    lines = tie_labels(placed.where(F.col("session_id") == session_id))
    new = lines.select(F.lit(slug).alias("list_slug"), F.col("line").cast("long").alias("rank"), "film_id", F.col("title").alias("title_listed"), "rank_label")
    return entries.where(F.col("list_slug") != slug).unionByName(new.select(*entries.columns))
