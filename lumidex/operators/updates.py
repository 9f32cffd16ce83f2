"""Writes of single tables of the catalogue, each by its own rule of what stays and what goes.

As in writes, each returns the table as it is after the write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.expressions import service_slug
from lumidex.operators.writes import insert_missing, replace_where, upsert

#: Columns that a later step fills and a fetch of facts leaves as they are.
FACTS_KEPT = ("overview", "tagline", "genres", "credits_fetched_on")
LINK = ("film_id", "linked_by", "linked_on")


def leaving_by_key(listings: DataFrame, films: DataFrame, labels: DataFrame, source: str) -> DataFrame:
    """listings where a source's labels are those of labels (key, label), by the titles' natural keys, and no others."""
    said = films.select("film_id", "key").join(labels, "key").groupBy(F.col("film_id").alias("s_film")).agg(F.max("label").alias("label"))
    rows = listings.join(said, listings["film_id"] == F.col("s_film"), "left")
    return rows.withColumn("leaving_date", F.when(F.col("source") == source, F.col("label")).otherwise(F.col("leaving_date"))).select(*listings.columns)


def facts_fetched(facts: DataFrame, new: DataFrame) -> DataFrame:
    """tmdb_facts with new facts; texts and credits' days stay."""
    kept = tuple(c for c in FACTS_KEPT if c in facts.columns)
    missing = {c: F.lit(None).cast(facts.schema[c].dataType) for c in kept if c not in new.columns}
    return upsert(facts, new.withColumns(missing), ["film_id"], keep_old=kept)


def replaced_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new's keys replaced whole; of new's rows of one key any one."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.dropDuplicates(keys).select(*old.columns))


def providers_checked(tmdb: DataFrame, checked: DataFrame) -> DataFrame:
    """tmdb after provider lookups (film_id, day, payload): found, checked on that day; the day of the first lookup stays."""
    new = checked.select("film_id", F.lit(True).alias("found"), F.col("day").alias("looked_up"), F.col("day").alias("providers_checked_at"), "payload")
    return upsert(tmdb, new, ["film_id"], keep_old=("looked_up",))


def providers_registered(services: DataFrame, mapped: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(movie_service, service_provider) with what offers (provider_id, name) name and they lack.

    A service that is known is never changed, a new one is not subscribed; a name without a
    letter or digit is left out.
    """
    named = offers.select("provider_id", "name", service_slug(F.col("name")).alias("slug")).where("slug <> ''")
    unknown = named.join(mapped.select(F.col("tmdb_provider_id").alias("provider_id")), "provider_id", "left_anti")
    one = unknown.groupBy("slug").agg(F.min_by("name", F.struct("provider_id", "name")).alias("name"))
    blank = {c: F.lit(None).cast(services.schema[c].dataType) for c in services.columns if c not in ("slug", "name", "kind", "subscribed")}
    fresh = one.withColumns({"kind": F.lit("svod"), "subscribed": F.lit(False)} | blank)
    by_id = unknown.groupBy("provider_id").agg(F.min(F.struct("slug", "name")).alias("x")).select(F.col("provider_id").alias("tmdb_provider_id"), F.col("x.slug").alias("service_slug"), F.col("x.name").alias("label"))
    return insert_missing(services, fresh, ["slug"]), insert_missing(mapped, by_id, ["tmdb_provider_id"])


def ratings_set(ratings: DataFrame, changes: DataFrame, films: DataFrame) -> DataFrame:
    """my_ratings after changes (film_id, score, rated_at): a null score takes the rating away, an unknown title none."""
    known = changes.join(films.select("film_id"), "film_id", "left_semi")
    return upsert(ratings, known, ["film_id"]).where("score is not null")


def lists_registered(lists: DataFrame, new: DataFrame) -> DataFrame:
    """film_list with new lists; the trust in one stays, and is 1 at first."""
    return upsert(lists, new.withColumn("trust", F.lit(1).cast(lists.schema["trust"].dataType)), ["slug"], keep_old=("trust",))


def entries_imported(entries: DataFrame, new: DataFrame) -> DataFrame:
    """film_list_entry with a file's lines; which title a line is linked to stays."""
    return upsert(entries, new.withColumn("film_id", F.lit(None).cast("long")), ["list_slug", "rank"], keep_old=("film_id",))


def old_ratings_imported(ratings: DataFrame, new: DataFrame) -> DataFrame:
    """old_rating with a file's lines; links stay."""
    return upsert(ratings, new.withColumns({c: F.lit(None).cast(ratings.schema[c].dataType) for c in LINK}), ["source", "line"], keep_old=LINK)


def old_ratings_linked(ratings: DataFrame, links: DataFrame, today) -> DataFrame:
    """old_rating after links (source, line, film_id, linked_by): a null film takes the link away, with who made it and when."""
    new = links.select(F.col("source").alias("l_source"), F.col("line").alias("l_line"), F.col("film_id").alias("l_film"), F.col("linked_by").alias("l_by"))
    rows = ratings.join(new, (F.col("source") == F.col("l_source")) & (F.col("line") == F.col("l_line")), "left")
    told = F.col("l_source").isNotNull()
    changed = {
        "film_id": F.when(told, F.col("l_film")).otherwise(F.col("film_id")), "linked_by": F.when(told, F.when(F.col("l_film").isNotNull(), F.col("l_by"))).otherwise(F.col("linked_by")),
        "linked_on": F.when(told, F.when(F.col("l_film").isNotNull(), F.lit(today).cast("date"))).otherwise(F.col("linked_on")),
    }
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in ratings.columns])


def numbered_after(rows: DataFrame, old: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """rows with numbers that follow old's largest: places within partitions of equal first order columns, shifted by prefix sums."""
    last = F.broadcast(old.agg(F.coalesce(F.max(key), F.lit(0)).alias("last")))
    first, rest = order[0], order[1:] or order
    sizes = rows.groupBy(first).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(first)) - F.col("n")  # one row for each value of the first order column
    shifts = sizes.select(F.col(first).alias("s_first"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy(first).orderBy(*rest))
    joined = rows.withColumn("own", own).join(shifts, F.col(first).eqNullSafe(F.col("s_first"))).join(last)
    return joined.withColumn(key, F.col("last") + F.col("before") + F.col("own")).drop("own", "before", "s_first", "last")


def reviews_rebuilt(reviews: DataFrame, entries: DataFrame, authority: str, reason: str | None = None) -> DataFrame:
    """match_review where an authority's open rows, or those of one reason, are entries (film_id, value, reason, detail, created_at)."""
    replaced = (F.col("authority") == authority) & ~F.col("resolved") & (F.lit(True) if reason is None else F.col("reason") == reason)
    new = entries.withColumns({"authority": F.lit(authority), "resolved": F.lit(False)})
    return replace_where(reviews, replaced, numbered_after(new, reviews, ["reason", "film_id", "value"]))


def reviews_resolved(reviews: DataFrame, notes: DataFrame) -> DataFrame:
    """match_review after notes (id, note): those rows are resolved, with the note at the end of what they say."""
    rows = reviews.join(notes.select(F.col("id").alias("n_id"), "note"), F.col("id") == F.col("n_id"), "left")
    said = F.concat(F.coalesce("detail", F.lit("")), F.lit(" ["), F.col("note"), F.lit("]"))
    told = F.col("n_id").isNotNull()
    return rows.withColumns({"detail": F.when(told, said).otherwise(F.col("detail")), "resolved": F.col("resolved") | told}).select(*reviews.columns)


def reviews_promoted(reviews: DataFrame, promoted: DataFrame, reason: str) -> DataFrame:
    """match_review where open rows of promoted (id, detail) have another reason and detail, in place."""
    rows = reviews.join(promoted.select(F.col("id").alias("p_id"), F.col("detail").alias("p_detail")), F.col("id") == F.col("p_id"), "left")
    told = F.col("p_id").isNotNull() & ~F.col("resolved")
    return rows.withColumns({"reason": F.when(told, F.lit(reason)).otherwise(F.col("reason")), "detail": F.when(told, F.col("p_detail")).otherwise(F.col("detail"))}).select(*reviews.columns)


def tombstoned(gone: DataFrame, tables: dict[str, DataFrame], today) -> dict[str, DataFrame]:
    """The tables after titles (film_id, note) were hidden: they are disposed of, and leave revisits and the ranker; others are untouched.

    A title that was disposed of before is refused: it is merged, or hidden already.
    """
    fresh = gone.join(tables["film_disposition"].select("film_id"), "film_id", "left_anti")
    ids = fresh.select("film_id")
    row = fresh.select("film_id", F.lit("tombstoned").alias("kind"), F.lit(None).cast("long").alias("survivor_id"), "note", F.lit(today).cast("date").alias("created_at"))
    out = dict(tables) | {"film_disposition": tables["film_disposition"].unionByName(row)}
    for name in ("needs_revisit", "rank_placement", "rank_comparison", "rank_order", "rank_order_comparison", "rank_mark"):
        if name in tables:
            out[name] = tables[name].join(ids, "film_id", "left_anti").select(*tables[name].columns)
    return out


def retired_links(links: DataFrame, ids: DataFrame, authority: str) -> DataFrame:
    """ids without those of an authority that links (film_id, value) name exactly."""
    named = links.select("film_id", "value", F.lit(authority).alias("authority"))
    return ids.join(named, ["film_id", "authority", "value"], "left_anti").select(*ids.columns)


def compared(log: DataFrame, placements: DataFrame, steps: DataFrame, today) -> DataFrame:
    """rank_placement after a session's verdicts led to a place (session_id, film_id, action, tier): what is only asked about stays out, a place is replaced."""
    done = steps.where("action = 'place'").join(log.select("session_id", "film_id").distinct(), ["session_id", "film_id"], "left_semi")
    row = done.select("session_id", "film_id", "tier", F.lit("compared").alias("how"), F.lit(today).cast("date").alias("placed_on"))
    return replaced_by_key(placements, row, ["session_id", "film_id"])


def moved(placements: DataFrame, order: DataFrame, moves: DataFrame, today) -> tuple[DataFrame, DataFrame]:
    """(rank_placement, rank_order) after moves (session_id, film_id, tier): the title has the new tier, and leaves the order of the old one, which closes up."""
    row = moves.join(placements.select("session_id", "film_id"), ["session_id", "film_id"], "left_semi").select("session_id", "film_id", "tier", F.lit("moved").alias("how"), F.lit(today).cast("date").alias("placed_on"))
    target = row.select(F.col("session_id").alias("m_session"), F.col("film_id").alias("m_film"), F.col("tier").alias("m_tier"))
    left = order.join(target, (F.col("session_id") == F.col("m_session")) & (F.col("film_id") == F.col("m_film")), "left").where("m_tier is null or m_tier = tier").select(*order.columns)
    place = F.row_number().over(Window.partitionBy("session_id", "tier").orderBy("position", "film_id"))
    return replaced_by_key(placements, row, ["session_id", "film_id"]), left.withColumn("position", place)


def deferred(deferrals: DataFrame, passed: DataFrame) -> DataFrame:
    """rank_deferral after titles were passed (session_id, film_id, deferred_on): the later day counts."""
    return deferrals.unionByName(passed.select(*deferrals.columns)).groupBy("session_id", "film_id").agg(F.max("deferred_on").alias("deferred_on"))


def reranked(log: DataFrame, placements: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rank_comparison, rank_placement) without what titles (session_id, film_id) that are asked about anew had."""
    keys = ["session_id", "film_id"]
    return log.join(again.select(*keys), keys, "left_anti").select(*log.columns), placements.join(again.select(*keys), keys, "left_anti").select(*placements.columns)


def refusal(own_tt: Column, filed_tt: Column, same_director: Column) -> Column:
    """Why a store's product is not the title, or null: its filing under the title's id is proof, under another a refusal, and under none a director has to agree."""
    return F.when(filed_tt == own_tt, None).when(filed_tt.isNotNull(), "another imdb id").when(F.coalesce(same_director, F.lit(False)), None).otherwise("unverified")
