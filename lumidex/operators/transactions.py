"""Writes of several tables that are one change: a catalog walk, and merges of titles.

Each reads one state of a store, makes all its tables from that, and commits them together;
see commits.Tables for what a run that dies leaves, and for reruns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.operators import placement, writes
from lumidex.operators.commits import State, Tables
from lumidex.operators.updates import numbered_after

#: Notes of a store: the frontier before the first walk and that walk's day, which open the grace window; the day of the last walk.
RELAUNCH_FRONTIER, RELAUNCH_DAY, FETCHED = "relaunch_frontier", "relaunch_first_walk", "films_fetched_at"
WALK_SOURCE = "criterion"


def record_walk(tables: Tables, decided: DataFrame, items: DataFrame, created: DataFrame, reviews: DataFrame, labels: DataFrame | None, day: str, template: str, number: int | None = None) -> State:
    """A walk's whole write: new titles, ids, claims, listings, transitions, reviews and leaving labels, or none of them.

    decided (film_id, key, mediaid, title, year, bind): what each listed item was taken for;
    film_id is null for a title of created (key, title, year, director), which key names then.
    items (mediaid, pos): the order of the walk. labels: (mediaid, label), None if they could
    not be read. number: of the walk, if a rerun is to do nothing.
    """
    state = tables.state()
    films, listings, ids, claims = (tables.read(n, state) for n in ("films", "listings", "external_ids", "claims"))
    own = listings.where(F.col("source") == WALK_SOURCE)
    frontier = own.agg(F.max("last_seen").cast("string")).first()[0]  # one row
    notes = dict(state.notes)
    if frontier is not None:
        notes = {RELAUNCH_FRONTIER: frontier, RELAUNCH_DAY: day} | notes
    quiet = RELAUNCH_DAY in notes and tables.spark.range(1).select(placement.in_relaunch(F.lit(notes[RELAUNCH_DAY]).cast("date"), F.lit(day).cast("date"))).first()[0]

    taken = created.join(films.select("key"), "key", "left_semi")
    checked = created.join(taken.select(F.col("key").alias("t_key")), F.col("key") == F.col("t_key"), "left")
    sound = F.when(F.col("t_key").isNotNull(), F.raise_error(F.concat(F.lit("a key was taken during the walk: "), F.col("key")))).otherwise(F.col("key"))
    new = numbered_after(checked.select(sound.alias("key"), "title", "year", "director"), films, ["key"], "film_id")
    named = decided.join(new.select(F.col("key").alias("n_key"), F.col("film_id").alias("n_film")), F.col("film_id").isNull() & (F.col("key") == F.col("n_key")), "left")
    named = named.withColumn("film_id", F.coalesce("film_id", "n_film")).drop("n_key", "n_film")

    date = F.lit(day).cast("date")
    bound = named.where("bind").select("film_id", F.lit(WALK_SOURCE).alias("authority"), F.col("mediaid").alias("value"))
    ids_after = writes.insert_missing(ids, bound.select(*ids.columns), ["authority", "value"])
    said = named.select("film_id", F.lit(WALK_SOURCE).alias("authority"), F.col("mediaid").alias("value"), "title", "year", date.alias("made_on"))
    claims_after = writes.insert_missing(claims, said.select(*claims.columns), ["film_id", "authority", "value"])

    seen = named.select("film_id").distinct()
    arrived = placement.walk_arrivals(seen, listings, frontier, notes.get(RELAUNCH_FRONTIER) if quiet else None) if frontier is not None else seen.limit(0)
    moves = arrived.select("film_id", F.lit(WALK_SOURCE).alias("source"), date.alias("appeared_on"))
    walked = placement.walk_listings(own, named.select("mediaid", "film_id"), items, day, template).withColumn("source", F.lit(WALK_SOURCE))
    walked = walked.join(own.select("film_id", "leaving_date"), "film_id", "left")
    after = listings.where(F.col("source") != WALK_SOURCE).unionByName(walked.select(*listings.columns))
    after = placement.walk_leaving(after, ids_after, labels, day).select(*listings.columns)
    return tables.commit(
        {"films": films.unionByName(new.select(*films.columns)), "listings": after, "external_ids": ids_after, "claims": claims_after},
        {"transitions": moves, "reviews": reviews},
        based_on=state,
        writer=None if number is None else ("walk", number),
        notes=notes | {FETCHED: day},
    )


def merge_films(tables: Tables, merges: DataFrame, save, number: int | None = None) -> State:
    """merges (film_id, survivor_id), recorded and carried out: every table of the store with a title's rows, folded by its rule, in one change."""
    state = tables.state()
    kept = tables.read("dispositions", state)
    new = merges.select("film_id", F.lit("merged").alias("kind"), "survivor_id")
    dispositions = writes.upsert(kept, new.select(*kept.columns), ["film_id"])
    canon = writes.canonical(dispositions, save).persist()
    rules = {"listings", "viewing", *writes.UNIONS, *writes.SURVIVOR_WINS}
    folded = {}
    for name in sorted(rules & set(state.tables)):
        rows = writes.merged_rows(tables.read(name, state), name, canon)
        folded[name] = writes.close_gaps(rows) if name == "rank_order" else rows
    try:
        return tables.commit({"dispositions": dispositions, **folded}, based_on=state, writer=None if number is None else ("merges", number))
    finally:
        canon.unpersist()
