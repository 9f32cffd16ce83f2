"""A refresh of provider listings that stops when lookups keep failing.

Passes are made one after the other (a watchlist's, first checks, the week's), each over its
worklist in order. MAX_FAILURES lookups that fail in a row, or one that is refused, end the
whole refresh before the next lookup: what is left stays as it was, for the next run. A
failed lookup is no departure, so its listings are carried forward. A record that is gone is
an answer; an id that is no number is passed over and neither counts as failure nor ends a run
of them. The stamp of the weekly pass moves only if it came to its end.

Scale: runs of failures are found without a window over the whole order. Lookups get their
rank by counts within blocks of the order and sums of the blocks before; a failure of rank r
is counted at r to r + 4, and where five meet a run is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: failures in a row that end a refresh.
MAX_FAILURES = 5
#: Places of the order that are ranked together.
BLOCK = 100_000


def refresh_outcomes(lookups: DataFrame, most: int = MAX_FAILURES) -> DataFrame:
    """(pass, pos, film_id, state) of lookups (pass, pos, film_id, outcome), outcome being answered, gone, failed, refused or invalid.

    state: refreshed, carried (failed, so listings are kept), skipped (no usable id) or
    stopped (not looked up). pos counts from 1 without gaps in each pass; passes are numbered
    in their order.
    """
    real = lookups.where("outcome <> 'invalid'").withColumn("block", F.floor(F.col("pos") / BLOCK))
    sizes = real.groupBy("pass", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("pass").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK lookups
    starts = sizes.select(F.col("pass").alias("s_pass"), F.col("block").alias("s_block"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("pass", "block").orderBy("pos"))
    ranked = real.withColumn("own", own).join(starts, (F.col("pass") == F.col("s_pass")) & (F.col("block") == F.col("s_block")))
    ranked = ranked.select("pass", "pos", "outcome", (F.col("before") + F.col("own")).alias("rank"))
    failed = ranked.where("outcome = 'failed'")
    met = failed.select("pass", F.explode(F.sequence(F.col("rank"), F.col("rank") + most - 1)).alias("at")).groupBy("pass", "at").count().where(F.col("count") == most)
    full = met.groupBy("pass").agg(F.min("at").alias("at"))
    ends = failed.join(full.select(F.col("pass").alias("f_pass"), "at"), (F.col("pass") == F.col("f_pass")) & (F.col("rank") == F.col("at"))).select("pass", (F.col("pos") + 1).alias("stop"))
    refused = lookups.where("outcome = 'refused'").groupBy("pass").agg(F.min("pos").alias("stop"))
    # the run ends at a place only if something stands there
    last = lookups.groupBy("pass").agg(F.max("pos").alias("last"))
    stops = ends.unionByName(refused).groupBy("pass").agg(F.min("stop").alias("stop")).join(last, "pass").where("stop <= last")
    first = stops.agg(F.min(F.struct("pass", "stop")).alias("e")).select(F.col("e.pass").alias("e_pass"), F.col("e.stop").alias("e_stop"))  # one row
    rows = lookups.join(F.broadcast(first))
    over = F.coalesce((F.col("pass") > F.col("e_pass")) | ((F.col("pass") == F.col("e_pass")) & (F.col("pos") >= F.col("e_stop"))), F.lit(False))
    state = F.when(over, "stopped").when(F.col("outcome") == "invalid", "skipped").when(F.col("outcome") == "failed", "carried").otherwise("refreshed")
    return rows.select("pass", "pos", "film_id", state.alias("state"))


def weekly_stamp(outcomes: DataFrame, weekly_pass: int, stamp, today) -> DataFrame:
    """(stamp): today if the weekly pass was made and nothing of it was stopped, else what it was; an earlier pass that stops takes the weekly one with it."""
    day = F.lit(stamp).cast("date")
    done = (F.count_if(F.col("pass") == weekly_pass) > 0) & (F.count_if(F.col("state") == "stopped") == 0)
    return outcomes.agg(F.when(done, F.lit(today).cast("date")).otherwise(day).alias("stamp"))
