"""Structured Streaming: availability as a stream of sightings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from lumidex.operators.currency import arrivals, seen_again


def sync_batch(current: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings after, transitions) of one micro-batch (film_id, source, url, seen); the frontier is read before the batch counts."""
    return seen_again(current, batch), arrivals(batch, current)


LISTINGS = "film_id long, source string, url string, first_seen date, last_seen date"


def writer(path: str, keep: int = 2):
    """A foreachBatch function that keeps listings under path, a folder a batch, and appends transitions.

    A batch's folder is written under its id and overwritten if the batch runs again, and
    readers take the folder of the last finished batch, so a lost driver repeats nothing.
    Folders of listings are partitioned by source, and sources that a batch does not tell
    about are not rewritten: they stay where they are, named in the new folder's map. Of
    older folders those that no map of the last keep batches names are deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, at = _files(spark, path)
        known = _where(spark, path, batch_id - 1) if batch_id else {}
        one = batch.groupBy("film_id", "source").agg(F.max_by("url", "seen").alias("url"), F.max("seen").alias("seen")).persist()
        told = sorted(r["source"] for r in one.select("source").distinct().collect())  # sources are a few hundred
        current = _held(spark, path, {s: known[s] for s in told if s in known})
        after, moved = sync_batch(current, one)
        # the first reading of a source is its baseline, not news
        moved.where(F.col("source").isin([s for s in told if s in known])).write.mode("overwrite").parquet(f"{path}/transitions/{batch_id}")
        after.write.mode("overwrite").partitionBy("source").parquet(f"{path}/listings/{batch_id}")
        one.unpersist()
        now = known | {s: batch_id for s in told}
        spark.createDataFrame(sorted(now.items()) or [("", -1)], "source string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/maps/{batch_id}")
        needed = {b for k in range(keep) if batch_id >= k for b in _where(spark, path, batch_id - k).values()}
        for status in fs.listStatus(at(f"{path}/listings")):
            name = status.getPath().getName()
            if name.isdigit() and int(name) <= batch_id and int(name) not in needed:
                fs.delete(status.getPath(), True)

    return write


def _files(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _where(spark, path: str, batch_id: int) -> dict[str, int]:
    """By source the batch whose folder holds its listings."""
    return {r["source"]: r["batch"] for r in spark.read.parquet(f"{path}/maps/{batch_id}").collect() if r["batch"] >= 0}


def _held(spark, path: str, where: dict[str, int]) -> DataFrame:
    """The listings of sources in the folders of their batches; Spark prunes the other sources' partitions."""
    rows = spark.createDataFrame([], LISTINGS)
    for batch in sorted(set(where.values())):
        own = [s for s, b in where.items() if b == batch]
        rows = rows.unionByName(spark.read.schema(LISTINGS).parquet(f"{path}/listings/{batch}").where(F.col("source").isin(own)))
    return rows


def listings(spark, path: str, batch_id: int) -> DataFrame:
    """The listings as they stood after a batch."""
    return _held(spark, path, _where(spark, path, batch_id))


STATE = "last_seen timestamp"
EVENT = "film_id long, source string, seen timestamp, kind string"


def reappearances(sightings: DataFrame, gap: str = "30 days", delay: str = "1 day") -> DataFrame:
    """film_id, source, seen, kind of a stream of sightings: return after more than gap, kept as state per title and source.

    The first sighting is a baseline and no event. State is one time a key and stays, as a
    title may return however late: it grows with the listings, not with the sightings.
    """
    wait = pd.Timedelta(gap)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        for seen in sorted(t for pdf in frames for t in pdf["seen"]):
            if last is not None and seen - last > wait:
                out.append((*key, seen, "return"))
            last = seen if last is None else max(last, seen)
        state.update((last.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["film_id", "source", "seen", "kind"])

    return sightings.withWatermark("seen", delay).groupBy("film_id", "source").applyInPandasWithState(step, EVENT, STATE, "append", "NoTimeout")


def activity(events: DataFrame, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts by event type in windows of event time; late rows count up to delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("from_ts"), "event_type", "n", "total")


def sessions(heartbeats: DataFrame, gap: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """Runs of heartbeats of a user that are less than gap apart."""
    return heartbeats.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("from_ts"), F.col("session_window.end").alias("to_ts"), "n")
