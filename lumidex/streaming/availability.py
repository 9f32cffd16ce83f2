"""Availability as state with timers: arrivals, quiet returns, departures and their end, from a stream of sightings.

A sighting says that a title was seen with a source by a reading, and when the reading before
that one was made, as every reading of a source knows; so a key needs nothing of other keys. A
title's state is when it was seen last. Seen by a reading whose predecessor it was seen by, or
which no reading preceded (a baseline), it is no news; else it has arrived. In the days after a
source is relaunched, what was last seen by the old source's last reading comes back quietly.
A timer of event time tells that a title has departed once the watermark has passed its last
sighting by more than the longest time between readings, and a second one, later, drops its
state; so state holds the titles of the last `forget` and no more. A title that comes back
after that is new, which is an arrival as well.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "film_id long, source string, kind string, at timestamp"
STATE = "last_seen timestamp, told boolean"
#: The state store that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Availability(StatefulProcessor):
    """State and timers of one title and source."""

    def __init__(self, gap: dt.timedelta, forget: dt.timedelta, relaunches: dict[str, tuple[dt.datetime, dt.datetime, int]]) -> None:
        self.gap, self.forget, self.relaunches = gap, forget, relaunches

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", STATE)

    def _timer(self, at: dt.datetime | None) -> None:
        """One timer, at at, in place of any other."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(int(pd.Timestamp(at).tz_localize("UTC").timestamp() * 1000))

    def _quiet(self, source: str, last: dt.datetime, seen: dt.datetime) -> bool:
        """Whether a return is none, as the source was relaunched: it was there to the end of the old one, and the new one is young."""
        if source not in self.relaunches:
            return False
        frontier, first, days = self.relaunches[source]
        return last == frontier and seen <= first + dt.timedelta(days=days)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        film, source = key
        last = self.seen.get()[0] if self.seen.exists() else None
        out = []
        sightings = sorted(((r.seen.to_pydatetime(), None if pd.isna(r.before) else r.before.to_pydatetime()) for pdf in rows for r in pdf.itertuples(index=False)), key=lambda x: x[0])
        for seen, before in sightings:
            if last is not None and seen <= last:
                continue  # told before, or late
            if before is not None and (last is None or last < before):
                out.append((film, source, "quiet" if last is not None and self._quiet(source, last, seen) else "arrived", seen))
            last = seen
        if last is not None:
            self.seen.update((last, False))
            self._timer(last + self.gap)
        yield pd.DataFrame(out, columns=["film_id", "source", "kind", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        film, source = key
        out = []
        if self.seen.exists():
            last, told = self.seen.get()
            if told:
                self.seen.clear()
                self._timer(None)
            else:
                out.append((film, source, "departed", last))
                self.seen.update((last, True))
                self._timer(last + self.gap + self.forget)
        yield pd.DataFrame(out, columns=["film_id", "source", "kind", "at"])

    def close(self) -> None:
        pass


def availability(sightings: DataFrame, gap: str = "10 days", forget: str = "400 days", delay: str = "1 day", relaunches: dict[str, tuple[dt.datetime, dt.datetime, int]] | None = None) -> DataFrame:
    """(film_id, source, kind, at) of a stream of sightings (film_id, source, seen, before): arrived, quiet or departed.

    before: when the source was read before, null at its first reading. at: when a title was
    seen, of a departure when it was seen last. gap: the longest time between two readings of a
    source. relaunches: by source the last reading of the old one, the first of the new one,
    and for how many days returns are quiet. Times are in UTC.
    """
    spark = sightings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    processor = Availability(pd.Timedelta(gap).to_pytimedelta(), pd.Timedelta(forget).to_pytimedelta(), relaunches or {})
    keyed = sightings.withWatermark("seen", delay).groupBy("film_id", "source")
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
