"""All queries of the catalogue engine and their SQL. Dates are given as text, alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.plans import deciding, identity, indexing, parsing, placing, reading, searching, summing, syncing, updating

DATES = {
    "film_view": ("last_viewing",), "viewing_stats": ("last_viewing",), "latest_rating": ("rented_on",), "currency_departed": ("first_seen", "last_seen"), "arrivals_30d": ("appeared_on",),
    "batch_arrivals": ("appeared_on",), "batch_listings": ("first_seen", "last_seen"), "carry_forward": ("last_seen",), "merged_listings": ("first_seen", "last_seen"),
}


def _as_text(run: Callable[[SparkSession, str], DataFrame], columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in columns})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _part in (reading, syncing, searching, identity, deciding, parsing, placing, summing, updating, indexing):
    for _name, _run in _part.QUERIES.items():
        QUERIES[_name] = _as_text(_run, DATES[_name]) if _name in DATES else _run
    for _name, _sql in _part.SQL.items():
        _casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DATES.get(_name, ()))
        SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({_sql})" if _casts else _sql
