"""State with timers, embedding jobs and the index of vectors."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from lumidex.operators import embedding, vectors
from lumidex.operators.commits import Tables
from lumidex.streaming.availability import availability

DAY = dt.date(2026, 11, 1)
SIGHTINGS = "film_id long, source string, seen timestamp, before timestamp"


def at(day):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day)


def plain_arrivals(readings, relaunches):
    """Of readings (source, day, films) in order: (film, source, kind, day) as comparing each with the reading before gives it."""
    last, before, out = {}, {}, []
    for source, day, films in readings:
        for f in films:
            seen = last.get((f, source))
            if source in before and (seen is None or seen < before[source]):
                frontier, first, days = relaunches.get(source, (None, 0, 0))
                out.append((f, source, "quiet" if seen is not None and seen == frontier and day <= first + days else "arrived", at(day)))
            last[f, source] = day
        before[source] = day
    return sorted(out)


def test_availability_with_timers(spark, tmp_path):
    """The events that comparing readings gives; departures once time has passed; state that ends."""
    rng = random.Random(5)
    relaunches = {"b": (4, 9, 30)}
    readings = [(s, d, [f for f in range(8) if rng.random() < 0.6]) for d in (0, 2, 4, 9, 12) for s in "ab"]
    before: dict = {}
    for n, (source, day, films) in enumerate(readings):
        rows = [(f, source, at(day), before.get(source)) for f in films]
        before[source] = at(day)
        spark.createDataFrame(rows, SIGHTINGS).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    for n in range(15):  # time goes on, a step with each five files
        spark.createDataFrame([(99, "c", at((100, 900, 901)[n // 5]), None)], SIGHTINGS).coalesce(1).write.parquet(f"{tmp_path}/in/{n + 100}")
    stream = spark.readStream.schema(SIGHTINGS).option("maxFilesPerTrigger", 5).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    found = availability(stream, "20 days", "400 days", relaunches={k: (at(f), at(d), n) for k, (f, d, n) in relaunches.items()})
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        query = found.writeStream.format("memory").queryName("availability").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    rows = [tuple(r) for r in spark.table("availability").where("film_id < 99").collect()]
    assert sorted(r for r in rows if r[2] != "departed") == plain_arrivals(readings, relaunches)
    last = {(f, s): d for s, d, films in readings for f in films}
    assert sorted(r for r in rows if r[2] == "departed") == sorted((f, s, "departed", at(d)) for (f, s), d in last.items())
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(sizes) >= len(last) and sizes[-1] < len(last) / 2


def texts(spark, rows):
    return spark.createDataFrame(rows, "film_id long, overview string, plot string, tagline string")


class Broken(embedding.ConceptEmbedder):
    """Fails on one text."""

    def encode(self, found):
        if any("poison" in t for t in found):
            raise ValueError("model went away")
        return super().encode(found)


def test_embedding_goes_on_where_it_was(spark, tmp_path):
    tables = Tables(spark, f"{tmp_path}/s")
    rows = [(i, f"word{i} nurse", None, None) for i in range(20)] + [(50, "", None, "  "), (51, "poison", None, None)]
    with pytest.raises(Exception, match="model went away"):
        embedding.embed(tables, texts(spark, rows), Broken, "m", 768, DAY, slices=4)
    before = {r["film_id"] for r in tables.read("film_embedding").collect()}
    n = embedding.embed(tables, texts(spark, rows), embedding.ConceptEmbedder, "m", 768, DAY, slices=4)
    done = tables.read("film_embedding").collect()
    assert {r["film_id"] for r in done} == {*range(20), 51} and n == 21 - len(before) and len(done) == 21
    want = embedding.ConceptEmbedder().encode(["word3 nurse"])[0]
    got = np.frombuffer(next(r["vector"] for r in done if r["film_id"] == 3), "<f4")
    assert np.allclose(got, want, atol=1e-7) and got[1] > 0.5
    assert embedding.embed(tables, texts(spark, rows), embedding.ConceptEmbedder, "m", 768, DAY) == 0
    changed = [(3, "another text", None, None), *rows[4:]]
    assert embedding.embed(tables, texts(spark, changed), embedding.ConceptEmbedder, "m", 768, DAY + dt.timedelta(1)) == 1
    assert embedding.current(tables.read("film_embedding"), "m").count() == 21


def test_concepts_share_a_dimension():
    model = embedding.ConceptEmbedder()
    a, b, c, none = model.encode(["A private eye.", "the gumshoe", "of a nurse", "the of"])
    assert a @ b == pytest.approx(1) and a @ c == 0 and not none.any() and np.linalg.norm(a) == pytest.approx(1)


def test_index_of_vectors_writes_changed_blocks_only(spark, tmp_path):
    rng = np.random.default_rng(3)
    held = {i: rng.normal(size=8) for i in range(60)}

    def frame():
        rows = [(i, np.asarray(v, "<f4").tobytes()) for i, v in held.items()]
        return spark.createDataFrame(rows, "film_id long, vector binary")

    index = embedding.VectorIndex(Tables(spark, f"{tmp_path}/v"), 8, blocks=6)
    assert len(index.refresh(frame())) == 6 and index.refresh(frame()) == []
    query = rng.normal(size=8)
    query /= np.linalg.norm(query)

    def check():
        unit = spark.createDataFrame([(i, (np.asarray(v, "<f4").astype(float) / np.linalg.norm(np.asarray(v, "<f4").astype(float))).tolist()) for i, v in held.items()], "film_id long, vector array<double>")
        want = [(r["film_id"], round(r["distance"], 9)) for r in vectors.nearest(unit, query.tolist(), 7, 1.5).collect()]
        assert [(r["film_id"], round(r["distance"], 9)) for r in index.nearest(query, 7, 1.5).collect()] == want

    check()
    held[5] = rng.normal(size=8)
    assert len(index.refresh(frame())) == 1
    check()
    del held[9]
    held[77] = rng.normal(size=8)
    assert 1 <= len(index.refresh(frame())) <= 2
    index.compact()
    check()
    assert index.tables.read("blocks").count() == 6 and index.nearest(query, 7, -1.0).isEmpty()
