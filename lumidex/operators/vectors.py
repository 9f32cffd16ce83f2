"""Vectors: exact nearest neighbours and hybrid ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType

#: How many neighbours count, from what distance on none does, and what closeness adds to a score.
NEAREST, CEILING, BONUS = 10, 0.8, 5.0
#: Vectors that are measured against a block of queries at once.
STEP = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


@pandas_udf(BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian floats of 32 bits, one after the other."""
    return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")


@pandas_udf(ArrayType(FloatType()))
def unpacked(blobs: pd.Series) -> pd.Series:
    """The vectors of packed blobs."""
    return blobs.map(lambda b: np.frombuffer(b, "<f4"), na_action="ignore")


def of_length(blob: Column, dim: int) -> Column:
    """A packed vector, if it is of dim numbers; else an error."""
    return F.when(F.octet_length(blob) == 4 * dim, blob).otherwise(F.raise_error(F.lit(f"a vector is not of {dim} numbers")).cast("binary"))


def distances(vectors: DataFrame, query: list[float], key: str = "film_id", column: str = "vector") -> DataFrame:
    """(key, distance) of all vectors to one: 1 minus the product."""
    return vectors.select(key, (1 - dot(F.col(column), F.array(*[F.lit(float(x)) for x in query]))).alias("distance"))


def nearest(vectors: DataFrame, query: list[float], k: int = NEAREST, ceiling: float = CEILING, key: str = "film_id", column: str = "vector") -> DataFrame:
    """The k vectors nearest to query, within ceiling; a partition sends its own k only."""
    return distances(vectors, query, key, column).where(F.col("distance") <= ceiling).orderBy("distance", key).limit(k)


def nearest_in(frames: Iterator[pd.DataFrame], names: list, q: np.ndarray, k: int, key: str, column: str) -> Iterator[pd.DataFrame]:
    """(query_id, key, distance): of the vectors of frames the k nearest to each of q; STEP of them are measured at once, whatever the size of a frame."""
    keys, dist = None, np.empty((len(names), 0))
    for pdf in frames:
        for at in range(0, len(pdf), STEP):
            part = pdf.iloc[at : at + STEP]
            d = 1 - q @ np.array(part[column].tolist(), np.float64).T
            own = np.broadcast_to(part[key].to_numpy(), d.shape)
            keys, dist = own if keys is None else np.concatenate([keys, own], axis=1), np.concatenate([dist, d], axis=1)
            order = np.lexsort((keys, dist), axis=1)[:, :k]
            keys, dist = np.take_along_axis(keys, order, 1), np.take_along_axis(dist, order, 1)
    if keys is not None:
        yield pd.DataFrame({"query_id": np.repeat(names, keys.shape[1]), key: keys.ravel(), "distance": dist.ravel()})


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, key: str = "vec_id", column: str = "embedding", block: int = 2000) -> DataFrame:
    """(query_id, key, distance, place): the k nearest of all vectors for each of queries (query_id, vector).

    Queries come to the tasks in blocks of a fixed size; each task multiplies its vectors
    with a block and keeps k rows a query, so what is shuffled is k rows for each query
    and task. More queries mean more blocks, never a larger one.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    parts = []

    def add(rows: list) -> None:
        ids = [r["query_id"] for r in rows]
        shipped = spark.sparkContext.broadcast((ids, np.array([r["vector"] for r in rows], np.float64)))

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return nearest_in(frames, *shipped.value, k, key, column)

        parts.append(vectors.select(key, column).mapInPandas(scan, f"query_id long, {key} {kind}, distance double"))

    rows: list = []
    for r in queries.select("query_id", "vector").toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            add(rows)
            rows = []
    if rows or not parts:
        add(rows) if rows else parts.append(vectors.select(F.lit(None).cast("long").alias("query_id"), key, F.lit(0.0).alias("distance")).limit(0))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", key))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("i", "x")).select("query_id", f"x.{key}", "x.distance", (F.col("i") + 1).alias("place"))


def hybrid(word_hits: DataFrame, near: DataFrame, title_hits: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(film_id, score, stage): word hits with a bonus for closeness, then those that only meaning found, by distance.

    Meaning adds none if a word hit is among title_hits, and only what is in allowed, if given.
    """
    n = near.select(F.col("film_id").alias("n_film"), "distance")
    hits = word_hits.join(n, F.col("film_id") == F.col("n_film"), "left").select("film_id", (F.col("score") + F.coalesce(BONUS * (1 - F.col("distance")), F.lit(0.0))).alias("score"), F.lit(0).alias("stage"))
    only = near.join(word_hits.select("film_id"), "film_id", "left_anti").select("film_id", (-F.col("distance")).alias("score"), F.lit(1).alias("stage"))
    if allowed is not None:
        only = only.join(allowed.select("film_id"), "film_id", "left_semi")
    if title_hits is not None and not word_hits.join(title_hits, "film_id", "left_semi").isEmpty():
        only = only.limit(0)
    return hits.unionByName(only).orderBy("stage", F.desc("score"), "film_id")


def stamp(embeddings: DataFrame, model: str) -> DataFrame:
    """One row that changes when the vectors of a model do."""
    return embeddings.where(F.col("model") == model).agg(F.count("*").alias("n"), F.max("embedded_on").alias("latest"), F.sum("film_id").alias("ids"))
