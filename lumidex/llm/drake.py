"""Centroid clustering of whole-number vectors with adaptive distance bounds (operator 11).

Lloyd's rounds give exact centroids: the floor of the mean of whole numbers. What a round
saves is distances. A vector's state has its centroid, an upper bound on the distance to
it, the next nearest centroids with a lower bound each, and one lower bound, the remainder,
on all other centroids. When centroids move, the bounds move by at most as much. Where the
upper bound is below all lower bounds, the centroid stays. Else the distance to it is
measured; then the shortest head of the near list is found below whose tail and remainder
the upper bound lies, and only that head is measured and sorted anew; where even the
remainder is not above it, all centroids are measured. A bound certifies only if it is
strictly smaller after a margin for rounding, so ties are always measured, in exact whole
numbers, and go to the smaller number. After each round the near list shrinks to the
longest head that any vector needed, but not below an eighth of the centroids; what it
drops joins the remainder.

Scale: a round is one pass over the state, narrow, without a shuffle of vectors: a task
writes its vectors' new state and, for each centroid, one row with their count and sum.
Those rows are summed by Spark, so the driver gets one number for each centroid and
component. States are tables in the shared folder, the last one deleted when the next is
written; a lost executor costs a task. Memory is that of a batch. A hot value or group does
not exist: no row depends on another but by the sums.

Defined results: vectors that are null, of another length or hold a null or non-finite
component take no part, and have no row; repeated rows are clustered each; a null vec_id is
hashed as nothing and else an ordinary row; equal hashes (a repeated vec_id) start in the
order of their components; fewer vectors than centroids: each is one; no vectors: no rows.
Extra columns do not matter. Components beyond LARGEST after scaling are refused with an
error, as squared distances would not fit the column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm.common import forget, saved, table

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components up to here have squared distances that fit 64 bits, and up to EXACT ones that are exact in a double.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Far more than the rounding of a square root and a sum, relative to them.
MARGIN = 1e-12

STATE = "vec_id {kind}, v binary, cluster int, near binary, bounds binary, distance long, n long, sums array<long>, depth int"


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors (n, d) to centroids (k, d), as int64."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)  # all terms are whole numbers below 2**53
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1).reshape(len(vectors), len(centroids))


def squared_to(vectors: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to its own row of centroid numbers (n, z)."""
    out = np.empty(which.shape, np.int64)
    for j in range(which.shape[1]):
        out[:, j] = ((vectors - centroids[which[:, j]]) ** 2).sum(1)
    return out


def above(x: np.ndarray) -> np.ndarray:
    return x * (1 + MARGIN)


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - MARGIN), 0)


class Bounds:
    """Clusters and bounds of a batch: cluster (n,), near (n, b), upper (n,), lower (n, b), rest (n,)."""

    def __init__(self, cluster, near, upper, lower, rest):
        self.cluster, self.near, self.upper, self.lower, self.rest = cluster, near, upper, lower, rest

    @classmethod
    def measured(cls, vectors: np.ndarray, centroids: np.ndarray, width: int) -> Bounds:
        """From all distances."""
        d = squared(vectors, centroids)
        order = np.argsort(d, axis=1, kind="stable")
        far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        rest = below(far[:, width + 1]) if d.shape[1] > width + 1 else np.full(len(d), np.inf)
        return cls(order[:, 0].astype(np.int32), order[:, 1 : width + 1].astype(np.int32), above(far[:, 0]), below(far[:, 1 : width + 1]), rest)

    def narrowed(self, width: int) -> None:
        """A near list of width at most; what it loses joins the remainder."""
        if self.near.shape[1] > width:
            self.rest = np.minimum(self.rest, self.lower[:, width:].min(1))
            self.near, self.lower = self.near[:, :width].copy(), self.lower[:, :width].copy()

    def drifted(self, drift: np.ndarray) -> None:
        """Centroids have moved by at most drift."""
        self.upper = above(self.upper + drift[self.cluster])
        self.lower = below(self.lower - drift[self.near])
        self.rest = below(self.rest - drift.max(initial=0))

    def _floors(self, rows: np.ndarray) -> np.ndarray:
        """(n, b + 1): at z the least of the bounds from z on and the remainder."""
        return np.minimum.accumulate(np.column_stack([self.lower[rows], self.rest[rows]])[:, ::-1], axis=1)[:, ::-1]

    def reassign(self, vectors: np.ndarray, centroids: np.ndarray) -> int:
        """Clusters nearest to the moved centroids; the longest head of a near list that had to be measured."""
        rows = np.flatnonzero(~(self.upper < self._floors(np.arange(len(vectors)))[:, 0]))
        if not len(rows):
            return 0
        own = squared_to(vectors[rows], centroids, self.cluster[rows][:, None])[:, 0]
        self.upper[rows] = above(np.sqrt(own.astype(np.float64)))
        certified = self.upper[rows][:, None] < self._floors(rows)
        width = self.near.shape[1]
        head = np.where(certified.any(1), certified.argmax(1), width + 1)
        deepest = 0
        for z in range(1, width + 1):
            at = rows[head == z]
            if len(at):
                deepest = z
                who = np.column_stack([self.cluster[at], self.near[at, :z]])
                d = squared_to(vectors[at], centroids, who)
                order = np.lexsort((who, d), axis=1)
                who, far = np.take_along_axis(who, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
                self.cluster[at], self.near[at, :z] = who[:, 0], who[:, 1:]
                self.upper[at], self.lower[at, :z] = above(far[:, 0]), below(far[:, 1:])
        at = rows[head == width + 1]
        if len(at):
            deepest = width + 1
            new = Bounds.measured(vectors[at], centroids, width)
            self.cluster[at], self.near[at], self.upper[at], self.lower[at], self.rest[at] = new.cluster, new.near, new.upper, new.lower, new.rest
        return deepest


def scaled(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): whole-number vectors of the rows that have exactly that many finite components."""
    x = F.col("x")
    sound = (F.size(x) == dimensions) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale))
    fits = F.forall(x, lambda c: F.abs(c * scale) <= LARGEST)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).cast("array<double>").alias("x")).where(sound)
    return rows.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order: k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in rows.select("x", key.alias("key")).orderBy("key", "x").limit(k).collect()], np.int64)


def _pass(source: DataFrame, kind: str, centroids: np.ndarray, drift: np.ndarray | None, width: int, final: bool) -> DataFrame:
    """source (whole-number vectors, or a state where drift is given) with its new state, and a row of sums for each task and cluster."""
    k, d = centroids.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, depth = np.zeros(k, np.int64), np.zeros((k, d), np.int64), 0
        inertia = np.zeros(k, object)
        for pdf in frames:
            if not len(pdf):
                continue
            if drift is None:
                v = np.array(pdf["x"].tolist(), np.int64)
                b = Bounds.measured(v, centroids, width)
                blobs = [r.tobytes() for r in v.astype("<i4")]
            else:
                blobs = pdf["v"].tolist()
                v = np.frombuffer(b"".join(blobs), "<i4").reshape(-1, d).astype(np.int64)
                near = np.frombuffer(b"".join(pdf["near"]), "<i4").reshape(len(v), -1).copy()
                bounds = np.frombuffer(b"".join(pdf["bounds"]), "<f8").reshape(len(v), -1).copy()
                b = Bounds(pdf["cluster"].to_numpy(np.int32).copy(), near, bounds[:, 0].copy(), bounds[:, 1:-1].copy(), bounds[:, -1].copy())
                b.narrowed(width)
                b.drifted(drift)
                depth = max(depth, b.reassign(v, centroids))
            out = pd.DataFrame({"vec_id": pdf["vec_id"].array, "cluster": b.cluster})
            n += np.bincount(b.cluster, minlength=k)
            if final:
                out["v"] = out["near"] = out["bounds"] = None
                out["distance"] = squared_to(v, centroids, b.cluster[:, None])[:, 0]
                for c in np.unique(b.cluster):
                    inertia[c] += int(out["distance"][b.cluster == c].astype(object).sum())
            else:
                np.add.at(sums, b.cluster, v)
                out["v"], out["near"] = blobs, [r.tobytes() for r in b.near.astype("<i4")]
                out["bounds"] = [r.tobytes() for r in np.column_stack([b.upper, b.lower, b.rest]).astype("<f8")]
                out["distance"] = None
            out["n"] = out["sums"] = out["depth"] = None
            yield out[[x.split()[0] for x in STATE.split(", ")]]
        rows = [(None, None, c, None, None, None, int(n[c]), [int(inertia[c])] if final else sums[c].tolist(), depth) for c in range(k) if n[c]]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in STATE.split(", ")]).astype({"distance": object, "vec_id": object})

    return source.mapInPandas(run, STATE.format(kind=kind))


def _sums(state: DataFrame, k: int, width: int) -> tuple[list[int], list[list[int]], int]:
    """(counts, sums, longest head) of the clusters: a row for each cluster and component reaches the driver."""
    parts = state.where("n is not null").select("cluster", "n", "depth", F.posexplode("sums").alias("i", "x"))
    found = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.max("depth").alias("depth")).collect()
    n, sums, depth = [0] * k, [[0] * width for _ in range(k)], 0
    for r in found:
        n[r["cluster"]], sums[r["cluster"]][r["i"]], depth = int(r["n"]), int(r["x"]), max(depth, r["depth"])
    return n, sums, depth


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, width: int | None = None) -> tuple[DataFrame, np.ndarray, list[int]]:
    """((vec_id, cluster, distance) of each vector, the centroids, each cluster's sum of distances).

    width: how many nearest centroids have a bound of their own at first; a quarter and one more, if not given.
    """
    rows = scaled(vectors, id_col, column, dimensions, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(rows, k, seed)
    k = len(centroids)
    if not k:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids.reshape(0, dimensions), []
    width = max(0, min(k - 1, k // 4 + 1 if width is None else width))
    least = min(width, max(1, k // 8))
    state, drift = None, None
    for _ in range(rounds):
        before, state = state, saved(_pass(rows if state is None else state.where("n is null"), kind, centroids, drift, width, False), "drake")
        if before is not None:
            forget(before)
        n, sums, depth = _sums(state, k, dimensions)
        moved = np.array([[s // n[c] for s in sums[c]] if n[c] else centroids[c].tolist() for c in range(k)], np.int64)
        if drift is not None:
            width = max(least, min(width, depth))
        drift, centroids = above(np.sqrt(((moved - centroids) ** 2).sum(1).astype(np.float64))), moved
        if not drift.any():
            break  # all later rounds would repeat this one
    last = saved(_pass(rows if state is None else state.where("n is null"), kind, centroids, drift, width, True), "clustered")
    if state is not None:
        forget(state)
    _, inertia, _ = _sums(last, k, 1)
    return last.where("n is null").select("vec_id", "cluster", "distance"), centroids, [x[0] for x in inertia]


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster, with its cluster's inertia and centroid: a lookup of as many entries as there are centroids."""
    found, centroids, inertia = cluster(table(spark, sf_dir, "embeddings"))
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def lookup(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)

    return found.select(
        "vec_id", "cluster", "distance",
        lookup(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), lookup(marks, "string").alias("centroid_sha256"),
    )


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """The rounds one after the other, over one row for each vector and component."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT rid, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM v) WHERE c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, c := c)) AS m FROM (SELECT rid, c, CAST(sum((x.x - o.x) * (x.x - o.x)) AS BIGINT) AS d FROM x JOIN c{r} o USING (i) GROUP BY rid, c) GROUP BY rid)")
        if r < rounds:
            mean = "SELECT m.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{0} JOIN x USING (rid) GROUP BY m.c, i".format(r)
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, CAST(CASE WHEN n > 0 THEN (s - ((s % n) + n) % n) // n ELSE o.x END AS BIGINT) AS x FROM c{r} o LEFT JOIN ({mean}) USING (c, i))")
    parts.append(f"w AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS mark FROM c{rounds} GROUP BY c)")
    return (
        "WITH " + ", ".join(parts) + " SELECT v.vec_id, CAST(m.c AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, mark AS centroid_sha256"
        f" FROM a{rounds} JOIN v USING (rid) JOIN w ON w.c = m.c"
    )


OP11_SQL = _sql()
