"""Approximate nearest neighbours by shifted space-filling curves (operator 12).

Nearness is the largest inner product. One more component, the root of what a vector's
squared norm lacks of the largest, puts all vectors on a sphere; a query, scaled to that
sphere, is near in angle to those of large products. Each of CURVES orderings projects the
sphere to PROJECTED dimensions of its own, shifts it, and numbers the cells of a grid along a
Hilbert curve. Spark sorts the cells' numbers of all curves across range partitions, which
gives each vector a position on each curve. A query's candidates are the vectors within a
window of positions around its own, on any curve; the windows are merged and reranked by
exact products.

How wide a window has to be depends on the data: on clustered vectors a few hundred
positions are enough, on vectors that fill all dimensions evenly no ordering keeps neighbours
together, and any index has to look at a good part of them. So the width is measured, not
set: for CALIBRATED queries (those of smallest hash) the true neighbours are found by brute
force, one pass over the vectors, and the width is the one within which TARGET of them lie.
That sample and the FIT_ROWS vectors that give the grid its range are all that is sampled;
every vector is indexed, and no window or block drops a candidate.

Scale: equal vectors are one class with its SMALLEST ids, as many as a result can name, cut
before anything is shuffled, so copies weigh nothing. What is sorted are a few numbers a
vector and curve. Vectors are dealt to blocks of BLOCK positions; a block's queries stream
past it in batches, however many reach it, and each leaves at most k + 1 ids. Blocks have
equal sizes by construction. The driver gets the samples and the positions of their
neighbours, all of fixed size; what is broadcast is a row for each curve and partition.

Defined results: vectors that are null, zero, of another length or hold a null or
non-finite component, and rows with a null id, take no part; repeated rows count once; fewer
than k candidates: all, if the windows reach them; equal products go by id; an empty table or
no queries: no rows. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumidex.llm.common import forget, saved, table

DIMENSIONS, NEIGHBOURS, QUERY_STEP = 64, 20, 20
#: Orderings, dimensions of each, bits of each dimension; positions in a block; share of the sampled queries' neighbours that windows have to reach.
CURVES, PROJECTED, BITS, BLOCK, TARGET = 8, 8, 7, 8192, 0.97
#: Rows that the driver gets to set the grid's range and the windows.
FIT_ROWS, CALIBRATED = 4096, 128
SEED = 12


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along a Hilbert curve of each of cells (n, m), whole numbers below 2**bits."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo what each level's turns and mirrors did, from the coarsest
        low = q - 1
        for i in range(len(x)):
            swap = np.where((x[i] & q) > 0, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where((x[i] & q) > 0, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    gray = np.zeros(len(cells), np.int64)
    q = top
    while q > 1:
        gray = np.where((x[-1] & q) > 0, gray ^ (q - 1), gray)
        q >>= 1
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ gray) >> b) & 1)
    return key


class Curves:
    """Projections, ranges and shifts of all orderings."""

    def __init__(self, sample: np.ndarray, largest: float, curves: int, seed: int):
        rng = np.random.default_rng(seed)
        self.largest, wide = largest, sample.shape[1] + 1
        m = min(PROJECTED, wide)
        self.projections = [np.linalg.qr(rng.normal(size=(wide, m)))[0] for _ in range(curves)]
        self.shifts = [rng.uniform(0, 0.2, m) for _ in range(curves)]
        lifted = self.lifted(sample)
        self.ranges = []
        for p in self.projections:
            y = lifted @ p
            low, high = np.quantile(y, 0.001, axis=0), np.quantile(y, 0.999, axis=0)
            self.ranges.append((low, np.maximum(high - low, 1e-12) * 1.2))

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        lack = np.maximum(self.largest**2 - (vectors * vectors).sum(1), 0)
        return np.column_stack([vectors, np.sqrt(lack)])

    def asked(self, queries: np.ndarray) -> np.ndarray:
        norm = np.sqrt((queries * queries).sum(1))[:, None]
        return np.column_stack([queries / norm * self.largest, np.zeros(len(queries))])

    def keys(self, points: np.ndarray) -> np.ndarray:
        """(n, curves) of lifted or asked points."""
        out = []
        for p, s, (low, span) in zip(self.projections, self.shifts, self.ranges, strict=True):
            grid = ((points @ p - low) / span + s) * (1 << BITS)
            out.append(hilbert(np.clip(grid, 0, (1 << BITS) - 1).astype(np.int64), BITS))
        return np.stack(out, axis=1)


def products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed from the first component to the last, so alike in any batch."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += query[j] * vectors[:, j]
    return total


def sound(vectors: DataFrame, id_col: str, column: str, dimensions: int) -> DataFrame:
    """(id, x, h) of the rows that take part; h is a hash of the vector."""
    x = F.col("x")
    fine = (F.size(x) == dimensions) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("x")).where(fine & F.col("id").isNotNull())
    return rows.withColumn("h", F.xxhash64("x"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(cid, x, ids) of each distinct vector: its smallest id, and its k + 1 smallest; copies beyond are cut in each partition."""
    ranked = rows.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("h", "x").orderBy("id"))).where(F.col("nth") <= k + 1)
    return ranked.groupBy("h", "x").agg(F.min("id").alias("cid"), F.sort_array(F.collect_list("id")).alias("ids")).select("cid", "x", "ids")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _positions(points: DataFrame, curves: Curves, n_curves: int) -> DataFrame:
    """(curve, tag, cid, pos) of points (tag, cid, x): tag 0 is a vector, its pos its number on the curve; tag 1 a query, its pos how many vectors stand before it."""

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x, asked = _matrix(pdf["x"]), pdf["tag"].to_numpy() == 1
                at = curves.lifted(x)
                at[asked] = curves.asked(x[asked])
                yield pd.DataFrame({"tag": pdf["tag"], "cid": pdf["cid"], "keys": list(curves.keys(at))})

    each = points.mapInPandas(keyed, "tag int, cid long, keys array<long>").select("tag", "cid", F.posexplode("keys").alias("curve", "key"))
    order = ["curve", "key", "cid", "tag"]

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), np.zeros(n_curves, np.int64)
        for pdf in frames:
            curve, idx = pdf["curve"].to_numpy(), np.zeros(len(pdf), np.int64)
            vector = pdf["tag"].to_numpy() == 0
            for c in np.unique(curve):
                at = curve == c
                seen = np.cumsum(vector[at])
                idx[at] = before[c] + seen - vector[at]
                before[c] += seen[-1]
            yield pd.DataFrame({"curve": curve, "tag": pdf["tag"], "cid": pdf["cid"], "part": part, "idx": idx})

    placed = each.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(numbered, "curve int, tag int, cid long, part int, idx long")
    placed = saved(placed, "order")
    ahead = Window.partitionBy("s_curve").orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(F.col("curve").alias("s_curve"), F.col("part").alias("s_part")).agg(F.count_if(F.col("tag") == 0).alias("n"))
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    # a row for each curve and partition, however many vectors there are
    joined = placed.join(F.broadcast(starts), (F.col("curve") == F.col("s_curve")) & (F.col("part") == F.col("s_part")))
    return joined.select("curve", "tag", "cid", (F.col("before") + F.col("idx")).alias("pos"))


def _nearest_rows(query: np.ndarray, rough: np.ndarray, vectors: np.ndarray, first_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, products) of the k nearest, ties to the smaller id; rough products choose what is summed exactly."""
    if len(rough) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        slack = 1e-9 * (abs(least) + float(np.abs(query).max()) * float(np.abs(vectors).max()))
        rows = np.flatnonzero(rough >= least - slack)
    else:
        rows = np.arange(len(rough))
    score = products(query, vectors[rows])
    order = np.lexsort((first_ids[rows], -score))[:k]
    return rows[order], score[order]


def brute_force(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, cid, score) of the k nearest of vectors (cid, x) for each of a bounded list of queries: one pass, k rows a task and query."""
    ids, q = [i for i, _ in queries], np.array([v for _, v in queries], np.float64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x, cid = _matrix(pdf["x"]), pdf["cid"].to_numpy()
                rough = q @ x.T
                for i, name in enumerate(ids):
                    rows, score = _nearest_rows(q[i], rough[i], x, cid, k)
                    yield pd.DataFrame({"query_id": name, "cid": cid[rows], "score": score})

    each = vectors.select("cid", "x").mapInPandas(run, "query_id long, cid long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cid"))
    return each.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def window_width(positions: DataFrame, vectors: DataFrame, asked: DataFrame, k: int, n: int, target: float, calibrated: int) -> int:
    """The width within which target of the sampled queries' true neighbours lie, on the curve that is kindest to each."""
    sample = [(r["cid"], r["x"]) for r in asked.orderBy(F.xxhash64("cid"), "cid").limit(calibrated).collect()]
    if not sample:
        return 0
    true = brute_force(vectors, sample, k)
    at = positions.where("tag = 0").select("curve", F.col("cid").alias("v"), F.col("pos").alias("v_pos"))
    q = positions.where((F.col("tag") == 1) & F.col("cid").isin([i for i, _ in sample])).select(F.col("curve").alias("q_curve"), F.col("cid").alias("q"), F.col("pos").alias("q_pos"))
    # at most CALIBRATED x k rows, then CALIBRATED x k x CURVES
    found = at.join(F.broadcast(true), F.col("v") == F.col("cid"))
    found = found.join(F.broadcast(q), (F.col("query_id") == F.col("q")) & (F.col("curve") == F.col("q_curve")))
    off = found.groupBy("query_id", "cid").agg(F.min(F.abs(F.col("v_pos") - F.col("q_pos"))).alias("off")).select("off").collect()
    return min(n, int(np.ceil(np.quantile([r["off"] for r in off], target))) + 1)


def _windows(near: DataFrame, k: int, width: int) -> DataFrame:
    """(cid, best): for each query and block the k + 1 nearest (minus the product, id) in its window; near is sorted by curve, block, tag and pos."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, parts, ready = None, [], None
        for pdf in frames:
            keys = pdf["curve"].to_numpy(np.int64) * (1 << 44) + pdf["block"].to_numpy()
            tags = pdf["tag"].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (tags[1:] != tags[:-1])) + 1).tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != block:
                    block, parts, ready = keys[a], [], None
                piece = pdf.iloc[a:b]
                if tags[a] == 0:
                    parts.append((piece["pos"].to_numpy(), _matrix(piece["x"]), piece["ids"].tolist()))
                    continue
                if ready is None:
                    if not parts:
                        continue
                    ready = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [i for p in parts for i in p[2]]
                    first = np.array([i[0] for i in ready[2]], np.int64)
                pos, x, ids = ready
                q, q_pos, names = _matrix(piece["x"]), piece["pos"].to_numpy(), piece["cid"].to_numpy()
                for s in range(0, len(q), 256):
                    rough = q[s : s + 256] @ x.T
                    # positions on a curve have no gaps, and a query stands before the vector of its number
                    low = np.searchsorted(pos, q_pos[s : s + 256] - width, "left")
                    high = np.searchsorted(pos, q_pos[s : s + 256] + width, "right")
                    out = []
                    for i in range(len(rough)):
                        lo, hi = low[i], high[i]
                        if lo == hi:
                            continue
                        rows, score = _nearest_rows(q[s + i], rough[i, lo:hi], x[lo:hi], first[lo:hi], k + 1)
                        every = sorted((-float(p), int(v)) for r, p in zip(rows, score, strict=True) for v in ids[lo + r])[: k + 1]
                        out.append((names[s + i], [p for p, _ in every], [v for _, v in every]))
                    if out:
                        yield pd.DataFrame(out, columns=["cid", "less", "ids"])

    return near.mapInPandas(run, "cid long, less array<double>, ids array<long>").select("cid", F.arrays_zip("less", "ids").alias("best"))


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, curves: int = CURVES, block: int = BLOCK, target: float = TARGET, calibrated: int = CALIBRATED, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries (id_col, column) the k nearest found of vectors, but for rows of its own id."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known = saved(classes(sound(vectors, id_col, column, dimensions), k), "vectors")
    asked = sound(queries, id_col, column, dimensions).distinct()
    kinds = saved(asked.groupBy("h", "x").agg(F.min("id").alias("cid")), "asked")
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, largest = known.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    if not n:
        return empty
    step = max(1, 2 * n // FIT_ROWS)
    sample = [r["x"] for r in known.where(F.pmod(F.xxhash64("cid"), F.lit(step)) == 0).select("x").limit(FIT_ROWS).collect()] or [r["x"] for r in known.select("x").limit(FIT_ROWS).collect()]
    fitted = Curves(np.array(sample, np.float64), largest, curves, seed)
    points = known.select(F.lit(0).alias("tag"), "cid", "x").unionByName(kinds.select(F.lit(1).alias("tag"), "cid", "x"))
    positions = saved(_positions(points, fitted, curves), "positions")
    width = window_width(positions, known, kinds, k + 1, n, target, calibrated)

    at = positions.where("tag = 0").select("curve", F.floor(F.col("pos") / block).alias("block"), "tag", "cid", "pos")
    held = at.join(known, "cid").select("curve", "block", "tag", "cid", "pos", "x", "ids")
    reach = F.sequence(F.floor(F.greatest(F.col("pos") - width, F.lit(0)) / block), F.floor(F.least(F.col("pos") + width, F.lit(n - 1)) / block))
    stand = positions.where("tag = 1").join(kinds.select("cid", "x"), "cid")
    stand = stand.select("curve", F.explode(reach).alias("block"), "tag", "cid", "pos", "x", F.lit(None).cast("array<long>").alias("ids"))
    near = held.unionByName(stand).repartition("curve", "block").sortWithinPartitions("curve", "block", "tag", "pos")
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k + 1)
    # written, so that a query vector that very many queries share may be split in the join
    found = saved(_windows(near, k, width).groupBy("cid").agg(best.alias("best")), "nearest")
    found = saved(kinds.join(found, "cid").select("h", "x", "best"), "answers")
    forget(positions)
    named = asked.join(found, ["h", "x"]).select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda b: b["ids"] != F.col("id")), 1, k).alias("best"))
    return named.select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("b.ids").alias("vec_id"), (-F.col("b.less")).alias("score"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0))
