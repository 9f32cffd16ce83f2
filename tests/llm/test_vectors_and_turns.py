"""Clustering, neighbours and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumidex.llm import drake, hilbert, turn_repair

DATA = "/root/testdata/sf0.001"
EMBEDDING = "vec_id long, embedding array<double>, x string, cluster int, n int"


def lloyd(rows, k, rounds, seed, scale):
    """(centroids, {id: [(cluster, distance)]}) by plain loops over exact whole numbers."""
    vectors = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows]
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in vectors:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    return centroids, sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in vectors), key=repr)


@pytest.mark.parametrize("width", [0, 1, 3, None])
def test_clusters_are_lloyds(spark, width):
    rng = np.random.default_rng(width or 7)
    middle = rng.normal(size=(5, 6))
    rows = [(i, (middle[i % 5] + rng.normal(size=6) * 0.3).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, -0.5, 0.25, 0.0, 0.0, 0.0]) for i in range(120)]  # a large group of copies, and ties
    rows += [(None, rows[0][1]), rows[3], rows[3]]
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], EMBEDDING)
    found, centroids, inertia = drake.cluster(df, k=9, rounds=6, seed=5, dimensions=6, scale=100, width=width)
    want_centroids, want = lloyd(rows, 9, 6, 5, 100)
    assert centroids.tolist() == want_centroids
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == want
    assert inertia == [sum(d for _, c, d in want if c == j) for j in range(9)]


def test_clusters_of_few_odd_and_no_rows(spark):
    odd = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, []), (8, [3000.0, -2.5])]
    df = spark.createDataFrame([(i, v, "", 0, 0) for i, v in odd], EMBEDDING)
    found, centroids, _ = drake.cluster(df, k=8, dimensions=2)
    assert sorted(r["vec_id"] for r in found.collect()) == [1, 8] and len(centroids) == 2
    found, centroids, inertia = drake.cluster(df.limit(0), k=8, dimensions=2)
    assert found.isEmpty() and len(centroids) == 0 and inertia == []
    large = spark.createDataFrame([(1, [100_000.0, 0.0], "", 0, 0), (2, [100_000.0, 1.0], "", 0, 0), (3, [-100_000.0, 0.0], "", 0, 0)], EMBEDDING)
    found, *_ = drake.cluster(large, k=2, rounds=3, dimensions=2)
    assert sorted(map(tuple, found.collect())) == lloyd([(1, [100_000.0, 0.0]), (2, [100_000.0, 1.0]), (3, [-100_000.0, 0.0])], 2, 3, 3, 1024)[1]
    with pytest.raises(Exception, match="beyond"):
        drake.cluster(spark.createDataFrame([(1, [1e9, 0.0], "", 0, 0)], EMBEDDING), dimensions=2)


def test_bounds_save_distances():
    """On separated groups most vectors are certified without a distance to any other centroid."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-900, 900, (8, 64))
    v = np.concatenate([m + rng.integers(-60, 60, (200, 64)) for m in middle])
    b = drake.Bounds.measured(v, middle, 3)
    moved = middle + rng.integers(-2, 3, middle.shape)
    b.drifted(drake.above(np.sqrt(((moved - middle) ** 2).sum(1).astype(float))))
    assert (b.upper < b._floors(np.arange(len(v)))[:, 0]).mean() > 0.99
    assert b.reassign(v, moved) <= 4 and (b.cluster == drake.squared(v, moved).argmin(1)).all()


def test_hilbert_steps_to_neighbours():
    """The curve visits every cell once, and each step moves one cell along one axis."""
    for m, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * m, indexing="ij"), -1).reshape(-1, m)
        key = hilbert.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def nearest(rows, k):
    """{query: [(rank, id, product)]} over all rows."""
    rows = {i: v for i, v in rows if i is not None and v and any(v) and None not in v and np.isfinite(v).all()}
    out = {}
    for q, x in rows.items():
        if q % 20 == 0:
            every = []
            for i, v in rows.items():
                total = 0.0
                for a, b in zip(x, v, strict=True):
                    total += a * b
                if i != q:
                    every.append((-total, i))
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(every)[:k])]
    return out


def by_query(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def asked(df):
    return df.where(F.col("vec_id") % 20 == 0)


def test_neighbours_of_copies_ties_and_odd_rows(spark):
    """Windows as wide as the table: exactly the brute force, with a third of all rows one vector."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 320)]
    rows += [(i, [float(i % 2), float(1 - i % 2), 0.0, 0.0]) for i in range(320, 360)]  # products that are all 0 or 1
    odd = [(1000, None), (1001, [0.0] * 4), (1020, [1.0, None, 0.0, 0.0]), (1040, [float("nan")] * 4), (None, [1.0] * 4), (1060, [1.0])]
    df = spark.createDataFrame([(i, v, "", 0, 0) for i, v in rows + odd + rows[:25]], EMBEDDING)
    found = hilbert.search(df, asked(df), k=20, dimensions=4, target=1.0, calibrated=10**6, block=64)
    assert by_query(found) == nearest(rows, 20)


def test_neighbours_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "", 0, 0) for i, v in rows], EMBEDDING)
    assert by_query(hilbert.search(df, asked(df), dimensions=2)) == nearest(rows, 20)
    assert hilbert.search(df.limit(0), asked(df.limit(0)), dimensions=2).isEmpty()
    assert hilbert.search(df, df.limit(0), dimensions=2).isEmpty()


def test_neighbours_recall_and_scores(spark):
    """At least nine of ten true neighbours, on vectors that fill all dimensions evenly, the hardest kind; on groups by far narrower windows."""
    import pyarrow.parquet as pq

    given = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()
    rows = list(zip(given["vec_id"].tolist(), [list(map(float, v)) for v in given["embedding"]], strict=True))
    want = nearest(rows, 20)
    got = by_query(hilbert.op12_neighbours(spark, "/root/testdata/sf0.1"))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    true = {q: {i: s for _, i, s in nearest([r for r in rows if r[0] == q or r[0] in {i for _, i, _ in got[q]}], 20)[q]} for q in list(want)[:5]}
    assert all(true[q][i] == s for q in true for _, i, s in got[q])


def damage(rows):
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fault == 1 else "".join(a for a in x if a not in ".!?") if fault == 2 else x
        yield from [(c, t, "user" if fault == 4 else r, x)] * (0 if fault == 0 else 2 if fault == 3 else 1)


NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def mend(rows):
    """The figures, edits and hash of one conversation's rows: the best (cost, edits) for each state, row by row."""
    seen, faults = set(), []
    for _, _, r, x in rows:
        end = x.rstrip(" \t\n\x0b\f\r")
        faults.append("b" if not end else "d" if (r, x) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((r, x))

    def grown(best):
        for _ in range(3):
            for state, (cost, done, out) in list(best.items()):
                for role in ("user", "assistant"):
                    to = NEXT[state].get(role[0])
                    if to is not None and (to not in best or (cost + 2, done + "I") < best[to][:2]):
                        best[to] = (cost + 2, done + "I", [*out, f"{role}:"])
        return best

    best = grown({"": (0, "", [])})
    for (_, _, r, x), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, done, out) in best.items():
            ways = [(state, cost + 3, "D", out)]
            if fault not in ("b", "d"):
                kept = cost + (fault == "t")
                ways += [(NEXT[state].get(r[:1]), kept, "K", [*out, f"{r}:{x}"])]
                ways += [(NEXT[state].get(role[0]), kept + 2, "R", [*out, f"{role}:{x}"]) for role in ("user", "assistant")]
            for to, c, letter, o in ways:
                if to is not None and (to not in new or (c, done + letter) < new[to][:2]):
                    new[to] = (c, done + letter, o)
        best = grown(new)
    cost, done, out = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, done, hashlib.sha256("\n".join(out).encode()).hexdigest())


def mended(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    return {c: mend(sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))) for c, v in by.items()}


TURNS = "conv_id long, turn long, role string, text string, conv string, audit int, n int"


def random_turns(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = [None, "", " \t", "A.", "B!", "so on", "A.  \n", "no end", "x" * 70, "é?"]
    rows = [(c, rng.choice([None, t, t, rng.randint(0, 5)]), rng.choice(roles), rng.choice([*texts, f"{t}."])) for c in [None, *range(12)] for t in range(rng.choice([1, 2, 5, 40]))]
    return rows + rows[:9]


@pytest.mark.parametrize("batch", [3, 17, 20_000])
def test_turns_are_repaired(spark, batch):
    """Equal to plain loops, whatever is cut into pieces."""
    rows = random_turns(batch)
    df = spark.createDataFrame([(*r, "", 0, 1) for r in rows], TURNS)
    repaired = turn_repair.repair(turn_repair.damaged(df), batch_rows=batch)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.digests(repaired).select("conv_id", *turn_repair.NAMES[-6:], "audit", "sha").collect()}
    want = mended(rows)
    assert got == {c: v for c, v in want.items() if c in got} and all(v[5:7] == (0, "") for c, v in want.items() if c not in got)


def test_one_conversation_of_many_rows(spark):
    """A conversation that holds most rows, over several partitions, with texts that end in nothing."""
    rows = [(7, t, "user" if t % 3 else "assistant", f"{t % 50} words." if t % 7 else "cut") for t in range(3000)] + random_turns(1)
    df = spark.createDataFrame([(*r, "", 0, 1) for r in rows], TURNS).repartition(6)
    repaired = turn_repair.repair(turn_repair.damaged(df), batch_rows=256)
    got = {r["conv_id"]: (r["cost"], r["audit"], r["sha"]) for r in turn_repair.digests(repaired).collect()}
    assert got[7] == mended(rows)[7][5:] and repaired.where("conv_id = 7").count() > 10


def test_turn_query_equals_its_sql(spark, tmp_path):
    rows = random_turns(5)
    spark.createDataFrame([(*r, "", 0, 1) for r in rows], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder, name in ((DATA, "conversations.parquet"), (tmp_path, "conversations.parquet/*.parquet")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/{name}'")
        got, want = turn_repair.op13_turn_repair(spark, str(folder)), con.sql(turn_repair.OP13_SQL)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    none = spark.createDataFrame([], TURNS)
    assert turn_repair.repair(turn_repair.damaged(none)).isEmpty()
