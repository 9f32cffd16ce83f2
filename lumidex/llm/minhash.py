"""Near-duplicate detection by b-bit MinHash (operator 4).

Each text's distinct word shingles give minima of 32 bits. Bands of ROWS minima
make bucket keys; of every minimum the low BITS bits are kept, packed into words of 64
bits. Documents that share a bucket are candidates; the similarity estimated from the
count of equal packed minima, corrected for chance collisions of the low bits, has to
come within MARGIN of the threshold (over 5 standard deviations); what passes is
confirmed on the full shingle sets. There are as many bands as it takes to miss a link at
the threshold with a probability of at most MISS: 24 for 0.85 (7.7e-7), 35 for 0.8 (9.2e-7).
The estimate drops such a link with 1.4e-7 and 4e-9 more, by the binomial tail of equal
minima; both together stay below 1e-6, and fall fast above the threshold.

Whole result without all pairs. Texts with equal sets are one class from the start,
whatever the number of copies. In a first round each class is compared with one centre
of its buckets only, that with the most common shingles, and the links found make
components. The second round looks for links between different components only. It
goes by the rarest shingles of the classes that share a bucket: two similar sets share
one among the first few of each, early enough for what is left to suffice (prefix and
position filters, which lose no pair), so of thousands of copies of one text those whose own
changes fill that prefix meet no one. Texts of one template that differ in a few words each, a
little below the threshold to each other, do meet and are told apart by their sets: in such a
group pairs grow with its square. No bucket is capped. Rarity is taken from
counts in SKETCH cells, a broadcast of fixed size; it orders the shingles, so how exact
the counts are changes the work and not the result. Joins are on bucket, shingle or
class keys, with nothing after them that needs one key's rows together, so adaptive
execution may split them.

Defined results: null, empty and blank texts have an empty set, are linked with nothing
and stay, with component_id their own doc_id; texts with fewer words than a shingle
have the whole sequence as one; very long texts count whole; repeated rows (equal
doc_id) each give a row; a null doc_id is ignored for the smallest id, and kept is true
for it only where its component has no other id. An empty table gives no rows.
Shingles are compared by hashes of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm.common import forget, saved, table
from lumidex.operators.graph import connected_components

ROWS = 5
MISS = 1e-6
BITS = 2
MOST_HASHES = 4096
SKETCH = 1 << 17
MARGIN = 0.22
_RANDOM = np.random.default_rng(20240229)
MULTIPLY = _RANDOM.integers(0, 2**63, MOST_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RANDOM.integers(0, 2**63, MOST_HASHES, dtype=np.uint64)
PLACE = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(percent: int) -> int:
    """Bands that miss a pair of this similarity with a probability of MISS at most."""
    bands = ceil(log(MISS) / log(1 - (percent / 100) ** ROWS)) if percent < 100 else 1
    if hashes_for(bands) > MOST_HASHES:
        raise ValueError(f"a similarity of {percent} % takes more than {MOST_HASHES} minima")
    return bands


def hashes_for(bands: int) -> int:
    """Minima for so many bands, as whole words of packed bits."""
    per = 64 // BITS
    return ceil(bands * ROWS / per) * per


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of size words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    if n < size:  # one shingle of another length: other multipliers than those of a whole one
        return (hashes * PLACE[-n:]).sum(keepdims=True) + np.uint64(n)
    total = hashes[: n - size + 1] * PLACE[0]
    for i in range(1, size):
        total += hashes[i : n - size + 1 + i] * PLACE[i]
    return np.unique(total)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minima(shingles: np.ndarray, count: int) -> np.ndarray:
    """count minima of 32 bits, in blocks so that memory stays bounded."""
    least = np.full(count, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 2048):
        mixed = shingles[at : at + 2048, None] * MULTIPLY[None, :count]
        mixed += ADD[:count]
        np.minimum(least, (mixed.min(axis=0)) >> np.uint64(32), out=least)
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    rows = least[: bands * ROWS].reshape(bands, ROWS) + np.uint64(1)
    keys = (rows * PLACE[:ROWS]).sum(axis=1) + np.arange(1, bands + 1, dtype=np.uint64) * PLACE[ROWS]
    keys ^= keys >> np.uint64(31)
    return (keys * PLACE[ROWS + 1]).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, 32 minima to a word."""
    per = 64 // BITS
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low, axis=1).view(np.int64)


def _sources(documents: DataFrame, id_col: str) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("?")), text).alias("row_key"))


def sketches(documents: DataFrame, size: int, bands: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id, row_key, cls (digest of the shingle set, null if empty), n_shingles, bands, sig."""
    docs = _sources(documents, id_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                rows = []
                for text in part["text"]:
                    found = shingle_hashes(text, size)
                    if not len(found):
                        rows.append((None, 0, None, None))
                        continue
                    least = minima(found, hashes_for(bands))
                    rows.append((set_digest(found), len(found), band_keys(least, bands), packed(least)))
                out = pd.DataFrame(rows, columns=["cls", "n_shingles", "bands", "sig"])
                out.insert(0, "doc_id", part["doc_id"].array)
                out.insert(1, "row_key", part["row_key"].array)
                yield out

    return docs.mapInPandas(sketch, f"doc_id {kind}, row_key long, cls binary, n_shingles long, bands array<long>, sig array<long>")


def estimate(a: str, b: str, hashes: int) -> F.Column:
    """Similarity from two packed signatures: the share of equal minima, without those equal by chance."""
    fives = F.lit(0x5555555555555555)
    words = []
    for i in range(hashes * BITS // 64):
        differ = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        words.append(F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(fives)))
    equal = 1 - reduce(lambda x, y: x + y, words) / F.lit(float(hashes))
    by_chance = 2.0**-BITS
    return (equal - by_chance) / (1 - by_chance)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int, hashes: int) -> DataFrame:
    """The pairs (a, b) of classes that sizes and signatures allow to be linked; with n_a, n_b, est."""
    for end in ("a", "b"):
        side = classes.select(F.col("cls").alias(f"cls_{end}"), F.col("sig").alias(f"sig_{end}"), F.col("n_shingles").alias(f"n_{end}"))
        pairs = pairs.join(side, pairs[end] == side[f"cls_{end}"])
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = pairs.where(fits).withColumn("est", estimate("sig_a", "sig_b", hashes))
    return pairs.where(F.col("est") >= percent / 100 - MARGIN).select("a", "b", "n_a", "n_b", "est")


def _sets(classes: DataFrame, documents: DataFrame, size: int, id_col: str) -> DataFrame:
    """(set_cls, shingles) of classes, from one text of each."""
    picked = classes.select("cls", "pick")
    texts = _sources(documents, id_col).join(picked, F.col("row_key") == F.col("pick"))
    texts = texts.withColumn("other_hash", F.hash("text")).dropDuplicates(["row_key", "other_hash"])  # different texts of one key both come

    def shingle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                found = [(cls, shingle_hashes(t, size)) for cls, t in zip(part["cls"], part["text"], strict=True)]
                found = [(cls, s.view(np.int64)) for cls, s in found if set_digest(s) == cls]
                yield pd.DataFrame(found, columns=["set_cls", "shingles"])

    return texts.select("cls", "text").mapInPandas(shingle, "set_cls binary, shingles array<long>")


def _cell_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of SKETCH cells."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SKETCH, np.int64)
        for pdf in frames:
            for s in pdf["shingles"]:
                total += np.bincount(np.asarray(s, np.int64) & (SKETCH - 1), minlength=SKETCH)
        cell = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cell.astype(np.int32), "n": total[cell]})

    out = np.zeros(SKETCH, np.int64)
    for r in sets.select("shingles").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # SKETCH rows at most
        out[r["cell"]] = r["n"]
    return out


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(cls, n, common, rarest): how common a set's shingles are, and those of which a similar set holds one, rarest first."""
    cells = sets.sparkSession.sparkContext.broadcast(_cell_counts(sets))

    def order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for cls, found in pdf[["set_cls", "shingles"]].itertuples(index=False):
                s = np.asarray(found, np.int64)
                seen = cells.value[s & (SKETCH - 1)]
                first = np.lexsort((s, seen))[: len(s) + (-percent * len(s) // 100) + 1]
                rows.append((cls, len(s), float(np.log(seen).mean()), s[first]))
            yield pd.DataFrame(rows, columns=["cls", "n", "common", "rarest"])

    return sets.mapInPandas(order, "cls binary, n long, common double, rarest array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs whose full shingle sets are similar enough."""
    for end in ("a", "b"):
        side = sets.select(F.col("set_cls").alias(f"set_{end}"), F.col("shingles").alias(f"shingles_{end}"))
        pairs = pairs.join(side, pairs[end] == side[f"set_{end}"])
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return pairs.withColumn("shared", shared.cast("long")).where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _across(rarest: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different labels that may be similar, by their rarest shingles.

    Of a shingle's classes those outside the most frequent label meet all others: every
    pair of different labels has one such side.
    """
    spread = rarest.select("cls", "n", F.posexplode("rarest").alias("at", "token"))
    named = spread.join(labels, spread["cls"] == labels["node"], "left").select("token", "cls", "n", "at", F.coalesce("component", "cls").alias("label"))
    named = saved(named, "named")
    sizes = named.groupBy("token", "label").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("token").agg(F.count("*").alias("labels"), F.max(F.struct("k", "label"))["label"].alias("largest")).where("labels > 1")
    mixed = mixed.select(F.col("token").alias("m_token"), "largest")
    inside = saved(named.join(mixed, F.col("token") == F.col("m_token")).select("token", "cls", "n", "at", "label", (F.col("label") != F.col("largest")).alias("outside")), "inside")
    out = inside.where("outside").select(*[F.col(c).alias(f"o_{c}") for c in ("token", "cls", "n", "at", "label")])
    once = ~F.col("outside") | (F.col("cls") < F.col("o_cls"))
    # what two sets can still share from these places on has to reach what similarity asks for
    room = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at")) >= percent * (F.col("n") + F.col("o_n"))
    pairs = inside.join(out, (F.col("token") == F.col("o_token")) & (F.col("label") != F.col("o_label")) & once & room)
    return pairs.select(F.least("cls", "o_cls").alias("a"), F.greatest("cls", "o_cls").alias("b")).distinct()


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept: documents linked from percent / 100 similarity of their sets of size-word shingles."""
    bands = bands_for(percent)
    hashes = hashes_for(bands)
    docs = saved(sketches(documents, size, bands, id_col), "sketches")
    classes = saved(
        docs.where("cls is not null")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("rep"), F.min("row_key").alias("pick"), *[F.any_value(c).alias(c) for c in ("n_shingles", "bands", "sig")]),
        "classes",
    )
    in_bands = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("s_bucket"))
    members = saved(in_bands.join(shared, F.col("bucket") == F.col("s_bucket")).select("bucket", "cls"), "members")
    candidates = saved(members.select("cls").distinct().join(classes, "cls").select("cls", "sig", "n_shingles", "pick"), "candidates")
    sets = saved(_sets(candidates, documents, size, id_col), "sets")
    rarest = saved(_rarest(sets, percent), "rarest")

    # both sides of the join on buckets are written first: right above its two exchanges a hot bucket may be split
    weighed = saved(members.join(rarest.select(F.col("cls").alias("r_cls"), "common"), F.col("cls") == F.col("r_cls")).select("bucket", "cls", "common"), "weighed")
    forget(members)
    centres = saved(weighed.groupBy("bucket").agg(F.max(F.struct("common", "cls"))["cls"].alias("centre")).select(F.col("bucket").alias("c_bucket"), "centre"), "centres")
    first = weighed.join(centres, F.col("bucket") == F.col("c_bucket")).where("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    links = saved(_confirmed(_likely(first, candidates, percent, hashes), sets, percent), "links")
    forget(weighed, centres)
    labels = connected_components(links, saved)
    more = saved(_confirmed(_likely(_across(rarest, labels, percent), candidates, percent, hashes), sets, percent), "more")
    forget(candidates, sets, rarest)
    found = connected_components(links.union(more), saved)

    named = classes.join(found, classes["cls"] == found["node"], "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    named = saved(named, "components")
    forget(classes)
    least = named.groupBy("component").agg(F.min("rep").alias("component_id")).select(F.col("component").alias("l_component"), "component_id")
    # written for the same reason: a text that many documents have is a hot class
    least = saved(named.join(least, F.col("component") == F.col("l_component")).select(F.col("cls").alias("l_cls"), "component_id"), "least")
    joined = docs.select("doc_id", "row_key", "cls", "n_shingles").join(least, F.col("cls") == F.col("l_cls"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "row_key", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85).drop("row_key")


def without_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """The documents whose kept is true, all columns; of rows with equal id and text one."""
    kept = near_duplicates(documents, size, percent, id_col).where("kept").select(F.col("row_key").alias("kept_key")).distinct()
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("?")), F.col("text").cast("string"))
    keyed = documents.select(key.alias("document_key"), F.struct("*").alias("document"))
    return keyed.join(kept, F.col("document_key") == F.col("kept_key")).dropDuplicates(["document_key"]).select("document.*")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(x.n) + min(y.n) - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN both_ways l ON l.a = r.b) SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id, m = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = w.doc_id
"""
