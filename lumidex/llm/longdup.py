"""Exact removal of repeated byte strings by distributed prefix doubling (operator 8).

Each byte inside a LENGTH-byte string that also starts somewhere else goes. Positions get
a rank by the string that starts there; a position whose rank is unique is dropped, and
ranks of longer strings are made of pairs: the rank here and the rank some bytes on.
Spark sorts the pairs and numbers them anew, over all documents.

1. Sparse positions. A start's anchor is the leftmost smallest SEED-byte hash in the
   LENGTH bytes from it, so equal strings have equal anchors at equal distances. Only
   anchors, one in about a hundred bytes, are counted; unique ones are dropped, and
   with them all starts that they stand for.
2. The starts of an anchor are dealt by distance into CHUNKS. All strings of a chunk share
   a core of nearly LENGTH bytes, and lie in one string of little more. Chunks with equal
   whole strings are one class; if there are two of them, all of it repeats. Of each class
   one goes on: cores are ranked by doubling (below), and chunks of a unique core are done.
3. What is left are the edges of repeats: all starts of their chunks are ranked by doubling.

Doubling: names of LENGTH / 4 bytes at a position and LENGTH / 4 bytes on are the first
pairs; their ranks, of LENGTH / 2 bytes, are paired again at an offset of up to
LENGTH / 2. A position that has no partner any more is unique itself. First names are
hashes of 64 bits, so results are exact but for hash collisions; ranks are numbers in the
order of the sorted pairs, which is not the order of the bytes, as only equality counts.

Scale: texts that are equal as a whole are one class from the start, whatever their
number, and removed if there are two. The texts that have candidate anchors are written to
the shared folder, and only these are read between. Counts are aggregated on the map
side, and joins back to counts are equi-joins that adaptive execution may split where a
passage is very common.

Defined results: null and empty texts have no bytes and nothing is removed; texts below
LENGTH bytes stay; very long texts are hashed in blocks of BLOCK starts; a row that
repeats is a copy like any other; null ids are ordinary; an empty table gives no rows.
Strings do not cross documents, overlapping occurrences count, and all strings are
judged on the input. Where a cut leaves part of a character, the text that is kept has
U+FFFD; hash and counts are of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumidex.llm.common import forget, saved, table

#: Bytes of the strings whose repeats go; bytes at an anchor; chunks of an anchor's starts.
LENGTH = 400
SEED = 160
CHUNKS = 8
#: Texts are hashed in blocks of so many starts, so that memory stays bounded however long one is.
BLOCK = 1 << 20

_RANDOM = np.random.default_rng(8)
BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RANDOM.integers(0, 2**62)) * 8 + 5
INVERSE = pow(BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _CACHE:
        _CACHE.clear()
        _CACHE[size] = _powers(BASE, size + 1), _powers(INVERSE, size + 1)
    return _CACHE[size]


class Hashes:
    """Hashes of 64 bits of any substring of data (bytes), by prefix sums of a random polynomial."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        up, self.down = _tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        found ^= found >> np.uint64(32)
        found *= np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
        return found


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first start, last start) of the anchors of data.

    The anchor of a start is the leftmost smallest hash of seed bytes inside the length
    bytes from there: equal strings have equal anchors at equal distances.
    """
    width, n = length - seed + 1, len(data)
    parts = []
    for at in range(0, n - length + 1, BLOCK):
        piece = data[at : at + BLOCK + length - 1]
        m = len(piece)
        starts = np.arange(m - seed + 1)
        found = Hashes(piece).of(starts, starts + seed)
        # 40 bits of hash, 24 of place: the smallest is the leftmost of the smallest hashes
        keyed = (found & np.uint64(0xFFFFFFFFFF000000)) | starts.astype(np.uint64)
        place = (_window_min(keyed, width) & np.uint64(0xFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        spot = place[edge]
        last = np.append(edge[1:] - 1, len(place) - 1)
        parts.append((spot + at, found[spot].view(np.int64), edge + at, last + at))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def anchored(documents: DataFrame, id_col: str = "doc_id", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, row_key, digest, n_bytes and the anchors (spots, hashes) of each document."""
    docs = _sources(documents, id_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                rows = []
                for text in part["text"]:
                    data = _bytes(text)
                    spot, found, _, _ = anchors(data, length, seed)
                    rows.append((hashlib.sha256(data).digest(), len(data), spot, found))
                out = pd.DataFrame(rows, columns=["digest", "n_bytes", "spots", "hashes"])
                out.insert(0, "doc_id", part["doc_id"].array)
                out.insert(1, "row_key", part["row_key"].array)
                yield out

    return docs.mapInPandas(scan, f"doc_id {kind}, row_key long, digest binary, n_bytes long, spots array<long>, hashes array<long>")


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _sources(documents: DataFrame, id_col: str) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("?")), text).alias("row_key"))


def chunk_step(length: int, seed: int, chunks: int) -> int:
    """Starts in a chunk. Its core, length - step + 1 bytes, has to be half of length at least."""
    step = -(-(length - seed + 1) // chunks)
    if length - step + 1 < -(-length // 2):
        raise ValueError("too few chunks")
    return step


def chunked_starts(data: bytes, spots: np.ndarray, length: int, seed: int, chunks: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, start of the core, hash of the whole) of the chunks of data's anchors at spots."""
    place, _, first, last = anchors(data, length, seed)
    wanted = np.isin(place, spots)
    place, first, last = place[wanted], first[wanted], last[wanted]
    step = chunk_step(length, seed, chunks)
    parts = []
    for c in range(chunks):
        near, far = c * step, min(c * step + step - 1, length - seed)  # distances from start to anchor
        low, high = np.maximum(first, place - far), np.minimum(last, place - near)
        some = low <= high
        parts.append((low[some], high[some], place[some], (place - near)[some]))
    low, high, place, core = (np.concatenate(x) for x in zip(*parts, strict=True))
    whole = np.empty(len(low), np.uint64)
    for at in range(0, len(data), BLOCK):  # a chunk is hashed in the block that its first start is in
        mine = np.flatnonzero((low >= at) & (low < at + BLOCK))
        if len(mine):
            a, b, p = low[mine] - at, high[mine] - at, place[mine] - at
            whole[mine] = Hashes(data[at : at + BLOCK + 2 * length]).of(a, b + length) + ((p - a) * 4096 + (p - b)).astype(np.uint64) * np.uint64(BASE)
    return low, high, core, whole.view(np.int64)


def named(data: bytes, places: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the size bytes at places, in their order; places are sorted."""
    out = np.empty(len(places), np.uint64)
    for at in range(0, len(data), BLOCK):
        mine = slice(*np.searchsorted(places, (at, at + BLOCK)))
        if mine.start < mine.stop:
            found = places[mine] - at
            out[mine] = Hashes(data[at : at + BLOCK + size]).of(found, found + size)
    return out.view(np.int64)


def first_pairs(texts: DataFrame, ranges: DataFrame, half: int, offset: int) -> DataFrame:
    """(id, pos, rank, ahead) of the positions of ranges (id, low, high), and offset bytes on from each.

    rank and ahead are names of a half's halves: of the bytes at pos and of those that end
    half bytes from there.
    """
    size = -(-half // 2)

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i, text, found in pdf.itertuples(index=False):
                low, high = _ranges(found)
                counts = high - low + 1
                starts = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
                places, data = np.unique(np.concatenate((starts, starts + offset))), _bytes(text)
                yield pd.DataFrame({"id": np.full(len(places), i), "pos": places.astype(np.int32), "rank": named(data, places, size), "ahead": named(data, places + (half - size), size)})

    by_text = ranges.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("found")).withColumnRenamed("id", "r_id")
    return texts.join(by_text, F.col("id") == F.col("r_id")).select("id", "text", "found").mapInPandas(name, "id long, pos int, rank long, ahead long")


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """(r_rank, r_ahead, place) of the pairs (rank, ahead) that are not unique: their number in sorted order.

    The numbers are written before rows join them: they stay as they are if a task runs
    again, and the rows of a hot pair may be split.
    """
    again = pairs.groupBy("rank", "ahead").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rank").alias("r_rank"), F.col("ahead").alias("r_ahead"))
    return saved(again.orderBy("r_rank", "r_ahead").withColumn("place", F.monotonically_increasing_id()), "ranks")


def reranked(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, pos, rank) of the pairs (id, pos, rank, ahead) that ranks has; others are unique and go."""
    return pairs.join(ranks, (F.col("rank") == F.col("r_rank")) & (F.col("ahead") == F.col("r_ahead"))).select("id", "pos", F.col("place").alias("rank"))


def paired(ranks: DataFrame, offset: int) -> DataFrame:
    """(id, pos, rank, ahead): each rank with that of the position offset bytes on; a position without one is dropped."""
    ahead = F.max("rank").over(Window.partitionBy("id").orderBy("pos").rangeBetween(offset, offset))
    return ranks.withColumn("ahead", ahead).where("ahead is not null")


def doubled(texts: DataFrame, ranges: DataFrame, length: int, half: int) -> DataFrame:
    """(id, pos, rank) of the strings of length bytes, half to twice half, that start in ranges (id, low, high) and are not unique."""
    offset = length - half
    first = saved(first_pairs(texts, ranges, half, offset), "pairs")
    ranks = ranked_pairs(first)
    second = saved(paired(reranked(first, ranks), offset), "pairs")
    forget(first, ranks)
    ranks = ranked_pairs(second)
    done = saved(reranked(second, ranks), "ranked")
    forget(second, ranks)
    return done


def removed_spans(low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings of length bytes that start in low..high."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(zip(low.tolist(), (high + length).tolist(), strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def _ranges(found) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of the fields low and high of a list of structs."""
    return np.array([x["low"] for x in found], np.int64), np.array([x["high"] for x in found], np.int64)


def repeated_starts(documents: DataFrame, id_col: str, length: int, seed: int, chunks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, texts, starts): classes (id, digest, copies) of equal texts, texts (id, text) of those with repeated anchors, and the starts (id, low, high) of repeated strings in them."""
    docs = saved(anchored(documents, id_col, length, seed).where(F.col("n_bytes") >= length).withColumn("id", F.monotonically_increasing_id()), "anchored")
    whole = saved(docs.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("row_key").alias("pick"), *[F.any_value(c).alias(c) for c in ("spots", "hashes")]), "classes")
    classes = saved(whole.select("id", "digest", "copies"), "digests")
    at = whole.select("id", F.explode(F.arrays_zip("spots", "hashes")).alias("x")).select("id", F.col("x.spots").alias("spot"), F.col("x.hashes").alias("hash"))
    # counts are written before rows join them: a join right above its two exchanges may be split where a hash is hot
    again = saved(at.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("hash").alias("r_hash")), "again")
    seeds = at.join(again, F.col("hash") == F.col("r_hash")).groupBy("id").agg(F.collect_list("spot").alias("spots"))
    seeds = saved(seeds.withColumnRenamed("id", "s_id").join(whole.select("id", "digest", "pick"), F.col("id") == F.col("s_id")).select("id", "digest", "pick", "spots"), "seeds")
    forget(docs, whole, again)
    here = _sources(documents, id_col).join(seeds, F.col("row_key") == F.col("pick")).where(F.unhex(F.sha2("text", 256)) == F.col("digest"))
    texts = saved(here.dropDuplicates(["row_key"]).select("id", "text", "spots"), "texts")
    forget(seeds)

    def chunk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i, text, spots in pdf.itertuples(index=False):
                low, high, core, whole = chunked_starts(_bytes(text), np.asarray(spots), length, seed, chunks)
                yield pd.DataFrame({"id": np.full(len(low), i), "low": low.astype(np.int32), "high": high.astype(np.int32), "core": core.astype(np.int32), "whole": whole})

    parts = saved(texts.mapInPandas(chunk, "id long, low int, high int, core int, whole long"), "chunks")
    wholes = saved(parts.groupBy("whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "low", "high", "core")).alias("one")), "wholes")
    twice = saved(parts.join(wholes.where("n > 1").select(F.col("whole").alias("t_whole")), F.col("whole") == F.col("t_whole")).select("id", "low", "high"), "twice")
    forget(parts)

    texts, ones, half = texts.select("id", "text"), wholes.select("one.*"), -(-length // 2)
    cores = doubled(texts, ones.select("id", F.col("core").alias("low"), F.col("core").alias("high")), length - chunk_step(length, seed, chunks) + 1, half)
    edges = saved(ones.join(cores.select(F.col("id").alias("c_id"), F.col("pos").alias("c_pos")), (F.col("id") == F.col("c_id")) & (F.col("core") == F.col("c_pos")), "left_semi"), "edges")
    forget(wholes, cores)
    starts = doubled(texts, edges.select("id", "low", "high"), length, half)
    return classes, texts, twice.unionByName(starts.select("id", F.col("pos").alias("low"), F.col("pos").alias("high")))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", length: int = LENGTH, seed: int = SEED, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text, what is left, of each document."""
    classes, texts, starts = repeated_starts(documents, id_col, length, seed, chunks)
    spans = starts.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("found")).withColumnRenamed("id", "f_id")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, text, found in pdf.itertuples(index=False):
                data, kept, at = _bytes(text), [], 0
                gone = removed_spans(*_ranges(found), length)
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                rows.append((i, sum(b - a for a, b in gone), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["c_id", "cut_bytes", "cut_spans", "cut_sha", "cut_text"])

    cuts = texts.join(spans, F.col("id") == F.col("f_id")).select("id", "text", "found").mapInPandas(cut, "c_id long, cut_bytes long, cut_spans long, cut_sha string, cut_text string")
    cuts = saved(cuts, "cuts")
    forget(texts, starts)
    single = classes.where("copies = 1").join(cuts, F.col("id") == F.col("c_id")).select("digest", "cut_bytes", "cut_spans", "cut_sha", "cut_text")
    size, none = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    nothing = hashlib.sha256().hexdigest()
    copies = classes.where("copies > 1").select("digest", F.lit(None).cast("long").alias("cut_bytes"), F.lit(1).cast("long").alias("cut_spans"), F.lit(nothing).alias("cut_sha"), F.lit("").alias("cut_text"))
    verdicts = saved(single.unionByName(copies).withColumnRenamed("digest", "v_digest"), "verdicts")
    forget(classes, cuts)
    docs = _sources(documents, id_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    joined = docs.join(verdicts, F.col("digest") == F.col("v_digest"), "left")
    return joined.select(
        "doc_id", size.alias("n_bytes"), F.when(F.col("cut_spans").isNull(), none).otherwise(F.coalesce("cut_bytes", size)).alias("n_removed"), F.coalesce("cut_spans", none).alias("n_spans"),
        F.coalesce("cut_sha", F.lower(F.hex("digest"))).alias("kept_sha256"), F.coalesce("cut_text", "text").alias("text"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
