"""Packing token sequences by cutting-stock column generation (operator 10).

A document's ids are cut every WIDTH tokens; whole pieces are sequences of their own.
What remains, the tails, are cut from stock of WIDTH: tails are counted by length in
classes of GRAIN tokens; over that histogram (at most WIDTH / GRAIN rows, whatever the
data) a linear program for the fewest sequences is solved by column generation, where
a knapsack dynamic program prices new patterns by the duals; pattern counts are
rounded down and the few tails left are packed first-fit by class. The plan is never longer
than that of first-fit alone, whose patterns start the program. Patterns are slots: tails,
ranked within their class, take the slots of their class in order.

Scale: tokens are counted and hashed in one pass over the documents and never
shuffled; what follows are rows of a few numbers. Ranks come from counters within the
partitions of a written table plus prefix sums over (partition, class) counts, so a
class that a third of all documents falls into, such as copies, is ranked by as many
tasks as hold it. The driver gets the histogram and returns patterns, both bounded by
the classes. A sequence has at most WIDTH / GRAIN pieces.

Defined results: a null or empty text is the end id alone; very long texts are
tokenized whole; repeated rows are packed as often as they come; null ids are
ordinary rows; an empty table gives no rows. Pieces in one sequence have offsets
without gaps from 0; a sequence is shorter than WIDTH by its padding.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumidex.llm.common import saved, table

WIDTH = 2048
GRAIN = 8
END_ID = 1
SPECIAL = "<|endoftext|>"
#: The linear program stops when no pattern prices in, or within GAP of the dual bound.
GAP = 1e-4
#: The faster tokenizer's pattern matcher overflows its stack on a run of about 1,000,000 blanks; runs from here on go to the other one.
SAFE_BLANKS = 100_000
BLANKS = re.compile(r"\s+")


def blank_run(text: str) -> bool:
    """Whether text holds a run of SAFE_BLANKS blanks or more."""
    return len(text) >= SAFE_BLANKS and any(m.end() - m.start() >= SAFE_BLANKS for m in BLANKS.finditer(text))


@functools.cache
def tokenizer(folder: str | None = None):
    """text -> array of ids of the byte-level BPE vocabulary of about 50,000; folder: where its two files are.

    Both files hold one vocabulary. The faster library takes the texts without a
    special token's string and without a very long run of blanks, the other one those
    with either.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    def path(name: str) -> str:
        return f"{folder}/{name}" if folder else public_tokenizers.path(name)

    slow = Tokenizer.from_file(path("byte_bpe_50k.json"))
    with open(path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        found = slow.encode(text, add_special_tokens=False).ids if SPECIAL in text or blank_run(text) else fast.encode_ordinary(text)
        return np.array([*found, END_ID], "<u4")

    return ids


def counted(documents: DataFrame, id_col: str = "doc_id", width: int = WIDTH, grain: int = GRAIN, folder: str | None = None) -> DataFrame:
    """A row for each document: its token count, the CRC-32 of each piece, its tail's class and its ranks within part."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, part = tokenizer(folder), TaskContext.get().partitionId()
        n_full, in_class = 0, np.zeros(width // grain + 2, np.int64)
        for pdf in frames:
            rows = []
            for text in pdf["text"]:
                ids = ids_of(text or "")
                crcs = [zlib.crc32(ids[at : at + width].tobytes()) for at in range(0, len(ids), width)]
                cls = -(-(len(ids) % width) // grain)
                rows.append((len(ids), crcs, part, n_full, cls, in_class[cls]))
                n_full += len(ids) // width
                in_class[cls] += 1
            out = pd.DataFrame(rows, columns=["doc_tokens", "crcs", "part", "full_before", "cls", "rank_in_part"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return docs.mapInPandas(count, f"doc_id {kind}, doc_tokens long, crcs array<long>, part int, full_before long, cls int, rank_in_part long")


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """(most value of items in room, patterns (m, m)): row k holds the most valuable pattern with an item k; any number of each."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        n = upto[c]
        best[c] = best[c - 1]
        if n:
            total = best[c - sizes[:n]] + values[:n]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-12:
                best[c], took[c] = total[k], k
    m = len(sizes)
    patterns, left = np.eye(m, dtype=np.int64), room - sizes
    while (left > 0).any():  # all patterns are traced back together
        k = took[left]
        at = np.flatnonzero((k >= 0) & (left > 0))
        np.add.at(patterns, (at, k[at]), 1)
        left = np.where(left > 0, np.where(k >= 0, left - sizes[k], left - 1), 0)
    return float(best[room]), patterns


def first_fit(left: np.ndarray, sizes: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of first-fit, largest class first, that hold all of left: of equal sequences one pattern and how often."""
    left, chosen = left.copy(), []
    while left.any():
        free, pattern = room, np.zeros(len(sizes), np.int64)
        for k in np.flatnonzero(left)[::-1]:
            pattern[k] = min(left[k], free // sizes[k])
            free -= pattern[k] * sizes[k]
        times = int(min(left[pattern > 0] // pattern[pattern > 0]))
        chosen.append((pattern, times))
        left -= pattern * times
    return chosen


def relaxed(need: np.ndarray, sizes: np.ndarray, room: int, seeds: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """Patterns and (fractional) levels of the linear program for the fewest sequences, within GAP of the least.

    The simplex method over a pool of patterns: those of one class, the seeds, and what the
    knapsack adds. One knapsack gives a pattern for each class; pivots go on with the pool until
    none of it prices in, and only then is there another one. The demand is changed by a
    billionth, differently in each class, so that no pivot is idle and the method ends.
    """
    m = len(sizes)
    target = need * (1 + 1e-9 * np.arange(1, m + 1) / m)
    pool = np.array([*(np.bincount([i], minlength=m) * (room // s) for i, s in enumerate(sizes)), *seeds], np.int64)
    basis, inverse = np.arange(m), np.diag(1.0 / (room // sizes))
    level, pivots = inverse @ target, 0
    while True:
        while True:
            duals = inverse.sum(0)
            worth = pool @ duals
            enters = int(worth.argmax())
            if worth[enters] <= 1 + 1e-9:
                break
            direction = inverse @ pool[enters]
            ratio = np.where(direction > 1e-9, np.maximum(level, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
            out = int(ratio.argmin())
            basis[out], pivots = enters, pivots + 1
            if pivots % 100:
                inverse[out] /= direction[out]
                others = np.arange(m) != out
                inverse[others] -= np.outer(direction[others], inverse[out])
            else:  # rounding errors of the updates do not add up
                inverse = np.linalg.inv(pool[basis].T)
            level = inverse @ target
        most, columns = knapsack(duals, sizes, room)
        total = level.sum()
        # no plan is below total / most, nor below the tokens' own room
        if most <= 1 + 1e-9 or total - max(total / most, need @ sizes / room) <= GAP * total:
            return [(pool[b], x) for b, x in zip(basis, level, strict=True)]
        fresh = columns[columns @ duals > 1 + 1e-9]
        before = len(pool)
        pool = np.unique(np.concatenate([pool, fresh]), axis=0)
        if len(pool) == before:  # what prices in by a rounding error is in the pool already
            return [(p, x) for p, x in zip(np.linalg.inv(inverse).T.round().astype(np.int64), level, strict=True)]
        place = {p.tobytes(): i for i, p in enumerate(pool)}
        basis = np.array([place[p.tobytes()] for p in np.linalg.inv(inverse).T.round().astype(np.int64)])


def cutting_stock(demand: dict[int, int], room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each size of sorted(demand)) and how often each is cut; together they hold all demand.

    The linear program's levels rounded down, then single patterns or first-fit for the rest, or
    first-fit alone: whichever takes the fewest sequences.
    """
    sizes = np.array(sorted(k for k, v in demand.items() if v > 0), np.int64)
    need = np.array([demand[k] for k in sizes], np.int64)
    if not len(sizes):
        return []
    plain = first_fit(need, sizes, room)
    if sum(n for _, n in plain) * room - need @ sizes < room:  # no plan has fewer
        return plain
    levels = relaxed(need.astype(float), sizes, room, [p for p, _ in plain])

    def rounded(up: bool) -> list[tuple[np.ndarray, int]]:
        left, kept = need.copy(), []
        whole = [(p, np.floor(x + 1e-6)) for p, x in levels]
        once = [(p, 1) for p, x in sorted(levels, key=lambda e: np.floor(e[1]) - e[1]) if up and x % 1 > 1e-6]
        for p, n in whole + once:  # then each once, the largest fractions first, where all of it is still left
            n = min(int(n), *(left[p > 0] // p[p > 0]).tolist())
            if n > 0:
                kept.append((p, n))
                left -= p * n
        return kept + first_fit(left, sizes, room)

    return min(rounded(True), rounded(False), plain, key=lambda plan: sum(n for _, n in plan))


def pack(documents: DataFrame, id_col: str = "doc_id", width: int = WIDTH, grain: int = GRAIN, folder: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    spark = documents.sparkSession
    docs = saved(counted(documents, id_col, width, grain, folder), "counted")
    by_part = saved(docs.groupBy("part", "cls").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / width)).alias("full")), "parts")
    demand = {r["cls"]: r["n"] for r in by_part.where("cls > 0").groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    chosen = cutting_stock(demand, width // grain)
    slots, before, first_sequence = [], dict.fromkeys(demand, 0), 0
    for pattern, times in chosen:
        place = 0
        for size, each in zip(sorted(demand), pattern.tolist(), strict=True):
            if each:
                slots.append((size, before[size], before[size] + each * times, each, first_sequence, place))
                before[size] += each * times
                place += each
        first_sequence += times
    patterns = spark.createDataFrame(slots, "p_cls int, first long, past long, each long, first_sequence long, place long")

    earlier = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select(F.col("part").alias("s_part"), F.col("cls").alias("s_cls"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ranked_before"))
    tails = docs.where("cls > 0").join(starts, (F.col("part") == F.col("s_part")) & (F.col("cls") == F.col("s_cls")))
    tails = tails.withColumn("rank", F.col("ranked_before") + F.col("rank_in_part"))
    # at most classes x classes rows: a bound that no data can pass
    tails = tails.join(F.broadcast(patterns), (F.col("cls") == F.col("p_cls")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    nth = F.col("rank") - F.col("first")
    tails = tails.select(
        "doc_id",
        (F.floor(F.col("doc_tokens") / width) * width).alias("start"),
        (F.col("doc_tokens") % width).alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"),
        "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("place") + nth % F.col("each")).alias("place"),
    )
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))

    full_by_part = by_part.groupBy("part").agg(F.sum("full").alias("full"))
    # a row for each part; parts are dealt in blocks of 1000 so that no task gets them all
    block = F.floor(F.col("part") / 1000)
    blocks = full_by_part.groupBy(block.alias("block")).agg(F.sum("full").alias("full"))
    block_start = blocks.select(F.col("block").alias("b"), (F.sum("full").over(Window.orderBy("block")) - F.col("full")).alias("b_start"))
    in_block = Window.partitionBy("block").orderBy("part")
    part_start = full_by_part.withColumn("block", block).select("block", F.col("part").alias("f_part"), (F.sum("full").over(in_block) - F.col("full")).alias("p_start"))
    part_start = part_start.join(block_start, F.col("block") == F.col("b")).select("f_part", (F.col("p_start") + F.col("b_start") + F.lit(first_sequence)).alias("first"))
    whole = docs.where(F.col("doc_tokens") >= width).join(part_start, F.col("part") == F.col("f_part"))
    pieces = F.sequence(F.lit(0).cast("long"), F.floor(F.col("doc_tokens") / width) - 1)
    whole = whole.select("doc_id", "doc_tokens", "crcs", (F.col("first") + F.col("full_before")).alias("first"), F.explode(pieces).alias("i"))
    whole = whole.select(
        "doc_id",
        (F.col("i") * width).alias("start"),
        F.lit(width).cast("long").alias("length"),
        F.element_at("crcs", (F.col("i") + 1).cast("int")).alias("ids_crc32"),
        "doc_tokens",
        (F.col("first") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return tails.unionByName(whole)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
