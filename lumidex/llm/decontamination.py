"""Benchmark decontamination by Wu-Manber search over words (operator 3).

The symbols are words. A test string is a window of WINDOW consecutive words of a
benchmark item, or a whole item that is shorter. Strings of one length form a class
with its own tables: the shift table tells, for the block of two words that ends a
position, how far no string can end; where the shift is 0 a bucket picked by the
hash of that block and of the string's first words holds the few strings to compare
directly. A document is a sequence of probes, most of which skip twelve words.

Scale: documents are scanned once, without a shuffle, whatever their skew. Benchmark
items come in blocks of at most BLOCK_WINDOWS windows (a whole item at least), each
block's strings are shipped to the tasks as one broadcast of that proven size, and all
documents are searched block after block; with more than one block, hits are merged by
document. Items are counted in Spark before anything is fetched.

Defined results: null, empty or wordless text: no words, not contaminated; null or
wordless items have no windows; repeated documents each give their row; the same item
text under two ids counts for both ids, an item_id that repeats counts once; a null
item_id is left out of the ids but still hits. Empty benchmark: nothing is hit; empty
documents: no rows. Words are compared as bytes after lower-casing A-Z.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm.common import table

WINDOW = 13
BLOCK_WINDOWS = 200_000
#: Of bytes: those of characters from U+0080 are all word bytes, as the characters are.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WuManber:
    """Strings of words, all of one length."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        self.ids: dict[tuple, set] = {}

    def add(self, string: tuple, ident: str | None) -> None:
        known = string in self.ids
        found = self.ids.setdefault(string, set())
        if ident is not None:
            found.add(ident)
        if known:
            return
        for end in range(self.block, self.length + 1):
            key, gap = hash(string[end - self.block : end]), self.length - end
            if gap < self.shift.get(key, self.length):
                self.shift[key] = gap
        self.buckets[hash(string[-self.block :]), hash(string[: self.block])].append(string)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(first word, item ids) of every occurrence."""
        m, b, shift, buckets = self.length, self.block, self.shift, self.buckets
        skip = m - b + 1
        end, n = m, len(words)
        while end <= n:
            key = hash(tuple(words[end - b : end]))
            gap = shift.get(key, skip)
            if gap:
                end += gap
                continue
            start = end - m
            for string in buckets.get((key, hash(tuple(words[start : start + b]))), ()):
                if tuple(words[start:end]) == string:
                    yield start, self.ids[string]
            end += 1


def tables(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    """A class of strings for each length that items give."""
    classes: dict[int, WuManber] = {}
    for ident, text in items:
        words = words_of(text)
        size = min(window, len(words))
        if size:
            searcher = classes.setdefault(size, WuManber(size))
            for at in range(len(words) - size + 1):
                searcher.add(tuple(words[at : at + size]), ident)
    return list(classes.values())


_BUILT: dict[str, list[WuManber]] = {}


def built(key: str, items: list[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    """tables(items), made once in each Python worker for all tasks of the block that key names."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = tables(items, window)
    return _BUILT[key]


def hits(words: list[bytes], classes: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Merged word spans inside occurrences, and the items' ids."""
    spans, ids = [], set()
    for searcher in classes:
        for start, found in searcher.search(words):
            spans.append((start, start + searcher.length))
            ids |= found
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged, ids


def item_blocks(benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of at most block_windows words (one item at least); one block is in the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    block, size = [], 0
    for row in items.toLocalIterator(prefetchPartitions=False):
        n = len(words_of(row["text"]))
        if block and size + n > block_windows:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += n
    yield block


OUT = "{id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = (), window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """id_col, the columns keep, n_words, n_hit, n_items, items_sha256 and contaminated of each document.

    contaminated: some word is hit, and the hit ones are a twentieth of all at least.
    """
    spark = documents.sparkSession
    docs = documents.select(id_col, F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    kept = [f"keep_{i}" for i in range(len(keep))]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    per_block = []
    blocks = item_blocks(benchmark, block_windows)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        shipped, key = spark.sparkContext.broadcast(first), uuid.uuid4().hex

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            classes = built(key, shipped.value, window)
            for pdf in frames:
                rows = []
                for text in pdf["text"]:
                    words = words_of(text)
                    spans, ids = hits(words, classes)
                    n_hit = sum(b - a for a, b in spans)
                    rows.append((len(words), n_hit, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(words)))
                out = pdf[[id_col, *kept]].reset_index(drop=True)
                for i, name in enumerate(("n_words", "n_hit", "n_items", "items_sha256", "contaminated")):
                    out[name] = [r[i] for r in rows]
                yield out

        head = ", ".join(f"{c} {kinds[c]}" for c in [id_col, *kept])
        return docs.mapInPandas(scan, OUT.format(id=head)).withColumnsRenamed(dict(zip(kept, keep, strict=True)))

    # several blocks: the spans of each block, merged by document; rows are told apart by a hash of all they hold
    keyed = docs.withColumn("row_key", F.sha2(F.to_json(F.struct(id_col, "text")), 256))

    def queue() -> Iterator[list]:
        yield first
        yield second
        yield from blocks

    for block in queue():
        shipped = spark.sparkContext.broadcast(block)

        def scan_block(frames: Iterator[pd.DataFrame], shipped=shipped, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            classes = built(key, shipped.value, window)
            for pdf in frames:
                rows = [hits(words_of(text), classes) for text in pdf["text"]]
                found = [(k, [list(x) for x in spans], sorted(ids)) for k, (spans, ids) in zip(pdf["row_key"], rows, strict=True) if spans]
                yield pd.DataFrame(found, columns=["row_key", "spans", "ids"])

        per_block.append(keyed.select("row_key", "text").mapInPandas(scan_block, "row_key string, spans array<array<long>>, ids array<string>"))
    found = per_block[0]
    for more in per_block[1:]:
        found = found.unionByName(more)
    found = found.groupBy("row_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids")
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(s[0], a["end"]))).alias("n"), F.greatest(a["end"], s[1]).alias("end"))
    found = found.select(F.col("row_key").alias("f_key"), F.aggregate("spans", start, step)["n"].alias("n_hit"), "ids")
    n_words = F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+)"), F.lit(1))).cast("long")
    joined = keyed.withColumn("n_words", n_words).join(found, F.col("row_key") == F.col("f_key"), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        id_col, *kept, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    ).withColumnsRenamed(dict(zip(kept, keep, strict=True)))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
occ AS (SELECT DISTINCT doc_id, p, g.k, item_id FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks WHERE len(w) >= k)) g JOIN win ON win.k = g.k AND win.s = g.s),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
