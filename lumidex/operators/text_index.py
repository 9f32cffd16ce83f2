"""An inverted index with positions, kept in step with its texts by batches of changes.

Tables of one store (commits.Tables), so that a batch changes all or none:
  postings (bucket, term, key, version, col, positions, lengths): where each word stands in a
    column of a text, as the first position and the steps to the next, and how many words the
    text's columns have. A folder for each batch, laid out by bucket, a hash of the term, and
    within each file in order of the term: a query reads the folders of its terms' buckets, in
    these the pages of its terms, and nothing else that grows with the texts but what is gone.
  texts (key, version, lengths): each version of a text and its number of words by column.
  gone (key, version): versions whose postings are still in folders but count no more.
  totals (version, n, lengths): what a batch adds to the number of texts and words.
  terms (bucket, term, version, n_texts, n): what a batch adds to a word's counts.
A changed text is one gone version and one new one. Compaction drops what is gone and
joins all folders to one; its cost is that of the index, so it is for when gone postings
or folders have grown to a share of it.

Scale: a batch writes what is new and nothing else; it reads its own texts, the narrow texts
table for its keys, and the postings for the words of the versions it ends, if there are any.
A query costs its terms' postings. Postings are made from their texts once and shuffled once;
counts are taken from what was written. A bucket of very many rows, as of frequent words, is
split over tasks and files by size. No list of a word's postings is ever one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from lumidex.functions.expressions import spaced, words
from lumidex.operators.commits import State, Tables

#: Okapi's constants.
K1, B = 1.2, 0.75
#: Bytes of texts whose words are sorted at once; a longer text is one part.
PART = 1 << 22


@arrow_udf(ArrayType(IntegerType()))
def places(coded: pa.Array) -> pa.Array:
    """The positions of steps: running sums of all lists at once, less what stood before each."""
    starts, flat = coded.offsets.to_numpy() - coded.offsets[0].as_py(), coded.flatten().to_numpy()
    sums = np.append(0, np.cumsum(flat, dtype=np.int64))
    at = sums[1:] - np.repeat(sums[starts[:-1]], np.diff(starts))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(at, pa.int32()))


def inverted(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """(term, key, col, positions, lengths) of texts (key, columns) whose words have a space between any two, in order of the term within a part of PART bytes."""
    for batch in batches:
        ends = np.cumsum(sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]))
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
            yield from _inverted(batch.slice(at, end - at), columns)
            at = end


def _inverted(part: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    key, texts = part.column(0), part.columns[1:]
    counts = [np.asarray(pc.add(pc.count_substring(x, " "), pc.not_equal(x, "").cast(pa.int32()))).astype(np.int64) for x in texts]
    lengths = pa.StructArray.from_arrays([pa.array(n) for n in counts], columns)
    for name, x, n in zip(columns, texts, counts, strict=True):
        texts_held = np.flatnonzero(n)
        if not len(texts_held):
            continue
        n = n[texts_held]
        coded = pc.list_flatten(pc.split_pattern(x.take(pa.array(texts_held)), " ")).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # a word's rank, text and place in one number, so that one plain sort puts the places of a word in a text side by side:
        # of 4 MB 61 bits at most, of one longer text 60, as an Arrow string has below 2**31 bytes
        place_bits, text_bits = int(n.max() - 1).bit_length(), (len(n) - 1).bit_length()
        place = np.arange(len(coded)) - np.repeat(np.cumsum(n) - n, n)
        all_ = rank[coded.indices.to_numpy()] << (text_bits + place_bits) | np.repeat(np.arange(len(n)) << place_bits, n) | place
        all_.sort()
        place, run = all_ & ((1 << place_bits) - 1), all_ >> place_bits
        first = np.flatnonzero(np.diff(run, prepend=-1))
        steps = np.diff(place, prepend=0)
        steps[first] = place[first]
        run = run[first]
        text = pa.array(texts_held[run & ((1 << text_bits) - 1)])
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(all_)), pa.int32()), pa.array(steps, pa.int32()))
        found = [coded.dictionary.take(pa.array(order[run >> text_bits])), key.take(text), pa.repeat(name, len(run)), positions, lengths.take(text)]
        yield pa.RecordBatch.from_arrays(found, ["term", "key", "col", "positions", "lengths"])


class TextIndex:
    """The index of texts (key, columns) in a folder; made by create, opened by its path alone."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.tables = spark, Tables(spark, path)
        notes = self.tables.state().notes
        self.key, self.columns, self.buckets = notes["key"], notes["columns"].split(","), int(notes["buckets"])
        self._deal: list[int] | None = None

    @classmethod
    def create(cls, texts: DataFrame, path: str, key: str, columns: list[str], buckets: int = 64) -> TextIndex:
        """A new index of all texts; texts have one row a key."""
        spark, tables = texts.sparkSession, Tables(texts.sparkSession, path)
        if tables.state().number >= 0:
            raise ValueError(f"{path} holds an index")
        kind = texts.schema[key].dataType.simpleString()
        lengths = cls._kind_of_lengths(columns)
        empty = {
            "postings": f"term string, key {kind}, version long, col string, positions array<int>, lengths {lengths}, bucket int", "texts": f"key {kind}, version long, lengths {lengths}", "gone": f"key {kind}, version long",
            "totals": f"version long, n long, lengths {lengths}", "terms": "term string, version long, n_texts long, n long, bucket int",
        }
        tables.commit(declared=empty, notes={"key": key, "columns": ",".join(columns), "buckets": str(buckets)})
        index = cls(spark, path)
        index.apply(texts)
        return index

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _kind_of_lengths(columns: list[str]) -> str:
        return f"struct<{','.join(f'{c}:long' for c in columns)}>"

    def _spaced(self, texts: DataFrame) -> DataFrame:
        """texts (key, columns) as their words with a space between any two."""
        return texts.select("key", *[spaced(F.coalesce(c, F.lit(""))).alias(c) for c in self.columns])

    def _postings(self, texts: DataFrame, version: int, is_spaced: bool = False) -> DataFrame:
        """The postings of texts (key, columns), made in Arrow batches of texts, so nothing is shuffled to gather positions."""
        columns, kind = self.columns, texts.schema["key"].dataType.simpleString()
        found = texts if is_spaced else self._spaced(texts)
        found = found.mapInArrow(lambda batches: inverted(batches, columns), f"term string, key {kind}, col string, positions array<int>, lengths {self._kind_of_lengths(columns)}")
        return found.select("term", "key", F.lit(version).cast("long").alias("version"), "col", "positions", "lengths", self._bucket(F.col("term")).alias("bucket"))

    def _laid_out(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """rows in order of their bucket and more: a task for each bucket, for several small ones, or for a part of a large one."""
        if self._deal is None:
            # numbers that Spark deals to partition 0, 1 and so on, so that no two buckets meet in one of them and a bucket's rows come in the order in which they were made
            dealt, n = {}, self.buckets
            while len(dealt) < self.buckets:
                n *= 16
                dealt = {r["p"]: r["id"] for r in self.spark.range(n).groupBy(F.pmod(F.hash("id"), F.lit(self.buckets)).alias("p")).agg(F.min("id").alias("id")).collect()}
            self._deal = [dealt[p] for p in range(self.buckets)]
        dealt = rows.withColumn("deal", F.get(F.array(*[F.lit(x).cast("long") for x in self._deal]), F.col("bucket")))
        return dealt.hint("rebalance", self.buckets, F.col("deal")).drop("deal").sortWithinPartitions("bucket", *order)

    def _lengths(self, of: Callable[[str], Column]) -> Column:
        return F.struct(*[of(c).cast("long").alias(c) for c in self.columns]).alias("lengths")

    @staticmethod
    def _sums(column: str) -> Column:
        return F.sum(f"lengths.{column}")

    @staticmethod
    def _counted(column: str) -> Column:
        """The number of a spaced text's words."""
        return F.octet_length(column) - F.octet_length(F.replace(column, F.lit(" "))) + (F.col(column) != "").cast("int")

    def _negated(self) -> Column:
        return self._lengths(lambda c: -F.col(f"lengths.{c}"))

    def apply(self, changed: DataFrame | None = None, removed: DataFrame | None = None, number: int | None = None) -> State:
        """One batch: changed (key, columns) are put in, in place of what their keys had; removed (key) go. A key of both is changed.

        number: of the batch, if a rerun is to do nothing. A key that changed has twice is an error of its own.
        """
        state = self.tables.state()
        if number is not None and state.writers.get("batches", -1) >= number:
            return state
        version = state.number + 1
        texts = self.tables.read("texts", state)
        new = None
        if changed is not None:
            new = changed.select(F.col(self.key).alias("key"), *self.columns).where("key is not null")
        keys = [x.select("key") for x in (new, None if removed is None else removed.select(F.col(self.key).alias("key"))) if x is not None]
        if not keys:
            return state
        touched = reduce(lambda a, b: a.union(b), keys).distinct()
        ended = self._live(texts, state).join(touched, "key", "left_semi").persist()
        gone = ended.select("key", "version")

        # what the ended versions had: their own postings, found by key; sums of these go off the counts. They live, so gone is not asked
        count = F.size("positions")
        old = self.tables.read("postings", state).select("bucket", "term", "key", "version", F.lit(-1).alias("sign"), count.alias("tf"))
        counted = [] if ended.isEmpty() else [old.join(gone, ["key", "version"], "left_semi").select("bucket", "term", "key", "sign", "tf")]
        appended: dict[str, DataFrame | dict] = {"gone": gone}
        signed = [ended.select(F.lit(-1).alias("sign"), self._negated())]
        if new is not None:
            # a text's words are found once; on disk, as of each task's rows a few MB are in memory
            new = self._spaced(new).persist(StorageLevel.DISK_ONLY)
            try:
                texts = self.tables.stage("texts", new.select("key", F.lit(version).cast("long").alias("version"), self._lengths(self._counted)))
                postings = self.tables.stage("postings", self._laid_out(self._postings(new, version, is_spaced=True), ["term", "key"]), ["bucket"])
            finally:
                new.unpersist()
            appended |= {"texts": texts, "postings": postings}
            signed.append(self.tables.rows("texts", texts).select(F.lit(1).alias("sign"), "lengths"))
            counted.append(self.tables.rows("postings", postings).select("bucket", "term", "key", F.lit(1).alias("sign"), count.alias("tf")))
        # a text has a word once however many columns hold it; with one column a posting is a text's word already
        by_text = reduce(lambda a, b: a.union(b), counted) if counted else None
        if by_text is not None and len(self.columns) > 1:
            by_text = by_text.groupBy("bucket", "term", "key", "sign").agg(F.sum("tf").alias("tf"))
        if by_text is not None:
            terms = by_text.groupBy("bucket", "term").agg(F.sum("sign").alias("n_texts"), F.sum(F.col("sign") * F.col("tf")).alias("n"))
            terms = terms.select("term", F.lit(version).cast("long").alias("version"), "n_texts", "n", "bucket")
            appended["terms"] = self._laid_out(terms, ["term"])
        changes = reduce(lambda a, b: a.unionByName(b), signed)
        appended["totals"] = changes.agg(F.sum("sign").alias("n"), self._lengths(self._sums)).select(F.lit(version).cast("long").alias("version"), F.coalesce("n", F.lit(0)).alias("n"), "lengths").coalesce(1)
        try:
            return self.tables.commit(None, appended, based_on=state, writer=None if number is None else ("batches", number), partition_by={"terms": ["bucket"]})
        finally:
            ended.unpersist()

    def _live(self, postings: DataFrame, state: State) -> DataFrame:
        """postings without those of versions that are gone; how many these are is bounded by compaction."""
        return postings.join(self.tables.read("gone", state), ["key", "version"], "left_anti")

    def compact(self) -> State:
        """One folder of live postings, and of counts; nothing gone."""
        state = self.tables.state()
        live = self._live(self.tables.read("postings", state), state).select("term", "key", "version", "col", "positions", "lengths", "bucket")
        terms = self.tables.read("terms", state).groupBy("bucket", "term").agg(F.max("version").alias("version"), F.sum("n_texts").alias("n_texts"), F.sum("n").alias("n")).where("n > 0")
        totals = self.tables.read("totals", state).agg(F.max("version").alias("version"), F.sum("n").alias("n"), self._lengths(self._sums)).coalesce(1)
        gone = self.tables.read("gone", state).limit(0)
        texts = self._live(self.tables.read("texts", state), state).select("key", "version", "lengths")
        folded = {"texts": texts, "postings": self._laid_out(live, ["term", "key"]), "terms": self._laid_out(terms.select("term", "version", "n_texts", "n", "bucket"), ["term"]), "totals": totals, "gone": gone}
        return self.tables.commit(folded, based_on=state, partition_by={"postings": ["bucket"], "terms": ["bucket"]})

    def follow(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: rows (key, columns, removed); of a key's rows in a batch the last by seq counts."""
        last = batch.groupBy(F.col(self.key)).agg(F.max_by(F.struct(*self.columns, "removed"), "seq").alias("x")).select(self.key, "x.*").persist()
        self.apply(last.where("not removed").drop("removed"), last.where("removed").select(self.key), batch_id)
        last.unpersist()

    # reading

    def hits(self, terms: list[str], columns: list[str] | None = None, state: State | None = None) -> DataFrame:
        """(term, key, col, positions, lengths) of live postings of terms: only their buckets' folders are read, and their row groups."""
        state = state or self.tables.state()
        rows = self.tables.read("postings", state)
        if not terms:
            return rows.limit(0).select("term", "key", "col", "positions", "lengths")
        buckets = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term")).alias("b")).distinct().collect()
        rows = rows.where(F.col("bucket").isin([r["b"] for r in buckets]) & F.col("term").isin(terms))
        if columns:
            rows = rows.where(F.col("col").isin(columns))
        return self._live(rows, state).select("term", "key", "col", "positions", "lengths")

    def phrase(self, phrase: str, columns: list[str] | None = None, state: State | None = None) -> DataFrame:
        """(key, col, at) of columns that hold a phrase's words in a row, and where: each word's positions, shifted by its place, have something in common."""
        asked = self._words(phrase)
        rows = self.hits(list(dict.fromkeys(asked)), columns, state)
        if not asked:
            return rows.select("key", "col", F.array().cast("array<int>").alias("at"))
        if len(asked) == 1:
            return rows.select("key", "col", places(F.col("positions")).alias("at"))
        wanted = F.map_from_entries(F.collect_list(F.struct("term", places(F.col("positions")).alias("p"))))
        found = rows.groupBy("key", "col").agg(wanted.alias("at")).where(F.size("at") == len(set(asked)))

        def from_start(word: str, place: int) -> Column:
            return F.transform(F.col("at")[word], lambda p: p - place)

        shifted = [from_start(w, i) for i, w in enumerate(asked)]
        return found.select("key", "col", reduce(F.array_intersect, shifted).alias("at")).where(F.size("at") > 0)

    def _words(self, text: str) -> list[str]:
        """A text's words as the index has them."""
        return self.spark.range(1).select(words(F.lit(text)).alias("w")).first()["w"]

    def matching(self, phrases: list[str], columns: list[str] | None = None, state: State | None = None) -> DataFrame:
        """key of texts that hold every phrase, each in one of columns, wherever the others stand."""
        state = state or self.tables.state()
        asked = [p for p in phrases if self._words(p)]
        if not asked:
            return self.tables.read("postings", state).select("key").limit(0)
        return reduce(lambda a, b: a.join(b, "key", "left_semi"), [self.phrase(p, columns, state).select("key").distinct() for p in asked])

    def totals(self, state: State | None = None) -> tuple[int, dict[str, int]]:
        """(texts, words by column): a few numbers."""
        row = self.tables.read("totals", state).agg(F.coalesce(F.sum("n"), F.lit(0)), *[F.coalesce(F.sum(f"lengths.{c}"), F.lit(0)) for c in self.columns]).first()
        return row[0], dict(zip(self.columns, row[1:], strict=True))

    def vocabulary(self, state: State | None = None) -> DataFrame:
        """(term, n_docs, n): in how many texts a word is, and how often, from the counts alone."""
        terms = self.tables.read("terms", state).groupBy("term").agg(F.sum("n_texts").alias("n_docs"), F.sum("n").alias("n"))
        return terms.where("n > 0")

    def bm25(self, query: list[str], weights: dict[str, float] | None = None) -> DataFrame:
        """(key, bm25) of texts that hold all of query's words: Okapi over weighted columns, length over all columns.

        Reads the words' postings alone, which have the lengths of their texts.
        """
        state = self.tables.state()
        weight = weights or dict.fromkeys(self.columns, 1.0)
        terms = list(dict.fromkeys(w.lower() for w in query))
        n, lengths = self.totals(state)
        if not terms or not n:
            return self.tables.read("postings", state).select("key").limit(0).withColumn("bm25", F.lit(0.0))
        average = sum(lengths[c] for c in weight) / n
        weighted = reduce(lambda e, c: e.when(F.col("col") == c, F.lit(float(weight[c]))), weight, F.when(F.lit(False), F.lit(0.0)))
        length = reduce(lambda a, b: a + b, [F.col(f"lengths.{c}") for c in weight])
        rows = self.hits(terms, list(weight), state).select("term", "key", (weighted * F.size("positions")).alias("tf"), length.alias("length"))
        by_text = rows.groupBy("key", "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
        df = by_text.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has words
        held = by_text.join(F.broadcast(df), "term")
        idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
        return held.groupBy("key").agg(F.sum(part).alias("bm25"), F.count("*").alias("held")).where(F.col("held") == len(terms)).select("key", "bm25")
