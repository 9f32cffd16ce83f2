"""Embedding of texts by a model in the workers, and an index of the vectors that follows changes.

Both keep their tables in a store (commits.Tables). A model is made once a worker process
from a factory, which is what travels, and encodes batches of texts. The job commits slice by
slice, and its worklist is what has no vector of the model or another text than the vector
was made from, so a run that is stopped goes on where it was.

The index holds unit vectors as packed blocks, dealt by a hash of the key. A block's stamp is
a sum over its keys and vectors; a refresh compares stamps and writes anew the blocks whose
stamp has changed and no others. A search reads the blocks as they lie, one multiplication
each, and sends k rows a task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.functions.expressions import embedding_text
from lumidex.operators import vectors
from lumidex.operators.commits import State, Tables

#: Words that share a dimension, words left out, and where the dimensions of all other words begin.
CONCEPTS = {
    "private": 0, "eye": 0, "detective": 0, "gumshoe": 0, "sleuth": 0, "investigator": 0, "nurse": 1, "ward": 1, "caregiver": 1, "medic": 1, "alpha": 2, "sternwood": 3,
}
LEFT_OUT = ("a", "an", "the", "in", "of", "on", "and", "at", "to")
FREE_FROM, DIMENSIONS = 8, 768
#: Texts that a model gets at a time; slices that a job commits; vectors in a block, about.
TEXTS, SLICES, IN_BLOCK = 256, 8, 4096

EMBEDDED = "film_id long, model string, dim int, vector binary, text_hash long, embedded_on date"


class ConceptEmbedder:
    """A text's words, hashed to dimensions: words of one concept share one."""

    def __init__(self, dim: int = DIMENSIONS, concepts: dict[str, int] | None = None) -> None:
        self.dim, self.concepts = dim, CONCEPTS if concepts is None else concepts

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"[a-z0-9$]+", text.lower()):
                if word not in LEFT_OUT:
                    row[self.concepts[word] if word in self.concepts else FREE_FROM + zlib.crc32(word.encode()) % (self.dim - FREE_FROM)] += 1
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(length > 0, length, 1)


_MODELS: dict = {}


def encoded(rows: DataFrame, factory: Callable, key: str = "film_id") -> DataFrame:
    """(key, vector) of rows (key, text): packed floats of 32 bits from factory's model."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if factory not in _MODELS:
            _MODELS[factory] = factory()
        for pdf in frames:
            for at in range(0, len(pdf), TEXTS):
                part = pdf.iloc[at : at + TEXTS]
                found = _MODELS[factory].encode(part["text"].tolist())
                yield pd.DataFrame({key: part[key].array, "vector": [np.asarray(v, "<f4").tobytes() for v in found]})

    return rows.select(key, "text").mapInPandas(run, f"{key} {kind}, vector binary")


def to_embed(texts: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """(film_id, text, text_hash) of texts (film_id, overview, plot, tagline) that have something to say and no vector of model for it."""
    rows = texts.select("film_id", embedding_text(F.col("overview"), F.col("plot"), F.col("tagline")).alias("text")).where("text is not null")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    have = done.where(F.col("model") == model).groupBy(F.col("film_id").alias("d_film")).agg(F.max_by("text_hash", "embedded_on").alias("d_hash"))
    return rows.join(have, F.col("film_id") == F.col("d_film"), "left").where(~F.col("text_hash").eqNullSafe(F.col("d_hash"))).select("film_id", "text", "text_hash")


def embed(tables: Tables, texts: DataFrame, factory: Callable, model: str, dim: int, today, slices: int = SLICES) -> int:
    """Embeds what there is to embed into the store's table film_embedding, a commit a slice; how many texts."""
    if "film_embedding" not in tables.state().tables:
        tables.commit(declared={"film_embedding": EMBEDDED})
    n = 0
    for i in range(slices):
        state = tables.state()
        held = tables.read("film_embedding", state)
        work = to_embed(texts, held, model).where(F.pmod(F.xxhash64("film_id"), F.lit(slices)) == i).persist()
        if found := work.count():
            made = encoded(work, factory).join(work.select("film_id", "text_hash"), "film_id")
            new = made.select("film_id", F.lit(model).alias("model"), F.lit(dim).alias("dim"), vectors.of_length(F.col("vector"), dim).alias("vector"), "text_hash", F.lit(today).cast("date").alias("embedded_on"))
            tables.commit(None, {"film_embedding": new}, based_on=state)
            n += found
        work.unpersist()
    return n


def current(embedded: DataFrame, model: str) -> DataFrame:
    """(film_id, vector) of a model: each title's last."""
    return embedded.where(F.col("model") == model).groupBy("film_id").agg(F.max_by("vector", F.struct("embedded_on", "text_hash")).alias("vector"))


BLOCKS = "block int, version long, ids array<long>, matrix binary"
STAMPS = "block int, stamp decimal(38,0), n long, version long"


class VectorIndex:
    """Blocks of unit vectors (film_id, packed vector) in a store, kept in step by refresh."""

    def __init__(self, tables: Tables, dim: int, blocks: int | None = None) -> None:
        self.tables, self.dim, self._blocks = tables, dim, blocks

    def refresh(self, rows: DataFrame) -> list[int]:
        """Writes the blocks that have changed since the last time; their numbers. rows: (film_id, vector) with packed floats of 32 bits."""
        state = self.tables.state()
        if "blocks" not in state.tables:
            count = self._blocks or max(1, math.ceil(rows.count() / IN_BLOCK))
            state = self.tables.commit(declared={"blocks": BLOCKS, "stamps": STAMPS}, notes={"blocks": str(count)})
        count = int(state.notes["blocks"])
        dealt = rows.where("vector is not null").select("film_id", "vector", F.pmod(F.xxhash64("film_id"), F.lit(count)).cast("int").alias("block"))
        now = dealt.groupBy("block").agg(F.sum(F.xxhash64("film_id", "vector").cast("decimal(38,0)")).cast("decimal(38,0)").alias("stamp"), F.count("*").alias("n"))
        held = self.tables.read("stamps", state).select(F.col("block").alias("h_block"), F.col("stamp").alias("h_stamp"), F.col("n").alias("h_n"), F.col("version").alias("h_version"))
        both = now.join(held, F.col("block") == F.col("h_block"), "full").select(F.coalesce("block", "h_block").alias("block"), "stamp", "n", "h_version", (F.col("stamp").eqNullSafe(F.col("h_stamp")) & F.col("n").eqNullSafe(F.col("h_n"))).alias("same")).persist()
        changed = sorted(r["block"] for r in both.where("not same").select("block").collect())  # a number for each changed block
        if changed:
            version = state.number + 1
            stamps = both.where("n is not null").select("block", "stamp", "n", F.when(F.col("same"), F.col("h_version")).otherwise(F.lit(version)).cast("long").alias("version"))
            kept = dealt.where(F.col("block").isin(changed))
            self.tables.commit({"stamps": stamps}, {"blocks": self._packed(kept, version)}, based_on=state)
        both.unpersist()
        return changed

    def _packed(self, dealt: DataFrame, version: int) -> DataFrame:
        dim = self.dim

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("film_id")
            m = np.frombuffer(b"".join(pdf["vector"]), "<f4").reshape(len(pdf), dim).astype(np.float64)
            length = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return pd.DataFrame([(key[0], version, pdf["film_id"].tolist(), (m / np.where(length > 0, length, 1)).astype("<f8").tobytes())], columns=["block", "version", "ids", "matrix"])

        return dealt.groupBy("block").applyInPandas(pack, BLOCKS)

    def compact(self) -> State:
        """Blocks without those that newer ones replace."""
        state = self.tables.state()
        return self.tables.commit({"blocks": self._live(state)}, based_on=state)

    def _live(self, state: State) -> DataFrame:
        names = self.tables.read("stamps", state).select(F.col("block").alias("s_block"), F.col("version").alias("s_version"))
        # a row for each block
        return self.tables.read("blocks", state).join(F.broadcast(names), (F.col("block") == F.col("s_block")) & (F.col("version") == F.col("s_version")), "left_semi")

    def nearest(self, query: Sequence[float], k: int = vectors.NEAREST, ceiling: float = vectors.CEILING) -> DataFrame:
        """(film_id, distance) of the k nearest within ceiling, by distance and id."""
        q, dim = np.asarray(query, np.float64), self.dim

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for ids, matrix in zip(pdf["ids"], pdf["matrix"], strict=True):
                    far = 1 - np.frombuffer(matrix, "<f8").reshape(-1, dim) @ q
                    names = np.asarray(ids, np.int64)
                    at = np.flatnonzero(far <= ceiling)
                    at = at[np.lexsort((names[at], far[at]))][:k]
                    yield pd.DataFrame({"film_id": names[at], "distance": far[at]})

        found = self._live(self.tables.state()).select("ids", "matrix").mapInPandas(scan, "film_id long, distance double")
        return found.orderBy("distance", "film_id").limit(k)
