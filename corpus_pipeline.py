"""The training-corpus pipeline: documents in, packed token sequences out.

Each stage calls one operator and works on all that the one before kept; between stages
the documents are written as Parquet and read again. Stages but the last return the
columns of documents, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm import decontamination, minhash, packing, repetition, secrets
from lumidex.llm.common import forget, saved, table


def _plain(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], dict]:
    """docs with names that clash with no operator's, those to carry along, and how the columns come back."""
    names = {c: c if c in ("doc_id", "text") else f"other_{i}" for i, c in enumerate(docs.columns)}
    back = {c: F.col(n) for c, n in names.items()}
    return docs.toDF(*names.values()), tuple(n for n in names.values() if n != "doc_id"), back


def _restored(df: DataFrame, back: dict) -> DataFrame:
    return df.select(*[v.alias(k) for k, v in back.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the repetition rules go."""
    plain, keep, back = _plain(docs)
    return _restored(repetition.quality_rules(plain, keep=keep).where("kept"), back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8 or more."""
    return minhash.without_near_duplicates(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    plain, keep, back = _plain(docs)
    return _restored(decontamination.decontaminate(plain, table(spark, sf_dir, "benchmark"), keep=keep).where("not contaminated"), back)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows; no document goes."""
    plain, keep, back = _plain(docs)
    found = secrets.scan_secrets(plain, keep=tuple(k for k in keep if k != "text"), with_text=True)
    back["text"] = F.col("redacted")
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("spans") != "", F.length("redacted")).otherwise(back["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return _restored(found, back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        forget(before)  # a table that this run wrote; others are left alone
    return docs


#: Suffix arrays, the random field and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
