"""The pipeline, stage by stage, and the queries with SQL."""

from __future__ import annotations

import collections
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumidex.llm import registry, repetition
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA), con.sql(registry.SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, want.project(", ".join(order)).fetchall()))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("*", "lang", "source").toDF("doc_id", "text", "lang", "source", "n_chars", "kept", "spans")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality_rules":
            assert set(after) == {i for i, r in before.items() if brute_quality(r["text"])}
        if name == "near_dedup":
            linked = brute.near_duplicates([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, c) in linked.items() if c == i}
        if name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not brute.contamination(r["text"], items)[-1]}
        if name == "secret_scan":
            assert set(after) == set(before)
            assert not any("token = " in r["text"] for r in after.values())
            assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if r["text"] != before[i]["text"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    by_doc: dict = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(after)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in after.items():  # each token of each document lies in exactly one piece
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[i], key=lambda p: p["start"])
        assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1].tolist()] and sum(p["length"] for p in own) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own)
    ends: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert sorted(ends) == list(range(len(ends))) and max(ends.values()) <= 2048


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(w) < 10 or 100 * brute.repeat_words(text) > 20 * len(w):
        return False
    size, inside, longest = brute.repetition(text, repetition.MIN_REPEAT) if len(w) < 400 else brute_long(w)
    return inside <= repetition.COVERED_LIMIT * size and longest <= repetition.LONGEST_LIMIT


def brute_long(w):
    """The same for long texts: strings of MIN_REPEAT words cover what longer ones do, and the longest grows from them."""
    least = repetition.MIN_REPEAT
    windows = collections.Counter(tuple(w[i : i + least]) for i in range(len(w) - least + 1))
    inside = {j for i in range(len(w) - least + 1) if windows[tuple(w[i : i + least])] > 1 for j in range(i, i + least)}
    size = repetition.LONGEST_LIMIT + 1
    longer = collections.Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return sum(len(x.encode()) for x in w), sum(len(w[j].encode()) for j in inside), size if max(longer.values(), default=0) > 1 else 0


def test_odd_tables(spark):
    """An empty table, null ids and texts, and rows that repeat pass all stages."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    assert run_stages(spark, spark.createDataFrame([], kinds)).count() == 0
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(None, good, "en", "s", 1), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, good + " tail", None, None, None), (5, good + " tail", None, None, None), (6, "other " + " ".join(f"term{i}" for i in range(30)), "en", "s", 9)]
    found = {r["doc_id"] for r in run_stages(spark, spark.createDataFrame(rows, kinds)).collect()}
    assert 6 in found and found <= {None, 5, 6} and len(found & {None, 5}) == 1


def run_stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    return docs
