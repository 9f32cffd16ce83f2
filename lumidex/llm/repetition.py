"""Quality rules on repetition, from a suffix array of each text's words (operator 5).

The suffix array of a text's word sequence comes from prefix doubling; the ranks of
all doublings give the longest common prefix of neighbours by descending powers of
two. A suffix's longest repeat is the larger common prefix with its two neighbours.
The spans of all maximal repeated substrings (the LCP intervals) of at least
MIN_REPEAT words have the same union as the spans of these longest repeats, for each
maximal repeat ends where the longest repeat of its start ends or inside it. The
verdict limits the covered fraction of the words' bytes and the longest repeat. Words of
over LONG_WORD bytes (scripts without spaces, encoded data) are also searched byte by byte,
each of their bytes a letter of the string and each word followed by a mark of its own; of
these, repeats of at least LEAST_BYTES count, and LONGEST_BYTES is the longest allowed.

The limits are set by clean texts: those of the labelled ones that the base rule keeps repeat
a line of boilerplate, of at most 13 words, and nothing longer. So repeats count from 14
words on, a twentieth of the bytes is the most that they may cover (the base rule lets a
fifth of the words through, in repeats of five), and none may be of over 25 words: a passage
pasted twice goes wherever it is longer than that, however long the text around it.

Scale: one pass over the rows, no shuffle; memory is that of one text's arrays.

Defined results: null and empty texts have no words and fail the base rule (fewer
than MIN_WORDS words); very long texts are judged whole; repeated rows each give
their row; an empty table gives none. Words are runs of anything but space and
U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm.common import table

MIN_WORDS = 10
#: Words of a repeat that counts for the verdict; the most of the words' bytes they may cover; words of the longest allowed.
MIN_REPEAT = 14
COVERED_LIMIT = 0.05
LONGEST_LIMIT = 25
#: Words of more bytes are searched by bytes; the bytes of a repeat there that counts, and of the longest allowed.
LONG_WORD, LEAST_BYTES, LONGEST_BYTES = 200, 100, 200
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


def _reranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(rank of each key, order, number of ranks)."""
    order = np.argsort(keys, kind="stable")
    placed = keys[order]
    steps = np.empty(len(keys), np.int64)
    steps[0] = 0
    np.cumsum(placed[1:] != placed[:-1], out=steps[1:])
    rank = np.empty(len(keys), np.int64)
    rank[order] = steps
    return rank, order, int(steps[-1]) + 1


def _pair(rank: np.ndarray, offset: int) -> np.ndarray:
    """Keys of (rank, rank at offset), the end of the text below all."""
    key = rank * (len(rank) + 1)
    if offset < len(rank):
        key[:-offset] += rank[offset:] + 1
    return key


def suffix_array(ids: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP of each with the one before it; the first is 0) of word ids from 0.

    With most, doubling stops there: suffixes are sorted by so many words at least, and LCPs below that are exact.
    """
    n = len(ids)
    levels = []  # ranks of the strings of 1, 2, 4, ... words at each start
    rank, order, distinct = _reranked(ids)
    while distinct < n and (most is None or 1 << len(levels) <= most):
        levels.append(rank if most is None else rank.astype(np.int32))
        rank, order, distinct = _reranked(_pair(rank, 1 << len(levels) - 1))
    lcp = np.zeros(n, np.int64)
    a, b, common = order[:-1].copy(), order[1:].copy(), lcp[1:]
    for k in range(len(levels) - 1, -1, -1):  # a common prefix is shorter than twice the last level's strings
        fits = np.flatnonzero((a + (1 << k) <= n) & (b + (1 << k) <= n))
        same = fits[levels[k][a[fits]] == levels[k][b[fits]]]
        for x in (a, b, common):
            x[same] += 1 << k
    return order, lcp


def longest_repeats(ids: np.ndarray, most: int | None = None) -> np.ndarray:
    """For each start, the length of the longest string there that also starts elsewhere; at least most stands for itself or more."""
    order, lcp = suffix_array(ids, most)
    best = np.zeros(len(ids), np.int64)
    best[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return best


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Whether each position is inside the union of [i, i + lengths[i]) over lengths of at least least."""
    places = np.arange(len(lengths))
    return np.maximum.accumulate(np.where(lengths >= least, places + lengths, 0)) > places


def _short_repeat(ids: np.ndarray, two: np.ndarray, four: np.ndarray, distinct: int) -> int:
    """The longest repeat of a text of six words or more that repeats no five: from the ranks of one, two and four words."""
    n = len(ids)
    if distinct < n and len(np.unique(four[: n - 3])) < n - 3:
        return 4
    if len(np.unique(two[: n - 2] * (n + 1) + ids[2:])) < n - 2:
        return 3
    if len(np.unique(two[: n - 1])) < n - 1:
        return 2
    return int(len(np.unique(ids)) < n)


def word_repeats(words: list[bytes]) -> tuple[int, int, int]:
    """(words in 5-word windows that occur twice, bytes of words in repeats of MIN_REPEAT, longest repeat)."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(ids)
    if n < 6:
        best = longest_repeats(ids) if n > 1 else np.zeros(n, np.int64)
        return 0, 0, int(best.max(initial=0))
    # most texts repeat no 5 words: doubling far enough to see that, and how many they do repeat, is all they need
    two, _, _ = _reranked(_pair(ids, 1))
    four, _, distinct = _reranked(_pair(two, 2))
    five = four[: n - 4] * (n + 1) + four[1 : n - 3]
    if distinct == n or len(np.unique(five)) == n - 4:
        return 0, 0, _short_repeat(ids, two, four, distinct)
    best = longest_repeats(ids)
    # a window occurs twice exactly if the longest repeat at its start has five words
    n_bytes = int(np.fromiter(map(len, words), np.int64, n)[covered(best, MIN_REPEAT)].sum())
    return int(covered(np.where(best >= 5, 5, 0), 5).sum()), n_bytes, int(best.max())


def byte_repeats(words: list[bytes]) -> tuple[int, int]:
    """(bytes in repeats of LEAST_BYTES, longest repeat up to LONGEST_BYTES + 1) inside the words of over LONG_WORD bytes."""
    long = [w for w in words if len(w) > LONG_WORD]
    if not long:
        return 0, 0
    ids = np.zeros(sum(map(len, long)) + len(long), np.int64)
    at = 0
    for i, w in enumerate(long):
        ids[at : at + len(w)] = np.frombuffer(w, np.uint8)
        at += len(w) + 1
        ids[at - 1] = 256 + i  # equal to nothing else, so no repeat passes the end of a word
    best = longest_repeats(ids, LONGEST_BYTES + 1)
    return int(covered(best, LEAST_BYTES).sum()), int(min(best.max(), LONGEST_BYTES + 1))


def _with_bytes(words: list[bytes]) -> tuple[int, ...]:
    n_repeat, n_covered, longest = word_repeats(words)
    in_long, longest_bytes = byte_repeats(words)
    return n_repeat, sum(map(len, words)), n_covered + in_long, longest, longest_bytes


#: n_covered_bytes counts words in repeats of words and bytes in repeats inside long words.
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, word_bytes long, n_covered_bytes long, longest_repeat long, longest_bytes long"


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of OUT."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() parts at just the six blanks
    seen: set[str] = set()
    n_dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n_dup += line in seen
            seen.add(line)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    return (len(words), word_chars, sum(map(text.count, SYMBOLS)), n_dup, *_with_bytes(words))


def quality_rules(documents: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = (), covered_limit: float = COVERED_LIMIT, longest_limit: int = LONGEST_LIMIT) -> DataFrame:
    """id_col, keep, the columns of OUT, base_failed and kept of each document."""
    kept = [f"keep_{i}" for i in range(len(keep))]
    # a text that is carried along is not sent twice
    judged = f"keep_{keep.index('text')}" if "text" in keep and dict(documents.dtypes)["text"] == "string" else "judged"
    docs = documents.select(id_col, *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], *([] if judged in kept else [F.col("text").cast("string").alias(judged)]))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in OUT.split(", ")]
        for pdf in frames:
            stats = np.array([text_stats(t) for t in pdf[judged]], np.int64).reshape(-1, len(names))
            out = pdf[[id_col, *kept]].reset_index(drop=True)
            for i, name in enumerate(names):
                out[name] = stats[:, i]
            yield out

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "judged")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    repetitive = (F.col("n_covered_bytes") > covered_limit * F.col("word_bytes")) | (F.col("longest_repeat") > longest_limit) | (F.col("longest_bytes") > LONGEST_BYTES)
    return (
        docs.mapInPandas(judge, f"{head}, {OUT}")
        .withColumns({"base_failed": failed, "kept": ~failed & ~repetitive})
        .withColumnsRenamed(dict(zip(kept, keep, strict=True)))
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(table(spark, sf_dir, "documents")).select(*cols)
