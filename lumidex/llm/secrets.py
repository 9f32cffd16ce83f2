"""Secret scans: patterns and a linear-chain conditional random field (operator 1).

Three patterns give the base spans. A conditional random field adds others: a text is
cut into tokens, runs of letters, digits, _, +, / and -, each tagged as outside (O),
begin (B) or inside (I) of a secret. Features are a token's shape (length, kinds of
characters, changes between letters and digits), its neighbours (a key word in one of
the two tokens before, the signs between) and the file (whether it reads like settings).
Weights are fitted by gradient ascent on the conditional likelihood of generated lines,
so no rows of the data are used. Decoding is Viterbi: tokens whose lead for O exceeds
all that transitions could return are O on the best path, so the text falls into short
runs between them, each decoded on its own with the same result as a pass over all.

Scale: one pass over whole texts, no shuffle. Features are numpy arrays over BLOCK bytes of a
text at a time, cut at tokens, with the tokens before that they look back to; runs to decode
go on across cuts. So memory is some ten times the longest text, and what a block takes. The
model, some hundred numbers, is fitted on the driver and broadcast.

Defined results: null and empty texts have no spans; very long texts are scanned whole;
repeated rows each give a row; null ids are ordinary; an empty table gives no rows.
Spans are in code points, end exclusive. Added spans do not overlap base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm.common import table

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = (b"passw", b"secret", b"token", b"api")
KEY_WORD = re.compile(rb"passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|bearer|credential|authorization")
KEY_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"bearer", b"credential", b"authorization")
O, B, I = 0, 1, 2  # noqa: E741

# byte classes
_CODES = np.arange(256)
DIGIT = (_CODES >= 48) & (_CODES <= 57)
UPPER = (_CODES >= 65) & (_CODES <= 90)
LOWER = (_CODES >= 97) & (_CODES <= 122)
SIGN = np.isin(_CODES, list(b"_+/-"))
HIGH = _CODES >= 128
TOKEN = DIGIT | UPPER | LOWER | SIGN | HIGH
HEX_DIGIT = DIGIT | ((_CODES >= 97) & (_CODES <= 102))
LENGTHS = np.array([8, 12, 16, 24, 40])
SHAPE_BITS = 12  # 3 of length class, 9 flags
AROUND_BITS = 7
N_FEATURES = 8 + 9 + 6 + AROUND_BITS + 1
#: Bytes of a text that have features at a time, up to the next token; tokens that a token's features look back to.
BLOCK, LOOK_BACK = 1 << 20, 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches."""
    found = []
    lower = text.encode("utf-8", "surrogatepass").lower()
    if any(x in lower for x in NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _may_have_hex(lower):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def _may_have_hex(lower: bytes) -> bool:
    """Whether some run of 24 hexadecimal digits is there; bytes of higher characters are none."""
    if len(lower) < 24:
        return False
    is_hex = HEX_DIGIT[np.frombuffer(lower, np.uint8)]
    every = is_hex[7::8]  # a run of 24 holds three in a row of every eighth byte
    if not (every[:-1] & every[1:]).any():
        return False
    edges = np.flatnonzero(np.diff(np.concatenate(([False], is_hex, [False])).view(np.int8)))
    return bool((edges[1::2] - edges[::2] >= 24).any())


def blocks(raw: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(context, begin, end) of blocks of a text's bytes: each begins with a token, after LOOK_BACK others from context on."""

    def starts(low: int, high: int) -> np.ndarray:
        """Where tokens start from low (over 0) to before high."""
        token = TOKEN[raw[low - 1 : high]]
        return np.flatnonzero(token[1:] & ~token[:-1]) + low

    begin = context = 0
    while begin < len(raw):
        end, at = len(raw), begin + size
        while at < len(raw):
            found = starts(at, min(at + size, len(raw)))
            if len(found):
                end = int(found[0])
                break
            at += size
        yield context, begin, end
        begin, reach, context = end, 256, 0
        while reach < begin:
            found = starts(begin - reach, begin)
            if len(found) >= LOOK_BACK:
                context = int(found[-LOOK_BACK])
                break
            reach *= 4


def reads_like_settings(data: bytes, size: int) -> bool:
    """Whether more than a fifth of a text's tokens follow an equals sign or a colon."""
    raw = np.frombuffer(data, np.uint8)
    tokens = named = 0
    for context, begin, end in blocks(raw, size):
        part = raw[context:end]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], TOKEN[part], [False])).view(np.int8)))
        start, before = edges[::2], np.concatenate(([0], edges[1::2]))[: len(edges) // 2]
        own = start >= begin - context
        marks = np.flatnonzero((part == 61) | (part == 58))
        named += int(((np.searchsorted(marks, start) > np.searchsorted(marks, before)) & own).sum())
        tokens += int(own.sum())
    return named * 5 > tokens


def featurize(data: bytes, settings: bool | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shape code, neighbourhood code) of the tokens of data, in bytes; settings: what the file reads like, where data is a part of one."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], TOKEN[raw], [False])).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    n = len(start)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, none
    size = end - start

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(flags, out=sums[1:], dtype=np.int32)
        return sums[end] - sums[start]

    digit = DIGIT[raw]
    digits, uppers, lowers = count(digit), count(UPPER[raw]), count(LOWER[raw])
    signs, highs, hexes = count(SIGN[raw]), count(HIGH[raw]), count(HEX_DIGIT[raw])
    letter = (UPPER | LOWER)[raw]
    change = np.zeros(len(raw), bool)
    change[1:] = (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])
    changes = count(change)
    shape = np.searchsorted(LENGTHS, size, "right")
    letters = uppers + lowers
    for bit, flag in enumerate((digits > 0, digits == size, uppers > 0, lowers > 0, hexes == size, signs > 0, highs > 0, changes >= 3, (uppers > 1) & (lowers > 0) & (letters > 0)), 3):
        shape = shape | (flag.astype(np.int64) << bit)

    # what is between a token and the one before
    before = np.concatenate(([0], end[:-1]))

    def between(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(flags, out=sums[1:], dtype=np.int32)
        return sums[start] > sums[before]

    equals = between((raw == 61) | (raw == 58))
    quote = between((raw == 34) | (raw == 39))
    line = between(raw == 10)
    joined = (start - before == 1) & (raw[np.maximum(start - 1, 0)] == 46)
    key = np.zeros(n, bool)
    lower = data.lower()
    if any(x in lower for x in KEY_HINTS):
        at = np.array([m.end() - 1 for m in KEY_WORD.finditer(lower)], np.int64)
        if len(at):
            key[np.searchsorted(start, at, "right") - 1] = True
    one, two = np.append(False, key[:-1]), np.append([False] * min(2, n), key[:-2])[:n]
    if settings is None:
        settings = bool(np.count_nonzero(equals) * 5 > n)
    around = np.zeros(n, np.int64)
    for bit, flag in enumerate((one, two & ~one, equals, quote, line, joined, np.full(n, settings))):
        around |= flag.astype(np.int64) << bit
    return start, end, shape, around


def _indicators() -> tuple[np.ndarray, np.ndarray]:
    """Features of every shape code and of every neighbourhood code; both have the bias in the shapes'."""
    codes = np.arange(1 << SHAPE_BITS)
    flags = [(codes >> b) & 1 for b in range(3, SHAPE_BITS)]
    digit, _, upper, lower, _, _, _, changes, _ = flags
    long = (codes & 7) >= 3
    both = [digit & lower, digit & upper, digit & upper & lower, digit & long, changes & long, upper & lower & digit & long]
    shapes = np.stack([*[(codes & 7) == k for k in range(8)], *flags, *both, np.ones(len(codes), int)], axis=1).astype(float)
    codes = np.arange(1 << AROUND_BITS)
    return shapes, np.stack([(codes >> b) & 1 for b in range(AROUND_BITS)], axis=1).astype(float)


SHAPES, AROUNDS = _indicators()


class Field:
    """Weights of states (features x 3) and of transitions (3 x 3)."""

    def __init__(self, states: np.ndarray, moves: np.ndarray) -> None:
        self.moves = moves
        self.shape_scores = SHAPES @ states[: SHAPES.shape[1]]
        self.around_scores = AROUNDS @ states[SHAPES.shape[1] :]
        others = max(moves[a, b] + moves[b, c] - moves[a, O] - moves[O, c] for a in range(3) for b in (B, I) for c in range(3))
        at_end = max(moves[a, b] - moves[a, O] for a in range(3) for b in (B, I))
        at_start = max(moves[b, c] - moves[O, c] for b in (B, I) for c in range(3))
        #: A token whose score for O leads by more is O on the best path, whatever its neighbours are.
        self.lead = max(others, at_end, at_start, 0.0)

    def scores(self, shape: np.ndarray, around: np.ndarray) -> np.ndarray:
        return self.shape_scores[shape] + self.around_scores[around]

    def viterbi(self, scores: np.ndarray, after_o: bool, before_o: bool) -> list[int]:
        """The best tags of a run of tokens, with an O before it and after it if so."""
        best = scores[0] + (self.moves[O] if after_o else 0)
        back = []
        for s in scores[1:]:
            total = best[:, None] + self.moves
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + s
        if before_o:
            best = best + self.moves[:, O]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def spans(self, data: bytes, size: int = BLOCK) -> list[tuple[int, int]]:
        """(start, end) in bytes of what is tagged as a secret."""
        found: list[list[int]] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the run that a cut went through
        after_o = False

        def decode(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], after_o: bool, before_o: bool) -> None:
            start, end, score = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts, strict=True))
            inside = False
            for k, tag in enumerate(self.viterbi(score, after_o, before_o)):
                if tag == I and inside:
                    found[-1][1] = int(end[k])
                elif tag != O:
                    found.append([int(start[k]), int(end[k])])
                inside = tag != O

        raw, seen = np.frombuffer(data, np.uint8), 0
        settings = reads_like_settings(data, size) if len(data) > size else None
        for context, begin, stop in blocks(raw, size):
            start, end, shape, around = featurize(data[context:stop], settings)
            own = np.searchsorted(start, begin - context)
            start, end = start[own:] + context, end[own:] + context
            if not len(start):
                continue
            # equal pairs of codes have equal scores: only those that may not be O are looked at
            score = self.scores(shape[own:], around[own:])
            open_ = np.flatnonzero(score[:, O] - np.maximum(score[:, B], score[:, I]) <= self.lead)
            runs = np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []
            if held and (not runs or runs[0][0] > 0):
                decode(held, after_o, True)
                held = []
            for run in runs:
                first, last = int(run[0]), int(run[-1])
                part = start[first : last + 1], end[first : last + 1], score[first : last + 1]
                if not held:
                    after_o = seen + first > 0
                held.append(part)
                if last < len(start) - 1:
                    decode(held, after_o, True)
                    held = []
            seen += len(start)
        if held:
            decode(held, after_o, False)
        return [(a, b) for a, b in found]


def fit(sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Weights for sequences of (shape codes, neighbourhood codes, tags) by Adam on the mean log likelihood of a token."""
    width, n = max(len(t) for _, _, t in sequences), len(sequences)
    x = np.zeros((n, width, SHAPES.shape[1] + AROUNDS.shape[1]))
    tags, real = np.zeros((n, width), int), np.zeros((n, width), bool)
    for i, (shape, around, t) in enumerate(sequences):
        x[i, : len(t)] = np.concatenate([SHAPES[shape], AROUNDS[around]], axis=1)
        tags[i, : len(t)], real[i, : len(t)] = t, True
    flat = x.reshape(n * width, -1)
    hot = np.eye(3)[tags] * real[..., None]
    pairs = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
    gold = flat.T @ hot.reshape(-1, 3)
    w = [np.zeros((x.shape[2], 3)), np.zeros((3, 3))]
    mean, square = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    total = real.sum()
    for step in range(1, steps + 1):
        score = (flat @ w[0]).reshape(n, width, 3)
        ahead, back = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        ahead[:, 0] = score[:, 0]
        for t in range(1, width):
            on = np.logaddexp.reduce(ahead[:, t - 1, :, None] + w[1], axis=1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], on, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            on = np.logaddexp.reduce(w[1] + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(real[:, t + 1, None], on, 0)
        norm = np.logaddexp.reduce(ahead[:, -1], axis=1)
        single = np.exp(np.minimum(ahead + back - norm[:, None, None], 0)) * real[..., None]
        joint = ahead[:, :-1, :, None] + w[1] + (score[:, 1:] + back[:, 1:])[:, :, None, :] - norm[:, None, None, None]
        joint = (np.exp(np.minimum(joint, 0)) * real[:, 1:, None, None]).sum(axis=(0, 1))
        slope = [(gold - flat.T @ single.reshape(-1, 3)) / total - decay * w[0], (pairs - joint) / total - decay * w[1]]
        for k in (0, 1):
            mean[k] = 0.9 * mean[k] + 0.1 * slope[k]
            square[k] = 0.99 * square[k] + 0.01 * slope[k] ** 2
            w[k] = w[k] + rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return Field(*w)


def generated_lines(count: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines of invented prose, numbers, code and settings, with the spans of the secrets in them."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ción", "ö", "é", "ung", "keit", "eau"]
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = small + small.upper() + digits

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 7))))
        style = rng.random()
        return w.capitalize() if style < 0.12 else w.upper() + pick(["", "!!"]) if style < 0.18 else w + pick(["###", "***", "%%%", "&&&", "$$$"]) if style < 0.24 else w + pick([",", ".", ""])

    def harmless() -> str:
        return pick([
            lambda: chars(digits, int(rng.integers(1, 17))),
            lambda: f"+{chars(digits, 1)} ({chars(digits, 3)}) {chars(digits, 3)}-{chars(digits, 4)}",
            lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
            lambda: f"{word()}.{chars(digits, 2)}@mail{chars(digits, 1)}.example.com",
            lambda: f"https://{chars(small, 8)}.example.org/{chars(small, 6)}/{chars(digits, 4)}?page={chars(digits, 1)}",
            lambda: f"20{chars(digits, 2)}-0{chars(digits, 1)}-1{chars(digits, 1)}",
            lambda: f"v{chars(digits, 1)}.{chars(digits, 2)}.{chars(digits, 1)}",
            lambda: f"{chars(small, 5)}_{chars(small, 7)}_{chars(small, 4)}",
            lambda: f"{chars(small, 4)}{chars(small, 5).capitalize()}{chars(small, 6).capitalize()}",
            lambda: f"src/{chars(small, 6)}/{chars(small, 8)}_{chars(digits, 2)}.py",
            lambda: f"{chars(small.upper(), 2)}-{chars(digits, 4)}",
            lambda: f"{chars(digits, 4)} {chars(digits, 4)} {chars(digits, 4)} {chars(digits, 4)}",
            lambda: f"{chars(small, 6)} = {chars(digits, 3)}",
            lambda: f'{chars(small, 5)}: "{word()}"',
            lambda: f"CC BY-NC {chars(digits, 1)}.0",
            lambda: pick(["token", "the secret", "password", "key"]) + " " + word(),
            lambda: pick(["token", "secret", "password"]) + pick([": ", " = "]) + word().lower(),
        ])()

    def secret() -> tuple[str, str, str]:
        """(before, secret, after)"""
        name = pick(["password", "passwd", "pwd", "secret", "client_secret", "token", "access_token", "api_key", "apikey", "API_KEY", "private_key", "Authorization: Bearer", "credential"])
        value = pick([
            lambda: chars(alnum, int(rng.integers(16, 48))),
            lambda: chars(alnum + "+/", int(rng.integers(24, 64))),
            lambda: chars(alnum + "_-", int(rng.integers(20, 48))),
            lambda: pick(["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "pk_test_"]) + chars(alnum, int(rng.integers(20, 40))),
            lambda: chars("0123456789abcdef", int(rng.integers(32, 64))),
            lambda: "eyJ" + chars(alnum, int(rng.integers(20, 40))) + "." + chars(alnum, int(rng.integers(24, 40))) + "." + chars(alnum + "_-", int(rng.integers(24, 44))),
        ])()
        how = rng.random()
        if how < 0.55:
            mark = pick(['"', "'", ""])
            return name + pick([" = ", ": ", "=", ":", " is ", " "]) + mark, value, mark
        if how < 0.75:
            short = chars(alnum, int(rng.integers(8, 14)))
            mark = pick(['"', "'"])
            return name + pick([" = ", ": ", "="]) + mark, chars(digits, 1) + short + chars(digits, 1) + chars(small, 1), mark
        return "", value, ""

    lines = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(int(rng.integers(4, 22))):
            kind = rng.random()
            if kind < 0.07:
                before, value, after = secret()
                spans.append((len(text) + len(before), len(text) + len(before) + len(value)))
                text += before + value + after
            else:
                text += harmless() if kind < 0.2 else word()
            text += pick([" ", " ", " ", " ", "\n", " | "])
        lines.append((text, spans))
    return lines


def tagged(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape codes, neighbourhood codes, tags) of a text whose secrets are at spans, in code points."""
    start, end, shape, around = featurize(text.encode())
    tags = np.zeros(len(start), int)
    for a, b in spans:
        low, high = len(text[:a].encode()), len(text[:b].encode())
        inside = np.flatnonzero((start < high) & (end > low))
        tags[inside] = I
        tags[inside[:1]] = B
    return shape, around, tags


TRAINING_LINES, SEED = 600, 71


@cache
def trained(count: int = TRAINING_LINES) -> Field:
    """The field fitted on generated lines, once a process."""
    return fit([x for x in (tagged(*line) for line in generated_lines(count, SEED)) if len(x[2])])


def all_spans(text: str | None, field: Field) -> list[tuple[int, int, int]]:
    """(start, end, kind) of base and added spans, by start, then kind."""
    if not text:
        return []
    base = sorted(base_spans(text))
    data = text.encode("utf-8", "surrogatepass")
    added = field.spans(data)
    if added:
        if len(data) != len(text):  # bytes to code points: all bytes before but those that continue a character
            raw, at, points, place = np.frombuffer(data, np.uint8), 0, 0, {}
            for x in sorted({x for span in added for x in span}):
                points, at = points + int(np.count_nonzero((raw[at:x] & 0xC0) != 0x80)), x
                place[x] = points
            added = [(place[a], place[b]) for a, b in added]
        starts, reach = [x for x, _, _ in base], list(accumulate((y for _, y, _ in base), max))
        # of the base spans that begin before an added one ends, does the furthest end after it begins?
        free = lambda a, b: not (k := bisect_left(starts, b)) or reach[k - 1] <= a
        added = [(a, b, 3) for a, b in added if free(a, b)]
    return sorted([*base, *added], key=lambda s: (s[0], s[2]))


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = (), field: Field | None = None, with_text: bool = False) -> DataFrame:
    """id_col, keep, n_assign, n_access, n_hex, n_crf, base_sha256, spans of each document.

    with_text adds redacted, the text with each run of overlapping spans replaced by [SECRET].
    """
    shipped = documents.sparkSession.sparkContext.broadcast(field or trained())
    docs = documents.select(id_col, *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("scanned"))
    kept = [f"keep_{i}" for i in range(len(keep))]

    kinds = dict.fromkeys(("n_assign", "n_access", "n_hex", "n_crf"), "long") | {"base_sha256": "string", "spans": "string"} | ({"redacted": "string"} if with_text else {})
    names = list(kinds)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                rows = []
                for text in part["scanned"]:
                    spans = all_spans(text, shipped.value)
                    base = [s for s in spans if s[2] < 3]
                    counts = [sum(s[2] == k for s in spans) for k in range(4)]
                    rows.append((*counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans), *([redact(text, spans)] if with_text else [])))
                out = part[[id_col, *kept]].reset_index(drop=True)
                for i, name in enumerate(names):
                    out[name] = [r[i] for r in rows]
                yield out

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "scanned")
    found = docs.mapInPandas(scan, ", ".join([head, *(f"{n} {k}" for n, k in kinds.items())]))
    return found.withColumnsRenamed(dict(zip(kept, keep, strict=True)))


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a > end:
            out += [text[max(at, 0) : a], "[SECRET]"]
            end = b
        else:
            end = max(end, b)
        at = end
    return "".join([*out, text[end:]])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans")
