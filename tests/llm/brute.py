"""Plain versions of operators, for tests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def remove_repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, SHA-256 of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rest = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_duplicates(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, smallest linked id)."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def contamination(text: str | None, items: list[tuple[int, str | None]], window: int = 13) -> tuple:
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    w, hit, ids = cut(text), set(), set()
    for i, item in items:
        v = cut(item)
        k = min(window, len(v))
        if not k:
            continue
        strings = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)}
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in strings:
                hit |= set(range(p, p + k))
                ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def repeat_words(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def maximal(conversations: list[tuple[int, int, str, str]]) -> dict[int, str]:
    """conv_id to rendered text of what no longer conversation begins with; of equal ones the smallest id."""
    turns: dict = {}
    for c, t, r, x in set(conversations):
        turns.setdefault(c, []).append((t, r, x))
    seqs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    keep = {}
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        if not longer and c == min(k for k, o in seqs.items() if o == s):
            keep[c] = "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in s)
    return keep


def base_spans(text: str | None) -> list[str]:
    """kind:start:end of the three patterns, found one position after the other, by start, then kind."""
    text = text or ""
    letters = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + "|" + letters("api") + "_?" + letters("key")
    kinds = [
        ("assign", "(?:" + names + ")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
    ]
    out = []
    for place, (kind, pattern, group, least) in enumerate(kinds):
        at = 0
        while at < len(text):
            m = re.compile(pattern).match(text, at)
            if m and len(m[group]) >= least:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
            at = m.end() if m else at + 1
    return [x for _, _, x in sorted(out)]


def repetition(text: str | None, least: int) -> tuple[int, int, int]:
    """(bytes of the words, those in word strings of at least least words that occur twice, words of the longest string that occurs twice)."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    longest, inside = 0, set()
    for size in range(1, len(w)):
        seen = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
        twice = [i for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1]
        longest = size if twice else longest
        if size >= least:
            inside |= {j for i in twice for j in range(i, i + size)}
    return sum(len(x.encode()) for x in w), sum(len(w[j].encode()) for j in inside), longest
