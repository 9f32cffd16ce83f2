"""HTML extraction by a recurrent block labeller (operator 6).

A page is cut into blocks: runs of text between block-level tags, each with the path of
open elements. A block's input is the sum of vectors of its hashed path tokens (tags,
class and id words), the share of its hashed words in each bucket, and a few numbers
(length, share in links, signs). A bidirectional LSTM in numpy reads the whole sequence
of a page's blocks and labels each one; what is labelled main text is joined.

The network is fitted on the driver, by back-propagation through time, on generated
pages whose blocks are known; no rows of the data are used. Its weights, some ten
thousand numbers, are broadcast.

Scale: one pass over the pages, no shuffle. Pages are labelled in batches of similar
block counts, bounded by pages times the block count of the longest; a page beyond that
bound goes alone and is read in pieces that hand on their units. Memory is that of such
a batch, and of the blocks of the longest page: a block has not its path but what of it
changed since the block before, so deep nesting costs no more than flat markup.

Defined results: null and empty html, and pages without main text, have empty text; very
long pages are read whole; repeated rows each give a row; a null page_id or url is
carried; an empty table gives no rows. Unclosed tags, comments and quotes are tolerated
as browsers do: an unclosed comment or script hides what follows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm.common import table

PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 1024, 64, 7
UNITS = 16
BATCH = 256
#: Pages times blocks of the longest page that are labelled at a time, and blocks held encoded; a page with more goes alone.
MAX_BLOCKS = 65536

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'][^>]*+)*+)>?|<[!?][^>]*+>?""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title object".split())
HIDDEN = RAW - {"title", "textarea"}
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: An opening tag that ends an open element of the same kind.
ENDS_ITS_OWN = frozenset("p li dt dd tr td th option".split())
#: Opening tags that end an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BLANKS = re.compile(r"\s+")


class _Open:
    """An open element: its name, the buckets of its path tokens, its neighbours in the list of open ones, and its number."""

    __slots__ = ("above", "below", "buckets", "name", "number")

    def __init__(self, name: str, buckets: list[int], below: _Open | None, number: int) -> None:
        self.name, self.buckets, self.below, self.above, self.number = name, buckets, below, None, number


class _Path:
    """The open elements: a linked list from the outermost to the top, and which buckets they switch on.

    Opening and closing cost what the element's own tokens cost, however deep it lies:
    elements of one name are a stack of their own, and so are those that are not inline.
    """

    def __init__(self) -> None:
        self.top: _Open | None = None
        self.named: dict[str, list[_Open]] = {}
        self.walls: list[_Open] = []
        self.count: dict[int, int] = {}
        self.changed: set[int] = set()
        self.opened = 0

    def _switch(self, bucket: int) -> None:
        self.changed ^= {bucket}

    def open(self, name: str, tokens: list[str]) -> None:
        self.opened += 1
        node = _Open(name, [_bucket(t, PATH_BUCKETS) for t in tokens], self.top, self.opened)
        if self.top is not None:
            self.top.above = node
        self.top = node
        self.named.setdefault(name, []).append(node)
        if name not in INLINE:
            self.walls.append(node)
        for b in node.buckets:
            self.count[b] = self.count.get(b, 0) + 1
            if self.count[b] == 1:
                self._switch(b)

    def remove(self, node: _Open) -> None:
        """Closes node, the topmost of its name, and nothing else."""
        if node.above is not None:
            node.above.below = node.below
        else:
            self.top = node.below
        if node.below is not None:
            node.below.above = node.above
        self.named[node.name].pop()
        if node.name not in INLINE:
            self.walls.pop()
        for b in node.buckets:
            self.count[b] -= 1
            if not self.count[b]:
                self._switch(b)

    def close_down_to(self, node: _Open) -> None:
        """Closes node and all above it."""
        while self.top is not node:
            self.remove(self.top)
        self.remove(node)

    def close(self, name: str) -> None:
        """An inline element closes alone, unless a block stands between; any other with all above it; what is not open is left."""
        if not self.named.get(name):
            return
        node = self.named[name][-1]
        if name not in INLINE:
            self.close_down_to(node)
        elif not self.walls or node.number > self.walls[-1].number:
            self.remove(node)

    def end(self, names: set[str]) -> None:
        """Closes the innermost block if it is of names."""
        if self.walls and self.walls[-1].name in names:
            self.close_down_to(self.walls[-1])

    def in_link(self) -> bool:
        node = self.top
        for _ in range(4):
            if node is None:
                return False
            if node.name == "a":
                return True
            node = node.below
        return False

    def changes(self) -> tuple[int, ...]:
        """What was switched since the last call: a bucket that is on now as its number plus 1, one that is off as that below 0."""
        found = tuple(b + 1 if self.count.get(b) else -b - 1 for b in sorted(self.changed))
        self.changed = set()
        return found


def page_blocks(page: str) -> list[tuple[tuple[int, ...], str, int]]:
    """(changes of the path, text, characters of it in links) of each block with text; time and memory grow as the page does, however deep it nests."""
    out: list[tuple[tuple[int, ...], str, int]] = []
    path = _Path()
    pieces: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = BLANKS.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append((path.changes(), text, linked))
        pieces, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if path.in_link():
            linked += len(text.strip())

    while m := MARKUP.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name not in INLINE:
            flush()
        if closing:
            path.close(name)
            continue
        ends = {name} if name in ENDS_ITS_OWN else {"p"} if name in ENDS_PARAGRAPH else set()
        if ends:
            path.end(ends)
        if name in VOID:
            continue
        own = [f"<{name}"]
        for a in ATTRIBUTE.finditer(m[3]):
            own += NAME.findall((a[2] or a[3] or a[4] or "").lower())
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            text = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if name not in HIDDEN:
                path.open(name, own)
                pieces.append(text)
                flush()
                path.remove(path.top)
            continue
        path.open(name, own)
    if at < len(page):
        say(page[at:])
    flush()
    return out


def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % buckets


def numbers(text: str, linked: int) -> list[float]:
    n = len(text)
    return [1.0, np.log1p(n) / 5, min(linked / n, 1.0), float(text[-1] in ".!?:"), float("©" in text), min(text.count(".") / 10, 1.0), float(text[0].isupper())]


class Encoded:
    """The inputs of a page: the buckets of its path that each block switches on (sign 1) or off (-1), word shares and numbers."""

    def __init__(self, blocks: list[tuple[tuple[int, ...], str, int]]) -> None:
        moves = np.fromiter((c for changes, _, _ in blocks for c in changes), np.int64)
        self.buckets, self.signs = np.abs(moves) - 1, np.sign(moves).astype(np.float64)
        self.ends = np.cumsum([0, *(len(changes) for changes, _, _ in blocks)])
        self.rest = np.zeros((len(blocks), WORD_BUCKETS + NUMBERS))
        for i, (_, text, linked) in enumerate(blocks):
            words = text.lower().encode("utf-8", "surrogatepass").split()
            hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_BUCKETS
            self.rest[i, :WORD_BUCKETS] = np.bincount(hashed, minlength=WORD_BUCKETS) / max(len(words), 1)
            self.rest[i, WORD_BUCKETS:] = numbers(text, linked)

    def __len__(self) -> int:
        return len(self.rest)

    def on(self, block: int) -> np.ndarray:
        """1 for each bucket that is on before the block's own switches, else 0."""
        upto = self.ends[block]
        return np.bincount(self.buckets[:upto], self.signs[:upto], PATH_BUCKETS)

    def path_sums(self, weights: np.ndarray, first: int, past: int) -> np.ndarray:
        """The sum of the weights of each block's path, from first to before past: sums run down the blocks, some switches at a time."""
        out = np.empty((past - first, weights.shape[1]))
        at, total = first, self.on(first) @ weights
        while at < past:
            upto = min(past, max(at + 1, int(np.searchsorted(self.ends, self.ends[at] + MAX_BLOCKS, "right")) - 1))
            low, high = self.ends[at], self.ends[upto]
            running = np.zeros((high - low + 1, weights.shape[1]))
            np.cumsum(weights[self.buckets[low:high]] * self.signs[low:high, None], axis=0, out=running[1:])
            out[at - first : upto - first] = total + running[self.ends[at + 1 : upto + 1] - low]
            at, total = upto, self.on(upto) @ weights
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def batches(order: list[int], widths: list[int]) -> Iterator[list[int]]:
    """order, by growing width, in runs of at most BATCH and at most MAX_BLOCKS places, padding included; a wider one alone."""
    some: list[int] = []
    for i in order:
        if some and (len(some) == BATCH or (len(some) + 1) * widths[i] > MAX_BLOCKS):
            yield some
            some = []
        some.append(i)
    if some:
        yield some


class Labeller:
    """Weights: for both directions input to gates and units to gates; units to the label."""

    def __init__(self, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            # rows of unseen path tokens stay 0: they tell nothing
            self.w["p" + d] = np.zeros((PATH_BUCKETS, 4 * UNITS))
            self.w["x" + d] = rng.normal(0, 0.1, (WORD_BUCKETS + NUMBERS, 4 * UNITS))
            self.w["h" + d] = rng.normal(0, 0.2, (UNITS, 4 * UNITS))
        self.w["o"] = rng.normal(0, 0.3, (2 * UNITS + 1,))

    def inputs(self, pages: list[Encoded], direction: str, first: int, past: int) -> tuple[np.ndarray, np.ndarray]:
        """(gate inputs by page and block, whether the block is there) of the blocks from first to before past."""
        width = past - first
        x, real = np.zeros((len(pages), width, 4 * UNITS)), np.zeros((len(pages), width), bool)
        for i, p in enumerate(pages):
            if len(p) <= first:
                continue
            total = p.path_sums(self.w["p" + direction], first, min(past, len(p))) + p.rest[first:past] @ self.w["x" + direction]
            at = slice(0, len(total))
            x[i, at], real[i, at] = total, True
        return x, real

    def run(self, x: np.ndarray, real: np.ndarray, direction: str, state: tuple[np.ndarray, np.ndarray] | None = None, training: bool = False) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """Units of every block, for training the states of every step, and the last state; the backward direction reads from the end."""
        n, width, _ = x.shape
        h, c = state or (np.zeros((n, UNITS)), np.zeros((n, UNITS)))
        out, steps = np.zeros((n, width, UNITS)), []
        for t in range(width) if direction == "f" else range(width - 1, -1, -1):
            gates = x[:, t] + h @ self.w["h" + direction]
            i, f, o = _sigmoid(gates[:, :UNITS]), _sigmoid(gates[:, UNITS : 2 * UNITS] + 1), _sigmoid(gates[:, 2 * UNITS : 3 * UNITS])
            g = np.tanh(gates[:, 3 * UNITS :])
            now = f * c + i * g
            on = real[:, t, None]
            if training:
                steps.append((t, h, c, i, f, o, g, np.tanh(now)))
            h, c = np.where(on, o * np.tanh(now), h), np.where(on, now, c)
            out[:, t] = h
        return out, steps, (h, c)

    def label(self, pages: list[Encoded]) -> list[np.ndarray]:
        """The probability of main text for each block of each page."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        for some in batches(order, [len(p) for p in pages]):
            width = len(pages[some[-1]])
            logit = np.full((len(some), width), self.w["o"][-1])
            pieces = [(at, min(at + MAX_BLOCKS, width)) for at in range(0, width, MAX_BLOCKS)]
            for k, d in enumerate("fb"):
                state = None
                for first, past in pieces if d == "f" else reversed(pieces):
                    x, real = self.inputs([pages[i] for i in some], d, first, past)
                    units, _, state = self.run(x, real, d, state)
                    logit[:, first:past] += units @ self.w["o"][k * UNITS : (k + 1) * UNITS]
            for row, i in enumerate(some):
                out[i] = _sigmoid(logit[row, : len(pages[i])])
        return out

    def fit(self, pages: list[Encoded], labels: list[list[int]], rounds: int = 100, rate: float = 0.03, decay: float = 1e-4) -> None:
        """Adam on the mean cross entropy of a block, over all pages at once."""
        width = max(map(len, pages))
        y = np.zeros((len(pages), width))
        real = np.array([[t < len(p) for t in range(width)] for p in pages])
        multi = np.zeros((len(pages), width, PATH_BUCKETS), np.float32)
        rest = np.zeros((len(pages), width, WORD_BUCKETS + NUMBERS))
        for i, p in enumerate(pages):
            y[i, : len(labels[i])] = labels[i]
            rest[i, : len(p)] = p.rest
            for t in range(len(p)):
                multi[i, t] = p.on(t + 1)
        used = np.flatnonzero(multi.any(axis=(0, 1)))
        multi = multi[:, :, used].reshape(-1, len(used))
        rest = rest.reshape(-1, rest.shape[2]).astype(np.float32)
        mean, square = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, rounds + 1):
            slope, runs, logit = {k: np.zeros_like(v) for k, v in self.w.items()}, {}, self.w["o"][-1]
            for k, d in enumerate("fb"):
                x = multi @ self.w["p" + d][used].astype(np.float32) + rest @ self.w["x" + d].astype(np.float32)
                runs[d] = self.run(x.reshape(len(pages), width, -1), real, d, training=True)
                logit = logit + runs[d][0] @ self.w["o"][k * UNITS : (k + 1) * UNITS]
            error = (_sigmoid(logit) - y) * real / real.sum()
            slope["o"][-1] = error.sum()
            for k, d in enumerate("fb"):
                out, steps, _ = runs[d]
                own = self.w["o"][k * UNITS : (k + 1) * UNITS]
                slope["o"][k * UNITS : (k + 1) * UNITS] = np.einsum("nt,ntu->u", error, out)
                dx = np.zeros((*out.shape[:2], 4 * UNITS))
                dh, dc = np.zeros((len(pages), UNITS)), np.zeros((len(pages), UNITS))
                for t, h, c, i, f, o, g, tanh in reversed(steps):
                    on = real[:, t, None]
                    total = dh + error[:, t, None] * own
                    inner = np.where(on, total * o * (1 - tanh**2) + dc, 0)
                    gates = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), np.where(on, total * tanh, 0) * o * (1 - o), inner * i * (1 - g**2)], axis=1)
                    dx[:, t] = gates
                    slope["h" + d] += h.T @ gates
                    dh = np.where(on, gates @ self.w["h" + d].T, dh)
                    dc = np.where(on, inner * f, dc)
                flat = dx.reshape(-1, 4 * UNITS).astype(np.float32)
                slope["p" + d][used] = multi.T @ flat
                slope["x" + d] = rest.T @ flat
            for k in self.w:
                slope[k] += decay * self.w[k]
                mean[k] = 0.9 * mean[k] + 0.1 * slope[k]
                square[k] = 0.99 * square[k] + 0.01 * slope[k] ** 2
                self.w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)


def generated_pages(count: int, seed: int) -> list[tuple[str, list[str]]]:
    """Invented pages, each with the texts of its main blocks in order."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción ö é ung keit eau".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    sentence = lambda: words(3, 14).capitalize() + pick([".", ".", ".", "!", "?"])
    prose = lambda: " ".join(sentence() for _ in range(int(rng.integers(1, 6))))
    main: list[str] = []

    def good(text: str, tag: str) -> str:
        main.append(text)
        return f"<{tag}>{text}</{tag}>" if rng.random() < 0.9 or tag != "p" else f"<p>{text}"

    link = lambda: f'<a href="/{word()}">{pick(["Home", "About", "Contact", word(), words(1, 4)])}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(2, 8)))) + "</ul>"

    def named(tag: str, names: str, inside: str) -> str:
        name, how = pick(names.split()), rng.random()
        mark = f' class="{name}"' if how < 0.6 else f' id="{name}"' if how < 0.8 else f' class="{word()} {name}-{pick(["box", "wrap", "block", "inner"])}"'
        return f"<{tag}{mark}>{inside}</{tag}>"

    def aside() -> str:
        """Something that is not main text, at home outside an article as well as in it."""
        return pick([
            lambda: named("div", "ad ads advert advertisement sponsor sponsored promo banner", pick([sentence(), f"<p>{prose()}</p>"])),
            lambda: f"<nav>{links()}</nav>",
            lambda: named(pick(["div", "ul"]), "menu navbar navigation breadcrumb breadcrumbs pagination pager", links()),
            lambda: f"<aside>{pick([f'<h3>{words(1, 4)}</h3>', ''])}<p>{prose()}</p>{links()}</aside>",
            lambda: named("div", "sidebar related widget recommended trending", f"<h3>{words(1, 4)}</h3>" + pick([links(), f"<p>{prose()}</p>"])),
            lambda: named("div", "cookie cookies consent notice gdpr alert popup modal", f"<p>{pick(['We use cookies.', 'This site uses cookies to improve your visit.', sentence()])}</p><button>{pick(['Accept', 'OK', word()])}</button>"),
            lambda: f"<form><label>{words(1, 3)}</label><input name=q><button>{pick(['Search', 'Send', 'Subscribe', word()])}</button><p>{sentence()}</p></form>",
            lambda: named("div", "newsletter subscribe signup login share social", f"<p>{sentence()}</p>{link()}"),
            lambda: named(pick(["section", "div"]), "comments comment discussion replies disqus respond", f"<h3>{pick(['Comments', words(1, 3)])}</h3>" + "".join(named("div", "comment reply comment-body", f"<p>{prose()}</p>") for _ in range(int(rng.integers(1, 4))))),
        ])()

    def article() -> str:
        parts = [good(words(2, 9).capitalize(), pick(["h1", "h1", "h2"]))] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 8))):
            kind = rng.random()
            if kind < 0.66:
                parts.append(good(pick([prose, prose, sentence, lambda: words(1, 3) + "."])(), "p"))
            elif kind < 0.72:
                parts.append(good(words(1, 6).capitalize(), pick(["h2", "h3"])))
            elif kind < 0.77:
                parts.append("<ul>" + "".join(good(words(2, 9), "li") for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif kind < 0.80:
                parts.append(f"<blockquote>{good(prose(), 'p')}</blockquote>")
            elif kind < 0.83:
                parts.append("<table><tr>" + "".join(good(words(1, 4), "td") for _ in range(int(rng.integers(1, 4)))) + "</tr></table>")
            elif kind < 0.87:
                text = prose()
                main.append(text)
                parts.append(f"<p><b>{text}{pick(['</b>', ''])}<br>")
            elif kind < 0.90:
                text = prose()
                main.append(text)
                parts.append(f"<hr>{text}")
            else:
                parts.append(aside())
        return "".join(parts)

    out = []
    for _ in range(count):
        main.clear()
        head = f"<head><title>{words(2, 8)}</title><style>p{{margin:0}}</style></head>" if rng.random() < 0.9 else ""
        before = "".join(x for x in (f"<header>{pick([f'<h1>{words(1, 4)}</h1>', f'<p>{sentence()}</p>', ''])}{pick([links(), link()])}</header>" if rng.random() < 0.4 else "", f"<nav>{links()}</nav>" if rng.random() < 0.6 else "", aside() if rng.random() < 0.6 else "", aside() if rng.random() < 0.3 else ""))
        wrap = rng.random()
        inner = article()
        if wrap < 0.6:
            body = f"<article>{inner}</article>"
        elif wrap < 0.75:
            body = f"<main>{inner}</main>"
        else:
            body = named("div", "content article post entry story main text body", inner)
        if rng.random() < 0.25:
            body = f"<main>{body}</main>" if wrap < 0.6 else f"<div>{body}</div>"
        after = "".join(x for x in (aside() if rng.random() < 0.5 else "", aside() if rng.random() < 0.3 else "", f"<footer>{pick(['&copy; ', '© ', ''])}{words(1, 9)}{pick(['', links(), '. ' + sentence()])}</footer>" if rng.random() < 0.85 else ""))
        out.append((f"<!DOCTYPE html><html>{head}<body>{before}{body}{after}" + pick(["</body></html>", ""]), [html.unescape(x) for x in main]))
    return out


TRAINING_PAGES, SEED = 400, 61


def known_labels(blocks: list[tuple[tuple[int, ...], str, int]], main: list[str]) -> list[int]:
    """1 for the blocks that are main, in order."""
    labels, at = [], 0
    for _, text, _ in blocks:
        hit = at < len(main) and text == " ".join(main[at].split())
        labels.append(int(hit))
        at += hit
    return labels


@cache
def trained(count: int = TRAINING_PAGES) -> Labeller:
    pages, labels = [], []
    for page, main in generated_pages(count, SEED):
        blocks = page_blocks(page)
        pages.append(Encoded(blocks))
        labels.append(known_labels(blocks, main))
    model = Labeller()
    model.fit(pages, labels)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main of each page."""
    shipped = pages.sparkSession.sparkContext.broadcast(model or trained())
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            at = 0
            while at < len(pdf):
                blocks: list = []
                held = 0
                while at + len(blocks) < len(pdf) and len(blocks) < 2 * BATCH and held < MAX_BLOCKS:
                    blocks.append(page_blocks(pdf["html"].iat[at + len(blocks)] or ""))
                    held += len(blocks[-1])
                part = pdf.iloc[at : at + len(blocks)]
                at += len(blocks)
                chosen = shipped.value.label([Encoded(b) for b in blocks])
                texts = [" ".join(text for (_, text, _), p in zip(b, ps, strict=True) if p >= 0.5) for b, ps in zip(blocks, chosen, strict=True)]
                yield pd.DataFrame({
                    "page_id": part["page_id"].array, "url": part["url"].array, "text": texts, "n_chars": list(map(len, texts)),
                    "n_blocks": list(map(len, blocks)), "n_main": [int((p >= 0.5).sum()) for p in chosen],
                })

    return rows.mapInPandas(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, n_main long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
