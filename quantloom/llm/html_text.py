"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks in page order. Each leaf has a vector: hashed tags, classes and ids of the elements on its
path, hashed words of its whole text (a bucket counts by the logarithm of its different words), and its share of links,
length and place. Names of elements that hold most of the page's text are hashed apart from all others, so that what
the body or a form around the whole page is called says something else than the same name on a small block. A
bidirectional LSTM in numpy reads the sequence of all leaves of the page, so every block is labelled with the whole
document as context.

The labeller is trained here, on a bounded number of whole pages of those at hand, taken whatever their length. Their
texts fill rebuilt pages, in which wanted and unwanted blocks are known: names of both kinds are put on holders, wrappers
and blocks, wanted names on unwanted blocks too, and some pages lose all names. Of the pages themselves, those with
an article or main element give labels: what is inside the innermost one, and below it in no menu, header, footer, aside,
form, advert, notice or comment. Other pages give no labels, as nothing says which of their blocks are wanted.

A batch is bounded by its leaves, and a long page is read in stretches that hand on the state of the LSTM, so memory
beyond a page's own leaves is bounded.

Defined results: null and empty pages, and pages without main text, give an empty text and 0 characters. Open
tags at the end of a page are dropped, open comments and scripts run to its end. Repeated rows each get their own result.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

PATH_DIM, WORD_DIM, EXTRA = 1024, 32, 8
#: Leaves in a batch of pages, and steps of a stretch of a long page.
BATCH_LEAVES, STRETCH = 8192, 4096
#: Share of a page's characters from which an element counts as one around the page.
AROUND = 0.5

#: An element of a path: a number that is its own in the page, and its tag, classes, ids and role.
Element = tuple[int, tuple[str, ...]]
Leaf = tuple[tuple[Element, ...], str, int]

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that an opening tag of the same kind ends.
_ENDS_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def leaves(page: str | None) -> list[Leaf]:
    """(path, text, characters inside links) of each leaf block with text, in page order; white space is single blanks."""
    out: list[Leaf] = []
    stack: list[tuple[str, Element]] = []
    held: list[str] = []
    links = linked = opened = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((tuple(e for t, e in stack if t not in _INLINE), text, linked))
            held.clear()
        linked = 0

    page, at = page or "", 0
    while True:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            held.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if tag not in _INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in _INLINE and any(t not in _INLINE for t, _ in stack[i:]):
                        del stack[i]
                    else:
                        del stack[i:]
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE and stack[i][0] != "p":
                    break
            links = sum(t == "a" for t, _ in stack)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in _RAW:
            if tag not in _INLINE:
                flush()
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in _VOID or attrs.endswith("/") and tag not in ("p", "div"):
            if tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
            if tag in _ENDS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] not in _INLINE:
                        break
            if tag in _ENDS_SELF:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if stack[i][0] in _ENDS_SELF[tag]:
                        break
        names: tuple[str, ...] = ()
        if attrs and tag not in _INLINE:
            names = tuple(w.lower() for g in _NAMES.findall(attrs) for w in _PARTS.findall("".join(g)))
        opened += 1
        stack.append((tag, (opened, (tag, *names))))
        links += tag == "a"
    flush()
    return out


@dataclass
class Vectors:
    """What the labeller reads of a page: for each leaf the hashed names of its path, and dense numbers."""

    paths: list[tuple[int, ...]]
    dense: np.ndarray

    def __len__(self) -> int:
        return len(self.paths)


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % PATH_DIM


def vectors(page: list[Leaf]) -> Vectors:
    chars: dict[int, int] = defaultdict(int)
    for path, text, _ in page:
        for number, _ in path:
            chars[number] += len(text)
    most = AROUND * sum(len(t) for _, t, _ in page)
    dense = np.zeros((len(page), WORD_DIM + EXTRA), np.float32)
    hashed: dict[int, tuple[int, ...]] = {}
    buckets: dict[str, int] = {}
    paths, known, found, extra = [], {}, [], []
    for i, (path, text, linked) in enumerate(page):
        ids = []
        for number, names in path:
            if number not in hashed:
                hashed[number] = tuple(_hashed("~" * (chars[number] > most) + name) for name in names)
            ids += hashed[number]
        key = tuple(sorted(set(ids)))
        paths.append(known.setdefault(key, key))
        words = text.split()
        for w in set(words):
            k = buckets.get(w)
            if k is None:
                k = buckets[w] = zlib.crc32(w.encode("utf-8", "replace")) % WORD_DIM
            found.append(len(extra) * WORD_DIM + k)
        n = len(text)
        extra.append((min(1.0, linked / n), min(2.0, n / 400), min(2.0, len(words) / 40), (i + 1) / len(page), 1.0 / (i + 1), float(text[-1] in ".!?"), min(2.0, len(page) / 50), n / (2 * most)))
        if len(extra) == STRETCH or i + 1 == len(page):
            first, counts = i + 1 - len(extra), np.bincount(np.array(found, np.int64), minlength=len(extra) * WORD_DIM)
            dense[first : i + 1, :WORD_DIM] = np.log2(1 + counts.reshape(-1, WORD_DIM)) / 8
            dense[first : i + 1, WORD_DIM:] = extra
            found, extra = [], []
    return Vectors(paths, dense)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM with one output for each step, over batches of pages; pages shorter than others are masked."""

    def __init__(self, hidden: int = 16, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.1, (PATH_DIM, 4 * hidden))
            # the state and the dense numbers of a step are one row: products stay small
            self.p[f"h{d}"] = np.concatenate([rng.normal(0, 0.2, (hidden, 4 * hidden)), rng.normal(0, 0.1, (WORD_DIM + EXTRA, 4 * hidden))])
            self.p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
            self.p[f"o{d}"] = rng.normal(0, 0.1, hidden)
        self.p["o"] = np.zeros(1)

    def _inputs(self, pages: list[Vectors], d: str, first: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """(gate inputs by paths, dense numbers, mask) of leaves first to stop of each page, and what the gradient needs."""
        numbers: dict[tuple[int, ...], int] = {}
        kind, row, step = [], [], []
        dense = np.zeros((len(pages), stop - first, WORD_DIM + EXTRA), np.float32)
        for i, p in enumerate(pages):
            some = p.paths[first:stop]
            kind += [numbers.setdefault(x, len(numbers)) for x in some]
            row += [i] * len(some)
            step += range(len(some))
            dense[i, : len(some)] = p.dense[first:stop]
        w = self.p[f"x{d}"]
        ids = np.fromiter((k for x in numbers for k in x), np.int64)
        sizes = np.fromiter((len(x) for x in numbers), np.int64)
        of_path = np.add.reduceat(w[np.concatenate([ids, [0]])], np.cumsum(sizes) - sizes, axis=0)
        of_path[sizes == 0] = 0
        z, mask = np.zeros((len(pages), stop - first, 4 * self.hidden), w.dtype), np.zeros((len(pages), stop - first), bool)
        mask[row, step] = True
        z[row, step] = of_path[kind] + self.p[f"c{d}"]
        return z, dense, mask, (ids, sizes, np.array(kind), row, step)

    def _run(self, pages: list[Vectors], d: str, keep: list | None = None) -> np.ndarray:
        """What one direction adds to the output of each step."""
        n, steps = self.hidden, max(map(len, pages))
        w, o = self.p[f"h{d}"], self.p[f"o{d}"]
        h, c, out = np.zeros((len(pages), n), w.dtype), np.zeros((len(pages), n), w.dtype), np.zeros((len(pages), steps))
        stretches = [(a, min(a + STRETCH, steps)) for a in range(0, steps, STRETCH)]
        for first, stop in stretches if d == "f" else reversed(stretches):
            inputs, dense, mask, used = self._inputs(pages, d, first, stop)
            whole = mask.all()
            for t in range(stop - first) if d == "f" else range(stop - first - 1, -1, -1):
                row = np.concatenate([h, dense[:, t]], axis=1)
                z = row @ w
                z += inputs[:, t]
                gates = _sigmoid(z[:, : 3 * n])
                i, f, r, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
                m = None if whole else mask[:, t, None]
                new_c = f * c + i * g
                new_c = new_c if whole else np.where(m, new_c, c)
                tanh_c = np.tanh(new_c)
                new_h = r * tanh_c if whole else np.where(m, r * tanh_c, h)
                if keep is not None:
                    keep.append((first + t, row, c, i, f, r, g, tanh_c, mask[:, t, None], new_h))
                h, c = new_h, new_c
                out[:, first + t] = h @ o
            if keep is not None:
                keep.append(used)
        return out

    def probabilities(self, pages: list[Vectors]) -> np.ndarray:
        return _sigmoid(self._run(pages, "f") + self._run(pages, "b") + self.p["o"])

    def gradients(self, pages: list[Vectors], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss over pages of at most one stretch."""
        n, grads = self.hidden, {}
        kept: dict[str, list] = {"f": [], "b": []}
        p = _sigmoid(sum(self._run(pages, d, kept[d]) for d in "fb") + self.p["o"])
        slope = np.zeros_like(p)
        for i, y in enumerate(labels):
            slope[i, : len(y)] = (p[i, : len(y)] - y) / sum(map(len, labels))
        grads["o"] = np.array([slope.sum()])
        for d in "fb":
            ids, sizes, kind, row, step = kept[d].pop()
            dh, dc = np.zeros((len(pages), n)), np.zeros((len(pages), n))
            z_slope = np.zeros((*slope.shape, 4 * n))
            w, o = np.zeros_like(self.p[f"h{d}"]), np.zeros(n)
            for t, x, c, i, f, r, g, tanh_c, m, new_h in reversed(kept[d]):
                o += slope[:, t] @ new_h
                dh = dh + slope[:, t, None] * self.p[f"o{d}"]
                live = np.where(m, dh, 0.0)
                step_c = np.where(m, dc + live * r * (1 - tanh_c**2), 0.0)
                dz = np.concatenate([step_c * g * i * (1 - i), step_c * c * f * (1 - f), live * tanh_c * r * (1 - r), step_c * i * (1 - g**2)], axis=1)
                z_slope[:, t] = dz
                w += x.T @ dz
                dh = np.where(m, dz @ self.p[f"h{d}"][:n].T, dh)
                dc = np.where(m, step_c * f, dc)
            flat = z_slope[row, step]
            order = np.argsort(kind, kind="stable")
            by_path = np.add.reduceat(flat[order], np.searchsorted(kind[order], np.arange(len(sizes))), axis=0)
            x = np.zeros_like(self.p[f"x{d}"])
            np.add.at(x, ids, np.repeat(by_path, sizes, axis=0))
            grads |= {f"x{d}": x, f"h{d}": w, f"c{d}": flat.sum(axis=0), f"o{d}": o}
        return grads

    def fit(self, pages: list[Vectors], labels: list[np.ndarray], epochs: int = 10, batch: int = 32, rate: float = 0.02, seed: int = 42) -> BlockLabeller:
        rng, step = np.random.default_rng(seed), 0
        pages, labels = in_stretches(pages, labels)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            for some in batches_by_length(pages, rng.permutation(len(pages)).tolist(), batch, rng):
                step += 1
                for k, g in self.gradients([pages[i] for i in some], [labels[i] for i in some]).items():
                    g = np.clip(g, -1, 1) + 1e-5 * self.p[k]
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g**2
                    lr = rate * (0.5 if epoch > epochs // 2 else 1.0) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    self.p[k] = self.p[k] - lr * mean[k] / (np.sqrt(square[k]) + 1e-8)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def label(self, pages: list[Vectors], batch: int = 32) -> list[np.ndarray]:
        """True for the main blocks of each page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        for some in batches_by_length(pages, [i for i, p in enumerate(pages) if len(p)], batch):
            p = self.probabilities([pages[i] for i in some])
            for row, i in enumerate(some):
                out[i] = p[row, : len(pages[i])] >= 0.5
        return out


def in_stretches(pages: list[Vectors], labels: list[np.ndarray]) -> tuple[list[Vectors], list[np.ndarray]]:
    """All leaves of all pages, longer pages as several sequences to learn from."""
    cuts = [(i, a) for i, p in enumerate(pages) for a in range(0, len(p), STRETCH)]
    return [Vectors(pages[i].paths[a : a + STRETCH], pages[i].dense[a : a + STRETCH]) for i, a in cuts], [labels[i][a : a + STRETCH] for i, a in cuts]


def batches_by_length(pages: list[Vectors], which: list[int], batch: int, rng: np.random.Generator | None = None) -> list[list[int]]:
    """Batches of whole pages of like length, with not too many leaves at once; in random order if there is a generator."""
    order, out, at = sorted(which, key=lambda i: len(pages[i])), [], 0
    while at < len(order):
        some = [order[at]]
        while len(some) < batch and at + len(some) < len(order) and len(pages[order[at + len(some)]]) * (len(some) + 1) <= BATCH_LEAVES:
            some.append(order[at + len(some)])
        at += len(some)
        out.append(some)
    return out if rng is None else [out[i] for i in rng.permutation(len(out))]


#: Names that mark a block as unwanted, and as wanted, when labels and pages to learn from are made.
UNWANTED = frozenset(
    "nav header footer aside form menu sidebar widget ad ads advert advertisement advertising sponsored promo banner cookie cookies consent notice alert popup modal newsletter subscribe signup comment comments reply replies discussion share social related recommended breadcrumb breadcrumbs pagination pager toolbar masthead copyright legal disclaimer login search button head title navigation contentinfo complementary topbar navbar toc byline tags meta feedback".split()
)
WANTED = frozenset("article main".split())
_UNWANTED_NAMES = tuple(sorted(UNWANTED - {"head", "title", "button", "meta", "form"}))
_WANTED_NAMES = tuple("article content post entry story body text main page blog news detail".split())
_AFFIXES = tuple("site page top bottom left right global inner wrapper box block area section item list primary secondary large module region container js".split())
_AROUND = ("<nav>{}</nav>", "<nav><ul><li>{}</li><li>{}</li><li>{}</li></ul></nav>", "<header>{}</header>", "<header><p>{}</p></header>", "<footer>{}</footer>", "<footer><p>{}</p><p>{}</p></footer>", "<aside>{}</aside>", "<aside><h3>{}</h3><p>{}</p></aside>", '<form action="/s"><p>{}</p><label>{}</label></form>', "<form>{}</form>", '<div role="navigation">{}</div>', '<div role="complementary"><p>{}</p></div>', '<div role="contentinfo">{}</div>', '<ul class="menu"><li><a href="/a">{}</a></li><li><a href="/b">{}</a></li></ul>', '<div class="related"><h4>{}</h4><a href="/r">{}</a></div>', '<div id="footer"><p>{}</p></div>', '<div class="sidebar"><h3>{}</h3><p>{}</p></div>', '<div class="ad">{}</div>')
_INSIDES = ("{}", "<p>{}</p>", "<p>{}</p><p>{}</p>", "<h3>{}</h3><p>{}</p>", "<ul><li>{}</li><li>{}</li></ul>", '<ul><li><a href="/x">{}</a></li><li><a href="/y">{}</a></li></ul>', "<div><p>{}</p></div><div><p>{}</p></div>", '<a href="/z">{}</a>', "<h3>{}</h3><div><b>{}</b><p>{}</p></div><div><b>{}</b><p>{}</p></div>", "<span>{}</span>")
_HOLDERS = ("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<article class="post"><div class="body">{}</div></article>', '<div role="main">{}</div>', "<main><div>{}</div></main>")
_BLOCKS = ("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", "<ul><li>{}</li><li>{}</li></ul>", "<p><b>{}</b> {}</p>", '<p>{} <a href="/l">{}</a></p>', "<pre>{}</pre>", "<table><tr><td>{}</td><td>{}</td></tr></table>", "<div>{}</div>", "<ol><li>{}</li></ol>", "<figure><figcaption>{}</figcaption></figure>")


_REPLIES = frozenset("comment comments reply replies discussion feedback".split())


def wanted_by_markup(path: tuple[Element, ...]) -> bool:
    """Whether a leaf is inside an article or main element (tags, not class names), with nothing unwanted from there on inwards.

    An element's unwanted names count before anything else of it, so main-nav or article-comments are unwanted; an article or main element
    that has one is still the page's article if it is the outermost one and not named after replies (as with-sidebar).
    """
    inside = False
    for _, (tag, *names) in path:
        unwanted = tag in UNWANTED or not UNWANTED.isdisjoint(names)
        if tag in WANTED and not (unwanted and inside) and _REPLIES.isdisjoint(names):
            inside = True
        elif inside and unwanted:
            return False
    return inside


class Rebuilder:
    """Makes pages out of given texts, with known wanted and unwanted blocks."""

    MARK = "⸺"  # put before wanted text, taken away again

    def __init__(self, rng: random.Random, texts: list[str]):
        self.rng, self.texts = rng, texts

    def _text(self, wanted: bool) -> str:
        t = self.rng.choice(self.texts)
        if self.rng.random() < (0.25 if wanted else 0.6):
            t = " ".join(t.split()[: self.rng.randint(1, 12)])
        return (self.MARK if wanted else "") + entities.escape(t)

    def _fill(self, pattern: str, wanted: bool) -> str:
        return re.sub(r"\{\}", lambda _: self._text(wanted), pattern)

    def _names(self, *kinds: tuple[str, ...]) -> str:
        """Attributes with a word of each kind, sometimes with others around it."""
        rng = self.rng
        words = [rng.choice(k) for k in kinds]
        if rng.random() < 0.5:
            words.insert(rng.randint(0, len(words)), rng.choice(_AFFIXES))
        joined = rng.choice(("-", "_", " ", "")).join(words) if len(words) > 1 else words[0]
        if len(words) > 1 and not set("-_ ") & set(joined):
            joined = words[0] + "".join(w.title() for w in words[1:])
        return f'{rng.choice(("class", "class", "id"))}="{joined}"'

    def unwanted(self) -> str:
        rng = self.rng
        if rng.random() < 0.4:
            return self._fill(rng.choice(_AROUND), False)
        kinds = (_WANTED_NAMES, _UNWANTED_NAMES) if rng.random() < 0.25 else (_UNWANTED_NAMES,)
        tag = rng.choice(("div", "div", "div", "section", "p" if rng.random() < 0.3 else "div"))
        inside = "{}" if tag == "p" else rng.choice(_INSIDES)
        return f"<{tag} {self._names(*kinds)}>{self._fill(inside, False)}</{tag}>"

    def around(self, page: str) -> str:
        """Elements around the whole page, called anything at all."""
        rng = self.rng
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            if rng.random() < 0.25:
                page = f'<form method="post" action="/">{page}</form>'
            else:
                kinds = [rng.choice((_UNWANTED_NAMES, _WANTED_NAMES, _AFFIXES)) for _ in range(rng.randint(0, 3))]
                page = f"<div {self._names(*kinds) if kinds else ''}>{page}</div>"
        kinds = [rng.choice((_UNWANTED_NAMES, _WANTED_NAMES, _AFFIXES)) for _ in range(rng.choice((0, 0, 1, 2, 3)))]
        return f"<body {self._names(*kinds) if kinds else ''}>{page}</body>"

    def holder(self, inner: str) -> str:
        rng, kind = self.rng, self.rng.random()
        if kind < 0.4:
            return rng.choice(_HOLDERS).replace("{}", inner)
        if kind < 0.85:
            out = f"<{(tag := rng.choice(('div', 'div', 'section', 'td')))} {self._names(_WANTED_NAMES)}>{inner}</{tag}>"
        else:
            out = f"<{(tag := rng.choice(('div', 'div', 'td')))}>{inner}</{tag}>"
        return f"<table><tr>{out}</tr></table>" if "<td" in out[:4] else out

    def page(self) -> tuple[list[Leaf], np.ndarray]:
        rng = self.rng
        inner = ["<h1>" + self._text(True) + "</h1>"] * (rng.random() < 0.8) + [self._fill(rng.choice(_BLOCKS), True) for _ in range(rng.choice((1, 3, 6, 12, 24)))]
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            inner.insert(rng.randint(1, len(inner)), self.unwanted())
        before, after = ("".join(self.unwanted() for _ in range(rng.randint(0, 4))) for _ in "ba")
        if rng.random() < 0.2:
            before = "<header><h1>" + self._text(False) + "</h1></header>" + before
        html = self.around(before + self.holder("".join(inner)) + after)
        if rng.random() < 0.06:
            html = re.sub(r' (?:class|id|role)="[^"]*"', "", html)
        got = leaves(f"<html><head><title>{self._text(False)}</title></head>{html}</html>")
        return [(p, t.replace(self.MARK, ""), n) for p, t, n in got], np.array([self.MARK in t for _, t, _ in got], float)


def marked_by_markup(page: list[Leaf]) -> bool:
    """Whether a page says which of its leaves are wanted: those inside its article or main element hold most of its sentences (leaves of eight words or more, by length)."""
    sentences = [(wanted_by_markup(path), len(t)) for path, t, _ in page if len(t.split()) >= 8] or [(wanted_by_markup(path), len(t)) for path, t, _ in page]
    return 2 * sum(n for w, n in sentences if w) > sum(n for _, n in sentences)


def examples(pages: list[list[Leaf]], n_rebuilt: int, seed: int = 42) -> list[tuple[list[Leaf], np.ndarray]]:
    """Leaves and labels to train on: rebuilt pages, and all leaves of each page with semantic markup."""
    texts = sorted({t for p in pages for _, t, _ in p})
    if not texts:
        return []
    rebuilder = Rebuilder(random.Random(seed), texts)
    made = [rebuilder.page() for _ in range(n_rebuilt)]
    made += [(p, np.array([float(wanted_by_markup(path)) for path, _, _ in p])) for p in pages if marked_by_markup(p)]
    return [(p, y) for p, y in made if p]


def train(pages: DataFrame, *, html: str = "html", max_pages: int = 160, max_bytes: int = 64 << 20, n_rebuilt: int = 1200, seed: int = 42) -> BlockLabeller | None:
    """Trains on at most ``max_pages`` different whole pages of any length, those with the smallest hashes, and on pages rebuilt from their texts.

    Pages beyond ``max_bytes`` together aren't brought to the driver, but for the first.
    """
    mark = F.xxhash64(F.lit(seed), F.col(html))
    ids = pages.where(F.col(html) != "").select(mark.alias("_m"), F.octet_length(html).alias("_n")).groupBy("_m").agg(F.max("_n").alias("_n")).orderBy("_m").limit(max_pages)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over max_pages rows
    ids = saved(ids.withColumn("_before", before).where((F.col("_before") == 0) | (F.col("_before") + F.col("_n") <= max_bytes)).select("_m"))
    filled = pages.where(F.col(html) != "").select(mark.alias("_m"), F.col(html).alias("html"))
    sample = [r["html"] for r in filled.join(F.broadcast(ids), "_m").groupBy("_m").agg(F.min("html").alias("html")).orderBy("_m").collect()]
    made = examples([leaves(p) for p in sample], n_rebuilt, seed)
    return BlockLabeller(seed=seed).fit([vectors(p) for p, _ in made], [y for _, y in made]) if made else None


def main_texts(model: BlockLabeller, pages) -> Iterator[str]:
    """The main text of each page, some pages at a time so that their leaves are bounded, or one longer page."""
    held: list[list[Leaf]] = []
    size = 0

    def done() -> Iterator[str]:
        for page, marked in zip(held, model.label([vectors(p) for p in held]), strict=True):
            yield "\n".join(t for (_, t, _), m in zip(page, marked, strict=True) if m)

    for html in pages:
        held.append(leaves(html))
        size += len(held[-1])
        if size >= BATCH_LEAVES or len(held) >= 512:
            yield from done()
            held, size = [], 0
    yield from done()


def extract(pages: DataFrame, *, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",), model: BlockLabeller | None = None, **options) -> DataFrame:
    """(key, keep, text, n_chars) of each whole page."""
    small_batches(pages.sparkSession)
    model = model or train(pages, html=html, **options)

    @F.pandas_udf("string")
    def main_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in parts:
            yield pd.Series(list(main_texts(model, some)), dtype=object)

    out = pages.select(key, *keep, (F.lit("") if model is None else main_text(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
