"""Main text of web pages: a recurrent labeller of blocks.

A page is read as the sequence of its leaf blocks: text between block-level tags. Each block has
a vector of its tag path (tag names and words of class, id and role, hashed), of its words
(hashed) and of a few figures. A bidirectional LSTM in numpy reads the whole sequence in both
directions, so every block is judged with all of the page before and after it at hand.

The network is trained here, on pages that ``training_pages`` composes with known labels: many
layouts of articles, menus, headers, footers, sidebars, notices, adverts, forms and comments,
filled with random words. It depends on no table, and always gives the same weights.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import raw

PATH_BUCKETS, WORD_BUCKETS, FIGURES = 128, 32, 8
INPUT = PATH_BUCKETS + WORD_BUCKETS + FIGURES
HIDDEN = 20
PAGES, EPOCHS, BATCH, SEED = 960, 10, 32, 5
#: Blocks that are read together at inference, padding included, and those of them that have their
#: vectors at one time: what bounds the memory of pages of any length.
BATCH_BLOCKS, STEP_BLOCKS = 1 << 15, 1 << 12

# ---------------------------------------------------------------- blocks

#: Elements whose content is never shown as text of the page, or belongs to a form's fields. What is
#: in others, like formulas, drawings and fallbacks of media, is left to the network.
_SKIPPED = {"script", "style", "template", "iframe", "head", "title", "select", "textarea"}
_RAW = {"script", "style", "textarea", "title", "iframe"}
#: What a head holds; the start of any other element ends it, as its end tag may be left out.
_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Inline elements; all others border a block.
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: An open element of the left closes when one of the right begins.
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"},
}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/a-zA-Z!?][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, and whether the element is hidden."""
    out = []
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("hidden")
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            out.append("hidden")
        elif key != "aria-hidden":
            out += [w.lower() for w in _NAME_WORD.findall(value)]
    return tuple(out)


class Path:
    """An element's place: itself and all elements that it lies in, at any depth.

    Places are nodes of a tree that pages share, so that equal places are read once. PLACES of them
    are kept; later ones belong to their page.
    """

    __slots__ = ("parent", "tag", "names", "depth", "inner", "sums")
    kept = 0

    def __init__(self, parent: Path | None, tag: str, names: tuple[str, ...]):
        self.parent, self.tag, self.names = parent, tag, names
        self.depth = parent.depth + 1 if parent is not None else 0
        self.inner: dict | None = None
        self.sums: np.ndarray | None = None

    def child(self, tag: str, names: tuple[str, ...]) -> Path:
        found = self.inner.get((tag, names)) if self.inner is not None else None
        if found is None:
            found = Path(self, tag, names)
            if Path.kept < PLACES:
                Path.kept += 1
                self.inner = self.inner if self.inner is not None else {}
                self.inner[tag, names] = found
        return found

    def vector(self) -> np.ndarray:
        """Tags, the outer ones for less and less, and all names, hashed."""
        node, above = self, []
        while node.sums is None and node.parent is not None:
            above.append(node)
            node = node.parent
        sums = node.sums if node.sums is not None else np.zeros((2, PATH_BUCKETS), np.float32)
        for node in reversed(above):
            sums = sums * _FADE
            sums[0, _bucket(node.tag, PATH_BUCKETS)] += 1
            for w in node.names:
                sums[1, _bucket("." + w, PATH_BUCKETS)] += 1
            # of a page's own places a few will do: the others are a few steps away
            if node.depth % 32 == 0 or Path.kept < PLACES:
                node.sums = sums
        return np.minimum(sums[0] + sums[1], 2)


#: Places that pages share, and how much less the tag of the next outer element counts; names don't fade.
PLACES = 1 << 15
_FADE = np.array([[0.85], [1.0]], np.float32)
_ROOT = Path(None, "", ())


def _root() -> Path:
    """A tree of places for a new page; a full one makes way."""
    global _ROOT
    if Path.kept >= PLACES:
        _ROOT, Path.kept = Path(None, "", ()), 0
    return _ROOT


def blocks(page: str) -> list[tuple[Path, str, int]]:
    """(place, text, characters in links) of every block with text, in page order.

    Character references are decoded, white space is one space, ends are trimmed. Tags that are
    never closed, closed twice or out of order do no harm. Elements may be nested to any depth.
    """
    out: list[tuple[Path, str, int]] = []
    path: list[tuple[str, Path]] = []
    root = _root()
    text: list[str] = []
    linked = skip = 0
    where: Path | None = None
    open_: dict[str, int] = {}

    def close():
        nonlocal linked, where
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append((where, whole, linked))
            text.clear()
        linked, where = 0, None

    def pop(to: int):
        nonlocal skip
        for name, _ in path[to:]:
            open_[name] -= 1
            skip -= name in _SKIPPED
        del path[to:]

    def words(piece: str):
        nonlocal linked, where
        if path and path[-1][0] == "head" and piece and not piece.isspace():
            pop(len(path) - 1)
        if not skip and piece:
            if where is None and not piece.isspace():
                where = path[-1][1] if path else root
            text.append(piece)
            linked += len(piece.strip()) if open_.get("a") else 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name not in _INLINE:
            close()
        if not m[1] and path and path[-1][0] == "head" and name not in _HEAD:
            pop(len(path) - 1)
        if m[1]:
            for k in range(len(path) - 1, -1, -1) if open_.get(name) else ():
                if path[k][0] == name:
                    pop(k)
                    break
                if name in _INLINE and path[k][0] not in _INLINE:
                    break  # a stray inline end tag doesn't close blocks
            continue
        if name in _VOID:
            continue
        if name not in _INLINE:
            # a block ends an open paragraph with all that it left open
            for k in range(len(path) - 1, -1, -1) if open_.get("p") else ():
                if path[k][0] == "p":
                    pop(k)
                    break
                if path[k][0] not in _INLINE:
                    break
        closing = next((k for k in range(len(path) - 1, max(-1, len(path) - 6), -1) if name in _CLOSED_BY.get(path[k][0], ())), None)
        if closing is not None and not any(x[0] in ("ul", "ol", "dl", "table") for x in path[closing + 1 :]):
            pop(closing)
        if name == "a":
            while open_.get("a"):
                pop(next(k for k in range(len(path) - 1, -1, -1) if path[k][0] == "a"))
        if m[3].rstrip().endswith("/") and (name in ("svg", "iframe", "math") or open_.get("svg") or open_.get("math")):
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        path.append((name, (path[-1][1] if path else root).child(name, _names(m[3]) if m[3] else ())))
        open_[name] = open_.get(name, 0) + 1
        skip += name in _SKIPPED
    close()
    return out


# ---------------------------------------------------------------- vectors


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


def vectors(page_blocks: list[tuple[Path, str, int]], start: int = 0, end: int | None = None) -> np.ndarray:
    """One row for each block (of a part of a page): place, words, figures."""
    part = page_blocks[start:end]
    x = np.zeros((len(part), INPUT))
    for i, (path, text, linked) in enumerate(part):
        words = text.split()
        x[i, :PATH_BUCKETS] = path.vector()
        hashed = np.fromiter((_bucket(w.lower(), WORD_BUCKETS) for w in words), np.int64, len(words))
        x[i, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = np.bincount(hashed, minlength=WORD_BUCKETS) / len(words)
        n = len(text)
        x[i, -FIGURES:] = (
            np.log1p(len(words)) / 4, np.log1p(n) / 6, min(1.0, linked / n), text[-1] in ".!?:;…", sum(map(text.count, ",.")) / n * 10,
            (start + i) / len(page_blocks), text[0].isupper(), "©" in text,
        )
    return x


# ---------------------------------------------------------------- the network


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _step(z, c, size):
    i, f, o = (_sigmoid(z[:, k * size : (k + 1) * size]) for k in range(3))
    g = np.tanh(z[:, 3 * size :])
    new = f * c + i * g
    return i, f, o, g, new, np.tanh(new)


def _read(x, mask, w, u, b, state=None):
    """One direction over (steps, pages, inputs), from a state on: outputs and the last state."""
    steps, pages, _ = x.shape
    size = u.shape[0]
    h, c = state or (np.zeros((pages, size)), np.zeros((pages, size)))
    put, out = x @ w + b, np.zeros((steps, pages, size))
    for s in range(steps):
        _, _, o, _, new, t = _step(put[s] + h @ u, c, size)
        m = mask[s][:, None]
        out[s] = h = np.where(m, o * t, h)
        c = np.where(m, new, c)
    return out, (h, c)


def _trace(x, mask, w, u, b):
    """As _read, with what the backward pass needs of every step."""
    steps, pages, _ = x.shape
    size = u.shape[0]
    h, c = np.zeros((pages, size)), np.zeros((pages, size))
    put = x @ w + b
    trace = []
    for s in range(steps):
        i, f, o, g, new, t = _step(put[s] + h @ u, c, size)
        m = mask[s][:, None]
        trace.append((h, c, i, f, o, g, t))
        h, c = np.where(m, o * t, h), np.where(m, new, c)
        trace[-1] += (h,)
    return np.array([t[-1] for t in trace]).reshape(steps, pages, size), trace


def _unread(x, mask, u, trace, dh_out):
    """Gradients of one direction."""
    steps, pages, _ = x.shape
    size = u.shape[0]
    dh, dc = np.zeros((pages, size)), np.zeros((pages, size))
    dz = np.zeros((steps, pages, 4 * size))
    du = np.zeros_like(u)
    for s in range(steps - 1, -1, -1):
        h, c, i, f, o, g, t, _ = trace[s]
        m = mask[s][:, None]
        dh = dh + dh_out[s]
        a = np.where(m, dh, 0)
        d = np.where(m, dc + a * o * (1 - t * t), 0)
        z = np.concatenate([d * g * i * (1 - i), d * c * f * (1 - f), a * t * o * (1 - o), d * i * (1 - g * g)], axis=1)
        dz[s] = z
        du += h.T @ z
        dh, dc = np.where(m, z @ u.T, dh), np.where(m, d * f, dc)
    return np.einsum("spi,spk->ik", x, dz), du, dz.sum((0, 1))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["w" + d] = r.normal(0, 0.12, (INPUT, 4 * HIDDEN))
            self.p["u" + d] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p["b" + d] = bias
        # the block's own vector is also seen directly
        self.p["v"] = r.normal(0, 0.2, 2 * HIDDEN)
        self.p["s"] = np.zeros(INPUT)
        self.p["a"] = np.zeros(1)

    def _both(self, x, mask):
        p = self.p
        hf, tf = _trace(x, mask, p["wf"], p["uf"], p["bf"])
        hb, tb = _trace(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"])
        return np.concatenate([hf, hb[::-1]], axis=2), tf, tb

    def scores(self, x, mask):
        h, _, _ = self._both(x, mask)
        return _sigmoid(h @ self.p["v"] + x @ self.p["s"] + self.p["a"])

    def gradients(self, x, mask, y):
        p = self.p
        h, tf, tb = self._both(x, mask)
        d = (_sigmoid(h @ p["v"] + x @ p["s"] + p["a"]) - y) * mask / mask.sum()
        dh = d[:, :, None] * p["v"]
        g = {"v": np.einsum("sp,spk->k", d, h), "s": np.einsum("sp,spk->k", d, x), "a": np.array([d.sum()])}
        g["wf"], g["uf"], g["bf"] = _unread(x, mask, p["uf"], tf, dh[:, :, :HIDDEN])
        g["wb"], g["ub"], g["bb"] = _unread(x[::-1], mask[::-1], p["ub"], tb, dh[::-1, :, HIDDEN:])
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01):
        """Adam over shuffled batches; pages are (vectors, labels)."""
        r = np.random.default_rng(SEED)
        one, two, t = *({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), 0
        for epoch in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                group = [pages[k] for k in order[at : at + BATCH]]
                x, mask = _padded([g[0] for g in group])
                y = np.zeros(mask.shape)
                for k, g in enumerate(group):
                    y[: len(g[1]), k] = g[1]
                t += 1
                now = rate * (0.3 if epoch >= epochs - 2 else 1)
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - now * one[k] / (1 - 0.9**t) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def label(self, pages: list) -> list[np.ndarray]:
        """Whether each block of each page (its blocks, or their vectors) is main text.

        Pages of similar length share a batch, and a batch is read a few steps at a time.
        """
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end - at + 1) <= BATCH_BLOCKS:
                end += 1
            odds = self._odds([pages[k] for k in order[at:end]])
            for j, k in enumerate(order[at:end]):
                out[k] = odds[: len(pages[k]), j] > 0
            at = end
        return out

    def _odds(self, pages: list) -> np.ndarray:
        """The output's log-odds (steps, pages): each direction adds its share, chunk by chunk, and keeps its state."""
        p, steps = self.p, max(map(len, pages))
        chunk = max(1, STEP_BLOCKS // len(pages))
        out = np.full((steps, len(pages)), self.p["a"][0])
        for turn, w, u, b, v in ((1, "wf", "uf", "bf", p["v"][:HIDDEN]), (-1, "wb", "ub", "bb", p["v"][HIDDEN:])):
            state = None
            for s in range(0, steps, chunk)[::turn]:
                e = min(steps, s + chunk)
                x, mask = _padded([g[s:e] if isinstance(g, np.ndarray) else vectors(g, s, e) for g in pages], e - s)
                h, state = _read(x[::turn], mask[::turn], p[w], p[u], p[b], state)
                out[s:e] += h[::turn] @ v + (x @ p["s"] if turn > 0 else 0)
        return out


def _padded(xs: list[np.ndarray], steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    steps = steps or max(map(len, xs))
    x, mask = np.zeros((steps, len(xs), INPUT)), np.zeros((steps, len(xs)), bool)
    for k, v in enumerate(xs):
        x[: len(v), k] = v
        mask[: len(v), k] = True
    return x, mask


# ---------------------------------------------------------------- training pages

_SYLLABLES = "the an er on re th in ti es or ou le de la que en un ver sch ei che os as ra ción ba ko mi su ne da ri po lu".split()
_BOILER_NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "main-nav", "top-menu", "breadcrumb", "breadcrumbs", "nav-links", "pagination", "toc"],
    "header": ["header", "site-header", "masthead", "page-header", "top-bar", "branding", "logo", "topbar"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "bottom", "colophon", "legal", "footer-links"],
    "sidebar": ["sidebar", "side-bar", "widget", "widget-area", "aside", "related", "related-posts", "recent", "popular", "trending", "recommended", "tags", "author-box"],
    "notice": ["notice", "cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "banner", "warning", "popup", "modal", "overlay", "paywall", "disclaimer"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-slot", "adbox", "banner-ad"],
    "form": ["form", "search", "search-form", "newsletter", "subscribe", "signup", "login", "contact", "contact-form", "poll"],
    "comments": ["comments", "comment", "comment-list", "comment-body", "reply", "responses", "discussion", "respond", "disqus"],
    "share": ["share", "social", "share-buttons", "social-links", "sharing", "follow"],
}
_BOILER_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section", "notice": "div", "advert": "div", "share": "div"}
_MAIN_NAMES = ["content", "main", "article", "post", "entry", "entry-content", "post-content", "article-body", "story", "main-content", "post-body", "text", "body-text", "page-content", "article-content", "maincontent"]


def training_pages(n: int = PAGES, seed: int = SEED):
    """Pages of random words and layouts, as (html, texts of the main blocks, in order)."""
    r = random.Random(seed)

    def word():
        return "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def phrase(a, b):
        return " ".join(word() for _ in range(r.randint(a, b))).capitalize()

    def sentence():
        text = phrase(1, 16) + r.choice((".", ".", ".", "!", "?", ""))
        # table rows, shouting, marks and figures occur in any block
        k = r.random()
        if k < 0.06:
            return text.replace(" ", " | ") + r.choice((" |", ""))
        if k < 0.1:
            return text.upper().replace(" ", "!! ")
        if k < 0.14:
            return " ".join(w + r.choice(("***", "%%%", "$$$", "###")) for w in text.split(" "))
        if k < 0.18:
            return text + " " + r.choice((f"{word()}@{word()}.example", f"{r.randint(0, 10**9)}", f"{word()} = '{word()}{r.randint(0, 999)}'"))
        return text

    def paragraph():
        return " ".join(sentence() for _ in range(r.choice((1, 1, 1, 2, 3, 5, 8, 20))))

    def inline(text):
        k = r.random()
        if k < 0.15:
            return f"<b>{text}" + r.choice(("</b>", "<br>", ""))
        if k < 0.3 and " " in text:
            w = text.split(" ")
            i = r.randrange(len(w))
            w[i] = r.choice((f"<a href='/{w[i]}'>{w[i]}</a>", f"<em>{w[i]}</em>", f"<span>{w[i]}</span>"))
            return " ".join(w)
        return text

    def attributes(names):
        if not names or r.random() < 0.15:
            return ""
        key = r.choice(("class", "class", "class", "id"))
        return f' {key}="{r.choice(names)}"'

    def link_list(a, b):
        items = [f'<li><a href="/{word()}">{phrase(1, 3) if r.random() < 0.6 else word()}</a></li>' for _ in range(r.randint(a, b))]
        return r.choice(("<ul>%s</ul>", "<ol>%s</ol>", "<div><ul>%s</ul></div>")) % "".join(items)

    def boiler(kind):
        own = r.random() < 0.5
        tag = _BOILER_TAGS[kind] if own else r.choice(("div", "div", "section", "ul" if kind == "menu" else "div"))
        # without its own tag the names must tell
        names = _BOILER_NAMES[kind]
        attrs = attributes(names) if own else f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"'
        if kind == "menu":
            body = link_list(2, 8) if tag != "ul" else "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(r.randint(2, 8)))
        elif kind == "header":
            body = r.choice((f'<a href="/">{phrase(1, 3)}</a>', f"<h1>{phrase(1, 4)}</h1><p>{phrase(2, 7)}</p>", f"<div>{phrase(1, 3)}</div>" + link_list(2, 5), f"<h2>{phrase(1, 3)}</h2>"))
        elif kind == "footer":
            body = r.choice((f"&copy; {word()}.example &middot; {sentence()}", f"<p>&copy; 20{r.randint(10, 25)} {phrase(1, 3)}</p>" + link_list(1, 5), f"<p>{paragraph()}</p>", link_list(2, 6) + f"<p>{phrase(2, 5)}</p>"))
        elif kind == "sidebar":
            body = f"<h3>{phrase(1, 3)}</h3>" + r.choice((link_list(2, 7), f"<p>{paragraph()}</p>", f"<p>{sentence()}</p><p>{sentence()}</p>"))
        elif kind in ("notice", "advert"):
            body = r.choice((sentence(), f"<p>{paragraph()}</p>", f"<p>{sentence()}</p><button>{phrase(1, 2)}</button>", f'<a href="/{word()}">{sentence()}</a>', f"<h4>{phrase(1, 4)}</h4><p>{sentence()}</p>"))
        elif kind == "form":
            body = f"<label>{phrase(1, 3)}</label><input name=q>" + r.choice(("", f"<p>{sentence()}</p>")) + f"<button>{word()}</button>"
            if tag != "form":
                body = f"<form>{body}</form>"
        elif kind == "share":
            body = "".join(f'<a href="#">{word()}</a> ' for _ in range(r.randint(2, 5)))
        else:
            one = lambda: f'<div class="{r.choice(("comment", "comment-item", "reply", "c"))}"><b>{word()}</b><p>{paragraph()}</p></div>'
            body = r.choice(("", f"<h3>{phrase(1, 3)}</h3>")) + "".join(one() for _ in range(r.randint(1, 6))) + r.choice(("", f"<form><label>{word()}</label><button>{word()}</button></form>"))
        return f"<{tag}{attrs}>{body}</{tag}>"

    def article():
        parts, texts = [], []

        def add(open_, text, close_):
            shown = inline(text)
            parts.append(open_ + shown + close_)
            texts.append(text)

        if r.random() < 0.85:
            title = phrase(2, 10) + r.choice(("", ".", ""))
            add(*r.choice((("<h1>", title, "</h1>"), ("<h1>", title, "</h1>"), ("<h2>", title, "</h2>"), ("<header><h1>", title, "</h1></header>"))))
        for _ in range(r.choice((1, 2, 3, 4, 6, 9, 14))):
            k = r.random()
            if k < 0.72:
                add("<p>", paragraph(), r.choice(("</p>", "</p>", "</p>", "")))
            elif k < 0.8:
                level = r.choice("23")
                add(f"<h{level}>", phrase(1, 6), f"</h{level}>")
            elif k < 0.88:
                parts.append("<ul>")
                for _ in range(r.randint(1, 5)):
                    add("<li>", phrase(1, 12), r.choice(("</li>", "</li>", "")))
                parts.append("</ul>")
            elif k < 0.92:
                add("<blockquote>", paragraph(), "</blockquote>")
            elif k < 0.95:
                add("<pre>", sentence(), "</pre>")
            else:
                parts.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    add("<td>", phrase(1, 4), "</td>")
                parts.append("</tr></table>")
            if r.random() < 0.06:
                parts.append(boiler(r.choice(("advert", "share", "sidebar", "form", "notice"))))
        if r.random() < 0.12:
            parts.append(boiler(r.choice(("share", "comments", "footer", "sidebar"))))
        return "".join(parts), texts

    for _ in range(n):
        body, texts = article()
        k = r.random()
        if k < 0.45:
            main = f"<article{attributes(_MAIN_NAMES) if r.random() < 0.4 else ''}>{body}</article>"
        elif k < 0.6:
            main = f"<main{attributes(_MAIN_NAMES) if r.random() < 0.4 else ''}>{body}</main>"
        else:
            tag = r.choice(("div", "div", "section"))
            main = f'<{tag} {r.choice(("class", "class", "id"))}="{r.choice(_MAIN_NAMES)}">{body}</{tag}>'
        if r.random() < 0.2:
            main = f"<main>{main}</main>"
        before = [boiler(x) for x in ("notice", "header", "menu", "form", "advert", "sidebar", "menu") if r.random() < (0.75 if x == "menu" else 0.35)]
        after = [boiler(x) for x in ("share", "comments", "sidebar", "advert", "menu", "form", "footer", "notice") if r.random() < (0.75 if x == "footer" else 0.3)]
        wrap = r.choice(("%s", "%s", '<div class="wrapper">%s</div>', '<div id="page"><div class="container">%s</div></div>'))
        inside = wrap % "".join([*before, main, *after])
        end = r.choice(("</body></html>", "</body></html>", ""))
        yield f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title></head><body>{inside}{end}", texts


def labelled(page: str, texts: list[str]) -> tuple[list, np.ndarray]:
    """A training page's blocks, and which of them are main text (matched in order)."""
    found, y, at = blocks(page), [], 0
    for _, text, _ in found:
        hit = at < len(texts) and text == " ".join(texts[at].split())
        at += hit
        y.append(hit)
    return found, np.array(y, float)


@functools.lru_cache(maxsize=1)
def trained() -> Labeller:
    pages = []
    for page, texts in training_pages():
        found, y = labelled(page, texts)
        if len(found):
            pages.append((vectors(found), y))
    return Labeller().fit(pages)


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: its main blocks in page order, one a line.

    Null and empty pages, and pages without main text, give an empty text. Pages are read whole, at
    any length and depth of nesting; a task holds the blocks of one page, or of BATCH_BLOCKS in
    short ones. Scripts, styles, templates, frames, heads and form fields have no text; all else is
    for the network to tell. Repeated rows give equal results; other columns are ignored.
    """
    model = model or trained()

    def run(batches):
        for b in batches:
            found, size, at = [], 0, 0
            for i, x in enumerate(b.column(2)):
                found.append(blocks(x.as_buffer().to_pybytes().decode("utf-8", "replace")))
                size += len(found[-1]) + 1
                if size >= BATCH_BLOCKS or i == b.num_rows - 1:
                    labels = model.label(found)
                    texts = ["\n".join(t for (_, t, _), y in zip(f, label) if y) for f, label in zip(found, labels)]
                    part = b.slice(at, len(found))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                    found, size, at = [], 0, i + 1

    return pages.select("page_id", "url", raw("html").alias("h")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
