"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the text between tags that aren't inline. Scripts, styles, markup and other text
that isn't shown are no blocks. Each block has a vector of its tag path (tags, classes, ids and roles of all
ancestors, hashed), of its words (hashed) and of some measures. A bidirectional LSTM in numpy reads the
vectors of all blocks of a page, so that each decision knows the whole page, and labels each as main text or
not. It is trained on PAGES synthetic pages of many layouts, made here, whose labels are known.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

HIDDEN, PATH, WORDS, MEASURES = 16, 512, 128, 8
#: Synthetic pages for training, and how often each is seen.
PAGES, EPOCHS = 900, 8
#: Pages that are labelled together; the most blocks (padded) of such a group.
GROUP, GROUP_BLOCKS = 256, 200_000

# --- blocks ---

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Not shown: these up to the next end tag, or the end of the page,
_RAW = frozenset("script style textarea title".split())
#: and these up to their own end tag, as they can be nested; without one the tag alone is passed over.
_HIDDEN = frozenset("noscript iframe xmp noembed noframes template svg math canvas object".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PARAGRAPH = ({"p"}, {"article", "aside", "blockquote", "body", "div", "footer", "form", "header", "li", "main", "nav", "section", "td"})
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@lru_cache(maxsize=65536)
def _bit(token: str) -> int:
    return 1 << (zlib.crc32(token.encode("utf-8", "surrogatepass")) % PATH)


@lru_cache(maxsize=65536)
def _bits(tag: str, attributes: str) -> int:
    out = _bit("t:" + tag)
    for kind, *value in _NAMES.findall(attributes):
        kind = "r:" if kind.lower() == "role" else "c:"
        for part in _PART.findall("".join(value).lower()):
            out |= _bit(kind + part)
    return out


@lru_cache(maxsize=512)
def _tags_of(tag: str) -> re.Pattern:
    return re.compile(f"<(/?){re.escape(tag)}(?![a-zA-Z0-9:_-])[^>]*>?", re.I)


def _ends(html: str, tag: str) -> dict[int, int]:
    """Where each element of a tag that is closed begins, and where it ends."""
    out, opened = {}, []
    for m in _tags_of(tag).finditer(html):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


class Block:
    __slots__ = ("links", "own", "path", "text")

    def __init__(self, text: str, path: int, own: int, links: int):
        self.text, self.path, self.own, self.links = text, path, own, links


def blocks(html: str | None) -> list[Block]:
    """The blocks with text, in page order: white space runs are one space, ends trimmed."""
    html, out = html or "", []
    stack: list[tuple[str, int, int]] = []  # tag, bits of the path, bits of the tag
    places: dict[str, list[int]] = defaultdict(list)  # of a tag in the stack
    bounds: list[int] = []  # of what isn't inline
    ends: dict[str, dict[int, int]] = {}
    parts: list[str] = []
    linked, in_link, at, size = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else 0, stack[-1][2] if stack else 0, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal in_link
        for t, _, _ in stack[k:]:
            places[t].pop()
            in_link -= t == "a"
        del stack[k:]
        while bounds and bounds[-1] >= k:
            bounds.pop()

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def text(s: str) -> None:
        nonlocal linked
        if s:
            parts.append(s)
            if in_link:
                linked += len(s.strip())

    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        inline = tag in _INLINE
        if not inline:
            flush()
        elif tag in ("br", "wbr", "img"):
            if tag == "br":
                parts.append(" ")
            continue
        if closing:
            k = last((tag,))
            if k >= 0 and not (inline and bounds and k < bounds[-1]):
                pop_to(k)
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                end = next((e for e in _tags_of(tag).finditer(html, at) if e[1]), None)
                at = end.end() if end else size
            continue
        if tag in _HIDDEN:
            if not attributes.endswith("/"):
                if tag not in ends:
                    ends[tag] = _ends(html, tag)
                at = max(at, ends[tag].get(m.start(), at))
            continue
        if tag in _VOID:
            continue
        if not inline:
            over, within = _CLOSES.get(tag, _PARAGRAPH)
            bound = last(within)
            if tag == "tr":
                k = min((i for t in over for i in reversed(places[t]) if i > bound), default=-1)
            else:
                k = last(over)
            if k > bound:
                pop_to(k)
        bits = _bits(tag, attributes)
        places[tag].append(len(stack))
        if not inline:
            bounds.append(len(stack))
        stack.append((tag, (stack[-1][1] if stack else 0) | bits, stack[-1][2] if inline and stack else bits))
        in_link += tag == "a"
    flush()
    return out


def _features(page: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of path and own tag, as bytes; hashed words and measures. Lengths count up to what training pages show."""
    n = len(page)
    wide = PATH // 8
    bits = np.frombuffer(b"".join(b.path.to_bytes(wide, "little") + b.own.to_bytes(wide, "little") for b in page), np.uint8).reshape(n, 2 * wide)
    rest = np.zeros((n, WORDS + MEASURES), np.float32)
    crc = zlib.crc32
    for i, b in enumerate(page):
        raw = b.text.encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        counts = np.bincount(np.fromiter(map(crc, words), np.int64, len(words)) % WORDS, minlength=WORDS)
        rest[i, :WORDS] = counts / max(1.0, float(np.sqrt((counts * counts).sum())))
        size, chars = len(raw), len(b.text)
        rest[i, WORDS:] = (min(log1p(chars), 7.0) / 8, b.links / max(1, chars), min(log1p(len(words)), 5.0) / 6, (raw.count(b".") + raw.count(b",")) / (len(words) + 1), sum(map(raw.count, b"0123456789")) / size if size < 400 else 0, raw.count(b"\xc2\xa9") > 0, i / n, min(log1p(n), 4.5) / 8)
    return bits, rest


# --- labeller ---

Weights = dict[str, np.ndarray]


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(seed: int = 11, hidden: int = HIDDEN) -> Weights:
    rng = np.random.default_rng(seed)
    n = 2 * PATH + WORDS + MEASURES
    out: Weights = {}
    for d in "fb":
        out["x" + d] = (rng.standard_normal((n, 4 * hidden)) * 0.1).astype(np.float32)
        out["u" + d] = (rng.standard_normal((hidden, 4 * hidden)) * 0.2).astype(np.float32)
        out["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
    out["o"] = (rng.standard_normal(2 * hidden) * 0.2).astype(np.float32)
    out["p"] = np.zeros(1, np.float32)
    return out


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse, what is behind its end stays behind."""
    steps = np.arange(len(x))[:, None]
    at = np.where(steps < lengths, lengths - 1 - steps, steps)
    return x[at, np.arange(x.shape[1])]


def _pass(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction; x (steps, pages, 4 * hidden) in the order input, forget, output, new."""
    n = u.shape[0]
    h = c = np.zeros((x.shape[1], n), np.float32)
    out = np.empty((len(x), x.shape[1], n), np.float32)
    for t in range(len(x)):
        g = x[t] + h @ u
        s, new = _sig(g[:, : 3 * n]), np.tanh(g[:, 3 * n :])
        c1 = s[:, n : 2 * n] * c + s[:, :n] * new
        tc = np.tanh(c1)
        if keep is not None:
            keep.append((h, c, s, new, tc))
        h, c = s[:, 2 * n :] * tc, c1
        out[t] = h
    return out


def _pad(pages: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((max(map(len, pages)), len(pages), width), np.float32)
    for i, p in enumerate(pages):
        out[: len(p), i] = p
    return out


def label(w: Weights, pages: list[list[Block]]) -> list[np.ndarray]:
    """Probability of main text of each block of pages that aren't empty."""
    both = np.concatenate([w["xf"], w["xb"]], axis=1)
    k = w["uf"].shape[1]
    parts = []
    sizes = np.array(list(map(len, pages)))
    bits, rest = zip(*map(_features, pages))
    bits, rest = np.concatenate(bits), np.concatenate(rest)
    kinds, of = np.unique(bits, axis=0, return_inverse=True)
    x = (np.unpackbits(kinds, axis=1, bitorder="little").astype(np.float32) @ both[: 2 * PATH])[of.reshape(-1)]
    x += rest @ both[2 * PATH :] + np.concatenate([w["cf"], w["cb"]])
    ends = np.cumsum(sizes)
    for e, n in zip(ends.tolist(), sizes.tolist()):
        parts.append(x[e - n : e])
    padded = _pad(parts, 2 * k)
    f = _pass(padded[:, :, :k], w["uf"])
    b = _flip(_pass(_flip(padded[:, :, k:], sizes), w["ub"]), sizes)
    p = _sig(np.concatenate([f, b], axis=2) @ w["o"] + w["p"])
    return [p[:n, i] for i, n in enumerate(sizes.tolist())]


def _gradients(w: Weights, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[float, Weights]:
    """x (steps, pages, features), y (steps, pages): the loss and what it asks of the weights."""
    n = w["uf"].shape[0]
    mask = np.arange(len(x))[:, None] < sizes
    keep: dict[str, list] = {"f": [], "b": []}
    xs = {"f": x, "b": _flip(x, sizes)}
    hs = {d: _pass(xs[d] @ w["x" + d] + w["c" + d], w["u" + d], keep[d]) for d in "fb"}
    h = np.concatenate([hs["f"], _flip(hs["b"], sizes)], axis=2)
    p = _sig(h @ w["o"] + w["p"])
    loss = -float((np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum() / mask.sum())
    dz = ((p - y) * mask / mask.sum()).astype(np.float32)
    grads = {"o": np.einsum("tb,tbh->h", dz, h), "p": dz.sum(keepdims=True).reshape(1)}
    dh = dz[:, :, None] * w["o"]
    for d, part in (("f", dh[:, :, :n]), ("b", _flip(dh[:, :, n:], sizes))):
        du, dg_all = np.zeros_like(w["u" + d]), np.empty((*x.shape[:2], 4 * n), np.float32)
        carry_h = carry_c = np.zeros((x.shape[1], n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h0, c0, s, new, tc = keep[d][t]
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            gh = part[t] + carry_h
            gc = carry_c + gh * o * (1 - tc * tc)
            dg = np.concatenate([gc * new * i * (1 - i), gc * c0 * f * (1 - f), gh * tc * o * (1 - o), gc * i * (1 - new * new)], axis=1)
            du += h0.T @ dg
            dg_all[t] = dg
            carry_h, carry_c = dg @ w["u" + d].T, gc * f
        flat = dg_all.reshape(-1, 4 * n)
        grads["x" + d], grads["u" + d], grads["c" + d] = xs[d].reshape(len(flat), -1).T @ flat, du, flat.sum(axis=0)
    return loss, grads


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 5) -> Weights:
    """Weights learned from synthetic pages. Words and parts of the path are hidden from time to time, so
    that no decision hangs on one of them."""
    made = []
    for html in synthetic(pages, seed):
        page = blocks(html)
        y = np.array([MARK in b.text for b in page], np.float32)
        for b in page:
            b.text = b.text.replace(MARK, "")
        bits, rest = _features(page)
        made.append((np.concatenate([np.unpackbits(bits, axis=1, bitorder="little").astype(np.float32), rest], axis=1), y))
    w, rng, step = initial(), np.random.default_rng(seed), 0
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    made.sort(key=lambda m: len(m[1]))
    groups = [made[i : i + 12] for i in range(0, len(made), 12)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)).tolist():
            xs, ys = zip(*groups[g])
            sizes = np.array(list(map(len, ys)))
            x, y = _pad(list(xs), xs[0].shape[1]), _pad([v[:, None] for v in ys], 1)[:, :, 0]
            x[:, :, : 2 * PATH] *= rng.random((1, x.shape[1], 2 * PATH)) > 0.06
            x[:, :, 2 * PATH : 2 * PATH + WORDS] *= rng.random((1, x.shape[1], 1)) > 0.5
            _, grads = _gradients(w, x, y, sizes)
            step += 1
            for k, v in grads.items():
                v = np.clip(v, -1, 1)
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                w[k] -= np.float32(0.006 / (1 - 0.9**step)) * m1[k] / (np.sqrt(m2[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return w


# --- synthetic pages ---

#: Begins the text of each main block of a synthetic page.
MARK = "\x01"
_SYLLABLES = "an ar be con da den di e el en er es fa ge ha i in is ka la le li lo ma me mi na ne no nt o on or ou ra re ri ro sa se st ta te ti to tra u ung ve vi za ß é è ñ ü".split()
_CHROME = {
    "menu": "Home About Contact Blog News Products Services Login Shop Help FAQ Archive Start Kontakt Accueil Inicio".split(),
    "foot": ["All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Impressum", "Mentions légales", "Aviso legal", "Powered by"],
    "notice": ["This site uses cookies.", "Accept all", "We value your privacy.", "Please enable scripts.", "Manage preferences"],
    "comment": ["Reply", "Report", "says:", "wrote on", "Log in to comment", "Leave a comment"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Anzeige", "Publicité", "Limited offer"],
    "side": ["Related posts", "Most read", "Popular", "Tags", "Follow us", "Archives", "Share this"],
    "form": ["Search", "Your e-mail", "Subscribe", "Send", "Password", "Newsletter", "Sign up"],
}
_BAD = {
    "menu": ["nav", "div.menu", "div#nav", "ul.menu", "div.navigation", "div.navbar", "nav.main-nav", "div.breadcrumbs", "nav.toc", "div.topbar"],
    "foot": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.legal"],
    "head": ["header", "div.header", "div#header", "header.site-header", "div.masthead", "div.banner"],
    "notice": ["div.cookie-notice", "div.notice", "div.alert", "div#cookie-banner", "div.consent", "div.popup", "div.modal", "section.notice", "aside.notice"],
    "comment": ["section.comments", "div#comments", "div.comment-list", "ol.comments", "div.comment", "div.reactions", "div.discussion", "section#responses", "article.comment"],
    "ad": ["div.ad", "div.ads", "div.advert", "aside.ad", "div.sponsored", "div.advertisement", "div#ad-top", "section.promo", "div.banner-ad"],
    "side": ["aside", "div.sidebar", "aside.sidebar", "div#sidebar", "div.related", "div.widget", "div.share", "div.social", "section.related-posts", "div.recommended"],
    "form": ["form", "div.newsletter form", "form.search", "form#login", "div.subscribe", "div.search"],
}
_GOOD = ["article", "article", "article", "main", "main article", "div.content", "div#content", "div.post", "div.entry-content", "section.article-body", "div#main", "div.story", "article.post", "div.main div.text", "body"]


class _Writer:
    def __init__(self, rng: random.Random):
        self.r, self.words = rng, ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(200)]
        self.junk = rng.random() < 0.12

    def prose(self, low: int, high: int) -> str:
        r = self.r
        out = r.choices(self.words, k=r.randint(low, high))
        out = [w + ("." if r.random() < 0.1 else "," if r.random() < 0.1 else "") for w in out]
        if self.junk:
            out = [w + r.choice(["%%%", "***", "$$$", "###", "&amp;&amp;&amp;"]) for w in out]
        elif r.random() < 0.1:
            out.insert(r.randrange(len(out) + 1), r.choice(["&amp;", "&quot;x&quot;", "&#233;", "&nbsp;", "2024", "&lt;b&gt;", "17"]))
        if r.random() < 0.04:
            out = [out[0]] * len(out)
        out[0] = out[0].capitalize()
        return " ".join(out) + r.choice([".", ".", "", "!", "?"])

    def element(self, kind: str, inner: str) -> str:
        for part in reversed(kind.split()):
            tag, *name = re.split(r"([.#])", part)
            name = f' {"class" if name[0] == "." else "id"}="{name[1]}"' if name else ""
            if tag != "body":
                inner = f"<{tag}{name}>{inner}</{tag}>"
        return inner

    def inline(self, text: str) -> str:
        r, words = self.r, text.split(" ")
        if len(words) > 4 and r.random() < 0.4:
            i = r.randrange(len(words))
            words[i] = r.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<i>{}", "<span class='w'>{}</span>", "{}<br>"]).format(words[i])
        return " ".join(words)

    def bad(self, kind: str) -> str:
        r, own = self.r, _CHROME.get(kind, [])
        line = lambda: r.choice(own) if own and r.random() < 0.5 else self.prose(1, 4)
        if kind == "menu" or (kind == "side" and r.random() < 0.5):
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{line()}</a></li>' for i in range(r.randint(2, 9))) + "</ul>"
            if kind == "side":
                inner = f"<h3>{line()}</h3>" + inner
        elif kind == "foot":
            inner = r.choice(["&copy; ", "© 2024 ", ""]) + self.prose(1, 14) + r.choice(["", " &middot; " + line(), f"<p>{line()}</p>"])
        elif kind == "comment":
            inner = r.choice(["", f"<h3>{line()}</h3>"]) + "".join(self.element(r.choice(["div.comment", "p", "li", "article"]), f"{r.choice(['', f'<b>{line()}</b> '])}<p>{self.prose(4, 60)}</p>") for _ in range(r.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{line()}</label><input type=text><p>{line()}</p><button>{line()}</button>" + r.choice(["", f"<select><option>{line()}<option>{line()}</select>"])
        elif kind == "head":
            inner = r.choice([f'<a href="/">{self.prose(1, 3)}</a>', f"<div>{self.prose(1, 3)}</div><p>{self.prose(3, 8)}</p>", self.prose(1, 4)])
        else:
            inner = r.choice([self.prose(3, 30), f"<p>{self.prose(5, 40)}</p>", f"<b>{line()}</b> {self.prose(2, 12)}", f"<p>{line()}</p><p>{self.prose(3, 20)}</p>"])
        return self.element(r.choice(_BAD[kind]), inner)

    def good(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{MARK}{self.prose(1, 9)}</h1>")
        for i in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12, 20])):
            x = r.random()
            text = self.inline(self.prose(1, 4) if r.random() < 0.2 else self.prose(4, 120))
            if x < 0.66:
                out.append(r.choice([f"<p>{MARK}{text}</p>"] * 4 + [f"<p>{MARK}{text}", f"<p><b>{MARK}{text}<br><p>{MARK}{self.prose(2, 60)}</p>"]))
            elif x < 0.74:
                out.append(f"<h{r.randint(2, 4)}>{MARK}{self.prose(1, 8)}</h2>")
            elif x < 0.82:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{MARK}{self.inline(self.prose(1, 25))}" + r.choice(["", "</li>"]) for _ in range(r.randint(1, 5))) + f"</{tag}>")
            elif x < 0.87:
                out.append(f"<blockquote>{r.choice(['', '<p>'])}{MARK}{text}</blockquote>")
            elif x < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.prose(1, 4)}<td>{MARK}{self.prose(1, 4)}" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.93:
                out.append(f"<div>{MARK}{text}</div>")
            elif x < 0.95:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.prose(2, 12)}</figcaption></figure>")
            else:
                out.append(self.bad(r.choice(["ad", "ad", "side", "form", "menu", "notice"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        plain = r.random() < 0.25
        before = ["menu", "ad"] if plain else [k for k in ("notice", "head", "menu", "ad", "side", "form") if r.random() < 0.45]
        after = ["foot"] if plain else [k for k in ("comment", "side", "ad", "form", "menu", "notice", "foot") if r.random() < (0.8 if k == "foot" else 0.35)]
        if not plain:
            r.shuffle(before)
        main = self.element(r.choice(["article"] * 8 + _GOOD), self.good())
        if r.random() < 0.25:  # a wrapper around all
            main = self.element(r.choice(["div.container", "div#page", "div.wrapper", "main"]), "".join(self.bad(k) for k in before) + main + "".join(self.bad(k) for k in after))
            before, after = [], []
        body = "".join(self.bad(k) for k in before) + main + "".join(self.bad(k) for k in after)
        return f"<!DOCTYPE html><html><head><title>{self.prose(1, 8)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{body}" + r.choice(["</body></html>", ""])


def synthetic(n: int, seed: int) -> list[str]:
    """Pages of many layouts. The text of a main block begins with MARK."""
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(n)]


# --- query ---


def extract(w: Weights, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    cut = list(map(blocks, pages))
    out = [""] * len(pages)
    order = sorted((i for i, p in enumerate(cut) if p), key=lambda i: len(cut[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < GROUP and (stop - at + 1) * len(cut[order[stop]]) <= GROUP_BLOCKS:
            stop += 1
        group = order[at:stop]
        for i, p in zip(group, label(w, [cut[i] for i in group])):
            out[i] = "\n\n".join(b.text for b, x in zip(cut[i], p.tolist()) if x >= 0.5)
        at = stop
    return out


def _map_extract(w: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                text = extract(w, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Null or empty html, and pages without main text: empty text. Null page_id or url: passed on. Repeated
    rows are read each. Empty table: no rows. Other columns aren't read.
    """
    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_map_extract(trained()), "page_id long, url string, text string, n_chars long")
