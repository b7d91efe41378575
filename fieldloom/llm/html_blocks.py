"""Main text of web pages: every leaf block is labelled by a numpy bidirectional LSTM that reads the whole page.

A page becomes a sequence of leaf blocks (text between block-level tags). A block is described by a hashed vector of its whole
tag path with classes, ids and roles, a hashed vector of its words, and a few numbers. The network is trained here, on pages written by a
seeded generator whose labels are known; no page of the input is looked at for training, so results don't depend on the table.
"""

from __future__ import annotations

import functools
import html
import os
import pickle
import random
import re
import string
import subprocess
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .texthash import prefix, spans, words

#: Sizes of the hashed path and word vectors, and of the state in each direction; pages and rounds of training; seed.
PATH_DIM, WORD_DIM, HIDDEN, PAGES, ROUNDS, SEED = 384, 48, 24, 2400, 10, 11
#: Share of blocks whose words are hidden in training (half as often, their numbers), and decay of the weights of the input.
MUTE, DECAY = 0.7, 0.004
_EXTRA = 7
#: Blocks that one matrix may hold in inference.
CELLS = 60_000

#: Tags that stay inside a block; all others end it.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; the network decides on all others, formulas and drawings among them.
HIDDEN_TAGS = frozenset("script style template head title iframe select textarea".split())
#: Weight of an element's tag and marks in a block's path, by its distance from the leaf: FAR / (FAR + distance).
FAR = 6
#: Tags that end an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such an end doesn't reach past.
SCOPE = frozenset("ul ol dl table body article section div nav aside footer header main form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^>]*>?"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HEADING = frozenset(f"h{i}" for i in range(1, 7))


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]  # (tag, words of class, id and role) of each element from the root
    link: float


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: references decoded, white space single, trimmed, never empty."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = hidden = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, tuple((tag, *marks) for tag, marks in stack), min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if not hidden:
                held.append(html.unescape(text) if "&" in text else text)
                linked += len(text) if in_link else 0
            continue
        if m["tag"] is None:
            if m["raw"]:
                flush()
            continue
        tag, end = m["tag"].lower(), m["end"]
        if tag == "a":
            in_link = 0 if end else 1
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            continue
        flush()
        in_link = 0
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    hidden -= sum(t in HIDDEN_TAGS for t, _ in stack[k:])
                    del stack[k:]
                    break
            continue
        if tag in CLOSES or tag in _HEADING or tag in SCOPE:
            closes = CLOSES.get(tag, {"p"} if tag in SCOPE else frozenset())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag in VOID or m["attrs"].rstrip().endswith("/"):
            continue
        marks = tuple(w for a in _ATTR.findall(m["attrs"]) for w in re.split(r"[^a-z]+", (a[1] or a[2] or a[3]).lower()) if w)
        if tag in ("body", "head"):  # an unclosed head ends with the body
            hidden -= sum(t in HIDDEN_TAGS for t, _ in stack)
            stack = [x for x in stack if x[0] not in HIDDEN_TAGS]
        stack.append((tag, marks))
        hidden += tag in HIDDEN_TAGS
    flush()
    return out


@functools.lru_cache(maxsize=100_000)
def _slot(word: str) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return (h >> 1) % PATH_DIM, 1.0 if h & 1 else -1.0


@functools.lru_cache(maxsize=20_000)
def _path(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """The hashed path: each name of any element counts once, by its nearest element; the leaf's tag once more by itself."""
    weight: dict[str, float] = {}
    for k, names in enumerate(reversed(path)):
        for name in names:
            weight.setdefault(name, FAR / (FAR + k))
    weight["leaf " + path[-1][0] if path else "none"] = 1.0
    out = np.zeros(PATH_DIM, np.float32)
    for name, w in weight.items():
        k, sign = _slot(name)
        out[k] += sign * w
    return out


_STOPS = np.zeros(256, np.float32)
_STOPS[list(b".,;:!?")] = 1
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page a row of numbers for each block."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), PATH_DIM + WORD_DIM + _EXTRA), np.float32)
    if flat:
        for row, b in zip(x, flat):
            row[:PATH_DIM] = _path(b.path)
        raw = [b.text.lower().encode("utf-8", "surrogatepass") for b in flat]
        data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
        first, last, row = words(data, off, ~_BLANK)
        h = spans(prefix(data), first, last)
        cell = row * WORD_DIM + ((h >> np.uint64(1)) % np.uint64(WORD_DIM)).astype(np.int64)
        own = np.bincount(cell, np.where(h & np.uint64(1), 1.0, -1.0), len(flat) * WORD_DIM).reshape(-1, WORD_DIM)
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = own / np.maximum(1.0, np.sqrt((own * own).sum(1, keepdims=True)))
        n = np.array([len(b.text) for b in flat], float)
        stops = np.add.reduceat(_STOPS[data], off[:-1]) / n
        at = np.concatenate([np.arange(len(p)) for p in pages])
        of = np.repeat([len(p) for p in pages], [len(p) for p in pages])
        extra = ([b.link for b in flat], np.log1p(n) / 6, np.log1p(np.bincount(row, minlength=len(flat))) / 4, stops, at / of, 1 / (1 + at), [min(len(b.path), 40) / 10 for b in flat])
        x[:, -_EXTRA:] = np.stack([np.asarray(e, np.float32) for e in extra], 1)
    return np.split(x, np.cumsum([len(p) for p in pages])[:-1])


# --- the network -----------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Weights of both directions and of the output; runs over (batch, length, features) with a mask."""

    def __init__(self, d: int, h: int, seed: int):
        rng = np.random.default_rng(seed)
        self.h = h
        self.w = {}
        for k in "fb":
            self.w[f"x{k}"] = (rng.standard_normal((d, 4 * h)) / np.sqrt(d)).astype(np.float32)
            self.w[f"h{k}"] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            self.w[f"b{k}"] = np.zeros(4 * h, np.float32)
            self.w[f"b{k}"][h : 2 * h] = 1  # forget gates start open
        self.w["o"] = (rng.standard_normal(2 * h) / np.sqrt(2 * h)).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _pass(self, k: str, x: np.ndarray, mask: np.ndarray, tape: list | None) -> np.ndarray:
        n, t, _ = x.shape
        h, c = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)
        out = np.zeros((n, t, self.h), np.float32)
        xs = x @ self.w[f"x{k}"] + self.w[f"b{k}"]
        for j in range(t) if k == "f" else range(t - 1, -1, -1):
            z = xs[:, j] + h @ self.w[f"h{k}"]
            i, f, o = (_sigmoid(z[:, a * self.h : (a + 1) * self.h]) for a in range(3))
            g = np.tanh(z[:, 3 * self.h :])
            m = mask[:, j, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(c2)
            h2 = m * (o * th) + (1 - m) * h
            if tape is not None:
                tape.append((j, i, f, o, g, c, c2, th, h, m))
            h, c = h2, c2
            out[:, j] = h
        return out

    def __call__(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits."""
        return np.concatenate([self._pass("f", x, mask, None), self._pass("b", x, mask, None)], 2) @ self.w["o"] + self.w["ob"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy over all blocks, by backpropagation through time."""
        tapes = {"f": [], "b": []}
        out = {k: self._pass(k, x, mask, tapes[k]) for k in "fb"}
        both = np.concatenate([out["f"], out["b"]], 2)
        dz = (_sigmoid(both @ self.w["o"] + self.w["ob"]) - y) * mask / mask.sum()
        grad = {"o": np.einsum("nt,nth->h", dz, both), "ob": dz.sum(keepdims=True).ravel()}
        dboth = dz[:, :, None] * self.w["o"]
        for k, part in (("f", dboth[:, :, : self.h]), ("b", dboth[:, :, self.h :])):
            dh = dc = np.zeros((len(x), self.h), np.float32)
            dzs = np.zeros((len(x), x.shape[1], 4 * self.h), np.float32)
            dwh = np.zeros_like(self.w[f"h{k}"])
            for j, i, f, o, g, c, c2, th, h, m in reversed(tapes[k]):
                dh = dh + part[:, j]
                dhm = dh * m
                dcm = (dc + dhm * o * (1 - th**2) / np.maximum(m, 1)) * m
                z = np.concatenate([dcm * g * i * (1 - i), dcm * c * f * (1 - f), dhm * th * o * (1 - o), dcm * i * (1 - g**2)], 1)
                dzs[:, j] = z
                dwh += h.T @ z
                dh = z @ self.w[f"h{k}"].T + dh * (1 - m)
                dc = dcm * f + dc * (1 - m)
            grad |= {f"x{k}": np.einsum("ntd,nte->de", x, dzs, optimize=True), f"h{k}": dwh, f"b{k}": dzs.sum((0, 1))}
        return grad


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((len(pages), t, pages[0].shape[1]), np.float32), np.zeros((len(pages), t), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


# --- pages for training ----------------------------------------------------------------------------

#: Words that pages use around their text.
_AROUND = {
    "nav": "home about contact news sports products services blog login search menu archive start kontakt inicio accueil",
    "ad": "advertisement sponsored buy now offer sale discount free shipping deal werbung",
    "notice": "cookies we use cookies accept settings consent privacy your experience subscribe newsletter sign up",
    "form": "name email password submit search send your message required",
    "comments": "comment reply says posted ago user thanks agree great like report",
    "side": "related popular recent posts tags categories follow us trending archive",
    "footer": "copyright © rights reserved terms privacy imprint contact sitemap",
}
#: Classes and ids that such parts bear; of `main`, those of the article.
_MARKS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav header links toolbar",
    "ad": "ad ads advert banner promo sponsored advertisement adsense",
    "notice": "cookie consent notice alert banner popup modal newsletter subscribe",
    "form": "form search login signup contact",
    "comments": "comments comment discussion replies responses disqus thread",
    "side": "sidebar aside widget related recommended share social tags rail",
    "footer": "footer copyright bottom foot legal",
    "head": "header masthead top site branding logo",
    "main": "content main article post entry body story text page",
}
#: Roles of such parts, and marks that say nothing.
_ROLES = {"nav": "navigation", "side": "complementary", "footer": "contentinfo", "form": "search", "notice": "alert"}
_PLAIN_MARKS = "row col container wrapper wrap inner outer block flex grid px py mt mb sm lg md full page box layout module item text center left right first last mx auto space gap max min w h hidden relative style"


def training_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and the labels of its blocks."""
    syllables = ["".join(rng.choices("abcdefghijklmnoprstuvwäéñ", k=rng.randint(1, 4))) for _ in range(60)]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    style = rng.random()
    labels: list[int] = []

    def line(kind: str | None, lo: int, hi: int) -> str:
        pool = _AROUND[kind].split() if kind and rng.random() < 0.6 else None
        terms = [rng.choice(pool) if pool and rng.random() < 0.6 else word() for _ in range(rng.randint(lo, hi))]
        if rng.random() < (0.9 if kind is None else 0.3):
            terms[0] = terms[0].capitalize()
            terms[-1] += "."
        odd = style if rng.random() < 0.5 else rng.random()
        if odd < 0.06:  # numbers, prices, symbols
            terms = [rng.choice([str(rng.randint(0, 3000)), w, f"{w}{rng.choice(string.punctuation.replace('&', '').replace('<', ''))}", f"{rng.randint(1, 99)}.{rng.randint(10, 99)}"]) for w in terms]
        elif odd < 0.1:
            terms = [w.upper() for w in terms]
        elif odd < 0.14:  # a very long block
            terms = terms * rng.randint(1, 30)
        return " ".join(terms)

    def marks(kind: str, sure: float) -> str:
        if rng.random() > sure:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(rng.sample(_MARKS[kind].split(), rng.randint(1, 2)))}"'

    def leaf(tag: str, text: str, label: int) -> str:
        labels.append(label)
        if rng.random() < 0.15:
            inside = rng.choice(["b", "i", "span", "em", "a", "font"])
            text = f"<{inside}>{text}</{inside}>" if rng.random() < 0.5 else f"{text} <{inside}>{word()}</{inside}> {word()}"
        mark = plain() if rng.random() < 0.2 else ""
        return f"<{tag}{mark}>{text}" + (f"</{tag}>" if tag not in ("p", "li", "td", "dt", "dd") or rng.random() < 0.9 else "")

    def plain() -> str:
        """Marks that say nothing."""
        return f' class="{" ".join(rng.sample(_PLAIN_MARKS.split(), rng.randint(1, 4)))}"'

    def nest(inner: str, most: int) -> str:
        for _ in range(rng.randint(0, most)):
            tag = rng.choice(["div", "div", "div", "section"])
            inner = f"<{tag}{plain() if rng.random() < 0.7 else ''}>{inner}</{tag}>"
        return inner

    deep = rng.choice([0, 0, 0, 1, 3, 8])
    old = rng.random() < 0.12  # laid out by a table

    def links(kind: str, n: int) -> str:
        form = rng.random()
        each = [f'<a href="/{word()}">{line(kind, 1, 3)}</a>' for _ in range(n)]
        if form < 0.75:
            return "<ul>" + "".join(leaf("li", x, 0) for x in each) + "</ul>"
        if form < 0.87:
            return "".join(leaf(rng.choice(["div", "p"]), x, 0) for x in each)
        labels.append(0)
        return " ".join(each)

    def around(kind: str) -> str:
        tag, sure = {"nav": ("nav", 0.4), "footer": ("footer", 0.4), "side": ("aside", 0.5), "form": ("form", 0.4)}.get(kind, (rng.choice(["div", "div", "section"]), 1.0))
        if kind != "form" and rng.random() < 0.4:
            tag, sure = "div", 1.0
        if old:
            tag, sure = "td", 0.4
        mark = marks(kind, sure)
        if kind in _ROLES and rng.random() < 0.15:
            mark += f' role="{_ROLES[kind]}"'
        if kind in ("nav", "side") and rng.random() < 0.8:
            inner = (leaf(rng.choice(["h2", "h3", "h4"]), line(kind, 1, 3), 0) if kind == "side" and rng.random() < 0.6 else "") + links(kind, rng.randint(1, 8))
        elif kind == "comments":
            inner = leaf(rng.choice(["h2", "h3"]), line(kind, 1, 4), 0) if rng.random() < 0.7 else ""
            each, list_ = rng.choice([("div", ""), ("div", ""), ("li", "ol"), ("article", ""), ("p", "")])
            body = "".join((f"<{each}{marks(kind, 0.5)}>" if each != "p" else "") + leaf("p", line(kind if rng.random() < 0.3 else None, 2, 40), 0) + (f"</{each}>" if each != "p" else "") for _ in range(rng.randint(1, 6)))
            inner += f"<{list_}>{body}</{list_}>" if list_ else body
        elif kind == "form":
            inner = "".join(leaf(rng.choice(["div", "p"]), f"<label>{line(kind, 1, 3)}</label><input>", 0) for _ in range(rng.randint(1, 3))) + leaf("button", line(kind, 1, 2), 0)
        elif rng.random() < 0.5:
            labels.append(0)
            inner = line(None if rng.random() < 0.6 else kind, 2, 25)
        else:
            inner = "".join(leaf("p", line(None if rng.random() < 0.5 else kind, 2, 30), 0) for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.05:
            inner += rng.choice(["<noscript>{}</noscript>", "<svg>{}</svg>"]).format(leaf("div", line(kind, 1, 6), 0))
        return f"<{tag}{mark}>{nest(inner, deep)}</{tag}>"

    def article() -> str:
        tag, sure = rng.choice([("article", 0.3), ("article", 0.3), ("main", 0.3), ("div", 1.0), ("section", 1.0), ("div", 0.2)])
        if old:
            tag, sure = "td", 0.2
        out = []
        if rng.random() < 0.85:
            out.append(leaf(rng.choice(["h1", "h1", "h2"]), line(None, 1, 12), 1))
        for _ in range(rng.choice([1, 1, 2, 4, 4, 8, 8, 14, 30, 80] * 5 + [300])):
            r = rng.random()
            if r < 0.66:
                out.append(leaf("p", line(None, 1, rng.choice([3, 12, 60, 150])), 1))
            elif r < 0.74:
                out.append(leaf(rng.choice(["h2", "h3"]), line(None, 1, 6), 1))
            elif r < 0.81:
                list_ = rng.choice(["ul", "ol"])
                out.append(f"<{list_}>" + "".join(leaf("li", line(None, 1, 14), 1) for _ in range(rng.randint(2, 5))) + f"</{list_}>")
            elif r < 0.85:
                out.append("<table>" + "".join("<tr>" + "".join(leaf("th" if k == 0 else "td", line(None, 1, 4), 1) for _ in range(rng.randint(1, 4))) + "</tr>" for k in range(rng.randint(1, 4))) + "</table>")
            elif r < 0.89:
                out.append(leaf(rng.choice(["blockquote", "pre"]), line(None, 3, 30), 1))
            elif r < 0.92:
                out.append(f"<figure><img src='x'>{leaf('figcaption', line(None, 2, 12), 1)}</figure>" if rng.random() < 0.5 else "<dl>" + "".join(leaf("dt", line(None, 1, 3), 1) + leaf("dd", line(None, 2, 12), 1) for _ in range(2)) + "</dl>")
            elif r < 0.94:
                out.append("<math>" + "".join(leaf(rng.choice(["mi", "mo", "mn"]), rng.choice(["x", "=", "+", "2", "k"]), 1) for _ in range(rng.randint(1, 5))) + "</math>")
            elif r < 0.96:
                out.append(nest(leaf("p", line(None, 3, 30), 1), 2))
            elif not old:
                out.append(around(rng.choice(["ad", "side", "notice"])))
        if rng.random() < 0.1 and not old:
            out.append(around("comments"))
        return f"<{tag}{marks('main', sure)}>{nest(''.join(out), deep)}" + (f"</{tag}>" if rng.random() < 0.95 else "")

    bare = rng.random() < 0.1  # no frame
    if rng.random() < 0.07:
        return article(), labels  # nothing else
    parts = [""] if bare else ["<!DOCTYPE html><html><head><title>x</title><script>var a='<p>';</script></head><body" + (plain() if rng.random() < 0.3 else "") + ">"]
    if rng.random() < 0.4:
        parts.append(f"<header{marks('head', 0.4)}>" if rng.random() < 0.6 else f"<div{marks('head', 1.0)}>")
        shut = "</header>" if parts[-1].startswith("<header") else "</div>"
        parts.append(leaf(rng.choice(["div", "p", "h1", "h2", "a"]), line(None, 1, 4), 0) if rng.random() < 0.8 else "")
        parts.append((around("nav") if rng.random() < 0.5 and not old else "") + shut)
    sides = lambda kinds, p, some: [k for k in kinds if rng.random() < (0.8 if k == some else p)]
    before, after = sides(("nav", "ad", "notice", "form", "side"), 0.25, "nav"), sides(("side", "comments", "ad", "form", "notice", "footer"), 0.25, "footer")
    rng.shuffle(after)
    if rng.random() < 0.03:
        body = [around(k) for k in (*before, "footer")]  # no article at all
    else:
        body = [around(k) for k in before] + [article()] + [around(k) for k in after]
    if old:
        row = "</tr><tr>" if rng.random() < 0.5 else ""
        body = ["<table><tr>", row.join(body), "</tr></table>"]
    parts.append(nest("".join(body), deep) if rng.random() < 0.4 else "".join(body))
    return "".join(parts) + ("" if bare else "</body></html>"), labels


@functools.lru_cache(maxsize=2)
def trained(pages: int = PAGES, rounds: int = ROUNDS, hidden: int = HIDDEN, seed: int = SEED) -> BiLstm:
    """train() in a process of its own with one thread, which small matrices need; a session trains once for the same numbers."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {k: "1" for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")} | {"PYTHONPATH": os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])}
    code = f"import pickle, sys; from fieldloom.llm import html_blocks as h; sys.stdout.buffer.write(pickle.dumps(h.train({pages}, {rounds}, {hidden}, {seed}).w))"
    net = BiLstm(PATH_DIM + WORD_DIM + _EXTRA, hidden, seed)
    net.w = pickle.loads(subprocess.run([sys.executable, "-c", code], env=env, check=True, stdout=subprocess.PIPE).stdout)
    return net


def train(pages: int, rounds: int, hidden: int, seed: int) -> BiLstm:
    """The network after Adam on generated pages."""
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        text, labels = training_page(rng)
        got = blocks(text)
        if len(got) == len(labels):
            data.append((features([got])[0], np.array(labels, np.float32)))
    data.sort(key=lambda d: len(d[0]))
    groups = [data[i : i + 20] for i in range(0, len(data), 20)]
    net = BiLstm(PATH_DIM + WORD_DIM + _EXTRA, hidden, seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    step, chance = 0, np.random.default_rng(seed)
    for r in range(rounds):
        rng.shuffle(groups)
        for group in groups:
            x, mask = _batch([g[0] for g in group])
            y = np.zeros_like(mask)
            for i, g in enumerate(group):
                y[i, : len(g[1])] = g[1]
            x[:, :, PATH_DIM : PATH_DIM + WORD_DIM] *= (chance.random(mask.shape) >= MUTE)[:, :, None]
            x[:, :, PATH_DIM + WORD_DIM :] *= (chance.random(mask.shape) >= MUTE / 2)[:, :, None]
            step += 1
            rate = 0.01 * (1 - r / rounds) + 0.001
            for k, g in net.gradient(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) - rate * DECAY * net.w[k] * (k[0] == "x")).astype(np.float32)
    return net


def label(pages: list[list[Block]], net: BiLstm) -> list[np.ndarray]:
    """Probability of being main text for each block of each page; pages are run side by side, whole, by falling length."""
    out = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: -len(pages[i]))
    while order:
        take = max(1, CELLS // len(pages[order[0]]))
        some, order = order[:take], order[take:]
        x, mask = _batch(features([pages[i] for i in some]))
        p = _sigmoid(net(x, mask))
        for row, i in enumerate(some):
            out[i] = p[row, : len(pages[i])]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: BiLstm | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main of each page: its main blocks in order, joined by two line ends.

    Null and empty pages, and pages without main blocks, have empty text; null ids and urls stay null. Rows that repeat are
    pages of their own. A block is main if its probability is over one half (exactly half is not). Whole pages of any length
    are read; nothing is cut or dropped within a main block. Empty input gives no rows, other columns are not carried.
    """
    net = net or trained()
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, step=1 << 20):
            found = [blocks(t) for t in batch.column("text").to_pylist()]
            main = [p > 0.5 for p in label(found, net)]
            texts = ["\n\n".join(b.text for b, k in zip(f, m) if k) for f, m in zip(found, main)]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "n_blocks": pa.array([len(f) for f in found], pa.int64()), "n_main": pa.array([int(m.sum()) for m in main], pa.int64()),
            })

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
