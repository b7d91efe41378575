"""License scan: exact set-similarity join of text blocks with license templates, by containment of the template.

Tokens are ordered by their document frequency over the whole corpus, rarest first. A block that holds at least
a = ceil(THRESHOLD * |T|) of a template's tokens must share one of T's first |T| - a + 1 tokens with one of its own first
tokens (prefix filter), have at least a tokens (length filter), and from each shared place on still have enough
tokens on both sides (positional filter). What passes is counted exactly. Blocks are lines and paragraphs of any length; where
words met far apart are unwanted, a block with over loose * |T| different tokens counts by its runs of that many words, all of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, key_text, slices
from .texthash import ascii_lower, prefix, spans, words

#: Least containment; different tokens, as a multiple of the template's, beyond which a block counts by its runs (inf: always as a whole), and those of the query.
THRESHOLD, LOOSE, COMPACT = 0.8, math.inf, 8
#: Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of well-known licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_LOWER = ascii_lower()
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def split(text: str) -> list[str]:
    """Words of a text as the scan takes them."""
    low = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _hash(token: str) -> int:
    raw = np.frombuffer(token.encode(), np.uint8)
    return int(spans(prefix(raw), np.array([0]), np.array([len(raw)]))[0])


class Templates:
    """Templates as sets of tokens numbered by global order, with an index of their prefixes."""

    def __init__(self, templates, threshold: float, loose: float):
        self.labels = [label for label, _ in templates]
        self.tokens = sorted({w for _, t in templates for w in split(t)})
        self.sets = [set(split(t)) for _, t in templates]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.most = [loose * len(s) for s in self.sets]
        h = np.array([_hash(w) for w in self.tokens], np.uint64)
        order = np.argsort(h)
        self.hashes, self.token_of = h[order], order

    def order(self, frequency: np.ndarray) -> None:
        """Number tokens by frequency (of self.tokens), rarest first, ties by the token."""
        by = sorted(range(len(self.tokens)), key=lambda i: (frequency[i], self.tokens[i]))
        self.rank = np.empty(len(by), np.int64)
        self.rank[by] = np.arange(len(by))
        place = {w: int(self.rank[i]) for i, w in enumerate(self.tokens)}
        self.sorted = [sorted(place[w] for w in s) for s in self.sets]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, ranks in enumerate(self.sorted):
            for at, r in enumerate(ranks[: len(ranks) - self.need[t] + 1]):
                self.index.setdefault(r, []).append((t, at))
        self.is_prefix = np.zeros(len(by), bool)
        self.is_prefix[list(self.index)] = True
        self.least = min(self.need)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are template tokens, and the tokens' numbers in self.tokens."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        return hit, self.token_of[at[hit]]

    def match(self, ranks: list[int]) -> list[tuple[int, int]]:
        """(template, tokens of it) of a block with these template tokens, in order."""
        met: dict[int, int] = {}
        for j, r in enumerate(ranks):
            for t, at in self.index.get(r, ()):
                need, have = self.need[t], met.get(t, 0)
                if have < 0 or j > len(ranks) - need:
                    continue
                if have + 1 + min(len(self.sorted[t]) - at - 1, len(ranks) - j - 1) < need:
                    met[t] = -1
                else:
                    met[t] = have + 1
        own, out = set(ranks), []
        for t, have in met.items():
            if have > 0:
                both = len(own.intersection(self.sorted[t]))
                if both >= self.need[t]:
                    out.append((t, both))
        return out


def _run(at: list[int], rank: list[int], width: float) -> tuple[int, int, int]:
    """Most different ranks on `width` words in a row, and the first and last place of the first such run."""
    held: dict[int, int] = {}
    best, left = (0, 0, 0), 0
    for place, r in zip(at, rank):
        held[r] = held.get(r, 0) + 1
        while at[left] <= place - width:
            held[rank[left]] -= 1
            if not held[rank[left]]:
                del held[rank[left]]
            left += 1
        if len(held) > best[0]:
            best = (len(held), at[left], place)
    return best


class Batch:
    """Words of the texts of a batch."""

    def __init__(self, texts: pa.Array):
        raw, self.off = buffers(texts)
        self.data = _LOWER[raw]
        self.start, self.end, self.row = words(self.data, self.off, _WORD)
        self.hash = spans(prefix(self.data), self.start, self.end)
        self.n = np.bincount(self.row, minlength=len(self.off) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def lines(self) -> np.ndarray:
        """Number of the line of each word; a text's border is a line's."""
        return self._cut(np.flatnonzero(self.data == 10))

    def paragraphs(self) -> np.ndarray:
        """Number of the paragraph of each word; paragraphs end at lines without anything but white space."""
        newline = np.flatnonzero(self.data == 10)
        solid = np.cumsum(~np.isin(self.data, [9, 10, 11, 12, 13, 32]))
        blank = newline[1:][solid[newline[1:]] == solid[newline[:-1]]] if len(newline) > 1 else newline[:0]
        return self._cut(blank)

    def _cut(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.sort(np.concatenate([at, self.off[1:-1]])), self.start, "right")


def _frequencies(t: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(t.tokens), np.int64)
        for batch in slices(batches):
            b = Batch(batch.column("text"))
            hit, token = t.find(b.hash)
            df += np.bincount(np.unique(b.row[hit] * len(df) + token) % len(df), minlength=len(df))
        yield pa.RecordBatch.from_pydict({"token": pa.array(np.arange(len(df))), "df": pa.array(df)})

    return run


def _phrases(b: Batch, phrases: dict[str, str]) -> list[list[tuple[int, str]]]:
    """(first word, label) of each place of a phrase, by row; hits of hashes are held against the text."""
    out: list[list[tuple[int, str]]] = [[] for _ in range(len(b.n))]
    for phrase, label in phrases.items():
        parts = [w.encode() for w in phrase.split()]
        k = len(parts)
        if len(b.hash) < k:
            continue
        ok = b.row[: len(b.row) - k + 1] == b.row[k - 1 :]
        for j, w in enumerate(parts):
            ok &= b.hash[j : len(b.hash) - k + 1 + j] == np.uint64(_hash(w.decode()))
        for i in np.flatnonzero(ok).tolist():
            if all(b.data[b.start[i + j] : b.end[i + j]].tobytes() == w for j, w in enumerate(parts)):
                out[b.row[i]].append((i - int(b.first[b.row[i]]), label))
    return out


def _blocks(b: Batch, t: Templates, block: np.ndarray, out: list[list[dict]]) -> None:
    """Add the matches of blocks (a number for each word, ascending) to the rows' lists."""
    hit, token = t.find(b.hash)
    if not len(hit):
        return
    every, own = t.rank[token], block[hit]
    key = np.unique(own * len(t.tokens) + every)
    own, rank = key // len(t.tokens), key % len(t.tokens)
    edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
    likely = np.add.reduceat(t.is_prefix[rank], edges[:-1]) > 0
    likely &= np.diff(edges) >= t.least
    for e in np.flatnonzero(likely).tolist():
        a, z = edges[e], edges[e + 1]
        lo, hi = np.searchsorted(block, own[a], "left"), np.searchsorted(block, own[a], "right")
        found = t.match(rank[a:z].tolist())
        n = len(np.unique(b.hash[lo:hi])) if found else 0
        for k, both in found:
            row, begin, end = int(b.row[lo]), lo, hi - 1
            if n > t.most[k]:
                near = slice(*np.searchsorted(hit, [lo, hi]))
                mine = np.isin(every[near], t.sorted[k])
                both, begin, end = _run(hit[near][mine].tolist(), every[near][mine].tolist(), t.most[k])
                if both < t.need[k]:
                    continue
            out[row].append({"label": t.labels[k], "first_word": int(begin - b.first[row]), "last_word": int(end - b.first[row]), "containment": both / len(t.sorted[k])})


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, loose: float = LOOSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches of each row's whole text.

    n_base counts the places of the phrases, first_word and last_word are their least and largest first words (null without
    any). matches has each block (a line, or a paragraph of several lines) with a template's containment; a block with over
    `loose` times the template's tokens counts if a run of that many of its words holds the template, and the best run stands for it. labels are those of
    phrases and matches; score is 1 with a phrase, else the best containment, else 0. Null and empty texts have no words, labels
    or places. Templates held to the same share all give their label. Rows that repeat, and null ids, are rows of their own;
    other columns are not carried; empty input gives no rows.
    """
    t = Templates(templates, threshold, loose)
    rows = key_text(docs, id_col, text_col)
    counted = rows.select("text").mapInArrow(_frequencies(t), "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).collect()  # one row a template token
    frequency = np.zeros(len(t.tokens), np.int64)
    for r in counted:
        frequency[r.token] = r.df
    t.order(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            b = Batch(batch.column("text"))
            base = _phrases(b, phrases)
            found: list[list[dict]] = [[] for _ in base]
            line, para = b.lines(), b.paragraphs()
            _blocks(b, t, line, found)
            _blocks(b, t, para, found)
            found = [[dict(x) for x in sorted({tuple(m.items()) for m in f})] for f in found]
            join = lambda x: ",".join(sorted(set(x)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(b.n.astype(np.int64)), "n_base": pa.array([len(p) for p in base], pa.int64()),
                "first_word": pa.array([min(p)[0] if p else None for p in base], pa.int64()), "last_word": pa.array([max(p)[0] if p else None for p in base], pa.int64()),
                "base_labels": pa.array([join(x for _, x in p) for p in base], pa.string()),
                "labels": pa.array([join([x for _, x in p] + [m["label"] for m in f]) for p, f in zip(base, found)], pa.string()),
                "score": pa.array([1.0 if p else max((m["containment"] for m in f), default=0.0) for p, f in zip(base, found)], pa.float64()),
                "matches": pa.array(found, _MATCH),
            })

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,last_word:long,containment:double>>")
