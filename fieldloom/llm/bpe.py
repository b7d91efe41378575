"""Byte-level BPE by a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import importlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import key_text, slices
from .texthash import gather

#: Pieces whose ids a worker keeps; beyond it the worker starts afresh.
CACHE = 300_000
#: Longest piece that is kept or encoded side by side with others.
SHORT = 64
_NONE = np.int64(1) << 62


class Ranks:
    """The vocabulary: bytes of each id, and the id that each mergeable pair of ids makes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        n = max(self.rank.values()) + 1
        table = [b""] * n
        for token, i in self.rank.items():
            table[i] = token
        self.offsets = np.zeros(n + 1, np.int64)
        np.cumsum([len(t) for t in table], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {(self.rank[t[:k]] << 32) | self.rank[t[k:]]: i for t, i in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank}
        self.pair = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that a and b make together, or _NONE."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


def encode_long(piece: bytes, v: Ranks) -> list[int]:
    """One piece: tree[k] is the least (rank, position) below node k; ranks are unique, so leftmost is least."""
    n = len(piece)
    ids = v.byte_id[np.frombuffer(piece, np.uint8)].tolist()
    size = 1 << max(1, (n - 1).bit_length())
    none = (1 << 62, 0)
    tree = [none] * (2 * size)
    pair = v.pair
    for i in range(n - 1):
        r = pair.get((ids[i] << 32) | ids[i + 1])
        if r is not None:
            tree[size + i] = (r, i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: tuple[int, int]) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low

    def rank_at(i: int) -> tuple[int, int]:
        j = nxt[i]
        r = pair.get((ids[i] << 32) | ids[j]) if j < n else None
        return none if r is None else (r, i)

    while tree[1] is not none and tree[1][0] < 1 << 62:
        rank, i = tree[1]
        j = nxt[i]
        ids[i], nxt[i] = rank, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        put(j, none)
        put(i, rank_at(i))
        if prv[i] >= 0:
            put(prv[i], rank_at(prv[i]))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = nxt[i]
    return out


def encode_many(pieces: list[bytes], v: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of short pieces end to end, and how many each has: one tree a row, all rows merging their own least pair at a time."""
    n, lens = len(pieces), np.array([len(p) for p in pieces])
    size = 1 << max(1, int(lens.max() - 1).bit_length())
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
    col = np.arange(size)
    ids = np.where(col < lens[:, None], v.byte_id[raw], -1)
    nxt = np.minimum(col + 1, size)[None].repeat(n, 0)
    prv = (col - 1)[None].repeat(n, 0)
    tree = np.full((n, 2 * size), _NONE)
    has = col[None, 1:] < lens[:, None]
    first = np.full((n, size), _NONE)
    first[:, :-1][has] = v.merge(ids[:, :-1][has], ids[:, 1:][has])
    tree[:, size:] = np.where(first < _NONE, (first << 8) | col, _NONE)
    w = size
    while w > 1:
        tree[:, w // 2 : w] = np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2])
        w //= 2
    rows = np.flatnonzero(tree[:, 1] < _NONE)

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        k = i + size
        tree[r, k] = value
        for _ in range(size.bit_length() - 1):
            k = k >> 1
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

    def ranks_at(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = nxt[r, i]
        ok = j < lens[r]
        got = np.where(ok, v.merge(ids[r, i], ids[r, np.where(ok, j, 0)]), _NONE)
        return np.where(got < _NONE, (got << 8) | i, _NONE)

    while len(rows):
        top = tree[rows, 1]
        i = top & 255
        j = nxt[rows, i]
        after = nxt[rows, j]
        ids[rows, i], ids[rows, j], nxt[rows, i] = top >> 8, -1, after
        ok = after < lens[rows]
        prv[rows[ok], after[ok]] = i[ok]
        put(rows, j, np.full(len(rows), _NONE))
        put(rows, i, ranks_at(rows, i))
        p = prv[rows, i]
        ok = p >= 0
        put(rows[ok], p[ok], ranks_at(rows[ok], p[ok]))
        rows = rows[tree[rows, 1] < _NONE]
    live = ids >= 0
    return ids[live], live.sum(1)


class Encoder:
    """Text to ids. Pieces met before come from a bounded cache of ids."""

    def __init__(self, path: str, pattern: str):
        self.v, self.find = load(path), importlib.import_module("regex").compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _add(self, new: list[str]) -> None:
        """Encode pieces that are not known and give them slots."""
        raw = [p.encode() for p in new]
        whole = [self.v.rank.get(b) for b in raw]
        groups: dict[int, list[int]] = {}
        for k, (b, r) in enumerate(zip(raw, whole)):
            groups.setdefault(-1 if r is not None else 0 if len(b) > SHORT else (len(b) - 1).bit_length(), []).append(k)
        order, parts, lens = [], [], []
        for size, ks in groups.items():
            for at in range(0, len(ks), 20_000):
                some = ks[at : at + 20_000]
                order += some
                if size == -1:
                    parts.append(np.array([whole[k] for k in some], np.int64))
                    lens.append(np.ones(len(some), np.int64))
                elif size == 0:
                    got = [encode_long(raw[k], self.v) for k in some]
                    parts.append(np.array([i for x in got for i in x], np.int64))
                    lens.append(np.array([len(x) for x in got], np.int64))
                else:
                    a, b = encode_many([raw[k] for k in some], self.v)
                    parts.append(a)
                    lens.append(b)
        base = len(self.offsets) - 1
        self.slot.update((new[k], base + i) for i, k in enumerate(order))
        self.ids = np.concatenate([self.ids, *parts])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(lens))])

    def __call__(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and their offsets."""
        if len(self.slot) > CACHE or len(self.ids) > 16 * CACHE:
            self.clear()
        pieces = [self.find(t) for t in texts]
        new = list({p for x in pieces for p in x if p not in self.slot})
        long = [p for p in new if len(p) > SHORT]
        if new:
            self._add(new)
        slot = self.slot
        which = np.fromiter((slot[p] for x in pieces for p in x), np.int64, sum(map(len, pieces)))
        ids, at = gather(self.ids, self.offsets, which)
        ends = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(x) for x in pieces], out=ends[1:])
        for p in long:
            del self.slot[p]  # do not keep very long pieces; their ids go with the next clearing
        return ids, at[ends]


def decode(ids: np.ndarray, v: Ranks) -> bytes:
    return gather(v.bytes, v.offsets, ids)[0].tobytes()


def _mapper(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, pattern)
        for batch in slices(batches, step=2 << 20):
            ids, off = enc(batch.column("text").to_pylist())
            cols = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(off))}
            rows = [ids[a:b] for a, b in zip(off[:-1], off[1:])]
            if with_ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                cols["decoded"] = pa.array([decode(x, enc.v) for x in rows], pa.binary())
            else:
                cols["ids_sha256"] = pa.array([hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in rows], pa.string())
                cols["decoded_sha256"] = pa.array([hashlib.sha256(decode(x, enc.v)).hexdigest() for x in rows], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return run


def encode_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded binary (the UTF-8 bytes that the ids decode to) of each row.

    Each match of pattern is encoded by itself by the ranks in the file at path; null and empty texts have no ids.
    A piece of any length takes O(n log n) steps; of equal least ranks the leftmost pair is merged. Rows are neither moved nor
    dropped: rows that repeat and null ids are rows of their own. Other columns are not carried; empty input gives no rows.
    """
    return key_text(docs, id_col, text_col).mapInArrow(_mapper(path, pattern, True), "doc_id long, n_tokens long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (decoded bytes), lower-case hex."""
    return key_text(docs, id_col, text_col).mapInArrow(_mapper(path, pattern, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
