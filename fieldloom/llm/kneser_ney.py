"""Interpolated modified Kneser-Ney model of three words (or two), counted in Spark, stored as sorted hash arrays that workers memory-map.

Counting rounds, each a map with local sums, one shuffle of packed sorted runs, and a reduce by shard of the key's hash: words
(hash, count), then triples of word numbers by their last two words, then per-word totals of the pairs and totals of the
triples' first two words. Keys are dealt out by hash after local sums, so frequent words weigh no more than others. The files of a shard:
  w<shard> word hashes, sorted; c<shard> their counts. A word's number is its place over all shards.
  p<shard> pair hashes (a bijection of the pair), sorted; q<shard> their counts; r<shard> their different words before.
  k<shard> (per word number, as w) different words before; t, a, b, d<shard> the sum of r of the pairs after it, and pairs with r of one, two, more.
  g<shard> hashes of the triples seen twice or more, sorted, with their last pair's shard; h<shard> their counts.
  x<shard> hashes of pairs that such triples start with, sorted; s, y, z<shard> their tokens in such triples, and such triples seen twice, more.
  o<shard> first words of the triples seen once, pair by pair as p, sorted in each; e, f<shard> where each BLOCK of pairs begins there, and each pair from its block's start.
Counts are bytes; those of 255 and more stand behind (put_counts). A model that is pruned (train's default, not the query's) has no o, e and f: triples seen
once count in the discounts and totals, and their mass goes to the pair's estimate (a context whose triples are all single passes everything on).
A document is one sentence: the start counts as a word before it, the end is a token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, key_text, settle, shared_path, slices
from .files import Arrays, put_array
from .texthash import ascii_lower, gather, mix, prefix, spans, words

#: Keys a task sums up before it hands them on; bytes of text whose keys one shard may have to hold (with 2^16 shards they grow).
HOLD, SHARD_BYTES = 4_000_000, 128 << 20
#: Bytes of text whose words are hashed at a time.
PIECE = 1 << 18
#: Pairs whose places among the triples seen once are told from a common one.
BLOCK = 256
_END = np.uint64(0x454E44)
_NONE = np.uint32(0xFFFFFFFF)
_LOWER = ascii_lower()
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens end to end, each text's words then its end, and the texts' offsets."""
    data, off = buffers(texts)
    data = _LOWER[data]
    s, e, row = words(data, off, _WORD)
    n = np.bincount(row, minlength=len(off) - 1) + 1
    out_off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out_off[1:])
    out = np.empty(out_off[-1], np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[out_off[1:] - 1] = True
    out[is_end] = _END
    out[~is_end] = _hashes(data, s, e)
    return out, out_off


def _hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the words data[s[i]:e[i]], ascending, PIECE bytes at a time: hashing takes over thirty bytes for each byte of text."""
    out, a = np.empty(len(s), np.uint64), 0
    while a < len(s):
        b = max(a + 1, int(np.searchsorted(e, s[a] + PIECE, "right")))
        out[a:b] = spans(prefix(data[s[a] : e[b - 1]]), s[a:b] - s[a], e[a:b] - s[a])
        a = b
    return out


# --- packed runs: sorted keys by difference, byte planes, zstd --------------------------------------


def _planes(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.dtype.str.encode().ljust(8) + x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unplanes(b: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    kind = np.dtype(raw[:8].decode().strip())
    return np.frombuffer(raw, np.uint8, offset=8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def put_counts(uri: str, name: str, x: np.ndarray) -> None:
    """Whole numbers as bytes; behind them the places of those of 255 and more, these themselves, and how many they are, eight bytes each."""
    big = np.flatnonzero(x >= 255)
    tail = np.concatenate([big, x[big].astype(np.int64), [len(big)]]).astype(np.int64)
    put_array(uri, name, np.concatenate([np.minimum(x, 255).astype(np.uint8), tail.view(np.uint8)]))


def _counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers at some places of what put_counts wrote."""
    out = raw[at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        n = int(raw[-8:].view(np.int64)[0])
        places, values = raw[-8 - 16 * n : -8].view(np.int64).reshape(2, n)
        out[big] = values[np.searchsorted(places, at[big])]
    return out


def _pack(keys: np.ndarray, *values: np.ndarray) -> list[bytes]:
    return [_planes(_narrow(np.diff(keys, prepend=keys[:1] * 0))), *(_planes(_narrow(v)) for v in values)]


def _unpack(row: list[bytes]) -> list[np.ndarray]:
    """The keys and their values; these as narrow as they were packed, so that sums of them need a type of their own."""
    first, *rest = [_unplanes(b) for b in row]
    return [np.cumsum(first, dtype=np.uint64), *rest]


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return [keys[first], *(np.add.reduceat(v[order], first, dtype=np.uint64) for v in values)]


def _dealt(shards: int, of, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """A packed run for each shard; of(keys): their shards."""
    to = of(keys).astype(np.int32)
    order = np.argsort(to, kind="stable")
    to = to[order]
    at = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, int)
    runs = [_pack(*(x[order[a:b]] for x in (keys, *values))) for a, b in zip(at, at[1:])]
    return pa.RecordBatch.from_pydict({"shard": pa.array(to[at[:-1]]) if len(to) else pa.array([], pa.int32()), "run": pa.array(runs, pa.list_(pa.binary()))})


def _top(shards: int):
    shift = np.uint64(64 - (shards.bit_length() - 1))
    return lambda h: (h >> shift).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)


def _triple_sums(keys: np.ndarray, firsts: np.ndarray, n: np.ndarray | None = None) -> list[np.ndarray]:
    """Different (pair, first), sorted, and the sums of their counts (one each unless given)."""
    order = np.lexsort((firsts, keys))
    keys, firsts, n = keys[order], firsts[order], None if n is None else n[order]
    del order
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (firsts[1:] != firsts[:-1])]) if len(keys) else np.zeros(0, int)
    if n is None:
        sums = np.diff(first, append=len(keys)).astype(np.uint64)
    else:
        sums = np.add.reduceat(n, first, dtype=np.uint64) if len(first) else n
    return [keys[first], firsts[first], sums]


def _word_sums(pair: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Of sorted pairs, by word number: pairs that end in it; of those that begin with it the sum of `before`, and how many have one, two, more."""
    w, kinds = np.unique(pair & np.uint64(0xFFFFFFFF), return_counts=True)
    v = pair >> np.uint64(32)
    edge = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    after = [np.add.reduceat(x, edge, dtype=np.uint64) for x in (before, before == 1, before == 2, before > 2)]
    lacks = [np.zeros(len(x), np.uint64) for x in (w, edge)]
    return _sums(np.concatenate([w, v[edge]]), np.concatenate([kinds.astype(np.uint64), lacks[1]]), *(np.concatenate([lacks[0], x]) for x in after))


class _Held:
    """Sums of a task, handed on when there are many."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n.astype(np.uint64)))
        self.n += len(k)

    def full(self) -> bool:
        if self.n > HOLD and len(self.parts) > 1:
            self.parts = [tuple(self.take())]
            self.n = len(self.parts[0][0])
        return self.n > HOLD // 2 and len(self.parts) == 1

    def take(self) -> list[np.ndarray]:
        parts, self.parts, self.n = self.parts, [], 0
        return _sums(*(np.concatenate(x) for x in zip(*parts))) if parts else [np.zeros(0, np.uint64)] * 2


@dataclass
class Model:
    """Where the arrays are, and the numbers that all words share."""

    uri: str
    shards: int
    base: np.ndarray = None  # number of each shard's first word
    n_tokens: int = 0
    pair_types: int = 0
    order: int = 3
    prune: bool = True
    discounts: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    gamma1: float = 1.0
    _arrays: Arrays = None

    @property
    def n_words(self) -> int:
        return int(self.base[-1])

    def __getstate__(self):
        return self.__dict__ | {"_arrays": None}

    @property
    def arrays(self) -> Arrays:
        self._arrays = self._arrays or Arrays(self.uri)
        return self._arrays

    def _search(self, name: str, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, place or -1) of each hash."""
        shard = _top(self.shards)(sorted_hashes)
        at = np.full(len(shard), -1)
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(1, int)
        for a, b in zip(edges, edges[1:]):
            keys, q = self.arrays[f"{name}{shard[a]}"], sorted_hashes[a:b]
            i = np.minimum(np.searchsorted(keys, q), max(len(keys) - 1, 0))
            at[a:b] = np.where(keys[i] == q, i, -1) if len(keys) else -1
        return shard, at

    def _take(self, name: str, shard: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Values of a shard's array at known places, 0 elsewhere; shards ascend."""
        out = np.zeros(len(at))
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(1, int)
        for a, b in zip(edges, edges[1:]):
            ok = at[a:b] >= 0
            if ok.any():
                out[a:b][ok] = _counts(np.asarray(self.arrays[f"{name}{shard[a]}"]), at[a:b][ok])
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct word hashes; -1 if not met in training."""
        shard, at = self._search("w", hashes)
        return np.where(at >= 0, self.base[shard] + at, -1)

    def pairs(self, number: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pair (before, word) of each token; the start is number n_words; unknown words count as n_words + 1."""
        number = np.where(number < 0, self.n_words + 1, number).astype(np.uint64)
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[offsets[:-1]] = self.n_words
        return (before << np.uint64(32)) | number

    def firsts(self, pair: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The word before each token's pair; NONE where the pair has the start, and everywhere in a model of pairs."""
        out = np.full(len(pair), _NONE)
        if self.order > 2:
            out[1:] = (pair[:-1] >> np.uint64(32)).astype(np.uint32)
            out[offsets[:-1]] = _NONE
        return out

    def triples(self, pair_hash: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hashes of triples, whose top bits are those of the pair's hash: they lie in the pair's shard."""
        low = np.uint64(64 - (self.shards.bit_length() - 1))
        return (pair_hash >> low << low) | (mix(pair_hash * np.uint64(0x9E3779B97F4A7C15) + first) >> (np.uint64(64) - low))

    def _once(self, shard: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether triples were seen once, from their last pairs' places (-1: not met) and first words; shards ascend."""
        out = np.zeros(len(at), bool)
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(1, int)
        for a, b in zip(edges, edges[1:]):
            i = a + np.flatnonzero(at[a:b] >= 0)
            if not len(i):
                continue
            firsts, begin, rest = (np.asarray(self.arrays[f"{name}{shard[a]}"]) for name in "oef")
            lo, end = (begin[x // BLOCK].astype(np.int64) + rest[x] for x in (at[i], at[i] + 1))
            want, hi = first[i], end.copy()
            k = np.flatnonzero(lo < hi)
            while len(k):  # halving, each among its own pair's
                mid = (lo[k] + hi[k]) >> 1
                less = firsts[mid] < want[k]
                lo[k[less]], hi[k[~less]] = mid[less] + 1, mid[~less]
                k = k[lo[k] < hi[k]]
            k = np.flatnonzero(lo < end)
            out[i[k]] = firsts[lo[k]] == want[k]
        return out

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """For each text: n_tokens, n_known, base_score, score."""
        h, off = tokens(texts)
        uniq, inv = np.unique(h, return_inverse=True)
        shard, at = self._search("w", uniq)
        count = self._take("c", shard, at)
        kinds = self._take("k", shard, at)
        d = self.discounts["words"]
        p1 = np.maximum(kinds - _cut(d, kinds), 0) / max(self.pair_types, 1) + self.gamma1 / (self.n_words + 1)
        mass, total = self._context(shard, at)
        start_mass, start_total = self._context(np.array([self.shards]), np.array([0]))
        number = np.where(at >= 0, self.base[shard] + at, -1)
        raw = self.pairs(number[inv], off)
        pair = mix(raw)
        up, pinv = np.unique(pair, return_inverse=True)
        found = self._search("p", up)
        seen, c = self._take("q", *found), self._take("r", *found)[pinv]
        before = np.empty(len(h), np.int64)
        before[1:] = inv[:-1]
        t, m = total[before % len(uniq)], mass[before % len(uniq)]
        t[off[:-1]], m[off[:-1]] = start_total[0], start_mass[0]
        safe = np.maximum(t, 1)
        prob = np.where(t > 0, (c - _cut(self.discounts["pairs"], c)) / safe + m / safe * p1[inv], p1[inv])
        if self.order > 2:
            prob = self._third(prob, raw, pair, off, seen[pinv], up, pinv, found)
        base = np.log10((count + 0.1) / (self.n_tokens + 0.1 * (self.n_words + 1)))
        add = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  every text has a token
        return {"n_tokens": np.diff(off), "n_known": add((count > 0)[inv].astype(np.int64)), "base_score": add(base[inv]), "score": add(np.log10(prob))}

    def _third(self, prob: np.ndarray, raw: np.ndarray, pair: np.ndarray, off: np.ndarray, seen: np.ndarray, up: np.ndarray, pinv: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Probabilities given two words before, from those given one; the context of a token is the pair of the token before.

        up, pinv, places: the different pair hashes, each token's among them, and where the model has them."""
        after = np.ones(len(raw), bool)
        after[off[:-1]] = False
        i = np.flatnonzero(after)
        if not len(i):
            return prob
        d = self.discounts["triples"]
        found = self._search("x", up)
        kept, two, more = (self._take(n, *found)[pinv[i - 1]] for n in "syz")
        context = seen[i - 1]
        first = self.firsts(raw, off)[i]
        ut, one, tinv = np.unique(self.triples(pair[i], first), return_index=True, return_inverse=True)
        c = self._take("h", *self._search("g", ut))
        if not self.prune:
            shard, at = (x[pinv[i[one]]] for x in places)
            c += self._once(shard, np.where(c > 0, -1, at), first[one])
        c = c[tinv]
        safe = np.maximum(context, 1)
        out = prob.copy()
        mass = (1.0 if self.prune else d[0]) * (context - kept) + d[1] * two + d[2] * more  # as many triples seen once as their tokens
        out[i] = np.where(context > 0, (c - _cut(d, c)) / safe + mass / safe * prob[i], prob[i])
        return out

    def _context(self, shard: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.discounts["pairs"]
        return sum(x * self._take(n, shard, at) for x, n in zip(d, "abd")), self._take("t", shard, at)


def _cut(d: tuple[float, float, float], c: np.ndarray) -> np.ndarray:
    """The discount of each count."""
    return np.select([c == 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of things seen once to four times; 0.5, 1, 1.5 where these are not to be had."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(out, 1))


def _merged(batches: Iterator[pa.RecordBatch], sums: Callable = _sums) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sums of each shard of a partition."""
    runs: dict[int, list] = {}
    for batch in batches:
        for s, run in zip(batch.column("shard").to_pylist(), batch.column("run").to_pylist()):
            runs.setdefault(s, []).append(_unpack(run))
    for s in sorted(runs):
        yield s, sums(*(np.concatenate(x) for x in zip(*runs.pop(s))))


def train(docs: DataFrame, path: str | None = None, order: int = 3, id_col: str = "doc_id", text_col: str = "text", prune: bool = True) -> Model:
    """Count all rows of docs (null: empty) and write the model's arrays below path (a new folder in the shared one unless given).

    prune: triples seen once are not stored and pass their mass on; else they have their own probabilities as all others. Rows that repeat count as often as they stand there; ids play no part. No rows make a model without words.
    """
    spark = docs.sparkSession
    uri = path or shared_path(spark, "kneser-ney")
    text = key_text(docs, id_col, text_col).select("text")
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES, 16)
    shards = 1 << min(16, (least - 1).bit_length())
    m = Model(uri, shards, order=order, prune=prune)
    top = _top(shards)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in slices(batches):
            held.add(tokens(batch.column("text"))[0])
            if held.full():
                yield _dealt(shards, top, *held.take())
        yield _dealt(shards, top, *held.take())

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (keys, n) in _merged(batches):
            put_array(uri, f"w{s}", keys)
            put_counts(uri, f"c{s}", n)
            yield pa.RecordBatch.from_pydict({"shard": [s], "n": [len(keys)], "sum": [int(n.sum())]})

    runs = text.mapInArrow(count_words, "shard int, run array<binary>").repartitionById(shards, F.col("shard"))
    got = runs.mapInArrow(write_words, "shard long, n long, sum long").collect()  # one row a shard
    sizes = np.zeros(shards, np.int64)
    for r in got:
        sizes[r.shard] = r.n
        m.n_tokens += r.sum
    for s in np.flatnonzero(sizes == 0):
        put_array(uri, f"w{s}", np.zeros(0, np.uint64))
        put_counts(uri, f"c{s}", np.zeros(0, np.uint8))
    m.base = np.concatenate([[0], np.cumsum(sizes)])
    if m.n_words + 2 >= 1 << 32:
        raise ValueError("more different words than 32 bits can number")

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda k: top(mix(k))
        parts, held = [], 0

        def take() -> list[np.ndarray]:
            pair, first = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            return _triple_sums(pair, first)

        def add(texts: pa.Array) -> int:
            h, off = tokens(texts)
            uniq, inv = np.unique(h, return_inverse=True)
            pair = m.pairs(m.numbers(uniq)[inv], off)
            parts.append((pair, m.firsts(pair, off)))
            return len(pair)

        for batch in slices(batches):
            held += add(batch.column("text"))
            if held > HOLD // 2:
                yield _dealt(shards, of, *take())
                held = 0
        if parts:
            yield _dealt(shards, of, *take())

    where = lambda k: np.searchsorted(m.base[1:], k.astype(np.int64), "right")  # noqa: E731  the start is shard `shards`

    def put_once(s: int, firsts: np.ndarray, off: np.ndarray) -> None:
        """firsts: first words of a shard's triples seen once; off: where each pair's begin, and the end."""
        put_array(uri, f"o{s}", firsts.astype(np.uint32))
        put_array(uri, f"e{s}", off[::BLOCK])
        put_array(uri, f"f{s}", _narrow(off - np.repeat(off[::BLOCK], BLOCK)[: len(off)]))

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (keys, first, n) in _merged(batches, _triple_sums):
            edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            third = first != _NONE
            pair, raw = keys[edge], np.add.reduceat(n, edge)
            before = np.where(third[edge], np.diff(np.append(edge, len(keys))), raw.astype(np.int64)).astype(np.uint64)  # at the start, and without triples: the counts
            h = mix(pair)
            place = np.argsort(h)
            put_array(uri, f"p{s}", h[place])
            put_counts(uri, f"q{s}", raw[place])
            put_counts(uri, f"r{s}", before[place])
            often, once = third & (n > 1), third & (n == 1)
            triple = m.triples(mix(keys[often]), first[often])
            order = np.argsort(triple)
            put_array(uri, f"g{s}", triple[order])
            put_counts(uri, f"h{s}", n[often][order])
            if not prune:
                put_once(s, *gather(first[once], np.append(0, np.cumsum(np.add.reduceat(once, edge, dtype=np.int64))), place))
            words_ = _dealt(shards, where, *_word_sums(pair, before)).to_pydict()
            # the first two words of the triples that are kept
            start = mix((first[often].astype(np.uint64) << np.uint64(32)) | (keys[often] >> np.uint64(32)))
            starts = _dealt(shards, top, *_sums(start, n[often], (n[often] == 2).astype(np.uint64), (n[often] > 2).astype(np.uint64))).to_pydict()
            stats = [int((before == j).sum()) for j in (1, 2, 3, 4)] + [len(pair)] + [int((n[third] == j).sum()) for j in (1, 2, 3, 4)]
            k = len(words_["run"]), len(starts["run"])
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([*words_["shard"], *starts["shard"], s], pa.int32()), "kind": pa.array(["word"] * k[0] + ["start"] * k[1] + ["stats"]),
                "run": pa.array([*words_["run"], *starts["run"], None], pa.list_(pa.binary())), "stats": pa.array([None] * sum(k) + [stats], pa.list_(pa.int64())),
            })

    runs = text.mapInArrow(count_triples, "shard int, run array<binary>").repartitionById(shards, F.col("shard"))
    per_word = settle(spark, runs.mapInArrow(write_pairs, "shard int, kind string, run array<binary>, stats array<long>"), "pairs")
    stats = per_word.where("kind = 'stats'").select("shard", *(F.col("stats")[j].alias(f"s{j}") for j in range(9))).collect()  # one row a shard
    m.discounts["pairs"] = discounts([sum(r[f"s{j}"] for r in stats) for j in range(4)])
    m.discounts["triples"] = discounts([sum(r[f"s{j}"] for r in stats) for j in range(5, 9)])
    m.pair_types = sum(r["s4"] for r in stats)
    for s in set(range(shards)) - {r.shard for r in stats}:
        for name in "pg":
            put_array(uri, f"{name}{s}", np.zeros(0, np.uint64))
        for name in "qrh":
            put_counts(uri, f"{name}{s}", np.zeros(0, np.uint8))
        if not prune:
            put_once(s, np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def write_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (keys, *values) in _merged(batches):
            put_array(uri, f"x{s}", keys)
            for name, x in zip("syz", values):
                put_counts(uri, f"{name}{s}", x)
            yield pa.RecordBatch.from_pydict({"shard": [s]})

    runs = per_word.where("kind = 'start'").select("shard", "run").repartitionById(shards, F.col("shard"))
    have = {r.shard for r in runs.mapInArrow(write_starts, "shard long").collect()}  # one row a shard
    for s in set(range(shards)) - have:
        put_array(uri, f"x{s}", np.zeros(0, np.uint64))
        for name in "syz":
            put_counts(uri, f"{name}{s}", np.zeros(0, np.uint8))

    def write_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (number, *values) in _merged(batches):
            size = int(m.base[s + 1] - m.base[s]) if s < shards else 1
            at = number.astype(np.int64) - int(m.base[s])
            dense = []
            for name, x in zip("ktabd", values):
                dense.append(np.zeros(size, np.uint64))
                dense[-1][at] = x
                put_counts(uri, f"{name}{s}", dense[-1])
            yield pa.RecordBatch.from_pydict({"shard": [s], "stats": [[int((dense[0] == j).sum()) for j in (1, 2, 3, 4)] + [int((dense[0] > 2).sum())]]})

    runs = per_word.where("kind = 'word'").select("shard", "run").repartitionById(shards + 1, F.col("shard"))
    stats = runs.mapInArrow(write_totals, "shard long, stats array<long>").collect()  # one row a shard
    have = {r.shard for r in stats}
    for s in set(range(shards + 1)) - have:
        for name in "ktabd":
            put_counts(uri, f"{name}{s}", np.zeros(max(1, int(m.base[s + 1] - m.base[s]) if s < shards else 1), np.uint8))
    n = [sum(r.stats[j] for r in stats if r.shard < shards) for j in range(5)]
    d = m.discounts["words"] = discounts(n[:4])
    m.gamma1 = (d[0] * n[0] + d[1] * n[1] + d[2] * n[4]) / m.pair_types if m.pair_types else 1.0
    return m


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity of each row's whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, step=2 << 20):
            got = model.score(batch.column("text"))
            got["perplexity"] = 10 ** np.minimum(-got["score"] / got["n_tokens"], 300)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "train_tokens": pa.array([model.n_tokens] * batch.num_rows, pa.int64()), **{k: pa.array(v) for k, v in got.items()}}).select(_SCORES)

    return key_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


_SCORES = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]


def held_out(docs: DataFrame, n: int = 10, id_col: str = "doc_id") -> Column:
    """crc32 of doc_id as text is 0 mod n; null ids are held out."""
    return F.coalesce(F.crc32(docs[id_col].cast("string")) % n, F.lit(0)) == 0


def score_all(docs: DataFrame) -> DataFrame:
    """Train on nine tenths and score all rows, by all triples."""
    out = score(docs, train(docs.where(~held_out(docs)), prune=False))
    return out.withColumn("held_out", held_out(out)).select("doc_id", "held_out", *_SCORES[1:])
