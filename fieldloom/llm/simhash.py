"""SimHash near-duplicates: fingerprints linked within a Hamming distance by a Gray-order hierarchical index.

Distinct fingerprints are dealt out to shares. Each share is sorted by Gray rank and factored into a tree: a node holds the bits
that all its members share (mask) and their values (pattern). Pairs of nodes descend together: a pair whose shared bits already
differ in more than d places is dropped with all its members, a pair that can't differ in more than d places is linked as a
whole, and so is a node whose members can't. Tasks return a spanning forest, never all pairs; components are joined by
large-star and small-star rounds in Spark.

Two kinds of fingerprints use the index. 64 bits of four-word shingles, repeats included, link at a fixed small distance: they
are dealt out by agreeing bands (two words that differ in at most d of b bands' bits agree on b - d bands, so no link is
missed). WIDE words of 64 bits of different five-word shingles estimate the shingles' similarity: bits differ for a share of
angle / pi, and sets of Jaccard similarity s lie at the angle acos(2 s / (1 + s)). They are dealt out by samples of bits, as many
samples as miss a pair of that similarity with a chance of MISS.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, key_text, one_of_each, settle, slices, whole_rows, with_group
from .texthash import mix, prefix, spans, words

#: Words a shingle, differing bits that still link, seed of the hash, children a node, rows that one share of a hot band may have.
WORDS, BITS, SEED, FANOUT, SHARE = 4, 4, 42, 8, 20_000
#: Fingerprints of a hot share that meet all of its blocks.
PIVOTS = 500
#: Words a shingle and least similarity of near copies, 64-bit words of their fingerprints, standard deviations of the distance allowed
#: above its mean there, chance that no sample of bits agrees there, fingerprints that chance should bring together on a sample.
NEAR_WORDS, NEAR, WIDE, SPREAD, MISS, TOGETHER = 5, 0.8, 6, 0.8, 0.1, 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, k: int = WORDS) -> int:
    """Majority of the bits of the hashes of all k-word shingles, repeats included; 0 without words."""
    own = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not own:
        return 0
    if len(own) <= k:
        return xxhash.xxh64_intdigest(b" ".join(own), SEED)
    line = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[: -k] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())], np.uint64, len(own) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = np.fromiter((fingerprint(t, k) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield batch.drop_columns(["text"]).append_column("fp", pa.array(got.view(np.int64)))

    return run


def fingerprints(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each row's whole text; null counts as empty."""
    return key_text(docs, id_col, text_col).mapInArrow(_prints(k), "doc_id long, fp long")


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LANES = np.uint64(0x0001000100010001)


def wide_prints(texts: pa.Array, k: int = NEAR_WORDS, n_words: int = WIDE) -> np.ndarray:
    """(texts, n_words) fingerprints: bit b is 1 if it is set in over half of the hashes of the text's different k-word shingles.

    A-Z count as a-z; a text of fewer words has one shingle; one without words is all zeros.
    """
    raw, off = buffers(texts)
    data = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    first, last, row = words(data, off, ~_SPACE)
    h = spans(prefix(data), first, last)
    n = np.bincount(row, minlength=len(texts))
    begin = np.cumsum(n) - n
    size = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    grams = np.zeros(len(at), np.uint64)
    end = np.repeat(begin + n, size)
    for j in range(k):
        inside = at + j < end
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(at + j, len(h) - 1)] | np.uint64(1), np.uint64(0))
    grams, own = mix(grams), np.repeat(np.arange(len(texts)), size)
    order = np.lexsort((grams, own))
    grams, own = grams[order], own[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    grams, own = grams[new], own[new]
    out = np.zeros((len(texts), n_words), np.uint64)
    if not len(grams):
        return out
    # runs of at most 2^15 shingles of a text: four counters of 16 bits in a word count four bits at once
    size = np.bincount(own, minlength=len(texts))
    edges = np.unique(np.concatenate([np.cumsum(size) - size, np.arange(0, len(own), 1 << 15)]))
    edges = edges[edges < len(own)]
    run = own[edges]
    for w in range(n_words):
        x = mix(grams + np.uint64(w * 0xD1342543DE82EF95 & (1 << 64) - 1))
        for j in range(16):
            sums = np.add.reduceat((x >> np.uint64(j)) & _LANES, edges)
            for lane in range(4):
                ones = np.zeros(len(texts), np.int64)
                np.add.at(ones, run, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
                out[:, w] |= (2 * ones > size).astype(np.uint64) << np.uint64(16 * lane + j)
    return out


def _pack(fp: np.ndarray) -> pa.Array:
    """Fingerprints as the column fp: a long, or the bytes of several words."""
    if fp.shape[1] == 1:
        return pa.array(fp[:, 0].view(np.int64))
    flat = np.ascontiguousarray(fp).astype("<u8")
    return pa.Array.from_buffers(pa.binary(fp.shape[1] * 8), len(fp), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _unpack(col: pa.Array) -> np.ndarray:
    if pa.types.is_integer(col.type):
        return col.to_numpy().view(np.uint64).reshape(-1, 1)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].copy().view("<u8").reshape(len(col), -1).astype(np.uint64)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield batch.drop_columns(["text"]).append_column("fp", _pack(wide_prints(batch.column("text"))))


# --- the index -----------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each row of words (the first is the highest) in the Gray order, as words: neighbours in that order differ in one bit."""
    x = np.asarray(x, np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    for k in range(1, x.shape[1]):
        x[:, k] ^= np.uint64(0) - (x[:, k - 1] & np.uint64(1))
    return x


def gray_order(fp: np.ndarray, group: np.ndarray) -> np.ndarray:
    return np.lexsort((*gray_rank(fp).T[::-1], group))


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(1, dtype=np.int64)


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = parent[up]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook the larger root of each pair onto the smaller, until all pairs have one root."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _levels(fp: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Bottom-up levels of (pattern, mask, first child, children, first row, group); rows are sorted by group, then Gray rank; nodes stay in a group."""
    n = len(fp)
    full = np.full(fp.shape, ~np.uint64(0))
    out = [(fp, full, np.arange(n), np.zeros(n, np.int64), np.arange(n), group)]
    while True:
        pattern, mask, _, _, member, g = out[-1]
        new = np.r_[True, g[1:] != g[:-1]]
        if new.all():
            return out
        begin = np.flatnonzero(new)
        within = np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)]))
        first = np.flatnonzero(within % FANOUT == 0)
        kids = np.diff(np.r_[first, len(g)])
        ones = np.bitwise_and.reduceat(pattern & mask, first)
        zeros = np.bitwise_and.reduceat(~pattern & mask, first)
        out.append((ones, ones | zeros, first, kids, member[first], g[first]))


def link(fp: np.ndarray, group: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A spanning forest of the links within groups: for each row of words, a row it reaches (itself for a root).

    Rows must be sorted by (group, Gray rank).
    """
    n = len(fp)
    parent = np.arange(n)
    levels = _levels(fp, group)
    # a node whose members can't differ in more than `bits` places is one component at once
    same = [None] * len(levels)
    for k, (pattern, mask, first, kids, member, _) in enumerate(levels):
        tight = _ones(~mask) <= bits
        same[k] = tight
        if k:
            idx = np.flatnonzero(tight)
            c = np.repeat(first[idx], kids[idx]) + _ramp(kids[idx])
            _union(parent, np.repeat(member[idx], kids[idx]), levels[k - 1][4][c])
    top = len(levels) - 1
    a = np.arange(len(levels[top][0]))
    todo = [(top, a, a)]
    while todo:
        k, a, b = todo.pop()
        if len(a) > (1 << 14 if k else 1 << 18):  # a pair of nodes has up to FANOUT squared pairs of children
            h = len(a) // 2
            todo += [(k, a[:h], b[:h]), (k, a[h:], b[h:])]
            continue
        pattern, mask, first, kids, member, _ = levels[k]
        if len(a) > 1 << 12:  # what is in one component already has nothing to add
            root = _find(parent, np.arange(n))
            low, high = np.minimum.reduceat(root, member), np.maximum.reduceat(root, member)
            news = (low[a] != low[b]) | (low[a] != high[a]) | (low[b] != high[b])
            a, b = a[news], b[news]
        both = mask[a] & mask[b]
        low = _ones((pattern[a] ^ pattern[b]) & both)
        keep = (low <= bits) & ~((a == b) & same[k][a])
        a, b, low, both = a[keep], b[keep], low[keep], both[keep]
        sure = (low + _ones(~both) <= bits) & same[k][a] & same[k][b]
        _union(parent, member[a[sure]], member[b[sure]])
        a, b = a[~sure], b[~sure]
        if not k or not len(a):
            continue
        joined = same[k][a] & same[k][b]  # two whole nodes that are already joined have nothing to add
        joined[joined] = _find(parent, member[a[joined]]) == _find(parent, member[b[joined]])
        a, b = a[~joined], b[~joined]
        m = kids[a] * kids[b]
        at = _ramp(m)
        ra, rb, kb = np.repeat(first[a], m), np.repeat(first[b], m), np.repeat(kids[b], m)
        ca, cb = ra + at // kb, rb + at % kb
        ok = ca <= cb
        todo.append((k - 1, ca[ok], cb[ok]))
    return _find(parent, np.arange(n))


def _ramp(lens: np.ndarray) -> np.ndarray:
    """0..len-1 for each length, end to end."""
    total = int(lens.sum())
    return np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)


# --- dealing out ---------------------------------------------------------------------------------


def bands_for(n: int, bits: int = BITS) -> int:
    """Bands to cut 64 bits into, so that a share of n evenly spread words stays near a thousand."""
    return next((b for b in range(bits + 1, 2 * bits + 1) if 64 * (b - bits) // b >= np.log2(max(n, 1)) - 10), 2 * bits)


def band_masks(b: int, bits: int = BITS) -> list[int]:
    edges = [64 * i // b for i in range(b + 1)]
    band = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(edges)]
    return [sum(band[i] for i in some) for some in itertools.combinations(range(b), b - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _link_sorted(bits: int):
    """Rows (g, fp) of whole groups, sorted by g: links (fp, root fp)."""

    def work(fp: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
        order = gray_order(fp, g)
        fp, g = fp[order], g[order]
        root = link(fp, g, bits=bits)
        hit = root != np.arange(len(fp))
        return pa.RecordBatch.from_pydict({"a": _pack(fp[hit]), "b": _pack(fp[root[hit]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, gs, held = [], [], 0
        for batch in batches:
            fps.append(_unpack(batch.column("fp")))
            gs.append(batch.column("g").to_numpy())
            held += batch.num_rows
            if held >= 100_000:
                fp, g = np.concatenate(fps), np.concatenate(gs)
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield work(fp[:cut], g[:cut])
                fps, gs, held = [fp[cut:]], [g[cut:]], len(fp) - cut
        if held:
            yield work(np.concatenate(fps), np.concatenate(gs))

    return run


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links between distinct 64-bit fingerprints (column fp), from all shares of all bands."""
    n = distinct.count()
    masks = band_masks(bands_for(n, bits), bits)
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    return _dealt(distinct, lambda df: df.select("fp", F.explode(F.array(*keys)).alias("key")), len(keys), n, bits, "long")


def _dealt(distinct: DataFrame, keyed: Callable[[DataFrame], DataFrame], keys: int, n: int, bits: int, kind: str) -> DataFrame:
    """Edges between fingerprints that share a key and differ in at most `bits` bits: the same components as all such links.

    A key that over SHARE fingerprints have is cut into blocks by hash, and about PIVOTS of its fingerprints join every block. Then
    its largest component is known, and only what lies outside it (little, where near copies made the key hot) meets all
    blocks. So such a key costs its size, and what is outside times the blocks, but not the square of its size. Such keys are
    found in a sample by hash (a key that it misses is only cut less finely).
    """
    spark = distinct.sparkSession
    rate = max(1, SHARE // 200)
    sizes = keyed(distinct.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(rate)) == 0)).groupBy("key").agg((F.count(F.lit(1)) * rate).alias("n"))
    hot = settle(spark, sizes.where(F.col("n") > SHARE // 2).select(F.col("key").alias("hot_key"), F.ceil(2 * F.col("n") / SHARE).alias("blocks")), "hot")
    # keys of SHARE / 2 and more are at most 2 * keys * n / SHARE; with fewer than 2^16 of them they are broadcast, else joined
    small = (lambda df: F.broadcast(df)) if 2 * keys * n // SHARE < 1 << 16 else (lambda df: df)
    shares = lambda rows: rows.select("fp", F.xxhash64("key", "block").alias("g")).repartition("g").sortWithinPartitions("g").mapInArrow(_link_sorted(bits), f"a {kind}, b {kind}")
    rows = keyed(distinct).join(small(hot), F.col("key") == F.col("hot_key"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("hot_key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")))
    every = lambda chosen: F.explode(F.when(chosen, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block")))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(1 << 20)) * F.col("blocks") < F.lit((PIVOTS << 21) // SHARE))
    first = settle(spark, shares(rows.select("fp", "key", every(pivot).alias("block"))).distinct(), "links")
    if hot.isEmpty():
        return first
    named = rows.where("blocks > 1").join(components(first, "hot"), F.col("fp") == F.col("node"), "left").select("fp", "key", "blocks", "block", F.coalesce("root", "fp").alias("root"))
    named = settle(spark, named, "hot")
    largest = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    largest = settle(spark, largest.select(F.col("key").alias("hot_key"), "most"), "hot")
    open_ = named.join(small(largest), F.col("key") == F.col("hot_key"))
    second = shares(open_.select("fp", "key", every(F.col("root") != F.col("most")).alias("block")))
    return first.unionByName(settle(spark, second.distinct(), "links")).distinct()


def differing(similarity: float) -> float:
    """Share of SimHash bits in which two sets of that Jaccard similarity differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def allowed(similarity: float = NEAR, n_words: int = WIDE) -> int:
    """Differing bits up to which wide fingerprints link."""
    p, n = differing(similarity), 64 * n_words
    return int(p * n + SPREAD * math.sqrt(n * p * (1 - p)))


def samples_for(n: int, similarity: float = NEAR) -> tuple[int, int]:
    """(bits of a sample, samples) for n fingerprints: bits so that about TOGETHER meet by chance on a sample, samples by MISS."""
    b = max(4, math.ceil(math.log2(max(n, 1) / TOGETHER)))
    return b, math.ceil(math.log(MISS) / math.log1p(-((1 - differing(similarity)) ** b)))


def _samples(masks: np.ndarray):
    """Rows fp: (fp, key) for each mask, with the key of the fingerprint's bits under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                fp = _unpack(some.column("fp"))
                keys = np.empty((len(fp), len(masks)), np.uint64)
                for i, m in enumerate(masks):
                    h = np.full(len(fp), i, np.uint64)
                    for k in range(fp.shape[1]):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (fp[:, k] & m[k]))
                    keys[:, i] = h
                again = pa.array(np.repeat(np.arange(len(fp)), len(masks)))
                yield pa.RecordBatch.from_pydict({"fp": some.column("fp").take(again), "key": pa.array(keys.ravel().view(np.int64))})

    return run


def wide_links(distinct: DataFrame, similarity: float = NEAR) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links between distinct wide fingerprints that agree on a sample of bits."""
    n = distinct.count()
    b, samples = samples_for(n, similarity)
    rng = np.random.default_rng(SEED)
    bits = np.zeros((samples, 64 * WIDE), np.uint8)
    for row in bits:
        row[rng.choice(64 * WIDE, min(b, 64 * WIDE), replace=False)] = 1
    masks = np.packbits(bits, axis=1).view(np.uint64)
    return _dealt(distinct, lambda df: df.mapInArrow(_samples(masks), "fp binary, key long"), samples, n, allowed(similarity), "binary")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches, by alternating large-star and small-star rounds.

    A node of many edges, such as the root of a large component, has its edges dealt out by their other end.
    """
    spark = edges.sparkSession
    e = settle(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def with_least(pairs: DataFrame) -> DataFrame:
        """pairs and the least v of each u."""
        least = settle(spark, pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), name)
        return with_group(pairs, least, "u", "n", "v")

    was = None
    while True:
        large = with_least(e.union(e.select("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        e = settle(spark, large.where("u <> v").distinct(), name)
        small = with_least(e)
        e = settle(spark, small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct(), name)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now


def _named(prints: DataFrame, least: Column, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, n, first) of each fingerprint (rows: n): the least value of `least`, nulls apart, in the component of the fingerprint."""
    spark = prints.sparkSession
    distinct = settle(spark, prints.groupBy("fp").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(linked(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = settle(spark, named, "named")
    small = settle(spark, named.groupBy("root").agg(F.min("least").alias("first"), F.sum(F.lit(1).cast("long")).alias("prints")), "small")
    byfp = with_group(named.select("fp", "n", "root"), small.select("root", "first", "prints"), "root", "prints", "fp").select("fp", "n", "first")
    return settle(spark, byfp, "byfp")


def groups(docs: DataFrame, k: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links of `bits` or fewer differing bits, itself included).

    Texts without words have fingerprint zero and are linked like any other. A null doc_id is never the least unless all are null.
    """
    prints = settle(docs.sparkSession, fingerprints(docs, k, id_col, text_col), "fingerprints")
    byfp = _named(prints, F.col("doc_id"), lambda distinct: links(distinct, bits))
    return with_group(prints, byfp, "fp", "n", "doc_id").select("doc_id", "fp", F.col("first").alias("component_id"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_rows(docs: DataFrame, similarity: float = NEAR) -> DataFrame:
    """doc_id, digest (sha256 of the text) and first (none, doc_id, digest of the row that stands for its group) of each row of docs.

    Groups are the components of links between wide fingerprints. Near copies of the given similarity of five-word shingles
    are found with a chance of about 1 - MISS a sample times that of the distance; of higher similarity, almost surely.
    """
    rows = key_text(docs).withColumn("digest", F.sha2("text", 256))
    prints = settle(docs.sparkSession, rows.mapInArrow(_wide, "doc_id long, digest string, fp binary"), "fingerprints")
    byfp = _named(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"), lambda distinct: wide_links(distinct, similarity))
    prints = prints.withColumns({"tie": F.xxhash64("doc_id", "digest"), "fp": F.hex("fp")})
    return with_group(prints, byfp.withColumn("fp", F.hex("fp")), "fp", "n", "tie").select("doc_id", "digest", "first")


def keep_one(docs: DataFrame, similarity: float = NEAR) -> DataFrame:
    """One row of each near-duplicate group: that of the least doc_id (null: last), then of the least sha256 of its text; all columns as they are.

    A row is known by id and text together, so that null or repeated ids take no other text along; of rows that repeat both one
    stays. Null and empty texts and texts without words are copies of each other. Empty input gives no rows. Columns of any name
    pass through.
    """
    spark = docs.sparkSession
    found = settle(spark, near_rows(docs, similarity), "near")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    out = found.where(~stays).select(F.col("doc_id").alias("out_id"), F.col("digest").alias("out_digest")).distinct()
    left = whole_rows(docs).join(out, F.col("id").eqNullSafe(F.col("out_id")) & (F.col("digest") == F.col("out_digest")), "left_anti")
    return one_of_each(left, found.groupBy("doc_id", "digest").count().where("count > 1").isEmpty())
