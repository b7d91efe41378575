import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import simhash as s


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(items):
    parent = {i: i for i in items}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ks = sorted(items)
    for i in ks:
        for j in ks:
            if i < j and bin(items[i] ^ items[j]).count("1") <= s.BITS:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ks}


def test_fingerprint():
    rng = random.Random(3)
    for n in range(12):
        t = " ".join("".join(rng.choices("aBcDé", k=3)) for _ in range(n)) + "\x0b\x1c\xa0x" * (n % 2)
        assert s.fingerprint(t) == plain_print(t)


@pytest.mark.parametrize("kind", ["random", "near", "dense", "groups"])
def test_index_finds_every_link(kind):
    rng = random.Random(kind)
    near = lambda c, k: c ^ sum(1 << b for b in rng.sample(range(64), k))
    if kind == "random":
        fp = [rng.getrandbits(64) for _ in range(300)]
    elif kind == "dense":
        c = rng.getrandbits(64)
        fp = [near(c, rng.randint(0, 3)) for _ in range(400)]
    else:
        cs = [rng.getrandbits(64) for _ in range(30)]
        fp = [near(rng.choice(cs), rng.randint(0, 7)) for _ in range(400)]
    fp = np.array(sorted(set(fp)), np.uint64)
    g = np.array([rng.randrange(3) if kind == "groups" else 0 for _ in fp])
    order = s.gray_order(fp[:, None], g)
    fp, g = fp[order], g[order]
    root = s.link(fp[:, None], g)
    for k in set(g.tolist()):
        rows = np.flatnonzero(g == k)
        want = plain_components({int(i): int(fp[i]) for i in rows})
        got = {int(i): int(root[i]) for i in rows}
        pairs = lambda m: {frozenset(i for i in m if m[i] == r) for r in m.values()}
        assert pairs(got) == pairs(want)


def test_bands_lose_no_link():
    rng = random.Random(4)
    for b in range(5, 9):
        masks = s.band_masks(b)
        for _ in range(200):
            d = sum(1 << i for i in rng.sample(range(64), 4))
            assert any(d & m == 0 for m in masks)


@pytest.mark.parametrize("pivots", [0, 2, 500])
def test_hot_bands_are_split(odd, odd_rows, monkeypatch, pivots):
    monkeypatch.setattr(s, "SHARE", 10)
    monkeypatch.setattr(s, "PIVOTS", pivots)
    check(odd, odd_rows)


@pytest.mark.parametrize("pivots", [0, 3])
def test_hot_keys_lose_no_link(spark, monkeypatch, pivots):
    """One key for all: dense groups, chains and loners in many blocks, against brute force."""
    monkeypatch.setattr(s, "SHARE", 40)
    monkeypatch.setattr(s, "PIVOTS", pivots)
    rng = random.Random(11)
    near = lambda c, k: c ^ sum(1 << b for b in rng.sample(range(64), k))
    one, two = rng.getrandbits(64), rng.getrandbits(64)
    fp = [near(one, rng.randint(0, 3)) for _ in range(300)] + [near(two, rng.randint(0, 4)) for _ in range(60)] + [rng.getrandbits(64) for _ in range(40)]
    for _ in range(5):  # chains of near links
        c = rng.getrandbits(64)
        for _ in range(12):
            fp.append(c)
            c = near(c, 4)
    fp = sorted(set(fp))
    df = spark.createDataFrame([(s._signed(x),) for x in fp], "fp long")
    edges = s._dealt(df, lambda d: d.select("fp", F.lit(1).cast("long").alias("key")), 1, len(fp), s.BITS, "long")
    got = {r.node: r.root for r in s.components(edges).collect()}
    want = plain_components(dict(enumerate(fp)))
    groups = lambda of: {frozenset(i for i in range(len(fp)) if of(i) == r) for r in map(of, range(len(fp)))}
    assert groups(lambda i: got.get(s._signed(fp[i]), s._signed(fp[i]))) == groups(want.__getitem__)


def test_tables(odd, odd_rows, none):
    check(odd, odd_rows)
    assert s.near_groups(none).collect() == [] and s.keep_one(none).collect() == []


def check(odd, odd_rows):
    prints = {r[0]: plain_print(r[1]) for r in odd_rows if r[0] is not None}
    want = plain_components(prints)
    got = s.near_groups(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


def test_wide_print():
    rng = random.Random(5)
    texts = ["", " \t", "One", "one two  THREE four", *(" ".join(rng.choices(["a", "bb", "Cc", "é"], k=n)) for n in (5, 6, 9, 40, 70_000))]
    got = s.wide_prints(pa.array(texts))
    for t, fp in zip(texts, got):  # the same words give the same print, whatever stands between them
        assert (s.wide_prints(pa.array(["x y", "  " + "\n".join(t.upper().replace("É", "é").split()) + " "]))[1] == fp).all()
    assert not got[:2].any() and all(g.any() for g in got[2:])
    h = s.mix(np.arange(40, dtype=np.uint64))  # counting four bits in a word loses none
    assert [int(b) for b in np.binary_repr(int(got[2][0]), 64)] and len(h) == 40


def test_wide_words_against_brute_force():
    rng = np.random.default_rng(8)
    cs = rng.integers(0, 1 << 63, (20, s.WIDE), dtype=np.uint64) * np.uint64(2)
    fp = cs[rng.integers(0, 20, 500)]
    for row in fp:
        for b in rng.choice(64 * s.WIDE, rng.integers(0, 60), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    fp = np.unique(fp, axis=0)
    g = rng.integers(0, 3, len(fp))
    order = s.gray_order(fp, g)
    fp, g = fp[order], g[order]
    root = s.link(fp, g, bits=s.allowed())
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) > s.allowed()
    near = ~far & (g[:, None] == g[None])
    want = np.arange(len(fp))
    while True:
        new = np.where(near, want[None], len(fp)).min(1)
        if (new == want).all():
            break
        want = new
    assert (root == want).all() and len(set(want.tolist())) < len(fp)


def test_gray_neighbours_differ_in_one_bit():
    x = np.arange(1 << 12, dtype=np.uint64)
    two = np.stack([x >> np.uint64(6) << np.uint64(58), x & np.uint64(63)], 1)  # high bits in one word, low ones in the next
    two = two[s.gray_order(two, np.zeros(len(x), int))]
    step = two[1:] ^ two[:-1]
    assert len(np.unique(two, axis=0)) == len(x) and np.bitwise_count(step).sum(1).max() <= 58 + 1


def test_stage_keeps_every_text_whatever_its_id(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (7, d), (7, e), (3, e.upper()), (9, f), (9, a), (7, d), (None, f), (5, f.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in s.keep_one(df).collect()), key=str)
    assert got == sorted([(9, a), (None, b), (None, c), (7, d), (3, e.upper()), (5, f.upper())], key=str)
