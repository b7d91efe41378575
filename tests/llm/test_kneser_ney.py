import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fieldloom.llm import kneser_ney as k


def split(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def plain(train, texts, order=3):
    """The model by dictionaries: each triple's count, pairs by their different words before (at the start: counts), words likewise."""
    uni, raw, tri, bi = Counter(), Counter(), Counter(), Counter()
    for t in train:
        w = split(t)
        uni.update(w)
        raw.update(zip(["<s>", *w], w))
        if order > 2:
            tri.update(zip(["<s>", *w], w, w[1:]))
    n, v = sum(uni.values()), len(uni)
    if order > 2:
        bi.update((b, c) for _, b, c in tri)
        bi.update({p: c for p, c in raw.items() if p[0] == "<s>"})
    else:
        bi = raw
    kinds = Counter(b for _, b in bi)
    after, third = defaultdict(Counter), defaultdict(Counter)
    for (a, b), c in bi.items():
        after[a][b] = c
    for (a, b, x), c in tri.items():
        third[a, b][x] = c
    dt, dp, dw = (k.discounts([sum(c == j for c in x.values()) for j in (1, 2, 3, 4)]) for x in (tri, bi, kinds))
    cut = lambda d, c: 0 if not c else d[min(c, 3) - 1]
    gamma = sum(cut(dw, c) for c in kinds.values()) / len(bi) if bi else 1.0
    p1 = lambda w: max(kinds[w] - cut(dw, kinds[w]), 0) / max(len(bi), 1) + gamma / (v + 1)

    def p2(a, b):
        x = after.get(a)
        if not x:
            return p1(b)
        t = sum(x.values())
        return (x[b] - cut(dp, x[b])) / t + sum(cut(dp, c) for c in x.values()) / t * p1(b)

    def p3(a, b, c):
        x = third.get((a, b))
        if not x:
            return p2(b, c)
        t = sum(x.values())
        kept = {w: n for w, n in x.items() if n > 1}  # single triples pass their whole mass on
        rest = sum(cut(dt, n) for n in kept.values()) + sum(n for n in x.values() if n == 1)
        return (kept.get(c, 0) - cut(dt, kept.get(c, 0))) / t + rest / t * p2(b, c)

    out = []
    for t in texts:
        w = split(t)
        score = math.log10(p2("<s>", w[0])) + sum(math.log10(p3(a, b, c) if order > 2 else p2(b, c)) for a, b, c in zip(["<s>", *w], w, w[1:]))
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), score))
    return out, p1, p2, p3, uni


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("order", [2, 3])
def test_matches_plain_counts(odd, odd_rows, order):
    train = [r[1] for r in odd_rows if not held(r[0])]
    want, p1, p2, p3, uni = plain(train, [r[1] for r in odd_rows], order)
    assert sum(map(p1, uni)) + p1("never seen") == pytest.approx(1)
    assert sum(p2("<s>", w) for w in uni) + p2("<s>", "never seen") == pytest.approx(1)
    a, b = split(train[3])[:2]
    assert sum(p3(a, b, w) for w in uni) + p3(a, b, "never seen") == pytest.approx(1)
    by = {r[0]: x for r, x in zip(odd_rows, want)}
    got = k.score(odd, k.train(odd.where(~k.held_out(odd)), order=order)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        w = by[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert (r.base_score, r.score) == (pytest.approx(w[3]), pytest.approx(w[4]))
    assert {r.doc_id: r.held_out for r in k.score_all(odd).collect()} == {r[0]: held(r[0]) for r in odd_rows}


def test_texts_seen_twice_score_higher(spark):
    """A text that stands twice in training is told from one that stands once, and that from a new one."""
    import random

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocab, k=80)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts[:100] + texts[:20])), "doc_id long, text string")
    got = {r.doc_id: r.perplexity for r in k.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k.train(df)).collect()}
    assert max(got[i] for i in range(20)) < min(got[i] for i in range(20, 100)) and max(got[i] for i in range(20, 100)) < min(got[i] for i in range(100, 120))


def test_held_tasks_agree(odd, monkeypatch):
    want = sorted(map(str, k.score_all(odd).collect()))
    monkeypatch.setattr(k, "HOLD", 50)
    assert sorted(map(str, k.score_all(odd).collect())) == want


def test_empty(spark, odd, none):
    assert k.score_all(none).collect() == []
    got = k.score(odd.where("doc_id = 3"), k.train(none)).first()
    assert got.n_known == 0 and got.train_tokens == 0 and math.isfinite(got.score)


def test_triples_seen_once_count(odd, odd_rows):
    """The query's model has every triple, those seen once too, at its own discounted probability."""
    train = [split(r[1]) for r in odd_rows if not held(r[0])]
    _, p1, p2, _, uni = plain([r[1] for r in odd_rows if not held(r[0])], [])
    third = defaultdict(Counter)
    for w in train:
        for a, b, c in zip(["<s>", *w], w, w[1:]):
            third[a, b][c] += 1
    d = k.discounts([sum(n == j for x in third.values() for n in x.values()) for j in (1, 2, 3, 4)])
    cut = lambda n: 0 if not n else d[min(n, 3) - 1]

    def p3(a, b, c):
        x = third.get((a, b))
        if not x:
            return p2(b, c)
        t = sum(x.values())
        return (x[c] - cut(x[c])) / t + sum(map(cut, x.values())) / t * p2(b, c)

    for a, b in [next(p for p, x in third.items() if set(x.values()) == {1}), max(third, key=lambda p: len(third[p]))]:
        assert sum(p3(a, b, w) for w in uni) + p3(a, b, "never seen") == pytest.approx(1)
    want = {}
    for r in odd_rows:
        w = split(r[1])
        want[r[0]] = math.log10(p2("<s>", w[0])) + sum(math.log10(p3(a, b, c)) for a, b, c in zip(["<s>", *w], w, w[1:]))
    got = k.score_all(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id])


def test_counts_of_any_size(tmp_path):
    import numpy as np

    x = np.random.default_rng(5).permutation(np.r_[np.arange(1000), 254, 255, 256, 1 << 32, 1 << 40]).astype(np.uint64)
    for y in (x, x % 255, x[:1], x[:0]):
        k.put_counts(f"file://{tmp_path}", "c0", y)
        at = np.arange(len(y))[::-1]
        assert (k._counts(k.Arrays(f"file://{tmp_path}")["c0"], at) == y[at].astype(np.int64)).all()


def test_words_are_hashed_in_pieces(monkeypatch):
    """Hashing holds a piece of the text at a time, in many rows or in one, and the pieces change no hash."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(5)
    row = " ".join(rng.choice(["one", "TWO", "drei", "\u00fcber", "x" * 90]) for _ in range(2000))
    for texts in (pa.array([row] * 100), pa.array([" ".join([row] * 100)])):
        k.tokens(texts)  # tables of powers
        tracemalloc.start()
        want, off = k.tokens(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 10 * texts.nbytes
        for size in (1, 100, 1 << 30):
            monkeypatch.setattr(k, "PIECE", size)
            some = texts.slice(0, 2) if len(texts) > 1 else pa.array([row])
            got = k.tokens(some)[0]
            assert (got[:-1] == want[: len(got) - 1]).all()
        monkeypatch.undo()


def test_narrow_counts_add_up():
    """Counts come in runs as narrow as they were packed; their sums do not wrap."""
    import numpy as np
    import pyarrow as pa

    keys, firsts = np.arange(5, dtype=np.uint64), np.full(5, 7, np.uint32)
    runs = [[0, k._pack(keys, firsts, np.full(5, n, np.uint64))] for n in (200, 255, 65535, (1 << 32) - 1, 1)]
    batch = pa.RecordBatch.from_pydict({"shard": [s for s, _ in runs], "run": pa.array([r for _, r in runs], pa.list_(pa.binary()))})
    [(_, (got, first, n))] = k._merged(iter([batch]), k._triple_sums)
    assert got.tolist() == keys.tolist() and first.tolist() == firsts.tolist() and set(n.tolist()) == {200 + 255 + 65535 + (1 << 32)}


def test_training_settles_one_table(odd, monkeypatch):
    """What comes back as a row a shard is collected: a table written for it has a file and processes of their own for each task."""
    names = []
    real = k.settle
    monkeypatch.setattr(k, "settle", lambda spark, df, name: names.append(name) or real(spark, df, name))
    k.train(odd, prune=False)
    assert names == ["pairs"]
