import hashlib
import random

from pyspark.sql import functions as F

from fieldloom.llm import winnow as w
from fieldloom.llm.common import bucket


def plain(data, k, win):
    if not data:
        return []
    grams = [data[i : i + k] for i in range(max(1, len(data) - k + 1))]
    h = {g: int(w.fingerprint(g, len(g), 1)[0][0]) for g in set(grams)}
    hs = [h[g] for g in grams]
    win, out = min(win, len(hs)), []
    for i in range(len(hs) - win + 1):
        low = min(hs[i : i + win])
        at = max(j for j in range(i, i + win) if hs[j] == low)
        if not out or out[-1] != (low, at):
            out.append((low, at))
    return out


def test_matches_plain_winnowing_with_ties():
    rng = random.Random(1)
    for n in (0, 1, 5, 30, 200):
        for letters in (b"ab", b"a", bytes(range(97, 123))):
            data = bytes(rng.choices(letters, k=n))
            h, p = w.fingerprint(data, 6, 9)
            assert list(zip(h.tolist(), p.tolist())) == plain(data, 6, 9)


def test_shared_passage_shares_a_hash():
    rng = random.Random(2)
    for _ in range(50):
        passage = bytes(rng.choices(range(97, 123), k=w.GRAM + w.WINDOW - 1))
        a, b = (bytes(rng.choices(range(97, 123), k=rng.randint(0, 90))) + passage + bytes(rng.choices(range(97, 123), k=40)) for _ in range(2))
        assert set(w.fingerprint(a)[0].tolist()) & set(w.fingerprint(b)[0].tolist())


def check(odd, odd_rows):
    rows = sorted(odd_rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    got = w.compare_edited(odd).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for r, nxt in zip(rows, [*rows[1:], rows[0]]):
        text, follow = r[1] or "", nxt[1] or ""
        new = w.edited(text, follow)
        a, b, c = (w.fingerprint(t.encode()) for t in (text, new, follow))
        for g in by[r[0]][:1]:
            assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest()) or len(by[r[0]]) > 1
            if len(by[r[0]]) == 1:
                assert (g.fingerprint, g.edited_fingerprint, g.near_edited, g.near_next) == (w.digest(*a), w.digest(*b), w.likeness(a[0], b[0]), w.likeness(a[0], c[0]))


def test_tables(odd, odd_rows, none, monkeypatch):
    check(odd, odd_rows)
    monkeypatch.setattr(w, "RANGE_ROWS", 20)  # many ranges: successors across their borders
    check(odd, odd_rows)
    assert w.compare_edited(none).collect() == []
    one = w.compare_edited(odd.where("doc_id = 3")).first()
    assert one.near_next == 1.0
    assert w.fingerprints(odd.where("doc_id is null or doc_id = 200")).count() == 2


def test_null_ids_have_ranges_of_their_own(spark, monkeypatch):
    """A third of the ids are null: their successors follow by hash, across many ranges."""
    monkeypatch.setattr(w, "RANGE_ROWS", 2)
    rng = random.Random(9)
    rows = [(None if k % 3 == 0 else k, "".join(rng.choices("abc ", k=rng.randint(0, 80)))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "xxhash64(text) h").collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), key[r], r[1]))
    shas = [hashlib.sha256(w.edited(a[1], b[1]).encode()).hexdigest() for a, b in zip(want, [*want[1:], want[0]])]
    got = w.compare_edited(df).collect()
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted((i or -1, len(t), h) for (i, t), h in zip(want, shas))


def test_buckets(spark):
    cuts = sorted({k * k - 9000 for k in range(1, 20_000)})
    df = spark.createDataFrame([(x,) for x in (-(10**9), -9000, -8999, -8998, 0, 1, 77, 10**6, cuts[63], cuts[64], cuts[64] + 1, cuts[-1], cuts[-1] + 1)], "x long")
    out = df.select("x", bucket(F.col("x"), cuts).alias("b"))
    assert [(r.x, r.b) for r in out.collect()] == [(r.x, sum(c < r.x for c in cuts)) for r in df.collect()]
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()[:100_000]  # constants are read once
