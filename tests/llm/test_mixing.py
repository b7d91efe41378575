import math
import re
from collections import defaultdict

import pytest

from fieldloom.llm import mixing as m


def test_exponent_meets_entropy_or_limit():
    tokens = {"big": 900_000, "mid": 90_000, "small": 10_000}
    p = m.plan(tokens, 1_000_000, 0.6, 1e9)
    assert m.entropy(p.weights) == pytest.approx(0.6 * math.log(3), abs=1e-9) and 0 < p.exponent < 1
    p = m.plan(tokens, 1_000_000, 0.99, 2.0)
    assert max(p.weights[s] * 1_000_000 / t for s, t in tokens.items()) == pytest.approx(2.0, abs=1e-6)
    assert m.plan({"a": 5, "b": 5}, 10).exponent == 1.0 and m.plan({"a": 0}, 0).weights == {"a": 0.0} and m.plan({}, 0).weights == {}


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("share", [0.5, 0.999])
def test_draws_fill_quotas_by_whole_passes(odd, odd_rows, share):
    rows = m.draw(odd, entropy_share=share).collect()
    tokens, docs = defaultdict(int), defaultdict(list)
    for r in odd_rows:
        tokens[r[3]] += words(r[1])
        docs[r[3]].append(r[0])
    p = m.plan(dict(tokens), sum(tokens.values()), share)
    got = defaultdict(lambda: defaultdict(list))
    for r in rows:
        assert r.weight == pytest.approx(p.weights[r.source])
        got[r.source][r.epoch].append(r)
    for s, t in tokens.items():
        whole = p.quota[s] // t if t else 0
        used = sum(r.n_tokens for e in got[s].values() for r in e)
        assert used <= p.quota[s]
        for e in range(whole):
            assert sorted(str(r.doc_id) for r in got[s][e]) == sorted(map(str, docs[s]))
        for e, x in got[s].items():  # starts follow each other without gaps or overlap
            x.sort(key=lambda r: (r.start, r.n_tokens))
            at = e * t
            for r in x:
                assert r.start >= at
                at = r.start + r.n_tokens
    assert rows == m.draw(odd, entropy_share=share).collect() or sorted(map(str, rows)) == sorted(map(str, m.draw(odd, entropy_share=share).collect()))


def test_stage(odd, none):
    assert m.mixed(odd).columns == odd.columns
    times = m._draws(odd).select("doc_id", "h", "epoch").distinct().count()
    assert times <= m.mixed(odd).count() <= times + 20
    assert m.draw(none).collect() == [] and m.mixed(none).collect() == []


def test_draws_match_brute_force(spark):
    """Every draw against one list a source, shuffled by the same keys and cut at the quota."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["a", "a", "a", "b", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens, docs = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        tokens[s] += words(t)
        docs[s] += 1
    p = m.plan(dict(tokens), sum(tokens.values()))
    passes = 1 + max(p.quota[s] // t for s, t in tokens.items())
    keys = df.select("doc_id", "source", F.xxhash64("text").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes).cast("long"))).alias("epoch"))
    key = {(r.epoch, r.doc_id): r.k for r in keys.select("epoch", "doc_id", F.xxhash64(F.lit(m.SEED), "epoch", "source", "doc_id", "h").alias("k")).collect()}
    want = set()
    for s in tokens:
        blocks = -(-docs[s] // m.BLOCK_ROWS)
        for e in range(p.quota[s] // tokens[s] + 1):
            at = e * tokens[s]
            for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (key[e, r[0]] % blocks, key[e, r[0]], r[0])):
                if at + words(t) <= p.quota[s]:
                    want.add((i, e, at))
                at += words(t)
    assert {(r.doc_id, r.epoch, r.start) for r in m.draw(df).collect()} == want
