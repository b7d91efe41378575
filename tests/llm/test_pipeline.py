import hashlib
import random

import corpus_pipeline as c
import pytest

from fieldloom.llm import exact_dedup, langid, mixing, simhash
from fieldloom.llm.common import settle

NAMES = ["_d", "_i", "_n", "_t", "_k", "_h", "_id", "_dg", "_times", "_letters", "row", "id", "digest", "key", "n", "first", "h", "times", "keep_id", "fp", "kept", "letters"]


def shingles(text):
    words = (text or "").translate({k: k + 32 for k in range(65, 91)}).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def run_all(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    out = [spark.read.parquet(f"{path}/documents.parquet")]
    for name, stage in c.STAGES:
        out.append(settle(spark, stage(spark, out[-1], path), name))
    return out


def test_stages_chain(spark, odd, odd_rows, tmp_path):
    """Every row of the odd table: null and repeated ids, nulls in all columns, copies, long texts."""
    tables = run_all(spark, odd, str(tmp_path))
    assert all(t.columns == odd.columns for t in tables[:-1])
    letters = [r for r in odd_rows if any(map(str.isalpha, r[1] or ""))]
    rows = lambda t: [(r.doc_id, r.text) for r in t.collect()]
    kept = rows(tables[1])
    assert set(kept) <= {(r[0], r[1]) for r in letters} and len(kept) >= len(letters) - 3  # one word repeated, letters without end
    best = {}
    for i, t in kept:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    exact = rows(tables[2])
    assert sorted(exact, key=str) == sorted(((None if i < 0 else i, t) for t, i in best.items()), key=str)
    near = rows(tables[3])
    gone = set(exact) - set(near)
    # what went is a near copy of something, and of a group of near copies one stays
    for _, t in gone:
        assert max(jaccard(shingles(t), shingles(u)) for _, u in exact if u != t) > 0.5
    left = [shingles(t) for _, t in near]
    assert all(jaccard(a, b) < 0.9 for k, a in enumerate(left) for b in left[:k])
    drawn = rows(tables[4])
    assert set(drawn) <= set(near)
    texts = {i: t for i, t in drawn}
    got = tables[5].collect()
    assert len(got) == len(drawn)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 in {hashlib.sha256(t.encode()).hexdigest() for i, t in drawn if i == r.doc_id} and r.doc_id in texts
    assert sorted(map(str, c.run(spark, str(tmp_path)).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("stage", [langid.keep_identified, exact_dedup.drop_copies, simhash.keep_one, mixing.mixed])
def test_columns_of_any_name_pass_through(spark, odd, odd_rows, stage):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(*r[:5], *(f"{k}-{j}" for j in range(len(NAMES)))) for k, r in enumerate(odd_rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    got = stage(docs)
    assert got.columns == names + NAMES
    have = {tuple(r) for r in rows}
    out = [tuple(r) for r in got.collect()]
    assert out and set(out) <= have
    plain = stage(docs.select(*names)).collect()
    assert sorted(map(str, (r[:2] for r in out))) == sorted(map(str, (tuple(r)[:2] for r in plain)))


@pytest.mark.parametrize("name", [n for n, _ in c.STAGES])
def test_empty_table(spark, none, name, tmp_path):
    assert dict(c.STAGES)[name](spark, none, str(tmp_path)).collect() == []


def test_near_copies_go_and_others_stay(spark):
    """Against brute force over exact Jaccard similarities of five-word shingles: pairs of 0.8 and more are found, unlike texts never joined."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(120):
        words = rng.choices(vocab, k=rng.choice([60, 150, 400, 1500]))
        texts.append(words)
        for _ in range(3):
            new = list(words)
            for _ in range(max(1, int(len(words) * rng.choice([0.005, 0.01, 0.02])))):
                new[rng.randrange(len(new))] = rng.choice(vocab)
            texts.append(new)
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.doc_id: r["first"].doc_id for r in simhash.near_rows(df).collect()}
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if i // 4 == j // 4 and jaccard(sets[i], sets[j]) >= 0.8]
    assert len(pairs) > 300 and sum(group[i] == group[j] for i, j in pairs) / len(pairs) > 0.95
    assert all(i // 4 == g // 4 for i, g in group.items())


def test_hot_group_of_near_copies(spark, monkeypatch):
    """A third of the rows are near copies of one text, no two alike; shares of hot samples are cut into blocks."""
    monkeypatch.setattr(simhash, "SHARE", 400)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(2000)]
    base = rng.choices(vocab, k=300)
    texts = [" ".join(rng.choices(vocab, k=100)) for _ in range(1200)]
    for k in range(600):
        new = list(base)
        new[rng.randrange(300)] = f"own{k}"
        texts.append(" ".join(new))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert got == list(range(1201))
