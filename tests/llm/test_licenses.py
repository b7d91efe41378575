import math
import re

from fieldloom.llm import licenses as x

TEXTS = [
    None,
    "",
    "code\nReleased under the MIT License.\nmore",
    "Licensed under the Apache License,\nVersion 2.0 and again apache license version 2",
    "under the mit license under the mit license",
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "this work is licensed under the gnu public license",
    "para one\n\nRedistribution and use in source and binary forms, with or\nwithout modification, are permitted provided\nthat the following conditions are met\n\nend",
    "nothing of the kind is under the sun " * 3000,
    "UNDER THE MIT LICENSE\x0bé under the mit licenseé",
    " \n \n",
]


def plain(text):
    text = text or ""
    words = x.split(text)
    places = sorted((i, label) for p, label in x.PHRASES.items() for q in [p.split()] for i in range(len(words)) if words[i : i + len(q)] == q)
    found = set()
    for block in [*text.split("\n"), *re.split(r"\n[ \t\r\x0b\x0c]*(?=\n)", text)]:
        b = set(x.split(block))
        for label, t in x.TEMPLATES:
            s = set(x.split(t))
            need = math.ceil(x.THRESHOLD * len(s) - 1e-9)
            if len(b & s) >= need and len(b) <= x.LOOSE * len(s):
                found.add((label, len(b & s) / len(s)))
    join = lambda v: ",".join(sorted(set(v)))
    score = 1.0 if places else max((c for _, c in found), default=0.0)
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, join(p for _, p in places), join([p for _, p in places] + [f for f, _ in found]), score)


def test_matches_brute_force(spark, odd, odd_rows):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:8] for r in x.scan(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == plain(t), t and t[:80]
    assert got[8][5] == "bsd" and got[6][5] == "gpl" and got[4][1:4] == (2, 0, 4)
    got = x.scan(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r[0]: plain(r[1]) for r in odd_rows}
    assert all(tuple(r)[1:8] == by[r.doc_id] for r in got)


def test_random_sets_find_every_pair(spark):
    import random

    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    templates = tuple((f"t{i}", " ".join(rng.sample(vocab, rng.randint(3, 12)))) for i in range(12))
    texts = ["\n".join(" ".join(rng.choices(vocab, k=rng.randint(1, 25))) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.5, 0.8):
        for r in x.scan(df, templates, {}, threshold).collect():
            want = set()
            for block in [*texts[r.doc_id].split("\n"), texts[r.doc_id]]:
                b = set(x.split(block))
                want |= {label for label, t in templates if len(b & set(t.split())) >= math.ceil(threshold * len(t.split()) - 1e-9) and len(b) <= x.LOOSE * len(t.split())}
            assert r.labels == ",".join(sorted(want))


def test_notices_in_long_blocks_are_found(spark):
    filler = [f"word{i}" for i in range(600)]
    gpl, mpl = (t for label, t in x.TEMPLATES if label in ("gpl", "mpl-2") and len(t) < 100)
    bsd = next(t for label, t in x.TEMPLATES if label == "bsd").split()
    line = " ".join([*filler[:300], gpl, *filler[300:]])
    wrapped = "\n".join([*filler[:300], " ".join(bsd[:9]), " ".join(bsd[9:]), *filler[300:]])
    df = spark.createDataFrame(list(enumerate([line, mpl + " " + line, wrapped, " ".join(filler)])), "doc_id long, text string")
    got = {r.doc_id: r for r in x.scan(df, loose=x.COMPACT).collect()}
    assert {i: (r.labels, r.score) for i, r in got.items()} == {0: ("gpl", 1.0), 1: ("gpl,mpl-2", 1.0), 2: ("bsd", 1.0), 3: ("", 0.0)}
    assert [(m.first_word, m.last_word) for m in got[0].matches] == [(300, 311)]
    assert {r.doc_id for r in x.scan(df).where("labels <> ''").collect()} == {0, 1, 2}


def test_runs_match_brute_force(spark):
    import random

    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    templates = tuple((f"t{i}", " ".join(rng.sample(vocab, rng.randint(3, 8)))) for i in range(10))
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 80))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in x.scan(df, templates, {}, loose=2).collect():
        words, want = texts[r.doc_id].split(), set()
        for label, t in templates:
            s, n = set(t.split()), 2 * len(t.split())
            runs = [words] if len(set(words)) <= n else [words[i : i + n] for i in range(len(words))]
            if max(len(s & set(w)) for w in runs) >= math.ceil(x.THRESHOLD * len(s) - 1e-9):
                want.add(label)
        assert r.labels == ",".join(sorted(want))


def test_empty(none):
    assert x.scan(none).collect() == []
