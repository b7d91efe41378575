import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from fieldloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library_on_any_text(library):
    rng = random.Random(1)
    alphabet = [chr(c) for c in [*range(127)] * 2 + [0x85, 0xA0, 0x2003, 0x200B, 0xE9, 0x4E2D, 0x1F600, 0x301, 0x660, 0x2160, 0x10FFFF]]
    texts = ["", "a", "  x\n\n y", "ab" * 3000, *("".join(rng.choices(alphabet, k=rng.randint(0, 90))) for _ in range(800)), *("".join(rng.choices("etaoin", k=rng.randint(40, 300))) for _ in range(60))]
    enc = bpe.Encoder(PATH, P.PATTERN)
    for _ in range(2):  # cold, then from the cache
        ids, off = enc(texts)
        for t, a, b in zip(texts, off[:-1], off[1:]):
            assert ids[a:b].tolist() == library.encode_ordinary(t)
            assert bpe.decode(ids[a:b], enc.v) == t.encode()


def test_both_trees_agree():
    rng = random.Random(2)
    v = bpe.load(PATH)
    pieces = [bytes(rng.choices(b"the ing and", k=rng.randint(2, 64))) for _ in range(300)]
    ids, lens = bpe.encode_many(pieces, v)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [bpe.encode_long(p, v) for p in pieces]


def test_tables(odd, odd_rows, none, library):
    got = {r.doc_id: r for r in bpe.digests(odd, PATH, P.PATTERN).collect()}
    full = {r.doc_id: r for r in bpe.encode_table(odd, PATH, P.PATTERN).collect()}
    for r in odd_rows:
        ids = library.encode_ordinary(r[1] or "")
        assert full[r[0]].ids == ids and full[r[0]].decoded == (r[1] or "").encode() and got[r[0]].n_tokens == len(ids)
        assert got[r[0]].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()
    assert bpe.digests(none, PATH, P.PATTERN).collect() == []
