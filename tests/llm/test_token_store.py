import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import token_store as s

PATH = P.path("word_bpe_49k.json")


def ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, s.END]


def test_encoder_equals_the_library():
    rng = random.Random(1)
    alphabet = [chr(c) for c in [*range(127)] * 2 + [0x85, 0xA0, 0x3000, 0xE9, 0x4E2D, 0x1F600, 0x301, 0x3A3, 0x130, 0x1C]]
    texts = ["", "a<|endoftext|>b <|startoftext|>", *("".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300))]
    same(texts)


def same(texts):
    enc, tk = s.WordEncoder(PATH), Tokenizer.from_file(PATH)
    want = [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        got, off = enc(pa.array(texts, pa.string()))
        wrong = [t for t, w, a, b in zip(texts, want, off[:-1], off[1:]) if got[a:b].tolist() != [*w, s.END]]
        assert not wrong, wrong[:5]


def test_every_letter_and_its_lower_case():
    """Each character of U+0021 to U+024F and what it becomes in lower case, alone, between and beside letters, digits and signs."""
    rng = random.Random(2)
    chars = sorted({x for c in map(chr, range(0x21, 0x250)) for x in (c, *c.lower(), *c.upper())})
    texts = [t for c in chars for t in (c, f"a{c}b", f"A{c}{c}. {c}'s", f"1{c}'{c}", f"'{c}l'll{c}")]
    for _ in range(10_000):
        few = rng.choices(chars, k=6) + list("abeilmstdrv'' ..09<|>")
        texts.append("".join(rng.choices(few, k=rng.randint(1, 30))))
    same(texts + ["Ə Ɛ Ɔ Ɓ Ɗ Ɣ Ɩ Ʊ aƐb AZƏRBAYCAN Ǆ ǅ İstanbul ß ẞ it's 'tis we'LL rock'n'roll l'été x" + "y" * 5000])


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(s, "CACHE", 50)
    monkeypatch.setattr(s, "PIECES", 50)
    rng = random.Random(3)
    enc, tk = s.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for n in range(40):
        texts = [" ".join("".join(rng.choices("abc\u00e9.", k=rng.randint(1, 3 + 60 * (n % 7 == 0)))) for _ in range(30)) for _ in range(3)]
        got, off = enc(pa.array(texts, pa.string()))
        assert [got[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [[*tk.encode(t, add_special_tokens=False).ids, s.END] for t in texts]


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50_000, 20_000).astype(np.uint32)
    y = np.concatenate([x[:5000], rng.integers(0, 50_000, 7).astype(np.uint32), x[5000:]])
    chunks = lambda v: {v[a:b].tobytes() for e in [s.cuts(v, np.array([0, len(v)]))] for a, b in zip(e, e[1:])}
    assert len(chunks(x) & chunks(y)) >= len(chunks(x)) - 3
    same = np.zeros(10_000, np.uint32)
    e = s.cuts(same, np.array([0, 10_000]))
    assert np.diff(e).max() <= s.LARGEST and e[-1] == 10_000
    both = s.cuts(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
    assert set(both) == set(s.cuts(x, np.array([0, len(x)]))) | {len(x) + i for i in s.cuts(y, np.array([0, len(y)]))}


@pytest.mark.parametrize("rows", [10_000, 25])
def test_round_trip(spark, odd, odd_rows, monkeypatch, rows):
    monkeypatch.setattr(s, "PART_ROWS", rows)
    path = s.write(odd, PATH)
    got = sorted(s.read(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(odd_rows)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    want = {r[0]: ids(r[1]) for r in odd_rows}
    at = 0
    for r in got:
        assert (r.start, r.ids) == (at, want[r.doc_id])
        at += r.n_tokens
    chunks = s.read  # each distinct chunk is stored once
    t = spark.read.parquet(f"{path}/tables")
    assert t.where("kind = 'chunk'").groupBy("digest").count().where("count > 1").count() == 0 and chunks
    crc = {r.doc_id: r.ids_crc32 for r in s.read(spark, path, with_ids=False).collect()}
    assert crc[3] == zlib.crc32(np.array(want[3], "<u4").tobytes())


def test_damage_is_found(spark, odd):
    path = s.write(odd.where("doc_id < 50"), PATH)
    fs, where = pyarrow.fs.FileSystem.from_uri(f"{path}/packs/w2")
    name = fs.get_file_info(pyarrow.fs.FileSelector(where))[0].path
    data = fs.open_input_stream(name).read()
    import zstandard

    raw = bytearray(zstandard.ZstdDecompressor().decompress(data))
    raw[100] ^= 1
    new = zstandard.ZstdCompressor(level=1).compress(bytes(raw))
    with fs.open_output_stream(name) as f:
        f.write(new[: len(data)].ljust(len(data), b"\0"))
    with pytest.raises(Exception, match="does not match|decompress|zstd"):
        s.read(spark, path).collect()


def test_empty(none):
    assert s.round_trip(none, PATH).collect() == []
