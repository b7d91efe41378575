"""Content-addressed store of token ids.

Ids are cut into chunks where a rolling hash of the last WINDOW ids hits a pattern, so equal passages give equal chunks
wherever they stand. Each distinct chunk is stored once, in pack files; a recipe per document lists its chunks; each pack has
a manifest with the Merkle root of its documents' digests, and the store has a root over the packs' roots.

Layout below the store's path:
  tables/kind=doc       recipes: part, seq, doc_id, start (ids of the part's documents before it), n_tokens, root, digests
  tables/kind=chunk     index: digest, part, block (offset in the pack), size, at, n_tokens, uses (in all documents): each distinct chunk once
  tables/kind=manifest  part, n_tokens, seq (documents), root
  packs/<part>          zstd blocks of the ids of the chunks that first occur in that part, little-endian
Parts are ranges of doc_id in ascending order, null ids first, equal ids by the text's hash. A pack is written beside its place
and then moved, with contents that depend on the input alone, so tasks can be run again at any time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import unicodedata
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, key_text, settle, shared_path, slices, with_group
from .texthash import gather, mix, words

#: Ids in the rolling window, mean and largest ids a chunk, ids a document ends with.
WINDOW, MEAN, LARGEST, END = 16, 512, 4096, 2
#: Words and pieces of words kept by a worker's encoder; longest word kept; bytes of ids a pack's block.
CACHE, PIECES, SHORT, BLOCK = 800_000, 800_000, 48, 1 << 17
#: Bytes of text encoded at a time.
STEP = 8 << 20
#: Documents aimed at for a part (range of doc_id), and parts whose ids are summed together.
PART_ROWS, PART_BLOCK = 10_000, 1000


#: Letters beyond ASCII that normalising leaves alone and whose lower case is such a letter too.
_LETTERS = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and unicodedata.normalize("NFC", c) == c and "\u00c0" <= c.lower() <= "\u024f" and len(c.lower()) == 1)
#: Words of printable ASCII and these letters are cut into pieces here; others go whole to the library.
_PAIRS = np.zeros((256, 256), bool)
_PAIRS[tuple(np.array([list(c.encode()) for c in _LETTERS]).T)] = True
#: Kinds of bytes in such words: letters, digits, others; a piece is a run of letters or of others, or a digit.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[48:58] = 1


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: its own if it is printable, else the next free ones from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in keep} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in keep)}


_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_OF_BYTE = _byte_letters() | {10: "\n"}


class _Known:
    """Strings and the ids of each, end to end."""

    def __init__(self):
        self.keys, self.ids, self.offsets = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def numbers(self, keys: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Numbers of different strings, and those not met before, which get the next numbers and must then be added."""
        at = pc.index_in(keys, value_set=self.keys)
        new = np.asarray(at.is_null())
        out = np.asarray(at.fill_null(0)).astype(np.int64)
        out[new] = len(self.keys) + np.arange(new.sum())
        return out, keys.filter(pa.array(new))

    def add(self, keys: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.ids = np.concatenate([self.ids, ids])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lens)])

    def keep(self, these: np.ndarray) -> None:
        """Forget all others."""
        self.keys = self.keys.filter(pa.array(these))
        self.ids, self.offsets = gather(self.ids, self.offsets, np.flatnonzero(these))


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _flat(lists: list[list], item: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The lists' items end to end, and their lengths."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    every = itertools.chain.from_iterable(lists)
    return np.fromiter(map(item, every) if item else every, np.uint32, int(lens.sum())), lens


class WordEncoder:
    """Ids by the tokenizers library. The vocabulary drops white space, so words between blanks are encoded by themselves and kept.

    Plain words are lower-cased and cut into pieces here and each new piece goes to the library's BPE model; all other
    words, and those with an apostrophe before a letter or that may hold a special token, go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.model = self.t.model
        self.words, self.pieces, self.seen = _Known(), _Known(), np.zeros(0, np.int64)

    def _thin(self) -> None:
        """Forget the words met once since the last thinning, and all if too many are left."""
        often = self.seen > 1
        if often.sum() > CACHE // 2:
            often[:] = False
        self.words.keep(often)
        self.seen = np.zeros(len(self.words.keys), np.int64)

    def _pieces(self, new: pa.Array) -> None:
        """Encode pieces that are not known."""
        raw = "\n".join(new.to_pylist())  # no piece holds a line end
        if not raw.isascii():
            raw = raw.encode().decode("latin-1").translate(_OF_BYTE)
        got = [_flat(list(map(self.model.tokenize, some)), attrgetter("id")) for some in itertools.batched(raw.split("\n"), 1000)]  # few lists at a time, or the garbage collector wakes
        self.pieces.add(new, *map(np.concatenate, zip(*got)))

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words end to end, and how many each has."""
        if len(self.pieces.keys) > PIECES:
            self.pieces = _Known()
        data, off = buffers(pc.utf8_lower(words))
        kind = _KIND[data]
        start = kind == 1
        start[1:] |= kind[1:] != kind[:-1]
        start[off[:-1]] = True
        found = _strings(data, np.append(np.flatnonzero(start), len(data))).dictionary_encode()
        number, new = self.pieces.numbers(found.dictionary)
        if len(new):
            self._pieces(new)
        ids, at = gather(self.pieces.ids, self.pieces.offsets, number[np.asarray(found.indices)])
        return ids, np.diff(at[np.append(0, np.cumsum(start))[off]])

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, off = buffers(words)
        after = np.append(raw[1:], np.uint8(0))
        odd = (raw < 33) | (raw == 127) | ((raw >= 192) & ~_PAIRS[raw, after]) | ((raw == 60) & (after == 124)) | ((raw == 39) & (_KIND[after | 32] == 0))
        odd = np.logical_or.reduceat(odd, off[:-1])
        if not odd.any():
            return self._plain(words)
        rest, n = _flat([self.t.encode(w, add_special_tokens=False).ids for w in words.filter(pa.array(odd)).to_pylist()])
        plain, lens = self._plain(words.filter(pa.array(~odd))) if not odd.all() else (rest[:0], n[:0])
        place = np.empty(len(odd), np.int64)
        place[~odd], place[odd] = np.arange(len(lens)), len(lens) + np.arange(len(n))
        both = np.concatenate([lens, n])
        return gather(np.concatenate([plain, rest]), np.append(0, np.cumsum(both)), place)[0], both[place]

    def __call__(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and their offsets."""
        if len(self.words.keys) > CACHE:
            self._thin()
        data, off = buffers(texts)
        first, last, row = words(data, off, _WORD)  # at ASCII white space, which every definition of white space has
        found = _strings(data[_WORD[data]], np.append(0, np.cumsum(last - first))).dictionary_encode()
        number, new = self.words.numbers(found.dictionary)
        if len(new):
            self.words.add(new, *self._encode(new))
        which = number[np.asarray(found.indices)]
        ids, at = gather(self.words.ids, self.words.offsets, which)
        ends = at[np.cumsum(np.bincount(row, minlength=len(texts)))]
        self.seen = np.append(self.seen, np.zeros(len(new), np.int64)) + np.bincount(which, minlength=len(self.words.keys))
        if len(new) and pc.max(pc.binary_length(new)).as_py() > SHORT:
            short = np.asarray(pc.binary_length(self.words.keys)) <= SHORT
            self.words.keep(short)
            self.seen = self.seen[short]
        return np.insert(ids, ends, end), np.append(0, ends + np.arange(1, len(texts) + 1))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """A worker's encoder, whose words outlive the task."""
    return WordEncoder(path)


def cuts(ids: np.ndarray, offsets: np.ndarray, mean: int = MEAN, largest: int = LARGEST, window: int = WINDOW) -> np.ndarray:
    """Chunk borders of documents whose ids stand end to end; offsets are the documents' borders and stay borders.

    A chunk ends after each id where the rolling hash of the last `window` ids of the document is 0 mod mean, and what is longer
    than `largest` is cut into pieces of that length from its start.
    """
    s = np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)  # sums of hashes over the window roll in O(1)
    roll = s.copy()
    roll[window:] -= s[:-window]
    hit = np.flatnonzero(mix(roll) % np.uint64(mean) == 0) + 1
    hit = hit[hit - offsets[np.searchsorted(offsets, hit, "left") - 1] >= window]
    edges = np.unique(np.concatenate([offsets, hit]))
    gaps = np.diff(edges)
    for i in np.flatnonzero(gaps > largest)[::-1]:
        edges = np.insert(edges, i + 1, np.arange(edges[i] + largest, edges[i + 1], largest))
    return edges


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(digests: list[bytes]) -> bytes:
    """Root over a list of digests: pairs are hashed level by level, an odd one is carried up; empty: the address of nothing."""
    if not digests:
        return address(b"")
    while len(digests) > 1:
        digests = [address(b"".join(digests[i : i + 2])) if i + 1 < len(digests) else digests[i] for i in range(0, len(digests), 2)]
    return digests[0]


def _encode(path: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, zip_ = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, step=STEP):
            ids, off = enc(batch.column("text"))
            edges = cuts(ids, off)
            raw = ids.astype(f"<u{width}").tobytes()
            at = (edges * width).tolist()
            digests = [address(raw[a:b]) for a, b in zip(at, at[1:])]
            first = np.searchsorted(edges, off)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "h": batch.column("h"),
                "ids": pa.array([zip_.compress(raw[a:b]) for a, b in zip((off[:-1] * width).tolist(), (off[1:] * width).tolist())], pa.binary()),
                "digests": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(digests, pa.binary())),
                "lens": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(np.diff(edges).astype(np.int32))),
            })

    return run


_OUT = "kind string, part int, seq long, doc_id long, start long, n_tokens long, root binary, digests array<binary>, digest binary, block long, size long, at long, uses long"


class _Pack:
    """A pack file in the making."""

    def __init__(self, uri: str, part: int):
        self.fs, path = pa.fs.FileSystem.from_uri(uri)
        self.fs.create_dir(path, recursive=True)
        self.path, self.tmp = f"{path}/{part:06d}", f"{path}/.{part:06d}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.tmp, compression=None)
        self.part, self.at, self.have, self.held, self.rows = part, 0, 0, [], []

    def add(self, digest: bytes, data: bytes, n: int, uses: int) -> None:
        self.rows.append((digest, self.have, n, uses))
        self.held.append(data)
        self.have += len(data)

    def flush(self) -> list[tuple]:
        """Write what is held as one block; the index rows of its chunks."""
        block = zstandard.ZstdCompressor(level=1).compress(b"".join(self.held))
        self.out.write(block)
        size = len(block)
        out = [("chunk", self.part, None, None, None, n, None, None, d, self.at, size, a, u) for d, a, n, u in self.rows]
        self.at += len(block)
        self.have, self.held, self.rows = 0, [], []
        return out

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


def _write(uri: str, width: int, schema: pa.Schema):
    """Rows of one part in order; a document's own new chunks' digests come before it. The pack is written, index and recipes returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        rows: list[tuple] = []  # in the order of _OUT
        pack, part, own, roots, seq, start = None, TaskContext.get().partitionId(), {}, [], 0, 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            for i, digest, uses, data, digests, lens in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "uses", "ids", "digests", "lens"))):
                pack = pack or _Pack(uri, part)
                if digest is not None:
                    own[digest] = uses
                    continue
                n, raw = sum(lens), None
                b = 0
                for d, k in zip(digests, lens):
                    a, b = b, b + k
                    if d in own:
                        raw = unzip.decompress(data) if raw is None else raw
                        pack.add(d, raw[a * width : b * width], k, own.pop(d))
                        if pack.have >= BLOCK:
                            rows += pack.flush()
                roots.append(merkle(digests))
                rows.append(("doc", part, seq, i, start, n, roots[-1], digests, None, None, None, None, None))
                seq, start = seq + 1, start + n
            if len(rows) > 5000:
                yield out()
        if pack:
            rows += pack.flush()
            pack.close()
            rows.append(("manifest", part, seq, None, None, start, merkle(roots), None, None, None, None, None, None))
            yield out()

    return run


def write(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text (null: empty) with the tokenizers file, end each with id END, and write a store; returns its path.

    Documents stand in ascending order of doc_id, null ids first; equal ids in the order of their texts' hashes, and rows that
    repeat id and text are documents of their own. No rows make a store without packs. Other columns are not carried.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or shared_path(spark, "store")
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    spool = key_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).mapInArrow(_encode(tokenizer, width), "doc_id long, h long, ids binary, digests array<binary>, lens array<int>")
    spool = settle(spark, spool, "spool")
    seen = spool.select("doc_id", "h", F.explode("digests").alias("digest"))
    owners = seen.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("o"), F.count(F.lit(1)).alias("uses")).select("o.doc_id", "o.h", "digest", "uses")
    rows = spool.select("doc_id", "h", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("uses"), "ids", "digests", "lens").unionByName(owners, allowMissingColumns=True)
    parts = max(1, -(-spool.count() // PART_ROWS))
    order = F.col("doc_id").asc_nulls_first(), F.col("h")
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("digest").isNull())
    kinds = {"kind": pa.string(), "part": pa.int32(), "root": pa.binary(), "digests": pa.list_(pa.binary()), "digest": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in _OUT.split(", ")])
    out = rows.mapInArrow(_write(f"{path}/packs/w{width}", width, schema), _OUT)
    out.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/tables")
    return path


class _Packs:
    """Random access to packs: memory maps where the folder is local, ranged reads elsewhere; the last blocks are kept unpacked."""

    def __init__(self, uri: str, keep: int = 16):
        self.fs, self.path = pa.fs.FileSystem.from_uri(uri)
        self.files: OrderedDict[int, pa.NativeFile] = OrderedDict()
        self.blocks: OrderedDict[tuple[int, int], bytes] = OrderedDict()
        self.keep, self.unzip = keep, zstandard.ZstdDecompressor()

    def block(self, part: int, at: int, size: int) -> bytes:
        if (part, at) not in self.blocks:
            if part not in self.files:
                name = f"{self.path}/{part:06d}"
                self.files[part] = pa.memory_map(name) if isinstance(self.fs, pa.fs.LocalFileSystem) else self.fs.open_input_file(name)
                if len(self.files) > 64:
                    self.files.popitem(last=False)[1].close()
            f = self.files[part]
            f.seek(at)
            self.blocks[part, at] = self.unzip.decompress(f.read(size))
            if len(self.blocks) > self.keep:
                self.blocks.popitem(last=False)
        return self.blocks[part, at]


def _read(uri: str, width: int, with_ids: bool):
    """Chunk rows in order of (part, seq, k) to documents; every digest, document root and part root is checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(uri)
        doc, parts, got, part_roots = None, [], [], []

        def end_part() -> None:
            if merkle(part_roots) != doc[-1]:
                raise ValueError(f"part {doc[0]} does not match its manifest")
            part_roots.clear()

        def end_doc() -> None:
            part, _, i, start, n, root, _ = doc
            data = b"".join(parts)
            mine = merkle([address(p) for p in parts])
            if mine != root or len(data) != n * width:
                raise ValueError(f"document {i} does not match its recipe")
            part_roots.append(mine)
            ids = np.frombuffer(data, f"<u{width}")
            got.append((i, start, n, ids.astype(np.int32) if with_ids else zlib.crc32(ids.astype("<u4").tobytes())))
            parts.clear()

        def out() -> pa.RecordBatch:
            i, s, n, x = zip(*got) if got else ([], [], [], [])
            got.clear()
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(i, pa.int64()), "start": pa.array(s, pa.int64()), "n_tokens": pa.array(n, pa.int64()), **({"ids": pa.array(x, pa.list_(pa.int32()))} if with_ids else {"ids_crc32": pa.array(x, pa.int64())})})

        names = ("part", "seq", "doc_id", "start", "doc_tokens", "root", "part_root", "c_part", "block", "size", "at", "n_tokens")
        for batch in batches:
            for part, seq, i, start, n, root, part_root, c_part, block, size, at, m in zip(*(batch.column(c).to_pylist() for c in names)):
                if doc is None or doc[:2] != (part, seq):
                    if doc:
                        end_doc()
                        if doc[0] != part:
                            end_part()
                    doc = (part, seq, i, start, n, root, part_root)
                parts.append(packs.block(c_part, block, size)[at : at + m * width])
            if len(got) > 500:
                yield out()
        if doc:
            end_doc()
            end_part()
        yield out()

    return run


def _parts(t: DataFrame) -> tuple[DataFrame, int]:
    """(part, base, part_root) of each part, base being the ids of all parts before it; and the number after the last part."""
    parts = t.where("kind = 'manifest'").select("part", "n_tokens", F.col("root").alias("part_root"), F.floor(F.col("part") / PART_BLOCK).alias("block"))
    sums = sorted(parts.groupBy("block").agg(F.sum("n_tokens").alias("n"), F.max("part").alias("last")).collect())  # a row for PART_BLOCK parts
    before = [(r.block, n) for r, n in zip(sums, itertools.accumulate((r.n for r in sums), initial=0))]
    base = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("own", base).join(t.sparkSession.createDataFrame(before, "block long, n long"), "block")
    return parts.select("part", (F.col("own") + F.col("n")).alias("base"), "part_root"), max((r["last"] + 1 for r in sums), default=0)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids array<int> or ids_crc32, rebuilt from a store's files."""
    t = spark.read.schema(_OUT).parquet(f"{path}/tables")
    parts, n = _parts(t)
    schema = "doc_id long, start long, n_tokens long, " + ("ids array<int>" if with_ids else "ids_crc32 long")
    if not n:
        return spark.createDataFrame([], schema)
    index = t.where("kind = 'chunk'").select("digest", F.col("part").alias("c_part"), "block", "size", "at", "n_tokens", "uses")
    docs = t.where("kind = 'doc'").select("part", "seq", "doc_id", "start", F.col("n_tokens").alias("doc_tokens"), "root", "digests").join(parts, "part")
    docs = docs.withColumn("start", F.col("start") + F.col("base")).select("part", "seq", "doc_id", "start", "doc_tokens", "root", "part_root", F.posexplode("digests").alias("k", "digest"))
    rows = with_group(docs.withColumn("digest", F.hex("digest")), index.withColumn("digest", F.hex("digest")), "digest", "uses", "seq").drop("digest", "uses")
    rows = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "seq", "k")
    fs, where = pa.fs.FileSystem.from_uri(f"{path}/packs")
    width = int(next(f.base_name for f in fs.get_file_info(pa.fs.FileSelector(where)) if f.base_name.startswith("w"))[1:])
    return rows.mapInArrow(_read(f"{path}/packs/w{width}", width, with_ids), schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write a store of docs and read it back: doc_id, start, n_tokens, ids_crc32. Repeated rows are documents of their own."""
    return read(docs.sparkSession, write(docs, tokenizer), with_ids=False)
