"""Document fingerprints by winnowing: hashes of all k-grams, the least of each window, rightmost of equals, positions kept.

Any passage of at least window + k - 1 equal UTF-8 bytes in two texts gives them a fingerprint in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, id_cuts, key_text, literal, slices
from .texthash import prefix, spans

#: Bytes a gram, grams a window.
GRAM, WINDOW = 24, 32
#: Rows aimed at for each range of ids that one task walks in order, and the most ranges (rows a range grow beyond that).
RANGE_ROWS, RANGES = 5_000, 1 << 18


def fingerprint(data: bytes, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions) of the chosen grams in order. A text shorter than k is one gram; an empty one has none."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    p = prefix(x)
    at = np.arange(max(1, len(x) - k + 1))
    h = spans(p, at, np.minimum(at + k, len(x))) >> np.uint64(32)
    key = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))  # least key: least hash, rightmost
    w = min(w, len(key))
    low, have = key, 1
    while have < w:
        step = min(have, w - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    chosen = low[np.r_[True, low[1:] != low[:-1]]]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of the distinct hashes of two fingerprints; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1.0 if len(a) + len(b) == 0 else both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(hashes.astype("<u4").tobytes() + positions.astype("<i8").tobytes())


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hashes array<long>, positions array<long> (byte offsets) of each row's whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [fingerprint(t.encode(), k, w) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "hashes": pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), "positions": pa.array([p for _, p in got], pa.list_(pa.int64()))})

    return key_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of text replaced by as many code points from the start of the following text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _walk(k: int, w: int):
    """Rows of one range, by falling id; ghost rows (the first of the next range) only follow."""

    def row(doc, following):
        (i, text, (h, p)), (_, text2, (h2, _)) = doc, following
        new = edited(text, text2)
        eh, ep = fingerprint(new.encode(), k, w)
        return i, len(text), hashlib.sha256(new.encode()).hexdigest(), digest(h, p), digest(eh, ep), likeness(h, eh), likeness(h, h2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, step=8 << 20):
            out = []
            for part, i, text, ghost in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "ghost"))):
                doc = (i, text, fingerprint(text.encode(), k, w))
                if last is not None and last[0] == part:
                    out.append(row(last[1], doc))
                last = None if ghost else (part, doc)
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(_NAMES, cols, _TYPES)})

    return run


_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def compare_edited(docs: DataFrame, k: int = GRAM, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, and likenesses to the edited and the next text, by falling doc_id.

    The next of the last document is the first; a single document is its own next. Null ids come last; rows with equal ids
    follow each other by the text's hash, and rows that repeat both are documents of their own. Null and empty texts have no
    grams, equal fingerprints and likeness 1. Empty input gives no rows; other columns are not carried. Texts are moved once: rows are dealt out by ranges of doc_id, and the first row of
    each range goes to the range before it too, as that one's last successor.
    """
    rows = key_text(docs, id_col, text_col).withColumn("order", F.xxhash64("text"))
    ids = docs.select(docs[id_col].cast("long").alias("i"))
    cuts = id_cuts(ids.where("i is not null"), RANGE_ROWS, RANGES)
    # null ids have ranges of their own, by the text's hash: its values are spread evenly over 64 bits
    lost = min(RANGES, -(-ids.where("i is null").count() // RANGE_ROWS))
    by_hash = [-(1 << 63) + (1 << 64) * j // lost for j in range(1, lost)]
    # ranges by falling id: part 0 holds the largest
    known = len(cuts) - bucket(F.col("i"), cuts)
    part = F.when(F.col("i").isNull(), len(cuts) + 1 + bucket(F.col("order"), by_hash)).otherwise(known).cast("int")
    # what stands at the head of each range, one row a range: all rows with that id (or hash) are sent, and the walk takes the first of them
    first = [(r.part, r.head) for r in ids.where("i is not null").groupBy(known.cast("int").alias("part")).agg(F.max("i").alias("head")).collect()]
    nulls = rows.where("doc_id is null").withColumn("i", F.col("doc_id")).groupBy(part.alias("part")).agg(F.min("order").alias("head")).collect() if lost else []
    heads = sorted(first) + sorted((r.part, r.head) for r in nulls)
    before, head = [0] * (len(cuts) + 1 + lost), [None] * (len(cuts) + 1 + lost)
    for j, (p, h) in enumerate(heads):
        before[p], head[p] = heads[j - 1][0], h
    rows = rows.withColumn("i", F.col("doc_id")).withColumn("part", part)
    own = F.struct(F.col("part"), F.lit(False).alias("ghost"))
    extra = F.struct(F.get(literal(before, "int"), F.col("part")).alias("part"), F.lit(True).alias("ghost"))
    leads = F.coalesce(F.col("i"), F.col("order")) == F.get(literal(head, "long"), F.col("part"))
    sent = rows.withColumn("at", F.explode(F.when(leads, F.array(own, extra)).otherwise(F.array(own))))
    sent = sent.select("doc_id", "text", "order", "at.part", "at.ghost").repartitionById(len(before), F.col("part"))
    sent = sent.sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "order", "text").select("part", "doc_id", "text", "ghost")
    return sent.mapInArrow(_walk(k, w), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
