"""Helpers shared by the corpus operators: shared storage, safe columns, Arrow text buffers, hot-key lookups."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.shared import settle, shared_path

__all__ = ["bucket", "buffers", "id_cuts", "key_text", "literal", "one_of_each", "settle", "shared_path", "slices", "whole_rows", "with_group"]

#: Text bytes that one vectorised step handles at a time in a Python worker.
STEP_BYTES = 4 << 20


def key_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """doc_id and whole text (null: empty), and nothing else, so that extra columns can't clash."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *(c.alias(k) for k, c in more.items()),
    )


def whole_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns as a struct, so that no name can clash), id and digest (sha256 of the text; null: empty)."""
    return docs.select(F.struct("*").alias("row"), docs[id_col].cast("long").alias("id"), F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256).alias("digest"))


def one_of_each(rows: DataFrame, single: bool) -> DataFrame:
    """The columns of `row` of one row of those that repeat id and digest; single: none do."""
    if not single:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.xxhash64("row")))).where("n = 1")
    return rows.select("row.*")


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about `step` bytes of text at most, or one row if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text_col)
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), float)))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + step, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls count as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def id_cuts(ids: DataFrame, rows: int, most: int) -> list[int]:
    """Values that cut the one column of ids into ranges of about `rows` rows, at most `most` ranges."""
    n = ids.count()
    k = min(most, max(1, -(-n // rows)))
    if k == 1:
        return []
    return sorted(set(ids.agg(F.percentile_approx(ids.columns[0], [j / k for j in range(1, k)], 10 * k)).first()[0] or []))


#: Values that one step of bucket() compares with.
_WIDE = 64


def literal(values: list, kind: str) -> Column:
    """A constant array of a SQL type, of any length."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def bucket(col: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are under the value: 0..len(cuts), by halving; many cuts are looked up in blocks of _WIDE."""
    if len(cuts) > _WIDE:
        blocks = [cuts[i : i + _WIDE] for i in range(0, len(cuts), _WIDE)]
        at = bucket(col, [x[-1] for x in blocks])
        inside = F.size(F.filter(F.coalesce(F.get(literal(blocks, "array<long>"), at), F.array().cast("array<long>")), lambda c: c < col))
        return F.when(at == len(blocks), len(cuts)).otherwise(at * _WIDE + inside)

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col <= cuts[mid], half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(cuts))


def with_group(rows: DataFrame, groups: DataFrame, key: str, size_col: str, tie: str, hot_share: int = 1000) -> DataFrame:
    """rows left-joined with groups (one row per key), safe against a key that holds a large share of the rows.

    Keys with at least max(1000, n / hot_share) rows are at most hot_share many, whatever the input: only these are broadcast,
    and their rows are dealt out by `tie` instead of the key. groups must be settled or cheap, and has the rows per key in size_col.
    """
    n = groups.agg(F.sum(size_col)).first()[0] or 0
    names = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size_col) >= max(1000, -(-n // hot_share))).select(F.col(key).alias("_hk"), F.struct(*names).alias("_hot"))
    cold = groups.select(F.col(key).cast("string").alias("_ck"), F.struct(*names).alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_k", F.when(F.col("_hk").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("hot:"), F.coalesce(F.col(tie).cast("string"), F.lit("")))))
    out = out.join(cold, F.col("_k") == F.col("_ck"), "left")
    got = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *(got[c].alias(c) for c in names))
