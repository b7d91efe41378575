"""Language identification by nearest centroid: TF-IDF of hashed byte n-grams, several centroids a language, cosine, rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, key_text, settle, slices

#: Buckets that n-grams are hashed to, n-gram lengths in bytes, centroids a language.
DIM, GRAMS, CENTROIDS = 4096, (1, 2, 3), 3
#: Different labelled texts a language that the centroids are fitted on (chosen by hash); idf is counted over all training rows.
SAMPLE = 400
#: A text is rejected if its cosine with the nearest centroid is under this share of a lower quantile of the cosines of that
#: language's members at its length; members count whole and by their first 8, 16, 32.. letters.
REJECT_SHARE, REJECT_QUANTILE, SHORTEST = 0.9, 0.01, 8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def counts(texts: pa.Array, rows: int = 256) -> Iterator[np.ndarray]:
    """(rows, DIM) counts of n-grams of whole texts: letters lower-cased, all other ASCII one space, nothing crosses a text's border."""
    texts = pc.utf8_lower(texts)
    for at in range(0, len(texts), rows):
        data, off = buffers(texts.slice(at, rows))
        n = len(off) - 1
        sep = np.insert(_FOLD[data], off[:-1], 32)
        start = off[:-1] + np.arange(n)
        keep = np.ones(len(sep), bool)
        keep[1:] = (sep[1:] != 32) | (sep[:-1] != 32)
        keep[start] = True
        doc = np.repeat(np.arange(n), np.diff(np.append(start, len(sep))))[keep]
        x = sep[keep].astype(np.uint32)
        out = np.zeros(n * DIM, np.float32)
        h = np.zeros(len(x), np.uint32)
        for k in range(max(GRAMS)):
            h = h[: len(x) - k] * np.uint32(0x01000193) + x[k:] + np.uint32(1)
            if k + 1 in GRAMS and len(h):
                same = doc[: len(h)] == doc[k:]
                b = ((h * _ODD[k]) >> np.uint32(20)).astype(np.int64)[same]
                out += np.bincount(doc[: len(h)][same] * DIM + b, minlength=n * DIM).astype(np.float32)
        yield out.reshape(n, DIM)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    lang_of: np.ndarray
    least: list[tuple[np.ndarray, np.ndarray]]  # for each language: log2 of n-grams, ascending, and the least cosine there

    def predict(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine with the nearest centroid, and whether that is too far."""
        cos = unit(np.log1p(c) * self.idf) @ self.centroids.T
        best = cos.argmax(1)
        top = cos[np.arange(len(c)), best]
        lang, size = self.lang_of[best], np.log2(np.maximum(c.sum(1), 1))
        least = np.zeros(len(c))
        for k in np.unique(lang):
            least[lang == k] = np.interp(size[lang == k], *self.least[k])
        return lang, top, top < least


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, seeded farthest-first from the mean; centroids of unit length."""
    c = unit(x.mean(0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[(x @ c.T).max(1).argmin()]])
    for _ in range(12):
        mine = (x @ c.T).argmax(1)
        c = unit(np.array([x[mine == j].mean(0) if (mine == j).any() else c[j] for j in range(len(c))]))
    return c


def _df_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(DIM, np.int64)
    for batch in slices(batches):
        for c in counts(batch.column("text")):
            df += (c > 0).sum(0)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(DIM)), "df": pa.array(df)})


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = np.vstack([np.log1p(c) for c in counts(batch.column("text"))])
        yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "order": batch.column("order"), "v": pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())})


def _near_rows(model: Model):
    """Rows (lang, text): log2 of n-grams and cosine with the nearest centroid of the language, of each text and its beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                cuts = [text[: SHORTEST << j] for j in range(max(0, (len(text) - 1) // SHORTEST).bit_length())] + [text]
                cuts = [t for t in cuts if any(map(str.isalpha, t))]
                own = model.centroids[model.lang_of == model.langs.index(lang)]
                for c in counts(pa.array(cuts, pa.string())):
                    near = (unit(np.log1p(c) * model.idf) @ own.T).max(1)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c)), "size": pa.array(np.log2(np.maximum(c.sum(1), 1)).astype(float)), "near": pa.array(near.astype(float))})

    return run


def _least(size: np.ndarray, near: np.ndarray, members: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths (in whole powers of two that enough members have) and the least cosine that is accepted at each."""
    step = np.round(size).astype(int)
    steps, n = np.unique(step, return_counts=True)
    steps = steps[n >= min(100, members / 2, n.max())]  # a quantile of 1% needs a hundred
    return steps.astype(float), np.array([REJECT_SHARE * np.quantile(near[step == s], REJECT_QUANTILE) for s in steps])


def _sample(labelled: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(lang, order, text) of the SAMPLE different texts of least hash of each language, and the rows of each language; copies count once."""
    spark = labelled.sparkSession
    rows = labelled.withColumn("order", F.xxhash64("text")).select("lang", "order", "text")
    texts = settle(spark, rows.groupBy("lang", "order").agg(F.count(F.lit(1)).alias("n")), "texts")
    sizes = {r.lang: r for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows")).collect()}
    if not sizes:
        return rows, {}
    # twice the places at least, then the least in order: Spark cuts each task's rows to SAMPLE before the shuffle
    parts = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, r in sizes.items() for x in (lang, min(parts, -(-parts * 2 * SAMPLE // r.texts)))])
    at = F.pmod("order", F.lit(parts))
    few = texts.where(at < share[F.col("lang")]).withColumn("at", at)
    first = few.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("at", "order"))).where(F.col("_n") <= SAMPLE)
    first = settle(spark, first.select("lang", "order"), "first")
    chosen = rows.join(F.broadcast(first), ["lang", "order"], "left_semi").groupBy("lang", "order").agg(F.min("text").alias("text"))
    return settle(spark, chosen, "chosen"), {lang: r.rows for lang, r in sizes.items()}


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from the rows where `usable` holds, lang is not null and the text has a letter; None if there are none.

    What reaches the driver is DIM document counts and at most SAMPLE vectors a language, of different texts.
    """
    lang = docs[lang_col].cast("string")
    labelled = key_text(docs.where(usable & lang.isNotNull()), id_col, text_col, lang=lang).where(F.col("text").rlike(r"\p{L}"))
    chosen, sizes = _sample(labelled)
    if not sizes:
        return None
    df = np.zeros(DIM, np.int64)
    for r in labelled.select("text").mapInArrow(_df_rows, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r.bucket] = r.df
    n = sum(sizes.values())
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    got = chosen.mapInArrow(_vector_rows, "lang string, order long, v binary").collect()
    langs, cents, owner = sorted(sizes), [], []
    for k, name in enumerate(langs):
        mine = sorted((r.order, bytes(r.v)) for r in got if r.lang == name)
        x = unit(np.array([np.frombuffer(v, np.float32) for _, v in mine]) * idf)
        c = _clusters(x, CENTROIDS)
        cents.append(c)
        owner += [k] * len(c)
    model = Model(langs, idf, np.vstack(cents).astype(np.float32), np.array(owner), [])
    rows = chosen.mapInArrow(_near_rows(model), "lang string, size double, near double").collect()  # SAMPLE texts a language, about 20 beginnings each
    members = {name: sum(r.lang == name for r in got) for name in langs}
    for name in langs:
        size, near = np.array([(r.size, r.near) for r in rows if r.lang == name]).T
        model.least.append(_least(size, near, members[name]))
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine), rejected for each row, from the text alone.

    Null texts and texts without a letter are `und`, score 0 and rejected, and so is everything if there is no model.
    Other texts get the nearest centroid's language, rejected or not; ties go to the first language by name.
    """
    rows = key_text(docs, id_col, text_col).withColumn("letters", F.col("text").rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            has = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            if model is None:
                lang, score, far = ["und"] * len(has), np.zeros(len(has)), np.ones(len(has), bool)
            else:
                got = [model.predict(c) for c in counts(batch.column("text"))]
                which, score, far = (np.concatenate([g[i] for g in got]) for i in range(3))
                lang = [model.langs[k] if h else "und" for k, h in zip(which, has)]
                score, far = np.where(has, np.clip(score, 0, 1), 0.0), far | ~has
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score.astype(float)), "rejected": pa.array(far)})

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(docs: DataFrame, n: int, id_col: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod n (null ids: 0)."""
    return F.coalesce(F.crc32(docs[id_col].cast("string")) % n, F.lit(0))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on two folds of three and predict all rows; held_out marks the fold that was not learned from."""
    held = fold(docs, 3) == 1
    out = predict(docs, fit(docs, ~held))
    return out.withColumn("held_out", fold(out, 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows that identify() rejects, all columns as they are. Each row is judged by its own text; ids play no part.

    Null and empty texts and texts without a letter go, and so does everything if no row can be learned from. Copies are judged
    alike. Columns of any name pass through. Empty input gives no rows.
    """
    model = fit(docs, fold(docs, 3) != 1)
    spare = "letters" + "_" * max(map(len, docs.columns))  # no column has so long a name
    rows = docs.select("*", F.coalesce(docs.text.cast("string").rlike(r"\p{L}"), F.lit(False)).alias(spare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = batch.column(spare).to_numpy(zero_copy_only=False).astype(bool)
            if model is None:
                keep[:] = False
            else:
                keep &= ~np.concatenate([model.predict(c)[2] for c in counts(batch.column("text"))])
            yield batch.filter(pa.array(keep)).drop_columns([spare])

    return rows.mapInArrow(run, docs.schema)
