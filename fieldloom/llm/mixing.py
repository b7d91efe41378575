"""Mixing sources to target weights: temperature on token shares, bisected exponent, budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import key_text, settle

#: Entropy to reach (as a share of the most that the sources allow), passes over a source at most, rows aimed at in a block.
ENTROPY, REPEAT, BLOCK_ROWS, SEED = 0.95, 4.0, 256, 17
#: Sources whose weights may be sent to every task.
SOURCES = 100_000


@dataclass(frozen=True)
class Plan:
    """exponent, and for each source its weight, tokens to draw, and tokens there are."""

    exponent: float
    weights: dict[str | None, float]
    quota: dict[str | None, int]
    tokens: dict[str | None, int]


def tempered(tokens: dict, exponent: float) -> dict:
    """Weights proportional to share ** exponent; sources without tokens have none."""
    total = sum(tokens.values())
    raw = {s: (t / total) ** exponent if t else 0.0 for s, t in tokens.items()}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def plan(tokens: dict, budget: int, entropy_share: float = ENTROPY, repeat: float = REPEAT) -> Plan:
    """The exponent in 0..1 nearest to 1 that reaches the entropy, or else the least that keeps every source within `repeat` passes.

    Entropy falls and repetition of small sources falls as the exponent rises, so both are bisected; the repetition limit wins
    if they conflict. A budget beyond repeat * tokens of everything can't keep the limit; the exponent is 1 then.
    """
    if not any(tokens.values()):
        return Plan(1.0, {s: 0.0 for s in tokens}, {s: 0 for s in tokens}, dict(tokens))
    target = entropy_share * math.log(sum(1 for t in tokens.values() if t))

    def bisect(ok_low) -> float:
        """The exponent at which ok_low, true at low exponents, turns false."""
        lo, hi = 0.0, 1.0
        if ok_low(1.0):
            return 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok_low(mid) else (lo, mid)
        return lo

    exponent = bisect(lambda a: entropy(tempered(tokens, a)) >= target)
    over = lambda a: any(w * budget > repeat * tokens[s] for s, w in tempered(tokens, a).items() if tokens[s])
    if over(exponent):
        exponent = min(1.0, bisect(over) + 2**-50)
    weights = tempered(tokens, exponent)
    return Plan(exponent, weights, {s: int(w * budget) for s, w in weights.items()}, dict(tokens))


def draw(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, n_tokens, weight, exponent, epoch (0..), block, start, of every draw of a document.

    Tokens are words between white space; the budget is all tokens unless given. Each pass (epoch) over a source is a new
    permutation: documents are dealt to blocks by hash and the blocks follow each other by number. Passes are drawn whole while
    the source's quota lasts; of the last pass, documents that would exceed it are left out. start is the source's tokens drawn before.
    A null source is a source; texts without words are drawn with each pass that reaches their place. Rows with equal ids
    and texts are told apart only by the pass. Sums run over block totals, and over documents only inside one block.
    """
    return _draws(docs, **how).drop("h")


def _draws(docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY, repeat: float = REPEAT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    spark = docs.sparkSession
    text = F.col("text")
    rows = key_text(docs, id_col, text_col, source=docs[source_col].cast("string"))
    count = F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).cast("long")
    rows = settle(spark, rows.select("doc_id", "source", count.alias("n_tokens"), F.xxhash64("text").alias("h")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()  # one row a source
    tokens = {r.source: r.t for r in totals}
    p = plan(tokens, sum(tokens.values()) if budget is None else budget, entropy_share, repeat)
    table = spark.createDataFrame(
        [(s, p.weights[s], p.exponent, p.quota[s], tokens[s], -(-r.n // BLOCK_ROWS), (p.quota[s] // tokens[s] if tokens[s] else 0)) for r in totals for s in [r.source]],
        "s string, weight double, exponent double, quota long, tokens long, blocks long, whole long",
    )
    # a row a source: sent to every task up to SOURCES, joined by Spark's own choice beyond
    drawn = rows.join(F.broadcast(table) if len(totals) <= SOURCES else table, F.col("source").eqNullSafe(F.col("s")))
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    # a block is numbered by a seeded hash: another dealing and another order for each pass
    drawn = drawn.withColumn("key", F.xxhash64(F.lit(SEED), "epoch", "source", "doc_id", "h")).withColumn("block", F.pmod("key", "blocks"))
    sums = drawn.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("bt"))
    # two levels: blocks of a source are summed by hundreds before they are put in order
    sums = settle(spark, sums.withColumn("super", F.floor(F.col("block") / 512)), "blocks")
    before = lambda col, *by: F.coalesce(F.sum(col).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    supers = sums.groupBy("source", "epoch", "super").agg(F.sum("bt").alias("st")).withColumn("s0", before("st", "source", "epoch", "super"))
    sums = sums.withColumn("b0", before("bt", "source", "epoch", "super", "block"))
    same = lambda x, y, *by: F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source")) & (F.col(f"{x}.epoch") == F.col(f"{y}.epoch")) & (F.col(f"{x}.{by[0]}") == F.col(f"{y}.{by[0]}"))
    sums = sums.alias("x").join(supers.alias("y"), same("x", "y", "super")).select("x.source", "x.epoch", "x.block", (F.col("b0") + F.col("s0")).alias("before"))
    placed = drawn.withColumn("inside", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "epoch", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = placed.alias("d").join(sums.alias("b"), same("d", "b", "block"))
    out = out.withColumn("start", F.col("tokens") * F.col("d.epoch") + F.col("before") + F.col("inside"))
    return out.where(F.col("start") + F.col("n_tokens") <= F.col("quota")).select("doc_id", "h", "d.source", "n_tokens", "weight", "exponent", "d.epoch", "d.block", "start")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Rows of docs as often as they are drawn, all columns as they are; rows that repeat id and text share their draws.

    Null texts count as empty; a null source is a source. Columns of any name pass through. Empty input gives no rows.
    """
    times = _draws(docs, **how).select("doc_id", "h", "epoch").distinct().groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times"))
    times = settle(docs.sparkSession, times, "draws")
    own = docs.select(F.struct("*").alias("row"), docs.doc_id.cast("long").alias("id"), F.xxhash64(F.coalesce(docs.text.cast("string"), F.lit(""))).alias("hash"))
    out = own.join(times, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("h")))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("k")).select("row.*")
