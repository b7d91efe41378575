"""Per-element and collective primitives: map, gather, scatter, expand, compact, reduce, scan, sort, stencil."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.shared import settle
def binary(op: str, *cols: Column) -> Column:
    """add, sub, mul, div (null at a zero divisor), max, min over two or more columns; computed in double."""
    c = [x.cast("double") for x in cols]
    return {
        "add": lambda: fold(lambda a, b: a + b, c),
        "sub": lambda: fold(lambda a, b: a - b, c),
        "mul": lambda: fold(lambda a, b: a * b, c),
        "div": lambda: F.when(c[1] != 0, c[0] / c[1]),
        "max": lambda: F.greatest(*c),
        "min": lambda: F.least(*c),
    }[op]()


def unary(op: str, col: Column) -> Column:
    """neg, square, cube, log10, log2, ln (null where not positive), sqrt (null where negative), in double."""
    c = col.cast("double")
    return {
        "neg": lambda: -c,
        "square": lambda: c * c,
        "cube": lambda: c * c * c,
        "log10": lambda: F.when(c > 0, F.log10(c)),
        "log2": lambda: F.when(c > 0, F.log2(c)),
        "ln": lambda: F.when(c > 0, F.ln(c)),
        "sqrt": lambda: F.when(c >= 0, F.sqrt(c)),
    }[op]()


def less_than(col: Column, value: float) -> Column:
    return col < F.lit(value)


def not_equal(a: Column, b: Column) -> Column:
    return a != b


def strided(index: Column, div: int = 1, mod: int | None = None, mul: int = 1, add: int = 0) -> Column:
    """((index div d) mod m) * mul + add: how a view reads another array."""
    out = F.floor(index / div).cast("long") if div > 1 else index
    out = out % mod if mod else out
    return out * mul + add


def map_op(df: DataFrame, f: Callable[..., Column], *cols: str, out: str = "value") -> DataFrame:
    return df.withColumn(out, f(*(F.col(c) for c in cols)))


def gather(index: DataFrame, source: DataFrame, key: str, source_id: str) -> DataFrame:
    """Each row of index with the columns of source at that id; rows without one are dropped."""
    return index.join(source, index[key] == source[source_id]).drop(source[source_id])


def scatter(out: DataFrame, out_id: str, source: DataFrame, to: str, order: str, values: list[str]) -> DataFrame:
    """Rows of out with values from the source rows sent there; of several the one with the largest order; others keep theirs."""
    last = source.groupBy(to).agg(F.max(F.struct(F.col(order), *values)).alias("_v")).withColumnRenamed(to, "_to")
    joined = out.join(last, out[out_id] == F.col("_to"), "left")
    return joined.select(*(F.when(F.col("_to").isNotNull(), F.col("_v")[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in out.columns))


def expand(df: DataFrame, n: int, out: str = "sub") -> DataFrame:
    """Each row n times, numbered 0..n-1."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def average_runs(df: DataFrame, id_col: str, value: str, n: int) -> DataFrame:
    """(id div n, mean) of runs of n."""
    return df.groupBy(F.floor(F.col(id_col) / n).cast("long").alias(id_col)).agg(F.avg(value).alias(value))


def reverse_index(df: DataFrame, count: str, out: str = "sub") -> DataFrame:
    """Each row as often as count says, numbered; none if count is 0 or less."""
    return df.where(F.col(count) > 0).withColumn(out, F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)))


#: Bits of a row's number inside its partition in _ORDER.
_INSIDE, _ORDER = 33, "place_in_order"


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df range-partitioned and sorted by the keys (nulls first) and written down, with each row's partition and place in it as one number.

    Ranges come from a sample, so neither sparse nor uneven keys make a large one; rows that repeat all keys share one.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    return settle(df.sparkSession, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_ORDER, F.monotonically_increasing_id()), "ordered")


def _before(ordered: DataFrame, value: Column) -> DataFrame:
    """(part, before): the sum of value over all partitions before; one row a partition, so it may be sent everywhere."""
    part = F.shiftright(_ORDER, _INSIDE).cast("int")
    sums = sorted(ordered.groupBy(part.alias("part")).agg(value.alias("s")).collect())
    kind = dict(ordered.agg(value.alias("s")).dtypes)["s"]
    out, total = [], None
    for r in sums:
        out.append((r.part, total))
        total = r.s if total is None else total if r.s is None else total + r.s
    return F.broadcast(ordered.sparkSession.createDataFrame(out, f"part int, before {kind}"))


def scan(df: DataFrame, id_col: str, value: str, inclusive: bool = True, out: str = "scan") -> DataFrame:
    """Running sum by id (nulls count as 0; of equal ids one comes first): ranges of ids are summed, put in order, and each is summed by itself."""
    ordered = in_order(df, id_col).withColumn("part", F.shiftright(_ORDER, _INSIDE).cast("int"))
    frame = Window.partitionBy("part").orderBy(_ORDER).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0)
    own = ordered.withColumn(out, F.coalesce(F.sum(value).over(frame), zero)).join(_before(ordered, F.sum(value)), "part")
    return own.withColumn(out, F.col(out) + F.coalesce("before", zero)).drop("part", "before", _ORDER)


def dense_ids(df: DataFrame, *keys: str, out: str = "id") -> DataFrame:
    """Number rows 0.. in the order of the keys: each row's place in its range, after the sizes of the ranges before."""
    ordered = in_order(df, *keys)
    own = ordered.withColumn("part", F.shiftright(_ORDER, _INSIDE).cast("int")).join(_before(ordered, F.count(F.lit(1))), "part")
    inside = F.col(_ORDER).bitwiseAND(F.lit((1 << _INSIDE) - 1))
    return own.withColumn(out, F.coalesce("before", F.lit(0)) + inside).drop("part", "before", _ORDER)


def compact(df: DataFrame, flag: Column, id_col: str, out: str = "dense") -> DataFrame:
    """Rows where flag holds, with dense numbers in id order."""
    return dense_ids(df.where(flag), id_col, out=out)


def argsort(df: DataFrame, key: str, id_col: str, out: str = "rank") -> DataFrame:
    """Rank of each row by (key, id), by one range-partitioned sort; a key that many rows have is cut by the id."""
    return dense_ids(df, key, id_col, out=out)


def reduce_with(df: DataFrame, value: str, merge: Callable[[Column, Column], Column], identity, rows: int = 10_000):
    """merge folded over a column from an identity, for an associative and commutative merge: blocks of rows fold by themselves, then their results."""
    kind = df.schema[value].dataType
    start = F.lit(identity).cast(kind)
    fold_ = lambda c: F.aggregate(c, start, lambda a, x: merge(a, x).cast(kind))
    parts = df.select(value)
    while True:
        n = parts.count()
        if n <= rows:
            return parts.agg(fold_(F.collect_list(value)).alias(value)).first()[0]
        blocks = -(-n // rows)
        parts = parts.withColumn("b", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
        parts = settle(df.sparkSession, parts.groupBy("b").agg(fold_(F.collect_list(value)).alias(value)).select(value), "folded")


def stencil3x3(nodes: DataFrame, value: str, nx: int, ny: int, border: bool = False, out: str = "average") -> DataFrame:
    """Mean over the 3x3 neighbours of each node of a grid (columns i, j); with border, of those that exist, else inner nodes only.

    Each value is sent to the nodes it counts for, so there is one shuffle with partial sums and no self-join.
    """
    around = F.array(*[F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j")) for dj in (-1, 0, 1) for di in (-1, 0, 1)])
    sent = nodes.select(F.explode(around).alias("at"), F.col(value).cast("double").alias("v")).select("at.*", "v")
    lo, hx, hy = (0, nx - 1, ny - 1) if border else (1, nx - 2, ny - 2)
    sent = sent.where(F.col("i").between(lo, hx) & F.col("j").between(lo, hy))
    return sent.groupBy("i", "j").agg((F.sum("v") / F.count("v")).alias(out)).select((F.col("i") + F.col("j") * nx).alias("node_id"), out)
