"""Index algebra of regular structures as column expressions: no table of connectivity is stored or shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.model import GridSpec


def logical(index: Column, dims: tuple[int, ...]) -> list[Column]:
    """i, j, k of an index that counts the first dimension fastest."""
    out, div = [], 1
    for n in dims:
        out.append((F.floor(index / F.lit(div)) if div > 1 else index) % F.lit(n))
        div *= n
    return [c.cast("long") for c in out]


def flat(ijk: list[Column], dims: tuple[int, ...]) -> Column:
    out, mul = F.lit(0).cast("long"), 1
    for c, n in zip(ijk, dims):
        out, mul = out + c * F.lit(mul), mul * n
    return out


def cell_nodes(cell: Column, grid: GridSpec) -> Column:
    """Node ids of a cell: beam 2, pixel 4, voxel 8, the first axis fastest."""
    base = flat(logical(cell, grid.cell_dims), grid.dims)
    offsets, step = [0], 1
    for n in grid.dims:
        offsets, step = offsets + [o + step for o in offsets], step * n
    return F.array(*[base + F.lit(o).cast("long") for o in offsets])


def nodes(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """node_id and i, j, k."""
    df = spark.range(grid.n_nodes).withColumnRenamed("id", "node_id")
    return df.select("node_id", *(c.alias(n) for c, n in zip(logical(F.col("node_id"), grid.dims), "ijk")))


def cells(spark: SparkSession, grid: GridSpec) -> DataFrame:
    df = spark.range(grid.n_cells).withColumnRenamed("id", "cell_id")
    return df.select("cell_id", F.lit(int(grid.shape)).alias("shape"), cell_nodes(F.col("cell_id"), grid).alias("nodes"))


def edges(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """edge_id, a, b: edges along x first, then y, then z."""
    parts, first = [], 0
    for axis, n in enumerate(grid.edge_counts):
        dims = tuple(c if d == axis else m for d, (m, c) in enumerate(zip(grid.dims, grid.cell_dims)))
        step = reduce(lambda a, b: a * b, grid.dims[:axis], 1)
        a = flat(logical(F.col("id"), dims), grid.dims)
        parts.append(spark.range(n).select((F.col("id") + F.lit(first)).alias("edge_id"), a.alias("a"), (a + F.lit(step)).alias("b")))
        first += n
    return reduce(DataFrame.unionByName, parts)


def cell_edges(cell: Column, grid: GridSpec) -> Column:
    """Edge ids of a cell in the shape's local order."""
    ijk = logical(cell, grid.cell_dims)
    counts, firsts = grid.edge_counts, [0]
    for n in counts:
        firsts.append(firsts[-1] + n)

    def edge(axis: int, *up: int) -> Column:
        dims = tuple(c if d == axis else m for d, (m, c) in enumerate(zip(grid.dims, grid.cell_dims)))
        others = iter(up)
        at = [c if d == axis else c + F.lit(next(others)) for d, c in enumerate(ijk)]
        return flat(at, dims) + F.lit(firsts[axis])

    if len(grid.dims) == 1:
        return F.array(edge(0))
    if len(grid.dims) == 2:
        return F.array(edge(0, 0), edge(1, 1), edge(0, 1), edge(1, 0))
    ring = [e for z in (0, 1) for e in (edge(0, 0, z), edge(1, 1, z), edge(0, 1, z), edge(1, 0, z))]
    return F.array(*ring, edge(2, 0, 0), edge(2, 1, 0), edge(2, 0, 1), edge(2, 1, 1))


def faces(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """face_id, nodes of a three-dimensional grid: faces in XY first, then XZ, then YZ."""
    (xn, yn, _), cd = grid.dims, grid.cell_dims
    up = [1, xn, xn * yn]
    parts, first = [], 0
    for (u, v), n in zip(((0, 1), (2, 0), (1, 2)), grid.face_counts):
        dims = tuple(cd[d] if d in (u, v) else grid.dims[d] for d in range(3))
        base = flat(logical(F.col("id"), dims), grid.dims)
        parts.append(spark.range(n).select((F.col("id") + F.lit(first)).alias("face_id"), F.array(base, base + up[u], base + up[v], base + up[u] + up[v]).alias("nodes")))
        first += n
    return reduce(DataFrame.unionByName, parts)


def cell_faces(cell: Column, grid: GridSpec) -> Column:
    """Face ids of a voxel: YZ low and high, XZ low and high, XY low and high."""
    i, j, k = logical(cell, grid.cell_dims)
    (xn, yn, zn), (xc, yc, zc), (nxy, nxz, _) = grid.dims, grid.cell_dims, grid.face_counts
    yz = lambda o: flat([i + F.lit(o), j, k], (xn, yc, zc)) + F.lit(nxy + nxz)
    xz = lambda o: flat([i, j + F.lit(o), k], (xc, yn, zc)) + F.lit(nxy)
    xy = lambda o: flat([i, j, k + F.lit(o)], (xc, yc, zn))
    return F.array(yz(0), yz(1), xz(0), xz(1), xy(0), xy(1))


def node_cells(node: Column, grid: GridSpec) -> Column:
    """Cells around a node, lower indices first."""
    ijk = logical(node, grid.dims)
    offsets: list[tuple[int, ...]] = [()]
    for _ in grid.dims:
        offsets = [(*o, d) for d in (-1, 0) for o in offsets]
    offsets = sorted(offsets, key=lambda o: o[::-1])
    cells_ = []
    for o in offsets:
        at = [c + F.lit(d) for c, d in zip(ijk, o)]
        inside = reduce(lambda a, b: a & b, [(c >= 0) & (c < n) for c, n in zip(at, grid.cell_dims)])
        cells_.append(F.when(inside, flat(at, grid.cell_dims)))
    return F.filter(F.array(*cells_), lambda c: c.isNotNull())


def axis_regular(index: Column, origin: float, delta: float) -> Column:
    return F.lit(origin) + index * F.lit(delta)


# --- domain decomposition --------------------------------------------------------------------------


def best_factors(n: int, cell_dims: tuple[int, ...]) -> tuple[int, ...]:
    """How many blocks along each axis, n in all, so that the surface of a block is least (ties: fewest along the first axes)."""
    best = None
    for a in range(1, n + 1):
        if n % a:
            continue
        for b in range(1, n // a + 1):
            if (n // a) % b:
                continue
            f = (a, b, n // a // b)[: len(cell_dims)]
            if len(cell_dims) < 3 and n // a // b > 1 or len(cell_dims) == 1 and b > 1:
                continue
            size = [c / k for c, k in zip(cell_dims, f)]
            cost = sum(2 * reduce(lambda p, q: p * q, size[:d] + size[d + 1 :], 1.0) for d in range(len(size)))
            if best is None or (round(cost, 9), f) < best:
                best = (round(cost, 9), f)
    return best[1]


def blocks(df: DataFrame, grid: GridSpec, parts: tuple[int, ...]) -> DataFrame:
    """Add block_id of each cell_id: cells are dealt out along each axis in equal runs."""
    at = [F.floor(c * F.lit(p) / F.lit(n)) for c, p, n in zip(logical(F.col("cell_id"), grid.cell_dims), parts, grid.cell_dims)]
    return df.withColumn("block_id", flat([a.cast("long") for a in at], parts))


def with_ghosts(df: DataFrame, grid: GridSpec, parts: tuple[int, ...]) -> DataFrame:
    """block_id, cell_id, ghost (0 or 1): each block's own cells, and one layer of its neighbours' cells."""
    ijk = logical(F.col("cell_id"), grid.cell_dims)
    where = lambda c, p, n: F.floor(c * F.lit(p) / F.lit(n)).cast("long")
    own = [where(c, p, n) for c, p, n in zip(ijk, parts, grid.cell_dims)]
    near = [F.array_distinct(F.array(*[where(F.greatest(F.least(c + F.lit(d), F.lit(n - 1)), F.lit(0)), p, n) for d in (-1, 0, 1)])) for c, p, n in zip(ijk, parts, grid.cell_dims)]
    out = df.select("cell_id", flat(own, parts).alias("own"), *(a.alias(f"n{d}") for d, a in enumerate(near)))
    for d in range(len(parts)):
        out = out.withColumn(f"b{d}", F.explode(f"n{d}"))
    block = flat([F.col(f"b{d}") for d in range(len(parts))], parts)
    return out.select(block.alias("block_id"), "cell_id", (F.col("own") != block).cast("int").alias("ghost"))
