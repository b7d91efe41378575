"""Connectivity and topology maps over explicit cells (and structured ones through the same columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.model import EDGES, FACES, TETS

from .primitives import dense_ids

def incidence(cells: DataFrame, *carry: str) -> DataFrame:
    """cell_id, slot, node_id, shape: a row for each node of each cell."""
    return cells.select("cell_id", F.posexplode("nodes").alias("slot", "node_id"), "shape", *carry)


def local_table(table: dict, shape: Column) -> Column:
    """The local nodes of a shape's parts as an array of arrays; polygons and strips go around their own nodes."""
    out = F.when(F.lit(False), F.array(F.array(F.lit(0))))
    for s, parts in table.items():
        out = out.when(shape == int(s), F.array(*[F.array(*[F.lit(int(n)) for n in p]) for p in parts]))
    return out.otherwise(F.array().cast("array<array<int>>"))


def cell_edges(cells: DataFrame) -> DataFrame:
    """cell_id, slot, a, b with a < b: each cell's edges in local order; polygons have the edges around them."""
    n = F.size("nodes")
    polygon = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(i, (i + 1) % n))
    local = F.when(F.col("shape") == 11, polygon).otherwise(local_table(EDGES, F.col("shape")))
    e = cells.select("cell_id", "nodes", F.posexplode(local).alias("slot", "e"))
    a, b = F.col("nodes")[F.col("e")[0]], F.col("nodes")[F.col("e")[1]]
    return e.select("cell_id", "slot", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def edges(cells: DataFrame) -> DataFrame:
    """edge_id, a, b: numbered by first appearance in cell order, then local order."""
    first = cell_edges(cells).groupBy("a", "b").agg(F.min(F.struct("cell_id", "slot")).alias("f"))
    return dense_ids(first.select("a", "b", "f.*"), "cell_id", "slot", out="edge_id").select("edge_id", "a", "b")


def cell_faces(cells: DataFrame) -> DataFrame:
    """cell_id, slot, key (three smallest node ids), nodes in the cell's order."""
    f = cells.select("cell_id", "nodes", F.posexplode(local_table(FACES, F.col("shape"))).alias("slot", "f"))
    f = f.select("cell_id", "slot", F.transform("f", lambda i: F.col("nodes")[i]).alias("nodes"))
    return f.select("cell_id", "slot", F.slice(F.array_sort("nodes"), 1, 3).alias("key"), "nodes")


def faces(cells: DataFrame) -> DataFrame:
    """face_id, nodes (as the first cell has them), n_cells: numbered by first appearance."""
    g = cell_faces(cells).groupBy("key").agg(F.min(F.struct("cell_id", "slot", "nodes")).alias("m"), F.count(F.lit(1)).alias("n_cells"))
    return dense_ids(g.select("m.*", "n_cells"), "cell_id", "slot", out="face_id").select("face_id", "nodes", "n_cells")


def node_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """node_id, n_cells for every point, untouched ones too."""
    got = incidence(cells).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return points.select("node_id").join(got, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_cells"))


def topology_map(conn: DataFrame, source: DataFrame | None, aggs: dict[str, Column], index: DataFrame | None = None, dst: DataFrame | None = None, out: DataFrame | None = None) -> DataFrame:
    """One map for all families. conn: dst_id, src_id (incidence in either direction), other columns free.

    source (src_id, ...): aggregates run over the rows met; None: over conn alone (destination and info maps).
    dst (dst_id, ...): columns joined to each destination before aggregating (combined maps); with an index it may be dense (dense_id, ...).
    index (dense_id, dst_id): only these destinations, keyed by dense_id in the result (gather, packed); with out given,
    results are put back by dst_id and other rows of out keep their values (scatter, sparse).
    """
    rows = conn if index is None else conn.join(index, "dst_id")
    if dst is not None:
        rows = rows.join(dst, "dense_id" if "dense_id" in dst.columns else "dst_id")
    if source is not None:
        rows = rows.join(source, "src_id")
    key = "dst_id" if index is None or out is not None else "dense_id"
    got = rows.groupBy(key).agg(*(c.alias(n) for n, c in aggs.items()))
    if out is None:
        return got
    got = got.select(F.col("dst_id").alias("_d"), *(F.col(n).alias(f"_{n}") for n in aggs))
    joined = out.join(got, out.dst_id == F.col("_d"), "left")
    return joined.select(*(F.when(F.col("_d").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in aggs else out[c] for c in out.columns))


def tetrahedra(cells: DataFrame) -> DataFrame:
    """cell_id, sub, nodes: the tetrahedra that fill each three-dimensional cell."""
    t = cells.select("cell_id", "nodes", F.posexplode(local_table(TETS, F.col("shape"))).alias("sub", "t"))
    return t.select("cell_id", "sub", F.transform("t", lambda i: F.col("nodes")[i]).alias("nodes"))


def triangles(cells: DataFrame) -> DataFrame:
    """cell_id, sub, nodes: fans of two-dimensional cells; a pixel's second triangle is (1, 3, 2), a strip's follow each other."""
    n = F.size("nodes")
    fan = F.transform(F.sequence(F.lit(1), n - 2), lambda k: F.array(F.lit(0), k, k + 1))
    strip = F.transform(F.sequence(F.lit(0), n - 3), lambda k: F.array(k, k + 1, k + 2))
    pixel = F.array(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3), F.lit(2)))
    local = F.when(F.col("shape") == 4, pixel).when(F.col("shape") == 10, strip).otherwise(fan)
    t = cells.where("shape in (2, 3, 4, 10, 11) and size(nodes) > 2").select("cell_id", "nodes", F.posexplode(local).alias("sub", "t"))
    return t.select("cell_id", "sub", F.transform("t", lambda i: F.col("nodes")[i]).alias("nodes"))
