"""Filters that make geometry: isosurfaces, tessellation, force-directed layout."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.matrix import legendre as legendre_number
from fieldloom.model import DIMENSION, EDGES, FACES, Shape

from .compute import corners
from .primitives import dense_ids, scan
from .topology import incidence, local_table, triangles


@functools.lru_cache
def case_table(shape: int) -> dict[int, list[tuple[int, ...]]]:
    """For each case (bit k: node k is below the value) the pieces, as local edges: points, lines or triangles.

    Derived, not listed: on each face (a two-dimensional cell is its own face) crossed edges are joined so that each run of low
    corners is cut off by itself, which both cells at a face decide alike; the lines close to loops, and loops are cut to fans.
    """
    s = Shape(shape)
    edges = EDGES[s]
    number = {frozenset(e): i for i, e in enumerate(edges)}
    dim = DIMENSION[s]
    n = max(max(e) for e in edges) + 1
    if dim == 1:
        return {1: [(0,)], 2: [(0,)]}
    ring = [edges[0][0]]
    if dim == 2:
        for a, b in edges:
            ring.append(b if a == ring[-1] else a)
        faces = [tuple(ring[:-1])]
    else:
        faces = FACES[s]

    def lines(face: tuple[int, ...], case: int) -> list[tuple[int, int]]:
        low = [case >> k & 1 for k in face]
        m, out = len(face), []
        for i in range(m):
            if low[i] and not low[i - 1]:  # a run of low corners starts: from its first edge to its last
                j = i
                while low[(j + 1) % m]:
                    j += 1
                out.append((number[frozenset((face[i - 1], face[i]))], number[frozenset((face[j % m], face[(j + 1) % m]))]))
        return out

    table = {}
    for case in range(1, (1 << n) - 1):
        segments = [x for f in faces for x in lines(f, case)]
        if dim == 2:
            table[case] = segments
            continue
        after: dict[int, list[int]] = {}
        for a, b in segments:
            after.setdefault(a, []).append(b)
            after.setdefault(b, []).append(a)
        left, pieces = {frozenset(x) for x in segments}, []
        while left:
            start = min(min(x) for x in left)
            loop, at = [start], start
            while True:
                to = next((x for x in after[at] if frozenset((at, x)) in left), None)
                if to is None:
                    break
                left.discard(frozenset((at, to)))
                at = to
                if at == start:
                    break
                loop.append(at)
            pieces += [(loop[0], loop[k], loop[k + 1]) for k in range(1, len(loop) - 1)]
        table[case] = pieces
    return table


def case_rows(shapes: set[int]) -> list[tuple[int, int, int, list[int]]]:
    return [(s, case, sub, list(p)) for s in sorted(shapes) for case, pieces in case_table(s).items() for sub, p in enumerate(pieces)]


def cases(cells: DataFrame, points: DataFrame, field: str, value: float) -> DataFrame:
    """cell_id, shape, case_id, n of cells: bit k is set if node k's value is below."""
    below = points.select("node_id", (F.col(field) < value).cast("long").alias("lo"))
    part = [c for c in ("part",) if c in cells.columns]
    inc = incidence(cells, *part).join(below, "node_id")
    return inc.groupBy("cell_id", *part, "shape").agg(F.sum(F.expr("shiftleft(lo, slot)")).alias("case_id"), F.count(F.lit(1)).alias("n"))


def isosurface(points: DataFrame, cells: DataFrame, field: str, value: float, nodal: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(points, cells) of the surface where field is value; points are one per crossed edge, cells points, lines or triangles.

    points: point_id, a, b (edge's nodes), alpha, and each of `nodal` (coordinates and fields) between its ends.
    cells: cell_id (of the input), sub, shape (point, beam or triangle), nodes (point ids), and the input cells' columns `carry`.
    Only cells that the surface crosses are looked at after the first grouping; the case table is broadcast (at most 256 cases a shape).
    Polygons and strips are cut by their triangles (sub counts these), points are never crossed, cells of unknown shape raise.
    """
    spark = cells.sparkSession
    shapes = {r.shape for r in cells.select("shape").distinct().collect()}
    if int(Shape.OTHER) in shapes:
        raise ValueError("a cell of unknown shape has no surface")
    have = shapes & {int(s) for s in EDGES}
    fans = shapes & {int(Shape.POLYGON), int(Shape.TRISTRIP)}
    cells = cells.withColumn("part", F.lit(0))
    if fans:
        flat = triangles(cells.where(F.col("shape").isin(*fans))).select(F.col("cell_id").alias("of"), F.col("sub").alias("part"), F.col("nodes").alias("three"))
        flat = cells.drop("part").join(flat, F.col("cell_id") == F.col("of")).withColumns({"shape": F.lit(int(Shape.TRI)), "nodes": F.col("three")}).drop("of", "three")
        cells, have = cells.where(~F.col("shape").isin(*fans)).unionByName(flat), have | {int(Shape.TRI)}
    table = F.broadcast(spark.createDataFrame(case_rows(have), "shape int, case_id long, sub int, local array<int>"))
    crossed = cases(cells, points, field, value).where("case_id > 0 and case_id < shiftleft(1L, int(n)) - 1").select("cell_id", "part", "case_id")
    mixed = cells.join(crossed, ["cell_id", "part"])
    pieces = mixed.join(table, ["shape", "case_id"]).select("cell_id", (F.col("part") + F.col("sub")).alias("sub"), "shape", "nodes", F.posexplode("local").alias("at", "edge"), *carry)
    e = local_table(EDGES, F.col("shape"))[F.col("edge")]
    p, q = F.col("nodes")[e[0]], F.col("nodes")[e[1]]
    pieces = pieces.select("cell_id", "sub", "at", F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), *carry)
    names = list(dict.fromkeys((field, *nodal)))
    ends = points.select("node_id", *(F.col(c).cast("double").alias(c) for c in names))
    edges = dense_ids(pieces.select("a", "b").distinct(), "a", "b", out="point_id")
    out = edges
    for side in "ab":
        out = out.join(ends.select(F.col("node_id").alias(side), F.struct(*names).alias(f"v{side}")), side)
    alpha = (F.lit(float(value)) - F.col("va")[field]) / (F.col("vb")[field] - F.col("va")[field])
    out = out.withColumn("alpha", alpha)
    mix = [(F.col("va")[c] + (F.col("vb")[c] - F.col("va")[c]) * F.col("alpha")).alias(c) for c in nodal]
    joined = pieces.join(edges, ["a", "b"]).groupBy("cell_id", "sub", *carry).agg(F.array_sort(F.collect_list(F.struct("at", "point_id"))).alias("ps"))
    return out.select("point_id", "a", "b", "alpha", *mix), joined.select("cell_id", "sub", (F.size("ps") - 1).alias("shape"), F.transform("ps", lambda x: x["point_id"]).alias("nodes"), *carry)


def legendre_values(points: DataFrame, cells: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """cell_id, at (0: centroid, 1-4: middles of the edges, 5-8: corners in order) and each field of nine Legendre coefficients evaluated there.

    Cells are quadrilaterals; values are divided by the longer side of the first edge's box, as such trees scale them. Others raise.
    """
    sides = corners(cells, points, 2, "x", "y")
    p, q = F.col("p0"), F.col("p1")
    size = F.greatest(F.abs(q["x"] - p["x"]), F.abs(q["y"] - p["y"]))
    at = [(0, 0), (0, -1), (1, 0), (0, 1), (-1, 0), (-1, -1), (1, -1), (1, 1), (-1, 1)]
    weights = [[float(legendre_number(i, x) * legendre_number(j, y)) for i in range(3) for j in range(3)] for x, y in at]
    quad = F.col("shape").isin(int(Shape.QUAD), int(Shape.PIXEL)) | ((F.col("shape") == int(Shape.POLYGON)) & (F.size("nodes") == 4))
    flat = cells.where("shape in (2, 3, 4, 11)").select("cell_id", *(F.when(quad, F.col(f)).otherwise(F.raise_error(F.lit("Legendre fields need quadrilaterals"))).alias(f) for f in fields))
    value = lambda f, w: sum((F.col(f)[k] * F.lit(x) for k, x in enumerate(w) if x), F.lit(0.0)) / size
    all_ = F.array(*[F.struct(F.lit(n).alias("at"), *(value(f, w).alias(f) for f in fields)) for n, w in enumerate(weights)])
    return flat.join(sides, "cell_id").select("cell_id", F.explode(all_).alias("v")).select("cell_id", "v.*")


#: Points (and their cells, of about the same number) that one task of a tessellation takes.
TASK_POINTS = 200_000


def _spread(df: DataFrame, n_points: int, key: str) -> DataFrame:
    """df dealt by the key to as many tasks as n_points need, so that a task's memory does not grow with the input; not fewer than the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-n_points // TASK_POINTS)), key)


def tessellate(points: DataFrame, cells: DataFrame, n_points: int, nodal: tuple[str, ...] = ("x", "y", "z"), legendre: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(points, quads): each two-dimensional cell is cut into a quad per edge by its centroid and its own edge midpoints.

    New ids start at n_points; by cell: the centroid, then midpoints in edge order. Quad j: centroid, midpoint j, the corner
    after it, midpoint j + 1. New points' values are means of their nodes'. legendre: cell fields of nine coefficients, which become
    nodal fields by evaluation (at a node of several cells, the last cell's).
    """
    n = F.size("nodes")
    ring = F.when(F.col("shape") == int(Shape.PIXEL), F.array(*[F.col("nodes")[k] for k in (0, 1, 3, 2)])).otherwise(F.col("nodes"))
    flat = cells.where("shape in (2, 3, 4, 11)").select("cell_id", ring.alias("ring"), n.cast("long").alias("n"), (n + 1).cast("long").alias("new"))
    flat = scan(flat, "cell_id", "new", inclusive=False, out="first").withColumn("first", F.col("first") + n_points)
    rows = flat.select("cell_id", "n", "first", F.posexplode("ring").alias("k", "node_id"))
    own = _spread(points.select("node_id", *nodal), n_points, "node_id")
    at = _spread(rows, n_points, "node_id").join(own.select("node_id", F.struct(*nodal).alias("v")), "node_id")
    # each corner counts for the centroid and for the midpoints of the edges before and after it
    to = F.array(F.col("first"), F.col("first") + 1 + F.col("k"), F.col("first") + 1 + (F.col("k") + F.col("n") - 1) % F.col("n"))
    # a new node is of one cell: corners are dealt by cells before they are copied
    new = _spread(at, n_points, "cell_id").select("cell_id", F.explode(to).alias("node_id"), "v").groupBy("cell_id", "node_id").agg(*(F.avg(F.col("v")[c]).alias(c) for c in nodal)).drop("cell_id")
    quads = rows.join(flat.select("cell_id", "ring"), "cell_id").select(
        "cell_id", F.col("k").alias("sub"), F.lit(int(Shape.QUAD)).alias("shape"),
        F.array(F.col("first"), F.col("first") + 1 + F.col("k"), F.col("ring")[((F.col("k") + 1) % F.col("n")).cast("int")], F.col("first") + 1 + (F.col("k") + 1) % F.col("n")).alias("nodes"),
    )
    out = points.select("node_id", *nodal).unionByName(new)
    if legendre:
        values = _spread(legendre_values(_spread(points, n_points, "node_id"), cells, legendre), n_points, "cell_id").join(_spread(flat.select("cell_id", "ring", "first"), n_points, "cell_id"), "cell_id")
        node = F.when(F.col("at") < 5, F.col("first") + F.col("at")).otherwise(F.get("ring", F.col("at") - 5))
        values = _spread(values.select(node.alias("node_id"), "cell_id", *legendre), n_points, "node_id")
        last = values.groupBy("node_id").agg(F.max_by(F.struct(*legendre), "cell_id").alias("v")).select("node_id", "v.*")
        out = _spread(out, n_points, "node_id").join(last, "node_id", "left")
    return out, quads


#: Nodes whose places one task may hold while it sums their pushes.
LAYOUT_NODES = 2_000_000


def pushes(own: np.ndarray, xy: np.ndarray, k: float, rows: int = 64, cols: int = 256) -> np.ndarray:
    """The sum of d k^2 / d.d over all places for each of own. Pairs are met in tiles that stay in a processor's cache, in buffers used again."""
    out, (x, y) = np.zeros((len(own), 2)), np.ascontiguousarray(xy.T)
    buffers = np.empty((4, rows, cols))
    for j in range(0, len(own), rows):
        mine = own[j : j + rows]
        for c in range(0, len(x), cols):
            dx, dy, w, z = buffers[:, : len(mine), : len(x[c : c + cols])]
            np.subtract(mine[:, :1], x[c : c + cols], out=dx)
            np.subtract(mine[:, 1:], y[c : c + cols], out=dy)
            np.multiply(dx, dx, out=w)
            np.multiply(dy, dy, out=z)
            np.maximum(np.add(w, z, out=w), 1e-12, out=w)
            np.divide(k * k, w, out=w)
            out[j : j + rows, 0] += np.einsum("ij,ij->i", dx, w)
            out[j : j + rows, 1] += np.einsum("ij,ij->i", dy, w)
    return out


def graph_layout(nodes: DataFrame, edges: DataFrame, rounds: int = 100, start: float = 1.0, final: float = 0.005, area: float = 1.0, gravity: float = 0.3, seed: int = 1) -> DataFrame:
    """node_id, newx, newy by Fruchterman-Reingold with gravity; edges (a, b). Places start from a hash of the id and the seed.

    Every pair of nodes pushes, so a round is quadratic by definition: rows are spread over tasks, and each task has all places
    (16 bytes a node, at most LAYOUT_NODES nodes, counted first). Places are written down each round, which keeps lineage short.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    if n > LAYOUT_NODES:
        raise ValueError(f"{n} nodes; a layout takes at most {LAYOUT_NODES}")
    if not n:
        return spark.createDataFrame([], "node_id long, newx double, newy double")
    u = lambda salt: F.pmod(F.xxhash64("node_id", F.lit(seed), F.lit(salt)), F.lit(1 << 20)) / float(1 << 20) - 0.5
    place = nodes.select("node_id", u(1).alias("x"), u(2).alias("y")).orderBy("node_id").toPandas()  # bounded above
    k = float(np.sqrt(area / n))
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").groupBy("a").agg(F.collect_list("b").alias("to"))
    rows = nodes.select("node_id").join(both, F.col("node_id") == F.col("a"), "left").select("node_id", "to").repartition(max(1, min(n // 200, spark.sparkContext.defaultParallelism * 4))).persist()
    for r in range(rounds):
        limit = start * (final / start) ** (r / max(rounds - 1, 1))
        shared = spark.sparkContext.broadcast((place.node_id.to_numpy(), place[["x", "y"]].to_numpy()))

        def step(batches, shared=shared, limit=limit):
            ids, xy = shared.value
            for pdf in batches:
                at = np.searchsorted(ids, pdf.node_id.to_numpy())
                move = pushes(xy[at], xy, k)
                lens = np.array([0 if to is None else len(to) for to in pdf.to])
                if lens.sum():
                    of = np.repeat(np.arange(len(pdf)), lens)
                    pull = xy[np.searchsorted(ids, np.concatenate([to for to in pdf.to if to is not None]))] - xy[at[of]]
                    np.add.at(move, of, pull * (np.sqrt((pull**2).sum(1)) / k)[:, None])
                move -= gravity / k * xy[at]
                size = np.sqrt((move**2).sum(1))
                out = xy[at] + move / np.maximum(size, 1e-12)[:, None] * np.minimum(size, limit)[:, None]
                yield pd.DataFrame({"node_id": pdf.node_id, "x": out[:, 0], "y": out[:, 1]})

        place = rows.mapInPandas(step, "node_id long, x double, y double").orderBy("node_id").toPandas()
        shared.unpersist()
    rows.unpersist()
    return spark.createDataFrame(place.rename(columns={"x": "newx", "y": "newy"}))


__all__ = ["case_table", "cases", "graph_layout", "isosurface", "tessellate"]
