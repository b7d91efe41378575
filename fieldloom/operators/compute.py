"""Fields computed from fields: recentering, normals, histogram, elevation, transforms, distance fields, atom bonds."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import vector as v3
from fieldloom.shared import settle

from .topology import incidence

#: Points of a cloud that may be handed to every task as one array.
SMALL_CLOUD = 4096


def recenter(points: DataFrame, cells: DataFrame, field: str, out: str | None = None, ncomp: int = 1) -> DataFrame:
    """node_id and the mean of the incident cells' values, 0 without any; of a field of several components, an array of their means."""
    out = out or f"nodecentered_{field}"
    part = [F.col(field).cast("double")] if ncomp == 1 else [F.col(field)[k].cast("double") for k in range(ncomp)]
    got = incidence(cells, field).groupBy("node_id").agg(*(F.avg(p).alias(f"_m{k}") for k, p in enumerate(part)))
    mean = [F.coalesce(f"_m{k}", F.lit(0.0)) for k in range(ncomp)]
    return points.select("node_id").join(got, "node_id", "left").select("node_id", (mean[0] if ncomp == 1 else F.array(*mean)).alias(out))


def corners(cells: DataFrame, points: DataFrame, n: int, *cols: str) -> DataFrame:
    """cell_id and p0..p<n-1>, structs of the columns of each cell's first nodes; one join and one grouping, whatever n."""
    inc = incidence(cells.where(F.size("nodes") >= n)).where(F.col("slot") < n)
    rows = inc.join(points.select("node_id", F.struct(*cols).alias("p")), "node_id")
    return rows.groupBy("cell_id").agg(*(F.max(F.when(F.col("slot") == k, F.col("p"))).alias(f"p{k}") for k in range(n)))


def surface_normals(cells: DataFrame, points: DataFrame) -> DataFrame:
    """cell_id, nx, ny, nz: unit vector of (p1 - p0) x (p2 - p1); null for a degenerate cell."""
    c = corners(cells, points, 3, "x", "y", "z")
    p = [v3.of(F.col(f"p{k}")) for k in range(3)]
    n = v3.cross(v3.sub(p[1], p[0]), v3.sub(p[2], p[1]))
    return c.select("cell_id", *(x.alias(a) for x, a in zip(v3.normalize(n), ("nx", "ny", "nz"))))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, low, high, n: equal bins [low, high) between least and largest value, the last closed; empty bins have 0.

    One pass for the range and one for the counts, which are summed before they are moved.
    """
    spark = df.sparkSession
    r = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.greatest(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0))
    n = df.where(F.col(value).isNotNull()).select(value).join(F.broadcast(r)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("_n"))  # r is one row
    edges = spark.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(r)).select("bin", (F.col("lo") + width * F.col("bin")).alias("low"), (F.col("lo") + width * (F.col("bin") + 1)).alias("high"))
    return edges.join(F.broadcast(n), "bin", "left").select("bin", "low", "high", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def elevate(points: DataFrame, field: str, axis: str = "z") -> DataFrame:
    return points.withColumn(axis, F.col(field).cast("double"))


def transform(points: DataFrame, matrix: np.ndarray, eager: bool = False) -> DataFrame:
    """x, y, z by a 4x4 matrix with the division by w; the projection is lazy unless the caller stores it."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    row = lambda r: F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3]))
    affine = np.array_equal(matrix[3], [0, 0, 0, 1])
    w = F.lit(1.0) if affine else row(matrix[3])
    out = [row(matrix[k]) if affine else F.when(w != 0, row(matrix[k]) / w) for k in range(3)]
    return points.withColumns(dict(zip("xyz", out)))


def distance_field(nodes: DataFrame, cloud: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), out: str = "dist", cell: float | None = None) -> DataFrame:
    """nodes with the least Euclidean distance to the cloud (-1 if it is empty); exact.

    A cloud of at most SMALL_CLOUD points (counted) is one array that each task folds over. A larger one is binned: each node looks
    in its bin and the bins around it, and only nodes without a certain answer look again in bins twice as wide. A node without a
    coordinate has no distance (null); equal rows stay rows of their own; no nodes give no rows.
    """
    spark = nodes.sparkSession
    n = cloud.count()
    if n == 0:
        return nodes.withColumn(out, F.lit(-1.0))
    square = lambda a, b: sum(((a[x] - b[x]) * (a[x] - b[x]) for x in axes), F.lit(0.0))
    if n <= SMALL_CLOUD:
        one = cloud.agg(F.collect_list(F.struct(*(F.col(a).cast("double").alias(a) for a in axes))).alias("_c"))
        me = {a: F.col(a) for a in axes}
        d = F.aggregate("_c", F.lit(float("inf")), lambda best, p: F.least(best, square(me, p)))
        return nodes.join(F.broadcast(one)).withColumn(out, F.sqrt(d)).drop("_c")
    r = nodes.agg(*(F.min(a).alias(f"l{a}") for a in axes), *(F.max(a).alias(f"h{a}") for a in axes)).first()
    c = cloud.agg(*(F.min(a).alias(f"l{a}") for a in axes), *(F.max(a).alias(f"h{a}") for a in axes)).first()
    if any(v is None for v in r):
        return nodes.withColumn(out, F.lit(None).cast("double"))
    span = max(max(r[f"h{a}"], c[f"h{a}"]) - min(r[f"l{a}"], c[f"l{a}"]) for a in axes) or 1.0
    width = cell or span / max(1.0, n ** (1 / len(axes)))
    # rows are known by a number, so that equal rows stay apart; each round is written down and looks only at what is left
    rows = settle(spark, nodes.select(F.struct("*").alias("row"), *(F.col(a).cast("double").alias(a) for a in axes)).withColumn("at", F.monotonically_increasing_id()), "nodes")
    points = cloud.select(*(F.col(a).cast("double").alias(f"c{a}") for a in axes))
    todo, found = rows.select("at", *axes), []
    while True:
        bins = lambda pre: [F.floor(F.col(pre + a) / width) for a in axes]
        around = todo
        for k, b in enumerate(bins("")):  # a node asks its own bin and those around it
            around = around.withColumn(f"b{k}", F.explode(F.array(*[b + F.lit(o) for o in (-1, 0, 1)])))
        here = points.withColumns({f"p{k}": b for k, b in enumerate(bins("c"))})
        near = around.join(here, [F.col(f"b{k}") == F.col(f"p{k}") for k in range(len(axes))])
        d = F.sqrt(square({a: F.col(a) for a in axes}, {a: F.col(f"c{a}") for a in axes}))
        got = settle(spark, near.groupBy("at").agg(F.min(d).alias("d")), "near")
        last = width >= span * 2
        found.append(got if last else got.where(F.col("d") <= width))
        if not last:
            todo, width = settle(spark, todo.join(found[-1], "at", "left_anti"), "todo"), width * 2
        if last or todo.isEmpty():
            return rows.join(reduce(DataFrame.union, found), "at", "left").select("row.*", F.col("d").alias(out))


def distance_pairs(points: DataFrame, id_col: str, cutoff: float, axes: tuple[str, ...] = ("x", "y", "z"), *carry: str) -> DataFrame:
    """a, b (a < b), dist of points nearer than cutoff: one side is sent to the bins around its own, then an equi-join on bins."""
    key = lambda p: [F.floor(F.col(f"{p}{x}") / cutoff).cast("long") for x in axes]
    keep = [id_col, *axes, *carry]
    left = points.select(*(F.col(c).alias(f"l_{c}") for c in keep))
    right = points.select(*(F.col(c).alias(f"r_{c}") for c in keep)).withColumn("_bin", F.array(*key("r_")))
    around = left.withColumn("_b", F.array(*key("l_")))
    for k in range(len(axes)):
        around = around.withColumn(f"_o{k}", F.explode(F.array(*[F.lit(o) for o in (-1, 0, 1)])))
    around = around.withColumn("_near", F.array(*[F.col("_b")[k] + F.col(f"_o{k}") for k in range(len(axes))]))
    d = F.sqrt(sum(((F.col(f"l_{x}") - F.col(f"r_{x}")) * (F.col(f"l_{x}") - F.col(f"r_{x}")) for x in axes), F.lit(0.0)))
    j = around.join(right, (F.col("_near") == F.col("_bin")) & (F.col(f"l_{id_col}") < F.col(f"r_{id_col}"))).withColumn("dist", d).where(F.col("dist") < cutoff)
    return j.select(F.col(f"l_{id_col}").alias("a"), F.col(f"r_{id_col}").alias("b"), "dist", *(F.col(f"{p}_{c}").alias(f"{q}_{c}") for c in carry for p, q in (("l", "a"), ("r", "b"))))


def bonds(atoms: DataFrame, id_col: str = "node_id", element: str = "element", hydrogen: float = 1.2, other: float = 1.9, least: float = 0.4, most_each: int | None = None) -> DataFrame:
    """a, b, dist of bonded atoms: least < d < hydrogen if either is H, else least < d < other; most_each: only that many bonds from the lower atom."""
    from pyspark.sql import Window

    p = distance_pairs(atoms, id_col, other, ("x", "y", "z"), element)
    is_h = (F.col(f"a_{element}") == "H") | (F.col(f"b_{element}") == "H")
    out = p.where((F.col("dist") > least) & (F.col("dist") < F.when(is_h, hydrogen).otherwise(other))).select("a", "b", "dist")
    if most_each:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("_n") <= most_each).drop("_n")
    return out


def points_in_triangles(points: DataFrame, tris: DataFrame, value: str | None = None, cell: float = 1.0) -> DataFrame:
    """point_id, cell_id, u, v, w of the first triangle (ax..cy) that holds each point (x, y); value: its interpolation from va, vb, vc.

    Triangles are sent to the bins that their boxes touch, points to their own.
    """
    bin_ = lambda c: F.floor(c / cell).cast("long")
    lo, hi = (lambda a: F.least(f"a{a}", f"b{a}", f"c{a}")), (lambda a: F.greatest(f"a{a}", f"b{a}", f"c{a}"))
    t = tris.withColumn("_bx", F.explode(F.sequence(bin_(lo("x")), bin_(hi("x"))))).withColumn("_by", F.explode(F.sequence(bin_(lo("y")), bin_(hi("y")))))
    p = points.withColumn("_px", bin_(F.col("x"))).withColumn("_py", bin_(F.col("y")))
    j = p.join(t, (F.col("_px") == F.col("_bx")) & (F.col("_py") == F.col("_by")))
    u, v, w = barycentric(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by", "cx", "cy")))
    j = j.withColumns({"u": u, "v": v, "w": w}).where("u between 0 and 1 and v between 0 and 1 and w between 0 and 1")
    more = [(F.col("u") * F.col("va") + F.col("v") * F.col("vb") + F.col("w") * F.col("vc")).alias(value)] if value else []
    got = j.select("point_id", F.struct("cell_id", "u", "v", "w", *more).alias("m")).groupBy("point_id").agg(F.min("m").alias("m"))
    return got.select("point_id", "m.*")


def barycentric(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """Weights of a, b, c at (x, y); null for a degenerate triangle."""
    d = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    u = F.when(d != 0, ((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / d)
    v = F.when(d != 0, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / d)
    return u, v, F.lit(1.0) - u - v


def tet_barycentric(p: list[Column], corners_: list[list[Column]]) -> list[Column]:
    """Four weights of a point in a tetrahedron by determinants; null if it is flat."""
    a, b, c, d = corners_
    det = lambda o, q, r, s: v3.dot(v3.sub(q, o), v3.cross(v3.sub(r, o), v3.sub(s, o)))
    whole = det(a, b, c, d)
    parts = [det(p, b, c, d), -det(p, a, c, d), det(p, a, b, d), -det(p, a, b, c)]
    return [F.when(whole != 0, x / whole) for x in parts]


def revolve(points: DataFrame, triangles: DataFrame, planes: int, n_points: int) -> tuple[DataFrame, DataFrame]:
    """Points (r, z) and triangles turned about the axis: planes copies of the points, and wedges between neighbours, the last to the first."""
    turned = points.withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(planes - 1))))
    phi = F.col("plane") * F.lit(2 * math.pi / planes)
    p = turned.select((F.col("plane") * n_points + F.col("node_id")).cast("long").alias("node_id"), (F.col("r") * F.cos(phi)).alias("x"), (F.col("r") * F.sin(phi)).alias("y"), "z")
    t = triangles.withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(planes - 1))))
    here, there = F.col("plane") * n_points, ((F.col("plane") + 1) % planes) * n_points
    nodes = F.concat(F.transform("nodes", lambda n: n + here), F.transform("nodes", lambda n: n + there))
    n_tris = triangles.count()
    return p, t.select((F.col("plane") * n_tris + F.col("cell_id")).cast("long").alias("cell_id"), F.lit(7).alias("shape"), nodes.cast("array<long>").alias("nodes"))


def torus_particles(particles: DataFrame) -> DataFrame:
    """Particles given by r, phi (radians) and z, with x and y; the other columns stay."""
    return particles.withColumns({"x": F.col("r") * F.cos("phi"), "y": F.col("r") * F.sin("phi")}).drop("r", "phi")
