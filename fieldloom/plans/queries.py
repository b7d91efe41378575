"""One registered query per operator, with its SQL twin where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import model
from fieldloom.functions import chemistry as ch, colors, grid as g, matrix as mx
from fieldloom.model import EDGES, Shape
from fieldloom.shared import settle
from fieldloom.operators import compute as cp, geometry as geo, primitives as pr, rays as ry, select as sel, topology as tp

from .relmesh import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- pieces of SQL: the meshes of relmesh ----------------------------------------------------------

G2 = """
g2n AS (SELECT o_orderkey AS node_id, o_orderkey % 100 AS i, o_orderkey // 100 AS j, o_totalprice AS v FROM orders WHERE o_orderkey < (SELECT count(*) // 100 * 100 FROM orders)),
g2c AS (SELECT c AS cell_id, c % 99 + 100 * (c // 99) AS b FROM (SELECT unnest(range(99 * ((SELECT count(*) // 100 FROM orders) - 1))) AS c)),
g2i AS (SELECT cell_id, o.slot, b + o.d AS node_id FROM g2c, (VALUES (0, 0), (1, 1), (2, 100), (3, 101)) o(slot, d))"""
G3 = """
g3n AS (SELECT p_partkey AS node_id, p_partkey % 10 AS i, (p_partkey // 10) % 10 AS j, p_partkey // 100 AS k, p_retailprice AS v, p_size AS size FROM part WHERE p_partkey < (SELECT count(*) // 100 * 100 FROM part)),
g3d AS (SELECT count(*) // 100 AS nz FROM part),
g3c AS (SELECT c AS cell_id, c % 9 + 10 * ((c // 9) % 9) + 100 * (c // 81) AS b FROM (SELECT unnest(range(81 * ((SELECT nz FROM g3d) - 1))) AS c)),
g3i AS (SELECT cell_id, o.slot, b + o.d AS node_id FROM g3c, (VALUES (0, 0), (1, 1), (2, 10), (3, 11), (4, 100), (5, 101), (6, 110), (7, 111)) o(slot, d))"""
GRAPH = """
gr AS (SELECT l_partkey * 100000 + l_suppkey AS cell_id, l_partkey AS a, l_suppkey + (SELECT count(*) FROM part) AS b, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY l_partkey, l_suppkey),
grn AS (SELECT p_partkey AS node_id FROM part UNION ALL SELECT s_suppkey + (SELECT count(*) FROM part) FROM supplier)"""
CLOUD = "cl AS (SELECT s_suppkey AS node_id, s_acctbal / 1000 AS x, CAST(s_suppkey % 10 AS DOUBLE) AS y, CAST(s_nationkey AS DOUBLE) AS z FROM supplier)"
RAYS = """
r0 AS (SELECT r AS ray_id, 0.05 * ((2 * (r % 40) - 40) / 2.0) AS x, 0.05 * ((2 * (r // 40) - 30) / 2.0) AS y FROM (SELECT unnest(range(1200)) AS r)),
rays AS (SELECT ray_id, 5.0::DOUBLE AS ox, 5.0::DOUBLE AS oy, (-5.0)::DOUBLE AS oz, x::DOUBLE / sqrt(x * x + y * y + 1.0) AS dx, y::DOUBLE / sqrt(x * x + y * y + 1.0) AS dy, 1.0 / sqrt(x * x + y * y + 1.0) AS dz FROM r0)"""
TRIS = """
t0 AS (SELECT p_partkey AS idx, CAST(p_partkey % 10 AS DOUBLE) AS ax, CAST((p_partkey // 10) % 10 AS DOUBLE) AS ay, 5 + p_size / 10.0::DOUBLE AS az FROM part),
tris AS (SELECT *, ax + 0.9::DOUBLE AS bx, ay AS by_, az + 0.1::DOUBLE AS bz, ax AS cx, ay + 0.9::DOUBLE AS cy, az + 0.2::DOUBLE AS cz FROM t0)"""


def tri_hits(rays: str, more: str = "ray_id") -> str:
    """CTEs th(ray columns, idx, t, u, v): all hits of a table of rays."""
    return f"""
x1 AS (SELECT r.*, t.*, bx - ax AS e1x, by_ - ay AS e1y, bz - az AS e1z, cx - ax AS e2x, cy - ay AS e2y, cz - az AS e2z, ox - ax AS tx, oy - ay AS ty, oz - az AS tz FROM {rays} r, tris t),
x2 AS (SELECT *, dy * e2z - dz * e2y AS px_, dz * e2x - dx * e2z AS py_, dx * e2y - dy * e2x AS pz_, ty * e1z - tz * e1y AS qx, tz * e1x - tx * e1z AS qy, tx * e1y - ty * e1x AS qz FROM x1),
x3 AS (SELECT *, e1x * px_ + e1y * py_ + e1z * pz_ AS det FROM x2),
x4 AS (SELECT *, (tx * px_ + ty * py_ + tz * pz_) * (1.0 / det) AS u, (dx * qx + dy * qy + dz * qz) * (1.0 / det) AS v, (e2x * qx + e2y * qy + e2z * qz) * (1.0 / det) AS t FROM x3 WHERE abs(det) > 1e-9),
th AS (SELECT * FROM x4 WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t > 1e-9 AND t < 1e6)"""


NEAR = "nh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, idx) AS rn FROM th) WHERE rn = 1)"


# --- 2.2 per-element -------------------------------------------------------------------------------

for _op, _sign in {"add": "+", "sub": "-", "mul": "*"}.items():
    query(f"SELECT l_orderkey, l_linenumber, l_extendedprice {_sign} l_quantity AS value FROM lineitem", f"map_binary_{_op}")(
        lambda t, op=_op: t.lineitem.select("l_orderkey", "l_linenumber", pr.binary(op, F.col("l_extendedprice"), F.col("l_quantity")).alias("value"))
    )
for _op, _fn in {"max": "greatest", "min": "least"}.items():
    query(f"SELECT l_orderkey, l_linenumber, {_fn}(l_quantity, l_discount * 100) AS value FROM lineitem", f"map_binary_{_op}")(
        lambda t, op=_op: t.lineitem.select("l_orderkey", "l_linenumber", pr.binary(op, F.col("l_quantity"), F.col("l_discount") * 100).alias("value"))
    )
query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS value FROM lineitem", "map_binary_div")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", pr.binary("div", F.col("l_extendedprice"), F.col("l_discount")).alias("value"))
)
_UNARY = {"neg": "-v", "square": "v * v", "cube": "v * v * v", "log10": "CASE WHEN v > 0 THEN log10(v) END", "log2": "CASE WHEN v > 0 THEN log2(v) END", "ln": "CASE WHEN v > 0 THEN ln(v) END", "sqrt": "CASE WHEN v >= 0 THEN sqrt(v) END"}
for _op, _e in _UNARY.items():
    _col = "c_acctbal" if _op in ("neg", "square", "ln", "sqrt") else "c_acctbal / 1000"
    query(f"SELECT c_custkey, round({_e}, 6) + 0.0 AS value FROM (SELECT c_custkey, {_col} AS v FROM customer)", f"map_unary_{_op}")(
        lambda t, op=_op, col=_col: t.customer.select("c_custkey", r6(pr.unary(op, F.expr(col))).alias("value"))
    )


@query("SELECT o_orderkey, o_totalprice < 100000 AS below, o_custkey <> o_orderkey AS differs FROM orders")
def map_compare(t):
    return t.orders.select("o_orderkey", pr.less_than(F.col("o_totalprice"), 100000).alias("below"), pr.not_equal(F.col("o_custkey"), F.col("o_orderkey")).alias("differs"))


@query("SELECT o_orderkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def gather(t):
    return pr.gather(t.orders.select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_acctbal"), "o_custkey", "c_custkey").select("o_orderkey", "c_acctbal")


@query("SELECT c_custkey, coalesce(x.v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) x ON c_custkey = x.o_custkey")
def scatter_keep(t):
    source = t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("c_acctbal"))
    return pr.scatter(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", source, "o_custkey", "o_orderkey", ["c_acctbal"])


@query("SELECT c_custkey, x.v AS price FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) x ON c_custkey = x.o_custkey")
def scatter(t):
    out = t.customer.select("c_custkey", F.lit(None).cast("double").alias("price"))
    return pr.scatter(out, "c_custkey", t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price")), "o_custkey", "o_orderkey", ["price"])


@query("SELECT p_partkey * 4 + s AS id, CAST(p_size * 10 + s AS BIGINT) AS value FROM part, (SELECT unnest(range(4)) AS s)")
def expand_1ton(t):
    return pr.expand(t.part.select("p_partkey", "p_size"), 4).select((F.col("p_partkey") * 4 + F.col("sub")).cast("long").alias("id"), (F.col("p_size") * 10 + F.col("sub")).cast("long").alias("value"))


@query("SELECT p_partkey // 8 AS p_partkey, avg(CAST(p_size AS DOUBLE)) AS p_size FROM part GROUP BY 1")
def reduce_nto1(t):
    return pr.average_runs(t.part, "p_partkey", "p_size", 8)


@query("SELECT p_partkey, s AS sub FROM part, (SELECT unnest(range(4)) AS s) WHERE s < p_size % 4")
def reverse_index(t):
    return pr.reverse_index(t.part.select("p_partkey", (F.col("p_size") % 4).alias("n")), "n").select("p_partkey", F.col("sub").cast("long").alias("sub"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS dense FROM part WHERE p_size > 25")
def simple_reverse_index(t):
    return pr.compact(t.part.select("p_partkey", "p_size"), F.col("p_size") > 25, "p_partkey").select("p_partkey", "dense")


@query("SELECT p_partkey, ((p_partkey // 10) % 10) * 3 + 1 AS at FROM part")
def strided_view(t):
    return t.part.select("p_partkey", pr.strided(F.col("p_partkey"), 10, 10, 3, 1).cast("long").alias("at"))


# --- 2.3 collective --------------------------------------------------------------------------------


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem")
def reduce_all(t):
    return t.lineitem.agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"), F.count(F.lit(1)).alias("n"))


def _cents(t):
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


for _name, _frame, _inc in (("scan_inclusive", "CURRENT ROW", True), ("scan_exclusive", "1 PRECEDING", False)):
    query(f"SELECT o_orderkey, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND {_frame}), 0) AS BIGINT) AS scan FROM orders", _name)(
        lambda t, inc=_inc: pr.scan(_cents(t), "o_orderkey", "cents", inc).select("o_orderkey", "scan")
    )


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS rank FROM part")
def argsort(t):
    return pr.argsort(t.part.select("p_partkey", "p_size"), "p_size", "p_partkey").select("p_partkey", "rank")


@query("SELECT p_size, p_partkey FROM part ORDER BY p_size, p_partkey")
def sort_pairs(t):
    return t.part.select("p_size", "p_partkey").orderBy("p_size", "p_partkey")


for _name, _border in (("stencil_3x3", False), ("stencil_3x3_border", True)):
    _where = "" if _border else "WHERE a.i BETWEEN 1 AND 98 AND a.j BETWEEN 1 AND (SELECT count(*) // 100 FROM orders) - 2"
    query(f"WITH {G2}, o AS (SELECT unnest([-1, 0, 1]) AS d) SELECT a.node_id, round(avg(b.v), 4) AS average FROM g2n a CROSS JOIN o x CROSS JOIN o y JOIN g2n b ON b.i = a.i + x.d AND b.j = a.j + y.d {_where} GROUP BY 1", _name)(
        lambda t, border=_border: (lambda grid, points, _: pr.stencil3x3(points, "v", *grid.dims, border=border).select("node_id", F.round("average", 4).alias("average")))(*t.g2())
    )


# --- 2.4 topology ----------------------------------------------------------------------------------


def _conn2(t):
    grid, points, cells = t.g2()
    conn = tp.incidence(cells).select(F.col("cell_id").alias("dst_id"), "slot", F.col("node_id").alias("src_id"), "shape")
    return grid, points.select(F.col("node_id").alias("src_id"), "v"), conn


def _index(t):
    """Every 7th cell, in falling order."""
    grid, _, _ = t.g2()
    return t.spark.range((grid.n_cells + 6) // 7).select(F.col("id").alias("dense_id"), (F.lit(grid.n_cells - 1) - F.col("id") * 7).alias("dst_id"))


IX = "ix AS (SELECT d AS dense_id, n - 1 - d * 7 AS cell_id FROM (SELECT n, unnest(range((n + 6) // 7)) AS d FROM (SELECT count(*) AS n FROM g2c)))"
def _mean() -> dict:
    return {"v": F.round(F.avg("v"), 4)}


@query(f"WITH {G2} SELECT cell_id AS dst_id, round(avg(v), 4) AS v FROM g2i JOIN g2n USING (node_id) GROUP BY 1")
def topo_source(t):
    _, src, conn = _conn2(t)
    return tp.topology_map(conn, src, _mean())


@query(f"WITH {G2} SELECT node_id AS dst_id, count(*) AS n, CAST(sum(cell_id) AS BIGINT) AS ids FROM g2i GROUP BY 1")
def topo_source_cells_of_nodes(t):
    _, _, conn = _conn2(t)
    back = conn.select(F.col("src_id").alias("dst_id"), F.col("dst_id").alias("src_id"))
    return tp.topology_map(back, None, {"n": F.count(F.lit(1)), "ids": F.sum("src_id")})


@query(f"WITH {G2} SELECT cell_id AS dst_id, round(max(v) - any_value(w), 4) AS v FROM g2i JOIN g2n USING (node_id) JOIN (SELECT cell_id, CAST(cell_id % 50 AS DOUBLE) AS w FROM g2c) USING (cell_id) GROUP BY 1")
def topo_combined(t):
    grid, src, conn = _conn2(t)
    dst = t.spark.range(grid.n_cells).select(F.col("id").alias("dst_id"), (F.col("id") % 50).cast("double").alias("w"))
    return tp.topology_map(conn, src, {"v": F.round(F.max("v") - F.max("w"), 4)}, dst=dst)


@query(f"WITH {G2} SELECT cell_id, b AS first, b + 101 AS last, CAST(4 AS BIGINT) AS n FROM g2c")
def topo_destination(t):
    _, _, cells = t.g2()
    return cells.select("cell_id", F.col("nodes")[0].alias("first"), F.element_at("nodes", -1).alias("last"), F.size("nodes").cast("long").alias("n"))


@query(f"WITH {G3} SELECT cell_id, 9 AS shape, 3 AS dim FROM g3c")
def topo_info(t):
    _, _, cells = t.g3()
    dims = F.create_map(*[F.lit(x) for s, d in model.DIMENSION.items() for x in (int(s), d)])
    return cells.select("cell_id", "shape", dims[F.col("shape")].alias("dim"))


@query(f"WITH {G2}, {IX} SELECT dense_id, round(avg(v), 4) AS v FROM ix JOIN g2i USING (cell_id) JOIN g2n USING (node_id) GROUP BY 1")
def topo_gather(t):
    _, src, conn = _conn2(t)
    return tp.topology_map(conn, src, _mean(), index=_index(t))


@query(f"WITH {G2}, {IX} SELECT dense_id, round(min(v) + any_value(dense_id), 4) AS v FROM ix JOIN g2i USING (cell_id) JOIN g2n USING (node_id) GROUP BY 1")
def topo_packed(t):
    _, src, conn = _conn2(t)
    return tp.topology_map(conn, src, {"v": F.round(F.min("v") + F.max("dense_id"), 4)}, index=_index(t))


for _name, _agg, _sqlagg in (("topo_scatter", "avg", "round(avg(v), 4)"), ("topo_sparse", "max", "round(max(v), 4)")):
    query(f"WITH {G2}, {IX}, got AS (SELECT cell_id, {_sqlagg} AS v FROM ix JOIN g2i USING (cell_id) JOIN g2n USING (node_id) GROUP BY 1) SELECT c.cell_id AS dst_id, coalesce(got.v, -1.0) AS v FROM g2c c LEFT JOIN got USING (cell_id)", _name)(
        lambda t, agg=_agg: (lambda grid, src, conn: tp.topology_map(conn, src, {"v": F.round(getattr(F, agg)("v"), 4)}, index=_index(t), out=t.spark.range(grid.n_cells).select(F.col("id").alias("dst_id"), F.lit(-1.0).alias("v"))))(*_conn2(t))
    )

# the other families with an index: w is the destination's own value, by cell (gather, sparse) or dense (packed, scatter)
_FAMILIES = {
    "combined": (lambda: F.round(F.max("v") - F.max("w"), 4), "round(max(v) - max(w), 4)", True, True),
    "destination": (lambda: F.max("w") * 2 + F.count(F.lit(1)), "max(w) * 2 + count(*)", False, True),
    "info": (lambda: F.max("shape") * 100.0 + F.count(F.lit(1)), "4 * 100.0::DOUBLE + count(*)", False, False),
}


def _indexed(family: str, form: str):
    agg, sql, with_source, with_dst = _FAMILIES[family]
    dense, back = form in ("packed", "scatter"), form in ("scatter", "sparse")
    w = "CAST(dense_id % 30 AS DOUBLE)" if dense else "CAST(cell_id % 50 AS DOUBLE)"
    got = f"WITH {G2}, {IX}, got AS (SELECT dense_id, cell_id, {sql} AS v FROM (SELECT ix.*, node_id, {w} AS w{', v' if with_source else ''} FROM ix JOIN g2i USING (cell_id){' JOIN g2n USING (node_id)' if with_source else ''}) GROUP BY 1, 2)"

    def run(t):
        grid, src, conn = _conn2(t)
        index = _index(t)
        dst = index.select("dense_id", (F.col("dense_id") % 30).cast("double").alias("w")) if dense else t.spark.range(grid.n_cells).select(F.col("id").alias("dst_id"), (F.col("id") % 50).cast("double").alias("w"))
        out = t.spark.range(grid.n_cells).select(F.col("id").alias("dst_id"), F.lit(-1.0).alias("v")) if back else None
        return tp.topology_map(conn, src if with_source else None, {"v": agg()}, index=index, dst=dst if with_dst else None, out=out)

    query(got + (" SELECT c.cell_id AS dst_id, coalesce(got.v, -1.0) AS v FROM g2c c LEFT JOIN got USING (cell_id)" if back else " SELECT dense_id, v FROM got"), f"topo_{family}_{form}")(run)


for _family in _FAMILIES:
    for _form in ("gather", "packed", "scatter", "sparse"):
        _indexed(_family, _form)

_G3E = f"""WITH {G3}, ex AS (SELECT e AS edge_id, e % 9 + 10 * (e // 9) AS a, 1 AS d FROM (SELECT unnest(range(90 * (SELECT nz FROM g3d))) AS e)),
ey AS (SELECT e + 90 * nz AS edge_id, e % 10 + 10 * ((e // 10) % 9) + 100 * (e // 90) AS a, 10 AS d FROM (SELECT nz, unnest(range(90 * nz)) AS e FROM g3d)),
ez AS (SELECT e + 180 * nz AS edge_id, e AS a, 100 AS d FROM (SELECT nz, unnest(range(100 * (nz - 1))) AS e FROM g3d)),
ee AS (SELECT edge_id, a, a + d AS b FROM (SELECT * FROM ex UNION ALL SELECT * FROM ey UNION ALL SELECT * FROM ez))"""


@query(f"{_G3E} SELECT * FROM ee")
def edges_structured(t):
    return g.edges(t.spark, t.g3()[0])


def _local(shape: Shape) -> str:
    return "(VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(EDGES[shape])) + ") l(slot, p, q)"


@query(f"{_G3E} SELECT c.cell_id, l.slot, e.edge_id FROM g3c c, {_local(Shape.VOXEL)} JOIN g3i x ON x.cell_id = c.cell_id AND x.slot = l.p JOIN g3i y ON y.cell_id = c.cell_id AND y.slot = l.q JOIN ee e ON e.a = x.node_id AND e.b = y.node_id")
def cell_edges_structured(t):
    grid, _, cells = t.g3()
    return cells.select("cell_id", F.posexplode(g.cell_edges(F.col("cell_id"), grid)).alias("slot", "edge_id"))


_EXPLICIT_EDGES = f"first AS (SELECT least(x.node_id, y.node_id) AS a, greatest(x.node_id, y.node_id) AS b, min(x.cell_id * 64 + l.slot) AS f FROM {_local(Shape.VOXEL)} JOIN g3i x ON x.slot = l.p JOIN g3i y ON y.cell_id = x.cell_id AND y.slot = l.q GROUP BY 1, 2)"


@query(f"WITH {G3}, {_EXPLICIT_EDGES} SELECT row_number() OVER (ORDER BY f) - 1 AS edge_id, a, b FROM first")
def edges_explicit(t):
    return tp.edges(t.g3()[2])


_FACES = "(VALUES " + ", ".join(f"({i}, {j}, {n})" for i, f in enumerate(model.FACES[Shape.VOXEL]) for j, n in enumerate(f)) + ") l(slot, pos, p)"
_G3F = f"fc AS (SELECT x.cell_id, l.slot, list(x.node_id ORDER BY x.node_id) AS key, list(x.node_id ORDER BY l.pos) AS nodes FROM {_FACES} JOIN g3i x ON x.slot = l.p GROUP BY 1, 2)"


@query(f"WITH {G3}, {_G3F}, u AS (SELECT key, min(cell_id * 64 + slot) AS f, arg_min(nodes, cell_id * 64 + slot) AS nodes, count(*) AS n_cells FROM fc GROUP BY 1) SELECT row_number() OVER (ORDER BY f) - 1 AS face_id, array_to_string(nodes, ' ') AS nodes, n_cells FROM u")
def faces_explicit(t):
    return tp.faces(t.g3()[2]).select("face_id", F.concat_ws(" ", F.transform("nodes", lambda n: n.cast("string"))).alias("nodes"), "n_cells")


@query(f"""WITH {G3}, f1 AS (SELECT e AS face_id, (e % 9) + 10 * ((e // 9) % 9) + 100 * (e // 81) AS b, 1 AS u, 10 AS w FROM (SELECT unnest(range(81 * nz)) AS e FROM g3d)),
f2 AS (SELECT e + 81 * nz, (e % 9) + 10 * ((e // 9) % 10) + 100 * (e // 90), 100, 1 FROM (SELECT nz, unnest(range(90 * (nz - 1))) AS e FROM g3d)),
f3 AS (SELECT e + 81 * nz + 90 * (nz - 1), (e % 10) + 10 * ((e // 10) % 9) + 100 * (e // 90), 10, 100 FROM (SELECT nz, unnest(range(90 * (nz - 1))) AS e FROM g3d))
SELECT face_id, b AS n0, b + u AS n1, b + w AS n2, b + u + w AS n3 FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3)""")
def faces_structured(t):
    return g.faces(t.spark, t.g3()[0]).select("face_id", *(F.col("nodes")[k].alias(f"n{k}") for k in range(4)))


@query(f"""WITH {G3} SELECT cell_id, s AS slot, CASE s WHEN 0 THEN yz WHEN 1 THEN yz + 1 WHEN 2 THEN xz WHEN 3 THEN xz + 9 WHEN 4 THEN xy ELSE xy + 81 END AS face_id FROM (
SELECT cell_id, 81 * nz + 90 * (nz - 1) + i + 10 * j + 90 * k AS yz, 81 * nz + i + 9 * j + 90 * k AS xz, cell_id AS xy FROM (SELECT cell_id, cell_id % 9 AS i, (cell_id // 9) % 9 AS j, cell_id // 81 AS k, nz FROM g3c, g3d)), (SELECT CAST(unnest(range(6)) AS INTEGER) AS s)""")
def cell_faces_structured(t):
    grid, _, cells = t.g3()
    return cells.select("cell_id", F.posexplode(g.cell_faces(F.col("cell_id"), grid)).alias("slot", "face_id"))


@query(f"WITH {GRAPH} SELECT n.node_id, count(x.node_id) AS n_cells FROM grn n LEFT JOIN (SELECT a AS node_id FROM gr UNION ALL SELECT b FROM gr) x USING (node_id) GROUP BY 1")
def node_cells(t):
    return tp.node_cells(*t.graph())


@query(f"WITH {G3} SELECT node_id, array_to_string(list(cell_id ORDER BY cell_id), ' ') AS cells FROM g3i GROUP BY 1")
def node_cells_structured(t):
    grid, points, _ = t.g3()
    return points.select("node_id", F.concat_ws(" ", F.transform(g.node_cells(F.col("node_id"), grid), lambda c: c.cast("string"))).alias("cells"))


_FAN = "(VALUES (0, 0, 1, 2), (1, 1, 3, 2)) l(sub, p, q, r)"


@query(f"WITH {G2} SELECT cell_id, sub, x.node_id AS a, y.node_id AS b, z.node_id AS c FROM {_FAN} JOIN g2i x ON x.slot = p JOIN g2i y USING (cell_id) JOIN g2i z USING (cell_id) WHERE y.slot = q AND z.slot = r")
def triangulate(t):
    return tp.triangles(t.g2()[2]).select("cell_id", "sub", *(F.col("nodes")[k].alias(n) for k, n in enumerate("abc")))


_TETS = "(VALUES " + ", ".join(f"({i}, {', '.join(map(str, x))})" for i, x in enumerate(model.TETS[Shape.VOXEL])) + ") l(sub, p, q, r, s)"


@query(f"WITH {G3} SELECT cell_id, sub, x.node_id AS a, y.node_id AS b, z.node_id AS c, w.node_id AS d FROM {_TETS} JOIN g3i x ON x.slot = p JOIN g3i y USING (cell_id) JOIN g3i z USING (cell_id) JOIN g3i w USING (cell_id) WHERE y.slot = q AND z.slot = r AND w.slot = s")
def tetrahedralize(t):
    return tp.tetrahedra(t.g3()[2]).select("cell_id", "sub", *(F.col("nodes")[k].alias(n) for k, n in enumerate("abcd")))


# --- 2.5 selection ---------------------------------------------------------------------------------


@query(f"WITH {GRAPH} SELECT cell_id, cents FROM gr WHERE cents BETWEEN 2000000 AND 5000000")
def threshold_cell(t):
    return sel.threshold_cells(t.graph()[1], "cents", 2000000, 5000000).select("cell_id", "cents")


for _name, _fn, _all in (("threshold_any", "bool_or", False), ("threshold_all", "bool_and", True)):
    query(f"WITH {G2} SELECT cell_id FROM g2i JOIN g2n USING (node_id) GROUP BY 1 HAVING {_fn}(v BETWEEN 50000 AND 300000)", _name)(
        lambda t, every=_all: (lambda grid, points, cells: sel.threshold_nodes(cells, points, "v", 50000, 300000, every).select("cell_id"))(*t.g2())
    )


@query(f"WITH {G2} SELECT 'subset_of_cells' AS name, cell_id, b AS first FROM g2c WHERE cell_id IN (SELECT cell_id FROM g2i JOIN g2n USING (node_id) WHERE v BETWEEN 1000 AND 20000)")
def subset(t):
    _, points, cells = t.g2()
    return sel.threshold_nodes(cells, points, "v", 1000, 20000).select(F.lit("subset_of_cells").alias("name"), "cell_id", F.col("nodes")[0].alias("first"))


@query(f"WITH {G3} SELECT cell_id FROM g3i JOIN g3n USING (node_id) GROUP BY 1 HAVING bool_and(i BETWEEN 2 AND 6 AND j BETWEEN 1 AND 8 AND k BETWEEN 0 AND 1)")
def box(t):
    _, points, cells = t.g3()
    return sel.box(cells, points, {"i": (2, 6), "j": (1, 8), "k": (0, 1)}).select("cell_id")


@query(f"WITH {GRAPH} SELECT cell_id FROM gr WHERE a IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def selection(t):
    _, cells = t.graph()
    return sel.selection(cells.withColumn("a", F.col("nodes")[0]), "a", t.part.where("p_size = 7"), "p_partkey").select("cell_id")


@query(f"WITH {G3}, {_G3F} SELECT min(cell_id) AS cell_id, min(slot) AS slot, array_to_string(any_value(nodes), ' ') AS nodes, CAST(min(cell_id) % 13 AS BIGINT) AS field FROM fc GROUP BY key HAVING count(*) = 1")
def external_faces(t):
    cells = t.g3()[2].withColumn("field", F.col("cell_id") % 13)
    return sel.external_faces(cells, "field").select("cell_id", "slot", F.concat_ws(" ", F.transform("nodes", lambda n: n.cast("string"))).alias("nodes"), "field")


_TF = "(VALUES " + ", ".join(f"({i}, {j}, {n})" for i, f in enumerate(model.FACES[Shape.TET]) for j, n in enumerate(f)) + ") f(slot, pos, n)"
_TN = "(VALUES " + ", ".join(f"({i}, {j}, {n})" for i, x in enumerate(model.TETS[Shape.VOXEL]) for j, n in enumerate(x)) + ") l(sub, n, vox)"


@query(f"WITH {G3}, tn AS (SELECT cell_id * 5 + sub AS cell_id, l.n, node_id FROM {_TN} JOIN g3i x ON x.slot = l.vox), ft AS (SELECT cell_id, f.slot, list(node_id ORDER BY node_id) AS key FROM {_TF} JOIN tn USING (n) GROUP BY 1, 2) SELECT min(cell_id) AS cell_id, min(slot) AS slot FROM ft GROUP BY key HAVING count(*) = 1")
def external_faces_tet(t):
    tets = tp.tetrahedra(t.g3()[2]).select((F.col("cell_id") * 5 + F.col("sub")).alias("cell_id"), F.lit(int(Shape.TET)).alias("shape"), "nodes")
    return sel.external_faces(tets).select("cell_id", "slot")


# --- 2.6 fields ------------------------------------------------------------------------------------


@query(f"WITH {GRAPH} SELECT n.node_id, round(coalesce(avg(x.cents), 0), 4) AS nodecentered_cents FROM grn n LEFT JOIN (SELECT a AS node_id, cents FROM gr UNION ALL SELECT b, cents FROM gr) x USING (node_id) GROUP BY 1")
def recenter(t):
    return cp.recenter(*t.graph(), "cents").select("node_id", F.round("nodecentered_cents", 4).alias("nodecentered_cents"))


@query("""WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT least(greatest(CAST(floor((l_extendedprice - lo) / (hi - lo) * 20) AS BIGINT), 0), 19) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1)
SELECT b AS bin, round(lo + (hi - lo) / 20 * b, 6) AS low, round(lo + (hi - lo) / 20 * (b + 1), 6) AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS b) x CROSS JOIN r LEFT JOIN c ON c.bin = b""")
def histogram(t):
    return cp.histogram(t.lineitem, "l_extendedprice", 20).select("bin", r6("low").alias("low"), r6("high").alias("high"), "n")


def _elevated(t):
    _, points, cells = t.g2()
    return cells, cp.elevate(points.select("node_id", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), (F.col("v") / 10000).alias("h")), "h")


@query(f"WITH {G2} SELECT node_id, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, v / 10000 AS z FROM g2n")
def elevate(t):
    return _elevated(t)[1].select("node_id", "x", "y", "z")


@query(f"""WITH {G2}, p AS (SELECT c.cell_id, a.v / 10000 AS a, b.v / 10000 AS b, d.v / 10000 AS c FROM g2c c JOIN g2n a ON a.node_id = c.b JOIN g2n b ON b.node_id = c.b + 1 JOIN g2n d ON d.node_id = c.b + 100),
q AS (SELECT cell_id, 0.0::DOUBLE * (c - b) - (b - a) * 1.0::DOUBLE AS x, (b - a) * (-1.0)::DOUBLE - 1.0::DOUBLE * (c - b) AS y, 1.0::DOUBLE AS z FROM p)
SELECT cell_id, round(x / sqrt(x * x + y * y + z * z), 6) AS nx, round(y / sqrt(x * x + y * y + z * z), 6) AS ny, round(z / sqrt(x * x + y * y + z * z), 6) AS nz FROM q""")
def normals(t):
    n = cp.surface_normals(*_elevated(t))
    return n.select("cell_id", *(r6(c).alias(c) for c in ("nx", "ny", "nz")))


_M = mx.translate(1.0, 2.0, 3.0) @ mx.rotate(2, 0.5) @ mx.scale(2.0, 0.5, 1.0)
_MP = mx.perspective(0.8, 1.0, 100.0, 1.25) @ mx.view((20.0, 10.0, 60.0), (5.0, 5.0, 5.0), (0.0, 1.0, 0.0))


def _lin(m, k: int) -> str:
    return f"({m[k][0]!r}::DOUBLE * x + {m[k][1]!r}::DOUBLE * y + {m[k][2]!r}::DOUBLE * z + {m[k][3]!r}::DOUBLE)"


def _floats(m) -> list[list[float]]:
    return [[float(x) for x in row] for row in m]


@query(f"WITH {CLOUD} SELECT node_id, " + ", ".join(f"round({_lin(_floats(_M), k)}, 6) AS {a}" for k, a in enumerate("xyz")) + " FROM cl")
def transform(t):
    return cp.transform(t.cloud(), _M).select("node_id", *(r6(a).alias(a) for a in "xyz"))


_SP = f"sp AS (SELECT node_id, " + ", ".join(f"{_lin(_floats(_MP), k)} / {_lin(_floats(_MP), 3)} AS {a}" for k, a in enumerate("xyz")) + " FROM cl), zz AS (SELECT min(z) AS lo, max(z) AS hi FROM sp)"


@query(f"WITH {CLOUD}, {_SP} SELECT node_id, round((x + 1) * 0.5 * 640, 6) AS px, round((y + 1) * 0.5 * 480, 6) AS py, round(100 * (z - lo) / (hi - lo), 5) AS pz FROM sp, zz")
def project(t):
    p = ry.project(t.cloud(), _MP, 640, 480, 100)
    return p.select("node_id", r6("px").alias("px"), r6("py").alias("py"), F.round("pz", 5).alias("pz"))


_NODES50 = "nd AS (SELECT n AS node_id, -1 + (n % 50) * 0.25::DOUBLE AS x, -1 + (n // 50) * 0.25::DOUBLE AS y, 12.0::DOUBLE AS z FROM (SELECT unnest(range(2500)) AS n))"


def _nodes50(t):
    n = F.col("id")
    return t.spark.range(2500).select(n.alias("node_id"), (-1 + (n % 50) * 0.25).alias("x"), (-1 + F.floor(n / 50) * 0.25).alias("y"), F.lit(12.0).alias("z"))


_DIST = f"WITH {CLOUD}, {_NODES50} SELECT n.node_id, round(min(sqrt((n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y) + (n.z - c.z) * (n.z - c.z))), 6) AS dist FROM nd n, cl c GROUP BY 1"


@query(_DIST)
def distance_exact(t):
    return cp.distance_field(_nodes50(t), t.cloud()).select("node_id", r6("dist").alias("dist"))


@query("WITH cl AS (SELECT (o_orderkey % 97) / 5.0::DOUBLE AS x, (o_orderkey % 89) / 4.0::DOUBLE AS y FROM orders), " + _NODES50 + " SELECT n.node_id, round(min(sqrt((n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y))), 6) AS dist FROM nd n, (SELECT DISTINCT x, y FROM cl) c GROUP BY 1")
def distance_binned(t):
    k = F.col("o_orderkey")
    cloud = t.orders.select(((k % 97) / 5.0).alias("x"), ((k % 89) / 4.0).alias("y")).distinct()
    return cp.distance_field(_nodes50(t), cloud, ("x", "y")).select("node_id", r6("dist").alias("dist"))


@query(f"WITH {CLOUD}, e AS (SELECT *, CASE WHEN node_id % 3 = 0 THEN 'H' ELSE 'C' END AS element FROM cl), d AS (SELECT a.node_id AS a, b.node_id AS b, a.element AS ea, b.element AS eb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist FROM e a JOIN e b ON a.node_id < b.node_id) SELECT a, b, round(dist, 6) AS dist FROM d WHERE dist > 0.4 AND dist < CASE WHEN ea = 'H' OR eb = 'H' THEN 1.2 ELSE 1.9 END")
def bonds(t):
    atoms = t.cloud().withColumn("element", F.when(F.col("node_id") % 3 == 0, "H").otherwise("C"))
    return cp.bonds(atoms).select("a", "b", r6("dist").alias("dist"))


_PIT = """WITH pt AS (SELECT e AS point_id, (e % 101) / 10.0::DOUBLE AS x, (e % 103) / 10.5::DOUBLE AS y FROM (SELECT event_id AS e FROM events)),
tr AS (SELECT c AS cell_id, (c % 10)::DOUBLE AS ax, (c // 10)::DOUBLE AS ay, c % 10 + 1.1::DOUBLE AS bx, c // 10 + 0.2::DOUBLE AS by_, c % 10 + 0.3::DOUBLE AS cx, c // 10 + 0.9::DOUBLE AS cy FROM (SELECT unnest(range(100)) AS c)),
w AS (SELECT *, ((by_ - cy) * (x - cx) + (cx - bx) * (y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS u, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS v FROM pt JOIN tr ON x BETWEEN least(ax, bx, cx) - 1 AND greatest(ax, bx, cx) + 1 AND y BETWEEN ay - 1 AND cy + 1)
SELECT point_id, cell_id, round(u * cell_id + v * 2 + (1.0::DOUBLE - u - v) * 3, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY cell_id) AS rn FROM w WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AND 1.0::DOUBLE - u - v BETWEEN 0 AND 1) WHERE rn = 1"""


@query(_PIT)
def point_in_triangle(t):
    e = F.col("event_id")
    points = t.events.select(e.alias("point_id"), ((e % 101) / 10.0).alias("x"), ((e % 103) / 10.5).alias("y"))
    c = F.col("id")
    i, j = (c % 10).cast("double"), F.floor(c / 10).cast("double")
    tris = t.spark.range(100).select(c.alias("cell_id"), i.alias("ax"), j.alias("ay"), (i + 1.1).alias("bx"), (j + 0.2).alias("by"), (i + 0.3).alias("cx"), (j + 0.9).alias("cy"), c.cast("double").alias("va"), F.lit(2.0).alias("vb"), F.lit(3.0).alias("vc"))
    return cp.points_in_triangles(points, tris, "value").select("point_id", "cell_id", r6("value").alias("value"))


@query("SELECT vec_id, round(list_min(embedding)::DOUBLE, 6) AS min, round(list_max(embedding)::DOUBLE, 6) AS max, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS magnitude FROM embeddings")
def array_stats(t):
    return model.array_stats(t.embeddings, "embedding", "vec_id").select("vec_id", *(r6(c).alias(c) for c in ("min", "max", "magnitude")))


@query("SELECT c AS component, round(min(v)::DOUBLE, 6) AS min, round(max(v)::DOUBLE, 6) AS max FROM (SELECT CAST(unnest(range(64)) AS INTEGER) AS c, unnest(embedding) AS v FROM embeddings) GROUP BY 1")
def component_range(t):
    return model.component_range(t.embeddings, "embedding", 64).select("component", r6("min").alias("min"), r6("max").alias("max"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def time_slices(t):
    return t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- 2.7 geometry ----------------------------------------------------------------------------------


@query("WITH n AS (SELECT c_custkey AS a, c_acctbal AS u, lead(c_acctbal) OVER (ORDER BY c_custkey) AS w FROM customer) SELECT a, a + 1 AS b, round((2000 - u) / (w - u), 6) AS alpha, round(a + (2000 - u) / (w - u), 6) AS x FROM n WHERE (u < 2000) <> (w < 2000)")
def iso_1d(t):
    _, points, cells = t.b1()
    p, _ = geo.isosurface(points, cells, "v", 2000.0, ("x",))
    return p.select("a", "b", r6("alpha").alias("alpha"), r6("x").alias("x"))


_CROSS2 = f"WITH {G2}, e AS (SELECT a.node_id AS a, b.node_id AS b, a.v AS u, b.v AS w, a.i AS x, a.j AS y, b.i - a.i AS dx, b.j - a.j AS dy FROM g2n a JOIN (SELECT *, node_id - 1 AS m FROM g2n WHERE i > 0 UNION ALL SELECT *, node_id - 100 FROM g2n WHERE j > 0) b ON a.node_id = b.m WHERE (a.v < 200000) <> (b.v < 200000))"


@query(f"{_CROSS2} SELECT row_number() OVER (ORDER BY a, b) - 1 AS point_id, a, b, round((200000 - u) / (w - u), 6) AS alpha, round(x + dx * ((200000 - u) / (w - u)), 6) AS x, round(y + dy * ((200000 - u) / (w - u)), 6) AS y FROM e")
def iso_2d(t):
    _, points, cells = t.g2()
    points = points.select("node_id", F.col("i").alias("x"), F.col("j").alias("y"), "v")
    p, _ = geo.isosurface(points, cells, "v", 200000.0, ("x", "y"))
    return p.select("point_id", "a", "b", *(r6(c).alias(c) for c in ("alpha", "x", "y")))


def _case_values(shape: Shape) -> str:
    return "(VALUES " + ", ".join(f"({c}, {s}, {', '.join(map(str, p))})" for _, c, s, p in geo.case_rows({int(shape)})) + ")"


_CASE2 = "cs AS (SELECT cell_id, CAST(sum(CASE WHEN v < 200000 THEN 1 << slot ELSE 0 END) AS BIGINT) AS case_id FROM g2i JOIN g2n USING (node_id) GROUP BY 1)"


@query(f"WITH {G2}, {_CASE2} SELECT cs.case_id, count(DISTINCT cell_id) AS cells, count(sub) AS lines FROM cs LEFT JOIN {_case_values(Shape.PIXEL)} t(case_id, sub, e0, e1) ON t.case_id = cs.case_id GROUP BY 1")
def iso_2d_counts(t):
    _, points, cells = t.g2()
    c = geo.cases(cells, points, "v", 200000.0)
    table = t.spark.createDataFrame([(r[1], r[2]) for r in geo.case_rows({int(Shape.PIXEL)})], "case_id long, sub int")
    return c.join(F.broadcast(table), "case_id", "left").groupBy("case_id").agg(F.countDistinct("cell_id").alias("cells"), F.count("sub").alias("lines"))


_V3 = "(k * 100.0::DOUBLE + i * 7 + j * 11 + size)"
_CROSS3 = f"WITH {G3}, gv AS (SELECT *, {_V3} AS f FROM g3n), e AS (SELECT a.node_id AS a, b.node_id AS b, a.f AS u, b.f AS w, a.v AS p, b.v AS q FROM gv a JOIN (SELECT *, node_id - 1 AS m FROM gv WHERE i > 0 UNION ALL SELECT *, node_id - 10 FROM gv WHERE j > 0 UNION ALL SELECT *, node_id - 100 FROM gv WHERE k > 0) b ON a.node_id = b.m WHERE (a.f < 150.5) <> (b.f < 150.5))"


def _iso3(t):
    _, points, cells = t.g3()
    f = F.col("k") * 100.0 + F.col("i") * 7 + F.col("j") * 11 + F.col("size")
    return geo.isosurface(points.withColumn("f", f), cells, "f", 150.5, ("v",))


@query(f"{_CROSS3} SELECT row_number() OVER (ORDER BY a, b) - 1 AS point_id, a, b, round((150.5 - u) / (w - u), 6) AS alpha, round(p + (q - p) * ((150.5 - u) / (w - u)), 6) AS v FROM e")
def iso_3d_points(t):
    return _iso3(t)[0].select("point_id", "a", "b", r6("alpha").alias("alpha"), r6("v").alias("v"))


_VOX_A = "CASE {e} " + " ".join(f"WHEN {i} THEN b + {sum(d for bit, d in ((1, 1), (2, 10), (4, 100)) if p & bit)}" for i, (p, _) in enumerate(EDGES[Shape.VOXEL])) + " END"
_VOX_B = "CASE {e} " + " ".join(f"WHEN {i} THEN b + {sum(d for bit, d in ((1, 1), (2, 10), (4, 100)) if q & bit)}" for i, (_, q) in enumerate(EDGES[Shape.VOXEL])) + " END"


@query(
    f"{_CROSS3}, pts AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS point_id, a, b FROM e), cs AS (SELECT cell_id, CAST(sum(CASE WHEN f < 150.5 THEN 1 << slot ELSE 0 END) AS BIGINT) AS case_id FROM g3i JOIN gv USING (node_id) GROUP BY 1), "
    f"tr AS (SELECT cell_id, b, sub, e0, e1, e2 FROM cs JOIN g3c USING (cell_id) JOIN {_case_values(Shape.VOXEL)} t(case_id, sub, e0, e1, e2) USING (case_id)) SELECT cell_id, sub, p0.point_id AS n0, p1.point_id AS n1, p2.point_id AS n2 FROM tr "
    + " ".join(f"JOIN pts p{k} ON p{k}.a = {_VOX_A.format(e=f'e{k}').replace('b +', 'tr.b +')} AND p{k}.b = {_VOX_B.format(e=f'e{k}').replace('b +', 'tr.b +')}" for k in range(3))
)
def iso_3d_triangles(t):
    return _iso3(t)[1].select("cell_id", "sub", *(F.col("nodes")[k].alias(f"n{k}") for k in range(3)))


@query(f"""WITH {G2}, c AS (SELECT *, (SELECT count(*) FROM g2n) + cell_id * 5 AS first FROM g2c), r AS (SELECT cell_id, first, o.k, b + o.d AS node_id FROM c, (VALUES (0, 0), (1, 1), (2, 101), (3, 100)) o(k, d)),
s AS (SELECT r.first AS a, r.first + 1 + k AS m, r.first + 1 + (k + 3) % 4 AS m2, n.i, n.j, n.v FROM r JOIN g2n n USING (node_id)), u AS (SELECT a AS node_id, i, j, v FROM s UNION ALL SELECT m, i, j, v FROM s UNION ALL SELECT m2, i, j, v FROM s)
SELECT node_id, round(avg(i), 6) AS x, round(avg(j), 6) AS y, round(avg(v), 4) AS v FROM u GROUP BY 1 UNION ALL SELECT node_id, CAST(i AS DOUBLE), CAST(j AS DOUBLE), round(v, 4) FROM g2n""")
def tessellate_points(t):
    grid, points, cells = t.g2()
    points = points.select("node_id", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), "v")
    return geo.tessellate(points, cells, grid.n_nodes, ("x", "y", "v"))[0].select("node_id", r6("x").alias("x"), r6("y").alias("y"), F.round("v", 4).alias("v"))


@query(f"WITH {G2}, c AS (SELECT *, (SELECT count(*) FROM g2n) + cell_id * 5 AS first FROM g2c) SELECT cell_id, CAST(k AS INTEGER) AS sub, first AS n0, first + 1 + k AS n1, b + d AS n2, first + 1 + (k + 1) % 4 AS n3 FROM c, (VALUES (0, 1), (1, 101), (2, 100), (3, 0)) o(k, d)")
def tessellate_quads(t):
    grid, points, cells = t.g2()
    points = points.select("node_id", F.col("i").cast("double").alias("x"))
    return geo.tessellate(points, cells, grid.n_nodes, ("x",))[1].select("cell_id", "sub", *(F.col("nodes")[k].alias(f"n{k}") for k in range(4)))


_LEGENDRE = [((1, 3**0.5 * x, 5**0.5 * (3 * x * x - 1) / 2), (1, 3**0.5 * y, 5**0.5 * (3 * y * y - 1) / 2)) for x, y in ((0, 0), (0, -1), (1, 0), (0, 1), (-1, 0), (-1, -1), (1, -1), (1, 1), (-1, 1))]
_LEGENDRE_SQL = "(VALUES " + ", ".join(f"({n}, " + ", ".join(f"{a * b!r}::DOUBLE" for a in p for b in q) + ")" for n, (p, q) in enumerate(_LEGENDRE)) + ") w(pos, " + ", ".join(f"w{k}" for k in range(9)) + ")"


@query(f"""WITH {G2}, c AS (SELECT *, (SELECT count(*) FROM g2n) + cell_id * 5 AS first FROM g2c), v AS (SELECT cell_id, pos, CASE WHEN pos < 5 THEN first + pos ELSE b + list_extract([0, 1, 101, 100], pos - 4) END AS node_id, {" + ".join(f"w{k} * ((cell_id % 7 + {k}) / 10.0::DOUBLE)" for k in range(9))} AS h FROM c, {_LEGENDRE_SQL})
SELECT node_id, round(arg_max(h, cell_id), 6) AS h FROM v GROUP BY 1""")
def tessellate_legendre(t):
    """Second-order cell fields as nodal ones."""
    grid, points, cells = t.g2()
    points = points.select("node_id", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"))
    cells = cells.withColumn("h", F.array(*[(F.col("cell_id") % 7 + k) / 10.0 for k in range(9)]))
    return geo.tessellate(points, cells, grid.n_nodes, ("x", "y"), ("h",))[0].where("h is not null").select("node_id", r6("h").alias("h"))


@query()
def graph_layout(t):
    nodes = t.supplier.select(F.col("s_suppkey").cast("long").alias("node_id"))
    edges = nodes.select(F.col("node_id").alias("a"), (F.col("node_id") * 7 % nodes.count()).alias("b"))
    return geo.graph_layout(nodes, edges, rounds=10)


@query("SELECT p * n + s_suppkey AS node_id, round((s_suppkey % 10 + 2.0::DOUBLE) * cos(p * 2 * pi() / 8), 6) + 0.0 AS x, round((s_suppkey % 10 + 2.0::DOUBLE) * sin(p * 2 * pi() / 8), 6) + 0.0 AS y, CAST(s_nationkey AS DOUBLE) AS z FROM supplier, (SELECT count(*) AS n FROM supplier), (SELECT unnest(range(8)) AS p)")
def revolve_points(t):
    n = t.supplier.count()
    points = t.supplier.select(F.col("s_suppkey").cast("long").alias("node_id"), (F.col("s_suppkey") % 10 + 2.0).alias("r"), F.col("s_nationkey").cast("double").alias("z"))
    tris = t.spark.range(n - 2).select(F.col("id").alias("cell_id"), F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2).alias("nodes"))
    return cp.revolve(points, tris, 8, n)[0].select("node_id", r6("x").alias("x"), r6("y").alias("y"), "z")


@query("SELECT p * (n - 2) + c AS cell_id, p * n + c AS n0, ((p + 1) % 8) * n + c + 2 AS n5 FROM (SELECT n, unnest(range(n - 2)) AS c FROM (SELECT count(*) AS n FROM supplier)), (SELECT unnest(range(8)) AS p)")
def revolve_wedges(t):
    n = t.supplier.count()
    points = t.supplier.select(F.col("s_suppkey").cast("long").alias("node_id"), F.lit(1.0).alias("r"), F.lit(0.0).alias("z"))
    tris = t.spark.range(n - 2).select(F.col("id").alias("cell_id"), F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2).alias("nodes"))
    return cp.revolve(points, tris, 8, n)[1].select("cell_id", F.col("nodes")[0].alias("n0"), F.col("nodes")[5].alias("n5"))


# --- 2.8 rays --------------------------------------------------------------------------------------


def _rays(t):
    return ry.camera_rays(t.spark, 40, 30, (5.0, 5.0, -5.0), (0.0, 0.0, 1.0), (0.05, 0.0, 0.0), (0.0, 0.05, 0.0))


@query(f"WITH {RAYS} SELECT ray_id, round(dx, 9) AS dx, round(dy, 9) AS dy, round(dz, 9) AS dz FROM rays")
def ray_generation(t):
    return _rays(t).select("ray_id", *(F.round(c, 9).alias(c) for c in ("dx", "dy", "dz")))


_HITS = f"WITH {RAYS}, {TRIS}, {tri_hits('rays')}, {NEAR} SELECT r.ray_id, coalesce(idx, -1) AS idx, round(coalesce(t, 0), 6) AS dist, round(coalesce(u, 0), 5) + 0.0 AS u, round(coalesce(v, 0), 5) + 0.0 AS v FROM rays r LEFT JOIN nh USING (ray_id)"


def _ray_hits(t, small):
    h = ry.nearest(_rays(t), {"triangle": t.tris()}, small=small)
    return h.select("ray_id", "idx", r6("dist").alias("dist"), F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


query(_HITS, "ray_hits")(lambda t: _ray_hits(t, ry.SMALL))
query(_HITS, "ray_hits_binned")(lambda t: _ray_hits(t, 0))

_SPH = "sph AS (SELECT p_partkey AS idx, CAST(p_partkey % 10 AS DOUBLE) AS cx, CAST((p_partkey // 10) * 2 AS DOUBLE) AS cy, 4 + p_size / 10.0::DOUBLE AS cz, 0.2::DOUBLE + (p_partkey % 5) / 10.0::DOUBLE AS r FROM part)"


@query(f"""WITH {RAYS}, {_SPH}, a AS (SELECT *, (cx - ox) * dx + (cy - oy) * dy + (cz - oz) * dz AS b, (cx - ox) * (cx - ox) + (cy - oy) * (cy - oy) + (cz - oz) * (cz - oz) AS l2 FROM rays, sph),
h AS (SELECT ray_id, idx, b - sqrt(greatest(r * r - (l2 - b * b), 0)) AS t FROM a WHERE b >= 0 AND l2 - b * b <= r * r), n AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, idx) AS rn FROM h WHERE t > 0)
SELECT r.ray_id, coalesce(idx, -1) AS idx, round(coalesce(t, 0), 5) AS dist FROM rays r LEFT JOIN (SELECT * FROM n WHERE rn = 1) USING (ray_id)""")
def ray_spheres(t):
    return ry.nearest(_rays(t), {"sphere": t.spheres()}).select("ray_id", "idx", F.round("dist", 5).alias("dist"))


_CYL = "cyl AS (SELECT p_partkey AS idx, CAST(p_partkey % 10 AS DOUBLE) AS bx, CAST((p_partkey // 10) * 2 AS DOUBLE) AS by_, 4 + p_size / 10.0::DOUBLE AS bz, 0.6::DOUBLE AS ax, 0.8::DOUBLE AS ay, 0.0::DOUBLE AS az, 1.5::DOUBLE AS h, 0.25::DOUBLE AS r FROM part)"


@query(f"""WITH {RAYS}, {_CYL}, a AS (SELECT *, dx * ax + dy * ay + dz * az AS da, (ox - bx) * ax + (oy - by_) * ay + (oz - bz) * az AS ra FROM rays, cyl),
b AS (SELECT *, dx - da * ax AS px, dy - da * ay AS py, dz - da * az AS pz, ox - bx - ra * ax AS qx, oy - by_ - ra * ay AS qy, oz - bz - ra * az AS qz FROM a),
c AS (SELECT *, px * px + py * py + pz * pz AS qa, 2 * (px * qx + py * qy + pz * qz) AS qb, qx * qx + qy * qy + qz * qz - r * r AS qc FROM b),
d AS (SELECT *, s, (-qb + s * sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS t FROM c, (SELECT unnest([-1, 1]) AS s) WHERE qa > 1e-9 AND qb * qb - 4 * qa * qc >= 0),
h AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, idx) AS rn FROM d WHERE t > 1e-9 AND t < 1e6 AND ra + t * da > 0 AND ra + t * da < h)
SELECT r.ray_id, coalesce(idx, -1) AS idx, round(coalesce(t, 0), 5) AS dist FROM rays r LEFT JOIN (SELECT ray_id, idx, t FROM h WHERE rn = 1) USING (ray_id)""")
def ray_cylinders(t):
    return ry.nearest(_rays(t), {"cylinder": t.cylinders()}).select("ray_id", "idx", F.round("dist", 5).alias("dist"))


_PTS = f"WITH {RAYS}, {TRIS}, {tri_hits('rays')}, {NEAR}, pt AS (SELECT ray_id, ox + dx * t AS px, oy + dy * t AS py, oz + dz * t AS pz, dx, dy, dz FROM nh)"


def _points(t):
    """Rays, the scene, and where the rays meet it; that is written down, as second rays and what they are held against start from it."""
    rays, scene = _rays(t), ry.once({"triangle": t.tris()})
    return rays, scene, settle(t.spark, ry.hit_points(rays, ry.nearest(rays, scene)), "hits")


def _second(source: str) -> str:
    """The hit CTEs once more under other names."""
    out = tri_hits(source)
    for n in ("x1", "x2", "x3", "x4", "th"):
        out = out.replace(f"{n} AS", f"{n}b AS").replace(f"FROM {n} ", f"FROM {n}b ").replace(f"FROM {n})", f"FROM {n}b)")
    return out


@query(f"""{_PTS}, l0 AS (SELECT *, 2.0::DOUBLE - px AS lx, 12.0::DOUBLE - py AS ly, -10.0::DOUBLE - pz AS lz FROM pt), l1 AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS len FROM l0),
sr AS (SELECT ray_id, px + lx / len * 1e-4::DOUBLE AS ox, py + ly / len * 1e-4::DOUBLE AS oy, pz + lz / len * 1e-4::DOUBLE AS oz, lx / len AS dx, ly / len AS dy, lz / len AS dz, len - 1e-4::DOUBLE AS reach FROM l1), {_second('sr')}
SELECT r.ray_id, CASE WHEN nh.ray_id IS NOT NULL AND r.ray_id NOT IN (SELECT ray_id FROM thb WHERE t < reach) THEN 1 ELSE 0 END AS lit FROM rays r LEFT JOIN nh USING (ray_id)""")
def shadow_exists(t):
    rays, scene, points = _points(t)
    return ry.shadow(rays, points, scene, (2.0, 12.0, -10.0))


def _radical(base: int) -> str:
    return "(" + " + ".join(f"((k // {base**i}) % {base}) / {float(base ** (i + 1))!r}::DOUBLE" for i in range(12)) + ")"


@query(f"""{_PTS}, nn AS (SELECT idx, 0.9::DOUBLE * 0 - (bz - az) * (cy - ay) AS x, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS y, (bx - ax) * (cy - ay) AS z FROM tris),
ph AS (SELECT nh.ray_id AS pixel, ox + dx * t AS px, oy + dy * t AS py, oz + dz * t AS pz, x / sqrt(x * x + y * y + z * z) AS nx, y / sqrt(x * x + y * y + z * z) AS ny, z / sqrt(x * x + y * y + z * z) AS nz FROM nh JOIN nn USING (idx)),
fr AS (SELECT *, 0.0::DOUBLE AS tx, -nz / sqrt(nz * nz + ny * ny) AS ty, ny / sqrt(nz * nz + ny * ny) AS tz FROM ph), sm AS (SELECT fr.*, k, {_radical(2)} AS u, {_radical(3)} * (2 * pi()) AS phi FROM fr, (SELECT unnest(range(1, 9)) AS k)),
dd AS (SELECT *, sqrt(u) * cos(phi) AS p, sqrt(u) * sin(phi) AS q, sqrt(1.0 - u) AS w, ny * tz - nz * ty AS bx_, nz * tx - nx * tz AS by__, nx * ty - ny * tx AS bz_ FROM sm),
sr AS (SELECT pixel * 8 + k - 1 AS ray_id, pixel, px + nx * 1e-4::DOUBLE AS ox, py + ny * 1e-4::DOUBLE AS oy, pz + nz * 1e-4::DOUBLE AS oz, p * tx + q * bx_ + w * nx AS dx, p * ty + q * by__ + w * ny AS dy, p * tz + q * bz_ + w * nz AS dz FROM dd), {_second('sr')}
SELECT pixel, round(1.0 - sum(CASE WHEN ray_id IN (SELECT ray_id FROM thb WHERE t < 3.0) THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 6) AS open FROM sr GROUP BY 1""")
def ao_avg(t):
    _, scene, points = _points(t)
    points = points.join(ry.triangle_normals(scene["triangle"]), "idx")
    return ry.ambient_occlusion(points, scene, 8, 3.0).select("pixel", r6("open").alias("open"))


def _suffixed(sql: str, names: tuple[str, ...], k: str) -> str:
    """CTEs under other names."""
    for n in names:
        out = []
        for word in re.split(r"(\b" + n + r"\b)", sql):
            out.append(f"{n}{k}" if word == n else word)
        sql = "".join(out)
    return sql


def _bounce(rays: str, depth: int) -> str:
    """CTEs sh<depth> (ray_id, shade) and rr<depth> (the next rays) of a table of rays."""
    sql = f"""{tri_hits(rays)}, {NEAR},
hp AS (SELECT h.ray_id, h.idx, h.ox, h.oy, h.oz, h.dx, h.dy, h.dz, h.ox + h.dx * h.t AS px, h.oy + h.dy * h.t AS py, h.oz + h.dz * h.t AS pz, nn.x AS nx, nn.y AS ny, nn.z AS nz FROM nh h JOIN nn USING (idx)),
l0 AS (SELECT *, 2.0::DOUBLE - px AS lx, 12.0::DOUBLE - py AS ly, -10.0::DOUBLE - pz AS lz, 5.0::DOUBLE - px AS ex, 5.0::DOUBLE - py AS ey, -5.0::DOUBLE - pz AS ez FROM hp), l1 AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS len, sqrt(ex * ex + ey * ey + ez * ez) AS el FROM l0),
sr AS (SELECT ray_id, px + lx / len * 1e-4::DOUBLE AS ox, py + ly / len * 1e-4::DOUBLE AS oy, pz + lz / len * 1e-4::DOUBLE AS oz, lx / len AS dx, ly / len AS dy, lz / len AS dz, len - 1e-4::DOUBLE AS reach FROM l1), {_second('sr')},
l2 AS (SELECT *, lx / len + ex / el AS hx, ly / len + ey / el AS hy, lz / len + ez / el AS hz, CASE WHEN ray_id IN (SELECT ray_id FROM thb WHERE t < reach) THEN 0 ELSE 1 END AS lit FROM l1),
sh AS (SELECT ray_id, least((0.2::DOUBLE + (0.6::DOUBLE * 0.9::DOUBLE * greatest((nx * lx + ny * ly + nz * lz) / len, 0) + 0.3::DOUBLE * 0.9::DOUBLE * pow(greatest((nx * hx + ny * hy + nz * hz) / sqrt(hx * hx + hy * hy + hz * hz), 0), 10.0)) * lit) * pow(0.3::DOUBLE, {depth}), 1.0) AS shade FROM l2),
rf AS (SELECT *, CASE WHEN nx * dx + ny * dy + nz * dz > 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS s FROM hp), rg AS (SELECT *, 2 * s * (nx * dx + ny * dy + nz * dz) AS m FROM rf),
rr AS (SELECT ray_id, px - dx * 1e-4::DOUBLE AS ox, py - dy * 1e-4::DOUBLE AS oy, pz - dz * 1e-4::DOUBLE AS oz, dx - m * s * nx AS dx, dy - m * s * ny AS dy, dz - m * s * nz AS dz FROM rg)"""
    return _suffixed(sql, ("x1", "x2", "x3", "x4", "th", "nh", "hp", "l0", "l1", "l2", "sr", "x1b", "x2b", "x3b", "x4b", "thb", "sh", "rf", "rg", "rr"), f"_{depth}")


_NORMALS = "n0 AS (SELECT idx, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS x, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS y, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS z FROM tris), nn AS (SELECT idx, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM n0)"


@query(f"WITH {RAYS}, {TRIS}, {_NORMALS}, {_bounce('rays', 0)}, {_bounce('rr_0', 1)} SELECT ray_id, round(least(coalesce(a.shade, 0) + coalesce(b.shade, 0), 1.0), 6) AS shade FROM rays LEFT JOIN sh_0 a USING (ray_id) LEFT JOIN sh_1 b USING (ray_id)")
def ray_trace(t):
    return ry.trace(_rays(t), t.tris(), (2.0, 12.0, -10.0), (5.0, 5.0, -5.0), bounces=1).select("ray_id", r6("shade").alias("shade"))


@query()
def ray_trace_all(t):
    """Triangles, spheres and cylinders together, one bounce, colored by height; tests hold the parts against arithmetic."""
    scene = {"triangle": t.tris(), "sphere": t.spheres(), "cylinder": t.cylinders()}
    out = ry.trace(_rays(t), scene, (2.0, 12.0, -10.0), (5.0, 5.0, -5.0), bounces=1, color=colors.color(F.col("pz") / 20.0, colors.TABLES["grey"])[0])
    return out.select("ray_id", r6("shade").alias("shade"), r6("depth").alias("depth"))


@query("SELECT user_id % 50 AS pixel, min(z) AS z, avg(value) AS value FROM (SELECT *, CAST(event_id % 17 AS DOUBLE) AS z, min(CAST(event_id % 17 AS DOUBLE)) OVER (PARTITION BY user_id % 50) AS m FROM events) WHERE z = m GROUP BY 1".replace("avg(value)", "round(avg(value), 6)"))
def z_composite(t):
    e = t.events.select((F.col("user_id") % 50).alias("pixel"), (F.col("event_id") % 17).cast("double").alias("z"), "value")
    return ry.z_composite(e, "pixel", "z", "value").select("pixel", "z", r6("value").alias("value"))


@query("""WITH s AS (SELECT p_partkey % 97 AS pixel, p_partkey AS z, (p_partkey % 11) / 11.0::DOUBLE AS v, 0.02::DOUBLE * exp(-((p_partkey % 11) / 11.0::DOUBLE - 0.5) * ((p_partkey % 11) / 11.0::DOUBLE - 0.5) / (2 * 0.13::DOUBLE * 0.13::DOUBLE)) AS a FROM part),
w AS (SELECT *, coalesce(exp(sum(ln(1 - a)) OVER (PARTITION BY pixel ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS through FROM s)
SELECT pixel, round(sum(v * a * through), 6) AS color, round(1 - exp(sum(ln(1 - a))), 6) AS opacity FROM w GROUP BY 1""")
def volume_composite(t):
    s = t.part.select((F.col("p_partkey") % 97).alias("pixel"), F.col("p_partkey").alias("z"), ((F.col("p_partkey") % 11) / 11.0).alias("v"))
    c = ry.composite(s, ["pixel"], "z", "v", ry.gaussian_opacity(F.col("v")))
    return c.select("pixel", r6("color").alias("color"), r6("opacity").alias("opacity"))


def _tets(t):
    _, points, cells = t.g3()
    tets = tp.tetrahedra(cells).select((F.col("cell_id") * 5 + F.col("sub")).alias("cell_id"), F.lit(int(Shape.TET)).alias("shape"), "nodes")
    p = points.select("node_id", (F.col("i") * 3.1 + 0.05).alias("x"), (F.col("j") * 2.9 + 0.03).alias("y"), (F.col("k") * 4.3 + 0.01).alias("z"), F.col("v").alias("s"))
    return cp.corners(tets, p, 4, "x", "y", "z", "s")


_DET = "(({q}x - {o}x) * (({r}y - {o}y) * ({s}z - {o}z) - ({r}z - {o}z) * ({s}y - {o}y)) + ({q}y - {o}y) * (({r}z - {o}z) * ({s}x - {o}x) - ({r}x - {o}x) * ({s}z - {o}z)) + ({q}z - {o}z) * (({r}x - {o}x) * ({s}y - {o}y) - ({r}y - {o}y) * ({s}x - {o}x)))"
_D = lambda o, q, r, s: _DET.format(o=o, q=q, r=r, s=s)
_LO, _HI = "CAST(greatest(ceil(least(p0{a}, p1{a}, p2{a}, p3{a})), 0) AS BIGINT)", "CAST(least(floor(greatest(p0{a}, p1{a}, p2{a}, p3{a})), {n} - 1) AS BIGINT) + 1"
_PIV = ", ".join(f"max(CASE WHEN n = {k} THEN {c} END) AS p{k}{c}" for k in range(4) for c in "xyzs")


@query(f"""WITH {G3}, np AS (SELECT node_id, i * 3.1::DOUBLE + 0.05::DOUBLE AS x, j * 2.9::DOUBLE + 0.03::DOUBLE AS y, k * 4.3::DOUBLE + 0.01::DOUBLE AS z, v AS s FROM g3n),
tt AS (SELECT cell_id * 5 + sub AS cell_id, {_PIV} FROM {_TN} JOIN g3i x ON x.slot = l.vox JOIN np USING (node_id) GROUP BY 1),
lx AS (SELECT *, unnest(range({_LO.format(a="x")}, {_HI.format(a="x", n=30)})) AS a FROM tt), ly AS (SELECT *, unnest(range({_LO.format(a="y")}, {_HI.format(a="y", n=30)})) AS b FROM lx), lz AS (SELECT *, unnest(range({_LO.format(a="z")}, {_HI.format(a="z", n=1000)})) AS c FROM ly),
la AS (SELECT *, CAST(a AS DOUBLE) AS ptx, CAST(b AS DOUBLE) AS pty, CAST(c AS DOUBLE) AS ptz FROM lz),
bw AS (SELECT *, {_D('pt', 'p1', 'p2', 'p3')} / {_D('p0', 'p1', 'p2', 'p3')} AS w0, -{_D('pt', 'p0', 'p2', 'p3')} / {_D('p0', 'p1', 'p2', 'p3')} AS w1, {_D('pt', 'p0', 'p1', 'p3')} / {_D('p0', 'p1', 'p2', 'p3')} AS w2, -{_D('pt', 'p0', 'p1', 'p2')} / {_D('p0', 'p1', 'p2', 'p3')} AS w3 FROM la)
SELECT CAST(ptx AS INTEGER) AS x, CAST(pty AS INTEGER) AS y, CAST(ptz AS INTEGER) AS z, round(arg_min(w0 * p0s + w1 * p1s + w2 * p2s + w3 * p3s, cell_id), 4) AS s FROM bw WHERE w0 >= 0 AND w1 >= 0 AND w2 >= 0 AND w3 >= 0 GROUP BY 1, 2, 3""")
def volume_sample(t):
    return ry.sample_tets(_tets(t), 30, 30, 1000).select("x", "y", "z", F.round("s", 4).alias("s"))


@query("SELECT p_partkey, CAST(list_sum([(((k[1] >> b) & 1) << (3 * b)) + (((k[2] >> b) & 1) << (3 * b + 1)) + (((k[3] >> b) & 1) << (3 * b + 2)) for b in range(10)]) AS BIGINT) AS morton FROM (SELECT p_partkey, [p_partkey % 1024, CAST(p_size AS BIGINT), p_partkey // 7 % 1024] AS k FROM part)")
def morton_key(t):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", colors.morton([k % 1024, F.col("p_size"), F.floor(k / 7) % 1024]).alias("morton"))


@query("SELECT p_partkey, round(v, 6) AS value FROM (SELECT p_partkey, (SELECT sum(c * (CASE a WHEN 0 THEN 1 WHEN 1 THEN x * sqrt(3) ELSE (3 * x * x - 1) / 2 * sqrt(5) END) * (CASE b WHEN 0 THEN 1 WHEN 1 THEN y * sqrt(3) ELSE (3 * y * y - 1) / 2 * sqrt(5) END)) FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b), (SELECT 1) q(z), LATERAL (SELECT (a * 3 + b + 1) / 10.0::DOUBLE AS c) w) / 2 * (CASE WHEN deep THEN 2 ELSE 1 END) * 1 AS v FROM (SELECT p_partkey, false AS deep, ((p_partkey % 41) / 20.0::DOUBLE - 1) AS x, ((p_partkey % 37) / 18.0::DOUBLE - 1) AS y FROM part))")
def quadtree_points(t):
    k = F.col("p_partkey")
    points = t.part.select(k.alias("point_id"), ((k % 41) / 20.0 - 1).alias("x"), ((k % 37) / 18.0 - 1).alias("y"))
    leaves = t.spark.createDataFrame([(0, 0, -1.0, 1.0, -1.0, 1.0, [(i + 1) / 10 for i in range(9)])], "leaf_id long, lvl int, xmin double, xmax double, ymin double, ymax double, coeffs array<double>")
    return ry.quadtree_values(points, leaves, 0).select(F.col("point_id").alias("p_partkey"), r6("value").alias("value"))


# --- 2.9 plots, decomposition ----------------------------------------------------------------------


@query(f"WITH {CLOUD} SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM cl")
def plot_extents(t):
    return t.cloud().agg(*(f(a).alias(f"{a}{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))))


for _name, _log, _e in (
    ("normalize_linear", False, "CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.5 END"),
    ("normalize_log", True, "CASE WHEN v <= 0 OR lo <= 0 THEN 0.0 WHEN hi > lo THEN greatest(least((ln(v) - ln(lo)) / (ln(hi) - ln(lo)), 1), 0) ELSE 0.5 END"),
):
    query(f"SELECT p_partkey, round({_e}, 6) AS value FROM (SELECT p_partkey, p_retailprice AS v FROM part), (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)", _name)(
        lambda t, log=_log: t.part.join(F.broadcast(t.part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")))).select("p_partkey", r6(colors.normalize(F.col("p_retailprice"), F.col("lo"), F.col("hi"), log)).alias("value"))
    )


def _color_sql(table, c: int) -> str:
    out = repr(float(table[-1][c]))
    for a, b in reversed(list(zip(table, table[1:]))):
        out = f"CASE WHEN t < {b[0]!r} THEN {a[c]!r}::DOUBLE + ({b[c]!r}::DOUBLE - {a[c]!r}::DOUBLE) * (t - {a[0]!r}::DOUBLE) / {b[0] - a[0]!r}::DOUBLE ELSE {out} END"
    return f"CASE WHEN t <= {table[0][0]!r} THEN {table[0][c]!r} ELSE {out} END"


_RB = colors.TABLES["rainbow"]


@query("SELECT p_partkey, " + ", ".join(f"round({_color_sql(_RB, c)}, 6) AS {n}" for c, n in ((1, "r"), (2, "g"), (3, "b"))) + " FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS t FROM part)")
def colormap(t):
    rgb = colors.color(F.col("p_size") / 50.0, _RB)
    return t.part.select("p_partkey", *(r6(c).alias(n) for c, n in zip(rgb, "rgb")))


_PARTS = (2, 2, 3)


@query(f"WITH {G3} SELECT cell_id, (cell_id % 9) * 2 // 9 + 2 * (((cell_id // 9) % 9) * 2 // 9) + 4 * ((cell_id // 81) * 3 // (nz - 1)) AS block_id FROM g3c, g3d")
def decompose_blocks(t):
    grid, _, cells = t.g3()
    return g.blocks(cells.select("cell_id"), grid, _PARTS).select("cell_id", F.col("block_id").cast("long").alias("block_id"))


@query(f"""WITH {G3}, w AS (SELECT cell_id, cell_id % 9 AS i, (cell_id // 9) % 9 AS j, cell_id // 81 AS k, nz - 1 AS m FROM g3c, g3d), o AS (SELECT unnest([-1, 0, 1]) AS d),
n AS (SELECT DISTINCT cell_id, i * 2 // 9 + 2 * (j * 2 // 9) + 4 * (k * 3 // m) AS own, greatest(least(i + a.d, 8), 0) * 2 // 9 + 2 * (greatest(least(j + b.d, 8), 0) * 2 // 9) + 4 * (greatest(least(k + c.d, m - 1), 0) * 3 // m) AS block_id FROM w, o a, o b, o c)
SELECT block_id, cell_id, CASE WHEN own <> block_id THEN 1 ELSE 0 END AS ghost FROM n""")
def ghost_cells(t):
    grid, _, cells = t.g3()
    return g.with_ghosts(cells.select("cell_id"), grid, _PARTS).select(F.col("block_id").cast("long").alias("block_id"), "cell_id", "ghost")


# --- 3 the composite: points of one kind, their distance field, its surface, cut by a box ----------


def atom_pipeline(t: Tables, size: int = 40, value: float = 4.0) -> DataFrame:
    from fieldloom.model import GridSpec

    grid = GridSpec((size, size, 10))
    n = g.nodes(t.spark, grid).select("node_id", (F.col("i") * 0.5).alias("x"), (F.col("j") * 0.5).alias("y"), (F.col("k") * 2.5).alias("z"))
    field = cp.distance_field(n, t.cloud().where("node_id % 2 = 0"))
    p, c = geo.isosurface(field, g.cells(t.spark, grid), "dist", value, ("x", "y", "z"))
    inside = sel.box(c, p.withColumnRenamed("point_id", "node_id"), {"x": (0.0, 9.0), "y": (0.0, 12.0)})
    return inside.select("cell_id", "sub", *(F.col("nodes")[k].alias(f"n{k}") for k in range(3)))


def _vox_end(e: str, side: int, steps: tuple[int, int, int]) -> str:
    """SQL of a voxel's node at one end of local edge e, from its first node b."""
    return f"CASE {e} " + " ".join(f"WHEN {i} THEN tr.b + {sum(d for bit, d in zip((1, 2, 4), steps) if ends[side] & bit)}" for i, ends in enumerate(EDGES[Shape.VOXEL])) + " END"


query(
    f"""WITH {CLOUD}, nd AS (SELECT n AS node_id, n % 40 AS i, (n // 40) % 40 AS j, n // 1600 AS k, (n % 40) * 0.5::DOUBLE AS x, ((n // 40) % 40) * 0.5::DOUBLE AS y, (n // 1600) * 2.5::DOUBLE AS z FROM (SELECT unnest(range(16000)) AS n)),
fd AS (SELECT nd.*, d.f FROM nd JOIN (SELECT n.node_id, min(sqrt((n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y) + (n.z - c.z) * (n.z - c.z))) AS f FROM nd n, cl c WHERE c.node_id % 2 = 0 GROUP BY 1) d USING (node_id)),
e AS (SELECT a.node_id AS a, b.node_id AS b, (4.0::DOUBLE - a.f) / (b.f - a.f) AS t, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM fd a JOIN (SELECT *, node_id - 1 AS m FROM fd WHERE i > 0 UNION ALL SELECT *, node_id - 40 FROM fd WHERE j > 0 UNION ALL SELECT *, node_id - 1600 FROM fd WHERE k > 0) b ON a.node_id = b.m WHERE (a.f < 4) <> (b.f < 4)),
pts AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS point_id, a, b, ax + (bx - ax) * t AS x, ay + (by_ - ay) * t AS y FROM e),
vc AS (SELECT c AS cell_id, c % 39 + 40 * ((c // 39) % 39) + 1600 * (c // 1521) AS b FROM (SELECT unnest(range(13689)) AS c)),
cs AS (SELECT cell_id, any_value(b) AS b, CAST(sum(CASE WHEN f < 4 THEN 1 << o.slot ELSE 0 END) AS BIGINT) AS case_id FROM vc, (VALUES (0, 0), (1, 1), (2, 40), (3, 41), (4, 1600), (5, 1601), (6, 1640), (7, 1641)) o(slot, d) JOIN fd ON fd.node_id = vc.b + o.d GROUP BY 1),
tr AS (SELECT cell_id, b, sub, e0, e1, e2 FROM cs JOIN {_case_values(Shape.VOXEL)} t(case_id, sub, e0, e1, e2) USING (case_id))
SELECT cell_id, sub, p0.point_id AS n0, p1.point_id AS n1, p2.point_id AS n2 FROM tr """
    + " ".join(f"JOIN pts p{k} ON p{k}.a = least({_vox_end(f'e{k}', 0, (1, 40, 1600))}, {_vox_end(f'e{k}', 1, (1, 40, 1600))}) AND p{k}.b = greatest({_vox_end(f'e{k}', 0, (1, 40, 1600))}, {_vox_end(f'e{k}', 1, (1, 40, 1600))})" for k in range(3))
    + " WHERE " + " AND ".join(f"p{k}.x BETWEEN 0 AND 9 AND p{k}.y BETWEEN 0 AND 12" for k in range(3)),
    "atom_pipeline",
)(atom_pipeline)


_ELEMENTS = "(VALUES ('H', 1, 0.32), ('C', 6, 0.77), ('O', 8, 0.73), ('FE', 26, 1.17), ('U', 92, 1.96), ('XX', 0, 0.1)) e(symbol, number, radius)"
_RESIDUES = "(VALUES ('ALA', 1, 'A'), ('GLY', 7, 'G'), ('TRP', 20, 'W'), ('HOH', 0, '?')) r(name, number, letter)"


@query(f"SELECT p_partkey, e.number, CAST(radius AS DOUBLE) AS covalent_radius, r.number AS residue_number, letter FROM part JOIN {_ELEMENTS} ON symbol = list_extract(['H', 'C', 'O', 'FE', 'U', 'XX'], p_partkey % 6 + 1) JOIN {_RESIDUES} ON name = list_extract(['ALA', 'GLY', 'TRP', 'HOH'], p_partkey % 4 + 1)")
def atom_properties(t):
    """Parts as atoms of six elements (one unknown) and four residues."""
    k = F.col("p_partkey")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), k % len(names))
    atoms = t.part.select("p_partkey", pick(["H", "C", "O", "FE", "U", "XX"]).alias("element"), pick(["ALA", "gly", "TRP", "HOH"]).alias("restype"))
    return ch.with_residues(ch.with_elements(atoms)).select("p_partkey", "number", "covalent_radius", "residue_number", "letter")


@query(f"""WITH vs AS ({SQL['volume_sample']}), r AS (SELECT min(s) AS lo, max(s) AS hi FROM vs), n AS (SELECT x, y, z, (s - lo) / (hi - lo) AS v FROM vs, r), a AS (SELECT *, 0.02::DOUBLE * exp(-(v - 0.5) * (v - 0.5) / (2 * 0.13::DOUBLE * 0.13::DOUBLE)) AS a FROM n),
w AS (SELECT *, coalesce(exp(sum(ln(1 - a)) OVER (PARTITION BY x, y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS through FROM a)
SELECT x, y, round(sum(v * a * through), 6) AS color, round(1 - exp(sum(ln(1 - a))), 6) AS opacity FROM w GROUP BY 1, 2""")
def volume_render(t):
    """The whole chain: tetrahedra, samples of their lattice, a transfer function, and one color a pixel."""
    s = settle(t.spark, volume_sample(t), "samples")  # read for its range, then for the blend
    r = s.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    v = s.join(F.broadcast(r)).select("x", "y", "z", ((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("v"))  # r is one row
    c = ry.composite(v, ["x", "y"], "z", "v", ry.gaussian_opacity(F.col("v")))
    return c.select("x", "y", r6("color").alias("color"), r6("opacity").alias("opacity"))


# --- more of the primitives, fields and images -----------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_discount + l_tax AS value FROM lineitem")
def map_zip3(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", pr.binary("add", F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).alias("value"))


@query("SELECT CAST(bit_xor(o_orderkey) AS BIGINT) AS folded FROM orders")
def reduce_custom(t):
    """A fold with a merge and an identity of one's own."""
    x = pr.reduce_with(t.orders.select(F.col("o_orderkey").cast("long").alias("v")), "v", lambda a, b: a.bitwiseXOR(b), 0)
    return t.spark.createDataFrame([(x,)], "folded long")


@query(f"WITH {GRAPH} SELECT n.node_id, round(coalesce(avg(x.cents), 0), 4) AS v0, round(coalesce(avg(x.cents * 2), 0), 4) AS v1, round(coalesce(avg(x.cell_id % 7), 0), 4) AS v2 FROM grn n LEFT JOIN (SELECT a AS node_id, cents, cell_id FROM gr UNION ALL SELECT b, cents, cell_id FROM gr) x USING (node_id) GROUP BY 1")
def recenter_vector(t):
    points, cells = t.graph()
    c = F.col("cents")
    got = cp.recenter(points, cells.withColumn("w", F.array(c.cast("double"), c * 2.0, (F.col("cell_id") % 7).cast("double"))), "w", "w", ncomp=3)
    return got.select("node_id", *(F.round(F.col("w")[k], 4).alias(f"v{k}") for k in range(3)))


@query("SELECT pixel, min(z) AS z, round(coalesce(avg(v) FILTER (WHERE v <> 0), 0), 6) AS value FROM (SELECT *, min(z) OVER (PARTITION BY pixel) AS m FROM (SELECT user_id % 50 AS pixel, CAST(event_id % 17 AS DOUBLE) AS z, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS v FROM events)) WHERE z = m GROUP BY 1")
def z_composite_background(t):
    """Of equal depths, the background color gives way."""
    k = F.col("event_id")
    e = t.events.select((F.col("user_id") % 50).alias("pixel"), (k % 17).cast("double").alias("z"), F.when(k % 3 == 0, 0.0).otherwise(F.col("value")).alias("value"))
    return ry.z_composite(e, "pixel", "z", "value", background=(0.0,)).select("pixel", "z", r6("value").alias("value"))


@query("SELECT p_partkey, " + ", ".join(f"round({_color_sql(colors.TABLES['Spectral'], c)}, 6) AS {n}" for c, n in ((1, "r"), (2, "g"), (3, "b"))) + " FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS t FROM part)")
def colormap_spectral(t):
    rgb = colors.color(F.col("p_size") / 50.0, colors.TABLES["Spectral"])
    return t.part.select("p_partkey", *(r6(c).alias(n) for c, n in zip(rgb, "rgb")))


def _nearest_sql(table, c: int) -> str:
    out = repr(float(table[-1][c]))
    for a, b in reversed(list(zip(table, table[1:]))):
        out = f"CASE WHEN t < {b[0]!r} THEN CASE WHEN t < {(a[0] + b[0]) / 2!r} THEN {a[c]!r} ELSE {b[c]!r} END ELSE {out} END"
    return f"CAST(CASE WHEN t <= {table[0][0]!r} THEN {table[0][c]!r} ELSE {out} END AS DOUBLE)"


@query("SELECT p_partkey, " + ", ".join(f"{_nearest_sql(colors.TABLES['dense'], c)} AS {n}" for c, n in ((1, "r"), (2, "g"), (3, "b"))) + " FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS t FROM part)")
def colormap_nearest(t):
    rgb = colors.color(F.col("p_size") / 50.0, colors.TABLES["dense"], smooth=False)
    return t.part.select("p_partkey", *(c.cast("double").alias(n) for c, n in zip(rgb, "rgb")))


@query("SELECT CAST(k * 500 AS DOUBLE) AS place FROM (SELECT unnest(range(CAST(ceil(lo / 500) AS BIGINT), CAST(floor(hi / 500) AS BIGINT) + 1)) AS k FROM (SELECT 1000.0::DOUBLE AS lo, 3000.0::DOUBLE + 0 * count(*) AS hi FROM part))")
def axis_ticks(t):
    """Major ticks of an axis from 1000 to 3000."""
    return t.spark.createDataFrame([(float(x),) for x in colors.ticks(1000.0, 3000.0)[0]], "place double")


@query("SELECT s_suppkey AS id, round((s_nationkey + 1.0::DOUBLE) * cos(s_suppkey % 7), 6) + 0.0 AS x, round((s_nationkey + 1.0::DOUBLE) * sin(s_suppkey % 7), 6) + 0.0 AS y, s_acctbal AS z FROM supplier")
def particles(t):
    """Particles of a torus (r, phi, z) in space."""
    p = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 1.0).alias("r"), (F.col("s_suppkey") % 7).cast("double").alias("phi"), F.col("s_acctbal").alias("z"))
    return cp.torus_particles(p).select("id", r6("x").alias("x"), r6("y").alias("y"), "z")
