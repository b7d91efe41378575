import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import colors, grid as g, matrix as mx
from fieldloom.model import EDGES, FACES, FieldInfo, GridSpec, MeshDataset, Shape
from fieldloom.operators import compute as cp, geometry as geo, primitives as pr, rays as ry, select as sel, topology as tp
from fieldloom.shared import settle
from fieldloom.streaming import steps as st


def ids(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.mark.parametrize("dims", [(5,), (4, 3), (3, 4, 3)])
def test_structured_equals_explicit(spark, dims):
    grid = GridSpec(dims)
    cells, nodes = g.cells(spark, grid), g.nodes(spark, grid)
    assert cells.count() == grid.n_cells and g.edges(spark, grid).count() == sum(grid.edge_counts)
    ends = {r.edge_id: (r.a, r.b) for r in g.edges(spark, grid).collect()}
    for r in cells.withColumn("e", g.cell_edges(F.col("cell_id"), grid)).collect():
        assert [ends[e] for e in r.e] == [tuple(sorted((r.nodes[a], r.nodes[b]))) for a, b in EDGES[grid.shape]]
    assert ids(tp.edges(cells), "a", "b") == sorted(ends.values())
    around = {r.node_id: r.c for r in nodes.withColumn("c", g.node_cells(F.col("node_id"), grid)).collect()}
    want = {}
    for r in cells.collect():
        for n in r.nodes:
            want.setdefault(n, []).append(r.cell_id)
    assert around == {k: sorted(v) for k, v in want.items()}
    if len(dims) == 3:
        face = {r.face_id: sorted(r.nodes) for r in g.faces(spark, grid).collect()}
        assert len(face) == sum(grid.face_counts)
        for r in cells.withColumn("f", g.cell_faces(F.col("cell_id"), grid)).collect():
            assert [face[k] for k in r.f] == [sorted(r.nodes[n] for n in f) for f in FACES[Shape.VOXEL]]
        assert tp.faces(cells).count() == len(face)
        a, b, c = grid.cell_dims
        assert sel.external_faces(cells).count() == 2 * (a * b + b * c + c * a)


def test_case_tables_close_and_agree_across_faces():
    for s in (Shape.TET, Shape.PYRAMID, Shape.WEDGE, Shape.HEX, Shape.VOXEL):
        for case, tris in geo.case_table(int(s)).items():
            crossed = {i for i, (a, b) in enumerate(EDGES[s]) if (case >> a & 1) != (case >> b & 1)}
            assert {e for t in tris for e in t} == crossed
            sides = {}
            for t in tris:
                for k in range(3):
                    e = frozenset((t[k], t[(k + 1) % 3]))
                    sides[e] = sides.get(e, 0) + 1
            nodes_of = [frozenset(f) for f in FACES[s]]
            for e, n in sides.items():  # a side that one triangle has lies in a face
                assert n == 2 or any(set(EDGES[s][i]) <= f for i in [min(e)] for f in nodes_of)
    assert len(geo.case_table(int(Shape.VOXEL))) == 254 and geo.case_table(int(Shape.PIXEL))[6] and len(geo.case_table(int(Shape.PIXEL))[6]) == 2


def test_primitives(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 13).alias("v"))
    vals = [i * 7 % 13 for i in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as partitions
    for inclusive in (True, False):
        got = [r.scan for r in pr.scan(df, "id", "v", inclusive).orderBy("id").collect()]
        assert got == [sum(vals[: i + inclusive]) for i in range(1000)]
    assert [r.id for r in pr.argsort(df, "v", "id").orderBy("rank").collect()] == sorted(range(1000), key=lambda i: (vals[i], i))
    assert ids(pr.dense_ids(df.where("v > 6"), "id", out="n"), "n", "id") == [(n, i) for n, i in enumerate(i for i in range(1000) if vals[i] > 6)]
    ties = spark.createDataFrame([(None,), (5,), (5,), (None,), (-10**15,), (10**15,)] * 40, "k long")  # nulls, equal and sparse keys
    got = sorted((r.n, r.k) for r in pr.dense_ids(ties, "k", out="n").collect())
    assert [n for n, _ in got] == list(range(240)) and [k for _, k in got] == [None] * 80 + [-(10**15)] * 40 + [5] * 80 + [10**15] * 40
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pr.reduce_with(df, "v", F.greatest, 0, rows=30) == 12 and pr.reduce_with(df.where("id < 0"), "v", F.greatest, -1) == -1
    empty = df.where("id < 0")
    assert pr.scan(empty, "id", "v").count() == 0 and pr.argsort(empty, "v", "id").count() == 0
    assert pr.reverse_index(df.where("id < 3"), "v").count() == 7 + 1
    assert df.agg(pr.binary("div", F.sum("v"), F.sum("id") * 0).alias("x")).first().x is None
    one = df.where("id = 1").select(*(pr.unary(op, -F.col("v")).alias(op) for op in ("ln", "log2", "log10", "sqrt", "neg", "cube"))).first()
    assert one[:] == (None, None, None, None, 7.0, -343.0)


def test_stencil_borders(spark):
    grid = GridSpec((4, 3))
    n = g.nodes(spark, grid).withColumn("v", F.lit(2.0))
    assert pr.stencil3x3(n, "v", 4, 3).count() == 2 and {r.average for r in pr.stencil3x3(n, "v", 4, 3, border=True).collect()} == {2.0}


def test_recenter_and_histogram_invariants(spark):
    grid = GridSpec((5, 4))
    cells, nodes = g.cells(spark, grid).withColumn("f", F.lit(3.5)), g.nodes(spark, grid)
    assert {r[1] for r in cp.recenter(nodes, cells, "f").collect()} == {3.5}
    lone = nodes.union(spark.createDataFrame([(99, 0, 0)], nodes.schema))
    assert cp.recenter(lone, cells, "f").where("node_id = 99").first()[1] == 0.0
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 5, 9)] + [(None,)], "v double")
    h = cp.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [3, 0, 1, 1] and h[0].low == 1 and h[-1].high == 9
    assert [r.n for r in cp.histogram(df.where("v = 2"), "v", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_distance_field_bins_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    nodes, cloud = rng.uniform(-20, 20, (60, 2)), np.concatenate([rng.normal(0, 1, (300, 2)), [[19.0, -19.0]]])
    a = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(nodes)], "node_id long, x double, y double")
    b = spark.createDataFrame([tuple(map(float, p)) for p in cloud], "x double, y double")
    want = np.sqrt(((nodes[:, None] - cloud[None]) ** 2).sum(2)).min(1)
    for small in (4096, 10):
        monkeypatch.setattr(cp, "SMALL_CLOUD", small)
        got = [r.dist for r in cp.distance_field(a, b, ("x", "y")).orderBy("node_id").collect()]
        assert np.allclose(got, want)
    assert {r.dist for r in cp.distance_field(a, b.limit(0), ("x", "y")).collect()} == {-1.0}


def test_ray_bins_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    o, d = rng.uniform(-6, 6, (80, 3)), rng.normal(0, 1, (80, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    rays = spark.createDataFrame([(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(o, d))], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    c = rng.uniform(-4, 4, (200, 3))
    t = np.concatenate([c, c + rng.normal(0, 1.5, (200, 3)), c + rng.normal(0, 1.5, (200, 3))], 1)
    tris = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(t)], "idx long, " + ", ".join(f"{p}{a} double" for p in "abc" for a in "xyz"))
    balls = spark.createDataFrame([(i, *map(float, x), 0.5) for i, x in enumerate(c)], "idx long, cx double, cy double, cz double, r double")
    rods = spark.createDataFrame([(i, *map(float, x), 0.0, 0.6, 0.8, 2.0, 0.3) for i, x in enumerate(c)], "idx long, bx double, by double, bz double, ax double, ay double, az double, h double, r double")
    scene = {"triangle": tris, "sphere": balls, "cylinder": rods}
    for kinds in (scene, *({k: v} for k, v in scene.items())):
        few, binned = ry.nearest(rays, kinds).orderBy("ray_id").collect(), ry.nearest(rays, kinds, small=0).orderBy("ray_id").collect()
        assert [(r.kind, r.idx) for r in few] == [(r.kind, r.idx) for r in binned] and any(r.idx >= 0 for r in few)
        assert np.allclose([r.dist for r in few], [r.dist for r in binned])


def test_transform_and_matrices(spark):
    p = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "node_id long, x double, y double, z double")
    m = mx.translate(1, 0, 0) @ mx.rotate(2, math.pi / 2)
    assert np.allclose(cp.transform(p, m).first()[1:], (-1, 1, 3))
    persp = mx.perspective(1.0, 1.0, 10.0, 1.0) @ mx.view((0, 0, 5), (0, 0, 0), (0, 1, 0))
    v = persp @ [1, 2, 3, 1]
    assert np.allclose(cp.transform(p, persp).first()[1:], v[:3] / v[3])
    assert np.allclose(mx.invert(m) @ m, np.eye(4)) and mx.determinant(mx.scale(2, 3, 4)) == pytest.approx(24)
    assert np.allclose(mx.trackball(0, 0, 0, 0), np.eye(4)) and mx.determinant(mx.trackball(0.1, 0, 0.4, 0.2)) == pytest.approx(1)


def test_colors_and_ticks(spark):
    t = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.1, 0.2, 0.3, 1.0, 2.0)], "t double")
    got = [tuple(r) for r in t.select(*colors.color(F.col("t"), colors.TABLES["dense"])).collect()]
    assert got[0] == got[1] == (0.26, 0.22, 0.92) and got[3] == (0.0, 1.0, 1.0) and got[-1] == (1.0, 0.4, 1.0)
    near = [tuple(r) for r in t.select(*colors.color(F.col("t") + 0.04, colors.TABLES["dense"], smooth=False)).collect()]
    assert near[3] == (0.0, 1.0, 1.0)
    assert colors.ticks(0, 10)[0] == [0, 2, 4, 6, 8, 10] and colors.ticks(0.5, 200, log=True)[0] == [1.0, 10.0, 100.0]
    assert colors.reverse(colors.TABLES["grey"]) == [(0.0, 1.0, 1.0, 1.0), (1.0, 0.0, 0.0, 0.0)]


def test_dataset_round_trip(spark, tmp_path):
    grid = GridSpec((3, 3))
    ds = MeshDataset(g.nodes(spark, grid).withColumn("v", F.lit(1.0)), {"c": g.cells(spark, grid)}, None, (FieldInfo("v"),), grid, time=2.0)
    ds.save(f"{tmp_path}/m")
    back = MeshDataset.load(spark, f"{tmp_path}/m")
    assert back.grid == grid and back.field("v").assoc == "points" and back.time == 2.0 and back.cellset().count() == 4
    with pytest.raises(KeyError):
        back.cellset("x")
    with pytest.raises(KeyError):
        back.field("x")


def test_decomposition(spark):
    assert g.best_factors(4, (8, 8, 1)) == (2, 2, 1) and g.best_factors(8, (8, 8, 8)) == (2, 2, 2) and g.best_factors(3, (9,)) == (3,)
    grid = GridSpec((5, 5, 5))
    cells = g.cells(spark, grid).select("cell_id")
    own = {r.cell_id: r.block_id for r in g.blocks(cells, grid, (2, 2, 2)).collect()}
    rows = g.with_ghosts(cells, grid, (2, 2, 2)).collect()
    assert {r.cell_id: r.block_id for r in rows if not r.ghost} == own and sum(r.ghost for r in rows) == 8 * (27 - 8)


def test_layout_and_tessellation(spark):
    nodes = spark.range(12).withColumnRenamed("id", "node_id")
    edges = nodes.select(F.col("node_id").alias("a"), ((F.col("node_id") + 1) % 12).alias("b"))
    a, b = (sorted(map(tuple, geo.graph_layout(nodes, edges, rounds=5).collect())) for _ in range(2))
    assert a == b and len(a) == 12 and all(abs(x) < 20 for _, x, _ in a)
    assert geo.graph_layout(nodes.limit(0), edges).count() == 0
    grid = GridSpec((3, 3))
    p = g.nodes(spark, grid).select("node_id", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.lit(0.0).alias("z"))
    pts, quads = geo.tessellate(p, g.cells(spark, grid), 9)
    assert pts.count() == 9 + 4 * 5 and quads.count() == 16
    at = {r.node_id: (r.x, r.y) for r in pts.collect()}
    area = lambda q: abs(sum(at[q[k]][0] * at[q[k - 3]][1] - at[q[k - 3]][0] * at[q[k]][1] for k in range(4))) / 2
    assert sum(area(r.nodes) for r in quads.collect()) == pytest.approx(4.0)


def test_streams(spark, tmp_path):
    src, seen = f"{tmp_path}/in", []
    for k in range(3):
        spark.createDataFrame([(k, 1.0 * k)], "id long, v double").write.mode("append").parquet(src)
    q = st.each_step(st.open_steps(spark, src, "id long, v double"), lambda df, n: seen.append((n, df.count())), f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert [c for _, c in seen if c] == [1, 1, 1]  # files without rows are steps too
    rows = spark.createDataFrame([("2024-01-01 00:00:10", 1.0), ("2024-01-01 00:00:50", 3.0), ("2024-01-01 00:01:10", 5.0)], "t string, v double").withColumn("t", F.to_timestamp("t"))
    got = sorted((r.n, r.total) for r in st.windows(rows, "t", "v", "1 minute").collect())
    assert got == [(1, 5.0), (2, 4.0)]


def test_topology_variants(spark):
    conn = spark.createDataFrame([(0, 10), (0, 11), (1, 11), (2, 12)], "dst_id long, src_id long")
    src = spark.createDataFrame([(10, 1.0), (11, 2.0), (12, 5.0)], "src_id long, v double")
    agg = {"v": F.sum("v")}
    assert ids(tp.topology_map(conn, src, agg), "dst_id", "v") == [(0, 3.0), (1, 2.0), (2, 5.0)]
    index = spark.createDataFrame([(0, 2), (1, 0)], "dense_id long, dst_id long")
    assert ids(tp.topology_map(conn, src, agg, index), "dense_id", "v") == [(0, 5.0), (1, 3.0)]
    out = spark.createDataFrame([(0, -1.0), (1, -1.0), (2, -1.0)], "dst_id long, v double")
    assert ids(tp.topology_map(conn, src, agg, index, out=out), "dst_id", "v") == [(0, 3.0), (1, -1.0), (2, 5.0)]


def test_polygons(spark):
    cells = spark.createDataFrame([(0, 11, [0, 1, 2, 3, 4]), (1, 10, [5, 6, 7, 8])], "cell_id long, shape int, nodes array<long>")
    assert ids(tp.triangles(cells), "cell_id", "nodes") == [(0, [0, 1, 2]), (0, [0, 2, 3]), (0, [0, 3, 4]), (1, [5, 6, 7]), (1, [6, 7, 8])]
    assert tp.cell_edges(cells.where("shape = 11")).count() == 5
    assert sel.box(cells, spark.range(9).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("x")), {"x": (0, 4)}).first().cell_id == 0


def test_layout_is_the_textbook_one(spark):
    """Five rounds against numpy: every pair pushes, edges pull, gravity draws to the middle, moves are cut to the limit."""
    n, k = 9, (1.0 / 9) ** 0.5
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    pairs = [(i, (i * 2 + 1) % n) for i in range(n)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    u = lambda salt: F.pmod(F.xxhash64("node_id", F.lit(1), F.lit(salt)), F.lit(1 << 20)) / float(1 << 20) - 0.5
    at = np.array([[r.x, r.y] for r in nodes.select("node_id", u(1).alias("x"), u(2).alias("y")).orderBy("node_id").collect()])
    for r in range(5):
        limit, new = 0.005 ** (r / 4), at.copy()
        for i in range(n):
            move = -0.3 / k * at[i]
            for j in range(n):
                d = at[i] - at[j]
                move = move + d * k * k / max(d @ d, 1e-12)
            for a, b in pairs:
                if a != b and i in (a, b):
                    d = at[b if i == a else a] - at[i]
                    move = move + d * np.sqrt(d @ d) / k
            size = np.sqrt(move @ move)
            new[i] = at[i] + move / max(size, 1e-12) * min(size, limit)
        at = new
    got = np.array([[r.newx, r.newy] for r in geo.graph_layout(nodes, edges, rounds=5).orderBy("node_id").collect()])
    assert np.allclose(got, at, atol=1e-9)


def test_distance_of_no_nodes_equal_nodes_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(cp, "SMALL_CLOUD", 3)
    cloud = spark.createDataFrame([(float(i), float(i % 3)) for i in range(20)], "x double, y double")
    nodes = spark.createDataFrame([(1, 0.5, 0.0), (1, 0.5, 0.0), (2, 100.0, 0.0), (3, None, 1.0)], "node_id long, x double, y double")
    assert cp.distance_field(nodes.limit(0), cloud, ("x", "y")).collect() == []
    got = sorted(cp.distance_field(nodes, cloud, ("x", "y")).collect(), key=lambda r: r.node_id)
    assert [r.node_id for r in got] == [1, 1, 2, 3] and got[0] == got[1] and got[0].dist == 0.5 and got[3].dist is None
    assert got[2].dist == pytest.approx(min(math.hypot(100 - i, i % 3) for i in range(20)))


def test_ray_without_direction_misses_in_both_ways(spark):
    rays = spark.createDataFrame([(0, 0.1, 0.1, -1.0, 0.0, 0.0, 0.0), (1, 0.1, 0.1, -1.0, 0.0, 0.0, 1.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    tri = spark.createDataFrame([(5, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "idx long, " + ", ".join(f"{p}{a} double" for p in "abc" for a in "xyz"))
    for small in (10, 0):
        assert [r.idx for r in ry.nearest(rays, {"triangle": tri}, small=small).orderBy("ray_id").collect()] == [-1, 5]


def test_polygons_have_surfaces_and_unknown_shapes_raise(spark):
    """A polygon is cut as its fan: the crossing points of its edges are those of the fan's rim."""
    ring = [(math.cos(2 * math.pi * k / 7), math.sin(2 * math.pi * k / 7)) for k in range(7)]
    points = spark.createDataFrame([(k, *map(float, p), float(p[0])) for k, p in enumerate(ring)], "node_id long, x double, y double, v double")
    cells = spark.createDataFrame([(4, 11, list(range(7))), (5, 10, [0, 1, 2, 3])], "cell_id long, shape int, nodes array<long>")
    p, c = geo.isosurface(points, cells, "v", 0.1, ("x", "y"))
    rows = c.where("cell_id = 4").collect()
    assert rows and all(r["shape"] == 1 for r in rows) and len({r.sub for r in rows}) == len(rows)
    rim = {r.point_id for r in p.collect() if (r.b - r.a) in (1, 6)}
    ends = [n for r in rows for n in r.nodes]
    assert {n for n in ends if ends.count(n) == 1} <= rim and p.where("abs(x - 0.1) > 1e-9").isEmpty()
    assert not c.where("cell_id = 5").isEmpty()
    with pytest.raises(ValueError):
        geo.isosurface(points, cells.withColumn("shape", F.lit(12)), "v", 0.1)


def test_edges_of_polygons_of_any_size_keep_cell_order(spark):
    big = [(0, 11, list(range(100))), (1, 11, list(range(100, 170)))]
    got = tp.edges(spark.createDataFrame(big, "cell_id long, shape int, nodes array<long>")).orderBy("edge_id").collect()
    want = [tuple(sorted((c[2][k], c[2][(k + 1) % len(c[2])]))) for c in big for k in range(len(c[2]))]
    assert [(r.a, r.b) for r in got] == want


def test_blending_by_slabs(spark):
    """Slabs of any depth give the blend of one list, nearest sample last."""
    rng = np.random.default_rng(5)
    rows = [(int(p), float(z), float(v), float(a)) for p, z, v, a in zip(rng.integers(0, 3, 300), rng.permutation(3000)[:300] - 1500, rng.random(300), rng.random(300) * 0.2)]
    df = spark.createDataFrame(rows, "pixel int, z double, v double, a double")
    want = {}
    for p in range(3):
        c = o = 0.0
        for _, _, v, a in sorted((r for r in rows if r[0] == p), key=lambda r: -r[1]):
            c, o = c * (1 - a) + v * a, o * (1 - a) + a
        want[p] = (c, o)
    for slab in (7, 256, 10_000):
        for r in ry.composite(df, ["pixel"], "z", "v", F.col("a"), slab=slab).collect():
            assert (r.color, r.opacity) == pytest.approx(want[r.pixel])
    assert ry.composite(df.limit(0), ["pixel"], "z", "v", F.col("a")).collect() == []


def test_closest_images_and_their_background(spark):
    rows = [(0, 1.0, 0.0), (0, 1.0, 4.0), (0, 1.0, 6.0), (0, 2.0, 9.0), (1, 3.0, 0.0), (1, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "pixel int, z double, v double")
    assert sorted(map(tuple, ry.z_composite(df, "pixel", "z", "v").collect())) == [(0, 1.0, 10 / 3), (1, 3.0, 0.0)]
    assert sorted(map(tuple, ry.z_composite(df, "pixel", "z", "v", background=(0.0,)).collect())) == [(0, 1.0, 5.0), (1, 3.0, 0.0)]


def test_traced_sphere_and_cylinder(spark):
    """Light and eye in front of each thing: the shade is ambient + 0.9 (diffuse + specular), and materials change it."""
    rays = spark.createDataFrame([(0, 0.0, 0.0, -5.0, 0.0, 0.0, 1.0), (1, 10.0, 0.0, -5.0, 0.0, 0.0, 1.0), (2, 50.0, 0.0, -5.0, 0.0, 0.0, 1.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    ball = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 1.0)], "idx long, cx double, cy double, cz double, r double")
    rod = spark.createDataFrame([(8, 10.0, -2.0, 0.0, 0.0, 1.0, 0.0, 4.0, 0.5)], "idx long, bx double, by double, bz double, ax double, ay double, az double, h double, r double")
    scene = {"sphere": ball, "cylinder": rod}
    hits = ry.hit_normals(ry.hit_points(rays, ry.nearest(rays, scene)), scene).orderBy("ray_id").collect()
    assert [(r.kind, r.idx, r.nx, r.ny, r.nz) for r in hits] == [("sphere", 7, 0, 0, -1), ("cylinder", 8, 0, 0, -1)]
    for x, k in ((0.0, 0), (10.0, 1)):
        got = ry.trace(rays, scene, (x, 0.0, -20.0), (x, 0.0, -5.0), bounces=0).orderBy("ray_id").collect()
        assert got[k].shade == pytest.approx(min(1.0, 0.2 + 0.9 * (0.6 + 0.3))) and got[k].depth == pytest.approx((4.0, 4.5)[k])
        assert (got[2].shade, got[2].depth) == (0.0, None)
    dull = spark.createDataFrame([("sphere", 7, 0.1, 0.2, 0.0, 1.0)], "kind string, idx long, ambient double, diffuse double, specular double, shine double")
    got = ry.trace(rays, scene, (0.0, 0.0, -20.0), (0.0, 0.0, -5.0), bounces=0, materials=dull, color=F.lit(0.5)).orderBy("ray_id").collect()
    assert got[0].shade == pytest.approx(0.5 * (0.1 + 0.9 * 0.2))


def test_schemes():
    assert len(colors.TABLES) == 44
    assert colors.TABLES["Blues"][1] == (0.125, 0.8706, 0.9216, 0.9686) and colors.TABLES["Accent"][1][:2] == (0.1429, 0.7451) and colors.TABLES["Spectral"][-1] == (1.0, 0.3686, 0.3098, 0.6353)
    for t in colors.TABLES.values():
        assert [p for p, *_ in t] == sorted(p for p, *_ in t) and all(0 <= c <= 1 for _, *rgb in t for c in rgb) and len(t[0]) == 4


def test_case_tables_have_the_known_sizes():
    """Lines of the square, triangles of the tetrahedron: one for a lone corner, two for a pair."""
    assert sum(map(len, geo.case_table(int(Shape.PIXEL)).values())) == 12 + 2 * 2 == sum(map(len, geo.case_table(int(Shape.QUAD)).values()))
    assert sum(map(len, geo.case_table(int(Shape.TET)).values())) == 8 + 6 * 2 and sum(map(len, geo.case_table(int(Shape.TRI)).values())) == 6
    for s, faces in FACES.items():  # each edge is in two faces, and corners - edges + faces = 2
        ends = [frozenset((f[k - 1], f[k])) for f in faces for k in range(len(f))]
        assert sorted(map(sorted, ends)) == sorted(sorted(e) for e in EDGES[s] for _ in range(2))
        assert len({n for f in faces for n in f}) - len(EDGES[s]) + len(faces) == 2


def test_wide_primitives_have_few_cells_that_are_not_sent_whole(spark):
    wide = spark.range(2000).selectExpr("id % 600 as idx", "0d as ax", "0d as ay", "id / 2000 as az", "10d as bx", "0d as by", "id / 2000 as bz", "0d as cx", "10d as cy", "id / 2000 as cz")
    wide = settle(spark, wide, "wide")
    rays = spark.createDataFrame([(0, -1.0, 1.0, 0.5, 1.0, 0.0, 0.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    pairs = ry.candidates(rays, wide, "triangle", small=0)
    assert 0 < pairs.count() <= 2000  # each pair once a cell, and the cells are as wide as the primitives
    lines = ry.candidates(rays, wide, "triangle", small=0)._jdf.queryExecution().sparkPlan().toString().splitlines()
    build = next(line for line in lines if "Join" in line and "_r0" in line)
    assert "BuildLeft" in build, "the rays' pieces are sent, not the primitives' cells"
    monkey = ry.PIECES
    try:
        ry.PIECES = 0  # neither side
        assert "SortMergeJoin" in ry.candidates(rays, wide, "triangle", small=0)._jdf.queryExecution().sparkPlan().toString()
    finally:
        ry.PIECES = monkey


def test_primitives_in_one_place_are_met_once(spark):
    tri = spark.range(3000).selectExpr("3000 - id as idx", "0d as ax", "0d as ay", "double(id % 3) as az", "1d as bx", "0d as by", "double(id % 3) as bz", "0d as cx", "1d as cy", "double(id % 3) as cz")
    tri = tri.union(spark.createDataFrame([(0, 0.0, 0.0, -9.0, 1.0, 0.0, -9.0, 0.0, 1.0, None)], tri.schema))
    rays = spark.createDataFrame([(0, 0.1, 0.1, -5.0, 0.0, 0.0, 1.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    for small in (ry.SMALL, 0):
        (got,) = ry.nearest(rays, {"triangle": tri}, small=small).collect()
        assert (got.idx, got.dist) == (3, 5.0)  # the least of a thousand at z = 0
    scene = ry.once({"triangle": tri})
    assert ids(scene["triangle"], "idx", "az") == [(1, 2.0), (2, 1.0), (3, 0.0)] and ry.once(scene) is scene


@pytest.mark.parametrize("n", [1, 63, 300, 1000])
def test_pushes_of_tiles_are_the_sum_over_all_pairs(n):
    xy = np.random.default_rng(n).random((n, 2))
    xy[: n // 3] = xy[0]  # equal places do not push
    own = xy[::2]
    d = own[:, None] - xy[None]
    want = (d * (0.01 / np.maximum((d**2).sum(2), 1e-12))[:, :, None]).sum(1)
    assert np.allclose(geo.pushes(own, xy, 0.1), want, rtol=1e-9, atol=1e-9)
    if n == 1000:  # several times as fast as whole rows of pairs, whose temporaries leave the cache
        def seconds(f):
            start = time.perf_counter()
            f()
            return time.perf_counter() - start

        big = np.random.default_rng(0).random((40_000, 2))

        def whole():
            d = big[:400, None] - big[None]
            return (d * (0.01 / np.maximum((d**2).sum(2), 1e-12))[:, :, None]).sum(1)

        assert 2 * min(seconds(lambda: geo.pushes(big[:400], big, 0.1)) for _ in range(3)) < min(seconds(whole) for _ in range(2))


def test_tessellation_has_more_tasks_for_more_points(spark, monkeypatch):
    monkeypatch.setattr(geo, "TASK_POINTS", 1)
    grid = GridSpec((4, 4))
    p = g.nodes(spark, grid).select("node_id", F.col("node_id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    cells = g.cells(spark, grid).withColumn("h", F.array(*[F.lit(1.0)] * 9))
    for fields in ((), ("h",)):
        points, _ = geo.tessellate(p, cells, 16, ("x", "y"), fields)
        assert points._jdf.queryExecution().sparkPlan().toString().count(", 16)") >= 3  # tasks for 16 points, not the session's 4
        assert points.count() == 16 + 9 * 5
