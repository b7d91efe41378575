import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import geometry as geo
from fieldloom.operators import select as sel
from fieldloom.sources import formats as fm
from fieldloom.sources import vtk

HEAD = "# vtk DataFile Version 3.0\nt\n{}\n"


def cube(binary=False):
    n = 4
    axis = np.arange(n, dtype=float)
    z, y, x = np.meshgrid(axis, axis, axis, indexing="ij")
    v = np.sqrt((x - 1.4) ** 2 + (y - 1.6) ** 2 + (z - 1.5) ** 2).ravel()
    kind = "BINARY" if binary else "ASCII"
    num = lambda a: a.astype(">f4").tobytes() + b"\n" if binary else (" ".join(map(repr, a.tolist())) + "\n").encode()
    out = (HEAD.format(kind) + f"DATASET RECTILINEAR_GRID\nFIELD F 1\ngroup 1 1 int\n").encode() + (struct.pack(">i", 7) + b"\n" if binary else b"7\n") + f"DIMENSIONS {n} {n} {n}\n".encode()
    for a in "XYZ":
        out += f"{a}_COORDINATES {n} float\n".encode() + num(axis)
    out += f"POINT_DATA {n**3}\nSCALARS d float\nLOOKUP_TABLE default\n".encode() + num(v)
    out += f"VECTORS w float\n".encode() + num(np.arange(3 * n**3, dtype=float))
    out += f"CELL_DATA {(n - 1) ** 3}\nFIELD C 1\nzonal 1 {(n - 1) ** 3} float\n".encode() + num(np.arange((n - 1) ** 3, dtype=float))
    return out, v


@pytest.mark.parametrize("binary", [False, True])
def test_vtk_grid(spark, tmp_path, binary):
    data, v = cube(binary)
    (tmp_path / "a.vtk").write_bytes(data)
    ds = fm.read(spark, f"{tmp_path}/a.vtk")
    assert ds.points.count() == 64 and ds.grid.dims == (4, 4, 4) and ds.whole.first()["group"] == 7
    rows = ds.points.orderBy("node_id").collect()
    assert np.allclose([r.d for r in rows], v, atol=1e-6) and rows[5].w == [15.0, 16.0, 17.0] and (rows[7].x, rows[7].y, rows[7].z) == (3, 1, 0)
    cells = ds.cellset("cells")
    assert cells.count() == 27 and cells.where("cell_id = 13").first().zonal == 13.0
    assert sel.external_faces(cells).count() == 54


def test_structured_and_explicit_agree_and_surface_is_closed(spark, tmp_path):
    data, _ = cube()
    (tmp_path / "a.vtk").write_bytes(data)
    ds = fm.read(spark, f"{tmp_path}/a.vtk")
    vtk.write(ds, f"{tmp_path}/b.vtk")
    back = fm.read(spark, f"{tmp_path}/b.vtk")
    hexes = back.cellset().withColumn("nodes", F.array(*[F.col("nodes")[k] for k in (0, 1, 3, 2, 4, 5, 7, 6)])).withColumn("shape", F.lit(8))
    for value in (0.9, 1.2):
        got = []
        for cells, points in ((ds.cellset(), ds.points), (back.cellset(), back.points), (hexes, back.points)):
            p, c = geo.isosurface(points, cells, "d", value, ("x", "y", "z", "d"), ("zonal",))
            tris = c.select(F.array_sort("nodes").alias("n"))
            edges = tris.select(F.explode(F.array(F.array(F.col("n")[0], F.col("n")[1]), F.array(F.col("n")[1], F.col("n")[2]), F.array(F.col("n")[0], F.col("n")[2]))).alias("e")).groupBy("e").count()
            assert edges.where("count <> 2").count() == 0  # closed
            assert p.count() - edges.count() + c.count() == 2
            assert p.where(f"abs(d - {value}) > 1e-9").count() == 0
            got.append((p.count(), c.count()))
        assert len(set(got)) == 1


def test_vtk_other_kinds(tmp_path):
    head = HEAD.format("ASCII")
    poly = vtk.parse((head + "DATASET POLYDATA\nPOINTS 4 float\n0 0 0 1 0 0 1 1 0 0 1 0\nVERTICES 1 3\n2 0 1\nLINES 2 7\n3 0 1 2\n2 2 3\nPOLYGONS 1 5\n4 0 1 2 3\nCELL_DATA 4\nSCALARS id int 1\nLOOKUP_TABLE default\n10 11 12 13\n").encode())[0]
    assert {k: (len(c.shapes), c.fields["id"].tolist()) for k, c in poly.cells.items()} == {"vertices": (2, [10, 10]), "lines": (3, [11, 11, 12]), "polygons": (1, [13])}
    mixed = vtk.parse((head + "DATASET UNSTRUCTURED_GRID\nPOINTS 5 float\n" + "0 " * 15 + "\nCELLS 4 15\n4 0 1 2 3\n2 0 1\n3 0 1 2\n2 0 1\nCELL_TYPES 4\n10 3 99 3\nCELL_DATA 4\nSCALARS v float\nLOOKUP_TABLE default\n1 2 3 4\n").encode())[0]
    assert {k: c.fields["v"].tolist() for k, c in mixed.cells.items()} == {"cells_other": [3.0], "cells_1d": [2.0, 4.0], "cells_3d": [1.0]}
    sp = vtk.parse((head + "DATASET STRUCTURED_POINTS\nDIMENSIONS 3 2 1\nORIGIN 1 2 3\nSPACING 0.5 1 1\n").encode())[0]
    assert sp.points[-1].tolist() == [2.0, 3.0, 3.0] and sp.dims == (3, 2)
    with pytest.raises(ValueError):
        vtk.parse(b"no")
    with pytest.raises(ValueError):
        vtk.parse((head + "DATASET POLYDATA\nTENSORS x float\n").encode())


@pytest.mark.parametrize("zonal", [False, True])
def test_bricks(spark, tmp_path, zonal):
    size, small = (4, 2, 2), (2, 2, 1)
    full = np.arange(16, dtype=">i2")
    for b in range(4):  # chunks: i fastest
        ids = [x + 2 * (b % 2) + 4 * (y + 2 * (b // 2)) for y in range(2) for x in range(2)]
        (tmp_path / f"d{b:03d}.raw").write_bytes(full[ids].tobytes())
    (tmp_path / "a.bov").write_text(f"TIME: 1\nDATA_FILE: d%03d.raw\nDATA SIZE: 4 2 2\nDATA_BRICKLETS: 2 2 1\nDATA FORMAT: SHORT\nVARIABLE: v\nDATA_ENDIAN: BIG\nCENTERING: {'zonal' if zonal else 'nodal'}\nBRICK ORIGIN: 1 0 0\nBRICK X_AXIS: 6 0 0\nBRICK_Y_AXIS: 0 2 0\nBRICK_Z_AXIS: 0 0 2\n")
    ds = fm.read(spark, f"{tmp_path}/a.bov")
    df, key = (ds.cellset(), "cell_id") if zonal else (ds.points, "node_id")
    assert [r.v for r in df.orderBy(key).collect()] == list(range(16))
    assert ds.points.agg(F.min("x"), F.max("x")).first()[:] == (1.0, 7.0) and ds.field("v").assoc == ("cells" if zonal else "points")


def test_curves(spark, tmp_path):
    (tmp_path / "a.curve").write_text("# one\n0 1\n1 2.5\n\n#two\n0 3\n")
    got = fm.read(spark, f"{tmp_path}/a.curve").orderBy("curve", "i").collect()
    assert [(r.curve, r.i, r.x, r.vals) for r in got] == [("one", 0, 0.0, 1.0), ("one", 1, 1.0, 2.5), ("two", 0, 0.0, 3.0)]


def test_dump(spark, tmp_path):
    step = "ITEM: TIMESTEP\n{}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 20\n-5 5\nITEM: ATOMS id type xs ys zs q\n1 1 0.5 0.5 0.5 1.5\n2 3 0 1 0.25 -1\n"
    (tmp_path / "a.dump").write_text(step.format(0) + step.format(100).replace("xs ys zs", "x y z"))
    ds = fm.read(spark, f"{tmp_path}/a.dump")
    got = ds.points.orderBy("time", "node_id").collect()
    assert [(r.time, r.x, r.y, r.z, r.type, r.id, r.q) for r in got] == [(0, 5, 10, 0, 0, 1, 1.5), (0, 0, 20, -2.5, 2, 2, -1), (100, 0.5, 0.5, 0.5, 0, 1, 1.5), (100, 0, 1, 0.25, 2, 2, -1)]


def test_protein(spark, tmp_path):
    atom = "{:6s}{:5d} {:4s} {:3s} A{:4d}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}          {:>2s}\n"
    rows = [("ATOM", 1, " N", "GLY", 1, 0, 0, 0, 1, 5, "N"), ("ATOM", 2, " CA", "GLY", 1, 1.4, 0, 0, 1, 6, "C"), ("ATOM", 3, " H", "GLY", 1, -1.0, 0, 0, 1, 7, "H"), ("HETATM", 4, " O", "HOH", 2, 9, 9, 9, 1, 8, "O")]
    (tmp_path / "a.pdb").write_text("HEADER x\n" + "".join(atom.format(*r) for r in rows) + "END\n")
    ds = fm.read(spark, f"{tmp_path}/a.pdb")
    pts = ds.points.orderBy("node_id").collect()
    assert [(p.element, p.restype, p.resseq, p.backbone, p.tempfactor, p.x) for p in pts] == [("N", "GLY", 1, 1, 5.0, 0.0), ("C", "GLY", 1, 1, 6.0, 1.4), ("H", "GLY", 1, 0, 7.0, -1.0), ("O", "HOH", 2, 1, 8.0, 9.0)]
    assert sorted(c.nodes for c in ds.cellset("bonds").collect()) == [[0, 1], [0, 2]]


def png(px, filters=(0, 1, 2, 3, 4)):
    h, w, ch = px.shape
    raw, before = b"", np.zeros(w * ch, int)
    for y in range(h):
        line, f = px[y].ravel().astype(int), filters[y % len(filters)]
        out = []
        for x in range(w * ch):
            a, b, c = (line[x - ch] if x >= ch else 0), before[x], (before[x - ch] if x >= ch else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((line[x] - [0, a, b, (a + b) // 2, paeth][f]) & 255)
        raw += bytes([f, *out])
        before = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[ch], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    for ch in (1, 2, 3, 4):
        px = rng.integers(0, 256, (7, 5, ch)).astype(np.uint8)
        got = fm.png_pixels(png(px))
        assert got.shape == (7, 5, 4) and (got[:, :, -1] == (px[:, :, -1] if ch in (2, 4) else 255)).all() and (got[:, :, 0] == px[:, :, 0]).all()
    (tmp_path / "a.png").write_bytes(png(px))
    ds = fm.read(spark, f"{tmp_path}/a.png")
    assert ds.points.count() == 48 and [r.g for r in ds.cellset("pixels").orderBy("cell_id").limit(5).collect()] == px[-1, :, 1].tolist()
    df = spark.createDataFrame([(0, 1.0), (3, 3.0)], "pixel long, value double")
    fm.write_pnm(df, f"{tmp_path}/a.pnm", 2, 2)
    assert (tmp_path / "a.pnm").read_bytes() == b"P6\n2 2\n255\n" + bytes([0, 0, 0, 255, 255, 255, 0, 0, 0, 0, 0, 0])


def test_quadtree(spark, tmp_path):
    node = lambda l, x, y, c, k: f" ({l},[{x},{y}])  -->  (has_coeff={str(c).lower()}, has_children={str(k).lower()}, norm=1)\n" + ("".join(f"[{i},*] {i + 1}.0 0 0\n" for i in range(3)) if c else "[empty tensor]\n")  # noqa: E731, E741
    text = "tree\n" + node(0, 0, 0, False, True) + "".join(node(1, x, y, True, False) for y in (0, 1) for x in (0, 1))
    (tmp_path / "a.madness").write_text(text)
    ds = fm.read(spark, f"{tmp_path}/a.madness")
    cells = ds.cellset("leaves").orderBy("cell_id").collect()
    assert [c["levels"] for c in cells] == [1] * 4 and cells[0].cell_biquadratic == [1.0, 0, 0, 2.0, 0, 0, 3.0, 0, 0]
    assert cells[0].cell_const == pytest.approx(1 - 1.5 * 5**0.5) and ds.points.agg(F.min("x"), F.max("y")).first()[:] == (-1.0, 1.0)


def test_series_and_choice(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"s{k}.dump").write_text(f"ITEM: TIMESTEP\n0\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS\n0 1\n0 1\n0 1\nITEM: ATOMS id type x y z\n1 1 {k} 0 0\n")
    ds = fm.read_series(spark, f"{tmp_path}/s*.dump", fm.parse_dump)
    assert sorted((r.time, r.x) for r in ds.points.collect()) == [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]
    with pytest.raises(NotImplementedError):
        fm.read(spark, "x.silo")
    with pytest.raises(ValueError):
        fm.read(spark, "x.unknown")


def test_sheared_brick(spark, tmp_path):
    (tmp_path / "d.raw").write_bytes(np.arange(8, dtype="<f4").tobytes())
    (tmp_path / "a.bov").write_text("DATA_FILE: d.raw\nDATA_SIZE: 2 2 2\nDATA_FORMAT: FLOAT\nVARIABLE: v\nBRICK_ORIGIN: 1 2 3\nBRICK_X_AXIS: 1 1 0\nBRICK_Y_AXIS: -1 1 0\nBRICK_Z_AXIS: 0 0.5 2\n")
    got = {r.node_id: (r.x, r.y, r.z) for r in fm.read(spark, f"{tmp_path}/a.bov").points.collect()}
    assert got[0] == (1, 2, 3) and got[1] == (2, 3, 3) and got[2] == (0, 3, 3) and got[4] == (1, 2.5, 5) and got[7] == (1, 4.5, 5)


def test_a_field_that_the_first_file_lacks_raises(spark, tmp_path):
    step = "ITEM: TIMESTEP\n0\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS\n0 1\n0 1\n0 1\nITEM: ATOMS id type x y z{}\n1 1 0 0 0{}\n"
    (tmp_path / "a.dump").write_text(step.format("", ""))
    (tmp_path / "b.dump").write_text(step.format(" q", " 5"))
    with pytest.raises(Exception, match="which the first file has not"):
        fm.load(spark, f"{tmp_path}/*.dump", fm.parse_dump).points.collect()


def test_grids_are_written_by_structure(spark, tmp_path):
    data, _ = cube()
    (tmp_path / "a.vtk").write_bytes(data)
    ds = fm.read(spark, f"{tmp_path}/a.vtk")
    text = vtk.text(ds)
    assert "DATASET RECTILINEAR_GRID" in text and "group 1 1 double\n7.0" in text
    bent = type(ds)(ds.points.withColumn("y", F.col("y") + F.col("x") * 0.1), ds.cells, ds.whole, ds.fields, ds.grid)
    vtk.write(bent, f"{tmp_path}/b.vtk")
    back = fm.read(spark, f"{tmp_path}/b.vtk")
    assert "DATASET STRUCTURED_GRID" in vtk.text(bent) and back.grid.dims == (4, 4, 4) and back.whole.first().group == 7.0
    for a, b in ((bent.points, back.points), (bent.cellset(), back.cellset())):
        key = a.columns[0]
        x, y = (df.drop("chunk", "time").orderBy(key).toPandas() for df in (a, b))
        assert list(x.columns) == list(y.columns) and all(np.allclose(np.array(x[c].tolist(), float), np.array(y[c].tolist(), float)) for c in x.columns)
    assert "DATASET UNSTRUCTURED_GRID" in vtk.text(type(ds)(ds.points, {"some": ds.cellset().where("cell_id < 5")}, None, ds.fields, ds.grid))
