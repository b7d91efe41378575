"""Queries that write a table's rows in a mesh format and read them back through its reader."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldloom.model import FieldInfo, MeshDataset, Shape
from fieldloom.shared import shared_path, write_file
from fieldloom.sources import formats as fm, vtk

from .queries import G3, query, r6


def _put(t, name: str, data: bytes | str) -> str:
    path = f"{shared_path(t.spark, 'files')}/{name}"
    write_file(t.spark, path, data.encode("ascii") if isinstance(data, str) else data)
    return path


def _grid(t) -> MeshDataset:
    grid, points, cells = t.g3()
    points = points.select("node_id", *(F.col(c).cast("double").alias(a) for c, a in zip("ijk", "xyz")), "v")
    cells = cells.withColumn("rest", (F.col("cell_id") % 13).cast("double"))
    whole = t.spark.createDataFrame([(7.0,)], "cycle double")
    return MeshDataset(points, {"cells": cells}, whole, (FieldInfo("v"), FieldInfo("rest", "cells", 0, 1, "cells"), FieldInfo("cycle", "whole", 0)), grid)


@query(f"WITH {G3} SELECT node_id, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, CAST(k AS DOUBLE) AS z, round(v, 6) AS v FROM g3n")
def vtk_grid_points(t):
    """A rectilinear file and back."""
    path = f"{shared_path(t.spark, 'files')}/grid.vtk"
    vtk.write(_grid(t), path)
    ds = fm.read(t.spark, path)
    assert ds.grid.dims == t.g3()[0].dims
    return ds.points.select("node_id", "x", "y", "z", r6("v").alias("v"))


@query(f"WITH {G3} SELECT cell_id, 9 AS shape, b AS first, b + 111 AS last, CAST(cell_id % 13 AS DOUBLE) AS rest, 7.0::DOUBLE AS cycle FROM g3c")
def vtk_grid_cells(t):
    path = f"{shared_path(t.spark, 'files')}/grid.vtk"
    vtk.write(_grid(t), path)
    ds = fm.read(t.spark, path)
    cycle = ds.whole.select("cycle")
    return ds.cellset().join(F.broadcast(cycle)).select("cell_id", "shape", F.col("nodes")[0].alias("first"), F.element_at("nodes", -1).alias("last"), "rest", "cycle")  # one row


@query("SELECT s_suppkey AS cell_id, 1 AS shape, s_suppkey AS a, s_suppkey + 1 AS b, round(s_acctbal, 6) AS worth FROM supplier WHERE s_suppkey < (SELECT max(s_suppkey) FROM supplier)")
def vtk_lines(t):
    """An unstructured file of beams between suppliers that follow each other."""
    k = F.col("s_suppkey").cast("long")
    top = t.supplier.agg(F.max("s_suppkey")).first()[0]
    cells = t.supplier.where(k < top).select(k.alias("cell_id"), F.lit(int(Shape.BEAM)).alias("shape"), F.array(k, k + 1).alias("nodes"), F.col("s_acctbal").alias("worth"))
    path = f"{shared_path(t.spark, 'files')}/lines.vtk"
    vtk.write(MeshDataset(t.cloud(), {"lines": cells}), path)
    return fm.read(t.spark, path).cellset().select("cell_id", "shape", F.col("nodes")[0].alias("a"), F.col("nodes")[1].alias("b"), r6("worth").alias("worth"))


@query(f"WITH {G3} SELECT node_id, i * 9.0::DOUBLE / 9 + 1 AS x, v FROM g3n")
def brick_points(t):
    """A header and a raw file of doubles in layers, each layer a bricklet."""
    grid, points, _ = t.g3()
    v = np.array([r.v for r in points.select("node_id", "v").orderBy("node_id").toLocalIterator()], "<f8")
    nz = grid.dims[2]
    path = _put(t, "a.bov", f"TIME: 0\nDATA_FILE: a.raw\nDATA_SIZE: 10 10 {nz}\nDATA_BRICKLETS: 10 10 1\nDATA_FORMAT: DOUBLE\nVARIABLE: v\nDATA_ENDIAN: LITTLE\nCENTERING: nodal\nBRICK_ORIGIN: 1 0 0\nBRICK_X_AXIS: 9 0 0\nBRICK_Y_AXIS: 0 9 0\nBRICK_Z_AXIS: 0 0 {nz - 1}\n")
    write_file(t.spark, path.rsplit("/", 1)[0] + "/a.raw", v.tobytes())
    return fm.read(t.spark, path).points.select("node_id", "x", "v")


@query("SELECT r_name AS curve, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INTEGER) AS i, CAST(n_nationkey AS DOUBLE) AS x, n_nationkey / 4.0::DOUBLE AS vals FROM nation JOIN region ON n_regionkey = r_regionkey")
def curves(t):
    """A curve for each region, a point for each nation."""
    rows = sorted(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey").collect())
    text, last = "", None
    for name, k in rows:
        text += ("" if name == last else f"# {name}\n") + f"{k} {k / 4.0}\n"
        last = name
    return fm.read(t.spark, _put(t, "a.curve", text)).select("curve", F.col("i").cast("int").alias("i"), "x", "vals")


def _suppliers(t) -> list:
    return sorted(t.cloud().select("node_id", "x", "y", "z", F.col("z").cast("int").alias("nation")).collect())


@query("SELECT s_suppkey AS node_id, s_suppkey + 1 AS id, CAST(s_nationkey AS BIGINT) AS type, round(s_acctbal / 1000, 6) AS x, CAST(s_suppkey % 10 AS DOUBLE) AS y, CAST(s_nationkey AS DOUBLE) AS z FROM supplier")
def particle_dump(t):
    """Suppliers as atoms of one time step; z is scaled by the box."""
    rows = _suppliers(t)
    text = f"ITEM: TIMESTEP\n0\nITEM: NUMBER OF ATOMS\n{len(rows)}\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 32\nITEM: ATOMS id type x y zs\n"
    text += "".join(f"{r.node_id + 1} {r.nation + 1} {r.x!r} {r.y!r} {r.z / 32!r}\n" for r in rows)
    return fm.read(t.spark, _put(t, "a.dump", text)).points.select("node_id", "id", "type", r6("x").alias("x"), "y", "z")


@query("SELECT s_suppkey AS node_id, round(s_acctbal / 10, 6) AS x, CAST(s_suppkey % 10 AS DOUBLE) AS y, CASE WHEN s_suppkey % 3 = 0 THEN 'N' ELSE 'C' END AS element, CAST(s_suppkey // 4 % 1000 AS BIGINT) AS resseq, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS backbone FROM supplier")
def protein_atoms(t):
    """Suppliers as ATOM lines."""
    rows = _suppliers(t)
    line = "ATOM  {:5d} {:4s} GLY A{:4d}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}          {:>2s}\n"
    kind = lambda k: (" N", "N") if k % 3 == 0 else (" CB", "C")
    text = "".join(line.format(r.node_id % 100_000, kind(r.node_id)[0], r.node_id // 4 % 1000, r.x * 100, r.y, r.z, 1, 2, kind(r.node_id)[1]) for r in rows)
    return fm.read(t.spark, _put(t, "a.pdb", text + "END\n")).points.select("node_id", r6("x").alias("x"), "y", "element", "resseq", "backbone")


@query("SELECT n_nationkey AS cell_id, CAST(n_nationkey * 10 AS BIGINT) AS r, CAST(255 - n_nationkey AS BIGINT) AS b, CAST(255 AS BIGINT) AS a FROM nation")
def image_pixels(t):
    """A PNG of five by five nations, read from the bottom row up."""
    keys = sorted(r[0] for r in t.nation.select("n_nationkey").collect())
    px = np.zeros((25, 3), np.uint8)
    for k in keys:
        px[k] = k * 10, k, 255 - k
    raw = b"".join(b"\0" + px[row * 5 : row * 5 + 5].tobytes() for row in range(4, -1, -1))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    return fm.read(t.spark, _put(t, "a.png", data)).cellset().select(F.col("cell_id").cast("int").alias("cell_id"), "r", "b", "a")


@query("SELECT s_suppkey AS cell_id, 2 AS shape, s_suppkey AS a, s_suppkey + 2 AS c, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS material FROM supplier WHERE s_suppkey < (SELECT count(*) FROM supplier) - 2")
def scene_faces(t):
    """Suppliers as the vertices of a strip of triangles in a scene file."""
    rows = _suppliers(t)
    text = "# strip\n" + "".join(f"v {r.x!r} {r.y!r} {r.z!r}\n" for r in rows) + "".join(f"usemtl {'odd' if k % 2 else 'even'}\nf {k + 1}/1/1 {k + 2} {k + 3 - len(rows) - 1}\n" for k in range(len(rows) - 2))
    return fm.read(t.spark, _put(t, "a.obj", text)).cellset().select("cell_id", "shape", F.col("nodes")[0].alias("a"), F.col("nodes")[2].alias("c"), "material")


@query("SELECT c AS cell_id, CAST(2 AS BIGINT) AS levels, 2.0::DOUBLE * (c + 1) AS cell_const FROM (SELECT unnest(range(16)) AS c)")
def quadtree_file(t):
    """A full tree of two levels; leaf c has the constant coefficient c + 1."""
    order = []

    def node(lvl: int, x: int, y: int) -> str:
        head = f" ({lvl},[{x},{y}])  -->  (has_coeff={'true' if lvl == 2 else 'false'}, has_children={'false' if lvl == 2 else 'true'}, norm=1)\n"
        if lvl == 2:
            order.append((x, y))
            return head + f"[0,*] {len(order)}.0 0 0\n[1,*] 0 0 0\n[2,*] 0 0 0\n"
        return head + "[empty tensor]\n" + "".join(node(lvl + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1))

    return fm.read(t.spark, _put(t, "a.madness", "tree\n" + node(0, 0, 0))).cellset().select("cell_id", "levels", "cell_const")


@query("SELECT CAST(r_regionkey AS DOUBLE) AS time, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_nationkey) AS DOUBLE) AS total FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def file_series(t):
    """A dump for each region, read as steps of a series; its atoms are the nations."""
    by: dict[int, list[int]] = {}
    for r in t.nation.select("n_regionkey", "n_nationkey").collect():
        by.setdefault(r[0], []).append(r[1])
    folder = shared_path(t.spark, "files")
    for region, keys in by.items():
        text = f"ITEM: TIMESTEP\n0\nITEM: NUMBER OF ATOMS\n{len(keys)}\nITEM: BOX BOUNDS\n0 1\n0 1\n0 1\nITEM: ATOMS id type x y z\n" + "".join(f"{k} 1 {k} 0 0\n" for k in keys)
        write_file(t.spark, f"{folder}/s{region}.dump", text.encode())
    return fm.read_series(t.spark, f"{folder}/s*.dump", fm.parse_dump).points.groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("SELECT CAST(11 + 3 * count(*) AS BIGINT) AS bytes, 'P6' AS kind FROM nation")
def image_file(t):
    """A PNM of the nations: its size and first letters."""
    path = f"{shared_path(t.spark, 'files')}/a.pnm"
    fm.write_pnm(t.nation.select(F.col("n_nationkey").alias("pixel"), F.col("n_regionkey").cast("double").alias("value")), path, 5, 5)
    return t.spark.read.format("binaryFile").load(path).select(F.length("content").cast("long").alias("bytes"), F.substring("content", 1, 2).cast("string").alias("kind"))


