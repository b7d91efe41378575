"""The other formats: brick of values, curves, particle dumps, proteins, images, quadtrees; and the choice by suffix."""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.model import GridSpec, MeshDataset, Shape
from fieldloom.shared import write_file

from . import vtk
from .parsed import Cells, Parsed, Parser, load, rectilinear

# --- brick of values: a text header and a raw file -------------------------------------------------

_BRICK = {"float": "f4", "double": "f8", "int": "i4", "short": "i2", "byte": "u1"}


def brick_header(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        if ":" in line and not line.lstrip().startswith("#"):
            k, v = line.split(":", 1)
            out[k.strip().upper().replace(" ", "_")] = v.strip().strip('"')
    return out


def read_bricks(spark: SparkSession, path: str, data_dir: str | None = None) -> MeshDataset:
    """A header at path; its raw file(s) (gzip by suffix; %d in the name counts chunks) as points or cells of one grid.

    Bricklets are chunks: (chunk, then i fastest). Numbers are placed by arithmetic, so order in the store doesn't matter.
    """
    h = brick_header(spark.read.text(path, wholetext=True).first()[0])
    size = tuple(int(x) for x in h["DATA_SIZE"].split())
    small = tuple(int(x) for x in h.get("DATA_BRICKLETS", h["DATA_SIZE"]).split())
    kind, comps = _BRICK[h.get("DATA_FORMAT", "float").lower()], int(h.get("DATA_COMPONENTS", 1))
    order = ">" if h.get("DATA_ENDIAN", "LITTLE").upper() == "BIG" else "<"
    zonal = h.get("CENTERING", "nodal").lower() == "zonal"
    name = h.get("VARIABLE", "data")
    floats = lambda k, d: [float(x) for x in h.get(k, d).split()]
    origin = floats("BRICK_ORIGIN", "0 0 0")
    axes = [floats("BRICK_X_AXIS", "1 0 0"), floats("BRICK_Y_AXIS", "0 1 0"), floats("BRICK_Z_AXIS", "0 0 1")]
    parts = [s // b for s, b in zip(size, small)]
    n_chunk = int(np.prod(small))
    folder = data_dir or path.rsplit("/", 1)[0]
    pattern = h["DATA_FILE"]
    glob = re.sub(r"%0?\d*d", "*", pattern)
    files = spark.read.format("binaryFile").load(f"{folder}/{glob}").select("path", "content")
    head = re.split(r"%0?\d*d", pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content):
                raw = gzip.decompress(content) if p.endswith(".gz") else content
                base = p.rsplit("/", 1)[1]
                first = int(base[len(head[0]) : len(base) - len(head[-1])]) if len(head) > 1 else 0
                a = np.frombuffer(raw, order + kind)
                for c in range(len(a) // (n_chunk * comps)):
                    v = a[c * n_chunk * comps : (c + 1) * n_chunk * comps].astype(float).reshape(n_chunk, comps)
                    b = first + c
                    i = np.arange(n_chunk)
                    at, mul = 0, 1
                    for d in range(3):
                        own = i // int(np.prod(small[:d])) % small[d]
                        block = b // int(np.prod(parts[:d])) % parts[d]
                        at, mul = at + (own + block * small[d]) * mul, mul * size[d]
                    yield pd.DataFrame({"id": at, "chunk": b, "v": v[:, 0] if comps == 1 else list(v)})

    values = files.mapInPandas(run, f"id long, chunk long, v {'double' if comps == 1 else 'array<double>'}")
    from fieldloom.functions import grid as g

    dims = tuple(s + 1 for s in size) if zonal else size
    grid = GridSpec(dims)
    nodes = g.nodes(spark, grid)
    # each index goes along its own axis, whatever way that points
    along = lambda k: sum((F.col(c) * F.lit(a[k] / max(d - 1, 1)) for c, a, d in zip("ijk", axes, dims) if a[k]), F.lit(origin[k]))
    points = nodes.select("node_id", *(along(k).alias(x) for k, x in enumerate("xyz")))
    cells = g.cells(spark, grid)
    v = values.select(F.col("id").alias("_id"), F.col("v").alias(name), "chunk")
    if zonal:
        cells = cells.join(v, F.col("cell_id") == F.col("_id")).drop("_id")
    else:
        points = points.join(v, F.col("node_id") == F.col("_id")).drop("_id")
    from fieldloom.model import FieldInfo

    return MeshDataset(points, {"cells": cells}, None, (FieldInfo(name, "cells" if zonal else "points", 0 if zonal else 1, comps, "cells" if zonal else None),), grid)


# --- curves: "# name" lines and x y pairs ----------------------------------------------------------


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """curve, i, x, vals. Each file is one value of text, so that lines keep their order."""
    line = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("chunk"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    from pyspark.sql import Window

    name = F.when(F.col("line").rlike(r"^\s*#"), F.trim(F.regexp_replace("line", r"^\s*#", "")))
    w = Window.partitionBy("chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = line.withColumn("curve", F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit(""))).where(~F.col("line").rlike(r"^\s*#") & F.col("line").rlike(r"\S"))
    xy = F.split(F.trim("line"), r"[\s,]+")
    rows = rows.select("chunk", "curve", "n", F.try_element_at(xy, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(xy, F.lit(2)).try_cast("double").alias("vals"))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("chunk", "curve").orderBy("n")) - 1).drop("n")


# --- particle dumps --------------------------------------------------------------------------------


def parse_dump(data: bytes) -> list[Parsed]:
    """Time steps of atoms; scaled coordinates (xs, xsu) are taken out of the box, others are as they stand. type counts from 0."""
    lines, at, out = data.decode("latin-1").splitlines(), 0, []
    time, n, box = 0.0, 0, np.array([[0.0, 1.0]] * 3)
    while at < len(lines):
        head = lines[at].strip()
        at += 1
        if head.startswith("ITEM: TIMESTEP"):
            time = float(lines[at])
            at += 1
        elif head.startswith("ITEM: NUMBER OF ATOMS"):
            n = int(lines[at])
            at += 1
        elif head.startswith("ITEM: BOX BOUNDS"):
            box = np.array([[float(v) for v in lines[at + k].split()[:2]] for k in range(3)])
            at += 3
        elif head.startswith("ITEM: ATOMS"):
            names = head.split()[2:]
            a = np.array([lines[at + k].split() for k in range(n)], dtype=object).reshape(n, len(names))
            at += n
            xyz = np.zeros((n, 3))
            used = set()
            for k, c in enumerate("xyz"):
                for suffix in ("", "u", "s", "su"):
                    if c + suffix in names:
                        v = a[:, names.index(c + suffix)].astype(float)
                        xyz[:, k] = box[k, 0] + v * (box[k, 1] - box[k, 0]) if suffix.startswith("s") else v
                        used.add(c + suffix)
                        break
            fields = {}
            for k, name in enumerate(names):
                if name not in used:
                    fields[name] = a[:, k].astype(float).astype(np.int64) - (name == "type") if name in ("id", "type") else a[:, k].astype(float)
            out.append(Parsed(xyz, fields, {"atoms": Cells.of(Shape.POINT, np.arange(n)[:, None])}, time=time))
    return out


# --- proteins: fixed-width lines -------------------------------------------------------------------


def read_protein(spark: SparkSession, path: str) -> MeshDataset:
    """Atoms of ATOM and HETATM lines by substring; one data set, models as time; bonds as cells from distances.

    Bonds: 0.4 < d < 1.2 with a hydrogen, else 0.4 < d < 1.9, at most four from the lower atom.
    """
    from pyspark.sql import Window

    from fieldloom.model import FieldInfo
    from fieldloom.operators.compute import bonds
    from fieldloom.operators.primitives import dense_ids

    line = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("chunk"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    cut = lambda a, b: F.trim(F.substring("line", a, b - a + 1))
    model = F.when(F.col("line").startswith("MODEL"), cut(7, 20).try_cast("double"))
    w = Window.partitionBy("chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = line.withColumn("time", F.coalesce(F.last(model, ignorenulls=True).over(w), F.lit(1.0)))
    rows = rows.where(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"))
    name = cut(13, 16)
    element = F.when(cut(77, 78) != "", F.initcap(cut(77, 78))).otherwise(F.regexp_extract(name, "([A-Za-z])", 1))
    rows = rows.select(
        "chunk", "time", "n", *(cut(a, b).try_cast("double").alias(c) for c, a, b in (("x", 31, 38), ("y", 39, 46), ("z", 47, 54))),
        element.alias("element"), cut(18, 20).alias("restype"), cut(23, 26).try_cast("long").alias("resseq"), name.isin("N", "CA", "C", "O").cast("long").alias("backbone"),
        cut(55, 60).try_cast("double").alias("occupancy"), cut(61, 66).try_cast("double").alias("tempfactor"), F.col("line").startswith("HETATM").cast("long").alias("hetatm"),
    )
    points = dense_ids(rows, "chunk", "n", out="node_id").drop("n")
    pair = bonds(points, most_each=4)
    cells = dense_ids(pair, "a", "b", out="cell_id").select("cell_id", F.lit(int(Shape.BEAM)).alias("shape"), F.array("a", "b").alias("nodes"), "dist")
    info = tuple(FieldInfo(c, "points", 1) for c in ("element", "restype", "resseq", "backbone", "occupancy", "tempfactor"))
    return MeshDataset(points, {"bonds": cells}, None, info)


# --- images ----------------------------------------------------------------------------------------


def png_pixels(data: bytes) -> np.ndarray:
    """(h, w, 4) bytes of a PNG of 8 bits a channel, not interlaced: grey, grey and alpha, RGB, palette, RGBA."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, clear = 8, b"", None, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", part)
            if depth != 8 or lace:
                raise ValueError("only 8 bits a channel, not interlaced")
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    ch = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * ch)
    out = np.zeros((h, w * ch), np.uint8)
    before = np.zeros(w * ch, np.int64)
    for y in range(h):
        f, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if f == 0:
            cur = line
        elif f == 2:
            cur = (line + before) & 255
        else:
            cur = line.copy()
            for x in range(w * ch):
                a = cur[x - ch] if x >= ch else 0
                c = before[x - ch] if x >= ch else 0
                b = before[x]
                if f == 1:
                    p = a
                elif f == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - c
                    p = min(((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c)))[2]
                cur[x] = (cur[x] + p) & 255
        out[y], before = cur, cur
    px = out.reshape(h, w, ch)
    full = np.full((h, w, 1), 255, np.uint8)
    if color == 0:
        return np.concatenate([px.repeat(3, 2), full], 2)
    if color == 2:
        return np.concatenate([px, full], 2)
    if color == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([palette[px[:, :, 0]], alpha[px[:, :, 0]][:, :, None]], 2)
    return np.concatenate([px[:, :, :1].repeat(3, 2), px[:, :, 1:]], 2) if color == 4 else px


def parse_png(data: bytes) -> list[Parsed]:
    """(w+1) x (h+1) nodes, cell set `pixels` from the bottom row up, fields r, g, b, a."""
    px = png_pixels(data)[::-1]
    h, w, _ = px.shape
    return [rectilinear([np.arange(w + 1), np.arange(h + 1)], None, {c: px[:, :, k].ravel().astype(np.int64) for k, c in enumerate("rgba")}, "pixels")]


def pnm(values: np.ndarray, low: float | None = None, high: float | None = None) -> bytes:
    """Binary PNM of (h, w) or (h, w, 3) numbers, scaled from low..high to 0..255, rows from the top."""
    a = np.asarray(values, float)
    low, high = (a.min() if low is None else low), (a.max() if high is None else high)
    b = np.clip((a - low) / ((high - low) or 1.0) * 255, 0, 255).astype(np.uint8)[::-1]
    b = b[:, :, None].repeat(3, 2) if b.ndim == 2 else b
    return f"P6\n{b.shape[1]} {b.shape[0]}\n255\n".encode() + b.tobytes()


def write_pnm(pixels: DataFrame, path: str, w: int, h: int, value: str = "value") -> None:
    """An image of at most w x h pixels (pixel id i + w j); the range comes from one aggregate."""
    r = pixels.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    a = np.zeros(w * h)
    for row in pixels.select("pixel", value).toLocalIterator():
        a[row[0]] = row[1]
    write_file(pixels.sparkSession, path, pnm(a.reshape(h, w), r.lo, r.hi))


# --- quadtrees -------------------------------------------------------------------------------------


_TREE_NODE = re.compile(r"\((\d+),\[(\d+),(\d+)\]\).*?\(has_coeff=(true|false),\s*has_children=(true|false),")


def parse_quadtree(data: bytes) -> list[Parsed]:
    """A title line, then nodes in preorder: level, place and flags on a line, then three rows of coefficients or a line without; root [-1, 1]^2.

    Leaves have four points of their own; fields levels, cell_const (value at the middle), cell_biquadratic (coefficients); node_linear at corners.
    """
    from fieldloom.functions.matrix import legendre

    lines = iter(data.decode("latin-1").splitlines()[1:])
    leaves = []
    for line in lines:
        m = _TREE_NODE.search(line)
        if not m:
            continue
        lvl, i, j = map(int, m.groups()[:3])
        c = [float(v) for _ in range(3) for v in next(lines).split("]", 1)[1].split()[:3]] if m[4] == "true" else [0.0] * 9
        if m[5] == "false":
            side = 2.0 / 2**lvl
            leaves.append((lvl, -1 + i * side, -1 + (i + 1) * side, -1 + j * side, -1 + (j + 1) * side, c))
    at = lambda c, lvl, x, y: sum(c[3 * i + j] * legendre(i, x) * legendre(j, y) for i in range(3) for j in range(3)) * 2.0 ** (lvl - 1)
    corners = [(-1, -1), (1, -1), (-1, 1), (1, 1)]
    pts = np.array([[x1 if sx > 0 else x0, y1 if sy > 0 else y0, 0.0] for _, x0, x1, y0, y1, _ in leaves for sx, sy in corners])
    linear = np.array([at(c, lvl, sx, sy) for lvl, *_, c in leaves for sx, sy in corners])
    cells = Cells.of(Shape.PIXEL, np.arange(4 * len(leaves)).reshape(-1, 4))
    cells.fields = {"levels": np.array([x[0] for x in leaves], np.int64), "cell_const": np.array([at(x[5], x[0], 0.0, 0.0) for x in leaves]), "cell_biquadratic": np.array([x[5] for x in leaves])}
    return [Parsed(pts, {"node_linear": linear}, {"leaves": cells})]


# --- scenes: vertices and faces --------------------------------------------------------------------


def parse_obj(data: bytes) -> list[Parsed]:
    """Vertices and faces of a Wavefront scene; normals and textures are left out, the material in use is a field; negative indices count back."""
    points, faces, materials, material = [], [], [], ""
    for line in data.decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["v"]:
            points.append([float(x) for x in w[1:4]])
        elif w[:1] == ["usemtl"]:
            material = " ".join(w[1:])
        elif w[:1] == ["f"]:
            at = [int(x.split("/")[0]) for x in w[1:]]
            faces.append([i - 1 if i > 0 else len(points) + i for i in at])
            materials.append(material)
    lens = [len(f) for f in faces]
    shapes = np.array([{3: Shape.TRI, 4: Shape.QUAD}.get(n, Shape.POLYGON) for n in lens], np.int32)
    nodes = np.array([i for f in faces for i in f], np.int64)
    return [Parsed(np.array(points, float).reshape(-1, 3), {}, {"faces": Cells(shapes, nodes, np.append(0, np.cumsum(lens, dtype=np.int64)).astype(np.int64), {"material": np.array(materials, object)})})]


# --- choice by suffix ------------------------------------------------------------------------------

PARSERS: dict[str, Parser] = {"vtk": vtk.parse, "lammpstrj": parse_dump, "dump": parse_dump, "png": parse_png, "obj": parse_obj, "mad": parse_quadtree, "madness": parse_quadtree}
#: Formats whose libraries are not at hand.
MISSING = {"silo", "nc", "netcdf", "bp", "h5", "pixie", "chimera"}


def read(spark: SparkSession, path: str) -> MeshDataset | DataFrame:
    """Open by the suffix, whatever its case; curves are returned as rows."""
    end = path.lower().rsplit(".", 1)[-1]
    if end == "bov":
        return read_bricks(spark, path)
    if end in ("curve", "ultra"):
        return read_curves(spark, path)
    if end in ("pdb", "ent"):
        return read_protein(spark, path)
    if end in PARSERS:
        return load(spark, path, PARSERS[end])
    if end in MISSING:
        raise NotImplementedError(f".{end} files need a library that is not installed")
    raise ValueError(f"no reader for .{end}")


def read_series(spark: SparkSession, pattern: str, parser: Parser) -> MeshDataset:
    """Single-step files as a time series: time is the file's place by name."""
    ds = load(spark, pattern, parser)
    paths = sorted(r.path for r in spark.read.format("binaryFile").load(pattern).select("path").collect())  # one row a file
    step = F.create_map(*[F.lit(x) for k, p in enumerate(paths) for x in (p, float(k))])
    time: Column = step[F.col("chunk")]
    return MeshDataset(ds.points.withColumn("time", time), {k: c.withColumn("time", time) for k, c in ds.cells.items()}, ds.whole, ds.fields, ds.grid)
