"""Legacy VTK files, ASCII and big-endian binary: all five kinds of data set, and an ASCII writer."""

from __future__ import annotations

import numpy as np

from fieldloom.model import DIMENSION, MeshDataset, Shape
from fieldloom.shared import write_file

from .parsed import Cells, Parsed, rectilinear, structured_cells

#: The format's cell types.
CELL_TYPES = {1: Shape.POINT, 3: Shape.BEAM, 5: Shape.TRI, 6: Shape.TRISTRIP, 7: Shape.POLYGON, 8: Shape.PIXEL, 9: Shape.QUAD, 10: Shape.TET, 11: Shape.VOXEL, 12: Shape.HEX, 13: Shape.WEDGE, 14: Shape.PYRAMID}
#: The format's number types.
TYPES = {"bit": "u1", "unsigned_char": "u1", "char": "i1", "unsigned_short": ">u2", "short": ">i2", "unsigned_int": ">u4", "int": ">i4", "unsigned_long": ">u8", "long": ">i8", "vtkidtype": ">i8", "float": ">f4", "double": ">f8"}


class _Reader:
    def __init__(self, data: bytes, binary: bool):
        self.d, self.at, self.binary = data, 0, binary

    def word(self) -> str | None:
        d, n = self.d, len(self.d)
        while self.at < n and d[self.at] in b" \t\r\n":
            self.at += 1
        start = self.at
        while self.at < n and d[self.at] not in b" \t\r\n":
            self.at += 1
        return d[start : self.at].decode("latin-1") if self.at > start else None

    def line(self) -> str:
        end = self.d.find(b"\n", self.at)
        end = len(self.d) if end < 0 else end
        out = self.d[self.at : end].decode("latin-1").rstrip("\r")
        self.at = end + 1
        return out

    def numbers(self, n: int, kind: str) -> np.ndarray:
        t = np.dtype(TYPES[kind.lower()])
        if not self.binary:
            words, i = [], self.at
            while len(words) < n:
                chunk_end = min(len(self.d), i + max(4096, 24 * (n - len(words))))
                while chunk_end < len(self.d) and self.d[chunk_end] not in b" \t\r\n":
                    chunk_end += 1
                got = self.d[i:chunk_end].split()
                if len(words) + len(got) >= n or chunk_end == len(self.d):
                    for _ in range(min(n - len(words), len(got))):
                        words.append(self.word())
                    break
                words += got
                self.at = i = chunk_end
            if len(words) < n:
                raise ValueError(f"{n} numbers expected, {len(words)} found")
            return np.array(words, dtype="S").astype(np.float64 if t.kind == "f" else np.int64)
        if self.d[self.at : self.at + 1] == b"\r":
            self.at += 1
        self.at += 1
        if kind.lower() == "bit":
            raw = np.unpackbits(np.frombuffer(self.d, "u1", -(-n // 8), self.at))[:n]
            self.at += -(-n // 8)
            return raw.astype(np.int64)
        out = np.frombuffer(self.d, t, n, self.at)
        self.at += n * t.itemsize
        return out.astype(np.float64 if t.kind == "f" else np.int64)


def _cell_list(r: _Reader) -> tuple[list[np.ndarray], None]:
    n, size = int(r.word()), int(r.word())
    flat, out, at = r.numbers(size, "int"), [], 0
    for _ in range(n):
        k = int(flat[at])
        out.append(flat[at + 1 : at + 1 + k])
        at += 1 + k
    return out, None


def _cells(rows: list[np.ndarray], shapes: list[Shape]) -> Cells:
    lens = np.array([len(x) for x in rows], np.int64)
    return Cells(np.array([int(s) for s in shapes], np.int32), np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(lens)]))


def _named(r: _Reader) -> dict[str, np.ndarray]:
    """The arrays of a FIELD section."""
    r.word()
    out = {}
    for _ in range(int(r.word())):
        name, comps, n, kind = r.word(), int(r.word()), int(r.word()), r.word()
        a = r.numbers(comps * n, kind)
        out[name] = a.reshape(n, comps) if comps > 1 else a
    return out


def parse(data: bytes) -> list[Parsed]:
    r = _Reader(data, False)
    if not r.line().lower().startswith("# vtk datafile"):
        raise ValueError("not a legacy VTK file")
    r.line()
    r.binary = r.line().strip().upper() == "BINARY"
    kind = dims = points = None
    axes, sections, rows, types = {}, {}, None, None
    whole: dict[str, np.ndarray] = {}
    fields: dict[str, dict[str, np.ndarray]] = {"POINT_DATA": {}, "CELL_DATA": {}}
    origin, spacing, where = [0.0] * 3, [1.0] * 3, None
    n_here = 0
    while (w := r.word()) is not None:
        w = w.upper()
        if w == "DATASET":
            kind = r.word().upper()
        elif w == "DIMENSIONS":
            dims = tuple(int(r.word()) for _ in range(3))
        elif w == "ORIGIN":
            origin = [float(r.word()) for _ in range(3)]
        elif w in ("SPACING", "ASPECT_RATIO"):
            spacing = [float(r.word()) for _ in range(3)]
        elif w == "POINTS":
            n = int(r.word())
            points = r.numbers(3 * n, r.word()).reshape(n, 3).astype(float)
        elif w.endswith("_COORDINATES"):
            n = int(r.word())
            axes[w[0]] = r.numbers(n, r.word())
        elif w in ("VERTICES", "LINES", "POLYGONS", "TRIANGLE_STRIPS"):
            sections[w] = _cell_list(r)[0]
        elif w == "CELLS":
            rows = _cell_list(r)[0]
        elif w == "CELL_TYPES":
            types = r.numbers(int(r.word()), "int")
        elif w in fields:
            where, n_here = w, int(r.word())
        elif w == "FIELD":
            (fields[where] if where else whole).update(_named(r))
        elif w == "SCALARS":
            name, t, rest = r.word(), r.word(), r.line().split()
            comps = int(rest[0]) if rest else 1
            at = r.at
            if (r.word() or "").upper() == "LOOKUP_TABLE":
                r.word()
            else:
                r.at = at
            a = r.numbers(comps * n_here, t)
            fields[where][name] = a.reshape(-1, comps) if comps > 1 else a
        elif w in ("VECTORS", "NORMALS"):
            name, t = r.word(), r.word()
            fields[where][name] = r.numbers(3 * n_here, t).reshape(-1, 3)
        elif w == "METADATA":
            while r.line().strip():
                pass
        else:
            raise ValueError(f"section {w} is not known")
    m = _mesh(kind, dims, points, axes, origin, spacing, sections, rows, types, fields["CELL_DATA"])
    m.fields, m.whole = fields["POINT_DATA"], whole
    return [m]


def _mesh(kind, dims, points, axes, origin, spacing, sections, rows, types, cell_fields) -> Parsed:
    if kind == "RECTILINEAR_GRID":
        return rectilinear([axes[a] for a in "XYZ"], None, cell_fields)
    if kind == "STRUCTURED_POINTS":
        return rectilinear([o + s * np.arange(d) for o, s, d in zip(origin, spacing, dims)], None, cell_fields)
    if kind == "STRUCTURED_GRID":
        cells = structured_cells(dims)
        cells.fields = cell_fields
        return Parsed(points, {}, {"cells": cells}, dims=tuple(d for d in dims if d > 1) or (1,))
    if kind == "POLYDATA":
        out, first = {}, 0
        for section, items in sections.items():
            shapes, lists, source = [], [], []
            for k, x in enumerate(items):
                if section == "VERTICES":
                    parts, shape = [x[i : i + 1] for i in range(len(x))], Shape.POINT
                elif section == "LINES":
                    parts, shape = [x[i : i + 2] for i in range(len(x) - 1)], Shape.BEAM
                else:
                    parts, shape = [x], Shape.POLYGON if section == "POLYGONS" else Shape.TRISTRIP
                lists += parts
                shapes += [shape] * len(parts)
                source += [k] * len(parts)
            c = _cells(lists, shapes)
            c.fields = {n: v[first + np.array(source, np.int64)] for n, v in cell_fields.items()}
            first += len(items)
            out[section.lower()] = c
        return Parsed(points, {}, out)
    if kind == "UNSTRUCTURED_GRID":
        shapes = np.array([int(CELL_TYPES.get(int(t), Shape.OTHER)) for t in types], np.int32)
        dim = np.array([DIMENSION.get(Shape(s), -1) for s in shapes])
        kinds = sorted(set(dim.tolist()))
        out = {}
        for d in kinds:  # a cell set for each dimension; unknown types have one of their own, so fields stay aligned
            at = np.flatnonzero(dim == d)
            c = _cells([rows[i] for i in at], [Shape(shapes[i]) for i in at])
            c.fields = {n: v[at] for n, v in cell_fields.items()}
            out["cells" if len(kinds) == 1 else f"cells_{d}d" if d >= 0 else "cells_other"] = c
        return Parsed(points, {}, out)
    raise ValueError(f"data set {kind} is not known")


def _array(name: str, a: np.ndarray) -> str:
    return f"{name} {a.shape[1] if a.ndim > 1 else 1} {len(a)} double\n" + "\n".join(" ".join(map(repr, np.atleast_1d(x).tolist())) for x in a.astype(float))


def _structure(dims: tuple[int, ...], coords: np.ndarray) -> list[str]:
    """Sections of a grid: rectilinear if each coordinate depends on its own axis alone, else structured."""
    full = (*dims, 1, 1)[:3]
    grid = coords.reshape(*full[::-1], 3)
    axes = [grid[0, 0, :, 0], grid[0, :, 0, 1], grid[:, 0, 0, 2]]
    z, y, x = np.meshgrid(axes[2], axes[1], axes[0], indexing="ij")
    head = f"DIMENSIONS {' '.join(map(str, full))}"
    if np.array_equal(np.stack([x, y, z], -1), grid):
        return ["DATASET RECTILINEAR_GRID", head, *(line for n, a in zip("XYZ", axes) for line in (f"{n}_COORDINATES {len(a)} double", " ".join(map(repr, a.tolist()))))]
    return ["DATASET STRUCTURED_GRID", head, f"POINTS {len(coords)} double", *(" ".join(map(repr, p.tolist())) for p in coords)]


def text(ds: MeshDataset, cellset: str | None = None, title: str = "mesh") -> str:
    """The data set as an ASCII file, for meshes that one file may hold: by its structure if it has one and cells in the grid's order, else unstructured.

    Whole-mesh fields go with it; null values are written as 0.
    """
    names = {f.name: f for f in ds.fields}
    own = [c for c in ds.points.columns if c in names and names[c].assoc == "points"]
    pts = ds.points.select("node_id", "x", "y", "z", *own).orderBy("node_id").toPandas()
    coords = pts[["x", "y", "z"]].to_numpy(float)
    index = {n: k for k, n in enumerate(pts.node_id.tolist())}
    cells = ds.cellset(cellset).orderBy("cell_id").toPandas() if ds.cells else None
    back = {int(s): t for t, s in CELL_TYPES.items()}
    out = ["# vtk DataFile Version 3.0", title, "ASCII"]
    gridded = ds.grid is not None and ds.grid.n_nodes == len(coords) and (cells is None or (len(cells) == ds.grid.n_cells and set(cells["shape"]) <= {int(ds.grid.shape)}))
    sections = _structure(ds.grid.dims, coords) if gridded else ["DATASET UNSTRUCTURED_GRID", f"POINTS {len(coords)} double", *(" ".join(map(repr, p.tolist())) for p in coords)]
    whole = ds.whole.first().asDict() if ds.whole is not None and ds.whole.head(1) else {}
    whole = {k: np.atleast_1d(np.asarray(v, float)) for k, v in whole.items() if k in names}
    if whole:
        sections.insert(1, "\n".join([f"FIELD FieldData {len(whole)}", *(f"{k} {v.size} 1 double\n" + " ".join(map(repr, v.tolist())) for k, v in whole.items())]))
    out += sections
    if cells is not None and not gridded:
        rows = [[index[n] for n in r] for r in cells["nodes"]]
        out += [f"CELLS {len(rows)} {sum(1 + len(r) for r in rows)}", *(" ".join(map(str, [len(r), *r])) for r in rows)]
        out += [f"CELL_TYPES {len(rows)}", *(str(back.get(s, 7)) for s in cells["shape"])]
    own_c = [] if cells is None else [c for c in cells.columns if c not in ("cell_id", "shape", "nodes", "chunk", "time")]
    for head, table, cols in (("POINT_DATA", pts, own), ("CELL_DATA", cells, own_c)):
        if cols and len(table):
            out.append(f"{head} {len(table)}\nFIELD FieldData {len(cols)}")
            for c in cols:
                v = table[c]
                out.append(_array(c, np.array(v.tolist(), float) if v.map(np.ndim).any() else np.nan_to_num(v.to_numpy(float))))
    return "\n".join(out) + "\n"


def write(ds: MeshDataset, path: str, cellset: str | None = None) -> None:
    write_file(ds.points.sparkSession, path, text(ds, cellset).encode("ascii"))
