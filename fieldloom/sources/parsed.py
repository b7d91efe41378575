"""What a file parser returns, and how files become DataFrames.

Files are read by Spark (binaryFile, any store), one file a chunk; parsing runs on the executors. The field names come from the
first file, the driver's only look at contents. Each table parses by itself, so asking for points alone makes no cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.model import FieldInfo, GridSpec, MeshDataset, Shape


@dataclass
class Cells:
    """shapes, and node ids end to end with offsets; fields by name."""

    shapes: np.ndarray
    nodes: np.ndarray
    offsets: np.ndarray
    fields: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def of(shape: Shape, rows: np.ndarray) -> Cells:
        """Cells of one shape from an (n, k) array of node ids."""
        n, k = rows.shape
        return Cells(np.full(n, int(shape), np.int32), rows.ravel().astype(np.int64), np.arange(n + 1) * k)


@dataclass
class Parsed:
    """A mesh of one file and time."""

    points: np.ndarray
    fields: dict[str, np.ndarray] = field(default_factory=dict)
    cells: dict[str, Cells] = field(default_factory=dict)
    whole: dict[str, np.ndarray] = field(default_factory=dict)
    dims: tuple[int, ...] | None = None
    time: float | None = None


Parser = Callable[[bytes], list[Parsed]]


def structured_cells(dims: tuple[int, ...]) -> Cells:
    """Beams, pixels or voxels of a grid; dimensions of one node don't count."""
    real = tuple(d for d in dims if d > 1)
    ids = np.arange(int(np.prod(real)) if real else 1).reshape(real[::-1] or (1,))
    corners = [ids]
    for axis in range(len(real)):
        ax = len(real) - 1 - axis
        lo = [np.take(c, range(real[axis] - 1), ax) for c in corners]
        hi = [np.take(c, range(1, real[axis]), ax) for c in corners]
        corners = lo + hi
    return Cells.of((Shape.POINT, Shape.BEAM, Shape.PIXEL, Shape.VOXEL)[len(real)], np.stack([c.ravel() for c in corners], 1))


def rectilinear(axes: list[np.ndarray], fields: dict | None = None, cell_fields: dict | None = None, name: str = "cells") -> Parsed:
    """A mesh from its axes' coordinates; missing axes are 0."""
    axes = [np.asarray(a, float) for a in axes] + [np.zeros(1)] * (3 - len(axes))
    z, y, x = np.meshgrid(axes[2], axes[1], axes[0], indexing="ij")
    dims = tuple(len(a) for a in axes)
    cells = structured_cells(dims)
    cells.fields = cell_fields or {}
    return Parsed(np.stack([x.ravel(), y.ravel(), z.ravel()], 1), fields or {}, {name: cells}, dims=tuple(d for d in dims if d > 1) or (1,))


# --- to DataFrames ---------------------------------------------------------------------------------


def _type(a: np.ndarray) -> str:
    base = "string" if a.dtype.kind in "OUS" else "long" if a.dtype.kind in "iu" else "double"
    return f"array<{base}>" if a.ndim > 1 else base


def _one(v: np.ndarray) -> np.ndarray:
    """A whole-mesh value as a column of one row: a number, or an array of several."""
    a = np.asarray(v).ravel()
    return a if a.size == 1 else a[None]


def _column(a: np.ndarray) -> pa.Array:
    flat = a.astype(object).ravel() if a.dtype.kind in "OUS" else a.ravel().astype(np.int64 if a.dtype.kind in "iu" else np.float64)
    kind = pa.string() if a.dtype.kind in "OUS" else pa.int64() if a.dtype.kind in "iu" else pa.float64()
    values = pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), values) if a.ndim > 1 else values


def _tables(table: str, name: str | None, parse: Parser, columns: list[str]):
    def one(m: Parsed) -> dict[str, pa.Array]:
        if table == "points":
            n = len(m.points)
            return {"node_id": pa.array(np.arange(n)), **{a: _column(m.points[:, k]) for k, a in enumerate("xyz")}, **{k: _column(v) for k, v in m.fields.items()}}
        if table == "whole":
            return {k: _column(_one(v)) for k, v in m.whole.items()}
        c = m.cells.get(name)
        if c is None:
            return {}
        nodes = pa.ListArray.from_arrays(pa.array(c.offsets, pa.int32()), pa.array(c.nodes, pa.int64()))
        return {"cell_id": pa.array(np.arange(len(c.shapes))), "shape": pa.array(c.shapes, pa.int32()), "nodes": nodes, **{k: _column(v) for k, v in c.fields.items()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for m in parse(content):
                    cols = one(m)
                    if set(cols) - set(columns):
                        raise ValueError(f"{path} has {sorted(set(cols) - set(columns))}, which the first file has not")
                    n = len(next(iter(cols.values()))) if cols else 0
                    if n:
                        cols |= {"chunk": pa.array([path] * n), "time": pa.array([m.time] * n, pa.float64())}
                        yield pa.RecordBatch.from_pydict({c: cols[c] if c in cols else pa.nulls(n) for c in columns})

    return run


def load(spark: SparkSession, path: str, parse: Parser) -> MeshDataset:
    """Files at path (a file, folder or pattern) as one data set; rows have chunk (the file) and time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = parse(bytes(files.orderBy("path").first().content))[0]
    tail = "chunk string, time double"
    schema = ", ".join(["node_id long, x double, y double, z double", *(f"`{k}` {_type(v)}" for k, v in first.fields.items()), tail])
    names = lambda *own: [*own, "chunk", "time"]
    points = files.mapInArrow(_tables("points", None, parse, names("node_id", "x", "y", "z", *first.fields)), schema)
    cells: dict[str, DataFrame] = {}
    infos = [FieldInfo(k, "points", 1, v.shape[1] if v.ndim > 1 else 1) for k, v in first.fields.items()]
    for name, c in first.cells.items():
        schema = ", ".join(["cell_id long, shape int, nodes array<long>", *(f"`{k}` {_type(v)}" for k, v in c.fields.items()), tail])
        cells[name] = files.mapInArrow(_tables("cells", name, parse, names("cell_id", "shape", "nodes", *c.fields)), schema)
        infos += [FieldInfo(k, "cells", 0, v.shape[1] if v.ndim > 1 else 1, name) for k, v in c.fields.items()]
    whole = None
    if first.whole:
        schema = ", ".join([*(f"`{k}` {_type(_one(v))}" for k, v in first.whole.items()), tail])
        whole = files.mapInArrow(_tables("whole", None, parse, names(*first.whole)), schema)
        infos += [FieldInfo(k, "whole", 0, int(np.size(v))) for k, v in first.whole.items()]
    return MeshDataset(points, cells, whole, tuple(infos), GridSpec(first.dims) if first.dims else None)


def at_time(ds: MeshDataset, time: float) -> MeshDataset:
    """One time step; a filter on the time column."""
    pick = lambda df: df.where(F.col("time") == time)
    return MeshDataset(pick(ds.points), {k: pick(v) for k, v in ds.cells.items()}, pick(ds.whole) if ds.whole is not None else None, ds.fields, ds.grid, ds.coordinates, time)
