"""Data model: a mesh is a set of DataFrames keyed by integer ids; all operators return new data sets.

points: node_id bigint, x, y, z double, nodal fields. cells: cell_id bigint, shape int, nodes array<bigint>, cell fields.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from enum import IntEnum
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Shape(IntEnum):
    POINT, BEAM, TRI, QUAD, PIXEL, TET, PYRAMID, WEDGE, HEX, VOXEL, TRISTRIP, POLYGON, OTHER = range(13)


DIMENSION = {Shape.POINT: 0, Shape.BEAM: 1, Shape.TRI: 2, Shape.QUAD: 2, Shape.PIXEL: 2, Shape.TRISTRIP: 2, Shape.POLYGON: 2, Shape.TET: 3, Shape.PYRAMID: 3, Shape.WEDGE: 3, Shape.HEX: 3, Shape.VOXEL: 3}

#: Local nodes of each local edge.
EDGES = {
    Shape.BEAM: [(0, 1)],
    Shape.TRI: [(0, 1), (1, 2), (2, 0)],
    Shape.QUAD: [(0, 1), (1, 2), (2, 3), (3, 0)],
    Shape.PIXEL: [(0, 1), (1, 3), (3, 2), (2, 0)],
    Shape.TET: [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)],
    Shape.PYRAMID: [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4), (2, 4), (3, 4)],
    Shape.WEDGE: [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)],
    Shape.HEX: [(0, 1), (1, 2), (2, 3), (0, 3), (4, 5), (5, 6), (6, 7), (4, 7), (0, 4), (1, 5), (3, 7), (2, 6)],
    Shape.VOXEL: [(0, 1), (1, 3), (2, 3), (0, 2), (4, 5), (5, 7), (6, 7), (4, 6), (0, 4), (1, 5), (2, 6), (3, 7)],
}
#: Local nodes around each local face; triangles come first.
FACES = {
    Shape.TET: [(0, 1, 3), (1, 2, 3), (2, 0, 3), (0, 2, 1)],
    Shape.PYRAMID: [(0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4), (0, 3, 2, 1)],
    Shape.WEDGE: [(0, 1, 2), (3, 5, 4), (0, 3, 4, 1), (1, 4, 5, 2), (2, 5, 3, 0)],
    Shape.HEX: [(0, 4, 7, 3), (1, 2, 6, 5), (0, 1, 5, 4), (3, 7, 6, 2), (0, 3, 2, 1), (4, 5, 6, 7)],
    Shape.VOXEL: [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)],
}
#: Local nodes of the tetrahedra that fill a shape.
TETS = {
    Shape.TET: [(0, 1, 2, 3)],
    Shape.PYRAMID: [(0, 1, 2, 4), (0, 2, 3, 4)],
    Shape.WEDGE: [(0, 2, 1, 4), (0, 3, 2, 4), (3, 5, 2, 4)],
    Shape.HEX: [(0, 1, 2, 5), (0, 2, 3, 7), (0, 7, 4, 5), (2, 6, 7, 5), (0, 5, 2, 7)],
    Shape.VOXEL: [(0, 1, 3, 5), (0, 3, 2, 6), (0, 6, 4, 5), (3, 7, 6, 5), (0, 5, 3, 6)],
}


@dataclass(frozen=True)
class GridSpec:
    """A regular structure of one to three dimensions; node ids count i fastest."""

    dims: tuple[int, ...]

    @property
    def cell_dims(self) -> tuple[int, ...]:
        return tuple(n - 1 for n in self.dims)

    @property
    def n_nodes(self) -> int:
        return prod(self.dims)

    @property
    def n_cells(self) -> int:
        return prod(self.cell_dims)

    @property
    def edge_counts(self) -> tuple[int, ...]:
        """Edges along each axis; ids run over the axes in turn."""
        return tuple(prod(self.cell_dims[a] if a == b else self.dims[b] for b in range(len(self.dims))) for a in range(len(self.dims)))

    @property
    def face_counts(self) -> tuple[int, int, int]:
        """Faces in XY, XZ and YZ; ids run over them in turn."""
        (xn, yn, zn), (xc, yc, zc) = self.dims, self.cell_dims
        return xc * yc * zn, xc * yn * zc, xn * yc * zc

    @property
    def shape(self) -> Shape:
        return (Shape.BEAM, Shape.PIXEL, Shape.VOXEL)[len(self.dims) - 1]


@dataclass(frozen=True)
class FieldInfo:
    """A field's name, owner (points, cells or whole), interpolation order, components, and cell set."""

    name: str
    assoc: str = "points"
    order: int = 1
    ncomp: int = 1
    cellset: str | None = None


@dataclass(frozen=True)
class MeshDataset:
    """One chunk of a mesh. Cell sets go by name; dims tells the regular structure if there is one; time is a discrete dimension."""

    points: DataFrame
    cells: dict[str, DataFrame] = field(default_factory=dict)
    whole: DataFrame | None = None
    fields: tuple[FieldInfo, ...] = ()
    grid: GridSpec | None = None
    coordinates: tuple[str, ...] = ("x", "y", "z")
    time: float | None = None

    def cellset(self, name: str | None = None) -> DataFrame:
        if name is None and len(self.cells) == 1:
            return next(iter(self.cells.values()))
        if name not in self.cells:
            raise KeyError(f"no cell set {name!r}; there are {sorted(self.cells)}")
        return self.cells[name]

    def field(self, name: str, assoc: str | None = None) -> FieldInfo:
        """The first field of that name (and owner)."""
        for f in self.fields:
            if f.name == name and assoc in (None, f.assoc):
                return f
        raise KeyError(f"no field {name!r} on {assoc or 'the mesh'}")

    def with_points(self, points: DataFrame, *new: FieldInfo) -> MeshDataset:
        return replace(self, points=points, fields=self.fields + new)

    def with_cells(self, name: str, cells: DataFrame, *new: FieldInfo) -> MeshDataset:
        return replace(self, cells=self.cells | {name: cells}, fields=self.fields + new)

    def save(self, path: str) -> None:
        """Parquet for each table, and the rest as one JSON row."""
        spark = self.points.sparkSession
        self.points.write.parquet(f"{path}/points")
        for i, cells in enumerate(self.cells.values()):
            cells.write.parquet(f"{path}/cells_{i}")
        if self.whole is not None:
            self.whole.write.parquet(f"{path}/whole")
        meta = {"cells": list(self.cells), "fields": [f.__dict__ for f in self.fields], "dims": self.grid.dims if self.grid else None, "coordinates": self.coordinates, "time": self.time, "whole": self.whole is not None}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> MeshDataset:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
        return MeshDataset(
            spark.read.parquet(f"{path}/points"),
            {name: spark.read.parquet(f"{path}/cells_{i}") for i, name in enumerate(meta["cells"])},
            spark.read.parquet(f"{path}/whole") if meta["whole"] else None,
            tuple(FieldInfo(**f) for f in meta["fields"]),
            GridSpec(tuple(meta["dims"])) if meta["dims"] else None,
            tuple(meta["coordinates"]),
            meta["time"],
        )


def array_stats(df: DataFrame, vector: str, id_col: str) -> DataFrame:
    """Per tuple: least and largest component and magnitude."""
    v = F.col(vector)
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.select(id_col, F.array_min(v).cast("double").alias("min"), F.array_max(v).cast("double").alias("max"), F.sqrt(square).alias("magnitude"))


def component_range(df: DataFrame, vector: str, n: int) -> DataFrame:
    """One row per component: its least and largest value."""
    c = df.select(F.posexplode(vector).alias("component", "v"))
    return c.groupBy("component").agg(F.min("v").cast("double").alias("min"), F.max("v").cast("double").alias("max")).where(F.col("component") < n)
