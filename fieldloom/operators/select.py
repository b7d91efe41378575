"""Selection of cells: thresholds, subsets, boxes, lists, external faces. Cell ids stay, so a selection is a view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topology import cell_faces, incidence


def threshold_cells(cells: DataFrame, field: str, low: float, high: float) -> DataFrame:
    """Cells whose own field is in [low, high]."""
    return cells.where(F.col(field).between(low, high))


def threshold_nodes(cells: DataFrame, points: DataFrame, field: str, low: float, high: float, all_points: bool = False) -> DataFrame:
    """Cells with any (or all) of their nodes' values in [low, high].

    A list of the wanted (or, for all, the unwanted) nodes is found first; only its cells are grouped or dropped.
    """
    inside = F.col(field).between(low, high)
    bad = points.where(~inside | F.col(field).isNull() if all_points else inside).select("node_id")
    hit = incidence(cells).join(bad, "node_id", "left_semi").select("cell_id").distinct()
    return cells.join(hit, "cell_id", "left_anti" if all_points else "left_semi")


def box(cells: DataFrame, points: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Cells all of whose nodes lie in the ranges, borders included."""
    inside = F.lit(True)
    for axis, (low, high) in ranges.items():
        inside = inside & F.col(axis).between(low, high)
    out = incidence(cells).join(points.where(~inside).select("node_id"), "node_id", "left_semi").select("cell_id").distinct()
    return cells.join(out, "cell_id", "left_anti")


def selection(cells: DataFrame, field: str, values: DataFrame, value: str) -> DataFrame:
    """Cells whose field is one of the values."""
    return cells.join(values.select(F.col(value).alias("_v")).distinct(), F.col(field) == F.col("_v"), "left_semi")


def external_faces(cells: DataFrame, *carry: str) -> DataFrame:
    """cell_id (the owner), slot, nodes of faces that one cell alone has, with the owner's fields."""
    g = cell_faces(cells).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cell_id", "slot", "nodes")).alias("f"))
    out = g.where("n = 1").select("f.*")
    return out.join(cells.select("cell_id", *carry), "cell_id") if carry else out
