"""Meshes over the relational tables: keys of orders, part, customer and supplier are dense and serve as node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import grid as g
from fieldloom.model import GridSpec, Shape


class Tables:
    """The tables of a folder and the meshes over them. Sizes of the grids come from counts, which read no column."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # G2: orders on a grid 100 wide; G3: part on a grid 10 x 10 x n; B1: customers in a row

    def g2(self) -> tuple[GridSpec, DataFrame, DataFrame]:
        """grid, points (node_id, i, j, v), cells."""
        grid = GridSpec((100, self.orders.count() // 100))
        k = F.col("o_orderkey").cast("long")
        points = self.orders.where(k < grid.n_nodes).select(k.alias("node_id"), (k % 100).alias("i"), F.floor(k / 100).alias("j"), F.col("o_totalprice").alias("v"))
        return grid, points, g.cells(self.spark, grid)

    def g3(self) -> tuple[GridSpec, DataFrame, DataFrame]:
        """grid, points (node_id, i, j, k, v, size), cells."""
        grid = GridSpec((10, 10, self.part.count() // 100))
        k = F.col("p_partkey").cast("long")
        points = self.part.where(k < grid.n_nodes).select(k.alias("node_id"), (k % 10).alias("i"), (F.floor(k / 10) % 10).alias("j"), F.floor(k / 100).alias("k"), F.col("p_retailprice").alias("v"), F.col("p_size").cast("long").alias("size"))
        return grid, points, g.cells(self.spark, grid)

    def b1(self) -> tuple[GridSpec, DataFrame, DataFrame]:
        grid = GridSpec((self.customer.count(),))
        points = self.customer.select(F.col("c_custkey").cast("long").alias("node_id"), F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("v"))
        return grid, points, g.cells(self.spark, grid)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """points (node_id: parts, then suppliers) and beams of distinct (part, supplier), value the sum of prices in cents."""
        n = self.part.count()
        points = self.part.select(F.col("p_partkey").cast("long").alias("node_id")).union(self.supplier.select((F.col("s_suppkey") + n).cast("long")))
        e = self.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
        m = F.col("l_partkey") * 100_000 + F.col("l_suppkey")
        return points, e.select(m.cast("long").alias("cell_id"), F.lit(int(Shape.BEAM)).alias("shape"), F.array(F.col("l_partkey").cast("long"), (F.col("l_suppkey") + n).cast("long")).alias("nodes"), "cents")

    def cloud(self) -> DataFrame:
        """Points of the suppliers: node_id, x, y, z."""
        return self.supplier.select(F.col("s_suppkey").cast("long").alias("node_id"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_suppkey") % 10).cast("double").alias("y"), F.col("s_nationkey").cast("double").alias("z"))

    # a scene: for each part a tilted triangle over a 10 x 10 field, and a sphere and a cylinder in rows of ten

    def tris(self) -> DataFrame:
        p = self.part.select(F.col("p_partkey").cast("long").alias("idx"), (F.col("p_partkey") % 10).cast("double").alias("ax"), (F.floor(F.col("p_partkey") / 10) % 10).cast("double").alias("ay"), (5 + F.col("p_size") / 10.0).alias("az"))
        ax, ay, az = F.col("ax"), F.col("ay"), F.col("az")
        return p.select("*", (ax + 0.9).alias("bx"), ay.alias("by"), (az + 0.1).alias("bz"), ax.alias("cx"), (ay + 0.9).alias("cy"), (az + 0.2).alias("cz"))

    def spheres(self) -> DataFrame:
        p = self.part
        k = F.col("p_partkey")
        return p.select(k.cast("long").alias("idx"), (k % 10).cast("double").alias("cx"), (F.floor(k / 10) * 2).cast("double").alias("cy"), (4 + F.col("p_size") / 10.0).alias("cz"), (0.2 + (k % 5) / 10.0).alias("r"))

    def cylinders(self) -> DataFrame:
        p = self.part
        k = F.col("p_partkey")
        return p.select(k.cast("long").alias("idx"), (k % 10).cast("double").alias("bx"), (F.floor(k / 10) * 2).cast("double").alias("by"), (4 + F.col("p_size") / 10.0).alias("bz"), F.lit(0.6).alias("ax"), F.lit(0.8).alias("ay"), F.lit(0.0).alias("az"), F.lit(1.5).alias("h"), F.lit(0.25).alias("r"))
