"""The node-centred grid of the cube [-1, 1]^3: generated, sliced and cut into slabs lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions.expressions import coordinate


def check_resolution(n: int) -> None:
    if not 8 <= n <= 1024:
        raise ValueError("the resolution must be 8 to 1024")


def _points(rows: DataFrame, n: int) -> DataFrame:
    i = rows.select(F.col("id").alias("linear"), F.expr(f"(id - 1) % {n} + 1").alias("ix"), F.expr(f"((id - 1) div {n}) % {n} + 1").alias("iy"), F.expr(f"(id - 1) div {n * n} + 1").alias("iz"))
    return i.select("*", *(F.expr(coordinate(f"i{c}", n)).alias(c) for c in "xyz"))


def grid_points(spark: SparkSession, n: int, k0: int = 1, k1: int | None = None, slab: int | None = None) -> DataFrame:
    """Nodes of the planes ``k0`` to ``k1`` in column-major numbering; one partition a slab if given,
    which must divide the planes."""
    k1 = n if k1 is None else k1
    if not 1 <= k0 <= k1 <= n:
        raise IndexError("planes out of the grid")
    if slab is not None and (slab < 1 or (k1 - k0 + 1) % slab):
        raise ValueError("slabs must divide the planes")
    parts = None if slab is None else (k1 - k0 + 1) // slab
    return _points(spark.range((k0 - 1) * n * n + 1, k1 * n * n + 1, 1, parts), n)


def slab_points(spark: SparkSession, n: int, slab: int, index: int) -> DataFrame:
    """The points of one slab of ``slab`` planes (from 1)."""
    first, last = slab_range(n, slab, index)
    return _points(spark.range(first, last + 1), n)


def slab_range(n: int, slab: int, index: int) -> tuple[int, int]:
    if n % slab:
        raise ValueError("slabs must divide the resolution")
    if not 1 <= index <= n // slab:
        raise IndexError("slab out of the grid")
    return (index - 1) * n * n * slab + 1, index * n * n * slab


def slab_ranges(spark: SparkSession, n: int, slab: int) -> DataFrame:
    """``slab, first, last``: the linear numbers of each slab."""
    slab_range(n, slab, 1)
    size = n * n * slab
    return spark.range(1, n // slab + 1).select(F.col("id").alias("slab"), ((F.col("id") - 1) * size + 1).alias("first"), (F.col("id") * size).alias("last"))
