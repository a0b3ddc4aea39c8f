"""Band joins as bin joins: one helper for every spatial lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.storage import merged

#: Where cells begin, as a share of a cell: coordinates are often round, and would lie on borders.
SHIFT = 0.381966


def explode_bins(rows: DataFrame, ranges: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row for each bin of the box of bin ranges; an empty range drops the row."""
    for name, (low, high) in ranges.items():
        cells = F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))
        rows = rows.withColumn(name, F.explode(cells))
    return rows


def band_join(left: DataFrame, right: DataFrame, on: list[str], axes: list[str], reach: float, cell: float) -> DataFrame:
    """Pairs whose coordinates ``l_axis`` and ``r_axis`` differ by at most ``reach`` on every axis.

    Right rows stand in their own cell, left rows in every cell they can reach; with ``cell`` well
    over ``reach`` that is mostly one: borders lie off round numbers. Columns keep their names; the
    sides must not share any but ``on``.
    """
    at = lambda x: F.floor(x / cell + SHIFT)
    spread = explode_bins(left, {f"_{a}": (at(F.col(f"l_{a}") - reach), at(F.col(f"l_{a}") + reach)) for a in axes})
    placed = right.select("*", *(at(F.col(f"r_{a}")).alias(f"_{a}") for a in axes))
    met = spread.join(merged(placed), on + [f"_{a}" for a in axes])
    return met.drop(*(f"_{a}" for a in axes)).where(" and ".join(f"abs(l_{a} - r_{a}) <= {reach!r}D" for a in axes))
