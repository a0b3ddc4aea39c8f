"""Grid generators."""

from __future__ import annotations

from meshlark.functions.expressions import coordinate, tidy
from meshlark.operators import grid

N, SLAB = 16, 4
_XYZ = [f"{tidy(c, 9)} as {c}" for c in "xyz"]


def grid_points(spark, sf_dir):
    return grid.grid_points(spark, N, slab=SLAB).selectExpr("linear", "ix", "iy", "iz", *_XYZ)


def grid_slice(spark, sf_dir):
    return grid.grid_points(spark, N, 3, 5).selectExpr("linear", "ix", "iy", "iz", *_XYZ)


def grid_slab_points(spark, sf_dir):
    return grid.slab_points(spark, N, SLAB, 2).selectExpr("linear", *_XYZ)


def grid_point_index_ranges(spark, sf_dir):
    return grid.slab_ranges(spark, N, SLAB)


_SQL = f"""select linear, ix, iy, iz, {', '.join(f'round({coordinate(f"i{c}", N)}, 9) + 0e0 as {c}' for c in 'xyz')} from
(select l as linear, (l-1) % {N} + 1 as ix, ((l-1) // {N}) % {N} + 1 as iy, (l-1) // {N * N} + 1 as iz from range(1, {N**3 + 1}) r(l))"""

QUERIES = {"grid_points": grid_points, "grid_slice": grid_slice, "grid_slab_points": grid_slab_points, "grid_point_index_ranges": grid_point_index_ranges}
ORACLES = {
    "grid_points": _SQL,
    "grid_slice": f"select * from ({_SQL}) where iz between 3 and 5",
    "grid_slab_points": f"select linear, x, y, z from ({_SQL}) where (iz - 1) // {SLAB} = 1",
    "grid_point_index_ranges": f"select (iz - 1) // {SLAB} + 1 as slab, min(linear) as first, max(linear) as last from ({_SQL}) group by 1",
}
