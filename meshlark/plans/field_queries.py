"""Bins, nearest triangles, parity and signed fields over one box a part, on grids of 8 or 12 nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.functions.expressions import DISTANCE2, DOTS, DUCK, box_distance, coordinate, tidy, voxel
from meshlark.operators import isosurface, sdf
from meshlark.operators.batches import gathered
from meshlark.operators.mesh import triangles
from meshlark.operators.tables import counts_and_offsets
from meshlark.plans.derived import SQL_BOX, SQL_TRI, box_welded, boxes, tessellated_rows

N, M = 8, 12


def _tri(spark, sf_dir):
    return triangles(*box_welded(boxes(spark, sf_dir)))


def _rows(spark, sf_dir):
    """The same as rows of vertices and faces, for what is made a mesh at a time."""
    return gathered(*box_welded(boxes(spark, sf_dir)))


def point_triangle_distance(spark, sf_dir):
    """Distance of every vector's first three components to one triangle."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id", *(f"cast(embedding[{i}] as double) as p{c}" for i, c in enumerate("xyz")))
    e = e.selectExpr("*", *(f"{v}e0 as {k}" for k, v in _TRIANGLE.items()))
    return e.selectExpr("vec_id", *(f"{v} as {k}" for k, v in DOTS.items())).selectExpr("vec_id", f"{tidy(f'sqrt({DISTANCE2})')} as d")


_TRIANGLE = dict(zip(sdf.VECTORS, (0, 0, 0, 0.5, 0, 0.125, 0, 0.75, -0.25)))


def seed_bins(spark, sf_dir):
    return sdf.seed_bins(_tri(spark, sf_dir), M, 1, (4, 4, 2)).selectExpr("mesh_id", "tile_id", "cast(tri_id as bigint) as tri_id")


def seed_bin_offsets(spark, sf_dir):
    return counts_and_offsets(sdf.seed_bins(_tri(spark, sf_dir), M, 1, (4, 4, 2)), "mesh_id", "tile_id")


def parity_bins(spark, sf_dir):
    return sdf.parity_bins(_tri(spark, sf_dir), M, (4, 4)).selectExpr("mesh_id", "tile_id", "cast(tri_id as bigint) as tri_id")


def active_tiles(spark, sf_dir):
    return sdf.parity_bins(_tri(spark, sf_dir), M, (4, 4)).groupBy("mesh_id").agg(F.countDistinct("tile_id").alias("active"))


def seed_nearest(spark, sf_dir):
    got = sdf.seed_nearest(_rows(spark, sf_dir), N)
    return got.groupBy("mesh_id", "iz").agg(F.count("*").alias("n"), F.sum(F.sqrt("d2")).alias("d")).selectExpr("mesh_id", "iz", "n", f"{tidy('d')} as d")


def exact_field(spark, sf_dir):
    got = sdf.fields(_rows(spark, sf_dir), N)
    return got.selectExpr("mesh_id", "cast(iz as bigint) as iz", "aggregate(sdf, 0e0, (a, v) -> a + abs(v)) as d").selectExpr("mesh_id", "iz", f"{tidy('d')} as d")


def jfa_field(spark, sf_dir):
    """Sum of distances by jump flooding; never below the exact sum."""
    got = sdf.fields(_rows(spark, sf_dir), M, "jfa").selectExpr("mesh_id", "aggregate(sdf, 0e0, (a, v) -> a + abs(v)) as d")
    return got.groupBy("mesh_id").agg(F.sum("d").alias("d")).selectExpr("mesh_id", f"{tidy('d')} as d")


def parity_hits(spark, sf_dir):
    return sdf.parity_hits(_tri(spark, sf_dir), M).selectExpr("mesh_id", "ix", "iy", "z_idx")


def parity_fill(spark, sf_dir):
    return sdf.parity_fill(sdf.parity_hits(_tri(spark, sf_dir), M), M).selectExpr("mesh_id", "ix", "iy", "cast(iz as bigint) as iz")


def signed_field(spark, sf_dir):
    got = sdf.fields(_rows(spark, sf_dir), M)
    total = got.selectExpr("mesh_id", "cast(iz as bigint) as iz", "aggregate(sdf, 0e0, (a, v) -> a + v) as total", "array_min(sdf) as least")
    return total.selectExpr("mesh_id", "iz", f"{tidy('total')} as total", f"{tidy('least')} as least")


def tessellated_field(spark, sf_dir):
    """The signed field of boxes of 108 triangles, whose edges run through the sides."""
    got = sdf.fields(tessellated_rows(boxes(spark, sf_dir), 3), N).selectExpr("mesh_id", "cast(iz as bigint) as iz", "aggregate(sdf, 0e0, (a, v) -> a + v) as total", "cast(size(filter(sdf, v -> v < 0)) as bigint) as n")
    return got.selectExpr("mesh_id", "iz", f"{tidy('total')} as total", "n")


def negative_slice_counts(spark, sf_dir):
    return sdf.fields(_rows(spark, sf_dir), M).selectExpr("mesh_id", "cast(iz as bigint) as iz", "cast(size(filter(sdf, v -> v < 0)) as bigint) as n")


def isosurface_meshes(spark, sf_dir):
    """Reconstruction of every mesh: counts and whether its Euler number is that of a closed surface."""
    got = isosurface.mesh_isosurfaces(_rows(spark, sf_dir), M)
    return got.selectExpr("mesh_id", "cast(size(vertices) as bigint) as vertices", "cast(size(faces) as bigint) as faces", "2 * size(vertices) - size(faces) = 4 as closed")


def isosurface_cubes(spark, sf_dir):
    """The same by marching cubes."""
    got = isosurface.mesh_isosurfaces(_rows(spark, sf_dir), M, cubes=True)
    return got.selectExpr("mesh_id", "cast(size(vertices) as bigint) as vertices", "cast(size(faces) as bigint) as faces", "array_max(transform(vertices, v -> v[2])) as z").selectExpr("mesh_id", "vertices", "faces", f"{tidy('z')} as z")


def isosurface_zmax(spark, sf_dir):
    """Greatest height of the reconstruction."""
    got = isosurface.mesh_isosurfaces(_rows(spark, sf_dir), M)
    return got.selectExpr("mesh_id", "array_max(transform(vertices, v -> v[2])) as z").selectExpr("mesh_id", f"{tidy('z')} as z")


QUERIES = {f.__name__: f for f in (point_triangle_distance, seed_bins, seed_bin_offsets, parity_bins, active_tiles, seed_nearest, exact_field, jfa_field, parity_hits, parity_fill, signed_field, tessellated_field, negative_slice_counts, isosurface_meshes, isosurface_cubes, isosurface_zmax)}


def _span(c: str) -> tuple[str, str]:
    corners = f"a{c}, a{c}+ab{c}, a{c}+ac{c}"
    return f"least({corners})", f"greatest({corners})"


def _bins(axes, tile, low, high, names="tri") -> str:
    counts = [-(-M // t) for t in tile]
    cols = ", ".join(f"(greatest({low(c)}, 1) - 1) // {t} as l{c}, (least({high(c)}, {M}) - 1) // {t} as h{c}" for c, t in zip(axes, tile))
    joins = "".join(f" join range({k}) r{c}(t{c}) on t{c} between l{c} and h{c}" for c, k in zip(axes, counts))
    tile_id = "1 + tx + ty * %d" % counts[0] + (" + tz * %d" % (counts[0] * counts[1]) if len(axes) > 2 else "")
    return f"bins as (select mesh_id, ({tile_id})::bigint as tile_id, tri_id::bigint as tri_id from (select mesh_id, tri_id, {cols} from {names}) b{joins})"


_SEED = _bins("xyz", (4, 4, 2), lambda c: f"{voxel(_span(c)[0], M, DUCK)} - 1", lambda c: f"{voxel(_span(c)[1], M, DUCK)} + 1")
_MAG = f"{sdf.JITTER * 2 / (M - 1)!r}::double"
_PARITY = _bins("xy", (4, 4), lambda c: voxel(f"{_span(c)[0]} - {_MAG}", M, DUCK), lambda c: f"{voxel(f'{_span(c)[1]} + {_MAG}', M, DUCK)} + 1", "(select * from tri where abs(aby*acx - abx*acy) > 1e-10)")


def _grid(n: int) -> str:
    p = ", ".join(f"{coordinate(f'i{c}', n)} as {c}" for c in "xyz")
    return f"node as (select ix, iy, iz, {p} from range(1, {n + 1}) a(ix), range(1, {n + 1}) b(iy), range(1, {n + 1}) c(iz)), field as (select mesh_id, ix, iy, iz, {box_distance('x', 'y', 'z')} as sdf from box, node)"


#: The surface crosses the edges of the tetrahedra: seven directions from each node.
_EDGES = f"""with {SQL_BOX}, {_grid(M)}, way(dx, dy, dz) as (values (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1)),
edge as materialized (select x, y, z, {', '.join(f'{coordinate(f"(i{c} + d{c})", M)} as {c}2' for c in 'xyz')}, dx + dy + dz as way from node, way where ix + dx <= {M} and iy + dy <= {M} and iz + dz <= {M}),
ends as (select mesh_id, z, z2, way, {box_distance('x', 'y', 'z')} as d, {box_distance('x2', 'y2', 'z2')} as d2 from box, edge),
crossing as (select mesh_id, way, z + d / (d - d2) * (z2 - z) as z from ends where (d < 0) <> (d2 < 0))"""
ORACLES = {
    "point_triangle_distance": f"select vec_id, round(sqrt({DISTANCE2}), 6) + 0e0 as d from (select vec_id, {', '.join(f'{v} as {k}' for k, v in DOTS.items())} from (select vec_id, {', '.join(f'embedding[{i}]::double as p{c}' for i, c in enumerate('xyz', 1))}, {', '.join(f'{v}::double as {k}' for k, v in _TRIANGLE.items())} from embeddings))",
    "seed_bins": f"with {SQL_TRI}, {_SEED} select * from bins",
    "seed_bin_offsets": f"with {SQL_TRI}, {_SEED} select mesh_id, tile_id, n, (sum(n) over (partition by mesh_id order by tile_id rows unbounded preceding) - n + 1)::bigint as first from (select mesh_id, tile_id, count(*) as n from bins group by 1, 2)",
    "parity_bins": f"with {SQL_TRI}, {_PARITY} select * from bins",
    "active_tiles": f"with {SQL_TRI}, {_PARITY} select mesh_id, count(distinct tile_id) as active from bins group by 1",
    # with these tiles every tile of the small grid sees every triangle within the band: the box's own distance
    "seed_nearest": f"with {SQL_BOX}, {_grid(N)} select mesh_id, iz, count(*) as n, round(sum(abs(sdf)), 6) + 0e0 as d from field group by 1, 2",
    "exact_field": f"with {SQL_BOX}, {_grid(N)} select mesh_id, iz, round(sum(abs(sdf)), 6) + 0e0 as d from field group by 1, 2",
    "parity_hits": f"with {SQL_BOX}, {_grid(M)}, col as (select mesh_id, ix, iy, iz, sdf < 0 as i, lag(sdf < 0, 1, false) over (partition by mesh_id, ix, iy order by iz) as b from field) select mesh_id, ix, iy, iz as z_idx from col where i <> b",
    "parity_fill": f"with {SQL_BOX}, {_grid(M)} select mesh_id, ix, iy, iz from field where sdf < 0",
    "signed_field": f"with {SQL_BOX}, {_grid(M)} select mesh_id, iz, round(sum(sdf), 6) + 0e0 as total, round(min(sdf), 6) + 0e0 as least from field group by 1, 2",
    # flooding finds the nearest triangle of a box everywhere on this grid
    "jfa_field": f"with {SQL_BOX}, {_grid(M)} select mesh_id, round(sum(abs(sdf)), 6) + 0e0 as d from field group by 1",
    "tessellated_field": f"with {SQL_BOX}, {_grid(N)} select mesh_id, iz, round(sum(sdf), 6) + 0e0 as total, count(*) filter (sdf < 0) as n from field group by 1, 2",
    # of a closed surface without handles, faces = 2 vertices - 4
    "isosurface_meshes": f"{_EDGES} select mesh_id, count(*) as vertices, 2 * count(*) - 4 as faces, true as closed from crossing group by 1",
    "isosurface_cubes": f"{_EDGES} select mesh_id, count(*) as vertices, 2 * count(*) - 4 as faces, round(max(z), 6) + 0e0 as z from crossing where way = 1 group by 1",
    "isosurface_zmax": f"{_EDGES} select mesh_id, round(max(z), 6) + 0e0 as z from crossing group by 1",
    "negative_slice_counts": f"with {SQL_BOX}, {_grid(M)} select mesh_id, iz, count(*) filter (sdf < 0) as n from field group by 1, 2",
}
