"""Derived tables are far larger than the table behind them; no plan may broadcast them by estimate."""

import pytest

from meshlark.plans import catalogue
from meshlark.storage import checkpoint

SMALL = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


@pytest.mark.parametrize("name", ["face_vectors", "degenerate_filter", "edge_flag_bits", "weld_pairs", "active_tiles", "seed_nearest", "area_weights", "area_cdf", "near_surface_samples", "exact_field", "jfa_field", "tessellated_field", "isosurface_meshes", "isosurface_cubes", "isosurface_zmax", "trilinear_lookup", "eikonal_subset", "mesh_centroid", "mesh_axes", "mesh_canonical", "face_adjacency", "component_volume", "turned_canonical", "mesh_sampler_summary"])
def test_no_derived_table_is_broadcast(spark, monkeypatch, name):
    """Every plan that is made on the way, checkpoints included; the rounds of components read tables
    of their own, whose size Spark knows, and are left out."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df)

    for module in ("meshlark.operators.mesh", "meshlark.plans.mesh_queries", "meshlark.operators.sampling"):
        monkeypatch.setattr(f"{module}.checkpoint", seen)
    plans.append(QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString())
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoop" in p]


def test_round_coordinates_stand_in_one_cell(spark):
    from pyspark.sql import functions as F

    from meshlark.operators import spatial

    met = []
    real = spatial.explode_bins
    rows = spark.range(100).select(F.lit(1).alias("mesh_id"), (F.col("id") / 100).alias("l_x"), (F.col("id") / 100).alias("r_x"))
    try:
        spatial.explode_bins = lambda *a: met.append(real(*a)) or met[0]
        pairs = spatial.band_join(rows.select("mesh_id", "l_x"), rows.select("mesh_id", "r_x"), ["mesh_id"], ["x"], 1e-7, 1e-3)
    finally:
        spatial.explode_bins = real
    assert met[0].count() == 100 and pairs.count() == 100


def test_points_meet_two_planes(spark):
    from meshlark.operators import sampling, sdf

    n = 5
    field = [[float(x * x + 3 * y - x * z) for y in range(n) for x in range(n)] for z in range(n)]
    planes = spark.createDataFrame([(1, z + 1, field[z]) for z in range(n)], "mesh_id long, iz int, sdf array<double>")
    points = spark.createDataFrame([(1, 1, -1.0, -1.0, -1.0), (1, 2, 1.0, 1.0, 1.0), (1, 3, 0.3, -0.7, 0.11), (1, 4, -0.2, 0.5, 0.5)], "mesh_id long, sample_id long, x double, y double, z double")
    key = ["mesh_id", "sample_id"]
    want = {r.sample_id: r.sd for r in sampling.trilinear(points, sdf.field_nodes(planes, n), n, key).collect()}
    got = sampling.plane_lookup(points, planes, n, key)
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.sample_id: r.sd for r in got.collect()} == pytest.approx(want)
