from collections import Counter
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshlark.functions import expressions as X
from meshlark.operators import isosurface, sampling, sdf
from meshlark.operators import mesh as M
from tests.test_mesh import FACES, tables

POINTS = [((-1, -1, 0), 2.0), ((2, -0.5, 0), 1.25), ((-0.5, 2, 0), 1.25), ((0.5, -1, 0), 1.0), ((-1, 0.5, 0), 1.0), ((1, 1, 0), 0.5), ((0.25, 0.25, 1), 1.0)]


@pytest.mark.parametrize("p,want", POINTS)
def test_distance(spark, p, want):
    t = dict(zip(M.VECTORS, (0, 0, 0, 1, 0, 0, 0, 1, 0)))
    row = spark.range(1).selectExpr(*(f"{float(v)}D as p{c}" for v, c in zip(p, "xyz")), *(f"{v}D as {k}" for k, v in t.items()))
    assert row.selectExpr(*(f"{v} as {k}" for k, v in X.DOTS.items())).select(F.expr(X.DISTANCE2)).first()[0] == pytest.approx(want)
    assert sdf.distance2(np.array(p, float), np.array(list(t.values()), float)) == pytest.approx(want)


def triangles(spark, faces=FACES):
    return M.triangles(*tables(spark, faces))


def grid(planes, n):
    f = planes.toPandas().sort_values("iz")
    return np.stack([np.asarray(s).reshape(n, n).T for s in f["sdf"]], axis=2)


def test_signed_grid_of_the_box(spark):
    g = grid(sdf.fields(triangles(spark), 12), 12)
    assert (g < 0).sum(axis=(0, 1)).tolist() == [0] * 4 + [24] * 4 + [0] * 4
    assert g.sum() == pytest.approx(710.1002618533) and g.min() == pytest.approx(-0.2790909091) and g[0, 0, 0] == pytest.approx(0.9348261871)


def test_flooding_is_never_nearer_and_mostly_exact(spark):
    t = triangles(spark)
    exact, flood = np.abs(grid(sdf.fields(t, 16), 16)), np.abs(grid(sdf.fields(t, 16, "jfa"), 16))
    assert (flood >= exact - 1e-12).all() and np.isclose(flood, exact).mean() > 0.95


def test_relational_forms_agree_with_the_stencil(spark):
    n, f = 12, triangles(spark).toPandas().sort_values("tri_id")
    t = f[M.VECTORS].to_numpy(float)
    best, index = sdf.seeded(t, n)
    rows = sdf.seed_nearest(triangles(spark), n).collect()
    assert len(rows) == np.isfinite(best).sum()
    assert all(best[r.ix - 1, r.iy - 1, r.iz - 1] == pytest.approx(r.d2, abs=1e-12) for r in rows)
    within = {(r.ix, r.iy, r.iz) for r in sdf.parity_fill(sdf.parity_hits(triangles(spark), n), n).collect()}
    x, y, z = np.nonzero(sdf.inside(t, n, f["flags"].to_numpy()))
    assert within == set(zip((x + 1).tolist(), (y + 1).tolist(), (z + 1).tolist()))


def test_isosurface_is_closed_and_has_the_volume(spark):
    n = 24
    x = sdf.nodes(n)
    v, t = isosurface.surface(np.linalg.norm(x, axis=-1) - 0.7)
    assert len(v) - len(t) * 3 // 2 + len(t) == 2
    a, b, c = v[t[:, 0]], v[t[:, 1]], v[t[:, 2]]
    assert np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6 == pytest.approx(4 / 3 * np.pi * 0.7**3, rel=0.02)
    vertices, faces = isosurface.as_tables(isosurface.isosurfaces(sdf.fields(triangles(spark), 12), 12))
    n = M.edge_multiplicity(faces).first()
    assert (n.boundary, n.non_manifold) == (0, 0)
    assert vertices.agg(F.max("z")).first()[0] == pytest.approx(0.37)


@pytest.mark.parametrize("cubes", [False, True])
def test_surfaces_close_whatever_the_field(cubes):
    """Every edge is run both ways equally often, on noise with all cases; a sphere has its volume and
    fewer triangles by cubes."""
    field = np.random.default_rng(2).standard_normal((14, 14, 14))
    field[[0, -1]] = field[:, [0, -1]] = field[:, :, [0, -1]] = 1
    v, t = isosurface.surface(field, 0.0, cubes)
    runs = Counter(map(tuple, np.concatenate((t[:, :2], t[:, 1:], t[:, [2, 0]])).tolist()))
    assert all(runs[b, a] == k for (a, b), k in runs.items()) and len(t) > 5000
    v, t = isosurface.surface(np.linalg.norm(sdf.nodes(24), axis=-1) - 0.7, 0.0, cubes)
    a, b, c = v[t[:, 0]], v[t[:, 1]], v[t[:, 2]]
    assert np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6 == pytest.approx(4 / 3 * np.pi * 0.7**3, rel=0.02)
    assert 2 * len(v) - len(t) == 4 and (len(t) < 4000) == cubes
    assert isosurface.surface(np.ones((8, 8, 8)), 0.0, cubes)[1].shape == (0, 3)


def test_resolution_is_checked(spark):
    with pytest.raises(ValueError):
        sdf.fields(triangles(spark), 7)


def test_strata():
    s = sampling.SamplingParameters().strata()
    assert [(a, b) for _, a, b, _ in s] == [(1, 26214), (26215, 58327), (58328, 85852), (85853, 104202), (104203, 117965), (117966, 131072)]
    p = sampling.SamplingParameters()
    assert (p.voxel, p.clamp, p.eikonal_threshold) == pytest.approx((0.007843138, 0.1254902, 0.015686275)) and p.eikonal_samples == 32768
    with pytest.raises(ValueError):
        sampling.partition_slice(1, 10, (0.5, 0.4))


def test_trilinear_reproduces_nodes_and_linear_fields(spark):
    n = 8
    nodes = spark.range(n**3).selectExpr("1L as mesh_id", f"cast(id % {n} + 1 as int) as ix", f"cast((id div {n}) % {n} + 1 as int) as iy", f"cast(id div {n * n} + 1 as int) as iz")
    nodes = nodes.selectExpr("*", " + ".join(f"{k}*{X.coordinate(f'i{c}', n)}" for k, c in zip((1, 2, -3), "xyz")) + " as sdf")
    p = np.random.default_rng(0).uniform(-1, 1, (50, 3)).tolist() + [[-1.0, -1.0, -1.0], [1.0, 1.0, 1.0]]
    points = spark.createDataFrame([(1, i, *q) for i, q in enumerate(p)], "mesh_id long, sample_id long, x double, y double, z double")
    for r in sampling.trilinear(points, nodes, n, ["mesh_id", "sample_id"]).collect():
        assert r.sd == pytest.approx(r.x + 2 * r.y - 3 * r.z, abs=1e-9)


def test_surface_samples_lie_on_the_box(spark):
    s = sampling.surface_samples(triangles(spark), 1, 4000).toPandas()
    q = s[["x", "y", "z"]].abs().to_numpy() / [0.61, 0.43, 0.37]
    assert np.allclose(q.max(axis=1), 1)
    area = np.array([0.43 * 0.37, 0.61 * 0.37, 0.61 * 0.43])
    assert np.bincount(q.argmax(axis=1), minlength=3) / len(s) == pytest.approx(area / area.sum(), abs=0.03)
    for sigma in (0.05, 0.8):
        near = sampling.near_surface_samples(spark.createDataFrame(pd.DataFrame(s[["mesh_id", "sample_id", "x", "y", "z"]])), sigma).toPandas().sort_values("sample_id")
        moved = near[["x", "y", "z"]].to_numpy()
        assert np.abs(moved).max() <= 1
        # each axis follows the normal cut off at the cube: its distribution there is uniform
        cdf, at = np.vectorize(NormalDist().cdf), s.sort_values("sample_id")[["x", "y", "z"]].to_numpy()
        lo, hi = cdf((-1 - at) / sigma), cdf((1 - at) / sigma)
        share = np.sort(((cdf((moved - at) / sigma) - lo) / (hi - lo)).ravel())
        assert np.abs(share - (np.arange(len(share)) + 0.5) / len(share)).max() < 0.02


def test_draws_meet_few_slices(spark):
    """Against a plain search, for groups of uneven weights, zero weights and one slice."""
    rng = np.random.default_rng(3)
    weights = {1: rng.pareto(1, 500), 2: np.array([0.0, 2.0, 0.0, 1.0, 0.0]), 3: np.array([4.0]), 4: np.array([1e-12] * 50 + [1.0])}
    rows = spark.createDataFrame([(g, i, float(w)) for g, ws in weights.items() for i, w in enumerate(ws)], "g long, i long, w double")
    asked = [(g, k, float(u)) for g in weights for k, u in enumerate([0.0, 1 - 2**-53, *rng.random(300)])]
    got = sampling.draw(spark.createDataFrame(asked, "g long, k long, u double"), sampling.cumulated(rows, "g", "i", "w"), "g", "u", "i")
    have = {(r.g, r.k): r.pick.i for r in got.collect()}
    assert len(have) == len(asked)
    for g, k, u in asked:
        hi = np.cumsum(weights[g]) / weights[g].sum()
        i = have[g, k]
        assert weights[g][i] > 0 and (hi[i - 1] if i else 0) - 1e-9 <= u <= hi[i] + 1e-9


def sphere(m, k, turn):
    """Triangles of a rotated sphere of radius 0.7."""
    a, b = np.linspace(0, np.pi, m + 1), np.arange(k) * 2 * np.pi / k
    p = 0.7 * np.stack([np.outer(np.sin(a), np.cos(b)), np.outer(np.sin(a), np.sin(b)), np.outer(np.cos(a), np.ones(k))], -1) @ turn.T
    rows = [(p[i, j], p[i + 1, j], p[i + 1, (j + 1) % k]) for i in range(m - 1) for j in range(k)] + [(p[i, j], p[i + 1, (j + 1) % k], p[i, (j + 1) % k]) for i in range(1, m) for j in range(k)]
    return np.array([np.concatenate((x, y - x, z - x)) for x, y, z in rows])


def test_slabs_of_a_finely_cut_sphere(spark, monkeypatch):
    """Bounded search and slabs against every distance, on a rotated mesh of 1140 triangles."""
    t, n = sphere(20, 30, np.linalg.qr(np.random.default_rng(0).standard_normal((3, 3)))[0]), 20
    best, index = sdf.exact_index(t, n)
    every = np.stack([sdf.distance2(sdf.nodes(n), x) for x in t])
    assert (best == every.min(axis=0)).all() and (index == every.argmin(axis=0)).all()
    assert (sdf.jump_flood(t, n)[0] >= best - 1e-12).all()
    frame = pd.DataFrame(t, columns=M.VECTORS).assign(mesh_id=4)
    frame["tri_id"] = np.arange(1, len(t) + 1)
    tri = spark.createDataFrame(frame).withColumn("flags", F.expr(X.edge_flags()))
    whole = grid(sdf.fields(tri, n), n)
    monkeypatch.setattr(sdf, "NODES", n * n * 3)
    monkeypatch.setattr(isosurface, "NODES", n * n * 3)
    slabs = sdf.fields(tri, n)
    assert (grid(slabs, n) == whole).all()
    r = np.linalg.norm(sdf.nodes(n), axis=-1)
    assert ((whole < 0) == (r < 0.7))[np.abs(r - 0.7) > 0.02].all() and not (whole[:, :, [0, -1]] < 0).any()
    (row,) = isosurface.isosurfaces(slabs, n).collect()
    v, f = isosurface.surface(whole)
    assert np.allclose(row.vertices, v) and set(map(tuple, row.faces)) == set(map(tuple, (f + 1).tolist())) and 2 * len(v) - len(f) == 4


def test_meshes_without_area_or_vertices_raise(spark):
    vertices, faces = tables(spark, FACES)
    with pytest.raises(Exception, match="degenerate"):
        M.triangles(vertices, faces.selectExpr("mesh_id", "face_id", "a", "a as b", "a as c")).collect()
    with pytest.raises(ValueError, match="vertices"):
        M.canonicalize(vertices.where("vertex_id > 2"), faces)


def test_subset_keeps_all_when_few(spark):
    rows = spark.range(20).selectExpr("id % 2 as mesh_id", "id as sample_id")
    assert sampling.random_subset(rows, "mesh_id", "sample_id", 10).count() == 20
    assert sampling.random_subset(rows, "mesh_id", "sample_id", 3).count() == 6
