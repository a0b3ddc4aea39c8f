import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import expressions as X
from meshlark.operators import mesh as M
from meshlark.operators.graph import connected_components
from meshlark.plans.derived import CORNERS, FACES
from meshlark.sources.meshes import soup_tables

H = (0.61, 0.43, 0.37)


def tables(spark, faces, points=None, mesh=1):
    points = [tuple(s * h for s, h in zip(c, H)) for c in CORNERS] if points is None else points
    v = spark.createDataFrame([(mesh, i, *map(float, p)) for i, p in enumerate(points, 1)], "mesh_id long, vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(mesh, i, *(c + 1 for c in t)) for i, t in enumerate(faces, 1)], "mesh_id long, face_id long, a long, b long, c long")
    return v, f


@pytest.mark.parametrize("x,want", [(0, 0), (1, 1753845952), (2, 3507691905), (42, 388445122), (4294967295, 1734902346)])
def test_hash(spark, x, want):
    assert spark.range(1).select(F.expr(X.u32_hash(f"cast({x} as bigint)"))).first()[0] == want


@pytest.mark.parametrize("at,want", [((1, 1), (-0.3213778897, 0.4728694591)), ((2, 1), (-0.152735175, 0.288128481)), ((256, 256), (0.2984283207, -0.3936903944))])
def test_jitter(spark, at, want):
    got = spark.range(1).select(*(F.expr(j) for j in X.jitter(str(at[0]), str(at[1]), "1e0"))).first()
    assert tuple(got) == pytest.approx(want, abs=1e-8)


def test_edge_flags(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0), (0.0, 1.0, 1.0, 0.0)], "abx double, aby double, acx double, acy double")
    assert [r[0] for r in rows.select(F.expr(X.edge_flags())).collect()] == [4, 4]


def test_components_of_chains_stars_and_loops(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7000, 7000), (None, 3), (50, 45)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(e, "src long, dst long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 7000: 7000, 45: 45, 50: 45}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_weld_near_and_equal(spark):
    p = [(0.0, 0, 0), (0, 0, 0), (5e-8, 0, 0), (1.2e-7, 0, 0), (1, 0, 0), (1 + 9e-8, 0, 0), (-1e-8, 0, 0)]
    v, _ = tables(spark, FACES, p)
    assert dict(M.weld_components(v).select("vertex_id", "root").collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 1}
    with pytest.raises(ValueError):
        M.weld_pairs(v, 0)


def test_weld_drops_degenerate_and_duplicate_faces(spark):
    v, f = tables(spark, [*FACES, (0, 1, 1), (5, 6, 4)])
    w = M.weld_components(v)
    got = M.weld_faces(f, w, M.weld_vertices(w))
    assert sorted(r[0] for r in got.select("face_id").collect()) == list(range(1, 13))


def test_orientation(spark):
    flipped = [(a, c, b) if i in (2, 7, 11) else (a, b, c) for i, (a, b, c) in enumerate(FACES, 1)]
    v, f = tables(spark, flipped)
    assert {r.face_id for r in M.orient_flips(f).where("flip = 1").collect()} == {2, 7, 11}
    assert M.orient_flips(f).where("component <> 1").count() == 0
    far = [tuple(c) for c in np.array(CORNERS) * H] + [tuple(c) for c in np.array(CORNERS) * H + 3]
    two = FACES + [(a + 8, c + 8, b + 8) for a, b, c in FACES]
    v, f = tables(spark, two, far)
    out = M.reorient(v, f)
    assert {r.face_id for r in out.where("flip = 1").collect()} == set(range(13, 25))
    volume = M.signed_volumes(v, out.select("mesh_id", "face_id", "a", "b", "c"), out.select("mesh_id", "face_id", "component", F.lit(0).alias("flip")))
    assert [r.volume6 / 6 for r in volume.collect()] == pytest.approx([0.776408] * 2)


def test_open_and_non_manifold_raise(spark):
    for faces in (FACES[:-1], [*FACES, (0, 1, 6)]):
        with pytest.raises(ValueError):
            M.orient_flips(tables(spark, faces)[1])
    n = M.edge_multiplicity(tables(spark, FACES[:-1])[1]).first()
    assert (n.boundary, n.manifold, n.non_manifold) == (3, 15, 0)


def test_moebius_strip_raises(spark):
    k = 5
    strip = [(2 * i, (2 * i + 2) % (2 * k), 2 * i + 1) if i < k - 1 else (2 * i, 1, 2 * i + 1) for i in range(k)]
    strip += [(2 * i + 1, (2 * i + 2) % (2 * k), (2 * i + 3) % (2 * k)) if i < k - 1 else (2 * i + 1, 1, 0) for i in range(k)]
    with pytest.raises(Exception, match="not orientable"):
        M.orient_flips(tables(spark, strip, [(0, 0, 0)] * (2 * k))[1], check=False).collect()


def test_canonical_box(spark):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    p = np.array(CORNERS) * H @ q.T + [3, -2, 1]
    soup = [(1, f, 3 * (f - 1) + k + 1, *map(float, p[c])) for f, t in enumerate(FACES, 1) for k, c in enumerate(t)]
    v, f = M.canonicalize(*soup_tables(spark.createDataFrame(soup, "mesh_id long, face_id long, vertex_id long, x double, y double, z double")), eps=1e-6)
    got = np.array([[r.x, r.y, r.z] for r in v.collect()])
    assert len(got) == 8 and np.abs(got).max(axis=0) == pytest.approx(0.9 * np.array(H) / np.linalg.norm(H))
    assert np.linalg.norm(got, axis=1).max() == pytest.approx(0.9)
    tri = M.with_area(M.face_vectors(v, f)).collect()
    assert all((r.ax + (r.abx + r.acx) / 3) * r.nx + (r.ay + (r.aby + r.acy) / 3) * r.ny + (r.az + (r.abz + r.acz) / 3) * r.nz > 0 for r in tri)
