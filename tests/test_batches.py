"""Whole meshes in batches: one narrow shuffle, equal meshes worked out once, chunks cut between meshes."""

import numpy as np
import pyarrow as pa
import pytest

from meshlark.operators import batches, isosurface, sdf
from meshlark.operators import mesh as M
from meshlark.plans import catalogue
from tests.test_mesh import FACES, tables

SMALL = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


@pytest.mark.parametrize("name,most", [("isosurface_cubes", 1), ("isosurface_meshes", 1), ("isosurface_zmax", 1), ("exact_field", 1), ("tessellated_field", 1), ("face_vectors", 2), ("edge_flag_bits", 1), ("jfa_field", 2), ("degenerate_filter", 4), ("seed_nearest", 2)])
def test_triangles_and_fields_are_not_dealt_again(spark, name, most):
    """Only vertices and faces are shuffled (and small sums after them): no triangles, fields or planes."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Exchange") <= most and "SortMergeJoin" not in plan


def test_tessellated_boxes_are_dealt_before_they_are_written_out(spark):
    """164 rows a mesh come from one that is shuffled, and are those of the two tables; no mesh is torn."""
    plan = QUERIES["tessellated_field"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")

    from meshlark.plans.derived import boxes, tessellated, tessellated_rows

    box = boxes(spark, SMALL)
    got, want = tessellated_rows(box, 3), batches.gathered(*tessellated(box, 3))
    assert got.schema.names == want.schema.names and got.count() == want.count() == 164 * box.count()
    assert got.exceptAll(want).isEmpty()
    for mesh in got.select("mesh_id").rdd.mapPartitions(lambda p: [[r.mesh_id for r in p]]).collect():
        assert mesh == sorted(mesh)


def rows(meshes):
    """Rows of ``gathered`` of boxes by half-extent, sorted by mesh."""
    from meshlark.plans.derived import CORNERS

    out = []
    for mesh, h in meshes:
        out += [(mesh, 1, i, *(float(c + 1) for c in f)) for i, f in enumerate(FACES, 1)]
        out += [(mesh, 0, i, *(h * s for s in c)) for i, c in enumerate(CORNERS, 1)]
    return pa.RecordBatch.from_arrays([*map(pa.array, zip(*out))], ["mesh_id", "part", "id", "p", "q", "r"])


@pytest.mark.parametrize("size", [1, 7, 20, 33, 1000])
def test_chunks_end_where_a_mesh_ends(monkeypatch, size):
    monkeypatch.setattr(batches, "ROWS", size)
    whole = rows([(m * 5, 0.1 + 0.05 * m) for m in range(9)])
    got = list(batches.triangle_chunks(whole.slice(i, 13) for i in range(0, whole.num_rows, 13)))
    assert [m for t in got for m in np.unique(t.mesh)] == [m * 5 for m in range(9)]
    assert all((np.bincount(t.mesh // 5)[t.mesh // 5] == 12).all() and t.tri.tolist() == list(range(1, 13)) * (len(t.tri) // 12) for t in got)


def test_equal_meshes_are_worked_out_once(monkeypatch):
    calls, real = [], sdf.exact_index
    monkeypatch.setattr(sdf, "exact_index", lambda *a, **k: calls.append(1) or real(*a, **k))
    monkeypatch.setattr(sdf, "_MEMO", batches.Memo())
    monkeypatch.setattr(isosurface, "_MEMO", batches.Memo())
    table = rows([(m, 0.3 + 0.1 * (m % 3)) for m in range(60)])
    got = pa.Table.from_batches(isosurface._surface_batches(12, 0.0, True, batches.triangle_chunks([table])))
    assert len(calls) == 3 and got.column("mesh_id").to_pylist() == list(range(60))
    v, f = isosurface.surface(sdf.signed_field(*((t := next(batches.triangle_chunks([rows([(1, 0.4)])]))).vectors, t.flags, t.tri), 12)[0].reshape(12, 12, 12).transpose(2, 1, 0), 0.0, True)
    assert np.allclose(got.column("vertices")[1].as_py(), v) and (np.array(got.column("faces")[1].as_py()) == f + 1).all()


def test_memo_is_bounded():
    memo = batches.Memo(1000)
    for k in range(50):
        assert memo((b"%d" % k,), lambda: (np.full(20, k),))[0][0] == k and memo.size <= 1000
    assert memo((b"large",), lambda: (np.zeros(500),))[0].shape == (500,) and (b"large",) not in memo.held


def test_missing_corners_and_far_ids(spark):
    """A face without some of its vertices has nulls for them, without any it goes; ids may be large."""
    v, f = tables(spark, [*FACES[:2], (0, 1, 90), (90, 91, 92)])
    big = 1 << 40
    v, f = v.selectExpr("mesh_id", f"vertex_id + {big} as vertex_id", "x", "y", "z"), f.selectExpr("mesh_id", "face_id", *(f"{c} + {big} as {c}" for c in "abc"))
    got = {r.face_id: r for r in M.face_vectors(v, f).collect()}
    assert sorted(got) == [1, 2, 3] and got[1].a == big + 1 and got[3].c is None and got[3].acx is None and got[3].abx == pytest.approx(1.22)
    assert {r.face_id: r.tri_id for r in M.triangles(v, f).collect()} == {1: 1, 2: 2}


@pytest.mark.parametrize("name", ["trilinear_lookup", "eikonal_subset", "near_surface_samples", "surface_samples"])
def test_samples_meet_no_written_out_field_or_weights(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and 1 <= plan.count("Exchange") <= 2


def test_lookup_beside_the_triangles_is_that_of_planes(spark):
    from meshlark.operators import sampling

    v, f = tables(spark, FACES)
    p = np.random.default_rng(5).uniform(-1, 1, (200, 3)).tolist() + [[-1.0, -1.0, -1.0], [1.0, 1.0, 1.0]]
    points = spark.createDataFrame([(1, i, *x) for i, x in enumerate(p)] + [(9, 1, 0.0, 0.0, 0.0)], "mesh_id long, sample_id long, x double, y double, z double")
    want = {r.sample_id: r.sd for r in sampling.plane_lookup(points, sdf.fields(M.triangles(v, f), 9), 9, ["mesh_id", "sample_id"]).collect()}
    got = sampling.field_lookup(v, f, points, 9).collect()
    assert len(got) == 202 and {r.sample_id: r.sd for r in got} == pytest.approx(want)


def test_draws_in_batches(spark):
    from meshlark.functions import expressions as X
    from meshlark.operators import sampling

    rows = [(m, s) for m in (0, 1, 77, 1200000, 1 << 31) for s in (1, 24, 131072)]
    want = [r[2] for r in X.with_uniforms(spark.createDataFrame(rows, "m long, s long"), "m", "s", {"u": 2}).collect()]
    assert sampling.uniforms(*np.array(rows).T, 2).tolist() == want
    weight = np.array([0.0, 2.0, 0.0, 1.0, 0.0])
    assert sampling.drawn(weight, np.array([0.0, 0.6, 2 / 3 + 1e-9, 1 - 2**-53, 1.0])).tolist() == [1, 1, 3, 3, 3]
    with pytest.raises(ValueError, match="area"), np.errstate(invalid="ignore"):
        sampling.drawn(np.zeros(3), np.array([0.5]))


@pytest.mark.parametrize("case", ["plain", "flipped", "two", "chain", "doubled"])
def test_cleaning_in_batches_is_that_of_tables(spark, monkeypatch, case):
    """Welding and orienting where a mesh's rows meet against the relational forms."""
    from meshlark.operators import cleaning
    from meshlark.plans.derived import CORNERS

    faces = [(a, c, b) if case == "flipped" and i in (2, 7, 11) else (a, b, c) for i, (a, b, c) in enumerate(FACES, 1)]
    points = [tuple(h * s for h, s in zip((0.61, 0.43, 0.37), c)) for c in CORNERS]
    if case == "two":
        faces, points = faces + [(a + 8, c + 8, b + 8) for a, b, c in FACES], points + [(x + 3, y, z) for x, y, z in points]
    if case == "doubled":
        faces = [*faces, (5, 6, 4), (0, 1, 1)]
    step = {"chain": 6e-8}.get(case, 0.0)
    seen, corner = {}, []
    for f in faces:
        for c in f:
            k = seen[c] = seen.get(c, -1) + 1
            corner.append((points[c][0] + k * step, *points[c][1:]))
    v, f = tables(spark, [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(len(faces))], corner)
    clusters, wound = M.weld(v, f, 1e-7, True)
    w = M.weld_components(v)
    means = M.weld_vertices(w)
    want = M.reorient(means, M.weld_faces(f, w, means).select("mesh_id", "new_id", "a", "b", "c").withColumnRenamed("new_id", "face_id"))
    rows = lambda t, *c: sorted(map(tuple, t.select(*c).collect()))
    assert rows(wound, "face_id", "component", "a", "b", "c", "flip") == rows(want, "face_id", "component", "a", "b", "c", "flip")
    got, have = (np.array(rows(t, "vertex_id", "root", "members", "x", "y", "z")) for t in (clusters, means))
    assert np.allclose(got, have, atol=1e-15, rtol=1e-14)
    monkeypatch.setattr(cleaning, "LARGE", 1)
    assert M.weld(v, f) is None
