import numpy as np
import pytest

from meshlark.operators import grid, sampling
from meshlark.sources import meshes, sinks
from tests.test_mesh import FACES, tables


def test_stl_round_trip_and_folders(spark, tmp_path):
    c = np.arange(18, dtype=float).reshape(2, 3, 3)
    for k in (3, 12):
        (tmp_path / f"run_id{k}").mkdir()
        (tmp_path / f"run_id{k}" / "Body_6.stl").write_bytes(meshes.encode_stl(c + k))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.stl").write_bytes(meshes.encode_stl(c))
    got = meshes.read_stl(spark, str(tmp_path), r"run_id\d*").toPandas()
    assert sorted(set(got["mesh_id"])) == [3, 12] and len(got) == 12
    assert got[got.mesh_id == 3].sort_values("vertex_id")[["x", "y", "z"]].to_numpy().tolist() == (c + 3).reshape(-1, 3).tolist()


def test_text_stl_and_errors():
    text = b"solid a\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1.5e0 0 0\nvertex 0 -1 .5\nendloop\nendfacet\nendsolid a\n"
    assert meshes.decode_stl(text).tolist() == [[[0, 0, 0], [1.5, 0, 0], [0, -1, 0.5]]]
    assert meshes.decode_stl(b"solid empty\nendsolid").shape == (0, 3, 3)
    with pytest.raises(ValueError):
        meshes.decode_stl(b"nothing")


def test_stl_edge_cases():
    """Binary files with bytes after the facets and text-like headers, and numbers of any length."""
    c = np.arange(18, dtype=float).reshape(2, 3, 3)
    data = meshes.encode_stl(c)
    for header in (b"\0" * 80, b"solid part".ljust(80), b"  solid \n".ljust(80)):
        for rest in (b"", b"xyz" * 30):
            assert meshes.decode_stl(header + data[80:] + rest).tolist() == c.tolist()
    long = "0." + "1234567890" * 5 + "e+0000000000001"
    assert meshes.decode_stl(f"solid\nvertex {long} 0 0\nvertex 1 0 0\nvertex 0 1 0\nendsolid".encode())[0, 0, 0] == float(long)
    with pytest.raises(ValueError):
        meshes.decode_stl(data[:-1])
    with pytest.raises(ValueError, match="three"):
        meshes.decode_stl(b"solid\nvertex 0 0 0\nendsolid")


def test_last_folder_counts_and_spare_rows_warn(spark, tmp_path):
    for k, name in enumerate(("Run_id7", "run_id07", "run_id7b")):
        (tmp_path / "m" / name).mkdir(parents=True)
        (tmp_path / "m" / name / "b.stl").write_bytes(meshes.encode_stl(np.full((1, 3, 3), float(k))))
    (tmp_path / "t.csv").write_text("7,1,2,3,4\n8,1,2,3,4\n")
    with pytest.warns(UserWarning, match="1 rows"):
        facets, params = meshes.read_batch(spark, str(tmp_path / "t.csv"), str(tmp_path / "m"), r"run_id\d*")
    assert {(r.mesh_id, r.x) for r in facets.collect()} == {(7, 1.0)} and params.count() == 2


def test_sampler_dataset_round_trip(spark, tmp_path):
    """Raw meshes to a stored dataset and back, samples from it, and the held-out part beside it."""
    vertices, faces = tables(spark, FACES)
    p = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "mesh_id long, p array<double>")
    made = sampling.mesh_samplers(vertices, faces, p, 8)
    path = str(tmp_path / "set")
    sinks.write_dataset(made, path)
    back = meshes.read_dataset(spark, path)
    assert set(back) == set(made) and all(back[k].count() == made[k].count() for k in made)
    (row,) = back["samplers"].collect()
    assert row.resolution == 8 and row.p == [1, 2, 3, 4] and row.bbox_max == pytest.approx([-v for v in row.bbox_min])
    n = sampling.SamplingParameters(samples=400, resolution=8)
    got = sampling.mesh_samples(back["triangles"], back["planes"], n).toPandas().sort_values("sample_id")
    assert got["sample_id"].tolist() == list(range(1, 401)) and (got.loc[got.stratum == "surface", "sd"] == 0).all()
    assert got["stratum"].value_counts().to_dict() == {"surface": 80, "band": 280, "volume": 40} and got[["x", "y", "z"]].abs().to_numpy().max() <= 1
    sinks.write_split(back["samplers"].selectExpr("*", "'test' as split").union(back["samplers"].selectExpr("*", "'train' as split")), path)
    assert spark.read.parquet(path + "_test").count() == 1
    with pytest.raises(ValueError):
        sampling.mesh_samplers(vertices, faces, p, 2000)


def test_parameter_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0,1.5,2,3,4\nrun_id1 , 5,6,7,8e1\n")
    (tmp_path / "b.txt").write_text("  0   1 2  3 4\n\n coldplate_inst7 1 2 3 4 \n")
    rows = {r.mesh_id: list(r.p) for r in meshes.read_parameters(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {0: [1.5, 2, 3, 4], 1: [5, 6, 7, 80]}
    assert {r.mesh_id for r in meshes.read_parameters(spark, str(tmp_path / "b.txt"), None).collect()} == {0, 7}
    (tmp_path / "c.csv").write_text("1,2,3\n")
    with pytest.raises(Exception, match="expected 5 fields"):
        meshes.read_parameters(spark, str(tmp_path / "c.csv")).collect()


def test_missing_parameters_raise(spark, tmp_path):
    (tmp_path / "m" / "run_id5").mkdir(parents=True)
    (tmp_path / "m" / "run_id5" / "b.stl").write_bytes(meshes.encode_stl(np.zeros((1, 3, 3))))
    (tmp_path / "t.csv").write_text("4,1,2,3,4\n")
    with pytest.raises(ValueError, match="5"):
        meshes.read_batch(spark, str(tmp_path / "t.csv"), str(tmp_path / "m"), r"run_id\d*")


def test_obj(spark):
    rows = spark.createDataFrame([(1, [[0.0, 0.0, 1.0]], [[1, 1, 1]])], "mesh_id long, vertices array<array<double>>, faces array<array<int>>")
    assert sinks.obj_text(rows).first().obj == "v 0.0 0.0 1.0\nf 1 1 1"


def test_grid_bounds(spark):
    with pytest.raises(IndexError):
        grid.grid_points(spark, 8, 0, 3)
    with pytest.raises(ValueError):
        grid.slab_ranges(spark, 8, 3)
    with pytest.raises(ValueError):
        grid.grid_points(spark, 8, slab=3)
    assert grid.grid_points(spark, 8, slab=2).rdd.getNumPartitions() == 4
    assert sorted(r.linear for k in range(1, 5) for r in grid.slab_points(spark, 8, 2, k).collect()) == list(range(1, 513))
