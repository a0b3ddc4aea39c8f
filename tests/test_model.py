import numpy as np
import pytest

from meshlark.operators import isosurface, model, sdf

W = model.initial(num_fourier=6, fourier_scale=1.0, hidden=12, film=7, mean=[1, 2, 3, 4], std=[1, 0, 2, 1], seed=5)
RNG = np.random.default_rng(2)
XS, P = RNG.uniform(-1, 1, (9, 3)), np.array([0.5, 2.5, 1.0, 3.0])


def test_gradient_by_finite_differences():
    g, h = model.gradient(W, XS, P), 1e-6
    for k in range(3):
        step = np.eye(3)[k] * h
        assert (model.forward(W, XS + step, P) - model.forward(W, XS - step, P)) / (2 * h) == pytest.approx(g[:, k], rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("weight", [0.0, 0.7])
def test_weight_gradients_by_finite_differences(weight):
    """Of the distance term alone and with the penalty on the gradient's length."""
    y, free = model.forward(W, XS, P) + RNG.choice([-0.3, 0.3], 9), RNG.uniform(-1, 1, (5, 3))
    loss, g = model.parameter_gradients(W, XS, P, y, 10.0, free=free, weight=weight)
    assert loss == pytest.approx(0.3 + weight * model.eikonal_penalty(model.gradient(W, free, P)))
    assert set(g) == set(W) - set(model.FIXED)
    for name in g:
        at = tuple(n // 2 for n in W[name].shape)
        w = {k: v.copy() for k, v in W.items()}
        w[name][at] += 1e-6
        up = model.parameter_gradients(w, XS, P, y, 10.0, free=free, weight=weight)[0]
        w[name][at] -= 2e-6
        assert (up - model.parameter_gradients(w, XS, P, y, 10.0, free=free, weight=weight)[0]) / 2e-6 == pytest.approx(g[name][at], rel=1e-3, abs=1e-6)


def test_zero_deviation_counts_as_one():
    assert model.standardised(W, P).tolist() == [-0.5, 0.5, -1.0, -1.0]


def test_training_lowers_the_loss_and_keeps_the_best(spark, tmp_path):
    w = {k: v.copy() for k, v in W.items()}
    rows = [(m, *map(float, x), float(np.linalg.norm(x) - 0.5), i % 4 == 0) for m in (1, 2, 3) for i, x in enumerate(RNG.uniform(-1, 1, (40, 3)))]
    samples = spark.createDataFrame(rows, "mesh_id long, x double, y double, z double, sd double, free boolean").cache()
    parameters, path = {1: P, 2: P + 1, 3: P + 0.5}, str(tmp_path)
    held = samples.where("mesh_id = 3")
    log = model.train(w, lambda epoch: samples.where("mesh_id < 3"), parameters, 2.0, epochs=12, rate=5e-3, validation=held, on_best=lambda w, k: model.save_checkpoint(spark, w, path, k))
    assert log[-1]["loss"] < 0.8 * log[1]["loss"] and len(log) == 13
    values = [r["validation"] for r in log]
    assert [r["best"] for r in log] == [all(v < u for u in values[:k]) for k, v in enumerate(values)]
    kept = max(r["epoch"] for r in log if r["best"])
    assert [x.name for x in tmp_path.iterdir()] == [f"epoch={kept}"]
    back = model.from_table(spark.read.parquet(f"{path}/epoch={kept}"))
    assert all(np.allclose(back[k], w[k]) for k in w)
    assert model.dataset_loss(held, parameters, back, 2.0) == pytest.approx(min(values))
    x, y = np.array([r[1:4] for r in rows if r[0] == 3]), np.array([r[4] for r in rows if r[0] == 3])
    assert min(values) == pytest.approx(model.clamped_l1(y, model.forward(back, x, parameters[3]), 2.0))


def test_inference_by_slabs_and_its_surface(spark):
    n, meshes = 8, spark.createDataFrame([(1, P.tolist()), (2, (P + 1).tolist())], "mesh_id long, p array<double>")
    got = model.infer(meshes, W, n, slab=2).collect()
    assert len(got) == 2 * n
    x = sdf.nodes(n)
    for r in got:
        want = model.forward(W, x[:, :, r.iz - 1].transpose(1, 0, 2).reshape(-1, 3), P + r.mesh_id - 1)
        assert np.asarray(r.sdf) == pytest.approx(want)
    level = float(np.median([v for r in got for v in r.sdf]))
    assert isosurface.isosurfaces(model.infer(meshes, W, n, slab=4), n, level).where("size(faces) > 0").count() == 2
    with pytest.raises(ValueError):
        model.infer(meshes, W, n, slab=3)


def test_prediction_matches_the_driver(spark):
    rows = spark.createDataFrame([(1, i, *map(float, x), P.tolist()) for i, x in enumerate(XS)], "mesh_id long, i long, x double, y double, z double, p array<double>")
    got = model.predict(rows, W, with_gradient=True).orderBy("i").toPandas()
    assert got["pred"].to_numpy() == pytest.approx(model.forward(W, XS, P))
    assert got[["gx", "gy", "gz"]].to_numpy() == pytest.approx(model.gradient(W, XS, P))
