"""The conditional distance model: layers, loss, gradient and training with numpy, applied by Arrow batches.

Weights are a dictionary of arrays; ``weight_table`` and ``from_table`` store them as rows. Per-mesh
parts (standardised parameters, modulation) are computed once a mesh, not per point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions.expressions import draw_key, hashed
from meshlark.operators.grid import check_resolution

LAYERS, SKIP, FIXED = 8, 5, ("B", "mu", "sigma")
Weights = dict[str, np.ndarray]


def glorot(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    bound = np.sqrt(6 / (rows + columns))
    return rng.uniform(-bound, bound, (rows, columns))


def initial(num_fourier: int = 256, fourier_scale: float = 24, hidden: int = 512, film: int = 256, size: int = 4, mean=None, std=None, seed: int = 0) -> Weights:
    """Fresh weights. Layers that read several inputs are drawn for the joint width, then split."""
    rng, encoded = np.random.default_rng(seed), 3 + 2 * num_fourier
    w = {"B": fourier_scale * rng.standard_normal((num_fourier, 3)), "mu": np.zeros(size) if mean is None else np.asarray(mean, float), "sigma": np.ones(size) if std is None else np.asarray(std, float)}
    for k in range(1, LAYERS + 1):
        width = {1: encoded + size, SKIP: hidden + encoded + size}.get(k, hidden)
        w[f"W{k}"], w[f"b{k}"] = glorot(rng, hidden, width), np.zeros(hidden)
    for k, (rows, columns) in enumerate(((film, size), (film, film), (2 * hidden * LAYERS, film)), 1):
        w[f"F{k}"], w[f"f{k}"] = glorot(rng, rows, columns), np.zeros(rows)
    w["Wo"], w["bo"] = glorot(rng, 1, hidden), np.zeros(1)
    return w


def swish(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def swish_slope(x: np.ndarray) -> np.ndarray:
    s = 1 / (1 + np.exp(-x))
    return s * (1 + x * (1 - s))


def swish_bend(x: np.ndarray) -> np.ndarray:
    s = 1 / (1 + np.exp(-x))
    return s * (1 - s) * (2 + x * (1 - 2 * s))


def standardised(w: Weights, p: np.ndarray) -> np.ndarray:
    return (p - w["mu"]) / np.where(w["sigma"] < np.finfo(np.float32).eps, 1, w["sigma"])


def fourier(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``[x, sin 2 pi B x, cos 2 pi B x]`` for points (N, 3)."""
    a = 2 * np.pi * (x @ b.T)
    return np.concatenate((x, np.sin(a), np.cos(a)), axis=1)


def linear_parts(w: np.ndarray, bias: np.ndarray, per_point: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """A linear layer over the joined inputs, with the parameters' share added once a mesh."""
    cut = w.shape[1] - len(p)
    return np.concatenate(per_point, axis=1) @ w[:, :cut].T + (w[:, cut:] @ p + bias)


def modulation(w: Weights, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale and shift of every layer, (layers, hidden) each."""
    h = swish(w["F1"] @ p + w["f1"])
    h = swish(w["F2"] @ h + w["f2"])
    out = (w["F3"] @ h + w["f3"]).reshape(LAYERS, 2, -1)
    return out[:, 0], out[:, 1]


def film(h: np.ndarray, gamma: np.ndarray, beta: np.ndarray, scale: float) -> np.ndarray:
    return h * (1 + scale * gamma) + scale * beta


def forward(w: Weights, x: np.ndarray, p: np.ndarray, scale: float = 0.2, keep: list | None = None) -> np.ndarray:
    """Distances (N,) at points (N, 3) of one mesh with raw parameters ``p``; ``keep`` gets what the
    backward pass needs."""
    q, e = standardised(w, p), fourier(w["B"], x)
    gamma, beta = modulation(w, q)
    a = None
    for k in range(1, LAYERS + 1):
        if k == 1:
            h = linear_parts(w["W1"], w["b1"], [e], q)
        elif k == SKIP:
            h = linear_parts(w[f"W{k}"], w[f"b{k}"], [a, e], q)
        else:
            h = a @ w[f"W{k}"].T + w[f"b{k}"]
        z = film(h, gamma[k - 1], beta[k - 1], scale)
        if keep is not None:
            keep.append((a, z))
        a = swish(z)
    if keep is not None:
        keep.append((a, e, q, gamma))
    return a @ w["Wo"][0] + w["bo"][0]


def gradient(w: Weights, x: np.ndarray, p: np.ndarray, scale: float = 0.2) -> np.ndarray:
    """Gradient of the distance by the point, (N, 3), by reverse accumulation."""
    keep: list = []
    forward(w, x, p, scale, keep)
    _, e, _, gamma = keep[-1]
    ga, ge = np.broadcast_to(w["Wo"][0], (len(x), w["Wo"].shape[1])), np.zeros_like(e)
    for k in range(LAYERS, 0, -1):
        gh = ga * swish_slope(keep[k - 1][1]) * (1 + scale * gamma[k - 1])
        back = gh @ w[f"W{k}"]
        hidden = w["Wo"].shape[1]
        if k == 1:
            ge += back[:, : e.shape[1]]
        elif k == SKIP:
            ga, ge = back[:, :hidden], ge + back[:, hidden : hidden + e.shape[1]]
        else:
            ga = back
    m = len(w["B"])
    sin, cos = e[:, 3 : 3 + m], e[:, 3 + m :]
    return ge[:, :3] + 2 * np.pi * ((ge[:, 3 : 3 + m] * cos - ge[:, 3 + m :] * sin) @ w["B"])


def clamped_l1(y: np.ndarray, z: np.ndarray, delta: float) -> float:
    return float(np.abs(np.clip(y, -delta, delta) - np.clip(z, -delta, delta)).mean())


def eikonal_penalty(g: np.ndarray) -> float:
    return float(((np.sqrt((g * g).sum(axis=1) + 1e-8) - 1) ** 2).mean()) if len(g) else 0.0


def weight_gradients(w: Weights, x: np.ndarray, p: np.ndarray, by_value: np.ndarray, along: np.ndarray, scale: float = 0.2) -> Weights:
    """Gradient by every trainable weight of ``sum(by_value * f(x)) + sum(along . grad f(x))``.

    The second sum is a directional derivative, so the forward pass carries tangents along ``along``
    beside the values and the backward pass goes through both; no second derivative is formed."""
    q, e = standardised(w, p), fourier(w["B"], x)
    gamma, beta = modulation(w, q)
    m, hidden = len(w["B"]), w["Wo"].shape[1]
    turn = 2 * np.pi * (along @ w["B"].T)
    de = np.concatenate((along, e[:, 3 + m :] * turn, -e[:, 3 : 3 + m] * turn), axis=1)
    layers, a, da = [], None, None
    for k in range(1, LAYERS + 1):
        inputs = [e] if k == 1 else [a, e] if k == SKIP else [a]
        tangents = [de] if k == 1 else [da, de] if k == SKIP else [da]
        inputs, tangents = np.concatenate(inputs, axis=1), np.concatenate(tangents, axis=1)
        h = linear_parts(w[f"W{k}"], w[f"b{k}"], [inputs], q if k in (1, SKIP) else q[:0])
        dh = tangents @ w[f"W{k}"][:, : inputs.shape[1]].T
        z, dz = film(h, gamma[k - 1], beta[k - 1], scale), dh * (1 + scale * gamma[k - 1])
        a, da = swish(z), swish_slope(z) * dz
        layers.append((inputs, tangents, h, dh, z, dz))
    g: Weights = {"Wo": (by_value @ a + da.sum(axis=0))[None], "bo": np.array([by_value.sum()])}
    ga, gda = by_value[:, None] * w["Wo"][0], np.broadcast_to(w["Wo"][0], a.shape)
    gmod = np.zeros((LAYERS, 2, hidden))
    for k in range(LAYERS, 0, -1):
        inputs, tangents, h, dh, z, dz = layers[k - 1]
        gz, gdz = ga * swish_slope(z) + gda * swish_bend(z) * dz, gda * swish_slope(z)
        gmod[k - 1] = scale * (gz * h + gdz * dh).sum(axis=0), scale * gz.sum(axis=0)
        gh, gdh = (v * (1 + scale * gamma[k - 1]) for v in (gz, gdz))
        parts = [gh.T @ inputs + gdh.T @ tangents] + [np.outer(gh.sum(axis=0), q)] * (k in (1, SKIP))
        g[f"W{k}"], g[f"b{k}"] = np.concatenate(parts, axis=1), gh.sum(axis=0)
        if k > 1:
            ga, gda = gh @ w[f"W{k}"][:, :hidden], gdh @ w[f"W{k}"][:, :hidden]
    s1 = w["F1"] @ q + w["f1"]
    h1 = swish(s1)
    s2 = w["F2"] @ h1 + w["f2"]
    g3 = gmod.ravel()
    g2 = (w["F3"].T @ g3) * swish_slope(s2)
    g1 = (w["F2"].T @ g2) * swish_slope(s1)
    for k, (gk, i) in enumerate(((g1, q), (g2, h1), (g3, swish(s2))), 1):
        g[f"F{k}"], g[f"f{k}"] = np.outer(gk, i), gk
    return g


def parameter_gradients(w: Weights, x: np.ndarray, p: np.ndarray, y: np.ndarray, delta: float, scale: float = 0.2, free: np.ndarray | None = None, weight: float = 0.0) -> tuple[float, Weights]:
    """Composite loss of one mesh and its gradient by every trainable weight: the clamped mean distance
    over points ``x`` with distances ``y``, and ``weight`` times the penalty on the gradient's length at
    the points ``free``."""
    free = np.zeros((0, 3)) if free is None else free
    out = forward(w, x, p, scale)
    diff = np.clip(out, -delta, delta) - np.clip(y, -delta, delta)
    by_value, along = np.sign(diff) * (np.abs(out) <= delta) / max(1, len(x)), np.zeros((0, 3))
    loss = float(np.abs(diff).mean()) if len(x) else 0.0
    if len(free):
        g = gradient(w, free, p, scale)
        size = np.sqrt((g * g).sum(axis=1, keepdims=True) + 1e-8)
        along = weight * 2 * (size - 1) / size * g / len(free)
        loss += weight * eikonal_penalty(g)
    at = np.concatenate((x, free))
    return loss, weight_gradients(w, at, p, np.concatenate((by_value, np.zeros(len(free)))), np.concatenate((np.zeros_like(x), along)), scale)


class AdamW:
    """Decoupled weight decay on top of Adam; one state a weight."""

    def __init__(self, rate: float = 1e-3, decay: float = 1e-4, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.rate, self.decay, self.betas, self.eps, self.t = rate, decay, betas, eps, 0
        self.m: Weights = {}
        self.v: Weights = {}

    def step(self, w: Weights, g: Weights) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] = self.betas[0] * self.m.get(k, 0) + (1 - self.betas[0]) * x
            self.v[k] = self.betas[1] * self.v.get(k, 0) + (1 - self.betas[1]) * x * x
            m, v = self.m[k] / (1 - self.betas[0] ** self.t), self.v[k] / (1 - self.betas[1] ** self.t)
            w[k] = w[k] - self.rate * (m / (np.sqrt(v) + self.eps) + self.decay * w[k])


def train(
    w: Weights, samples, parameters: dict[int, np.ndarray], delta: float, epochs: int = 1, rate: float = 1e-3, scale: float = 0.2,
    weight: float = 0.1, validation: DataFrame | None = None, on_best=None,
) -> list[dict]:
    """Epochs over ``samples(mesh_id, x, y, z, sd[, free])``, or over what ``samples(epoch)`` returns,
    a step a mesh; rows with ``free`` also bear the penalty on the gradient's length, ``weight`` times.

    Meshes come to the driver, where the optimiser runs, one partition ahead and in an order of their
    own each epoch. After each epoch, and before the first, the mean loss over ``validation`` is taken
    on the executors; ``on_best(w, epoch)`` is called when it is strictly the best so far. ``w`` ends
    as it is best on validation (without any, as the last epoch leaves it). Returns ``epoch, loss,
    validation, best`` for each."""
    optimiser, log = AdamW(rate), []
    held, best = {k: v.copy() for k, v in w.items()}, None

    def judged(epoch: int, loss: float | None) -> None:
        nonlocal best, held
        value = None if validation is None else dataset_loss(validation, parameters, w, delta, scale)
        better = value is not None and (best is None or value < best)
        if better:
            best, held = value, {k: v.copy() for k, v in w.items()}
            if on_best:
                on_best(w, epoch)
        log.append({"epoch": epoch, "loss": loss, "validation": value, "best": better})

    judged(0, None)
    for epoch in range(1, epochs + 1):
        now = samples(epoch) if callable(samples) else samples
        now = now if "free" in now.columns else now.withColumn("free", F.lit(False))
        rows = now.groupBy("mesh_id").agg(F.collect_list(F.array("x", "y", "z", "sd", F.col("free").cast("double"))).alias("s"))
        seen = []
        for r in hashed(rows, {"turn": draw_key("mesh_id", str(epoch), 1)}).orderBy("turn", "mesh_id").toLocalIterator(prefetchPartitions=True):
            s = np.array(r["s"])
            loss, g = parameter_gradients(w, s[:, :3], parameters[r["mesh_id"]], s[:, 3], delta, scale, s[s[:, 4] > 0, :3], weight)
            optimiser.step(w, g)
            seen.append(loss)
        judged(epoch, float(np.mean(seen)))
    if best is not None:
        w.update(held)
    return log


def dataset_loss(samples: DataFrame, parameters: dict[int, np.ndarray], w: Weights, delta: float, scale: float = 0.2) -> float | None:
    """Mean over meshes of the mean clamped distance between ``sd`` and the prediction; None without rows."""
    found = losses(samples, parameters, w, delta, scale).agg(F.avg("loss")).first()
    return found[0]


def losses(samples: DataFrame, parameters: dict[int, np.ndarray], w: Weights, delta: float, scale: float = 0.2) -> DataFrame:
    """``mesh_id, loss``: the mean clamped distance of each mesh. Predictions stay on the executors."""
    p = samples.sparkSession.createDataFrame([(int(k), [float(x) for x in v]) for k, v in parameters.items()], "mesh_id long, p array<double>")
    met = predict(samples.select("mesh_id", "x", "y", "z", "sd").join(p, "mesh_id"), w, scale)
    clip = lambda c: F.greatest(F.lit(-delta), F.least(F.lit(delta), F.col(c)))
    return met.groupBy("mesh_id").agg(F.avg(F.abs(clip("sd") - clip("pred"))).alias("loss"))


def infer(parameters: DataFrame, w: Weights, n: int, slab: int = 8, scale: float = 0.2) -> DataFrame:
    """``mesh_id, iz, sdf, tri``: fields that the model predicts for ``parameters(mesh_id, p)``, planes
    as in ``sdf.fields``. A row a slab of ``slab`` planes is all that is shuffled; its points are made
    where they are used, some thousands at a time."""
    check_resolution(n)
    if n % slab:
        raise ValueError("slabs must divide the resolution")
    spark = parameters.sparkSession
    shared, x = spark.sparkContext.broadcast(w), -1 + np.arange(n) * (2 / (n - 1))
    some = 8192

    def run(frames):
        for f in frames:
            for mesh, p, first in zip(f["mesh_id"], f["p"], f["first"]):
                p = np.asarray(p, float)
                for k in range(first, first + slab):
                    plane = np.stack((np.tile(x, n), np.repeat(x, n), np.full(n * n, x[k])), axis=1)
                    value = np.concatenate([forward(shared.value, plane[i : i + some], p, scale) for i in range(0, n * n, some)])
                    yield pd.DataFrame({"mesh_id": [mesh], "iz": [k + 1], "sdf": [value], "tri": [np.zeros(0, np.int32)]})

    rows = parameters.select(F.col("mesh_id").cast("long"), "p", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(slab))).alias("first"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mesh_id", "first")
    return rows.mapInPandas(run, "mesh_id long, iz int, sdf array<double>, tri array<int>")


def predict(points: DataFrame, w: Weights, scale: float = 0.2, with_gradient: bool = False) -> DataFrame:
    """``pred`` (and ``gx, gy, gz``) for ``points(mesh_id, ..., x, y, z, p)``; weights are broadcast."""
    shared = points.sparkSession.sparkContext.broadcast(w)
    extra = ["pred"] + ["gx", "gy", "gz"] * with_gradient
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + "".join(f", {c} double" for c in extra)

    def run(frames):
        for f in frames:
            f = f.reset_index(drop=True)
            out = np.zeros((len(f), len(extra)))
            for _, at in f.groupby("mesh_id", dropna=False).indices.items():
                x, p = f.loc[at, ["x", "y", "z"]].to_numpy(float), np.asarray(f["p"].iloc[at[0]], float)
                out[at, 0] = forward(shared.value, x, p, scale)
                if with_gradient:
                    out[at, 1:] = gradient(shared.value, x, p, scale)
            yield pd.concat([f, pd.DataFrame(out, columns=extra)], axis=1)

    return points.mapInPandas(run, schema)


def weight_table(spark: SparkSession, w: Weights) -> DataFrame:
    """``name, shape, data, trainable``: the fixed parts (encoding, standardisation) are never trained,
    which is all that a training or test mode would change in this model."""
    rows = [(k, list(v.shape), v.ravel().astype(float).tolist(), k not in FIXED) for k, v in w.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, data array<double>, trainable boolean")


def from_table(table: DataFrame) -> Weights:
    return {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in table.collect()}


def save_checkpoint(spark: SparkSession, w: Weights, path: str, epoch: int) -> str:
    """Write the new folder first, then remove older ones."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = f"{path.rstrip('/')}/epoch={epoch}"
    weight_table(spark, w).coalesce(1).write.mode("overwrite").parquet(new)
    for s in fs.listStatus(root):
        if s.getPath().getName() != f"epoch={epoch}":
            fs.delete(s.getPath(), True)
    return new
