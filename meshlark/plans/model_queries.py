"""Layers of the distance model over ``embeddings``, with small integer-formula weights.

Components 1 to 3 of a vector are a point and 1 to 4 shape parameters; these queries read no others.
The evaluation takes the label as the mesh, with parameters made of it; the inference a mesh a
supplier.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meshlark.functions.expressions import coordinate, tidy
from meshlark.operators import model

# Small weights by formula, the same in both engines.
B = np.array([[0.25, 0.5, -0.25], [0.125, -0.5, 0.75]])
WX = np.array([[((3 * i + 5 * j) % 7 - 3) / 8 for j in range(7)] for i in range(3)])
WP = np.array([[((2 * i + 3 * j) % 5 - 2) / 4 for j in range(4)] for i in range(3)])
WH = np.array([[((i + 4 * j) % 5 - 2) / 4 for j in range(3)] for i in range(3)])
BIAS = np.array([0.5, -0.25, 0.125])
SCALE, DELTA = 0.2, 0.1


def _rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("p"))


def _layer(rows, size, f):
    """Apply ``f(points (N, 3), parameters (N, 4)) -> (N, size)`` to Arrow batches."""
    columns = [f"o{i + 1}" for i in range(size)]

    def run(frames):
        for frame in frames:
            p = np.stack(frame["p"].to_numpy()) if len(frame) else np.zeros((0, 4))
            yield pd.concat([frame[["vec_id"]].reset_index(drop=True), pd.DataFrame(f(p[:, :3], p), columns=columns)], axis=1)

    got = rows.select("vec_id", "p").mapInPandas(run, "vec_id long, " + ", ".join(f"{c} double" for c in columns))
    return got.selectExpr("vec_id", *(f"{tidy(c)} as {c}" for c in columns))


def fourier_features(spark, sf_dir):
    return _layer(_rows(spark, sf_dir), 7, lambda x, p: model.fourier(B, x))


def linear_xp(spark, sf_dir):
    return _layer(_rows(spark, sf_dir), 3, lambda x, p: model.fourier(B, x) @ WX.T + p @ WP.T + BIAS)


def linear_hxp(spark, sf_dir):
    def f(x, p):
        h = model.fourier(B, x) @ WX.T + p @ WP.T + BIAS
        return h @ WH.T + model.fourier(B, x) @ WX.T + p @ WP.T + BIAS

    return _layer(_rows(spark, sf_dir), 3, f)


def film_block(spark, sf_dir):
    return _layer(_rows(spark, sf_dir), 3, lambda x, p: model.swish(model.film(x, p[:, :3] @ WH.T, p @ WP.T, SCALE)))


def small_weights(seed: int = 3) -> model.Weights:
    """A network of all layers, narrow enough for its SQL."""
    return model.initial(num_fourier=2, fourier_scale=0.5, hidden=4, film=3, seed=seed, mean=[0.1, 0, 0, -0.1], std=[1, 0.5, 2, 1])


def _predicted(spark, sf_dir, with_gradient=False):
    rows = _rows(spark, sf_dir).selectExpr("vec_id", "vec_id as mesh_id", "p", "p[0] as x", "p[1] as y", "p[2] as z")
    return model.predict(rows, small_weights(), with_gradient=with_gradient)


def sdf_forward_small(spark, sf_dir):
    return _predicted(spark, sf_dir).selectExpr("vec_id", f"{tidy('pred')} as pred")


def eikonal_loss(spark, sf_dir):
    """Mean penalty of the gradient's length, by label."""
    got = _predicted(spark, sf_dir, True).join(_rows(spark, sf_dir).select("vec_id", "label"), "vec_id")
    pen = "pow(sqrt(gx*gx + gy*gy + gz*gz + 1e-8) - 1, 2)"
    return got.groupBy("label").agg(F.avg(F.expr(pen)).alias("loss")).selectExpr("cast(label as bigint) as label", f"{tidy('loss')} as loss")


def _label_parameters(labels) -> dict:
    return {k: np.array([k * 0.25, 1 - k * 0.125, 0.5, k % 3]) for k in labels}


def evaluation_loss(spark, sf_dir):
    """Evaluation on samples: the clamped error of each mesh and the mean over meshes. A vector's
    first components are a point and the fourth its distance; labels are few."""
    rows = _rows(spark, sf_dir).where("label is not null").selectExpr("cast(label as bigint) as mesh_id", "p[0] as x", "p[1] as y", "p[2] as z", "p[3] as sd")
    parameters = _label_parameters(r[0] for r in rows.select("mesh_id").distinct().collect())
    got = model.losses(rows, parameters, small_weights(), DELTA)
    both = got.unionByName(got.agg(F.lit(-1).cast("long").alias("mesh_id"), F.avg("loss").alias("loss")))
    return both.selectExpr("mesh_id", f"{tidy('loss')} as loss")


PLANES, SLAB = 8, 2


def inferred_planes(spark, sf_dir):
    """Slab-wise inference of a field for every supplier."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    p = s.select(F.col("s_suppkey").alias("mesh_id"), F.expr("array(s_nationkey / 10e0, (s_suppkey % 7) / 4e0, 0.5e0, (s_suppkey % 3) / 2e0)").alias("p"))
    got = model.infer(p, small_weights(), PLANES, SLAB)
    return got.selectExpr("mesh_id", "cast(iz as bigint) as iz", "aggregate(sdf, 0e0, (a, v) -> a + v) as total").selectExpr("mesh_id", "iz", f"{tidy('total')} as total")


QUERIES = {f.__name__: f for f in (fourier_features, linear_xp, linear_hxp, film_block, sdf_forward_small, eikonal_loss, evaluation_loss, inferred_planes)}


def _sum(row, names) -> str:
    return " + ".join(f"({w!r}::double * {c})" for w, c in zip(row.tolist(), names))


def _network(source: str, with_gradient: bool = False) -> str:
    """CTEs for ``small_weights`` over ``source(x0, x1, x2, p0..p3, ...)``; the last, ``net``, has
    ``pred`` and, by tangents along each axis, ``g0, g1, g2``. A layer is a CTE."""
    w = small_weights()
    hidden, m, size = w["Wo"].shape[1], len(w["B"]), len(w["mu"])
    ways = range(3) if with_gradient else ()
    lin = lambda row, names: " + ".join(f"({float(c)!r}::double) * {v}" for c, v in zip(row, names)) or "0e0"
    act = lambda z: f"({z}) / (1 + exp(-({z})))"
    q, turns = [f"q{j}" for j in range(size)], [f"turn{i}" for i in range(m)]
    out = [f"net0 as (select *, {', '.join(f'(p{j} - ({float(w['mu'][j])!r}::double)) / ({float(w['sigma'][j])!r}::double) as q{j}' for j in range(size))}, {', '.join(f'2e0 * pi() * ({lin(w['B'][i], ['x0', 'x1', 'x2'])}) as turn{i}' for i in range(m))} from {source})"]
    e = ["x0", "x1", "x2"] + [f"sin({v})" for v in turns] + [f"cos({v})" for v in turns]
    de = {d: [f"{float(j == d)!r}" for j in range(3)] + [f"cos({v}) * 2e0 * pi() * ({float(w['B'][i, d])!r}::double)" for i, v in enumerate(turns)] + [f"-sin({v}) * 2e0 * pi() * ({float(w['B'][i, d])!r}::double)" for i, v in enumerate(turns)] for d in ways}
    tables = {"e": e, **{f"t{d}": v for d, v in de.items()}}
    out.append("net1 as (select *, " + ", ".join(f"{v} as {t}_{j}" for t, vs in tables.items() for j, v in enumerate(vs)) + " from net0)")
    enc = {t: [f"{t}_{j}" for j in range(len(e))] for t in tables}
    for k, (names, to) in enumerate(((q, "f1_"), ([f"f1_{i}" for i in range(len(w["F1"]))], "f2_")), 1):
        out.append(f"net{k + 1} as (select *, {', '.join(f'{act(lin(w[f'F{k}'][i], names) + f' + ({float(w[f"f{k}"][i])!r}::double)')} as {to}{i}' for i in range(len(w[f'F{k}'])))} from net{k})")
    last = [f"f2_{i}" for i in range(len(w["F2"]))]
    out.append(f"lay0 as (select *, {', '.join(f'{lin(w['F3'][i], last)} + ({float(w['f3'][i])!r}::double) as m{i}' for i in range(len(w['F3'])))} from net3)")
    for k in range(1, model.LAYERS + 1):
        before = {t: [f"{'a' if t == 'e' else 'd' + t[1:]}{k - 1}_{i}" for i in range(hidden)] for t in tables}
        inputs = {t: enc[t] if k == 1 else before[t] + enc[t] if k == model.SKIP else before[t] for t in tables}
        extra = q if k in (1, model.SKIP) else []
        matrix, cols, gain = w[f"W{k}"], [], lambda i: f"(1 + {SCALE} * m{(k - 1) * 2 * hidden + i})"  # noqa: B023
        for i in range(hidden):
            n = len(inputs["e"])
            cols.append(f"({lin(matrix[i, :n], inputs['e'])} + {lin(matrix[i, n:], extra)} + ({float(w[f'b{k}'][i])!r}::double)) * {gain(i)} + {SCALE} * m{(k - 1) * 2 * hidden + hidden + i} as z{k}_{i}")
            cols += [f"({lin(matrix[i, :n], inputs[f't{d}'])}) * {gain(i)} as y{d}{k}_{i}" for d in ways]
        out.append(f"pre{k} as (select *, {', '.join(cols)} from lay{k - 1})")
        s = lambda i: f"(1 / (1 + exp(-z{k}_{i})))"  # noqa: B023, E731
        cols = [f"z{k}_{i} * {s(i)} as a{k}_{i}" for i in range(hidden)] + [f"y{d}{k}_{i} * {s(i)} * (1 + z{k}_{i} * (1 - {s(i)})) as d{d}{k}_{i}" for d in ways for i in range(hidden)]
        out.append(f"lay{k} as (select *, {', '.join(cols)} from pre{k})")
    ends = [f"{lin(w['Wo'][0], [f'a{model.LAYERS}_{i}' for i in range(hidden)])} + ({float(w['bo'][0])!r}::double) as pred"]
    ends += [f"{lin(w['Wo'][0], [f'd{d}{model.LAYERS}_{i}' for i in range(hidden)])} as g{d}" for d in ways]
    out.append(f"net as (select *, {', '.join(ends)} from lay{model.LAYERS})")
    return ", ".join(out)


_P = [f"p{j}" for j in range(4)]
_POINT = f"pts as (select vec_id, label, {', '.join(f'embedding[{j + 1}]::double as x{j}' for j in range(3))}, {', '.join(f'embedding[{j + 1}]::double as p{j}' for j in range(4))} from embeddings where embedding is not null)"
_BY_LABEL = f"pts as (select label::bigint as mesh_id, {', '.join(f'embedding[{j + 1}]::double as x{j}' for j in range(3))}, embedding[4]::double as sd, label * 0.25e0 as p0, 1 - label * 0.125e0 as p1, 0.5e0 as p2, (label % 3)::double as p3 from embeddings where embedding is not null and label is not null)"
_CLIP = lambda c: f"greatest(-{DELTA}e0, least({DELTA}e0, {c}))"
_CUBE = f"pts as (select s_suppkey as mesh_id, iz, {', '.join(f'{coordinate(i, PLANES)} as x{j}' for j, i in enumerate(('ix', 'iy', 'iz')))}, s_nationkey / 10e0 as p0, (s_suppkey % 7) / 4e0 as p1, 0.5e0 as p2, (s_suppkey % 3) / 2e0 as p3 from supplier, range(1, {PLANES + 1}) a(ix), range(1, {PLANES + 1}) b(iy), range(1, {PLANES + 1}) c(iz))"
_BASE = f"base as (select vec_id, {', '.join(f'embedding[{j + 1}]::double as p{j}' for j in range(4))} from embeddings where embedding is not null)"
_ENC = "enc as (select *, p0 as e0, p1 as e1, p2 as e2, " + ", ".join(f"{f}(2e0 * pi() * ({_sum(B[i], _P)})) as e{3 + i + 2 * k}" for k, f in enumerate(("sin", "cos")) for i in range(2)) + " from base)"
_E = [f"e{j}" for j in range(7)]
_XP = [f"({_sum(WX[i], _E)} + {_sum(WP[i], _P)} + {float(BIAS[i])!r}::double)" for i in range(3)]
_OUT = lambda cols: ", ".join(f"round({c}, 6) + 0e0 as o{i}" for i, c in enumerate(cols, 1))
_Z = [f"({_P[i]} * (1 + {SCALE} * ({_sum(WH[i], _P)})) + {SCALE} * ({_sum(WP[i], _P)}))" for i in range(3)]
ORACLES = {
    "fourier_features": f"with {_BASE}, {_ENC} select vec_id, {_OUT(_E)} from enc",
    "linear_xp": f"with {_BASE}, {_ENC} select vec_id, {_OUT(_XP)} from enc",
    "linear_hxp": f"with {_BASE}, {_ENC}, h as (select *, {', '.join(f'{x} as h{i}' for i, x in enumerate(_XP))} from enc) select vec_id, {_OUT([f'{_sum(WH[i], ['h0', 'h1', 'h2'])} + {_XP[i]}' for i in range(3)])} from h",
    "sdf_forward_small": f"with {_POINT}, {_network('pts')} select vec_id, round(pred, 6) + 0e0 as pred from net",
    "eikonal_loss": f"with {_POINT}, {_network('pts', True)} select label::bigint as label, round(avg(pow(sqrt(g0*g0 + g1*g1 + g2*g2 + 1e-8) - 1, 2)), 6) + 0e0 as loss from net group by 1",
    "evaluation_loss": f"with {_BY_LABEL}, {_network('pts')}, m as (select mesh_id, avg(abs({_CLIP('sd')} - {_CLIP('pred')})) as loss from net group by 1) select mesh_id, round(loss, 6) + 0e0 as loss from m union all select -1, round(avg(loss), 6) + 0e0 from m",
    "inferred_planes": f"with {_CUBE}, {_network('pts')} select mesh_id, iz, round(sum(pred), 6) + 0e0 as total from net group by 1, 2",
    "film_block": f"with {_BASE} select vec_id, {_OUT([f'{z} / (1 + exp(-{z}))' for z in _Z])} from base",
}
