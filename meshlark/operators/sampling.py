"""Stratified point samples of meshes from a counter-based generator.

A draw is a hash of (mesh, sample, draw number), so samples do not depend on partitioning or retries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.functions import expressions as X
from meshlark.operators.batches import faces_of, gathered, over_triangles, runs, tables_of, triangles_of, whole
from meshlark.operators.grid import check_resolution
from meshlark.operators.mesh import bounding_box, canonicalize, triangles
from meshlark.operators.sdf import NODES, fields, mesh_fields
from meshlark.storage import checkpoint, merged


def partition_slice(start: int, stop: int, splits: tuple[float, ...]) -> list[tuple[int, int]]:
    """Consecutive inclusive ranges by cumulated shares, ends rounded half to even, the last at ``stop``."""
    share = np.array(splits, np.float32)
    if not np.isclose(share.sum(), 1) or (share <= 0).any():
        raise ValueError("shares must be positive and sum to 1")
    n = stop - start + 1
    ends = np.rint(np.cumsum(share) * np.float32(n)).astype(int).tolist()
    ends[-1] = n
    return [(start + a, start + b - 1) for a, b in zip([0, *ends[:-1]], ends)]


@dataclass(frozen=True)
class SamplingParameters:
    samples: int = 131_072
    resolution: int = 256
    ratio_eikonal: float = 0.25
    clamp_voxels: int = 16
    eikonal_voxels: int = 2
    splits: tuple[float, float, float] = (0.2, 0.7, 0.1)
    band_splits: tuple[float, ...] = (0.35, 0.3, 0.2, 0.15)
    band_sigmas: tuple[int, ...] = (1, 4, 8, 12)

    @property
    def voxel(self) -> float:
        return 2 / (self.resolution - 1)

    @property
    def clamp(self) -> float:
        return self.voxel * self.clamp_voxels

    @property
    def eikonal_threshold(self) -> float:
        return self.voxel * self.eikonal_voxels

    @property
    def eikonal_samples(self) -> int:
        return round(self.samples * self.ratio_eikonal)

    def strata(self) -> list[tuple[str, int, int, float]]:
        """``(stratum, start, stop, sigma)`` in sample order; the band is split further by sigma."""
        surface, band, volume = partition_slice(1, self.samples, self.splits)
        bands = partition_slice(*band, self.band_splits)
        return [("surface", *surface, 0.0), *(("band", *b, s * self.voxel) for b, s in zip(bands, self.band_sigmas)), ("volume", *volume, 0.0)]


def strata_table(spark: SparkSession, p: SamplingParameters) -> DataFrame:
    return spark.createDataFrame(p.strata(), "stratum string, start long, stop long, sigma double")


def area_weights(tri: DataFrame) -> DataFrame:
    """``weight``: share of the mesh's area; a mesh without area raises."""
    total = F.sum("area2").over(Window.partitionBy("mesh_id"))
    return tri.withColumn("weight", F.when(total > 0, F.col("area2") / total).otherwise(F.raise_error(F.lit("mesh without area")).cast("double")))


def cumulated(rows: DataFrame, by: str, order: str, weight: str) -> DataFrame:
    """``lo, hi, slices``: half-open slices of [0, 1) by weight, in order, without gaps (a slice begins
    where the one before it ends), and how many the group has."""
    every, w = Window.partitionBy(by), Window.partitionBy(by).orderBy(order)
    run = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("hi", run / F.sum(weight).over(every)).withColumn("slices", F.count("*").over(every))
    return rows.withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))


def draw(samples: DataFrame, cdf: DataFrame, by: str, u: str, *columns: str) -> DataFrame:
    """``pick``: of the slice that holds ``u``, the named columns; ``cdf`` comes from ``cumulated``.

    [0, 1) is cut into as many equal bins as the group has slices. A slice stands in the bins it
    touches, at most twice as many rows as there are slices, and a sample in its own, so that it meets
    two slices on average however many the group has; a sample past the last end (rounding) draws from
    the last slice that has weight."""
    many = F.col("slices")
    bin_of = lambda x: F.least(F.floor(x * many), many - 1)
    size = cdf.groupBy(by).agg(F.max("slices").alias("slices"), F.max("hi").alias("_end")).withColumnRenamed(by, "_by")
    end = cdf.groupBy(by).agg(F.max("hi").alias("_end")).withColumnRenamed(by, "_by")
    last = F.col("hi") == F.col("_end")
    placed = cdf.join(merged(end), F.col(by) == F.col("_by")).where("hi > lo").withColumn("_hi", F.when(last, F.lit(float("inf"))).otherwise(F.col("hi")))
    placed = placed.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("lo")), F.when(last, many - 1).otherwise(bin_of(F.col("hi"))))))
    placed = placed.select(F.col(by).alias("_of"), "_bin", F.col("lo").alias("_lo"), "_hi", F.struct(*columns).alias("pick"))
    asked = samples.join(merged(size), F.col(by) == F.col("_by")).withColumn("_at", bin_of(F.col(u))).drop("_by", "_end", "slices")
    met = asked.join(merged(placed), (F.col(by) == F.col("_of")) & (F.col("_at") == F.col("_bin")) & (F.col(u) >= F.col("_lo")) & (F.col(u) < F.col("_hi")))
    return met.drop("_at", "_of", "_bin", "_lo", "_hi")


def sample_ids(meshes: DataFrame, first: int, last: int) -> DataFrame:
    return meshes.select("mesh_id").withColumn("sample_id", F.explode(F.sequence(F.lit(first), F.lit(last))))


def surface_samples(tri: DataFrame, first: int, last: int) -> DataFrame:
    """Uniform points on the surface: ``mesh_id, sample_id, face, x, y, z``, drawn where a mesh's triangles
    meet (``tri`` may be rows of ``batches.gathered``)."""
    return over_triangles(tri, partial(_surface_batches, first, last), "mesh_id long, sample_id int, face int, x double, y double, z double")


def uniforms(mesh: np.ndarray, sample: np.ndarray, draw: int) -> np.ndarray:
    """``expressions.uniform`` of arrays."""
    word = lambda x: np.asarray(x).astype(np.int64).astype(np.uint64)
    h = (word(mesh) * np.uint64(2654435761) + word(sample) * np.uint64(2246822519) + np.uint64(draw * 3266489917)) & np.uint64(X.MASK)
    for shift, by in ((16, X.MIX_1), (15, X.MIX_2)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(by)) & np.uint64(X.MASK)
    return ((h ^ (h >> np.uint64(16))).astype(float) + 0.5) / 4294967296


def drawn(weight: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The slice of [0, 1) by weight, in order, that holds ``u``; past the last end (rounding) the last
    slice that has weight."""
    run = np.cumsum(weight / np.cumsum(weight)[-1])
    if not run[-1] > 0:
        raise ValueError("mesh without area")
    return np.minimum(np.searchsorted(run / run[-1], u, "right"), np.flatnonzero(weight > 0)[-1])


def _surface_batches(first, last, chunks):
    ids = np.arange(first, last + 1, dtype=np.int32)
    many = max(1, (1 << 17) // len(ids))
    for t in chunks:
        ends = runs(t.mesh)
        for k in range(0, len(ends) - 1, many):
            own = ends[k : k + many + 1].tolist()
            mesh, sample = np.repeat(t.mesh[own[:-1]], len(ids)), np.tile(ids, len(own) - 1)
            u = uniforms(mesh, sample, 0).reshape(-1, len(ids))
            pick = np.concatenate([s + drawn(t.area2[s:e], x) for s, e, x in zip(own, own[1:], u)])
            root, v2, v = np.sqrt(uniforms(mesh, sample, 1)), uniforms(mesh, sample, 2), t.vectors[pick].T
            xyz = [v[c] + root * (1 - v2) * v[3 + c] + root * v2 * v[6 + c] for c in range(3)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (mesh, sample, t.tri[pick].astype(np.int32), *xyz))], ["mesh_id", "sample_id", "face", "x", "y", "z"])


def near_surface_samples(surface: DataFrame, sigma: float) -> DataFrame:
    """Surface points moved by normal offsets, each axis drawn until it is inside the cube: a normal
    cut off at -1 and 1, taken in one draw by its inverse distribution."""
    rows = X.with_uniforms(surface.select("mesh_id", "sample_id", "x", "y", "z"), "mesh_id", "sample_id", {f"u{c}": 10 + i for i, c in enumerate("xyz")})
    rows = rows.withColumns({f"{e}{c}": F.expr(f"({at} - {c}) / {sigma!r}D") for c in "xyz" for e, at in (("l", "-1e0"), ("h", "1e0"))})
    rows = rows.withColumns({f"{e}{c}": F.expr(X.normal_cdf(f"{e}{c}")) for c in "xyz" for e in "lh"})
    rows = rows.withColumns({f"q{c}": F.expr(f"l{c} + u{c} * (h{c} - l{c})") for c in "xyz"})
    return rows.selectExpr("mesh_id", "sample_id", *(f"greatest(-1e0, least(1e0, {c} + {sigma!r}D * {X.normal_quantile(f'q{c}')})) as {c}" for c in "xyz"))


def volume_samples(meshes: DataFrame, first: int, last: int) -> DataFrame:
    """Uniform points of the cube."""
    rows = X.with_uniforms(sample_ids(meshes, first, last), "mesh_id", "sample_id", {c: k for k, c in enumerate("xyz")})
    return rows.selectExpr("mesh_id", "sample_id", *(f"2e0 * {c} - 1e0 as {c}" for c in "xyz"))


def trilinear(points: DataFrame, nodes: DataFrame, n: int, key: list[str]) -> DataFrame:
    """``sd``: the grid value at each point, blended from the eight nodes around it."""
    f = {f"f{c}": f"({c} + 1e0) / (2e0 / {n - 1}) + 1e0" for c in "xyz"}
    cell = points.selectExpr("*", *(f"{v} as {k}" for k, v in f.items()))
    cell = cell.selectExpr("*", *(f"greatest(1, least({n - 1}, cast(floor(f{c}) as int))) as c{c}" for c in "xyz"))
    offsets = F.array(*(F.struct(*(F.lit(v).alias(f"o{c}") for c, v in zip("xyz", o))) for o in np.ndindex(2, 2, 2)))
    eight = cell.select("*", F.inline(offsets))
    weight = " * ".join(f"if(o{c} = 1, f{c} - c{c}, 1 - (f{c} - c{c}))" for c in "xyz")
    eight = eight.selectExpr(*points.columns, *(f"c{c} + o{c} as i{c}" for c in "xyz"), f"{weight} as w")
    met = eight.join(merged(nodes.select("mesh_id", "ix", "iy", "iz", "sdf")), ["mesh_id", "ix", "iy", "iz"])
    return met.groupBy(*key, *[c for c in "xyz" if c not in key]).agg(F.sum(F.col("w") * F.col("sdf")).alias("sd"))


def plane_lookup(points: DataFrame, planes: DataFrame, n: int, key: list[str]) -> DataFrame:
    """``trilinear`` on planes (see ``sdf.fields``) as they are: a point meets the plane below and the one
    above it and picks four nodes of each, so that the field is not written out node by node."""
    cell = points.selectExpr("*", *(f"({c} + 1e0) / (2e0 / {n - 1}) + 1e0 as f{c}" for c in "xyz"))
    cell = cell.selectExpr("*", *(f"greatest(1, least({n - 1}, cast(floor(f{c}) as int))) as c{c}" for c in "xyz"))
    cell = cell.selectExpr(*points.columns, "cx", "cy", "fx - cx as wx", "fy - cy as wy", "inline(array(struct(cz as iz, 1 - (fz - cz) as wz), struct(cz + 1 as iz, fz - cz as wz)))")
    met = cell.join(merged(planes.select("mesh_id", "iz", "sdf")), ["mesh_id", "iz"])
    node = lambda i, j: f"sdf[cx - 1 + {i} + (cy - 1 + {j}) * {n}]"
    blend = " + ".join(f"{'wx' if i else '(1 - wx)'} * {'wy' if j else '(1 - wy)'} * {node(i, j)}" for i in (0, 1) for j in (0, 1))
    met = met.selectExpr(*points.columns, f"wz * ({blend}) as part")
    return met.groupBy(*key, *[c for c in "xyz" if c not in key]).agg(F.sum("part").alias("sd"))


def field_lookup(vertices: DataFrame, faces: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """``mesh_id, sample_id, x, y, z, sd``: samples with the distance blended from the exact field of their
    mesh, as ``plane_lookup`` has it. Where a mesh's grid fits one task, samples are dealt to its triangles
    and the field is not handed on."""
    check_resolution(n)
    if n**3 > NODES:
        return plane_lookup(points, fields(triangles(vertices, faces), n), n, ["mesh_id", "sample_id"]).select("mesh_id", "sample_id", "x", "y", "z", "sd")
    return gathered(vertices, faces, points).mapInArrow(partial(_lookup_batches, n), "mesh_id long, sample_id long, x double, y double, z double, sd double")


def blended(field: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Values of a field (z, y, x) at points (P, 3)."""
    n = len(field)
    at = (p + 1) / (2 / (n - 1)) + 1
    cell = np.clip(np.floor(at).astype(int), 1, n - 1)
    (fx, fy, fz), (i, j, k), out = (at - cell).T, cell.T - 1, 0.0
    for a, b, c in np.ndindex(2, 2, 2):
        out = out + (fz if a else 1 - fz) * ((fx if c else 1 - fx) * (fy if b else 1 - fy) * field[k + a, j + b, i + c])
    return out


def _lookup_batches(n, batches):
    for table in whole(batches):
        mesh, sample, p = tables_of(table)[2]
        sd, has = np.empty(len(mesh)), np.zeros(len(mesh), bool)
        for one, _, (field, _) in mesh_fields([triangles_of(faces_of(table))], n):
            s, e = np.searchsorted(mesh, (one, one + 1))
            sd[s:e], has[s:e] = blended(field.reshape(n, n, n), p[s:e]), True
        yield pa.RecordBatch.from_arrays([*map(pa.array, (mesh[has], sample[has], *p[has].T, sd[has]))], ["mesh_id", "sample_id", "x", "y", "z", "sd"])


def mesh_samples(tri: DataFrame, planes: DataFrame, p: SamplingParameters) -> DataFrame:
    """``mesh_id, sample_id, stratum, x, y, z, sd``: all strata of every mesh, in one order of sample
    ids: surface points at distance 0, points near it by sigma, points of the cube, these with
    distances blended from the fields in ``planes`` (of the resolution of ``p``)."""
    strata, meshes = p.strata(), tri.select("mesh_id").distinct()
    surface = surface_samples(tri, 1, max(stop for stratum, _, stop, _ in strata if stratum != "volume")).drop("face")
    found, parts = [], []
    for stratum, start, stop, sigma in strata:
        part = volume_samples(meshes, start, stop) if stratum == "volume" else surface.where(F.col("sample_id").between(start, stop))
        if stratum == "surface":
            found.append(part.select("mesh_id", "sample_id", F.lit(stratum).alias("stratum"), "x", "y", "z", F.lit(0.0).alias("sd")))
        else:
            part = near_surface_samples(part, sigma) if stratum == "band" else part
            parts.append(part.select("mesh_id", "sample_id", F.lit(stratum).alias("stratum"), "x", "y", "z"))
    off = reduce(DataFrame.union, parts)
    n = p.resolution
    met = plane_lookup(off, planes, n, ["mesh_id", "sample_id", "stratum"])
    return reduce(DataFrame.union, found).union(met.select("mesh_id", "sample_id", "stratum", "x", "y", "z", "sd"))


def mesh_samplers(vertices: DataFrame, faces: DataFrame, parameters: DataFrame, resolution: int = 256, mode: str = "exact") -> dict[str, DataFrame]:
    """The sampler dataset of raw meshes with ``parameters(mesh_id, p)``: canonical ``vertices`` and
    ``faces``, ``triangles`` with area weights, ``planes`` (the field) and ``samplers`` (resolution,
    bounds, parameters), all by ``mesh_id``; ``sinks.write_dataset`` stores them."""
    check_resolution(resolution)
    points, wound = canonicalize(vertices, faces)
    points, wound = checkpoint(points), checkpoint(wound)
    tri = triangles(points, wound)
    box = bounding_box(points, "mesh_id").select("mesh_id", *(F.array(*(f"{m}_{c}" for c in "xyz")).alias(f"bbox_{m}") for m in ("min", "max")))
    return {"vertices": points, "faces": wound, "triangles": area_weights(tri), "planes": fields(tri, resolution, mode), "samplers": parameters.join(box, "mesh_id").withColumn("resolution", F.lit(resolution))}


def random_subset(rows: DataFrame, by: str, key: str, k: int, salt: int = 99) -> DataFrame:
    """``k`` rows of each group by least hash, all if there are no more."""
    rows = X.with_uniforms(rows, by, key, {"_h": salt})
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h", key))).where(F.col("_r") <= k).drop("_r", "_h")


def eikonal_subset(samples: DataFrame, threshold: float, k: int) -> DataFrame:
    """Off-surface samples farther than ``threshold``, ``k`` of each mesh (all if there are no more)."""
    return random_subset(samples.where((F.col("stratum") != "surface") & (F.abs("sd") > threshold)), "mesh_id", "sample_id", k)
