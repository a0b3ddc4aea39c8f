"""Signed distance grids of triangle meshes.

Spatial bins turn every lookup into an equi-join: a voxel or a column meets only triangles of its
tile. The relational forms serve small grids and cross-checks; ``fields`` does slabs of a mesh with
numpy, for any resolution, its input being the mesh's own triangles.
"""

from __future__ import annotations

from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.functions import expressions as X
from meshlark.operators.batches import VECTORS, Memo, over_triangles
from meshlark.operators.grid import check_resolution
from meshlark.operators.spatial import explode_bins

# Seed tile (it decides what a voxel is compared with), band, parity tile, tolerances.
SEED_TILE, PARITY_TILE, BAND = (8, 8, 4), (16, 16), 5
JITTER, EPS_DET, EPS_BARY, FALLBACK = 1e-3, 1e-10, 5e-8, 10.0
#: Nodes of a slab, and pairs of nodes or columns with triangles looked at together.
NODES, PAIRS = 1 << 19, 1 << 15
_MEMO = Memo()


def _bounds(c: str) -> tuple[str, str]:
    corners = f"a{c}, a{c} + ab{c}, a{c} + ac{c}"
    return f"least({corners})", f"greatest({corners})"


def seed_bins(tri: DataFrame, n: int, band: int = BAND, tile: tuple[int, int, int] = SEED_TILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``mesh_id, tile_id, tri_id``: tiles under the triangle's box grown by ``band`` voxels."""
    ranges, counts = {}, [-(-n // t) for t in tile]
    for c, t, m in zip("xyz", tile, counts):
        low, high = _bounds(c)
        lo, hi = f"greatest({X.voxel(low, n)} - {band}, 1)", f"least({X.voxel(high, n)} + {band}, {n})"
        ranges[f"t{c}"] = (F.expr(f"greatest(0, least({m - 1}, ({lo} - 1) div {t}))"), F.expr(f"greatest(0, least({m - 1}, ({hi} - 1) div {t}))"))
    return explode_bins(tri, ranges).selectExpr("mesh_id", f"1 + tx + ty * {counts[0]} + tz * {counts[0] * counts[1]} as tile_id", "tri_id", *keep)


def parity_bins(tri: DataFrame, n: int, tile: tuple[int, int] = PARITY_TILE, mag: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``mesh_id, tile_id, tri_id``: tiles of columns that a ray through the triangle may have."""
    mag = JITTER * 2 / (n - 1) if mag is None else mag
    some, ranges, counts = tri.where(f"abs(aby*acx - abx*acy) > {EPS_DET!r}D"), {}, [-(-n // t) for t in tile]
    for c, t, m in zip("xy", tile, counts):
        low, high = (f"{b} {s} {mag!r}D" for b, s in zip(_bounds(c), "-+"))
        some = some.where(f"{high} >= -1 and {low} <= 1")
        lo = f"greatest({X.voxel(f'greatest({low}, -1e0)', n)}, 1)"
        hi = f"least({X.voxel(f'least({high}, 1e0)', n)} + 1, {n})"
        ranges[f"t{c}"] = (F.expr(f"({lo} - 1) div {t}"), F.expr(f"least({m - 1}, ({hi} - 1) div {t})"))
    return explode_bins(some, ranges).selectExpr("mesh_id", f"1 + tx + ty * {counts[0]} as tile_id", "tri_id", *keep)


def _nodes(rows: DataFrame, n: int, tile: tuple[int, int, int]) -> DataFrame:
    """The nodes of each tile row."""
    cx, cy = -(-n // tile[0]), -(-n // tile[1])
    rows = rows.selectExpr("*", f"(tile_id - 1) % {cx} as tx", f"((tile_id - 1) div {cx}) % {cy} as ty", f"(tile_id - 1) div {cx * cy} as tz")
    span = {f"i{c}": (F.expr(f"t{c} * {t} + 1"), F.expr(f"least(t{c} * {t} + {t}, {n})")) for c, t in zip("xyz", tile)}
    rows = explode_bins(rows, span).drop("tx", "ty", "tz")
    return rows.selectExpr("*", *(f"{X.coordinate(f'i{c}', n)} as p{c}" for c in "xyz"))


def seed_nearest(tri: DataFrame, n: int, band: int = BAND, tile: tuple[int, int, int] = SEED_TILE) -> DataFrame:
    """``mesh_id, ix, iy, iz, d2, tri_id``: nearest triangle of the voxel's tile, ties to the lowest id.

    Grids of up to ``NODES`` are seeded a mesh at a time where its triangles meet. For larger ones the
    bins carry the triangle, and the minimum pre-aggregates before the shuffle."""
    if n**3 <= NODES:
        return over_triangles(tri, partial(_seed_batches, n, band, tile), "mesh_id long, ix int, iy int, iz int, d2 double, tri_id int")
    met = _nodes(seed_bins(tri, n, band, tile, tuple(VECTORS)), n, tile).selectExpr("mesh_id", "tri_id", "ix", "iy", "iz", *(f"{v} as {k}" for k, v in X.DOTS.items()))
    best = met.groupBy("mesh_id", "ix", "iy", "iz").agg(F.min(F.struct(F.expr(X.DISTANCE2).alias("d2"), "tri_id")).alias("b"))
    return best.selectExpr("mesh_id", *(f"cast(i{c} as int) as i{c}" for c in "xyz"), "b.d2", "b.tri_id")


def _seed_batches(n, band, tile, chunks):
    def one(t, ids):
        best, index = seeded(t, n, band, tile)
        at = np.nonzero(index >= 0)
        return *((a + 1).astype(np.int32) for a in at), best[at], ids[index[at]]

    for t in chunks:
        held, size = [], 0
        for mesh, at, key in t.meshes():
            held.append((mesh, _MEMO(("seed", n, band, tile, key), lambda: one(t.vectors[at], t.tri[at]))))
            size += len(held[-1][1][0])
            if size > NODES or at.stop == len(t.mesh):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([m for m, _ in held], [len(x[0]) for _, x in held])), *(pa.array(np.concatenate(c)) for c in zip(*(x for _, x in held)))], ["mesh_id", "ix", "iy", "iz", "d2", "tri_id"])
                held, size = [], 0


def parity_hits(tri: DataFrame, n: int, tile: tuple[int, int] = PARITY_TILE) -> DataFrame:
    """``mesh_id, ix, iy, z_idx, tri_id``: where the jittered ray of a column crosses a triangle."""
    mag = JITTER * 2 / (n - 1)
    met = parity_bins(tri, n, tile, mag, (*VECTORS, "flags"))
    met = met.selectExpr("*", f"(tile_id - 1) % {-(-n // tile[0])} as tx", f"(tile_id - 1) div {-(-n // tile[0])} as ty")
    met = explode_bins(met, {f"i{c}": (F.expr(f"t{c} * {t} + 1"), F.expr(f"least(t{c} * {t} + {t}, {n})")) for c, t in zip("xy", tile)})
    jx, jy = X.offsets("h", f"{mag!r}D")
    met = X.hashed(met, {"h": X.column_key("ix", "iy")})
    met = X.staged(met, {"sx": f"{X.coordinate('ix', n)} + {jx} - ax", "sy": f"{X.coordinate('iy', n)} + {jy} - ay", "det": "aby*acx - abx*acy"})
    met = X.staged(met, {"u": "(sy*acx - sx*acy)/det", "v": "(sx*aby - sy*abx)/det"}).withColumn("w", F.expr("1 - u - v"))
    met = met.where(f"least(u, v, w) >= -{EPS_BARY!r}D")  # most candidates end here; what is left may lie on an edge
    for i, b in enumerate("uvw"):
        met = met.where(f"{b} > {EPS_BARY!r}D or (flags & {1 << i}) <> 0")
    met = met.withColumn("z", F.expr("az + u*abz + v*acz")).where("not isnan(z) and z > -1 and z < 1")
    return met.selectExpr("mesh_id", "ix", "iy", f"cast((z + 1) / (2e0 / {n - 1}) as bigint) + 2 as z_idx", "tri_id").where(f"z_idx between 1 and {n}")


def parity_fill(hits: DataFrame, n: int) -> DataFrame:
    """``mesh_id, ix, iy, iz`` of the inside nodes: prefix parity of the hits along each column that
    has any. A column's hits are bounded by its triangles."""
    cols = hits.groupBy("mesh_id", "ix", "iy").agg(F.collect_list("z_idx").alias("zs"))
    cols = cols.withColumn("iz", F.explode(F.sequence(F.array_min("zs"), F.lit(n).cast("long"))))
    return cols.where("size(filter(zs, z -> z <= iz)) % 2 = 1").select("mesh_id", "ix", "iy", "iz")


def distance2(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances of points (..., 3) to triangles (..., 9), broadcast; regions as in ``DISTANCE2``."""
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    a, ab, ac = ([t[..., k + i] for i in range(3)] for k in (0, 3, 6))
    ap = [p[..., i] - a[i] for i in range(3)]
    ap2, p1, p2, e, f, g = dot(ap, ap), dot(ap, ab), dot(ap, ac), dot(ab, ab), dot(ab, ac), dot(ac, ac)
    b1, b2, c1, c2 = p1 - e, p2 - f, p1 - f, p2 - g
    bc = b2 - b1
    with np.errstate(divide="ignore", invalid="ignore"):
        # the face, then the edges and corners over it, the first that applies on top
        out = np.asarray(ap2 - (g * p1 * p1 - 2 * f * p1 * p2 + e * p2 * p2) / (e * g - f * f))
        layers = [
            ((b1 * c2 - c1 * b2 <= 0) & (bc >= 0) & (c1 - c2 >= 0), lambda: ap2 - 2 * p1 + e - bc * bc / (e - 2 * f + g)),
            ((c1 * p2 - p1 * c2 <= 0) & (p2 >= 0) & (c2 <= 0), lambda: ap2 - p2 * p2 / g),
            ((p1 * b2 - b1 * p2 <= 0) & (p1 >= 0) & (b1 <= 0), lambda: ap2 - p1 * p1 / e),
            ((c2 >= 0) & (c1 <= c2), lambda: ap2 - 2 * p2 + g),
            ((b1 >= 0) & (b2 <= b1), lambda: ap2 - 2 * p1 + e),
            ((p1 <= 0) & (p2 <= 0), lambda: ap2),
        ]
        for where, value in layers:
            np.copyto(out, value(), where=where)
    return np.maximum(out, 0)


def axis(n: int) -> np.ndarray:
    return -1 + np.arange(n) * (2 / (n - 1))


def nodes(n: int) -> np.ndarray:
    """Nodes as (n, n, n, 3), indexed by x, y, z."""
    x = axis(n)
    return np.stack(np.meshgrid(x, x, x, indexing="ij"), axis=-1)


def exact_index(t: np.ndarray, n: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest triangle of every node of the planes ``first`` to ``last`` - 1 (lowest number of
    equals) and its squared distance, as (n, n, planes).

    Boxes of nodes are halved until few triangles can be nearest: one whose distance to the box's
    centre passes the least such distance by more than the box's diameter is nearest to none of its
    nodes. Only a box with its candidates is in memory."""
    x, last = axis(n), n if last is None else last
    best, index = np.empty((n, n, last - first)), np.empty((n, n, last - first), np.int32)
    work = [(0, n, 0, n, first, last, np.arange(len(t)))]
    while work:
        *box, some = work.pop()
        size = [box[1] - box[0], box[3] - box[2], box[5] - box[4]]
        many = size[0] * size[1] * size[2]
        if many * len(some) <= PAIRS and (many <= 64 or len(some) <= 64) or many == 1:
            p = np.stack(np.meshgrid(x[box[0] : box[1]], x[box[2] : box[3]], x[box[4] : box[5]], indexing="ij"), -1).reshape(-1, 3)
            d = distance2(p[None], t[some, None])
            low = d.argmin(axis=0)
            at = tuple(slice(a - o, b - o) for a, b, o in zip(box[::2], box[1::2], (0, 0, first)))
            best[at], index[at] = d[low, np.arange(len(p))].reshape(size), some[low].reshape(size)
            continue
        ends = np.array([[x[box[2 * i]], x[box[2 * i + 1] - 1]] for i in range(3)])
        d = np.sqrt(distance2(ends.mean(axis=1), t[some]))
        some = some[d <= d.min() + np.linalg.norm(ends[:, 1] - ends[:, 0]) + 1e-9]
        cut = int(np.argmax(size))
        half = (box[2 * cut] + box[2 * cut + 1]) // 2
        for edge in (2 * cut + 1, 2 * cut):
            part = list(box)
            part[edge] = half
            work.append((*part, some))
    return best, index


def seeded(t: np.ndarray, n: int, band: int = BAND, tile: tuple[int, int, int] = SEED_TILE) -> tuple[np.ndarray, np.ndarray]:
    """Seeds: nearest of the triangles of the node's tile; -1 in tiles without any."""
    x, best, index = axis(n), np.full((n, n, n), np.inf), np.full((n, n, n), -1, np.int32)
    corners = np.stack((t[:, :3], t[:, :3] + t[:, 3:6], t[:, :3] + t[:, 6:]))
    at = lambda v: np.trunc((v + 1) / (2 / (n - 1))).astype(int) + 1
    last = -(-n // np.array(tile)) - 1
    lo = np.clip((np.maximum(at(corners.min(axis=0)) - band, 1) - 1) // np.array(tile), 0, last)
    hi = np.clip((np.minimum(at(corners.max(axis=0)) + band, n) - 1) // np.array(tile), 0, last)
    for k in range(len(t)):
        for z in range(lo[k][2], hi[k][2] + 1):  # a layer of tiles at a time
            s = tuple(slice(a * w, min((b + 1) * w, n)) for a, b, w in zip((*lo[k][:2], z), (*hi[k][:2], z), tile))
            d = distance2(np.stack(np.meshgrid(*(x[q] for q in s), indexing="ij"), -1), t[k])
            closer = d < best[s]
            best[s][closer], index[s][closer] = d[closer], k
    return best, index


def jump_flood(t: np.ndarray, n: int, corrections: int = 2, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """Jump flooding from the seeds: strides n/2, n/4 ... 1, then ``corrections`` at 1. A node takes a
    neighbour's triangle only if strictly nearer, neighbours in (dz, dy, dx) order. The whole grid is
    in memory, 20 bytes a node; distances are taken some planes at a time, and only where a neighbour
    has another triangle. For few triangles all distances are tabled first."""
    x, (best, index) = axis(n), seeded(t, n, band)
    table = np.stack([distance2(nodes(n), v) for v in t]) if len(t) * n**3 <= 1 << 20 else None
    strides, j, deep = [], n // 2, max(1, (1 << 18) // n**2)
    while j >= 1:
        strides.append(j)
        j //= 2
    for jump in strides + [1] * corrections:
        before = index.copy()
        for dz, dy, dx in product((-1, 0, 1), repeat=3):
            if dx == dy == dz == 0:
                continue
            lo, hi = zip(*((max(0, -d * jump), n - max(0, d * jump)) for d in (dx, dy, dz)))
            for z in range(lo[2], hi[2], deep):
                to = (slice(lo[0], hi[0]), slice(lo[1], hi[1]), slice(z, min(z + deep, hi[2])))
                fro = tuple(slice(q.start + d * jump, q.stop + d * jump) for q, d in zip(to, (dx, dy, dz)))
                cand = before[fro]
                at = np.nonzero((cand >= 0) & (cand != index[to]))
                if not len(at[0]):
                    continue
                own = cand[at]
                at = tuple(a + q.start for a, q in zip(at, to))
                d2 = distance2(np.stack([x[a] for a in at], -1), t[own]) if table is None else table[(own, *at)]
                closer = d2 < best[at]
                at = tuple(a[closer] for a in at)
                best[at], index[at] = d2[closer], own[closer]
    return best, index


def crossings(t: np.ndarray, n: int, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``column, plane``: where the jittered rays along z cross triangles, columns being numbered
    x * n + y and planes from 0 (the first above the crossing). Triangles meet the columns of their own
    bounds, so many pairs at a time."""
    t, flags = t[keep := np.abs(t[:, 4] * t[:, 6] - t[:, 3] * t[:, 7]) > EPS_DET], flags[keep]
    mag, h = JITTER * 2 / (n - 1), 2 / (n - 1)
    corners = np.stack((t[:, :2], t[:, :2] + t[:, 3:5], t[:, :2] + t[:, 6:8]))
    lo = np.clip(np.ceil((corners.min(axis=0) - mag + 1) / h), 0, n).astype(np.int64)
    hi = np.clip(np.floor((corners.max(axis=0) + mag + 1) / h), -1, n - 1).astype(np.int64)
    wide = np.maximum(hi - lo + 1, 0)
    many = wide[:, 0] * wide[:, 1]
    ends = np.cumsum(many)
    out = []
    for a in range(0, int(many.sum()), PAIRS):
        pair = np.arange(a, min(a + PAIRS, int(ends[-1])))
        k = np.searchsorted(ends, pair, "right")
        pair -= (ends - many)[k]
        ix, iy = lo[k, 0] + pair // wide[k, 1], lo[k, 1] + pair % wide[k, 1]
        hash_ = ((ix + 1).astype(np.uint64) * np.uint64(X.COLUMN_X) + (iy + 1).astype(np.uint64) * np.uint64(X.COLUMN_Y)) & np.uint64(X.MASK)
        for shift, by in ((16, X.MIX_1), (15, X.MIX_2)):
            hash_ = ((hash_ ^ (hash_ >> np.uint64(shift))) * np.uint64(by)) & np.uint64(X.MASK)
        hash_ ^= hash_ >> np.uint64(16)
        ax, ay, az, abx, aby, abz, acx, acy, acz = t[k].T
        sx = -1 + ix * h + ((hash_ & np.uint64(65535)) / 65535 - 0.5) * mag - ax
        sy = -1 + iy * h + ((hash_ >> np.uint64(16)) / 65535 - 0.5) * mag - ay
        det = aby * acx - abx * acy
        u, v = (sy * acx - sx * acy) / det, (sx * aby - sy * abx) / det
        ok = np.ones(len(pair), bool)
        for i, b in enumerate((u, v, 1 - u - v)):
            ok &= (b > EPS_BARY) | ((np.abs(b) <= EPS_BARY) & (flags[k] >> i & 1 == 1))
        z = az + u * abz + v * acz
        ok &= (z > -1) & (z < 1)
        out.append(((ix * n + iy)[ok], ((z[ok] + 1) / h).astype(np.int64) + 1))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), ())))


def inside(t: np.ndarray, n: int, flags: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Nodes of the planes ``first`` to ``last`` - 1 inside the mesh, by ray parity along z with jitter
    and edge ownership."""
    last = n if last is None else last
    column, plane = crossings(t, n, np.asarray(flags).astype(np.int64))
    toggle = np.zeros((n * n, last - first), np.int32)
    below = plane < last
    np.add.at(toggle, (column[below], np.maximum(plane[below] - first, 0)), 1)
    return (np.cumsum(toggle, axis=1) % 2 == 1).reshape(n, n, -1)


def signed(best: np.ndarray, within: np.ndarray) -> np.ndarray:
    d = np.where(np.isfinite(best), np.sqrt(np.where(np.isfinite(best), best, 0)), FALLBACK)
    return np.where(within, -d, d)


def fields(tri: DataFrame, n: int, mode: str = "exact", corrections: int = 2) -> DataFrame:
    """``mesh_id, iz, sdf, tri``: one row a plane, values in x-fastest order.

    Grids of up to ``NODES`` are made a mesh at a time where its triangles meet (``tri`` may be rows of
    ``batches.gathered``, which saves a shuffle); meshes of equal triangles are worked out once. Larger
    exact fields are made slab by slab, each a row of its own with the mesh's triangles, so that a large
    grid spreads over the cluster and a task holds ``NODES`` nodes. Jump flooding needs the whole
    grid of a mesh in one task."""
    check_resolution(n)
    deep = n if mode == "jfa" else max(1, min(n, NODES // n**2))
    schema = "mesh_id long, iz int, sdf array<double>, tri array<int>"
    if deep >= n:
        return over_triangles(tri, partial(_field_batches, n, mode, corrections), schema)

    def run(batches):
        for batch in batches:
            t = batch.column("t")
            for i, (mesh, first) in enumerate(zip(batch.column("mesh_id").to_pylist(), batch.column("first").to_pylist())):
                rows = t[i].values
                v = np.stack([rows.field(c).to_numpy(zero_copy_only=False) for c in VECTORS], axis=1)
                yield _planes([(mesh, first, *signed_field(v, rows.field("flags").to_numpy(zero_copy_only=False), rows.field("tri_id").to_numpy(zero_copy_only=False), n, mode, corrections, first, min(n, first + deep)))], n)

    if "part" in tri.columns:
        raise ValueError("slabs need rows of mesh.triangles")
    rows = tri.groupBy("mesh_id").agg(F.sort_array(F.collect_list(F.struct("tri_id", *VECTORS, "flags"))).alias("t"))
    rows = rows.select(F.col("mesh_id").cast("long"), "t", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(deep))).alias("first"))
    rows = rows.repartition(int(tri.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mesh_id", "first")
    return rows.mapInArrow(run, schema)


def signed_field(t: np.ndarray, flags: np.ndarray, ids: np.ndarray, n: int, mode: str = "exact", corrections: int = 2, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signed distances and nearest triangles of the planes ``first`` to ``last`` - 1, in x-fastest order."""
    best, index = exact_index(t, n, first, last) if mode == "exact" else jump_flood(t, n, corrections)
    s = signed(best, inside(t, n, flags, first, last))
    return s.T.ravel(), np.where(index >= 0, ids[np.maximum(index, 0)], 0).T.ravel().astype(np.int32)


def mesh_fields(chunks, n: int, mode: str = "exact", corrections: int = 2):
    """Each mesh of the chunks with its contents and its whole field (see ``signed_field``)."""
    for t in chunks:
        for mesh, at, key in t.meshes():
            yield mesh, key, _MEMO((mode, n, corrections, key), lambda: signed_field(t.vectors[at], t.flags[at], t.tri[at], n, mode, corrections))


def _field_batches(n, mode, corrections, chunks):
    held = []
    for mesh, _, field in mesh_fields(chunks, n, mode, corrections):
        held.append((mesh, 0, *field))
        if len(held) * n**3 >= NODES:
            yield _planes(held, n)
            held = []
    if held:
        yield _planes(held, n)


def _planes(held: list, n: int) -> pa.RecordBatch:
    iz = [np.arange(f + 1, f + 1 + len(s) // n**2, dtype=np.int32) for _, f, s, _ in held]
    off = pa.array(np.arange(sum(map(len, iz)) + 1, dtype=np.int32) * n**2)
    lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x))) for x in list(zip(*held))[2:]]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat([m for m, *_ in held], [len(z) for z in iz]), pa.int64()), pa.array(np.concatenate(iz)), *lists], ["mesh_id", "iz", "sdf", "tri"])


def field_nodes(planes: DataFrame, n: int) -> DataFrame:
    """``mesh_id, ix, iy, iz, sdf`` from planes."""
    e = planes.select("mesh_id", "iz", F.posexplode("sdf").alias("k", "sdf"))
    return e.selectExpr("mesh_id", f"k % {n} + 1 as ix", f"k div {n} + 1 as iy", "iz", "sdf")
