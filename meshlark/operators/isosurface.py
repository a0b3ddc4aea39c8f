"""Isosurfaces by marching tetrahedra, or by marching cubes.

A cell is six tetrahedra around its main diagonal, or is taken as a whole. The crossing of an edge is
named by its two grid nodes, so neighbouring cells share it and the surface closes without welding.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.operators.batches import Memo, over_triangles
from meshlark.operators.grid import check_resolution
from meshlark.operators.sdf import NODES, fields, mesh_fields

_MEMO = Memo()


def tetrahedra() -> np.ndarray:
    """Six paths from corner (0,0,0) to (1,1,1), as corner offsets (6, 4, 3), positively oriented."""
    out = []
    for order in permutations(range(3)):
        path = [np.zeros(3, int)]
        for a in order:
            path.append(path[-1] + np.eye(3, dtype=int)[a])
        if np.linalg.det(np.array(path[1:]) - path[0]) < 0:
            path[1], path[2] = path[2], path[1]
        out.append(path)
    return np.array(out)


@lru_cache(1)
def cube_cases() -> dict[int, np.ndarray]:
    """By the corners of a cell that are below the level (bit 4x + 2y + z): triangles as (T, 3, 2)
    corners, three crossed edges each.

    Built from a rule: on each side of the cell, taken round from outside, every run of corners below
    the level is cut off by a segment. The segments of the six sides join to closed loops, which are
    fanned into triangles. A side is cut alike in both its cells, so the surface closes."""
    corner = lambda p: int(p[0] * 4 + p[1] * 2 + p[2])
    sides = []
    for a in range(3):
        for end in (0, 1):
            round_ = []
            for u, v in ((0, 0), (1, 0), (1, 1), (0, 1)):
                p = [0, 0, 0]
                p[a], p[(a + 1) % 3], p[(a + 2) % 3] = end, u, v
                round_.append(corner(p))
            sides.append(round_ if end else round_[::-1])
    out = {}
    for case in range(1, 255):
        below = [case >> c & 1 for c in range(8)]
        after = {}
        for side in sides:
            for k in range(4):
                if below[side[k]] and not below[side[k - 1]]:  # a run begins
                    last = k
                    while below[side[(last + 1) % 4]]:
                        last += 1
                    after[frozenset((side[k - 1], side[k]))] = frozenset((side[last % 4], side[(last + 1) % 4]))
        faces = []
        while after:
            loop = [next(iter(after))]
            while (edge := after.pop(loop[-1])) != loop[0]:
                loop.append(edge)
            faces += [[sorted(loop[0]), sorted(x), sorted(y)] for x, y in zip(loop[1:], loop[2:])]
        out[case] = np.array(faces)
    return out


def cube_faces(base: np.ndarray, below: np.ndarray, number) -> list[np.ndarray]:
    """Ends of the crossed edges of each triangle in the cells at ``base``."""
    places = np.array(list(product((0, 1), repeat=3)))
    corners = number(base + places[None])
    case = (below.ravel()[corners] << np.arange(8)).sum(axis=1)
    order = np.argsort(case, kind="stable")
    cut = np.concatenate(([0], np.flatnonzero(np.diff(case[order])) + 1, [len(order)]))
    return [corners[order[s:e]][:, cube_cases()[int(case[order[s]])]].reshape(-1, 3, 2) for s, e in zip(cut, cut[1:]) if e > s]


def crossing_faces(field: np.ndarray, n: int, first: int = 0, level: float = 0.0, cubes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``name`` and place of the vertices and faces (three names each) of the surface in the layers of
    cells between the given planes (x, y, z) from plane ``first`` on of a grid of ``n``; inside is below
    the level. Only cells whose corners differ in sign are cut up. A vertex is named by the grid
    nodes of its edge, so that layers fit together."""
    value = field.ravel() - level
    deep = field.shape[2]
    below = field < level
    near = [below[i : n - 1 + i, j : n - 1 + j, k : deep - 1 + k] for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    base = np.stack(np.nonzero(np.logical_or.reduce(near) & ~np.logical_and.reduce(near)), -1).reshape(-1, 1, 3)
    number = lambda c: (c[..., 0] * n + c[..., 1]) * deep + c[..., 2]
    faces = cube_faces(base, below, number) if cubes else tetrahedron_faces(base, value, number)
    ends = np.sort(np.concatenate(faces or [np.zeros((0, 3, 2), np.int64)]).reshape(-1, 2), axis=1)
    whole = ends // deep * n + ends % deep + first  # numbers in the whole grid
    name, one = np.unique(whole[:, 0] * n**3 + whole[:, 1], return_index=True)
    a, b = ends[one, 0], ends[one, 1]
    at = lambda q: np.stack((q // (n * n), q // n % n, q % n), 1) * (2 / (n - 1)) - 1
    s = (value[a] / np.where(value[a] == value[b], 1, value[a] - value[b]))[:, None]
    p, q = at(whole[one, 0]), at(whole[one, 1])
    return name, p + s * (q - p), (whole[:, 0] * n**3 + whole[:, 1]).reshape(-1, 3)


def tetrahedron_faces(base: np.ndarray, value: np.ndarray, number) -> list[np.ndarray]:
    """Ends of the crossed edges of each triangle in the tetrahedra of the cells at ``base``."""
    corners = np.concatenate([number(base + t[None]) for t in tetrahedra()])
    low = value[corners] < 0
    faces = []
    count = low.sum(axis=1)
    for k in (1, 3):  # one corner apart: a triangle
        t, b = corners[count == k], low[count == k]
        one = np.argmax(b if k == 1 else ~b, axis=1)
        for i in range(4):
            rows = t[one == i]
            # the other corners in the order that turns the triangle's normal to the high side
            j = [x for x in range(4) if x != i]
            if (i % 2 == 1) != (k == 3):
                j = [j[0], j[2], j[1]]
            faces.append(np.stack([np.stack((rows[:, i], rows[:, x]), 1) for x in j], 1))
    t, b = corners[count == 2], low[count == 2]
    for i in range(4):
        for j in range(i + 1, 4):
            rows = t[b[:, i] & b[:, j]]
            k, m = [x for x in range(4) if x not in (i, j)]
            if np.linalg.det(np.eye(4)[[i, j, k, m]]) < 0:
                k, m = m, k
            e = lambda x, y: np.stack((rows[:, x], rows[:, y]), 1)
            quad = [e(i, k), e(i, m), e(j, m), e(j, k)]
            faces += [np.stack((quad[0], quad[1], quad[2]), 1), np.stack((quad[0], quad[2], quad[3]), 1)]
    return faces


def joined(name: np.ndarray, place: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices once each, by name, and faces by their numbers from 0."""
    name, one = np.unique(name, return_index=True)
    return place[one], np.searchsorted(name, faces)


def surface(field: np.ndarray, level: float = 0.0, cubes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Vertices in [-1, 1]^3 and faces of the surface of a whole field (x, y, z)."""
    return joined(*crossing_faces(field, field.shape[0], 0, level, cubes))


def isosurfaces(planes: DataFrame, n: int, level: float = 0.0, cubes: bool = False) -> DataFrame:
    """``mesh_id, vertices, faces`` of each mesh's planes (see ``sdf.fields``), by marching tetrahedra or
    by marching ``cubes``.

    Cells are cut up layer by layer: a plane goes to the layers below and above it, and a task
    holds the planes of a few layers. What meets in one row a mesh is the surface, not the field."""
    deep = max(1, min(n - 1, NODES // n**2))
    nested = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 3), pa.array(x.ravel(), kind))
    lists = lambda rows: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.concat_arrays(rows))

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("s")[i].values
                first = own.field("iz")[0].as_py() - 1
                field = own.field("sdf").flatten().to_numpy().reshape(len(own), n, n).transpose(2, 1, 0)
                name, place, faces = crossing_faces(field, n, first, level, cubes)
                yield pa.RecordBatch.from_arrays([batch.column("mesh_id").slice(i, 1), batch.column("layer").slice(i, 1), *(lists([pa.array(x.ravel(), k)]) for x, k in ((name, pa.int64()), (place, pa.float64()), (faces, pa.int64())))], ["mesh_id", "layer", "name", "place", "faces"])

    def whole(batches):
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                own = batch.column("p")[i].values
                made.append(joined(*(own.field(c).flatten().to_numpy().reshape(shape) for c, shape in (("name", -1), ("place", (-1, 3)), ("faces", (-1, 3))))))
            if made:
                yield pa.RecordBatch.from_arrays([batch.column("mesh_id"), lists([nested(v, pa.float64()) for v, _ in made]), lists([nested(f + 1, pa.int32()) for _, f in made])], ["mesh_id", "vertices", "faces"])

    layer = F.array_distinct(F.array(F.expr(f"greatest(iz - 2, 0) div {deep}"), F.expr(f"least(iz - 1, {n - 2}) div {deep}")))
    rows = planes.select("mesh_id", "iz", "sdf", F.explode(layer).alias("layer")).withColumn("layer", F.col("layer").cast("int"))
    rows = rows.groupBy("mesh_id", "layer").agg(F.sort_array(F.collect_list(F.struct("iz", "sdf"))).alias("s"))
    parts = rows.mapInArrow(cut, "mesh_id long, layer int, name array<long>, place array<double>, faces array<long>")
    parts = parts.groupBy("mesh_id").agg(F.sort_array(F.collect_list(F.struct("layer", "name", "place", "faces"))).alias("p"))
    return parts.mapInArrow(whole, "mesh_id long, vertices array<array<double>>, faces array<array<int>>")


def mesh_isosurfaces(tri: DataFrame, n: int, level: float = 0.0, cubes: bool = False) -> DataFrame:
    """``isosurfaces`` of the exact fields of ``tri``. Where a mesh's grid fits one task (up to ``NODES``),
    the surface is cut there and the field is not handed on."""
    check_resolution(n)
    if n**3 > NODES:
        return isosurfaces(fields(tri, n), n, level, cubes)
    return over_triangles(tri, partial(_surface_batches, n, level, cubes), "mesh_id long, vertices array<array<double>>, faces array<array<int>>")


def _surface_batches(n, level, cubes, chunks):
    held, size = [], 0

    def one(sdf):
        v, f = surface(sdf.reshape(n, n, n).transpose(2, 1, 0), level, cubes)
        return v, (f + 1).astype(np.int32)

    for mesh, key, (sdf, _) in mesh_fields(chunks, n):
        held.append((mesh, _MEMO(("surface", n, level, cubes, key), lambda: one(sdf))))
        size += held[-1][1][0].size + held[-1][1][1].size
        if size > NODES:
            yield _surfaces(held)
            held, size = [], 0
    if held:
        yield _surfaces(held)


def _surfaces(held: list) -> pa.RecordBatch:
    lists = []
    for k in (0, 1):
        rows = [x[k] for _, x in held]
        flat, ends = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        three = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * 3), pa.array(flat.ravel()))
        lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), three))
    return pa.RecordBatch.from_arrays([pa.array([m for m, _ in held], pa.int64()), *lists], ["mesh_id", "vertices", "faces"])


def as_tables(surfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vertices`` and ``faces`` tables with ids from 1."""
    v = surfaces.select("mesh_id", F.posexplode("vertices").alias("k", "v")).select("mesh_id", (F.col("k") + 1).alias("vertex_id"), *(F.col("v")[i].alias(c) for i, c in enumerate("xyz")))
    f = surfaces.select("mesh_id", F.posexplode("faces").alias("k", "f")).select("mesh_id", (F.col("k") + 1).alias("face_id"), *(F.col("f")[i].alias(c) for i, c in enumerate("abc")))
    return v, f
