"""Welding and orientation of whole meshes where their rows meet, by the rules of ``mesh``, on arrays of
many meshes at once. Meshes of more than ``LARGE`` rows go through the relational forms there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from meshlark.operators.batches import lookup, runs, tables_of, whole
from meshlark.operators.spatial import SHIFT

LARGE = 1 << 20


def components(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number of each one's component, of ``size`` numbers linked by ``i``, ``j``."""
    label = np.arange(size)
    while len(i):
        a, b = label[i], label[j]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (the first weighs most), and where a new combination begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def near(mesh: np.ndarray, place: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of one mesh at most ``eps`` apart: places stand in their cell and look in all
    cells they reach, as in ``spatial.band_join``."""
    cell = max(1024 * eps, 1e-3)
    at = lambda x: np.floor(x / cell + SHIFT).astype(np.int64)
    own, low, high = at(place), at(place - eps), at(place + eps)
    seen, cells = [], []
    for way in np.ndindex(2, 2, 2):
        some = np.flatnonzero(np.all([low[:, k] < high[:, k] for k in range(3) if way[k]], axis=0)) if any(way) else np.arange(len(mesh))
        seen.append(some)
        cells.append(np.where(way, high, low)[some])
    seen, cells = np.concatenate(seen), np.concatenate(cells + [own])
    order, new = firsts(np.concatenate((mesh[seen], mesh)), *cells.T)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    looks, stands = group[: len(seen)], group[len(seen) :]
    by = np.argsort(stands, kind="stable")
    start, end = np.searchsorted(stands[by], looks), np.searchsorted(stands[by], looks, "right")
    many = end - start
    i = np.repeat(seen, many)
    j = by[np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())]
    i, j = i[keep := i < j], j[keep]
    d = place[i] - place[j]
    keep = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= eps * eps) & (np.abs(d) <= eps).all(axis=1)
    return i[keep], j[keep]


def dense(mesh: np.ndarray) -> np.ndarray:
    """Numbers from 1 in each mesh, of sorted rows."""
    ends = runs(mesh)
    return np.arange(len(mesh)) - np.repeat(ends[:-1], np.diff(ends)) + 1


def welded(vertices, faces, eps: float):
    """Clusters ``mesh, root, place, members`` (numbered by root) and faces ``mesh, face, corner`` on them,
    corners as positions of clusters. Faces without their vertices raise."""
    mesh, ids, place = vertices
    order, new = firsts(mesh, *place.T, ids)[0], None
    new = firsts(mesh, *place.T)[1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    lead = order[new]  # of each place the smallest vertex
    rank = np.argsort(np.argsort(lead))  # rows are sorted by mesh and vertex, so places go by their lead
    which, lead = rank[which], np.sort(lead)
    root = components(len(lead), *near(mesh[lead], place[lead], eps))
    kept = np.flatnonzero(root == np.arange(len(lead)))
    cluster = np.searchsorted(kept, root)
    copies = np.bincount(which, minlength=len(lead))
    members = np.bincount(cluster, copies, len(kept))
    mean = np.stack([np.bincount(cluster, place[lead][:, c] * copies, len(kept)) / members for c in range(3)], axis=1)
    of, face, corner = faces
    pos, there = zip(*(lookup(mesh, ids, of, c) for c in corner.T))
    if not np.all(there):
        raise ValueError(f"faces without their vertices in meshes {np.unique(of[~np.all(there, axis=0)])[:5].tolist()}")
    new_corner = np.stack([cluster[which[p]] for p in pos], axis=1) if len(of) else np.zeros((0, 3), np.int64)
    three = np.sort(new_corner, axis=1)
    some = np.flatnonzero((three[:, 0] < three[:, 1]) & (three[:, 1] < three[:, 2]))
    order, _ = firsts(*three[some].T, some)
    _, new = firsts(*three[some].T)
    some = np.sort(some[order[new]])  # of equal sets the lowest face
    return (mesh[lead][kept], ids[lead][kept], mean, members.astype(np.int64)), (of[some], face[some], new_corner[some])


def outward(mesh: np.ndarray, corner: np.ndarray, place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``component`` (position of its lowest face) and ``flip`` of faces, by the double cover and then
    the sign of the volume; open, non-manifold and not orientable meshes raise."""
    u, v = corner.ravel(), corner[:, [1, 2, 0]].ravel()
    order, new = firsts(np.minimum(u, v), np.maximum(u, v), np.arange(len(u)))[0], firsts(np.minimum(u, v), np.maximum(u, v))[1]
    start = np.flatnonzero(new)
    many = np.diff(np.append(start, len(order)))
    if (many != 2).any():
        raise ValueError(f"open or non-manifold edges in meshes {np.unique(mesh[order[start[many != 2]] // 3])[:5].tolist()}")
    e, g = order[start], order[start + 1]
    toggle = ((u < v)[e] == (u < v)[g]).astype(np.int64)
    f, g = e // 3, g // 3
    cover = components(2 * len(mesh), np.concatenate((2 * f, 2 * f + 1)), np.concatenate((2 * g + toggle, 2 * g + 1 - toggle)))
    c0, c1 = cover[::2], cover[1::2]
    if (c0 == c1).any():
        raise ValueError(f"not orientable: mesh {mesh[c0 == c1][0]}")
    component, flip = np.minimum(c0, c1) // 2, c0 % 2
    ends = runs(owner)
    which = np.searchsorted(owner[ends[:-1]], mesh)
    mean = np.add.reduceat(place, ends[:-1], axis=0) / np.diff(ends)[:, None] if len(owner) else place
    a, b, c = (place[corner[:, k]] for k in range(3))
    det = np.einsum("ij,ij->i", a - mean[which], np.cross(b - a, c - a))
    volume = np.bincount(component, np.where(flip == 1, -det, det), len(mesh))
    return component, flip ^ (volume[component] < 0)


COLUMNS = "mesh_id long, part int, id long, p double, q double, r double, members long, flip int"


def _rows(mesh, vertices, faces) -> pa.RecordBatch:
    """Vertices (root as ``id``, members) and faces (``id`` the component) as one table, in order of their numbers."""
    (vm, vi, place, members), (fm, fi, corner, flip) = vertices, faces
    values = np.concatenate((place, corner.astype(float)))
    cols = [np.concatenate((vm, fm)), np.repeat(np.array([0, 1], np.int32), [len(vm), len(fm)]), np.concatenate((vi, fi)), *values.T, np.concatenate((members, dense(fm))), np.concatenate((dense(vm), flip)).astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["mesh_id", "part", "id", "p", "q", "r", "members", "flip"])


def weld_batches(eps: float, orient: bool, batches):
    """Rows of ``COLUMNS``: of vertices the root, place, members and (as ``flip``) number; of faces the lowest
    face of the component (where asked for), corners, (as ``members``) number and flip."""
    for table in whole(batches):
        vertices, faces, _ = tables_of(table)
        (mesh, root, place, members), (of, _, corner) = welded(vertices, faces, eps)
        number = dense(mesh)
        component, flip = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        if orient:
            component, flip = outward(of, corner, place, mesh)
            corner = np.where(flip[:, None] == 1, corner[:, [0, 2, 1]], corner)
            component = dense(of)[component] if len(of) else component
        yield _rows(mesh, (mesh, root, place, members), (of, component, number[corner], flip))
