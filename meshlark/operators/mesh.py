"""Mesh cleaning: triangles, welding, orientation, centring and principal-axis alignment.

Tables: ``vertices(mesh_id, vertex_id, x, y, z)``, ``faces(mesh_id, face_id, a, b, c)``, ids from 1.
Coordinates are double; a welded vertex is known by the smallest member of its cluster and then
renumbered densely. Everything is keyed by ``mesh_id`` and runs for all meshes at once.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators import cleaning
from meshlark.operators.batches import VECTORS, face_chunks, gathered, triangle_chunks
from meshlark.operators.graph import connected_components
from meshlark.operators.spatial import band_join
from meshlark.storage import Scratch, checkpoint, merged

NODE = 1 << 31


def face_vectors(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``mesh_id, face_id, a, b, c`` with the corner A and the edges AB and AC. Vertices and faces of a mesh
    meet in one task (see ``batches``), where corners are looked up."""
    ids = [f"{c} {faces.schema[c].dataType.simpleString()}" for c in ("mesh_id", "face_id", "a", "b", "c")]
    made = gathered(vertices, faces).mapInArrow(_face_batches, "mesh_id long, face_id long, a long, b long, c long, " + ", ".join(f"{v} double" for v in VECTORS))
    return made.selectExpr(*(f"cast({i.split()[0]} as {i.split()[1]}) as {i.split()[0]}" for i in ids), *VECTORS)


def _face_batches(batches):
    for f in face_chunks(batches):
        there = [f.found[:, 0]] * 3 + [f.found[:, 0] & f.found[:, k] for k in (1, 2) for _ in range(3)]
        corners = [pa.array(f.corner[:, k].astype(np.int64), mask=~f.found[:, k]) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(f.mesh), pa.array(f.face), *corners, *(pa.array(v, mask=~ok) for v, ok in zip(f.vectors.T, there))], ["mesh_id", "face_id", "a", "b", "c", *VECTORS])


def with_area(tri: DataFrame) -> DataFrame:
    """``area2``: the doubled area, and the components of the normal."""
    n = {"nx": "aby*acz - abz*acy", "ny": "abz*acx - abx*acz", "nz": "abx*acy - aby*acx"}
    return tri.withColumns({k: F.expr(v) for k, v in n.items()}).withColumn("area2", F.expr("sqrt(nx*nx + ny*ny + nz*nz)"))


def triangles(vertices: DataFrame, faces: DataFrame, least: float = 1e-20) -> DataFrame:
    """Non-degenerate triangles renumbered 1..T per mesh in face order, with edge-ownership flags. A
    mesh all of whose faces are degenerate raises."""
    schema = "mesh_id long, tri_id int, face_id long, " + ", ".join(f"{v} double" for v in VECTORS) + ", area2 double, flags int"
    return gathered(vertices, faces).mapInArrow(partial(_triangle_batches, least), schema)


def _triangle_batches(least, batches):
    for t in triangle_chunks(batches, least):
        yield pa.RecordBatch.from_arrays([*map(pa.array, (t.mesh, t.tri, t.face, *t.vectors.T, t.area2, t.flags))], ["mesh_id", "tri_id", "face_id", *VECTORS, "area2", "flags"])


def weld_pairs(vertices: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Pairs of vertices ``i < j`` of one mesh at most ``eps`` apart."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    left = vertices.select("mesh_id", F.col("vertex_id").alias("i"), *(F.col(c).alias(f"l_{c}") for c in "xyz"))
    right = vertices.select("mesh_id", F.col("vertex_id").alias("j"), *(F.col(c).alias(f"r_{c}") for c in "xyz"))
    near = band_join(left, right, ["mesh_id"], ["x", "y", "z"], eps, max(1024 * eps, 1e-3)).where("i < j")
    return near.where(" + ".join(f"(l_{a}-r_{a})*(l_{a}-r_{a})" for a in "xyz") + f" <= {eps * eps!r}D").select("mesh_id", "i", "j")


def weld_places(vertices: DataFrame, eps: float = 1e-7) -> DataFrame:
    """``mesh_id, x, y, z, vertex_id, copies, root``: the distinct places with their smallest vertex and
    how many they have. A place with many copies makes no pairs; only distinct places are joined."""
    place = vertices.groupBy("mesh_id", "x", "y", "z").agg(F.min("vertex_id").alias("vertex_id"), F.count("*").alias("copies"))
    place = Scratch(vertices.sparkSession).write(place, "places")
    node = lambda c: F.col("mesh_id").cast("long") * NODE + F.col(c)
    pairs = weld_pairs(place, eps).select(node("i").alias("src"), node("j").alias("dst"))
    joined = connected_components(pairs).select(F.col("node"), (F.col("component") % NODE).alias("low"))
    return place.join(merged(joined), node("vertex_id") == F.col("node"), "left").select(*place.columns, F.coalesce("low", "vertex_id").alias("root"))


def weld_components(vertices: DataFrame, eps: float = 1e-7) -> DataFrame:
    """``mesh_id, vertex_id, root``. Vertices of one place are one class (see ``weld_places``)."""
    roots = weld_places(vertices, eps).select(F.col("mesh_id").alias("m"), *(F.col(c).alias(f"_{c}") for c in "xyz"), "root")
    same = (F.col("mesh_id") == F.col("m")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("z") == F.col("_z"))
    return vertices.join(merged(roots), same).select("mesh_id", "vertex_id", "x", "y", "z", "root")


def weld_vertices(welded: DataFrame) -> DataFrame:
    """``mesh_id, root, vertex_id, x, y, z``: cluster means with dense ids, of every vertex or of places
    with their ``copies``."""
    copies = F.col("copies") if "copies" in welded.columns else F.lit(1)
    mean = welded.groupBy("mesh_id", "root").agg(*((F.sum(F.col(c) * copies) / F.sum(copies)).alias(c) for c in "xyz"), F.sum(copies).alias("members"))
    return mean.withColumn("vertex_id", F.row_number().over(Window.partitionBy("mesh_id").orderBy("root")))


def weld_faces(faces: DataFrame, welded: DataFrame, clusters: DataFrame) -> DataFrame:
    """Faces on the new vertices: degenerate ones go, of equal vertex sets the lowest face id stays."""
    ids = welded.select("mesh_id", "vertex_id", "root").join(merged(clusters.select("mesh_id", "root", F.col("vertex_id").alias("new"))), ["mesh_id", "root"])
    corners = faces.select("mesh_id", "face_id", F.posexplode(F.array("a", "b", "c")).alias("k", "vertex_id")).join(merged(ids), ["mesh_id", "vertex_id"])
    wide = corners.groupBy("mesh_id", "face_id").agg(*(F.max(F.when(F.col("k") == i, F.col("new"))).alias(v) for i, v in enumerate("abc")))
    wide = wide.where("a <> b and b <> c and a <> c").withColumn("set", F.array_sort(F.array("a", "b", "c")))
    first = wide.groupBy("mesh_id", "set").agg(F.min(F.struct("face_id", "a", "b", "c")).alias("f")).select("mesh_id", "f.*")
    return first.withColumn("new_id", F.row_number().over(Window.partitionBy("mesh_id").orderBy("face_id")))


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges of each face with the sign of its traversal: ``lo, hi, face_id, edge_id, sign``."""
    three = F.array(*(F.struct(F.lit(k).alias("edge_id"), F.col(u).alias("u"), F.col(v).alias("v")) for k, (u, v) in enumerate((("a", "b"), ("b", "c"), ("c", "a")), 1)))
    e = faces.select("mesh_id", "face_id", F.inline(three))
    return e.select("mesh_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "face_id", "edge_id", F.when(F.col("u") <= F.col("v"), 1).otherwise(-1).alias("sign"))


def edge_multiplicity(faces: DataFrame) -> DataFrame:
    """``mesh_id, boundary, manifold, non_manifold``: undirected edges by the number of faces on them."""
    n = edges(faces).groupBy("mesh_id", "lo", "hi").agg(F.count("*").alias("n"))
    return n.groupBy("mesh_id").agg(*(F.count_if(F.expr(c)).alias(k) for k, c in (("boundary", "n = 1"), ("manifold", "n = 2"), ("non_manifold", "n > 2"))))


def face_adjacency(faces: DataFrame) -> DataFrame:
    """``mesh_id, f, g, toggle`` for faces on an edge of two; ``toggle`` if both run it the same way."""
    two = edges(faces).groupBy("mesh_id", "lo", "hi").agg(F.count("*").alias("n"), F.min("face_id").alias("f"), F.max("face_id").alias("g"), F.sum("sign").alias("s"))
    return two.where("n = 2 and f <> g").select("mesh_id", "f", "g", (F.col("s") != 0).cast("int").alias("toggle"))


def orient_flips(faces: DataFrame, check: bool = True) -> DataFrame:
    """``mesh_id, face_id, component, flip``: consistent winding relative to the component's lowest face.

    Faces stand twice, as they are and flipped; an adjacency links copies of agreeing winding, and
    components of this double cover carry the parity. A component that holds both copies of a face
    cannot be oriented and raises, as do boundary and non-manifold edges when ``check`` is set.
    """
    if check:
        bad = edge_multiplicity(faces).where("boundary > 0 or non_manifold > 0").select("mesh_id").limit(5).collect()
        if bad:
            raise ValueError(f"open or non-manifold edges in meshes {[r[0] for r in bad]}")
    node = lambda f, s: F.col("mesh_id").cast("long") * NODE + F.col(f) * 2 + s
    adj = face_adjacency(faces)
    links = adj.select(node("f", F.lit(0)).alias("src"), node("g", F.col("toggle")).alias("dst")).union(adj.select(node("f", F.lit(1)), node("g", 1 - F.col("toggle"))))
    comp = connected_components(links)
    at = faces.select("mesh_id", "face_id").join(merged(comp.withColumnsRenamed({"node": "n0", "component": "c0"})), node("face_id", F.lit(0)) == F.col("n0"), "left")
    at = at.join(merged(comp.withColumnsRenamed({"node": "n1", "component": "c1"})), node("face_id", F.lit(1)) == F.col("n1"), "left")
    # a component's smallest node is its lowest face, unflipped in one cover and flipped in the other
    low = F.coalesce(F.least("c0", "c1"), node("face_id", F.lit(0)))
    flip = F.when(F.col("c0") == F.col("c1"), F.raise_error(F.concat(F.lit("not orientable: mesh "), F.col("mesh_id"))).cast("int")).otherwise(F.coalesce(((F.col("c0") % 2) != 0).cast("int"), F.lit(0)))
    return at.select("mesh_id", "face_id", F.floor((low % NODE) / 2).alias("component"), flip.alias("flip"))


def signed_volumes(vertices: DataFrame, faces: DataFrame, flips: DataFrame) -> DataFrame:
    """``mesh_id, component, volume6``: six times the volume about the vertex mean, after the flips."""
    mean = vertices.groupBy("mesh_id").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    tri = face_vectors(vertices, faces).join(merged(flips), ["mesh_id", "face_id"]).join(merged(mean), "mesh_id")
    det = "(ax-mx)*(aby*acz-abz*acy) + (ay-my)*(abz*acx-abx*acz) + (az-mz)*(abx*acy-aby*acx)"
    return tri.groupBy("mesh_id", "component").agg(F.sum(F.expr(f"case when flip = 1 then -1 else 1 end * ({det})")).alias("volume6"))


def reorient(vertices: DataFrame, faces: DataFrame, check: bool = True) -> DataFrame:
    """Faces wound outward, with the final ``flip``: a component of negative volume is turned whole."""
    flips = checkpoint(orient_flips(faces, check))
    volume = signed_volumes(vertices, faces, flips).select("mesh_id", "component", (F.col("volume6") < 0).cast("int").alias("turn"))
    out = faces.join(merged(flips), ["mesh_id", "face_id"]).join(merged(volume), ["mesh_id", "component"]).withColumn("flip", F.expr("flip ^ turn"))
    return out.select("mesh_id", "face_id", "component", "a", F.expr("if(flip = 1, c, b)").alias("b"), F.expr("if(flip = 1, b, c)").alias("c"), "flip")


def flip_share(wound: DataFrame) -> DataFrame:
    """``mesh_id, flipped_percent`` of ``reorient``'s faces."""
    return wound.groupBy("mesh_id").agg((F.round(100.0 * F.sum("flip") / F.count("*"), 2) + 0.0).alias("flipped_percent"))


def checked(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces, with an error for meshes without vertices (their corners are missing) and for ids that
    the numbering of nodes cannot hold."""
    corner = faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vertex_id")).distinct()
    lost = corner.join(merged(vertices.select("mesh_id", "vertex_id")), ["mesh_id", "vertex_id"], "left_anti").select("mesh_id").limit(5).collect()
    if lost:
        raise ValueError(f"faces without their vertices in meshes {sorted({r[0] for r in lost})}")
    most = faces.agg(F.max("face_id")).first()[0]
    if most is not None and most >= NODE // 2:
        raise ValueError("too many faces")
    return faces


def centred(vertices: DataFrame) -> DataFrame:
    whole = Window.partitionBy("mesh_id")
    return vertices.withColumns({f"m{c}": F.avg(c).over(whole) for c in "xyz"}).withColumns({c: F.col(c) - F.col(f"m{c}") for c in "xyz"}).drop("mx", "my", "mz")


def moments(vertices: DataFrame) -> DataFrame:
    """Uncentred second moments ``xx, xy, xz, yy, yz, zz`` per mesh."""
    return vertices.groupBy("mesh_id").agg(*(F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))


def principal_axes(second: DataFrame) -> DataFrame:
    """``u11`` to ``u33``: axes as columns by falling moment, each with its largest entry positive,
    the third turned if needed for a rotation."""
    names = [f"u{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]

    def run(frames):
        for f in frames:
            m = f[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
            u = np.linalg.eigh(m)[1][:, :, ::-1]
            big = np.take_along_axis(u, np.abs(u).argmax(axis=1)[:, None, :], 1)
            u = u * np.where(big < 0, -1.0, 1.0)
            u[:, :, 2] *= np.where(np.linalg.det(u) < 0, -1.0, 1.0)[:, None]
            yield pd.concat([f[["mesh_id"]].reset_index(drop=True), pd.DataFrame(u.reshape(-1, 9), columns=names)], axis=1)

    return second.mapInPandas(run, "mesh_id long, " + ", ".join(f"{n} double" for n in names))


def aligned(vertices: DataFrame, axes: DataFrame, reach: float = 0.9) -> DataFrame:
    """Rotated into the axes and scaled so that the farthest vertex lies at ``reach``."""
    turned = vertices.join(merged(axes), "mesh_id").selectExpr("mesh_id", "vertex_id", *(f"u1{j}*x + u2{j}*y + u3{j}*z as {c}" for j, c in enumerate("xyz", 1)))
    turned = turned.withColumn("r", F.sqrt(F.max(F.expr("x*x + y*y + z*z")).over(Window.partitionBy("mesh_id"))))
    scale = F.lit(reach) / (F.col("r") + F.when(F.col("r") == 0, 1.0).otherwise(0.0))
    return turned.select("mesh_id", "vertex_id", *((F.col(c) * scale).alias(c) for c in "xyz"))


def bounding_box(points: DataFrame, by: str) -> DataFrame:
    return points.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"))


def weld(vertices: DataFrame, faces: DataFrame, eps: float = 1e-7, orient: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """Clusters (see ``weld_vertices``) and faces on them, renumbered, where asked for wound outward (see
    ``reorient``), made where a mesh's rows meet; none if a mesh has more than ``LARGE`` faces."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    most = faces.groupBy("mesh_id").count().agg(F.max("count")).first()[0]
    if most is not None and most > cleaning.LARGE:
        return None
    made = gathered(vertices, faces).mapInArrow(partial(cleaning.weld_batches, eps, orient), cleaning.COLUMNS)
    made = Scratch(vertices.sparkSession).write(made, "welded")
    clusters = made.where("part = 0").selectExpr("mesh_id", "id as root", "p as x", "q as y", "r as z", "members", "flip as vertex_id")
    kept = made.where("part = 1").selectExpr("mesh_id", "cast(members as int) as face_id", "id as component", *(f"cast({k} as int) as {c}" for k, c in zip("pqr", "abc")), "flip")
    return clusters, kept if orient else kept.drop("component", "flip")


def canonicalize(vertices: DataFrame, faces: DataFrame, eps: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """Weld, centre, orient, align: canonical ``vertices`` and ``faces``."""
    if made := weld(vertices, faces, eps, True):
        points = centred(made[0].select("mesh_id", "vertex_id", "x", "y", "z"))
        return aligned(points, principal_axes(moments(points))), made[1]
    welded = checkpoint(weld_components(vertices, eps))
    clusters = weld_vertices(welded)
    kept = checkpoint(weld_faces(checked(vertices, faces), welded, clusters).select("mesh_id", F.col("new_id").alias("face_id"), "a", "b", "c"))
    points = checkpoint(centred(clusters.select("mesh_id", "vertex_id", "x", "y", "z")))
    wound = reorient(points, kept)
    return aligned(points, principal_axes(moments(points))), wound
