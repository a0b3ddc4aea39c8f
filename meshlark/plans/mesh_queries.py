"""Mesh cleaning over one box a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.functions.expressions import DUCK, edge_flags, jitter, tidy
from meshlark.operators import mesh as M
from meshlark.plans.derived import EPS, SQL_BOX, SQL_CHAIN, SQL_SOUP, SQL_TRI, TURN, box_soup, box_welded, boxes, chained_soup, tessellated, turned
from meshlark.sources.meshes import soup_tables
from meshlark.storage import checkpoint, merged

_XYZ = [f"{tidy(c)} as {c}" for c in "xyz"]


def _soup(spark, sf_dir):
    return box_soup(boxes(spark, sf_dir))


def _welded(spark, sf_dir):
    """Welded soup: clusters and faces on them."""
    vertices, faces = soup_tables(_soup(spark, sf_dir))
    if made := M.weld(vertices, faces):
        return made
    welded = checkpoint(M.weld_components(vertices))
    clusters = checkpoint(M.weld_vertices(welded))
    kept = M.weld_faces(faces, welded, clusters).select("mesh_id", F.col("new_id").alias("face_id"), "a", "b", "c")
    return clusters, checkpoint(kept)


def _wound(spark, sf_dir):
    """The same with the faces wound outward."""
    made = M.weld(*soup_tables(_soup(spark, sf_dir)), orient=True)
    if made is None:
        clusters, faces = _welded(spark, sf_dir)
        made = clusters, M.reorient(clusters, faces)
    return made


def _clusters(spark, sf_dir):
    """Clusters of the welded soup, without its faces."""
    return M.weld_vertices(M.weld_places(soup_tables(_soup(spark, sf_dir))[0]))


def mesh_soup(spark, sf_dir):
    return _soup(spark, sf_dir).selectExpr("mesh_id", "face_id", "vertex_id", *_XYZ)


def face_vectors(spark, sf_dir):
    tri = M.with_area(M.face_vectors(*soup_tables(_soup(spark, sf_dir))))
    return tri.selectExpr("mesh_id", "face_id", *(f"{tidy(c)} as {c}" for c in (*M.VECTORS, "area2")))


def degenerate_filter(spark, sf_dir):
    """Triangles that are left when every mesh gets one face with a repeated corner."""
    vertices, faces = soup_tables(_soup(spark, sf_dir))
    faces = faces.union(faces.where("face_id = 1").selectExpr("mesh_id", "13L", "a", "b", "b"))
    return M.triangles(vertices, faces).groupBy("mesh_id").agg(F.count("*").alias("n"), F.max("tri_id").cast("long").alias("last_tri"), F.max("face_id").alias("last_face"))


def edge_flag_bits(spark, sf_dir):
    return M.triangles(*box_welded(boxes(spark, sf_dir))).selectExpr("mesh_id", "face_id", "cast(flags as bigint) as flags")


def weld_pairs(spark, sf_dir):
    return M.weld_pairs(soup_tables(_soup(spark, sf_dir))[0])


def weld_chain_pairs(spark, sf_dir):
    """Pairs where copies of a corner lie in a row and only neighbours are within the tolerance."""
    return M.weld_pairs(chained_soup(boxes(spark, sf_dir)), EPS)


def weld_chain_vertices(spark, sf_dir):
    """Clusters that only chains of pairs hold together, with their means."""
    clusters = M.weld_vertices(M.weld_components(chained_soup(boxes(spark, sf_dir)), EPS))
    return clusters.selectExpr("mesh_id", "cast(vertex_id as bigint) as vertex_id", "root", *_XYZ, "members")


def weld_components(spark, sf_dir):
    return M.weld_components(soup_tables(_soup(spark, sf_dir))[0]).select("mesh_id", "vertex_id", "root")


def weld_vertices(spark, sf_dir):
    return _welded(spark, sf_dir)[0].selectExpr("mesh_id", "cast(vertex_id as bigint) as vertex_id", "root", *_XYZ, "members")


def weld_faces(spark, sf_dir):
    return _welded(spark, sf_dir)[1].selectExpr("mesh_id", *(f"cast({c} as bigint) as {c}" for c in ("face_id", "a", "b", "c")))


def weld_metrics(spark, sf_dir):
    """Share of vertices that welding leaves, in percent."""
    clusters, _ = _welded(spark, sf_dir)
    return clusters.groupBy("mesh_id").agg((F.round(100.0 * F.count("*") / F.sum("members"), 2) + 0.0).alias("left_percent"))


def edge_multiplicity(spark, sf_dir):
    """Open meshes: every fourth face is dropped to leave boundary edges."""
    _, faces = box_welded(boxes(spark, sf_dir))
    return M.edge_multiplicity(faces.where("face_id < 12 or mesh_id % 2 = 0"))


def face_adjacency(spark, sf_dir):
    return M.face_adjacency(_welded(spark, sf_dir)[1]).selectExpr("mesh_id", "cast(f as bigint) as f", "cast(g as bigint) as g", "cast(toggle as bigint) as toggle")


def orient_flips(spark, sf_dir):
    return _wound(spark, sf_dir)[1].selectExpr("mesh_id", "cast(face_id as bigint) as face_id", "cast(flip as bigint) as flip")


def reorient_metrics(spark, sf_dir):
    """Share of faces that orienting turns, in percent."""
    return M.flip_share(_wound(spark, sf_dir)[1])


def component_volume(spark, sf_dir):
    clusters, wound = _wound(spark, sf_dir)
    wound = wound.select("mesh_id", "face_id", "component", "a", "b", "c", F.lit(0).alias("flip"))
    v = M.signed_volumes(clusters, wound.drop("component", "flip"), wound.select("mesh_id", "face_id", "component", "flip"))
    return v.selectExpr("mesh_id", f"{tidy('volume6 / 6')} as volume")


def mesh_centroid(spark, sf_dir):
    v = _clusters(spark, sf_dir).groupBy("mesh_id").agg(*(F.avg(c).alias(c) for c in "xyz"))
    return v.selectExpr("mesh_id", *_XYZ)


def mesh_moments(spark, sf_dir):
    m = M.moments(M.centred(_clusters(spark, sf_dir)))
    return m.selectExpr("mesh_id", *(f"{tidy(c)} as {c}" for c in ("xx", "xy", "xz", "yy", "yz", "zz")))


def mesh_axes(spark, sf_dir):
    u = M.principal_axes(M.moments(M.centred(_clusters(spark, sf_dir))))
    return u.selectExpr("mesh_id", *(f"{tidy(f'u{i}{j}')} as u{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)))


def turned_axes(spark, sf_dir):
    """Principal axes of rotated boxes."""
    u = M.principal_axes(M.moments(turned(box_welded(boxes(spark, sf_dir))[0])))
    return u.selectExpr("mesh_id", *(f"{tidy(f'u{i}{j}')} as u{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)))


def turned_canonical(spark, sf_dir):
    """The cleaning pipeline on rotated boxes whose sides are of several triangles."""
    vertices, faces = tessellated(boxes(spark, sf_dir), 3)
    v, f = M.canonicalize(turned(vertices), faces)
    v = v.groupBy("mesh_id").agg(F.count("*").alias("n"), *(F.max(F.abs(c)).alias(f"reach_{c}") for c in "xyz"))
    v = v.join(merged(f.groupBy("mesh_id").agg(F.count("*").alias("faces"), F.sum("flip").cast("long").alias("flips"))), "mesh_id")
    return v.selectExpr("mesh_id", "n", "faces", "flips", *(f"{tidy(f'reach_{c}')} as reach_{c}" for c in "xyz"))


def mesh_canonical(spark, sf_dir):
    points = M.centred(_clusters(spark, sf_dir))
    v = M.aligned(points, M.principal_axes(M.moments(points)))
    return v.groupBy("mesh_id").agg(F.count("*").alias("n"), *(F.max(F.abs(c)).alias(f"reach_{c}") for c in "xyz"), F.max(F.expr("sqrt(x*x+y*y+z*z)")).alias("r")).selectExpr("mesh_id", "n", *(f"{tidy(f'reach_{c}')} as reach_{c}" for c in "xyz"), f"{tidy('r')} as r")


def bounding_box(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    return M.bounding_box(e, "label").selectExpr("cast(label as bigint) as label", *(f"{tidy(f'{m}_{c}')} as {m}_{c}" for m in ("min", "max") for c in "xyz"))


def hash_jitter(spark, sf_dir):
    jx, jy = jitter("p_partkey", "p_size", "1e0")
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"{tidy(jx, 9)} as jx", f"{tidy(jy, 9)} as jy")


def mesh_sampler_summary(spark, sf_dir):
    """One row a mesh: the whole cleaning pipeline, area and bounds of its canonical form."""
    vertices, faces = M.canonicalize(*soup_tables(_soup(spark, sf_dir)))
    tri = M.triangles(vertices, faces).groupBy("mesh_id").agg(F.count("*").alias("triangles"), (F.sum("area2") / 2).alias("area"))
    box = M.bounding_box(vertices, "mesh_id").join(merged(vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices"))), "mesh_id")
    out = box.join(merged(tri), "mesh_id").join(merged(faces.groupBy("mesh_id").agg(F.sum("flip").alias("flips"))), "mesh_id")
    return out.selectExpr("mesh_id", "vertices", "triangles", "flips", f"{tidy('area')} as area", *(f"{tidy(f'max_{c}')} as max_{c}" for c in "xyz"))


QUERIES = {f.__name__: f for f in (mesh_soup, face_vectors, degenerate_filter, edge_flag_bits, weld_pairs, weld_chain_pairs, weld_chain_vertices, weld_components, weld_vertices, weld_faces, weld_metrics, edge_multiplicity, face_adjacency, orient_flips, reorient_metrics, component_volume, mesh_centroid, mesh_moments, mesh_axes, turned_axes, turned_canonical, mesh_canonical, bounding_box, hash_jitter, mesh_sampler_summary)}

_FV = """fv as (select mesh_id, face_id, {first} from (select mesh_id, face_id, {pick} from soup group by 1, 2))""".format(
    first=", ".join([f"{c}0 as a{c}" for c in "xyz"] + [f"{c}{i} - {c}0 as {e}{c}" for i, e in ((1, "ab"), (2, "ac")) for c in "xyz"]),
    pick=", ".join(f"max({c}) filter ((vertex_id - 1) % 3 = {i}) as {c}{i}" for i in range(3) for c in "xyz"),
)
_AREA = "sqrt((aby*acz-abz*acy)*(aby*acz-abz*acy) + (abz*acx-abx*acz)*(abz*acx-abx*acz) + (abx*acy-aby*acx)*(abx*acy-aby*acx))"
_ROOTS = "rooted as (select *, min(vertex_id) over (partition by mesh_id, x, y, z) as root from soup)"
_DENSE = "dense as (select mesh_id, root, min(x) as x, min(y) as y, min(z) as z, count(*) as members, row_number() over (partition by mesh_id order by root) as vertex_id from rooted group by mesh_id, root)"
_NF = "nf as (select r.mesh_id, r.face_id, max(d.vertex_id) filter ((r.vertex_id-1)%3=0) as a, max(d.vertex_id) filter ((r.vertex_id-1)%3=1) as b, max(d.vertex_id) filter ((r.vertex_id-1)%3=2) as c from rooted r join dense d on d.mesh_id = r.mesh_id and d.root = r.root group by 1, 2)"
_WELD = f"with {SQL_SOUP}, {_ROOTS}, {_DENSE}"
_EDGES = "e as (select mesh_id, face_id, least(u, v) as lo, greatest(u, v) as hi, case when u <= v then 1 else -1 end as s from (select mesh_id, face_id, unnest([a, b, c]) as u, unnest([b, c, a]) as v from {faces}))"
_ORDER = "ord as (select *, greatest(hx, hy, hz) as h1, hx+hy+hz-greatest(hx, hy, hz)-least(hx, hy, hz) as h2, least(hx, hy, hz) as h3 from box)"
#: The axes of a box are coordinate axes by falling extent; an odd order turns the third around.
_AXES = "ax as (select *, case when (hx > hy and hy > hz) or (hy > hz and hz > hx) or (hz > hx and hx > hy) then 1e0 else -1e0 end as s, case when hx >= hy and hx >= hz then 1 when hx <= hy and hx <= hz then 3 else 2 end as px, case when hy >= hx and hy >= hz then 1 when hy <= hx and hy <= hz then 3 else 2 end as py, case when hz >= hx and hz >= hy then 1 when hz <= hx and hz <= hy then 3 else 2 end as pz from box)"
_R = "sqrt(hx*hx + hy*hy + hz*hz)"
_jx, _jy = jitter("p_partkey", "p_size", "1e0", DUCK)
ORACLES = {
    "mesh_soup": f"with {SQL_SOUP} select mesh_id, face_id::bigint as face_id, vertex_id::bigint as vertex_id, {', '.join(f'round({c}, 6) + 0e0 as {c}' for c in 'xyz')} from soup",
    "face_vectors": f"with {SQL_SOUP}, {_FV} select mesh_id, face_id::bigint as face_id, {', '.join(f'round({c}, 6) + 0e0 as {c}' for c in M.VECTORS)}, round({_AREA}, 6) + 0e0 as area2 from fv",
    "degenerate_filter": f"with {SQL_BOX} select mesh_id, 12::bigint as n, 12::bigint as last_tri, 12::bigint as last_face from box",
    "edge_flag_bits": f"with {SQL_TRI} select mesh_id, tri_id::bigint as face_id, ({edge_flags()})::bigint as flags from tri",
    "weld_pairs": f"with {SQL_SOUP} select a.mesh_id, a.vertex_id::bigint as i, b.vertex_id::bigint as j from soup a join soup b on a.mesh_id = b.mesh_id and a.vertex_id < b.vertex_id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 1e-14",
    "weld_chain_pairs": f"with {SQL_CHAIN} select a.mesh_id, least(a.vertex_id, b.vertex_id)::bigint as i, greatest(a.vertex_id, b.vertex_id)::bigint as j from chain a join chain b on a.mesh_id = b.mesh_id and a.c = b.c and b.r = a.r + 1",
    "weld_chain_vertices": f"with {SQL_CHAIN}, k as (select mesh_id, min(vertex_id) as root, avg(x) as x, avg(y) as y, avg(z) as z, count(*) as members from chain group by mesh_id, c) select mesh_id, row_number() over (partition by mesh_id order by root) as vertex_id, root::bigint as root, {', '.join(f'round({c}, 6) + 0e0 as {c}' for c in 'xyz')}, members from k",
    "weld_components": f"with {SQL_SOUP}, {_ROOTS} select mesh_id, vertex_id::bigint as vertex_id, root::bigint as root from rooted",
    "weld_vertices": f"{_WELD} select mesh_id, vertex_id, root::bigint as root, {', '.join(f'round({c}, 6) + 0e0 as {c}' for c in 'xyz')}, members from dense",
    "weld_faces": f"{_WELD}, {_NF} select mesh_id, face_id::bigint as face_id, a, b, c from nf",
    "weld_metrics": f"with {SQL_BOX} select mesh_id, round(100e0 * 8 / 36, 2) + 0e0 as left_percent from box",
    "edge_multiplicity": f"with {SQL_BOX}, bf as (select mesh_id, f.face_id, f.a, f.b, f.c from box, face f where f.face_id < 12 or mesh_id % 2 = 0), {_EDGES.format(faces='bf')}, k as (select mesh_id, lo, hi, count(*) as n from e group by 1, 2, 3) select mesh_id, count(*) filter (n = 1) as boundary, count(*) filter (n = 2) as manifold, count(*) filter (n > 2) as non_manifold from k group by 1",
    "face_adjacency": f"{_WELD}, {_NF}, {_EDGES.format(faces='nf')} select p.mesh_id, p.face_id::bigint as f, q.face_id::bigint as g, (p.s = q.s)::bigint as toggle from e p join e q on p.mesh_id = q.mesh_id and p.lo = q.lo and p.hi = q.hi and p.face_id < q.face_id",
    # outward faces of a convex body look away from its centre: independent of the graph search
    "orient_flips": f"with {SQL_SOUP}, {_FV} select mesh_id, face_id::bigint as face_id, ((ax - tx + (abx+acx)/3)*(aby*acz-abz*acy) + (ay + (aby+acy)/3)*(abz*acx-abx*acz) + (az + (abz+acz)/3)*(abx*acy-aby*acx) < 0)::bigint as flip from fv join (select mesh_id, tx from box) using (mesh_id)",
    "reorient_metrics": f"with {SQL_BOX} select mesh_id, case kind when 1 then 25e0 when 2 then 100e0 else 0e0 end as flipped_percent from box",
    "component_volume": f"with {SQL_BOX} select mesh_id, round(8 * hx * hy * hz, 6) + 0e0 as volume from box",
    "mesh_centroid": f"with {SQL_BOX} select mesh_id, round(tx, 6) + 0e0 as x, 0e0 as y, 0e0 as z from box",
    "mesh_moments": f"with {SQL_BOX} select mesh_id, round(hx*hx, 6) + 0e0 as xx, 0e0 as xy, 0e0 as xz, round(hy*hy, 6) + 0e0 as yy, 0e0 as yz, round(hz*hz, 6) + 0e0 as zz from box",
    "mesh_axes": f"with {SQL_BOX}, {_AXES} select mesh_id, " + ", ".join(f"(case when p{c} = {j} then {'s' if j == 3 else '1e0'} else 0e0 end) + 0e0 as u{i}{j}" for i, c in enumerate("xyz", 1) for j in (1, 2, 3)) + " from ax",
    # the columns of the rotation have their largest entries positive, so a turned axis is one of them
    "turned_axes": f"with {SQL_BOX}, {_AXES} select mesh_id, " + ", ".join(f"round(({' + '.join(f'(case when p{c} = {j} then {float(TURN[i, k])!r}::double else 0e0 end)' for k, c in enumerate('xyz'))}) * {'s' if j == 3 else '1e0'}, 6) + 0e0 as u{i + 1}{j}" for i in range(3) for j in (1, 2, 3)) + " from ax",
    "turned_canonical": f"with {SQL_BOX}, {_ORDER} select mesh_id, 56::bigint as n, 108::bigint as faces, 0::bigint as flips, round(0.9e0 * h1 / {_R}, 6) as reach_x, round(0.9e0 * h2 / {_R}, 6) as reach_y, round(0.9e0 * h3 / {_R}, 6) as reach_z from ord",
    "mesh_canonical": f"with {SQL_BOX}, {_ORDER} select mesh_id, 8::bigint as n, round(0.9e0 * h1 / {_R}, 6) as reach_x, round(0.9e0 * h2 / {_R}, 6) as reach_y, round(0.9e0 * h3 / {_R}, 6) as reach_z, 0.9e0 as r from ord",
    "bounding_box": "select label::bigint as label, " + ", ".join(f"round({m}(embedding[{i}]::double), 6) + 0e0 as {m}_{c}" for m in ("min", "max") for i, c in enumerate("xyz", 1)) + " from embeddings group by 1",
    "hash_jitter": f"select p_partkey, round({_jx}, 9) + 0e0 as jx, round({_jy}, 9) + 0e0 as jy from part",
    "mesh_sampler_summary": f"with {SQL_BOX}, {_ORDER} select mesh_id, 8::bigint as vertices, 12::bigint as triangles, (case kind when 1 then 3 when 2 then 12 else 0 end)::bigint as flips, round(8 * 0.81e0 * (h1*h2 + h2*h3 + h1*h3) / ({_R}*{_R}), 6) + 0e0 as area, round(0.9e0 * h1 / {_R}, 6) as max_x, round(0.9e0 * h2 / {_R}, 6) as max_y, round(0.9e0 * h3 / {_R}, 6) as max_z from ord",
}
