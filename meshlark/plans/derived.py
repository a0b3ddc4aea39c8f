"""Meshes derived from the ``part`` table, for queries and their SQL: one box a part.

Half-extents are distinct and off the grid planes. By ``p_partkey % 4`` the box is as it should be,
has faces 2, 7 and 11 reversed, or all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators.batches import dealt

# Corner signs and faces of the box, faces numbered from 1, corners from 0.
CORNERS = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
FACES = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
TURNED = (2, 7, 11)

HALF = "0.31e0+(p_size%7)/20e0 as hx, 0.21e0+(p_partkey%5)/25e0 as hy, 0.14e0+(p_partkey%3)/20e0 as hz"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey is not null and p_size is not null")
    return part.selectExpr("p_partkey as mesh_id", *HALF.split(", "), "(p_size%5)*0.25e0 as tx", "p_partkey%4 as kind")


def box_soup(box: DataFrame, shift: bool = True) -> DataFrame:
    """``mesh_id, face_id, vertex_id, x, y, z``: 36 private vertices, as a file of facets has them."""
    rows = []
    for f, corners in enumerate(FACES, 1):
        for k in range(3):
            here, turned = CORNERS[corners[k]], CORNERS[corners[(0, 2, 1)[k]]]
            use = "kind = 2" + (" or kind = 1" if f in TURNED else "")
            at = [f"if({use}, {t}, {h})*h{c}" + (" + tx" if c == "x" and shift else "") for c, h, t in zip("xyz", here, turned)]
            rows.append(f"struct({f}L as face_id, {3 * (f - 1) + k + 1}L as vertex_id, {', '.join(f'{a} as {c}' for a, c in zip(at, 'xyz'))})")
    return box.select("mesh_id", F.expr(f"inline(array({', '.join(rows)}))"))


#: Which of the faces with a corner a face is, from 0: the number of a corner's copy in a soup.
COPY = {(f, c): sum(c in g for g in FACES[:f]) for f, face in enumerate(FACES) for c in face}
#: Tolerance, and the step between neighbouring copies of a corner in ``chained_soup``.
EPS, STEP = 1e-3, 6e-4
#: A rotation about z, then x, by angles of Pythagorean triangles.
TURN = np.array([[0.6, -0.8, 0], [0.8, 0.6, 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, 5 / 13, -12 / 13], [0, 12 / 13, 5 / 13]])


def chained_soup(box: DataFrame) -> DataFrame:
    """A soup whose copies of a corner lie in a row: neighbours are within ``EPS``, the ends are not."""
    rows = []
    for f, face in enumerate(FACES):
        for k, c in enumerate(face):
            x, y, z = CORNERS[c]
            rows.append(f"struct({f + 1}L as face_id, {3 * f + k + 1}L as vertex_id, {x}*hx + {COPY[f, c]} * {STEP!r}D as x, {y}*hy as y, {z}*hz as z)")
    return box.select("mesh_id", F.expr(f"inline(array({', '.join(rows)}))"))


def turned(vertices: DataFrame) -> DataFrame:
    """Vertices rotated by ``TURN``."""
    at = [" + ".join(f"{float(TURN[i, j])!r}D * {c}" for j, c in enumerate("xyz")) for i in range(3)]
    return vertices.select(*(c for c in vertices.columns if c not in "xyz"), *(F.expr(v).alias(c) for c, v in zip("xyz", at)))


def _tessellation(m: int) -> tuple[dict[tuple[int, int, int], int], list[tuple[int, int, int]]]:
    """Numbers of the vertices, by their steps along the sides, and faces."""
    lookup = {(x, y, z): None for x in range(m + 1) for y in range(m + 1) for z in range(m + 1) if {x, y, z} & {0, m}}
    names = {p: i for i, p in enumerate(lookup, 1)}
    faces = []
    for a in range(3):
        u, v = (a + 1) % 3, (a + 2) % 3
        for side in (0, m):
            for i in range(m):
                for j in range(m):
                    square = []
                    for x, y in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)):
                        p = [0, 0, 0]
                        p[a], p[u], p[v] = side, x, y
                        square.append(names[tuple(p)])
                    square = square if side else square[::-1]
                    faces += [(square[0], square[1], square[2]), (square[0], square[2], square[3])]
    return names, faces


def tessellated(box: DataFrame, m: int) -> tuple[DataFrame, DataFrame]:
    """The clean box with every side cut into ``m`` x ``m`` squares of two triangles."""
    names, faces = _tessellation(m)
    at = lambda k: f"{2 * k / m - 1!r}D"
    v = ", ".join(f"struct({n}L as vertex_id, {at(x)} as x, {at(y)} as y, {at(z)} as z)" for (x, y, z), n in names.items())
    f = ", ".join(f"struct({i}L as face_id, {a}L as a, {b}L as b, {c}L as c)" for i, (a, b, c) in enumerate(faces, 1))
    vertices = box.select("mesh_id", "hx", "hy", "hz", F.expr(f"inline(array({v}))")).selectExpr("mesh_id", "vertex_id", "x*hx as x", "y*hy as y", "z*hz as z")
    return vertices, box.select("mesh_id", F.expr(f"inline(array({f}))"))


def tessellated_rows(box: DataFrame, m: int) -> DataFrame:
    """The same as rows of ``batches.gathered``. Boxes are dealt and put in order before they are written
    out, so that a mesh's rows come out together and none of them is shuffled or sorted."""
    names, faces = _tessellation(m)
    rows = [(0, i, *(2 * k / m - 1 for k in place)) for place, i in names.items()] + [(1, i, *map(float, f)) for i, f in enumerate(faces, 1)]
    rows = ", ".join(f"struct({part} as part, {i}L as id, {p!r}D as p, {q!r}D as q, {r!r}D as r)" for part, i, p, q, r in rows)
    made = dealt(box.select(F.col("mesh_id").cast("long"), "hx", "hy", "hz")).select("*", F.expr(f"inline(array({rows}))"))
    return made.selectExpr("mesh_id", "part", "id", *(f"if(part = 0, {k}*h{c}, {k}) as {k}" for k, c in zip("pqr", "xyz")))


def box_welded(box: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clean box: 8 vertices and 12 outward faces, about the origin."""
    v = ", ".join(f"struct({i}L as vertex_id, {x}*hx as x, {y}*hy as y, {z}*hz as z)" for i, (x, y, z) in enumerate(CORNERS, 1))
    f = ", ".join(f"struct({i}L as face_id, {a + 1}L as a, {b + 1}L as b, {c + 1}L as c)" for i, (a, b, c) in enumerate(FACES, 1))
    return box.select("mesh_id", F.expr(f"inline(array({v}))")), box.select("mesh_id", F.expr(f"inline(array({f}))"))


#: The same in SQL: ``box``, ``corner``, ``face``, ``soup`` (moved) and ``tri`` (clean, about the origin).
_corner = ", ".join(f"({i}, {x}, {y}, {z})" for i, (x, y, z) in enumerate(CORNERS))
_face = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(FACES, 1))
SQL_BOX = f"""box as (select p_partkey as mesh_id, {HALF}, (p_size%5)*0.25e0 as tx, p_partkey%4 as kind from part where p_partkey is not null and p_size is not null),
corner(c, sx, sy, sz) as (values {_corner}),
face(face_id, a, b, c) as (values {_face})"""
SQL_SOUP = f"""{SQL_BOX},
turned as (select box.*, f.face_id, f.a, case when kind = 2 or (kind = 1 and f.face_id in (2, 7, 11)) then f.c else f.b end as b,
  case when kind = 2 or (kind = 1 and f.face_id in (2, 7, 11)) then f.b else f.c end as c from box, face f),
soup as materialized (select mesh_id, t.face_id, 3*(t.face_id-1)+k.k+1 as vertex_id, c.sx*hx + tx as x, c.sy*hy as y, c.sz*hz as z
  from turned t, (values (0), (1), (2)) k(k) join corner c on c.c = case k.k when 0 then t.a when 1 then t.b else t.c end)"""
_copy = ", ".join(f"({f + 1}, {k}, {c}, {COPY[f, c]})" for f, face in enumerate(FACES) for k, c in enumerate(face))
SQL_CHAIN = f"""{SQL_BOX},
copy(face_id, k, c, r) as (values {_copy}),
chain as materialized (select mesh_id, 3*(face_id-1)+k+1 as vertex_id, copy.c, r, sx*hx + r*{STEP!r} as x, sy*hy as y, sz*hz as z from box, copy join corner on corner.c = copy.c)"""
SQL_TRI = f"""{SQL_BOX},
tri as (select mesh_id, hx, hy, hz, f.face_id as tri_id, p.sx*hx as ax, p.sy*hy as ay, p.sz*hz as az,
  (q.sx-p.sx)*hx as abx, (q.sy-p.sy)*hy as aby, (q.sz-p.sz)*hz as abz, (r.sx-p.sx)*hx as acx, (r.sy-p.sy)*hy as acy, (r.sz-p.sz)*hz as acz
  from box, face f join corner p on p.c = f.a join corner q on q.c = f.b join corner r on r.c = f.c)"""
