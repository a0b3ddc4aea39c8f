"""Weights, draws, stratified samples and lookups over one box a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.functions.expressions import DUCK, box_distance, coordinate, normal_cdf, normal_quantile, tidy, uniform, with_uniforms
from meshlark.operators import sdf
from meshlark.operators import sampling as S
from meshlark.operators.batches import gathered
from meshlark.operators.mesh import triangles
from meshlark.plans.derived import SQL_BOX, SQL_TRI, box_welded, boxes

N, SAMPLES, KEPT = 8, 24, 5
#: Wide enough for many offsets to be cut off at the cube.
SIGMA = 0.8
PARAMETERS = S.SamplingParameters(samples=SAMPLES, resolution=N)


def _tri(spark, sf_dir):
    return triangles(*box_welded(boxes(spark, sf_dir)))


def area_weights(spark, sf_dir):
    return S.area_weights(_tri(spark, sf_dir)).selectExpr("mesh_id", "cast(tri_id as bigint) as tri_id", f"{tidy('weight')} as weight")


def area_cdf(spark, sf_dir):
    c = S.cumulated(S.area_weights(_tri(spark, sf_dir)), "mesh_id", "tri_id", "weight")
    return c.selectExpr("mesh_id", "cast(tri_id as bigint) as tri_id", f"{tidy('lo')} as lo", f"{tidy('hi')} as hi")


def weighted_draw(spark, sf_dir):
    """For every order, a line drawn with probability in proportion to its quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    cdf = S.cumulated(lines, "l_orderkey", "l_linenumber", "l_quantity")
    orders = with_uniforms(lines.select("l_orderkey").distinct(), "l_orderkey", "1", {"u": 0})
    got = S.draw(orders, cdf, "l_orderkey", "u", "l_linenumber")
    return got.select("l_orderkey", F.col("pick.l_linenumber").cast("long").alias("l_linenumber"))


def sample_strata(spark, sf_dir):
    return S.strata_table(spark, S.SamplingParameters()).selectExpr("stratum", "start", "stop", f"{tidy('sigma')} as sigma")


def surface_samples(spark, sf_dir):
    got = S.surface_samples(gathered(*box_welded(boxes(spark, sf_dir))), 1, SAMPLES)
    return got.selectExpr("mesh_id", "cast(sample_id as bigint) as sample_id", "cast(face as bigint) as face", *(f"{tidy(c)} as {c}" for c in "xyz"))


def near_surface_samples(spark, sf_dir):
    got = S.near_surface_samples(S.surface_samples(gathered(*box_welded(boxes(spark, sf_dir))), 1, SAMPLES), SIGMA)
    return got.selectExpr("mesh_id", "cast(sample_id as bigint) as sample_id", *(f"{tidy(c)} as {c}" for c in "xyz"))


def volume_samples(spark, sf_dir):
    return S.volume_samples(boxes(spark, sf_dir), 1, SAMPLES).selectExpr("mesh_id", "cast(sample_id as bigint) as sample_id", *(f"{tidy(c)} as {c}" for c in "xyz"))


def _with_distance(spark, sf_dir):
    points = S.volume_samples(boxes(spark, sf_dir), 1, SAMPLES)
    return S.field_lookup(*box_welded(boxes(spark, sf_dir)), points, N)


def trilinear_lookup(spark, sf_dir):
    return _with_distance(spark, sf_dir).selectExpr("mesh_id", "cast(sample_id as bigint) as sample_id", f"{tidy('sd', 5)} as sd")


def eikonal_subset(spark, sf_dir):
    rows = _with_distance(spark, sf_dir).withColumn("stratum", F.lit("volume"))
    return S.eikonal_subset(rows, 0.5, KEPT).selectExpr("mesh_id", "cast(sample_id as bigint) as sample_id")


def training_samples(spark, sf_dir):
    """All three strata of every mesh: surface at distance 0, band by sigma, volume; with distances."""
    tri = _tri(spark, sf_dir)
    got = S.mesh_samples(tri, sdf.fields(tri, N), PARAMETERS)
    return got.groupBy("mesh_id", "stratum").agg(F.count("*").alias("n"), F.avg(F.abs("sd")).alias("d")).selectExpr("mesh_id", "stratum", "n", f"{tidy('d', 5)} as d")


QUERIES = {f.__name__: f for f in (area_weights, area_cdf, weighted_draw, sample_strata, surface_samples, near_surface_samples, volume_samples, trilinear_lookup, eikonal_subset, training_samples)}

_AREA = "sqrt((aby*acz-abz*acy)*(aby*acz-abz*acy) + (abz*acx-abx*acz)*(abz*acx-abx*acz) + (abx*acy-aby*acx)*(abx*acy-aby*acx))"
_CDF = f"area as (select *, {_AREA} as area2 from tri), cdf as (select *, area2 / sum(area2) over (partition by mesh_id) as weight, (sum(area2) over (partition by mesh_id order by tri_id rows unbounded preceding)) / sum(area2) over (partition by mesh_id) as hi from area)"
_U = [uniform("mesh_id", "sample_id", k, DUCK) for k in range(3)]
_POINTS = f"""with {SQL_TRI}, {_CDF},
draws as (select mesh_id, sample_id, {', '.join(f'{u} as u{k}' for k, u in enumerate(_U))} from (select mesh_id, unnest(range(1, {SAMPLES + 1})) as sample_id from box)),
best as (select d.mesh_id, d.sample_id, d.u1, d.u2, min(c.tri_id) as face from draws d join cdf c on c.mesh_id = d.mesh_id and d.u0 < c.hi group by all),
pts as (select b.mesh_id, sample_id, face, {', '.join(f'a{c} + sqrt(u1)*(1-u2)*ab{c} + sqrt(u1)*u2*ac{c} as {c}' for c in 'xyz')} from best b join cdf c on c.mesh_id = b.mesh_id and c.tri_id = b.face)"""


def _near(sigma: str, source: str = "pts") -> str:
    """Points of ``source`` moved by a cut-off normal of width ``sigma``."""
    draws = ", ".join(f"{uniform('mesh_id', 'sample_id', 10 + i, DUCK)} as u{c}" for i, c in enumerate("xyz"))
    ends = ", ".join(f"({at} - {c}) / ({sigma}) as {e}{c}" for c in "xyz" for e, at in (("l", "-1e0"), ("h", "1e0")))
    shares = ", ".join(f"{normal_cdf(f'{e}{c}')} as p{e}{c}" for c in "xyz" for e in "lh")
    return f"""n1 as (select *, {draws}, {ends} from {source}), n2 as (select *, {shares} from n1), n3 as (select *, {', '.join(f'pl{c} + u{c} * (ph{c} - pl{c}) as q{c}' for c in 'xyz')} from n2),
near as (select * replace ({', '.join(f'greatest(-1e0, least(1e0, {c} + ({sigma}) * {normal_quantile(f"q{c}")})) as {c}' for c in 'xyz')}) from n3)"""


_VOLUME = f"vol as (select mesh_id, sample_id, {', '.join(f'2e0 * {u} - 1e0 as {c}' for u, c in zip(_U, 'xyz'))} from (select mesh_id, unnest(range(1, {SAMPLES + 1})) as sample_id from box))"
_F = {c: f"(({c} + 1e0) / (2e0 / {N - 1}) + 1e0)" for c in "xyz"}
_CELL = "cell as (select *, " + ", ".join(f"greatest(1, least({N - 1}, floor({_F[c]})::bigint)) as c{c}, {_F[c]} as f{c}" for c in "xyz") + " from vol join box using (mesh_id))"
_BLEND = " + ".join(
    "(" + " * ".join(f"(f{c} - c{c})" if o else f"(1 - (f{c} - c{c}))" for c, o in zip("xyz", (i, j, k))) + f") * {box_distance(*(coordinate(f'(c{c} + {o})', N) for c, o in zip('xyz', (i, j, k))))}"
    for i in (0, 1) for j in (0, 1) for k in (0, 1)
)
_STRATA = PARAMETERS.strata()
_OF = "case " + " ".join(f"when sample_id <= {stop} then '{stratum}'" for stratum, _, stop, _ in _STRATA) + " end"
_WIDTH = "case " + " ".join(f"when sample_id <= {stop} then {sigma!r}::double" for _, _, stop, sigma in _STRATA if sigma or stop == _STRATA[0][2]) + " else 1e0 end"
_SD = f"with {SQL_BOX}, {_VOLUME}, {_CELL}, sds as (select mesh_id, sample_id, {_BLEND} as sd from cell)"
ORACLES = {
    "area_weights": f"with {SQL_TRI}, {_CDF} select mesh_id, tri_id::bigint as tri_id, round(weight, 6) + 0e0 as weight from cdf",
    "area_cdf": f"with {SQL_TRI}, {_CDF} select mesh_id, tri_id::bigint as tri_id, round(hi - weight, 6) + 0e0 as lo, round(hi, 6) + 0e0 as hi from cdf",
    "weighted_draw": f"with c as (select l_orderkey, l_linenumber, sum(l_quantity) over (partition by l_orderkey order by l_linenumber rows unbounded preceding) / sum(l_quantity) over (partition by l_orderkey) as hi from lineitem) select l_orderkey, min(l_linenumber)::bigint as l_linenumber from c where {uniform('l_orderkey', '1', 0, DUCK)} < hi group by 1",
    "sample_strata": "select * from (values ('surface', 1::bigint, 26214::bigint, 0e0), ('band', 26215, 58327, 0.007843), ('band', 58328, 85852, 0.031373), ('band', 85853, 104202, 0.062745), ('band', 104203, 117965, 0.094118), ('volume', 117966, 131072, 0e0)) t(stratum, start, stop, sigma)",
    "surface_samples": f"{_POINTS} select mesh_id, sample_id, face::bigint as face, {', '.join(f'round({c}, 6) + 0e0 as {c}' for c in 'xyz')} from pts",
    "near_surface_samples": f"{_POINTS}, {_near(f'{SIGMA!r}::double')} select mesh_id, sample_id, {', '.join(f'round({c}, 6) + 0e0 as {c}' for c in 'xyz')} from near",
    "training_samples": f"{_POINTS}, {_near(_WIDTH, '(select * from pts where sample_id > %d)' % _STRATA[0][2])}, {_VOLUME.replace('vol as', 'cube as')}, vol as (select mesh_id, sample_id, x, y, z from cube where {_OF} = 'volume' union all select mesh_id, sample_id, x, y, z from near where {_OF} = 'band' union all select mesh_id, sample_id, x, y, z from pts where {_OF} = 'surface'), {_CELL} select mesh_id, {_OF} as stratum, count(*) as n, round(avg(case when {_OF} = 'surface' then 0 else abs({_BLEND}) end), 5) + 0e0 as d from cell group by 1, 2",
    "volume_samples": f"with {SQL_BOX}, {_VOLUME} select mesh_id, sample_id, {', '.join(f'round({c}, 6) + 0e0 as {c}' for c in 'xyz')} from vol",
    "trilinear_lookup": f"{_SD} select mesh_id, sample_id, round(sd, 5) + 0e0 as sd from sds",
    "eikonal_subset": f"{_SD} select mesh_id, sample_id from sds where abs(sd) > 0.5 qualify row_number() over (partition by mesh_id order by {uniform('mesh_id', 'sample_id', 99, DUCK)}, sample_id) <= {KEPT}",
}
