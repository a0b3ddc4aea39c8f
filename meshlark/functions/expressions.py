"""Scalar formulas as SQL text.

Each builder returns text that Spark and, through ``Dialect``, other engines accept; operators feed
it to ``F.expr`` so that everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    spark: bool = True

    def xor(self, a: str, b: str) -> str:
        return f"(({a}) ^ ({b}))" if self.spark else f"xor({a}, {b})"

    def shr(self, a: str, n: int) -> str:
        return f"shiftright({a}, {n})" if self.spark else f"(({a}) >> {n})"

    def div(self, a: str, b) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def trunc(self, a: str) -> str:
        """Truncation toward zero."""
        return f"cast({a} as bigint)" if self.spark else f"cast(trunc({a}) as bigint)"

    def even_round(self, a: str) -> str:
        return f"rint({a})" if self.spark else f"round_even({a}, 0)"


SPARK, DUCK = Dialect(), Dialect(False)
MASK = 4294967295

# The published constants of the 32-bit mixer and of the column key.
MIX_1, MIX_2 = 0x7FEB352D, 0x846CA68B
COLUMN_X, COLUMN_Y = 0x9E3779B9, 0x7F4A7C15


def mix_steps(x: str, d: Dialect = SPARK) -> list[str]:
    """The 32-bit mixer as steps, each on the value ``x`` that the one before it left, a bigint in
    [0, 2^32). The second product passes 2^63, so it is split."""
    return [
        f"(({d.xor(x, d.shr(x, 16))}) * {MIX_1} & {MASK})",
        d.xor(x, d.shr(x, 15)),
        f"((({x} & 65535) * {MIX_2} + (((({d.shr(x, 16)}) * {MIX_2}) & 65535) * 65536)) & {MASK})",
        d.xor(x, d.shr(x, 16)),
    ]


def u32_hash(x: str, d: Dialect = SPARK) -> str:
    """The mixer as one text; it doubles at each step, so operators use ``hashed`` instead."""
    for k in range(4):
        x = mix_steps(x, d)[k]
    return x


def staged(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that are computed once. Filters are pushed below a projection with its expressions put in
    for their names, which multiplies long ones; below a generator of one row they are not."""
    return rows.select("*", F.inline(F.array(F.struct(*(F.expr(v).alias(k) for k, v in columns.items())))))


def hashed(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Columns with the mixed keys, a projection a step: each step names its input more than once, so
    Catalyst keeps them apart and the generated code stays short."""
    rows = rows.withColumns({name: F.expr(key) for name, key in keys.items()})
    for k in range(4):
        rows = rows.withColumns({name: F.expr(mix_steps(name)[k]) for name in keys})
    return rows


def draw_key(mesh: str, sample: str, draw: int) -> str:
    return f"((cast({mesh} as bigint) * 2654435761 + cast({sample} as bigint) * 2246822519 + {draw * 3266489917}) & {MASK})"


def uniform(mesh: str, sample: str, draw: int, d: Dialect = SPARK) -> str:
    """Counter-based uniform in (0, 1): the hash of (mesh, sample, draw), centred."""
    return f"(({u32_hash(draw_key(mesh, sample, draw), d)} + 0.5e0) / 4294967296e0)"


def with_uniforms(rows: DataFrame, mesh: str, sample: str, draws: dict[str, int]) -> DataFrame:
    """The same as columns, one a draw."""
    rows = hashed(rows, {name: draw_key(mesh, sample, k) for name, k in draws.items()})
    return rows.withColumns({name: F.expr(f"({name} + 0.5e0) / 4294967296e0") for name in draws})


def column_key(ix: str, iy: str) -> str:
    return f"((cast({ix} as bigint) * {COLUMN_X} + cast({iy} as bigint) * {COLUMN_Y}) & {MASK})"


def offsets(h: str, mag: str, d: Dialect = SPARK) -> tuple[str, str]:
    """Offsets in x and y of the ray of a column, from its mixed key: the low and high 16 bits."""
    return f"((({h}) & 65535) / 65535e0 - 0.5e0) * {mag}", f"(({d.shr(h, 16)} & 65535) / 65535e0 - 0.5e0) * {mag}"


def jitter(ix: str, iy: str, mag: str, d: Dialect = SPARK) -> tuple[str, str]:
    return offsets(u32_hash(column_key(ix, iy), d), mag, d)


#: Dot products of a point with a triangle, from columns px..pz, ax..az, abx.., acx..; stage for ``DISTANCE2``.
DOTS = {
    "ap2": "(px-ax)*(px-ax)+(py-ay)*(py-ay)+(pz-az)*(pz-az)",
    "p1": "(px-ax)*abx+(py-ay)*aby+(pz-az)*abz",
    "p2": "(px-ax)*acx+(py-ay)*acy+(pz-az)*acz",
    "e": "abx*abx+aby*aby+abz*abz",
    "f": "abx*acx+aby*acy+abz*acz",
    "g": "acx*acx+acy*acy+acz*acz",
}

#: Squared distance by the Voronoi region of the closest point: three corners, three edges, face.
#: With p1, p2 the products of AP with AB and AC, those of BP and CP follow by subtraction.
DISTANCE2 = """greatest(0e0, case
 when p1 <= 0 and p2 <= 0 then ap2
 when p1 - e >= 0 and p2 - f <= p1 - e then ap2 - 2*p1 + e
 when p2 - g >= 0 and p1 - f <= p2 - g then ap2 - 2*p2 + g
 when p1*(p2 - f) - (p1 - e)*p2 <= 0 and p1 >= 0 and p1 - e <= 0 then ap2 - p1*p1/e
 when (p1 - f)*p2 - p1*(p2 - g) <= 0 and p2 >= 0 and p2 - g <= 0 then ap2 - p2*p2/g
 when (p1 - e)*(p2 - g) - (p1 - f)*(p2 - f) <= 0 and (p2 - f) - (p1 - e) >= 0 and (p1 - f) - (p2 - g) >= 0
  then ap2 - 2*p1 + e - ((p2 - f) - (p1 - e))*((p2 - f) - (p1 - e))/(e - 2*f + g)
 else ap2 - (g*p1*p1 - 2*f*p1*p2 + e*p2*p2)/(e*g - f*f) end)"""


def top_left(dx: str, dy: str) -> str:
    return f"(({dy}) > 0 or (({dy}) = 0 and ({dx}) < 0))"


def edge_flags() -> str:
    """Ownership bits of the edges u=0 (1), v=0 (2) and w=0 (4), from abx, aby, acx, acy."""
    s = "(case when aby*acx - abx*acy < 0 then 1e0 else -1e0 end)"
    own = (top_left(f"-{s}*acx", f"-{s}*acy"), top_left(f"{s}*abx", f"{s}*aby"), top_left(f"{s}*(acx-abx)", f"{s}*(acy-aby)"))
    return " + ".join(f"(case when {o} then {1 << i} else 0 end)" for i, o in enumerate(own))


def coordinate(i: str, n: int) -> str:
    """Node ``i`` (from 1) of ``n`` on [-1, 1]."""
    return f"(-1e0 + ({i} - 1) * 2e0 / {n - 1})"


def voxel(x: str, n: int, d: Dialect = SPARK) -> str:
    """Index of the node at or below, truncating toward zero."""
    return f"({d.trunc(f'(({x}) + 1e0) / (2e0 / {n - 1})')} + 1)"


# Coefficients, highest power first, of Hart's rational form of the normal distribution
# (as West gives it in double precision) and of Acklam's of its inverse (centre and tail).
CDF_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
INVERSE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INVERSE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
INVERSE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INVERSE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def _number(x: float) -> str:
    return repr(x) if "e" in repr(x) else f"{x!r}e0"


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def normal_cdf(x: str) -> str:
    """Standard normal distribution of a column (stage its value first: the name is used often)."""
    y = f"abs({x})"
    near = f"{polynomial(y, CDF_P)} / {polynomial(y, CDF_Q)}"
    far = f"1e0 / ({y} + 1e0 / ({y} + 2e0 / ({y} + 3e0 / ({y} + 4e0 / ({y} + 0.65e0))))) / 2.506628274631e0"
    below = f"exp(-0.5e0 * {x} * {x}) * (case when {y} < 7.07106781186547e0 then {near} else {far} end)"
    return f"(case when {x} > 0 then 1e0 - {below} else {below} end)"


def normal_quantile(p: str) -> str:
    """Inverse of the standard normal distribution at a column in (0, 1), to nine digits."""
    r = f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    tail = lambda q: f"{polynomial(q, INVERSE_C)} / {polynomial(q, INVERSE_D)}"
    low, high = (tail(f"sqrt(-2e0 * ln({x}))") for x in (p, f"(1e0 - {p})"))
    centre = f"({p} - 0.5e0) * {polynomial(r, INVERSE_A)} / {polynomial(r, INVERSE_B)}"
    return f"(case when {p} < {TAIL}e0 then {low} when {p} > {1 - TAIL}e0 then -({high}) else {centre} end)"


def tidy(x: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"(round({x}, {digits}) + 0e0)"


def box_distance(x: str, y: str, z: str) -> str:
    """Signed distance to the box of half-extents hx, hy, hz about the origin."""
    q = [f"(abs({c}) - {h})" for c, h in ((x, "hx"), (y, "hy"), (z, "hz"))]
    out = " + ".join(f"greatest({c}, 0e0) * greatest({c}, 0e0)" for c in q)
    return f"(sqrt({out}) + least(greatest({', '.join(q)}), 0e0))"
