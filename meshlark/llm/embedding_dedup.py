"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of the vectors of each length gives the reference points, chosen farthest first;
vectors of different lengths are never compared. There are as many as ``GROWTH`` times the square root
of the number of vectors (from ``PIVOTS`` to ``MOST``), so that the lists, of which there are about
half its square, stay as long as they are. A vector is described by the ordered list of its ``PREFIX``
nearest references; inverted lists hold vectors by label and by every ``SHARED`` references of that
prefix, so two vectors meet exactly if they share so many; every vector is indexed. A pair that meets
in several lists counts in one, that of its least shared references, and is verified by its cosine in
double precision. Lists carry the vectors: pairs of ids, to be joined with vectors later, would be some
hundred a vector.

Equal vectors of one label are one class; only classes are compared. Lists over ``BLOCK`` classes are
cut into salted parts, and pairs of parts are separate groups of bounded size. Large groups emit
counts and links that span what they connect, not all pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing, as
do rows of null label; a null id has no component and is
not kept; of references equally near the one chosen first counts as nearer; rows of equal id are vectors of their own in the counts and one node in the components;
extra columns are passed over; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.sampling import bounded_sample
from meshlark.operators.graph import connected_components
from meshlark.storage import checkpoint

SAMPLE, PIVOTS, MOST, GROWTH, PREFIX, SHARED, BLOCK = 2048, 32, 512, 0.6, 7, 2, 1024
LEAST, SHORT, ROWS = 0.93, 24, 4096
APART = 0.8
DIGIT = np.int64(9)  # bits of a reference's number


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # squares of large components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivot_count(vectors: int) -> int:
    return min(MOST, max(PIVOTS, int(np.ceil(GROWTH * vectors**0.5))))


def references(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first choice among unit vectors, from the first row on. Past the first ``PIVOTS`` it
    ends where all that is left has a reference within ``APART``: among references as near as that,
    whose order noise would decide, close vectors would share too few."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        if len(chosen) >= PIVOTS and near.min() >= APART:
            break
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def prefixes(x: np.ndarray, pivots: np.ndarray, size: int = PREFIX) -> np.ndarray:
    """The ``size`` nearest references of each unit vector, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :size]


def packed(numbers: np.ndarray) -> np.ndarray:
    """Rows of rising reference numbers as one integer each, the first in the lowest digit."""
    out = np.zeros(len(numbers), np.int64)
    for k in range(numbers.shape[1]):
        out |= numbers[:, k].astype(np.int64) << DIGIT * k
    return out


def unpacked(own: np.ndarray, size: int) -> np.ndarray:
    return own[..., None] >> DIGIT * np.arange(size) & ((1 << DIGIT) - 1)


def list_keys(prefix: np.ndarray, shared: int = SHARED) -> np.ndarray:
    """Of each vector, the keys of all sets of ``shared`` references in its prefix."""
    rising = np.sort(prefix, axis=1)
    return np.stack([packed(rising[:, list(c)]) for c in combinations(range(prefix.shape[1]), min(shared, prefix.shape[1]))], axis=1)


def first_shared(a: np.ndarray, b: np.ndarray, size: int, shared: int) -> np.ndarray:
    """The key of the ``shared`` least references that two packed prefixes have in common."""
    x, y = unpacked(a, size), unpacked(b, size)
    common = (x[..., :, None] == y[..., None, :]).any(axis=-1)
    place = np.cumsum(common, axis=-1)
    return np.where(common & (place <= shared), x << DIGIT * np.maximum(place - 1, 0), 0).sum(axis=-1)


def stacked(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def widths(column: pa.Array, kind) -> np.ndarray:
    """The number of components of each packed vector."""
    return np.fromiter(map(len, column.to_pylist()), np.int32, len(column)) // np.dtype(kind).itemsize


def _index(pivots: dict[int, np.ndarray], shared: int, kind):
    """Rows of every list; ``pivots`` holds the references by length."""

    def run(batches):
        for whole in batches:
            width = widths(whole.column("v"), kind)
            for w in np.unique(width).tolist():
                batch = whole.filter(pa.array(width == w))
                x = unit(stacked(batch.column("v"), w, kind))
                prefix = prefixes(x, pivots[w])
                keys, own = list_keys(prefix, shared), packed(np.sort(prefix, axis=1))
                for at in range(0, len(x), ROWS):
                    part = keys[at : at + ROWS]
                    row = pa.array(np.repeat(np.arange(at, at + len(part)), part.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("label", "cid", "vh", "mult", "v")), pa.array(np.full(len(row), w, np.int32)), pa.array(own).take(row), pa.array(part.ravel())], ["label", "cid", "vh", "mult", "v", "width", "own", "list"])

    return run


def _compare(size: dict[int, int], shared: int, least: float, kind):
    """Verify the pairs of each run of equal ``width, label, list, pa, pb``: ``(cid, vh, links, dst)`` rows.
    ``size`` is, by length, how many references a prefix has; calls take vectors of one length."""

    def here(d, a, b):
        """Whether a pair is counted in this list and in this pair of its parts."""
        many = size[int(d["width"][0])]
        return (first_shared(d["own"][a], d["own"][b], many, min(shared, many)) == d["list"][a]) & ((d["pa"][a] == d["pb"][a]) | (d["part"][a] != d["part"][b]))

    def pairs_small(d, x, a, b):
        """Pairs that are verified and counted here."""
        keep = np.einsum("ij,ij->i", x[a], x[b]) >= least
        a, b = a[keep], b[keep]
        keep = here(d, a, b)
        return a[keep], b[keep]

    def large(d, x, s, e):
        """Counts and spanning links of one run."""
        n = e - s
        close = np.zeros((n, n), bool)
        for i in range(0, n, 512):
            close[i : i + 512] = x[s + i : min(s + i + 512, e)] @ x[s:e].T >= least
        np.fill_diagonal(close, False)
        label = np.arange(n)
        while True:
            low = np.minimum(label, np.where(close, label[None, :], n).min(axis=1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        counted = np.zeros(n, np.int64)
        for i in range(0, n, 64):
            a, b = np.nonzero(close[i : i + 64])
            a, b = a + (s + i), b + s
            keep = here(d, a, b)
            np.add.at(counted, a[keep] - s, d["mult"][b[keep]])
        return counted, label

    def made(d):
        x = unit(d["v"])
        n = len(x)
        edge = np.flatnonzero(np.any([d[c][1:] != d[c][:-1] for c in ("label", "list", "pa", "pb")], axis=0)) + 1 if n else np.zeros(0, int)
        cut = np.concatenate(([0], edge, [n]))
        size = np.diff(cut)
        group = np.repeat(np.arange(len(size)), size)
        cid, vh, add, dst = [], [], [], []
        few = size[group] <= SHORT
        for s in range(1, int(min(size.max(initial=1), SHORT))):
            a = np.flatnonzero((group[s:] == group[:-s]) & few[s:])
            a, b = pairs_small(d, x, a, a + s)
            cid += [d["cid"][a], d["cid"][b]]
            vh += [d["vh"][a], d["vh"][b]]
            add += [d["mult"][b], d["mult"][a]]
            dst += [d["cid"][b], d["cid"][a]]
        for g in np.flatnonzero(size > SHORT):
            s, e = int(cut[g]), int(cut[g + 1])
            counted, label = large(d, x, s, e)
            some = np.flatnonzero((counted > 0) | (label != np.arange(e - s)))
            cid.append(d["cid"][s + some])
            vh.append(d["vh"][s + some])
            add.append(counted[some])
            dst.append(d["cid"][s + label[some]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (cid, vh, add, dst)], ["cid", "vh", "links", "dst"])

    names = ("width", "label", "list", "pa", "pb", "part", "cid", "vh", "mult", "own")

    def pieces(batches):
        """Rows as they come, at most ``ROWS`` of one length at a time."""
        for batch in batches:
            width = batch.column("width").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(width[1:] != width[:-1]) + 1).tolist(), len(width)]
            for s, e in zip(cut, cut[1:]):
                for at in range(s, e, ROWS):
                    yield batch.slice(at, min(ROWS, e - at))

    def run(batches):
        held = None
        for part in pieces(batches):
            now = {c: part.column(c).to_numpy(zero_copy_only=False) for c in names}
            now["v"] = stacked(part.column("v"), int(now["width"][0]), kind)
            if held is not None and held["width"][0] != now["width"][0]:
                yield made(held)
                held = None
            if held is not None:
                now = {c: np.concatenate((held[c], now[c])) for c in now}
            last = np.all([now[c] == now[c][-1] for c in ("label", "list", "pa", "pb")], axis=0)
            end = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if end:
                yield made({c: v[:end] for c, v in now.items()})
            held = {c: v[end:] for c, v in now.items()}
        if held is not None:
            yield made(held)

    return run


def learn(rows: DataFrame) -> dict[int, np.ndarray]:
    """References by length, for every length of ``rows(vec_id, e)``: a bounded sample a length (a small
    job each)."""
    found = {}
    for r in rows.groupBy(F.size("e").alias("width")).count().orderBy("width").collect():
        sample = [x["e"] for x in bounded_sample(rows.where(F.size("e") == r["width"]), "vec_id", SAMPLE).collect()]
        found[r["width"]] = references(unit(np.array(sample)), pivot_count(r["count"]))
    return found


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, shared: int = SHARED) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row a vector."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("e"), F.col(label_col).cast("long").alias("label"))
    x = F.col("e")
    finite = F.forall(x, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    good = F.coalesce(x.isNotNull() & finite & F.exists(x, lambda y: y != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("good", good).withColumn("vh", F.when(F.col("good"), F.xxhash64("label", "e")))
    pivots = learn(rows.where("good").select("vec_id", "e"))
    classes = rows.where("good").groupBy("label", "e", "vh").agg(F.min("vec_id").alias("cid"), F.count("*").alias("mult"))
    held = classes.select("label", "cid", "vh", "mult", "e").mapInArrow(_pack(kind), "label long, cid long, vh long, mult long, v binary")
    held = checkpoint(held)
    lists = held.mapInArrow(_index(pivots, shared, kind), "label long, cid long, vh long, mult long, v binary, width int, own long, list long")
    keys = held.mapInArrow(_index(pivots, shared, kind), "label long, cid long, vh long, mult long, v binary, width int, own long, list long").groupBy("width", "label", "list").agg(F.count("*").alias("n")).where("n > 1")
    keys = keys.select(F.col("width").alias("_width"), F.col("label").alias("_label"), F.col("list").alias("_list"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    lists = lists.join(keys, (F.col("width") == F.col("_width")) & (F.col("label") == F.col("_label")) & (F.col("list") == F.col("_list"))).drop("_width", "_label", "_list")
    part = F.pmod(F.xxhash64("cid", "vh"), F.col("parts")).cast("int")
    lists = lists.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lists = lists.withColumn("pa", F.least("part", "other")).withColumn("pb", F.greatest("part", "other")).drop("other", "parts")
    group = ["width", "label", "list", "pa", "pb"]
    met = lists.repartition(*group).sortWithinPartitions(*group)
    found = checkpoint(met.mapInArrow(_compare({w: min(PREFIX, len(x)) for w, x in pivots.items()}, shared, least, kind), "cid long, vh long, links long, dst long"))
    degree = found.groupBy("cid", "vh").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("cid <> dst").select("cid", "dst").distinct(), "cid", "dst")
    out = rows.join(classes.select(F.col("label").alias("l2"), F.col("vh").alias("v2"), F.col("e").alias("e2"), "cid", "mult"), (F.col("label") == F.col("l2")) & (F.col("vh") == F.col("v2")) & (F.col("e") == F.col("e2")), "left")
    out = out.select("vec_id", "vh", "cid", "mult").join(degree.withColumnsRenamed({"cid": "c3", "vh": "v3"}), (F.col("cid") == F.col("c3")) & (F.col("vh") == F.col("v3")), "left")
    out = out.join(parts, F.col("cid") == F.col("node"), "left")
    component = F.coalesce("component", "cid", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("mult", F.lit(1)) - 1).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _pack(kind):
    def run(batches):
        for batch in batches:
            e = batch.column("e")
            off = e.offsets.to_numpy()
            data = e.values.to_numpy(zero_copy_only=False).astype(kind)
            v = [data[off[i] : off[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("label", "cid", "vh", "mult")] + [pa.array(v, pa.binary())], ["label", "cid", "vh", "mult", "v"])

    return run


def op9(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = f"""
with recursive e as (select vec_id, label, embedding::double[] as v from embeddings),
link as (select a, b from (select x.vec_id as a, y.vec_id as b, list_cosine_similarity(x.v, y.v) as c from e x join e y on x.label = y.label and x.vec_id <> y.vec_id) where not isnan(c) and c >= {LEAST}),
reach(a, b) as (select vec_id, vec_id from e union select r.a, l.b from reach r join link l on l.a = r.b),
low as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from e join low on low.a = vec_id left join n on n.a = vec_id
"""
