"""Near duplicates by SimHash and anchor-point covering.

A fingerprint's 64 bits are two halves of 32. If two fingerprints differ in at most 3 bits, one half
differs in at most 1. In each half the anchors are the words of a covering code: the perfect Hamming
code [31, 26] of covering radius 1, times the free 32nd bit. A fingerprint is at home at its nearest
anchor and is replicated to every anchor within radius plus threshold: 1 + 1 in the code's bits
(one or 16 anchors) or 1 with the free bit turned. So the home of one of two linked fingerprints
always meets a replica of the other. Distinct fingerprints are compared, not documents, so copies
cost nothing; an anchor emits links that span what it connects rather than all pairs. The fingerprints
of an anchor with more than ``BLOCK`` are dealt into parts by hash, and every pair of parts is a group
of its own, so that no task holds more than two parts of one anchor.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; texts of
fewer than ``words`` words hash as a whole; of very long texts every shingle counts, bits being added
up 65,536 shingles at a time; a bit set in exactly half the shingles is 0; repeated rows share fingerprint and component; a null id
never names a component unless all ids in it are null; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import flat, with_row_key
from meshlark.operators.graph import connected_components
from meshlark.storage import checkpoint

SEED, WORDS, MOST = 42, 3, 3
LONG_RUN = 96
BLOCK = 1024


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority of the bits of XXH64 (seed 42) over the word shingles of ASCII-lower-cased text."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    n = len(shingles)
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        total += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


digest = xxhash.xxh64_intdigest


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, th, fp`` (signed longs), one row a document; ``th`` is the hash of its text."""

    def run(batches):
        for batch in batches:
            raw, off = flat(batch.column("text"))
            data = raw.tobytes()
            got = np.fromiter((fingerprint(data[off[i] : off[i + 1]], words) for i in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(got.view(np.int64))], ["doc_id", "th", "fp"])

    return with_row_key(docs, id_col, text_col).mapInArrow(run, "doc_id long, th long, fp long")


def _syndromes() -> np.ndarray:
    """Of the four bytes of a half: XOR of the numbers 1..31 of the bits set (bit 32 has none)."""
    place = np.array([*range(1, 32), 0], np.uint8)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, place[8 * b : 8 * b + 8], 0).astype(np.uint8), axis=1) for b in range(4)])


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 32-bit halves: ``(index, anchor)`` of each replica, the home anchors first."""
    half = half.astype(np.uint32)
    t = _syndromes()
    s = t[0][half & 255] ^ t[1][(half >> 8) & 255] ^ t[2][(half >> 16) & 255] ^ t[3][half >> 24]
    bit = np.concatenate(([0], 1 << np.arange(31, dtype=np.uint64), [0])).astype(np.uint32)
    near = half ^ bit[s]
    i = np.arange(len(half))
    index, anchor = [i, i], [near, near ^ np.uint32(1 << 31)]
    off = np.flatnonzero(s)
    for a in range(1, 32):
        b = s[off] ^ a
        use = b > a  # each pair of bits with this sum once; a itself being the sum gives b = 0
        rows = off[use]
        index.append(rows)
        anchor.append(half[rows] ^ bit[a] ^ bit[b[use]])
    return np.concatenate(index), np.concatenate(anchor)


def _replicas(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for k, half in enumerate((fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))):
            i, a = anchors(half)
            yield pa.RecordBatch.from_arrays([pa.array((a.astype(np.int64) << 1) | k), pa.array(fp[i].view(np.int64))], ["anchor", "fp"])


def _spanning(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that span what the members of one anchor connect, by search from each in turn."""
    left = np.arange(len(fp))
    queue: list[int] = []
    out = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        x = queue.pop()
        close = np.bitwise_count(fp[left] ^ fp[x]) <= most
        got = left[close]
        out.extend((x, y) for y in got.tolist())
        queue.extend(got.tolist())
        left = left[~close]
    return out


def _links(most: int):
    def linked(a, fp):
        cut = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]))
        size = np.diff(cut)
        u, v = [], []
        short = np.repeat(size <= LONG_RUN, size)
        for s in range(1, int(min(size.max(initial=1), LONG_RUN))):
            i = np.flatnonzero((a[s:] == a[:-s]) & short[s:])
            i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= most]
            u.append(fp[i])
            v.append(fp[i + s])
        for k in np.flatnonzero(size > LONG_RUN):
            at = slice(cut[k], cut[k + 1])
            if pairs := _spanning(fp[at], most):
                x, y = np.array(pairs).T
                u.append(fp[at][x])
                v.append(fp[at][y])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["src", "dst"])

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            end = int(np.searchsorted(now[0], now[0][-1]))  # the last anchor may go on in the next batch
            if end:
                yield linked(*(x[:end] for x in now))
            held = [x[end:] for x in now]
        if held is not None and len(held[0]):
            yield linked(*held)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = MOST) -> DataFrame:
    """``doc_id, th, fp, component, component_id``: the smallest fingerprint and the smallest id
    reachable over links of ``most`` (at most 3) bits."""
    if not 0 <= most <= 3:
        raise ValueError("the cover holds for thresholds 0 to 3")
    rows = checkpoint(fingerprints(docs, id_col, text_col, words))
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    met = each.select("fp").mapInArrow(_replicas, "anchor long, fp long")
    size = met.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1").withColumnRenamed("anchor", "_anchor")
    met = met.join(size, F.col("anchor") == F.col("_anchor"), "left").drop("_anchor").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    many = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.xxhash64("anchor", F.least(k, "part"), F.greatest(k, "part")))
    met = met.select(F.explode(F.when(F.col("parts").isNull(), F.array("anchor")).otherwise(many)).alias("anchor"), "fp")
    met = met.repartition("anchor").sortWithinPartitions("anchor")
    links = met.mapInArrow(_links(most), "src long, dst long").distinct()
    part = checkpoint(connected_components(links)).withColumnRenamed("node", "fp")
    each = each.join(part, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = each.groupBy("component").agg(F.min("low").alias("component_id"))
    each = each.join(low, "component").select(F.col("fp").alias("_fp"), "component", "component_id")
    return rows.join(each, F.col("fp") == F.col("_fp")).drop("_fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, all columns, of which none is linked to another: of each group the row
    of smallest id stays (of equal ids that of least text hash, of equal texts that whose columns come
    first as JSON)."""
    found = near_duplicates(docs, id_col, text_col, words, most)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    stay = checkpoint(found.join(first.withColumnRenamed("component", "_c"), (F.col("component") == F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))).groupBy("doc_id", "th").agg(F.count("*").alias("same")))
    again = stay.where("same > 1").limit(1).count()
    stay = stay.select(F.col("doc_id").alias("_stay_id"), F.col("th").alias("_stay_th"))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("_stay_id")) & (key == F.col("_stay_th")))
    if again:  # rows equal in id and text: the same one of them whatever the partitioning
        order = Window.partitionBy("_stay_id", "_stay_th").orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
        kept = kept.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return kept.drop("_stay_id", "_stay_th")


def op2(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
