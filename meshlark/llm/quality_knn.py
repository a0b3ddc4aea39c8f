"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are hashed into bins: lower-cased words, four-character shapes (letters to ``a`` or ``A``,
digits to ``0``, the rest as it is) and how often words recur. Counts are damped and weighted by
inverse document frequency, and projected on the leading right singular vectors of the sample. Every
document is then compared with every labelled vector by exact cosine products in blocks, and its
``NEIGHBOURS`` nearest vote with weights that grow with similarity.

Learning takes at most ``SAMPLE`` labelled rows outside the held-out quarter (those of least id
hash); their vectors (``SAMPLE`` x ``DIMENSIONS`` floats) are broadcast. Only text is an input.

Defined cases: null and blank texts score 0; without labelled rows every score is 0; very long texts count whole,
in memory in proportion to their words; a document labelled twice counts with its lower label; of
neighbours equally similar at the last place some vote, the same in every run; rows of equal id are documents of their own; extra
columns are passed over; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import flat, held_out
from meshlark.llm.sampling import bounded_sample

SAMPLE, DIMENSIONS, NEIGHBOURS, POWER, BLOCK = 4000, 64, 31, 6, 512
WORD_BINS, SHAPE_BINS, COUNT_BINS = 512, 512, 16
BINS = WORD_BINS + SHAPE_BINS + COUNT_BINS
THRESHOLD = 0.7


def shape_table() -> np.ndarray:
    """Byte classes: letters and bytes over 127 to ``a`` or ``A``, digits to ``0``, blanks to a blank."""
    table = np.arange(256, dtype=np.uint32)
    table[97:123] = table[128:] = 97
    table[65:91] = 65
    table[48:58] = 48
    table[9:14] = 32
    return table


SHAPES = shape_table()


def bins(text: bytes) -> np.ndarray:
    """Damped counts of the hashed terms of one text."""
    out = np.zeros(BINS, np.float32)
    words = text.lower().split()
    if not words:
        return out
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    count = np.fromiter(seen.values(), np.int64, len(seen))
    place = np.fromiter((zlib.crc32(w) for w in seen), np.int64, len(seen)) % WORD_BINS
    n = len(words)
    np.add.at(out, place, (np.log1p(count) / np.log1p(n)).astype(np.float32))
    s = SHAPES[np.frombuffer(text, np.uint8)]
    if len(s) >= 4:
        code = (s[:-3] | (s[1:-2] << np.uint32(8)) | (s[2:-1] << np.uint32(16)) | (s[3:] << np.uint32(24))) * np.uint32(2654435761)
        shapes = np.bincount(code >> np.uint32(32 - SHAPE_BINS.bit_length() + 1), minlength=SHAPE_BINS) / len(s)
        out[WORD_BINS : WORD_BINS + SHAPE_BINS] = np.log1p(1000 * shapes)
    times = np.minimum(np.log2(count).astype(np.int64), COUNT_BINS - 1)
    out[WORD_BINS + SHAPE_BINS :] = 4 * np.bincount(times, weights=count, minlength=COUNT_BINS) / n
    return out


class Voter:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        """``x``: bins of the labelled rows, ``y``: labels 0 and 1."""
        self.prior = float(y.mean()) if len(y) else 0.0
        if not len(y):
            self.vectors = None
            return
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        self.scale = 1 / np.maximum(np.sqrt((x * self.idf).var(axis=0)), 0.05)
        self.mean = (x * self.idf * self.scale).mean(axis=0)
        z = x * self.idf * self.scale - self.mean
        q = np.random.default_rng(0).standard_normal((BINS, min(DIMENSIONS + 16, BINS))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(z.T @ (z @ q))
        _, _, v = np.linalg.svd(z @ q, full_matrices=False)
        self.basis = (q @ v.T)[:, :DIMENSIONS].astype(np.float32)
        self.vectors, self.labels = self.place(x), y.astype(np.float32)

    def place(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf * self.scale - self.mean) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        some = x.any(axis=1)
        if self.vectors is None:
            return np.zeros(len(x))
        near = self.place(x) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 1e-3).astype(np.float64) ** POWER
        got = (weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1)
        return np.where(some, np.clip(got, 0, 1), 0.0)


def blocks(column):
    """Bins of the texts, ``BLOCK`` rows at a time."""
    raw, off = flat(column)
    data = raw.tobytes()
    for at in range(0, len(off) - 1, BLOCK):
        yield at, np.stack([bins(data[off[i] : off[i + 1]]) for i in range(at, min(at + BLOCK, len(off) - 1))])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Voter:
    own = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("int").alias("y")).where("label_id is not null and y is not null")
    own = bounded_sample(own.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.min("y").alias("y")), "label_id", sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("label_id")).select("text", "y")

    def run(batches):
        for batch in batches:
            for at, x in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(at, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    found = bounded_sample(rows.mapInArrow(run, "y int, x binary"), "x", sample).toPandas()
    x = np.frombuffer(b"".join(map(bytes, found["x"])), np.float32).reshape(-1, BINS)
    return Voter(x, found["y"].to_numpy(np.int64) if len(found) else np.zeros(0, np.int64))


def score(docs: DataFrame, voter: Voter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(voter)

    def run(batches):
        for batch in batches:
            for at, x in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(x)), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op4(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
