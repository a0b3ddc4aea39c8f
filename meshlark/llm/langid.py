"""Language identification by language-bitmask n-gram filters.

Features are letter trigrams of lower-cased words with their borders. One table of 64-bit masks is a
Bloom filter for every language at once (bit-sliced): an n-gram's slots are ANDed and the bits left
are the languages that have it. For each text the bits are counted per language, corrected for the
filter's false positives, and the language with most of the text's n-grams wins.

Learning takes at most ``SAMPLE`` training documents of each language (those of least id hash), whole
texts; an n-gram belongs to a language if it is in at least ``MIN_SHARE`` of its sampled documents.

Defined cases: null text and texts without a letter are ``und`` with score 0; if no n-gram is known
the most frequent language is given with score 0; ties go to the more frequent language, then by
name; with no training rows everything is ``und``; of very long texts every n-gram counts; rows of equal id are documents of their own;
extra columns are passed over; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.bpe import portions
from meshlark.llm.common import held_out, keep_schema, narrowed, restored

SAMPLE, MIN_SHARE, PROBES, LOAD = 2000, 0.01, 3, 12
#: A text is rejected (``accepted`` false) if less than this share of its n-grams is known for the language found.
MIN_KNOWN = 0.25
K = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact 63-bit codes of all trigrams, the text each belongs to, and which texts have a letter."""
    low = [t.lower() for t in many]
    data = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low)) + 1
    isl = letters()[data]
    text = np.concatenate((np.repeat(np.arange(len(low)), size), [len(low) - 1])) if low else np.zeros(0, np.int64)
    text = np.concatenate(([0], text))[: len(data)]
    some = np.bincount(text[isl], minlength=len(low)) > 0
    keep = isl.copy()
    keep[1:] |= isl[:-1]
    keep[0] = True
    c, text = np.where(isl, data, 32)[keep].astype(np.uint64), text[keep]
    mid = c[1:-1] != 32
    code = (c[:-2] | (c[1:-1] << np.uint64(21)) | (c[2:] << np.uint64(42)))[mid]
    return code, text[1:-1][mid], some


def slots(code: np.ndarray, bits: int) -> list[np.ndarray]:
    x = code * K[0]
    x ^= x >> np.uint64(29)
    return [(x * k) >> np.uint64(64 - bits) for k in K[:PROBES]]


class Filters:
    """``languages`` are in order of frequency; word ``w`` of a slot's mask has languages 64 w and up."""

    def __init__(self, languages: list[str], code: np.ndarray, language: np.ndarray):
        self.languages = languages
        self.bits = max(10, (LOAD * max(1, len(np.unique(code)))).bit_length())
        self.masks = np.zeros((max(1, -(-len(languages) // 64)), 1 << self.bits), np.uint64)
        for w in range(len(self.masks)):
            own = language // 64 == w
            bit = np.uint64(1) << (language[own] % 64).astype(np.uint64)
            for at in slots(code[own], self.bits):
                np.bitwise_or.at(self.masks[w], at, bit)
        fill = np.array([np.mean((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
        self.false = np.minimum(fill**PROBES, 0.99)

    def counts(self, many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected n-grams of each text in each language, all its n-grams, whether it has a letter."""
        code, text, some = trigrams(many)
        at = slots(code, self.bits)
        total = np.bincount(text, minlength=len(many))
        out = np.zeros((len(many), len(self.languages)))
        for w, table in enumerate(self.masks):
            mask = table[at[0]] & table[at[1]] & table[at[2]]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                out[:, i] = np.bincount(text[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(many))
        return np.maximum(0, (out - self.false * total[:, None]) / (1 - self.false)), total, some


def learn(train: DataFrame, sample: int = SAMPLE) -> Filters:
    """``train``: ``doc_id, text, lang``. The n-grams that come to the driver are bounded by the sample."""
    counts = sorted(((r["lang"], r["count"]) for r in train.groupBy("lang").count().collect()), key=lambda r: (-r[1], r[0]))
    if not counts:
        return Filters([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    # a hash bound that leaves about 1.3 times the sample of each language, then its first rows
    unit = (F.xxhash64("doc_id", F.lit(7)) / F.lit(2.0**64)) + 0.5
    near = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, 1.3 * sample / n + 0.001))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))
    some = train.withColumn("u", unit).where(F.col("u") < near[F.col("lang")]).withColumn("rank", rank).where(F.col("rank") <= sample)

    def grams(batches):
        for batch in batches:
            langs, at = np.array(batch.column("lang").to_pylist(), object), 0
            for part in portions(batch.column("text")):
                code, text, _ = trigrams(part)
                own = langs[at : at + len(part)]
                at += len(part)
                for lang in set(own.tolist()):
                    is_own = (own == lang)[text]
                    pair = np.unique(np.stack((code[is_own], text[is_own].astype(np.uint64))), axis=1)
                    c, n = np.unique(pair[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    # the ranking leaves one partition a language
    some = some.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    found = some.select("lang", "text").mapInArrow(grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    least = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, MIN_SHARE * min(n, sample))])
    rows = found.where(F.col("n") >= least[F.col("lang")]).select("lang", "code").toPandas()
    place = {lang: i for i, (lang, _) in enumerate(counts)}
    return Filters(list(place), rows["code"].to_numpy(np.int64).view(np.uint64), rows["lang"].map(place).to_numpy(np.int64))


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score, known, accepted``; columns named in ``keep`` are passed on as they are."""
    rows = narrowed(docs, id_col, text_col, tuple(c for c in keep if c != text_col))
    kept = {f"keep_{c}": "text" if c == text_col else f"keep_{c}" for c in keep}
    schema = "doc_id long, lang_pred string, score double, known double, accepted boolean" + keep_schema(rows.withColumn(f"keep_{text_col}", F.col("text")), keep)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        f: Filters = shared.value
        names = np.array([*f.languages, "und"], object)
        for batch in batches:
            at = 0
            for part in portions(batch.column("text")):
                if f.languages:
                    n, total, some = f.counts(part)
                    best = n.argmax(axis=1)
                    top = n[np.arange(len(part)), best]
                    rest = np.sort(n, axis=1)[:, -2] if n.shape[1] > 1 else np.zeros(len(part))
                    score = np.divide(top, top + rest, out=np.zeros(len(part)), where=top > 0)
                    known = np.minimum(1, np.divide(top, total, out=np.zeros(len(part)), where=total > 0))
                else:
                    some, best = np.zeros(len(part), bool), np.zeros(len(part), int)
                    score = known = np.zeros(len(part))
                lang = np.where(some, names[best], "und")
                score = np.where(some, score, 0.0)
                own = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(known), pa.array(some & (known >= MIN_KNOWN)), *(own.column(c) for c in kept.values())],
                    ["doc_id", "lang_pred", "score", "known", "accepted", *kept],
                )

    return restored(rows.mapInArrow(run, schema), keep)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def op7(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "known", "accepted")
