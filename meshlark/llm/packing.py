"""Packing by power-of-two decomposition.

A document's ids (with id 0 at its end) are cut into whole pieces of the maximum length and then the
binary digits of the rest, longest first. Each piece is a sequence of its own whose length is a power
of two: no sequence crosses documents, nothing is padded, and ``bucket`` (the length's exponent)
groups sequences of one length for batching. No shuffle is needed.

Ids are those of the ``tokenizers`` library for the vocabulary file; they are computed by a rank
encoder built from the same file, several times as fast, whose equality the tests check. Splitting
needs a look-ahead only inside runs of white space, so texts are cut there and the rest of the split
pattern runs without one. The file's added tokens are found first, as the library does; what lies
between two of them is a text of its own.

Defined cases: null text counts as empty (its sequence is the single id 0); a very long text is
encoded whole, in memory in proportion to its bytes; rows of equal id are documents of their own; extra columns are passed over; an empty table gives an empty table.
``sequence_id`` is unique, not dense: the partition's number and the row's number within it.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import texts

MOST = 1024
VOCABULARY = "byte_bpe_50k.json"
#: White space of the split pattern (Unicode White_Space).
BLANK = r"\t-\r \x85\xa0  -     　"
BEFORE_LAST_BLANK = re.compile(f"[{BLANK}]+(?=[{BLANK}][^{BLANK}])")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(2)
def encoder(path: str):
    """``text -> ids`` for a byte-level vocabulary file in which merges have the order of their ids."""
    file = json.load(open(path, encoding="utf-8"))
    model = file["model"]
    alphabet = byte_alphabet()
    ids = model["vocab"]
    made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError("merges are not in the order of their ids")
    merged = set(made)
    ranks = {bytes(alphabet[c] for c in t): i for t, i in ids.items() if i in merged or len(t) == 1}
    pattern = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", "")
    one = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
    if any(t.get(flag) for t in file.get("added_tokens") or [] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token takes in its surroundings")
    token = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def between(text: str) -> list[int]:
        cuts = [m.end() for m in BEFORE_LAST_BLANK.finditer(text)]
        if not cuts:
            return one(text)
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            out += one(text[a:b])
        return out

    def encode(text: str) -> list[int]:
        parts = token.split(text) if token else [text]
        if len(parts) == 1:
            return between(text)
        out: list[int] = []
        for k, part in enumerate(parts):
            out += [added[part]] if k % 2 else between(part)
        return out

    return encode


def piece_lengths(n: int, most: int = MOST) -> list[int]:
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket`` and, if wanted, ``ids``."""
    if most < 1 or most & (most - 1):
        raise ValueError("the maximum must be a power of two")
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids = batch.column("doc_id")
            row, start, length, crc, total, parts = [], [], [], [], [], []
            for i, text in enumerate(texts(batch.column("text"))):
                own = np.array([*encode(text), 0], "<u4")
                data, at = own.tobytes(), 0
                for n in piece_lengths(len(own), most):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                    total.append(len(own))
                    at += n
                if with_ids:
                    parts.append(own)
            n = np.array(length, np.int64)
            columns = [ids.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.frexp(n)[1] - 1, pa.int32())]
            if with_ids:
                flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in schema.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    rows = rows.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *["ids"] * with_ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences of one length to a folder, ready to be batched without padding."""
    packed.write.partitionBy("bucket").parquet(path)


def op1(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
