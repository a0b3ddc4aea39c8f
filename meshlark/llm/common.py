"""Arrow batches as flat arrays, shared by the text operators."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The separators of the word definition used throughout: space and U+0009 to U+000D.
BLANKS = "\x20\x09-\x0d"
WORD = re.compile(f"[^{BLANKS}]+")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def groups(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts(column: pa.Array) -> Iterator[str]:
    """Python strings one at a time; null counts as empty."""
    for x in column:
        yield x.as_py() or ""


def held_out(doc_id: Column) -> Column:
    """The held-out quarter: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def narrowed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text)`` and the columns to pass on, renamed, so that none can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))


def keep_schema(rows: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f", `keep_{c}` {rows.schema[f'keep_{c}'].dataType.simpleString()}" for c in keep)


def restored(found: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Passed-on columns under their own names; one that a result's name takes gets ``was_`` before it."""
    return found.withColumnsRenamed({f"keep_{c}": f"was_{c}" if c in found.columns else c for c in keep}) if keep else found


def with_row_key(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Narrowed rows with ``th``. A row is known by its id and the hash of its text; rows equal in
    both have equal results."""
    rows = narrowed(docs, id_col, text_col, keep).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("th", F.xxhash64("text"))


def crc(data: bytes) -> int:
    return zlib.crc32(data)
