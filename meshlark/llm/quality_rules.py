"""Quality rules by compression bands.

zstandard ratios (bytes over compressed bytes, level ``LEVEL``) of the whole text and of its chunks of
``CHUNK`` bytes must lie in bands: a high ratio means repetitive text, a low one incompressible text.
Short texts compress worse, so limits go by length. A text passes if the whole is in its band and at
most ``BAD_CHUNKS`` of the chunks are out of theirs; texts of one chunk or less have none. The upper limits lie above real prose of
several scripts (README), those that compress best among them: Cyrillic and technical manuals.

Defined cases: null text has no words and fails the base rule; a text too short for the first band
has no ratio limits; very long texts are compressed whole and chunk by chunk; rows of equal id are documents of their own; extra columns are passed over; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import flat

SYMBOLS = b"#*$%&|<>"
LEVEL, CHUNK, BAD_CHUNKS = 3, 4096, 0.5
#: From so many bytes: least and greatest ratio of the whole text.
BANDS = ((256, 1.2, 2.5), (1024, 1.4, 3.2), (4096, 1.6, 3.8), (16384, 1.8, 4.5), (65536, 1.9, 6.1))
CHUNK_BAND = (1.5, 4.2)
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks int, chunks int"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words found twice or more."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    a = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    name = a[: n - size + 1]
    for i in range(1, size):
        _, name = np.unique(name * np.int64(len(seen)) + a[i : n - size + 1 + i], return_inverse=True)
    twice = np.bincount(name)[name] > 1
    cover = np.zeros(n, bool)
    for i in range(size):
        cover[i : n - size + 1 + i] |= twice
    return int(cover.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def band(size: int) -> tuple[float, float] | None:
    found = None
    for least, low, high in BANDS:
        if size >= least:
            found = low, high
    return found


def ratios(text: bytes, press) -> tuple[float, int, int]:
    """Ratio of the whole, chunks out of their band, chunks. The last chunk ends where the text ends, so
    that every byte is in one."""
    whole = len(text) / len(press(text)) if text else 0.0
    if len(text) <= CHUNK:
        return whole, 0, 0
    at = [*range(0, len(text) - CHUNK, CHUNK), len(text) - CHUNK]
    bad = sum(not CHUNK_BAND[0] <= CHUNK / len(press(text[i : i + CHUNK])) <= CHUNK_BAND[1] for i in at)
    return whole, bad, len(at)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts, ``base_failed``, ``kept`` and what the bands saw."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        for batch in batches:
            raw, off = flat(batch.column("text"))
            data = raw.tobytes()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                text = data[off[i] : off[i + 1]]
                words = text.split()
                n = len(words)
                chars = sum(len(w) for w in words) - int(np.count_nonzero((raw[off[i] : off[i + 1]] & 0xC0) == 0x80))
                repeat = repeated_words(words)
                failed = n < 50 or 100 * repeat > 50 * n
                ratio, bad, chunks = ratios(text, press)
                limits = band(len(text))
                good = (limits is None or limits[0] <= ratio <= limits[1]) and bad <= BAD_CHUNKS * chunks
                out.append((n, chars, sum(text.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS))), duplicate_lines(text), repeat, failed, good and not failed, ratio, bad, chunks))
            names = [x.split(" ") for x in COLUMNS.split(", ")]
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}
            columns = list(zip(*out)) if out else [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names[1:]))], [x for x, _ in names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COLUMNS)


def op8(spark, sf_dir):
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
