"""Removal of repeated strings by ranking positions at growing lengths.

This is not the dealt prefix doubling in full: ranking every byte position, in Spark, at each power of
two does not fit the disk budget (see the README for figures). What is kept of it: positions get
ranks for growing lengths, each length is ranked by a shuffle, and only positions whose rank is not
yet unique go on to the next. What differs: the names of powers of two are doubled inside a task,
equality is told by hashing (a grouping, not a sort; the order of ranks is not needed), and positions
stand sparsely until the last round. The lengths ranked, for 400 bytes, are 32 (at content-chosen
anchors), 337 and 393 (what blocks of 64 and 8 windows share) and 400, each named by a pair of ranks;
see ``anchors`` for why no repeat is lost.

Strings are bytes, or words (``unit``). Words are runs without blanks, but characters of scripts
without spaces (Han, kana, Thai, Lao, Khmer, Burmese) are words each. ``leave_first`` takes out only
strings that a document of smaller id has too, so that one copy of a passage stays.

Defined cases: null text counts as empty; texts under ``span`` symbols have no window and stay whole;
very long texts are cut into overlapping pieces, so that no window is lost or seen twice; repeated
rows and equal ids are rows of their own (with ``leave_first`` rows of equal id never remove from
each other, and a null id neither removes nor loses); extra columns are passed over; an empty table
gives an empty table. Cuts of bytes may fall inside a character: ``text`` then lacks its odd bytes
while the digest is over the exact bytes. A run of removed words goes with the blanks that follow it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshlark.llm.anchors import Windows
from meshlark.llm.common import flat, keep_schema, restored, with_row_key
from meshlark.llm.repeats import covered, repeated_ranges, with_ranges, word_symbols, word_windows

SPAN, PASSAGE = 400, 50
#: Windows in a block, round by round.
BLOCKS = (64, 8, 1)
WORD_BLOCKS = (8, 1)
#: UTF-8 of the characters that are words of their own.
ALONE = rb"(?:\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xf0[\xa0-\xbf][\x80-\xbf]{2})"
UNSPACED, PLAIN = re.compile(ALONE), re.compile(rb"[^\x20\x09-\x0d]+")
MIXED = re.compile(ALONE + rb"|(?:(?!" + ALONE + rb")[^\x20\x09-\x0d])+")


def _symbols():
    def of(column):
        raw, off = flat(column)
        yield (lambda s, e: raw[s:e]), off, 0

    return of


def words_of(text: bytes) -> list[bytes]:
    return MIXED.findall(text) if UNSPACED.search(text) else text.split()


def word_cut(text: bytes, ranges, span: int) -> np.ndarray | None:
    """Mask of the bytes under the removed words, from a word's start to that of the next that stays."""
    if ranges is None or len(ranges) == 0:
        return None
    start = np.fromiter((m.start() for m in (MIXED if UNSPACED.search(text) else PLAIN).finditer(text)), np.int64)
    cut = covered(len(start), ranges, span)
    return np.concatenate((np.zeros(start[0], bool), np.repeat(cut, np.diff(np.append(start, len(text))))))


def _sizes(span: int) -> Windows:
    block = 1 << (span.bit_length() - 1)
    return Windows(span, max(1, min(32, block // 2)), block)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, keep: tuple[str, ...] = (), unit: str = "byte", leave_first: bool = False, passage: int = 0) -> DataFrame:
    """``doc_id, text, n_bytes, n_removed, n_spans, kept_sha256`` (bytes, for either unit); ``text`` is
    what is left. Columns named in ``keep`` are passed on. With ``passage`` there is ``n_passage_words``
    too: the words, in the text as given, under passages of so many words that a document of smaller
    id has too, which may be shorter than ``span`` bytes; these are counted, not removed."""
    rows = with_row_key(docs, id_col, text_col, keep)
    by_words = lambda size, first: repeated_ranges(rows, word_symbols(words_of), np.uint64, word_windows(size), WORD_BLOCKS, first)
    if unit == "word":
        ranges = {"ranges": by_words(span, leave_first)}
    elif unit == "byte":
        ranges = {"ranges": repeated_ranges(rows, _symbols, np.uint8, _sizes(span), BLOCKS, leave_first)}
    else:
        raise ValueError("the unit is byte or word")
    if passage:
        ranges["passages"] = by_words(passage, True)

    counted = ["n_passage_words"] * bool(passage)

    def run(batches):
        for batch in batches:
            raw, off = flat(batch.column("text"))
            todo = batch.column("ranges")
            out = {k: [] for k in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256", *counted)}
            for i in range(batch.num_rows):
                own = raw[off[i] : off[i + 1]]
                found = todo[i].values if todo[i].is_valid else None
                cut = word_cut(own.tobytes(), found, span) if unit == "word" else covered(len(own), found, span)
                kept = (own if cut is None else own[~cut]).tobytes()
                out["text"].append(kept.decode("utf-8", "ignore"))
                out["n_bytes"].append(len(own))
                out["n_removed"].append(len(own) - len(kept))
                out["n_spans"].append(0 if cut is None else int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1])))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if passage:
                    found = batch.column("passages")[i].values if batch.column("passages")[i].is_valid else None
                    out["n_passage_words"].append(0 if found is None or not len(found) else int(covered(len(words_of(own.tobytes())), found, passage).sum()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            passed = [f"keep_{c}" for c in keep]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds)), *(batch.column(c) for c in passed)], ["doc_id", *out, *passed])

    schema = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", {c} long" for c in counted)
    return restored(with_ranges(rows, **ranges).mapInArrow(run, schema + keep_schema(rows, keep)), keep)


def op5(spark, sf_dir):
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
