"""Removal of word passages that an earlier document has, by relative Lempel-Ziv parsing.

Reference blocks: every document is cut into stretches of up to 97 words around content-chosen
anchors (see ``anchors``); the index files each distinct stretch once, under its anchor's 8 words and
with the smallest id that has it. All stretches of one anchor are a block. Two equal windows choose
equal anchors, so a document needs to be factored only against the blocks that its own anchors name,
and a block that holds one stretch only can be left out.

Factors: a stretch that a document of smaller id has too is one factor as a whole. Else it is parsed
from left to right against what the block's earlier documents have: the window at hand is looked up,
and a match is extended word by word as far as it goes (a factor, of ``span`` words at least, with the
document it is copied from). A window that crosses a factor's end may start elsewhere, so the parse
goes on at the first window that the factor does not hold, not at its end; no window stays unjudged.

Blocks of more than ``LIMIT`` stretches (a phrase that a third of all texts have) are not gathered in
a task: their windows are looked up in an index by window, where copies pre-aggregate.

Defined cases: null text has no words; texts under ``span`` words stay whole; very long texts are cut
into overlapping pieces, so that no window is lost or seen twice; rows of equal id never remove from
each other (only a smaller id counts); a null id neither removes nor loses; extra columns are passed
over; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.anchors import Windows, long_array, names
from meshlark.llm.common import flat, groups, with_row_key
from meshlark.llm.repeats import PART, anchor_rows, covered, other, same_document, with_ranges, word_symbols, word_windows
from meshlark.storage import Scratch

SPAN = 50
#: Stretches of a block that one task gathers.
LIMIT = 512
WORD = 8  # bytes of a word's name


def parse(block, span: int):
    """Factors of the stretches of one block: ``block`` yields ``(name, owner, body)`` by rising owner,
    the body being 8 bytes a word; gives ``(name, source, first, length)``, in words from the
    stretch's start, for factors of ``span`` words or more that an earlier owner has."""
    index: dict[bytes, tuple[int, bytes, int]] = {}
    wide = span * WORD
    for name, owner, body in block:
        at, end = 0, len(body) - wide
        while at <= end:
            here = index.setdefault(body[at : at + wide], (owner, body, at))
            if here[0] < owner:
                _, source, k = here
                stop, k = at + wide, k + wide
                while stop < len(body) and body[stop : stop + WORD] == source[k : k + WORD]:
                    stop, k = stop + WORD, k + WORD
                yield name, here[0], at // WORD, (stop - at) // WORD
                at = stop - wide  # the last window in the factor
            at += WORD


def _factors(span: int):
    columns = ["key", "ctx", "source", "first", "length"]

    def made(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else [()] * 5)], columns)

    def run(batches):
        held, key, found = [], None, []

        def factored():
            found.extend((key, *f) for f in parse(held, span))

        for batch in batches:
            for k, ctx, low, body in zip(*(batch.column(c).to_pylist() for c in ("key", "ctx", "low", "body"))):
                if k != key:
                    factored()
                    held, key = [], k
                    if len(found) > 1 << 16:
                        yield made(found)
                        found = []
                if not held or held[-1][0] != ctx:  # rows equal in id and text give a body each
                    held.append((ctx, low, body))
        factored()
        yield made(found)

    return run


def _bodies(source: DataFrame, span: int) -> DataFrame:
    """``key, ctx, low, n, k, body``: the words' names of each stretch in ``todo``, which holds the first
    row of its class."""

    def run(batches):
        symbols = word_symbols()()
        for batch in batches:
            todo = batch.column("todo")
            for raw, off, base in symbols(batch.column("text")):
                for i in range(len(off) - 1):
                    own = todo[base + i].values
                    lo, n = (own.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "n"))
                    body = [raw(int(off[i]) + x, int(off[i]) + x + m - 1 + span).tobytes() for x, m in zip(lo.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([*(own.field(x) for x in ("key", "ctx", "low", "n", "k")), pa.array(body, pa.binary())], ["key", "ctx", "low", "n", "k", "body"])

    return source.mapInArrow(run, "key long, ctx long, low long, n long, k long, body binary")


def _single(bodies: DataFrame, win: Windows) -> DataFrame:
    """``key, ctx, low, first, h1, h2``: every window of each stretch with its name of 128 bits."""

    def run(batches):
        for batch in batches:
            raw, off = flat(batch.column("body"))
            for i, j in groups(off, PART):
                sym = np.frombuffer(raw[off[i] : off[j]].tobytes(), np.uint64)
                if not len(sym):
                    continue
                (b,) = names(sym, win.block)
                n = batch.column("n").to_numpy()[i:j]
                row = np.repeat(np.arange(j - i), n)
                first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = (off[i:j] - off[i])[row] // WORD + first
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in ("key", "ctx", "low")), *map(long_array, (first, b[at].view(np.int64), b[at + win.span - win.block].view(np.int64)))],
                    ["key", "ctx", "low", "first", "h1", "h2"],
                )

    return bodies.mapInArrow(run, "key long, ctx long, low long, first long, h1 long, h2 long")


def factor_ranges(rows: DataFrame, span: int, limit: int = LIMIT) -> DataFrame:
    """``doc_id, th, lo, n, source``: factors of ``span`` words or more of the texts of
    ``rows(doc_id, th, text)``, as stretches of ``n`` windows from ``lo``; ``source`` is the document
    a factor is copied from."""
    win, tmp = word_windows(span), Scratch(rows.sparkSession)
    found = tmp.write(anchor_rows(rows.where("doc_id is not null"), word_symbols(), win), "anchors")
    member = F.xxhash64("doc_id", "th", "lo")
    index = found.groupBy("key", "ctx").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(member).alias("rep"))
    block = index.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").withColumnRenamed("key", "_key")
    index = index.join(block, F.col("key") == F.col("_key"), "left").drop("_key").where("k > 1 or high > low").drop("high")
    index = tmp.write(index, "index").withColumnsRenamed({"key": "_key", "ctx": "_ctx"})
    met = found.join(index, (F.col("key") == F.col("_key")) & (F.col("ctx") == F.col("_ctx"))).drop("_key", "_ctx")
    met = met.withColumn("first", F.col("k").isNotNull() & (member == F.col("rep"))).where("doc_id > low or k is not null and (first or doc_id = low)")
    met = tmp.write(met.select("doc_id", "th", "lo", "n", "key", "ctx", "low", "k", "first"), "met")
    for name in ("anchors", "index"):
        tmp.drop(name)
    whole = met.where("doc_id > low").select("doc_id", "th", "lo", "n", F.col("low").alias("source"))
    todo = met.where("first").groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "n", "key", "ctx", "low", "k")).alias("todo"))
    source = rows.join(other(todo, "doc_id", "th"), same_document("", "_")).select("text", "todo")
    bodies = tmp.write(_bodies(source, span), "bodies")
    hot, cold = bodies.where(F.col("k") > limit), bodies.where(F.col("k") <= limit)
    cold = cold.repartition("key").sortWithinPartitions("key", "low", "ctx")
    parsed = cold.mapInArrow(_factors(span), "key long, ctx long, source long, first long, length long").withColumn("n", F.col("length") - (span - 1)).drop("length")
    single = tmp.write(_single(hot.dropDuplicates(["key", "ctx"]), win), "windows")
    lowest = single.groupBy("h1", "h2").agg(F.min("low").alias("source"), F.max("low").alias("high")).where("high > source").withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    looked = single.join(lowest, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where("low > source").select("key", "ctx", "source", "first", F.lit(1).cast("long").alias("n"))
    factors = tmp.write(parsed.union(looked), "factors").withColumnsRenamed({"key": "_key", "ctx": "_ctx", "n": "m", "first": "at"})
    for name in ("bodies", "windows"):
        tmp.drop(name)
    asks = met.where("k is not null and doc_id = low").join(factors, (F.col("key") == F.col("_key")) & (F.col("ctx") == F.col("_ctx")))
    return whole.union(asks.select("doc_id", "th", (F.col("lo") + F.col("at")).alias("lo"), F.col("m").alias("n"), "source"))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, limit: int = LIMIT) -> DataFrame:
    """``doc_id, text, n_words, n_removed, kept_sha256``; ``text`` is the kept words, space-joined."""
    rows = with_row_key(docs, id_col, text_col)
    ranges = factor_ranges(rows, span, limit)

    def run(batches):
        for batch in batches:
            raw, off = flat(batch.column("text"))
            data, todo = raw.tobytes(), batch.column("ranges")
            out = {k: [] for k in ("text", "n_words", "n_removed", "kept_sha256")}
            for i in range(batch.num_rows):
                words = data[off[i] : off[i + 1]].split()
                n = len(words)
                cut = covered(n, todo[i].values if todo[i].is_valid else None, span)
                if cut is not None:
                    words = [words[x] for x in np.flatnonzero(~cut).tolist()]
                kept = b" ".join(words)
                out["text"].append(kept.decode())
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", *out])

    return with_ranges(rows, ranges=ranges.drop("source")).mapInArrow(run, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")


def op6(spark, sf_dir):
    return remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i+49], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
low as (select k, min(doc_id) as low from win group by k),
cut as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join low using (k) where doc_id > low),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from word anti join cut using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""
