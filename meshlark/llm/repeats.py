"""Relational part of the repeat search: anchors of bytes or words, and rounds of ranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.anchors import Windows, long_array, segments
from meshlark.llm.common import flat, groups
from meshlark.storage import Scratch

ROWS = "doc_id long, th long, lo long, n long, at long, key long, ctx long"
STEP = 1 << 18
PART = 1 << 21


def word_symbols(cut=bytes.split):
    """``make_symbols`` for words: the 64-bit names of what ``cut`` makes of a text, by groups of rows."""

    def make():
        digest = xxhash.xxh3_64_intdigest

        def of(column):
            raw, off = flat(column)
            data = raw.tobytes()
            for i, j in groups(off, PART):
                counts, parts = [0], []
                for r in range(i, j):
                    words = cut(data[off[r] : off[r + 1]])
                    counts.append(len(words))
                    parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
                sym = np.concatenate(parts)
                yield (lambda s, e, sym=sym: sym[s:e]), np.cumsum(counts), i

        return of

    return make


def word_windows(span: int) -> Windows:
    block = 1 << (span.bit_length() - 1)
    return Windows(span, max(1, min(8, block // 2)), block)


def anchor_rows(docs: DataFrame, make_symbols, win: Windows) -> DataFrame:
    """One row an anchor; ``make_symbols()`` gives ``column -> (symbols of a range, offsets, first row)``."""

    def run(batches):
        symbols = make_symbols()
        for batch in batches:
            ids, th = batch.column("doc_id"), batch.column("th")
            for raw, off, base in symbols(batch.column("text")):
                for i, j, s, e in segments(off, STEP, win.span):
                    got = win.anchors(raw(s, e), np.clip(off[i : j + 1], s, e) - s)
                    if got is None:
                        continue
                    row = pa.array(base + i + got["doc"])
                    lo = got["lo"] + np.maximum(s - off[i + got["doc"]], 0)
                    yield pa.RecordBatch.from_arrays([ids.take(row), th.take(row), *map(long_array, (lo, got["n"], got["at"], got["key"], got["ctx"]))], ["doc_id", "th", "lo", "n", "at", "key", "ctx"])

    return docs.mapInArrow(run, ROWS)


def same_document(a: str, b: str):
    return F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}th") == F.col(f"{b}th"))


def other(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumnsRenamed({x: f"_{x}" for x in names})


def ranked(found: DataFrame, tmp: Scratch, tag: str, earlier: bool) -> DataFrame:
    """One round over rows with ``key`` and ``ctx``: rows whose key is unique leave; members of a
    class that repeats are ``hit``; rows to look at more closely, one of each class at least where
    a key has several classes, are ``open`` (a class is stood for by its member of least hash).

    Only counts and minima come out of the groupings, which pre-aggregate; the joins are plain
    equi-joins with their aggregate, which adaptive execution splits where a key is hot.
    """
    member = F.xxhash64("doc_id", "th", "lo")
    classes = found.groupBy("key", "ctx").agg(F.count("*").alias("c"), F.min("doc_id").alias("low"), F.min(member).alias("rep"))
    several = classes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select(F.col("key").alias("_key"))
    classes = classes.join(several, F.col("key") == F.col("_key"), "left").withColumn("open", F.col("_key").isNotNull()).where("open or c > 1")
    classes = tmp.write(classes.select(F.col("key").alias("_key"), F.col("ctx").alias("_ctx"), "c", "low", "rep", "open"), f"classes{tag}")
    hit = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False)) if earlier else F.col("c") > 1
    joined = found.join(classes, (F.col("key") == F.col("_key")) & (F.col("ctx") == F.col("_ctx")))
    joined = joined.withColumn("hit", hit).withColumn("open", F.col("open") & (~F.col("hit") & ~F.col("done") | (member == F.col("rep"))))
    marked = joined.where("open or (hit and not done)").drop("key", "ctx", "_key", "_ctx", "c", "low", "rep")
    marked = tmp.write(marked, f"marked{tag}")
    tmp.drop(f"classes{tag}")
    return marked


def repeated_ranges(docs: DataFrame, make_symbols, dtype: type, win: Windows, sizes: tuple[int, ...], earlier: bool) -> DataFrame:
    """``(doc_id, th, lo, n)``: stretches of windows to remove. ``earlier``: a window counts when its
    symbols also start in a document of smaller id; else when they also start anywhere else.

    Rows equal in id and text name the same stretches: lists hold each once, so that every such row
    meets one list and stays one row, counted as itself, in every round."""
    tmp = Scratch(docs.sparkSession)
    rows = tmp.write(anchor_rows(docs, make_symbols, win), "anchors").withColumn("done", F.lit(False))
    marked = ranked(rows, tmp, "", earlier)
    tmp.drop("anchors")
    ranges = [marked.where("hit").select("doc_id", "th", "lo", "n")]
    todo = marked.where("open").groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "n", "at", (F.col("hit") | F.col("done")).alias("done"))).alias("todo"))
    source = docs.join(other(todo, "doc_id", "th"), same_document("", "_")).select("doc_id", "th", "text", "todo")
    bodies = tmp.write(stretches(source, make_symbols, win), "bodies")
    work = bodies.withColumn("todo", F.array(F.struct("lo", "n", "at", "done")))
    for k, size in enumerate(win.rounds(sizes)):
        marked = ranked(tmp.write(block_rows(work, dtype, win, size), f"blocks{k}"), tmp, str(k), earlier)
        tmp.drop(f"blocks{k}")
        ranges.append(marked.where("hit and not done").select("doc_id", "th", "lo", "n"))
        if size > 1:
            todo = marked.where("open").groupBy("doc_id", "th", "base").agg(F.collect_set(F.struct("lo", "n", "at", (F.col("hit") | F.col("done")).alias("done"))).alias("todo"))
            work = bodies.drop("n", "at", "done").join(other(todo, "doc_id", "th"), same_document("", "_") & (F.col("lo") == F.col("base"))).select("doc_id", "th", "lo", "body", "todo")
    found = tmp.write(reduce(DataFrame.union, ranges), "ranges")
    for name in ("bodies", "marked", *(f"marked{k}" for k in range(len(ranges) - 1))):
        tmp.drop(name)
    return found


def stretches(source: DataFrame, make_symbols, win: Windows) -> DataFrame:
    """The symbols of each open stretch, as bytes: ``(doc_id, th, lo, n, at, done, body)``."""

    def run(batches):
        symbols = make_symbols()
        for batch in batches:
            ids, th, todo = batch.column("doc_id"), batch.column("th"), batch.column("todo")
            for raw, off, base in symbols(batch.column("text")):
                for i in range(len(off) - 1):
                    own = todo[base + i].values
                    lo, n = (own.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "n"))
                    body = [raw(int(off[i]) + x, int(off[i]) + x + m - 1 + win.span).tobytes() for x, m in zip(lo.tolist(), n.tolist())]
                    row = pa.array(np.full(len(lo), base + i))
                    yield pa.RecordBatch.from_arrays([ids.take(row), th.take(row), own.field("lo"), own.field("n"), own.field("at"), own.field("done"), pa.array(body, pa.binary())], ["doc_id", "th", "lo", "n", "at", "done", "body"])

    return source.mapInArrow(run, "doc_id long, th long, lo long, n long, at long, done boolean, body binary")


def block_rows(work: DataFrame, dtype: type, win: Windows, size: int) -> DataFrame:
    """The blocks of every ``todo`` stretch of each body, a body being cut at ``lo`` of its document."""

    each = np.dtype(dtype).itemsize

    def run(batches):
        for batch in batches:
            ids, th, base, todo = (batch.column(x) for x in ("doc_id", "th", "lo", "todo"))
            raw, off = flat(batch.column("body"))
            for i, j in groups(off, STEP):
                sym = np.frombuffer(raw[off[i] : off[j]].tobytes(), dtype)
                lists = todo.slice(i, j - i)
                own = lists.flatten()
                row = np.repeat(np.arange(i, j), lists.value_lengths().to_numpy(zero_copy_only=False))
                lo, n, at, done = (own.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "n", "at", "done"))
                at0 = base.to_numpy(zero_copy_only=False)[row]
                got = win.blocks(sym, (off[row] - off[i]) // each + lo - at0, n, at, size)
                src = got["src"]
                take = pa.array(row[src])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), th.take(take), base.take(take), pa.array(done[src]), *map(long_array, (got["lo"] + lo[src], got["n"], got["at"], got["key"], got["ctx"]))],
                    ["doc_id", "th", "base", "done", "lo", "n", "at", "key", "ctx"],
                )

    return work.mapInArrow(run, "doc_id long, th long, base long, done boolean, lo long, n long, at long, key long, ctx long")


def with_ranges(docs: DataFrame, **ranges: DataFrame) -> DataFrame:
    """Each document with a list of its stretches (bounded by its own length) by each name."""
    every = reduce(DataFrame.union, (r.select("doc_id", "th", "lo", "n", F.lit(name).alias("of")) for name, r in ranges.items()))
    one = [F.collect_set(F.when(F.col("of") == name, F.struct("lo", "n"))).alias(name) for name in ranges]
    lists = every.groupBy("doc_id", "th").agg(*one)
    return docs.join(other(lists, "doc_id", "th"), same_document("", "_"), "left").drop("_doc_id", "_th", "th")


def covered(size: int, ranges, span: int) -> np.ndarray | None:
    """Mask of the symbols under any window of the stretches; None if there is none."""
    if ranges is None or len(ranges) == 0:
        return None
    lo, n = ranges.field("lo").to_numpy(zero_copy_only=False), ranges.field("n").to_numpy(zero_copy_only=False)
    d = np.zeros(size + 1, np.int32)
    np.add.at(d, lo, 1)
    np.add.at(d, lo + n - 1 + span, -1)
    return np.cumsum(d[:-1]) > 0
