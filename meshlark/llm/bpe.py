"""Byte-level BPE encoding and decoding on padded matrices.

Texts are split by the pattern; pieces not met before are put, by length, into padded matrices of
byte ids. In each round every row merges its leftmost pair of least rank, pairs being looked up in
an open-addressing hash table, and rows and columns are compacted; a row leaves when no pair has a
rank. A piece that is itself in the vocabulary is one id. Pieces over ``LONG`` bytes merge by the
same rule on a heap, as a matrix of their width would take a round for each merge.

Defined cases: null text counts as empty (no ids, the digests of nothing); very long texts are split
by the pattern like any other; of pairs of equal rank the leftmost merges first; rows of equal id are
documents of their own; extra columns are passed over; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG, KEPT, PART = 1024, 300_000, 1 << 21
NONE = np.int32(2**31 - 1)
K = np.uint64(0x9E3779B97F4A7C15)


def splitter(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    r"""The pattern with ``\s`` as the White_Space property, without the four control characters
    that Python counts besides."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class MatrixBpe:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = {i: t for t, i in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = (np.array(x, np.uint64) for x in zip(*pairs))
        self.shift = np.uint64(64 - max(4, len(pairs).bit_length() + 1))
        self.keys = np.full(1 << (64 - int(self.shift)), 2**64 - 1, np.uint64)
        self.vals = np.full(len(self.keys), NONE, np.int32)
        self.mask = np.uint64(len(self.keys) - 1)
        self._fill((a << np.uint64(32)) | b, r.astype(np.int32))
        self.split = splitter()
        self.known: dict[str, bytes] = {}

    def _fill(self, key: np.ndarray, val: np.ndarray) -> None:
        at = (key * K) >> self.shift
        while len(key):
            free = self.keys[at] == 2**64 - 1
            self.keys[at[free]] = key[free]  # of several at one place one stays
            won = self.keys[at] == key
            self.vals[at[won]] = val[won]
            key, val, at = key[~won], val[~won], (at[~won] + np.uint64(1)) & self.mask

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, or ``NONE``; ids below 0 stand for padding."""
        out = np.full(a.shape, NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = (a.ravel()[todo].astype(np.uint64) << np.uint64(32)) | b.ravel()[todo].astype(np.uint64)
        at = (key * K) >> self.shift
        flat = out.ravel()
        while len(todo):
            have = self.keys[at]
            hit = have == key
            flat[todo[hit]] = self.vals[at[hit]]
            go = ~hit & (have != 2**64 - 1)
            todo, key, at = todo[go], key[go], (at[go] + np.uint64(1)) & self.mask
        return flat.reshape(a.shape)

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of similar length, as little-endian 32-bit integers."""
        n, width = len(pieces), max(map(len, pieces))
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < size[:, None], self.byte[raw], np.int32(-1))
        out: list[bytes] = [b""] * n
        row, rank = np.arange(n), self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while True:
            j = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), j] if rank.shape[1] else np.full(len(row), NONE)
            over = best == NONE
            if over.any():
                for r, own, m in zip(row[over].tolist(), ids[over], size[over].tolist()):
                    out[r] = own[:m].astype("<u4").tobytes()
                row, ids, size, rank, j, best = (x[~over] for x in (row, ids, size, rank, j, best))
            if not len(row):
                return out
            k = np.arange(len(row))
            ids[k, j] = best
            column = np.arange(ids.shape[1] - 1)
            ids = np.where(column <= j[:, None], ids[:, :-1], ids[:, 1:])
            size -= 1
            keep = max(int(size.max()), 1)
            ids = ids[:, :keep]
            column = np.arange(rank.shape[1] - 1)
            rank = np.where(column < j[:, None], rank[:, :-1], rank[:, 1:])[:, : keep - 1]
            if rank.shape[1]:
                right = np.flatnonzero(j < keep - 1)
                rank[right, j[right]] = self.pair_ranks(ids[right, j[right]], ids[right, j[right] + 1])
                left = np.flatnonzero(j > 0)
                rank[left, j[left] - 1] = self.pair_ranks(ids[left, j[left] - 1], ids[left, j[left]])

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, on a heap of (rank, place)."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, words = list(range(1, n + 1)), list(range(-1, n - 1)), self.words

        def rank(i: int):
            j = after[i]
            return self.ranks.get(words[ids[i]] + words[ids[j]]) if j < n else None

        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (again := rank(k)) is not None:
                    heapq.heappush(heap, (again, k))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet, by buckets of length."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            if (i := self.ranks.get(b)) is not None:
                self.known[p] = i.to_bytes(4, "little")
            elif len(b) > LONG:
                self.known[p] = self.merge_long(b)
            else:
                buckets.setdefault((len(b) - 1).bit_length() if len(b) > 12 else len(b) + 16, []).append((p, b))
        for rows in buckets.values():
            for at in range(0, len(rows), 8192):
                part = rows[at : at + 8192]
                for (p, _), ids in zip(part, self.merge_rows([b for _, b in part])):
                    self.known[p] = ids

    def encode(self, many: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.split.findall(t) for t in many]
        if len(self.known) > KEPT:
            self.known.clear()
        new = {p for own in split for p in own if p not in self.known}
        if new:
            self.learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, own)) for own in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def coder(path: str) -> MatrixBpe:
    return MatrixBpe(path)


def portions(column, most: int = PART):
    """Lists of texts of about ``most`` characters."""
    held, size = [], 0
    for t in texts(column):
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids`` and ``decoded`` (bytes)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            at = 0
            for part in portions(batch.column("text")):
                ids = bpe.encode(part)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                back = [bpe.decode(x) for x in ids]
                columns = [batch.column("doc_id").slice(at, len(part)), pa.array(n), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                if with_ids:
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat)), pa.array(back, pa.binary())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op3(spark, sf_dir):
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
