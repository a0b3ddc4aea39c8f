"""Repeated windows found from content-chosen anchors.

A window is ``span`` consecutive symbols (bytes or words). Symbols get 64-bit names; the name of 2m
symbols is a mix of the names of its halves, so ``log2`` doubling steps name every power of two.
The anchor of a window is its ``gram``-symbol string of least name (leftmost of equals). Equal
windows choose equal anchors, and the windows that choose one anchor are consecutive, so a document
of n symbols needs about ``2 n / (span - gram)`` rows instead of n, and loses no window:

* an anchor whose gram occurs once owns only windows that occur once: it is dropped;
* anchors with equal gram and equal stretch of owned windows (a *class*) repeat in all of them;
* of the rest, one member of each class, the owned windows are cut into ever smaller blocks, placed
  from the anchor, and ranked again in the same two steps: a block's *core* is what all its windows
  share (a core found once: nothing in it repeats), its *union* what they cover together.

Grouping is by the gram's name (64 bits) and, within it, by names of 64 or 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multipliers of the mixing step (64-bit golden ratio and two published finaliser constants).
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
R = np.uint64(32)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * K1
    x += b
    x *= K2
    x ^= x >> R
    x *= K3
    x ^= x >> R
    return x


def byte_symbols() -> np.ndarray:
    """Names of the 256 bytes."""
    x = np.arange(1, 257, dtype=np.uint64)
    return mix(mix(x, x << np.uint64(17)), x * K3)


BYTES = byte_symbols()


def names(sym: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Names of all substrings of the given lengths (ascending powers of two). Bytes get the names
    of ``byte_symbols``; 64-bit symbols are names already."""
    out, h, step = [], BYTES[sym] if sym.dtype == np.uint8 else sym, 1
    for want in lengths:
        while step < want:
            h = mix(h[:-step], h[step:]) if len(h) > step else h[:0]
            step *= 2
        out.append(h)
    return out


class Windows:
    """Sizes: ``span`` symbols a window, ``gram`` and ``block`` powers of two with
    ``block <= span <= 2 * block`` and ``2 * span - gram <= 4 * block``."""

    def __init__(self, span: int, gram: int, block: int):
        assert gram < span and block <= span <= 2 * block and 2 * span - gram <= 4 * block
        self.span, self.gram, self.block, self.grams = span, gram, block, span - gram + 1

    def rounds(self, sizes: tuple[int, ...]) -> list[int]:
        """Of the block sizes those whose cores and unions two blocks' names cover; 1 always does."""
        return [s for s in sizes if self.span - s + 1 >= self.block and self.span + s - 1 <= 2 * self.block]

    def anchors(self, sym: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray] | None:
        """One row for each anchor of the documents ``sym[off[i]:off[i + 1]]``: row index ``doc``,
        ``lo`` (first owned window, from the document's start), ``n`` (owned windows), ``key`` (the
        gram's name) and ``ctx`` (name of the owned stretch, with the anchor's place in it)."""
        t, n = self.span, len(sym)
        if n < t:
            return None
        g, b = names(sym, self.gram, self.block)
        m, w = (g & ~np.uint64(0xFFFFFFFF)) | np.arange(len(g), dtype=np.uint64), 1
        while 2 * w <= self.grams:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        if w < self.grams:
            m = np.minimum(m[: n - t + 1], m[self.grams - w : self.grams - w + n - t + 1])
        bad = np.zeros(n + 2, np.int32)
        np.add.at(bad, np.clip(np.maximum(off[1:] - t + 1, off[:-1]), 0, n), 1)
        np.add.at(bad, off[1:], -1)
        p = np.flatnonzero(np.cumsum(bad)[: n - t + 1] == 0)
        if not len(p):
            return None
        a = (m[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1))
        last = np.concatenate((first[1:], [len(p)])) - 1
        lo, hi, at = p[first], p[last], a[first]
        end, k = hi + t, self.block
        ctx = mix(mix(b[lo], b[np.minimum(lo + k, end - k)]), mix(b[np.maximum(end - 2 * k, lo)], b[end - k]))
        ctx = mix(ctx, ((at - lo) * 65536 + (hi - lo)).astype(np.uint64))
        doc = np.searchsorted(off, lo, "right") - 1
        return {"doc": doc, "lo": lo - off[doc], "n": hi - lo + 1, "at": at - lo, "key": g[at].view(np.int64), "ctx": ctx.view(np.int64)}

    def blocks(self, sym: np.ndarray, start: np.ndarray, n: np.ndarray, at: np.ndarray, size: int) -> dict[str, np.ndarray]:
        """Cut stretches (``n`` windows from ``start`` in ``sym``, the anchor ``at`` symbols on) into
        blocks of ``size`` windows. ``src`` is the stretch a block comes from, ``key`` and ``ctx``
        are names of core and union; with one window a block they are its two halves of 128 bits."""
        (b,) = names(sym, self.block)
        t, k = self.span, self.block
        first, last = (at - n + 1) // size, at // size  # blocks are numbered by distance from the anchor
        count = last - first + 1
        src = np.repeat(np.arange(len(n)), count)
        q = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count) + first[src]
        near, far = np.maximum(q * size, at[src] - n[src] + 1), np.minimum(q * size + size - 1, at[src])
        anchor = (start + at)[src]
        lo, hi = anchor - far, anchor - near
        core, core_end = anchor - q * size, anchor - q * size - size + 1 + t
        if size == 1:
            key, ctx = b[core], b[core_end - k]
        else:
            key = mix(b[core], b[core_end - k])
            ctx = mix(mix(b[lo], b[hi + t - k]), ((core - lo + size) * 65536 + (hi - lo)).astype(np.uint64))
        return {"src": src, "lo": lo - start[src], "n": hi - lo + 1, "at": far, "key": key.view(np.int64), "ctx": ctx.view(np.int64)}


def segments(off: np.ndarray, most: int, span: int):
    """Cut rows into pieces of ``most`` symbols or fewer, overlapping by ``span - 1`` within a row,
    as ``(first row, last row + 1, from, to)``; no window is lost or seen twice."""
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > most:
            for s in range(int(off[i]), max(int(off[i]) + 1, int(off[i + 1]) - span + 1), most):
                yield i, i + 1, s, min(s + most + span - 1, int(off[i + 1]))
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            j = min(j, n)
            yield i, j, int(off[i]), int(off[j])
            i = j


def long_array(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.int64))
