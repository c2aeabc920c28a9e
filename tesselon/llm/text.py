"""Vectorised tokens and shingles over Arrow string buffers.

A token is a run of bytes outside ``\\x20 \\x09-\\x0D``, with A-Z lowered. Tokens
are represented by 64-bit hashes computed for a whole batch at once: every byte
maps to a fixed pseudo-random value, a prefix sum of ``value * P**i`` (mod 2**64)
gives a polynomial hash of any slice, and a finaliser scrambles it. No Python
object is made per token.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 21
_SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_P = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, applied to a uint64 array (copied)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """(value per lowered byte, True for a space)."""
    raw = hashlib.shake_256(b"token bytes").digest(256 * 8)
    values = np.frombuffer(raw, dtype=np.uint64).copy() | np.uint64(1)
    for c in range(ord("A"), ord("Z") + 1):
        values[c] = values[c + 32]
    space = np.zeros(256, dtype=bool)
    space[list(_SPACES)] = True
    return values, space


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n."""
    inverse = pow(_P, -1, 1 << 64)
    out = []
    for base in (_P, inverse):
        col = np.full(n, np.uint64(base & _M64))
        col[0] = 1
        out.append(np.multiply.accumulate(col))
    return out[0], out[1]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets with one more entry than rows) of an Arrow string
    column; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(space_at, starts: np.ndarray, n: int):
    """Cut [0, n) into parts of about SEGMENT_BYTES, at row starts or spaces."""
    at = 0
    while at < n:
        end = min(n, at + SEGMENT_BYTES)
        if end < n:
            k = np.searchsorted(starts, end, side="right") - 1
            if starts[k] > at:
                end = int(starts[k])
            else:
                look = 1 << 12
                while True:
                    low, high = max(at + 1, end - look), min(n, end + look)
                    hit = np.flatnonzero(space_at(low, high))
                    if len(hit):
                        end = low + int(hit[np.argmin(np.abs(hit - (end - low)))])
                        break
                    if low == at + 1 and high == n:
                        end = n
                        break
                    look *= 4
                later = np.searchsorted(starts, at, side="right")
                if later < len(starts) and starts[later] < end:
                    end = int(starts[later])
        yield at, end
        at = end


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token in order, first token's index for each row and the
    total at the end)."""
    hashes, first, _, _ = placed_tokens(raw, offsets)
    return hashes, first


def placed_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As tokens(), and where each token starts and ends in raw."""
    values, space = _byte_tables()
    starts = np.unique(offsets[:-1])
    hashes, begins, stops = [], [], []
    for low, high in _segments(lambda a, b: space[raw[a:b]], starts, int(offsets[-1])):
        part = raw[low:high]
        solid = ~space[part]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        inside = starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)] - low
        first[inside] = solid[inside]
        before = inside[inside > 0] - 1
        last[before] = solid[before]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        up, down = _powers(1 << max(21, int(len(part) - 1).bit_length()))
        sums = values[part]
        sums *= up[: len(part)]
        np.cumsum(sums, out=sums)
        h = sums[b]
        h[a > 0] -= sums[a[a > 0] - 1]
        h *= down[a]
        h ^= (b - a).astype(np.uint64) << np.uint64(48)
        hashes.append(mix64(h))
        begins.append(a + low)
        stops.append(b + low + 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(where, offsets), where, np.concatenate(stops)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each shingle, hash of each shingle), repeats kept. A row with
    fewer words than ``width`` (but one at least) has its whole sequence as one
    shingle; a row without words has none."""
    n, counts = len(hashes), np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    full = np.maximum(counts - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h[: n - k] = mix64(h[: n - k] * np.uint64(_P) + hashes[k:]) if k else mix64(hashes)
    local = np.arange(n) - first[:-1][row] if n else np.zeros(0, np.int64)
    keep = local < full[row] if n else np.zeros(0, bool)
    rows, out = row[keep], h[keep]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            live = counts[short] > k
            at = (first[:-1][short] + k)[live]
            whole[live] = mix64(whole[live] * np.uint64(_P) + hashes[at])
        whole = mix64(whole + counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        rows, out = np.concatenate([rows, short]), np.concatenate([out, whole])
    return rows, out


def distinct_by_row(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each row one after another, where each row
    starts)."""
    if (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    h = hashes.copy()
    starts = np.searchsorted(rows, np.arange(n + 1))
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        h[a:z].sort()
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    r, h = rows[new], h[new]
    return h, np.searchsorted(r, np.arange(n + 1))


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges [a, b) of about ``limit`` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def parts(batches, column: str, limit: int = 1 << 20):
    """Record batches cut to about ``limit`` bytes of text; a longer row stands
    alone. Empty batches are left out."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        c = batch.column(batch.schema.get_field_index(column))
        kind = pa.types.is_large_string(c.type)
        offsets = np.frombuffer(c.buffers()[1], dtype=np.int64 if kind else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        for a, b in slices(offsets, limit):
            yield batch.slice(a, b - a)
