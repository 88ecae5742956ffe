"""Words of Arrow text columns as positions and 64-bit hashes, a whole batch at a time.

Words are maximal runs of bytes other than space and 0x09-0x0D. All arithmetic wraps modulo 2^64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
_BYTE_BASE = 0x9E3779B97F4A7C15
#: Odd multipliers of the two window-hash lanes.
LANES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Per base the longest powers so far, up to _CHUNK of them: a Python worker lives on between tasks.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.. modulo 2^64, n of each at least."""
    held = _POWERS.get(base)
    if held is not None and len(held[0]) >= n:
        return held
    size = 1 << max(10, int(n).bit_length())
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, dtype=U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    if size <= _CHUNK << 1:
        _POWERS[base] = (out[0], out[1])
    return out[0], out[1]


@dataclass
class Words:
    data: np.ndarray  # uint8
    starts: np.ndarray  # int64, of each word in data
    ends: np.ndarray
    doc_ptr: np.ndarray  # document i has words doc_ptr[i]:doc_ptr[i+1]
    doc_off: np.ndarray  # and bytes doc_off[i]:doc_off[i+1]
    is_word: np.ndarray  # bool, of each byte

    def raw(self, i: int, j: int) -> list[bytes]:
        """Words i to j as bytes."""
        if i >= j:
            return []
        return self.data[self.starts[i] : self.ends[j - 1]].tobytes().split()


def lowered(column: pa.Array) -> pa.Array:
    """A-Z to a-z, nothing else."""
    column = pc.fill_null(column, "")
    offsets, data = buffers(column)
    data = data.copy()
    up = (data >= 65) & (data <= 90)
    data[up] += 32
    return pa.Array.from_buffers(
        pa.large_string(), len(column), [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)]
    )


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a text column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def split_words(column: pa.Array, separators: np.ndarray = SEPARATORS) -> Words:
    """Null texts have no words."""
    off, data = buffers(pc.fill_null(column, ""))
    n = len(data)
    word = ~separators[data]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off), off, word)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes; bytes are taken a chunk at a time."""
    out = np.empty(len(w.starts), dtype=U64)
    i, n = 0, len(w.starts)
    while i < n:
        a = int(w.starts[i])
        j = max(i + 1, int(np.searchsorted(w.ends, a + _CHUNK, side="right")))
        b = int(w.ends[j - 1])
        up, down = powers(_BYTE_BASE, b - a)
        sums = np.zeros(b - a + 1, dtype=U64)
        np.cumsum((w.data[a:b].astype(U64) + U64(1)) * up[: b - a], out=sums[1:])
        s, e = w.starts[i:j] - a, w.ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(LANES[0]))
        i = j
    return out


def gram_hashes(h: np.ndarray, k: int, base: int = LANES[0]) -> np.ndarray:
    """Hash of each k consecutive word hashes; callers leave out those that cross documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    up, down = powers(base, len(h))
    sums = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def pieces(batch: pa.RecordBatch, text: int, limit: int = 2_000_000):
    """Slices of a batch with about ``limit`` bytes of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    i, n = 0, len(sizes)
    while i < n:
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j
