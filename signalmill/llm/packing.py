"""Packing of token sequences by minimum bin slack.

Every document becomes its token ids plus an end id (null text: the end id alone). Documents longer
than a window are cut into full windows and a remainder. Whole windows stand alone; the remainders
are packed. Only their lengths matter, and there are at most ``window`` different ones, so the plan
works on a histogram of lengths that Spark counts: for the largest length left, a subset-sum over
bitsets finds how close to full the window can be filled from the lengths left, and backtracking
gives how many of each length do it. That multiset is used as often as its lengths last, so the plan
has a bounded number of multisets however many documents there are. Every piece then finds its place
from its rank among the pieces of its length, which is the sum of a rank inside a shard and the
shard's offset. Whole windows have a shard for each task that made them, other lengths as many as their count
asks for, so no length is ordered in one task and shards grow in number, not in size.

A sequence is padded to ``window``, except where its length is a power of two.

Repeated rows are documents of their own. Null ids stay null. Equal pieces tie for their places, which
go by shards and in them by id, start and checksum; any order gives the same padding. A very long text is cut like any
other; a task holds the ids of one such text at a time. Columns other than doc_id and text are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.llm.scratch import materialise
from signalmill.llm.words import SEPARATORS, buffers, pieces

WINDOW, END_ID = 4096, 2
#: Pieces of a length that are ranked in one task, and into how many shards all pieces fall at least before such tasks grow.
SHARD_ROWS, MOST_SHARDS = 4096, 1 << 16
_PIECE = 2_000_000  # bytes of text at a time
#: Bounds of what a task keeps of known units: their bytes and 128 for each.
_CACHE_BYTES, _UNIT_BYTES = 48 << 20, 128
#: What the tokenizer's pre-tokeniser makes of a byte: letters and punctuation form runs, digits stand alone.
_LETTER, _MARK, _DIGIT, _HARD = 1, 2, 3, 4
_KINDS = np.full(256, _HARD, np.uint8)
_KINDS[33:127] = _MARK
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[39] = _HARD  # an apostrophe may start a clitic
_KINDS[SEPARATORS] = 0


def units_of(column: pa.Array):
    """(bytes with plain words in lower case, kind of each byte, units' starts, documents' first units).

    Words of Latin-1 letters, ASCII punctuation and digits are plain: they fall into runs of letters, runs
    of punctuation and single digits. Every other word is one hard unit: it has an apostrophe, a character
    of another kind, or ``<|``, which may open a special token.
    """
    off, data = buffers(pc.fill_null(column, ""))
    n = len(data)
    kind, low = _KINDS[data], data.copy()
    upper = (data >= 65) & (data <= 90)
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    after = data[np.minimum(lead + 1, n - 1)]
    lead = lead[np.where(data[lead] == 0xC3, (after != 0x97) & (after != 0xB7), (after == 0xAA) | (after == 0xB5) | (after == 0xBA)) & (lead + 1 < n)]
    kind[lead] = kind[lead + 1] = _LETTER
    upper[lead[(data[lead] == 0xC3) & (data[lead + 1] < 0x9F)] + 1] = True
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    inside = kind != 0
    before = np.concatenate(([False], inside[:-1]))[:n]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    hard = np.flatnonzero((kind == _HARD) | ((data == 0x3C) & (np.append(data[1:], 0)[:n] == 0x7C)))
    if len(hard):
        words = np.unique(np.searchsorted(starts, hard, side="right") - 1)
        ends = np.flatnonzero(inside & (~np.append(inside[1:], False)[:n] | first[1:])) + 1
        step = np.zeros(n + 1, np.int8)
        np.add.at(step, starts[words], 1)
        np.add.at(step, ends[words], -1)
        kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = _HARD
    low[upper & (kind != _HARD)] += 32
    same = np.concatenate(([False], kind[1:] == kind[:-1]))[:n] & (kind != _DIGIT) & ~first[:n]
    starts = np.flatnonzero(inside & ~same)
    return low, kind, starts, np.searchsorted(starts, off)


class UnitTokenizer:
    """Ids of texts from ids of their units, which are kept between batches.

    The vocabulary drops white space and joins nothing across it, and its pre-tokeniser cuts plain words
    into the units of ``units_of``, so a text's ids are its units' ids in a row. A plain unit's ids come
    from the tokenizer's model, a hard word's from the whole tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.shown = {b: b for b in keep} | {b: 256 + i for i, b in enumerate(rest)}  # a byte's character in the model
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, units: list[bytes], hard: bool) -> None:
        if hard:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        else:
            tokenize, shown = self.tokenizer.model.tokenize, self.shown
            lists = [[t.id for t in tokenize(u.decode() if u.isascii() else u.decode("latin-1").translate(shown))] for u in units]
        n = len(self.known)
        self.known.update(zip(units, range(n, n + len(units))))
        self.held += sum(map(len, units)) + _UNIT_BYTES * len(units)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(sizes)))

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of each text."""
        if self.held > _CACHE_BYTES:
            self.forget()
        low, kind, starts, doc_ptr = units_of(column)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        place = np.empty(len(starts), np.int64)
        is_hard = kind[starts] == _HARD
        for hard in (False, True):
            own = np.flatnonzero(is_hard == hard)
            if not len(own):
                continue
            taken = (kind == _HARD) if hard else (kind != 0) & (kind != _HARD)
            sums = np.cumsum(taken)
            where = np.append(sums[starts[own]] - 1, sums[-1])
            found = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(where), pa.py_buffer(low[taken])]).dictionary_encode()
            seen = found.dictionary.to_pylist()
            if new := [x for x in seen if x not in self.known]:
                self.learn(new, hard)
            place[own] = np.fromiter(map(self.known.__getitem__, seen), np.int64, len(seen))[found.indices.to_numpy()]
        count = np.diff(self.offsets)[place]
        ends = np.concatenate(([0], np.cumsum(count)))
        index = np.repeat(self.offsets[place] - ends[:-1], count)
        index += np.arange(len(index))
        return self.flat[index], ends[doc_ptr]


def token_pieces(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows and a remainder of each document."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_file)
        try:
            for batch in batches:
                for part in pieces(batch, 1, _PIECE):
                    ids, ends = tokenizer.ids(part.column(1))
                    rows, start, length, crc, total = [], [], [], [], []
                    for i in range(part.num_rows):
                        own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                        data = own.tobytes()
                        for s in range(0, len(own), window):
                            n = min(window, len(own) - s)
                            rows.append(i)
                            start.append(s)
                            length.append(n)
                            crc.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
                            total.append(len(own))
                    yield pa.record_batch([part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:  # a worker lives on after the task
            tokenizer.forget()
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


_TOKENIZERS: dict[str, UnitTokenizer] = {}


def _tokenizer(file: str) -> UnitTokenizer:
    """One for each Python worker; its units are kept for the length of a task."""
    if file not in _TOKENIZERS:
        _TOKENIZERS[file] = UnitTokenizer(file)
    return _TOKENIZERS[file]


def padding(length: int, window: int = WINDOW) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def fill(room: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """How many of each length fill ``room`` best: the largest reachable sum, by subset-sum.

    reach[i] has bit s set if the first i chunks can sum to s; a length with count c gives chunks of
    1, 2, 4, ... copies, so its bitset takes log2(c) shifts.
    """
    mask = (1 << (room + 1)) - 1
    reach, chunks = [1], []
    for n in lengths:
        copies, size = min(left[n], room // n), 1
        while copies > 0 and not reach[-1] >> room & 1:
            size = min(size, copies)
            chunks.append((n, size))
            reach.append((reach[-1] | reach[-1] << n * size) & mask)
            copies -= size
            size *= 2
        if reach[-1] >> room & 1:
            break
    best = reach[-1].bit_length() - 1
    used: dict[int, int] = {}
    for i in range(len(chunks), 0, -1):
        if not reach[i - 1] >> best & 1:
            n, size = chunks[i - 1]
            used[n] = used.get(n, 0) + size
            best -= n * size
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(lengths of one sequence with their counts, how many such sequences), until none is left."""
    left, out = dict(counts), []
    while left:
        largest = max(left)
        left[largest] -= 1
        room = window - largest
        used = fill(room, [n for n in sorted(left, reverse=True) if n <= room and left[n]], left) if room else {}
        left[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        out.append((used, times))
    return out


def sharded(cut: DataFrame, window: int, shard_rows: int) -> DataFrame:
    """Pieces with the shard of their length that they are ranked in. Whole windows, which stand alone, are ranked within the
    task that made them; other lengths have as many shards as their count asks for."""
    counts = cut.where(F.col("length") < window).groupBy("length").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = max(shard_rows, -(-total // MOST_SHARDS))
    shards = counts.select("length", F.ceil(F.col("n") / size).alias("shards"))  # a row for each length, a window's at most
    by_hash = F.pmod(F.xxhash64("row"), F.coalesce("shards", F.lit(1)))
    shard = F.when(F.col("length") == window, F.shiftright("row", 33)).otherwise(by_hash).cast("long")
    return cut.join(F.broadcast(shards), "length", "left").select(*cut.columns, shard.alias("shard"))


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = sharded(materialise(token_pieces(docs, tokenizer_file, window, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces"), window, shard_rows)
    # A row for each task with whole windows, each length and each shard: no more than tasks + window + MOST_SHARDS.
    by_shard = cut.groupBy("length", "shard").agg(F.count("*").alias("n")).orderBy("length", "shard").collect()
    counts: dict[int, int] = {}
    key, before = np.array([(r[0] << 40) + r[1] for r in by_shard], np.int64), np.zeros(len(by_shard), np.int64)
    for i, (n, _, c) in enumerate(by_shard):
        before[i] = counts.get(n, 0)
        counts[n] = counts.get(n, 0) + c
    # Of each length: from which rank on pieces go to which multiset, and where in its sequences.
    table: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    taken, sequences = dict.fromkeys(counts, 0), 0
    for used, times in plan(counts, window):
        offset = 0
        for n in sorted(used, reverse=True):
            table[n].append((taken[n], used[n], sequences, offset))
            taken[n] += used[n] * times
            offset += n * used[n]
        sequences += times
    places = docs.sparkSession.sparkContext.broadcast(({n: np.array(x, np.int64).T for n, x in table.items()}, key, before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, key, before = places.value
        for batch in batches:
            length, shard, rank = (batch.column(c).to_numpy() for c in (2, 5, 6))
            rank = before[np.searchsorted(key, (length << 40) + shard)] + rank - 1
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    n = int(length[rows[0]])
                    first, each, base, at = where[n]
                    i = np.searchsorted(first, rank[rows], side="right") - 1
                    j = rank[rows] - first[i]
                    sequence[rows] = base[i] + j // each[i]
                    offset[rows] = at[i] + j % each[i] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32")))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard", "rank").mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
