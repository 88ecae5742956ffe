"""Benchmark decontamination: size-partitioned MinHash containment search.

Texts are sequences of words, A-Z lower-cased; shingles are ``k`` = 5 words in a row (an item of fewer
words is one shingle of that many). An item is found in a document if at least ``threshold`` = 0.8 of
its distinct shingles occur there.

An item has a MinHash sketch: the shingles with its smallest hash values. Items are partitioned by
their number of shingles in powers of two, and a partition's sketch size is the number of shingles that
an item of its upper size may lack, plus one. So a document that contains an item holds at least one
shingle of its sketch, however long the document is: the search loses nothing. A document is a candidate
for an item if it holds as many of the sketch as the threshold implies; candidates are then verified on
the words themselves, by exact containment of the item's shingles.

Documents are scanned where they are and never shuffled. Items are sent to the tasks in blocks of at most
``block_shingles`` shingles, with one scan of the documents for each block, so what is broadcast has a
fixed bound however many items there are; a single larger item makes a block of its own, so that one item
should fit a task's memory several times. A benchmark of many blocks means as many scans.

Null and empty items are never found; null and empty texts contain nothing. Repeated items count once;
items with one id and different texts are items of their own. Repeated documents give repeated rows. Items that tie,
with equal containment in one document, are all found; at the threshold itself an item is found. Very long
texts are searched whole; a task holds one of them at a time. Other columns are ignored, or go along in ``clean``,
whatever their names. An empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.llm.scratch import materialise
from signalmill.llm.words import U64, Words, gram_hashes, lowered, pieces, split_words, word_hashes

SHINGLE, THRESHOLD, BLOCK_SHINGLES = 5, 0.8, 1_000_000


def allowed_misses(n: int, threshold: float) -> int:
    """How many of n shingles may be missing."""
    return n - int(np.ceil(n * threshold - 1e-9))


def item_sketch(hashes: np.ndarray, threshold: float) -> np.ndarray:
    """The bottom hashes of an item's distinct shingles, as many as its size partition asks for."""
    upper = 1 << (len(hashes) - 1).bit_length()
    return np.sort(hashes)[: allowed_misses(upper, threshold) + 1]


class ItemBlock:
    """Items with their shingles and an index of their sketches."""

    def __init__(self, rows: list[tuple], k: int, threshold: float):
        self.k, self.threshold, self.items = k, threshold, []
        by_size: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            w = split_words(lowered(pa.array([text])))
            n = len(w.starts)
            if not n:
                continue
            size = min(k, n)
            h = gram_hashes(word_hashes(w), size)
            words = w.raw(0, n)
            shingles = {b" ".join(words[i : i + size]) for i in range(n - size + 1)}
            distinct = np.unique(h)
            sketch = item_sketch(distinct, threshold)
            need = max(1, len(sketch) - allowed_misses(len(distinct), threshold))
            by_size.setdefault(size, []).extend((int(x), len(self.items)) for x in sketch)
            self.items.append((item_id, size, shingles, need))
        self.index = {}
        for size, pairs in by_size.items():
            pairs.sort()
            self.index[size] = (np.array([p[0] for p in pairs], U64), np.array([p[1] for p in pairs], np.int64))

    def candidates(self, w: Words) -> list[tuple[int, int]]:
        """(document, item) pairs with enough of a sketch in the document."""
        h = word_hashes(w)
        out = []
        for size, (keys, owner) in self.index.items():
            g = gram_hashes(h, size)
            if not len(g):
                continue
            place = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == g)
            doc = np.searchsorted(w.doc_ptr, hit, side="right") - 1
            inside = hit + size <= w.doc_ptr[doc + 1]
            hit, doc = hit[inside], doc[inside]
            # A document's distinct sketch shingles, then each item that has them.
            _, one = np.unique(np.stack((doc.astype(U64), g[hit])), axis=1, return_index=True)
            doc, found = doc[one], g[hit[one]]
            first, last = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
            n = last - first
            which = owner[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pairs, times = np.unique(np.stack((np.repeat(doc, n), which)), axis=1, return_counts=True)
            out += [(int(d), int(i)) for d, i, t in zip(*pairs, times) if t >= self.items[int(i)][3]]
        return sorted(out)

    def contained(self, column: pa.Array):
        """(document, item id, shingles, shared) of verified pairs."""
        w = split_words(lowered(column))
        last, held = None, {}
        for doc, i in self.candidates(w):
            if doc != last:
                last, words, held = doc, w.raw(w.doc_ptr[doc], w.doc_ptr[doc + 1]), {}
            item_id, size, shingles, _ = self.items[i]
            if size not in held:
                held[size] = {b" ".join(words[j : j + size]) for j in range(len(words) - size + 1)}
            shared = len(shingles & held[size])
            if len(shingles) - shared <= allowed_misses(len(shingles), self.threshold):
                yield doc, item_id, len(shingles), shared


def item_blocks(docs: DataFrame, benchmark: DataFrame, k: int, threshold: float, block_shingles: int):
    """Broadcast blocks of items, one after the other."""
    items = materialise(benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "items")
    # Words, and so shingles, are fewer than bytes; items go to blocks by their bytes.
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (4 * block_shingles)))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield docs.sparkSession.sparkContext.broadcast(([tuple(r) for r in rows], k, threshold))


_HELD: list = [None, None]  # a broadcast value and its index, in each Python worker


def _block(shared) -> ItemBlock:
    if _HELD[0] is not shared.value:
        _HELD[:] = [shared.value, ItemBlock(*shared.value)]
    return _HELD[1]


def find_items(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of each item found in a document."""
    out = None
    for shared in item_blocks(docs, benchmark, k, threshold, block_shingles):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = _block(shared)
            for batch in batches:
                for part in pieces(batch, 1):
                    found = list(block.contained(part.column(1)))
                    doc, item, n, m = (list(c) for c in zip(*found)) if found else ([], [], [], [])
                    yield pa.record_batch([part.column(0).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["doc_id", "item_id", "n_shingles", "n_shared"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_shared long")
        out = found if out is None else out.union(found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    place = docs.schema.names.index("text")
    out = docs
    for shared in item_blocks(docs, benchmark, k, threshold, block_shingles):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = _block(shared)
            for batch in batches:
                for part in pieces(batch, place):
                    fine = np.ones(part.num_rows, dtype=bool)
                    fine[[d for d, *_ in block.contained(part.column(place))]] = False
                    yield part.filter(pa.array(fine))

        out = out.mapInArrow(run, docs.schema)
    return out
