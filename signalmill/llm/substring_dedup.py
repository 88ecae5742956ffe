"""Exact removal of repeated passages by relative Lempel-Ziv parsing.

A passage is repeated if it is covered by a window of ``window`` consecutive words whose sequence also
starts anywhere else, the same document included.

The reference is all documents, cut into phrases where the text itself says: each window has an anchor, the
``gram``-word sequence in it with the smallest hash, and a phrase is what a run of windows with one anchor
covers. Equal windows have equal anchors, so a document need only be parsed against the blocks of the
reference that hold its own anchors; no other block can have a factor of it.

1. Phrases whose anchor occurs once in all documents can't hold a repeated window and are left out.
2. The reference index holds each different phrase once, by anchor and hash, however often it occurs. A
   phrase that is in it at another place is a factor as it stands. Copies and long common passages are used
   up here.
3. The different phrases of an anchor are dealt by it into blocks of bounded size, with their words, and a suffix array
   indexes all places of a block. A phrase is parsed greedily: the longest match of what comes next with any other
   place of the block is the next factor if it is as long as a window, and parsing goes on behind it; else the
   next word is a literal.
4. Windows inside a factor repeat, those that begin at literals don't, and the windows that reach over the
   end of a factor are looked up one by one in the suffix array, so none is missed at the boundaries.
5. The words that a document's factors and boundary windows cover are removed.

An anchor with over ``HOT`` different phrases isn't brought together: its phrases are cut into single
windows, which are counted by their own hashes over all tasks. A factor's source doesn't matter for the
spans. Words are compared by 64-bit hashes, windows by two independent 64-bit hashes of those.

Null texts have no words. Texts shorter than a window stay whole. Very long texts are parsed whole; a task holds
one of them at a time. Rows that repeat id and text are two documents, so their windows repeat; their spans are
gathered once. Extra columns go along, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from signalmill.llm.scratch import discard, materialise, written
from signalmill.llm.words import LANES, U64, gram_hashes, mix, pieces, powers, split_words, word_hashes

WINDOW, GRAM = 35, 8
#: Different phrases of an anchor that are parsed in one block, and bytes of phrases in a block.
HOT, BLOCK = 1000, 2_000_000


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def phrases(h: np.ndarray, doc_ptr: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(first window, windows, anchor, phrase hash, anchor's occurrences: 1 or 2 for more) of each phrase;
    windows are numbered by their first word in h."""
    empty = np.zeros(0, np.int64)
    if len(h) < window:
        return empty, empty, empty.astype(U64), empty.astype(U64), empty
    g = gram_hashes(h, gram)
    span = window - gram + 1
    low = sliding_min(g, span)
    ends = np.repeat(doc_ptr[1:], np.diff(doc_ptr))
    valid = np.flatnonzero(np.arange(len(low)) + window <= ends[: len(low)])
    if not len(valid):
        return empty, empty, empty.astype(U64), empty.astype(U64), empty
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (np.diff(valid) > 1) | (low[valid[1:]] != low[valid[:-1]])
    at = np.flatnonzero(new)
    first, count = valid[at], np.diff(np.append(at, len(valid)))
    last, anchor = first + count - 1, low[first]
    across = np.arange(span)
    left = first + (g[first[:, None] + across] == anchor[:, None]).argmax(axis=1)
    right = last + span - 1 - (g[last[:, None] + across] == anchor[:, None])[:, ::-1].argmax(axis=1)
    up, down = powers(LANES[1], len(h))
    sums = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    phrase = mix((sums[last + window] - sums[first]) * down[first] + count.astype(U64) * U64(LANES[0]))
    return first, count, anchor, phrase, 1 + (left != right)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key (k1, k2) that rows share only if they have the same id and text."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.hash("doc_id")})


def document_phrases(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0):
                w = split_words(part.column(0))
                first, count, anchor, phrase, seen = phrases(word_hashes(w), w.doc_ptr, window, gram)
                doc = np.searchsorted(w.doc_ptr, first, side="right") - 1
                own = pa.array(doc)
                yield pa.record_batch(
                    [part.column(1).take(own), part.column(2).take(own), pa.array((first - w.doc_ptr[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(seen.astype(np.int32))],
                    names=["k1", "k2", "start", "windows", "anchor", "phrase", "seen"],
                )

    return keyed(docs).select("text", "k1", "k2").mapInArrow(run, "k1 long, k2 int, start int, windows int, anchor long, phrase long, seen int")


def phrase_texts(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The text of each phrase in spans (k1, k2, spans array<start, windows, anchor, large>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(once(batch), 0):
                w = split_words(part.column(0))
                doc, start, count = flat_spans(part.column(3))
                first = w.doc_ptr[doc] + start
                texts = [w.data[a:b].tobytes() for a, b in zip(w.starts[first].tolist(), w.ends[first + count + window - 2].tolist())]
                own = pa.array(doc)
                anchor, large = (part.column(3).flatten().field(i) for i in (2, 3))
                yield pa.record_batch([anchor, part.column(1).take(own), part.column(2).take(own), pa.array(start.astype(np.int32)), pa.array(texts, pa.binary()), large], names=["anchor", "k1", "k2", "start", "words", "large"])

    joined = keyed(docs).select("text", "k1", "k2").join(spans, ["k1", "k2"]).select("text", "k1", "k2", "spans")
    return joined.mapInArrow(run, "anchor long, k1 long, k2 int, start int, words binary, large boolean")


def once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row of each key: rows that repeat id and text have the same phrases."""
    keys = np.stack((batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)))
    _, rows = np.unique(keys, axis=1, return_index=True)
    return batch if len(rows) == batch.num_rows else batch.take(pa.array(np.sort(rows)))


def suffix_order(h: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a block: all places in the order of the words from there to the end of their phrase, and where each
    place stands in it. By doubling: ranks of w words give those of 2w."""
    at, width, found = np.arange(len(h)), 1, 0
    distinct, rank = np.unique(h, return_inverse=True)
    while len(distinct) > found and len(distinct) < len(h):
        found = len(distinct)
        after = np.zeros(len(h), dtype=np.int64)
        inside = np.flatnonzero(at + width < end)
        after[inside] = rank[inside + width] + 1
        distinct, rank = np.unique(rank.astype(np.int64) * (len(h) + 1) + after, return_inverse=True)
        width *= 2
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(h), dtype=np.int64)
    place[order] = at
    return order, place


def parse(h: np.ndarray, ptr: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of what repeats in a block of phrases, phrase i having the words ptr[i]:ptr[i+1].

    All phrases are parsed side by side: in every round each takes its next factor, the longest match of what comes next with
    any other place of the block, or a literal.
    """
    spans = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(h) < window:
        return spans[0]
    end = np.repeat(ptr[1:], np.diff(ptr))
    order, place = suffix_order(h, end)
    lanes = []
    for lane in LANES:
        up, down = powers(lane, len(h))
        sums = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        lanes.append((sums, down))

    def equal(p: np.ndarray, q: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return np.logical_and(*((sums[p + n] - sums[p]) * down[p] == (sums[q + n] - sums[q]) * down[q] for sums, down in lanes))

    def neighbours(p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The places before and after each p in the suffix array, of which one has the longest match with it: which of the p
        have one, those, and the words that both have left."""
        for step in (-1, 1):
            at = place[p] + step
            use = np.flatnonzero((at >= 0) & (at < len(order)))
            q = order[at[use]]
            yield use, q, np.minimum(end[p[use]] - p[use], end[q] - q)

    def longest(p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        for use, q, high in neighbours(p):
            low = np.zeros(len(use), np.int64)
            while (low < high).any():
                mid = (low + high + 1) // 2
                same = equal(p[use], q, mid)
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            out[use] = np.maximum(out[use], low)
        return out

    def repeats(p: np.ndarray) -> np.ndarray:
        """Whether the window at p is found at another place."""
        out = np.zeros(len(p), dtype=bool)
        for use, q, both in neighbours(p):
            enough = np.flatnonzero(both >= window)
            out[use[enough]] |= equal(p[use[enough]], q[enough], window)
        return out

    active, s = np.arange(len(ptr) - 1), ptr[:-1].copy()
    while True:
        active = active[s[active] + window <= ptr[active + 1]]
        if not len(active):
            return tuple(np.concatenate(x) for x in zip(*spans))
        p = s[active]
        n = longest(p)
        hit = np.flatnonzero(n >= window)
        spans.append((p[hit], n[hit] - window + 1))
        # Windows over the end of a factor, which another factor may hold.
        stop = p[hit] + n[hit]
        first = stop - window + 1
        many = np.maximum(np.minimum(stop, ptr[active[hit] + 1] - window + 1) - first, 0)
        over = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        over = over[repeats(over)]
        spans.append((over, np.ones(len(over), np.int64)))
        s[active] = np.where(n >= window, p + n, p + 1)


def factored(texts: DataFrame, window: int) -> DataFrame:
    """k1, k2, start, windows of what repeats among the phrases (anchor, k1, k2, start, words) of an anchor."""

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        k1, k2, start, words = (pa.concat_arrays([p.column(c) for p in parts]) for c in range(1, 5))
        w = split_words(words.view(pa.string()))
        at, count = parse(word_hashes(w), w.doc_ptr, window)
        own = np.searchsorted(w.doc_ptr, at, side="right") - 1
        first = start.to_numpy()[own] + at - w.doc_ptr[own]
        return pa.RecordBatch.from_arrays([k1.take(pa.array(own)), k2.take(pa.array(own)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], names=["k1", "k2", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases come in the order of their anchors; a block ends where the anchor changes."""
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, 4, 1_000_000):
                if size >= BLOCK:
                    cut = int(np.searchsorted(part.column(0).to_numpy(), held[-1].column(0)[-1].as_py(), side="right"))
                    held.append(part.slice(0, cut))
                    if cut < part.num_rows:
                        yield found(held)
                        held, size, part = [], 0, part.slice(cut)
                    else:
                        continue
                held.append(part)
                size += part.nbytes
        if held:
            yield found(held)

    return texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "k1 long, k2 int, start int, windows int")


def single_windows(texts: DataFrame, window: int) -> DataFrame:
    """Hashes of the single windows of phrases (anchor, k1, k2, start, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = split_words(batch.column(4).view(pa.string()))
            h = word_hashes(w)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(w.doc_ptr))
            at = np.flatnonzero(np.arange(len(h)) + window <= w.doc_ptr[doc + 1])
            a, b = (gram_hashes(h, window, lane)[at] if len(at) else np.zeros(0, U64) for lane in LANES)
            own = pa.array(doc[at])
            start = batch.column(3).to_numpy()[doc[at]] + (at - w.doc_ptr[doc[at]])
            yield pa.record_batch([batch.column(1).take(own), batch.column(2).take(own), pa.array(start.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["k1", "k2", "start", "w1", "w2"])

    return texts.mapInArrow(run, "k1 long, k2 int, start int, w1 long, w2 long")


def flat_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, windows) of each element of a list column of structs; null lists are empty."""
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = column.flatten()
    start, count = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    return np.repeat(np.arange(len(column)), sizes), start, count


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined with ``keys``, which has each key once with the number ``n`` of its rows.

    Keys with more than a ten-thousandth of all rows (a thousand at least) are at most ten thousand, so
    they are broadcast, and their rows stay where they are; only the others are shuffled.
    """
    limit = max(1000, rows.count() // 10_000)
    hot = F.broadcast(keys.where(F.col("n") > limit).drop("n"))
    return rows.join(hot, on).union(rows.join(hot.select(*on), on, "left_anti").join(keys.where(F.col("n") <= limit).drop("n"), on))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """k1, k2, spans array<struct<start, windows>>: runs of repeated windows of each document."""
    every, path = written(document_phrases(docs, window, gram), "phrases")
    shared = every.groupBy("anchor").agg(F.sum("seen").alias("twice"), F.count("*").alias("n")).where("twice > 1").select("anchor", "n")
    known = materialise(with_keys(every, materialise(shared, "anchors"), ["anchor"]), "known")
    index = materialise(
        known.groupBy("anchor", "phrase").agg(F.count("*").alias("n"), F.sum("seen").alias("seen"), F.min(F.struct("k1", "k2", "start", "windows")).alias("first")), "index"
    )
    discard(docs.sparkSession, path)
    factors = with_keys(known, index.where("n > 1").select("anchor", "phrase", "n"), ["anchor", "phrase"]).select("k1", "k2", "start", "windows")
    variety = materialise(index.groupBy("anchor").agg(F.count("*").alias("n")).withColumn("different", F.col("n")), "variety")
    open_ = with_keys(index.select("anchor", "first", F.col("n").alias("copies"), "seen"), variety, ["anchor"]).where("different > 1 or (copies = 1 and seen > 1)")

    large = (F.col("different") > hot).alias("large")
    texts = phrase_texts(docs, open_.groupBy("first.k1", "first.k2").agg(F.collect_list(F.struct("first.start", "first.windows", "anchor", large)).alias("spans")), window)
    any_large = not variety.where(F.col("different") > hot).isEmpty()
    if any_large:  # else they are read once
        texts = materialise(texts, "texts")
    spans = factors.union(factored(texts.where("not large").drop("large"), window))
    if any_large:
        single = materialise(single_windows(texts.where("large").drop("large"), window), "windows")
        twice = single.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
        spans = spans.union(with_keys(single, materialise(twice, "twice"), ["w1", "w2"]).select("k1", "k2", "start", F.lit(1).alias("windows")))
    # A set: rows that repeat id and text have the same spans.
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """row (a struct of all columns of ``docs``), n_words, n_removed and kept for every row: the kept
    words joined by one space. With ``digest`` their SHA-256 is in kept, and row is without text."""
    names = [c for c in docs.columns if not (digest and c == "text")]
    marked = (
        keyed(docs.select("doc_id", "text", F.struct(*names).alias("row")))
        .join(repeated_spans(docs.select("doc_id", "text"), window, gram), ["k1", "k2"], "left").select("text", "spans", "row")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0):
                w = split_words(part.column(0))
                doc, start, count = flat_spans(part.column(1))
                step = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(step, w.doc_ptr[doc] + start, 1)
                np.add.at(step, w.doc_ptr[doc] + start + count - 1 + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                sums = np.concatenate(([0], np.cumsum(gone)))
                removed = sums[w.doc_ptr[1:]] - sums[w.doc_ptr[:-1]]
                kept = []
                for i in range(part.num_rows):
                    a, b = w.doc_ptr[i], w.doc_ptr[i + 1]
                    words = w.raw(a, b)
                    if removed[i]:
                        words = [words[j] for j in np.flatnonzero(~gone[a:b]).tolist()]
                    text = b" ".join(words)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), pa.array(np.diff(w.doc_ptr)), pa.array(removed), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"]
                )

    schema = StructType([marked.schema["row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    return marked.mapInArrow(run, schema)
