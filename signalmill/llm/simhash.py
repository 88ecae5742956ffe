"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprint: A-Z lower-cased, words, 3-word shingles with repeats, joined by single spaces (fewer
words: the whole sequence; none, or null text: fingerprint zero); each shingle's XXH64 (UTF-8, seed
42); a bit is 1 if set in over half of them. Fingerprints link at ``radius`` = 3 or fewer differing
bits.

Equal fingerprints become one node first, so copies cost nothing more. The fingerprint is a ring of
four 16-bit segments. Of two fingerprints with at most 3 differing bits, some start on the ring has
differences d0 <= 0, d0+d1 <= 1, d0+d1+d2 <= 2 and d0+d1+d2+d3 <= 3 (budgets in proportion, rounded
down). So every fingerprint is filed under each start with its first segment whole and its second
with one bit masked: 4 * 16 keys of 31 bits. Fingerprints that meet under a key have a chain of two
segments within budget; pairs are then held to the third budget, and only those left to the full
Hamming check. Within a key a breadth-first walk emits a spanning forest of the links, never all
pairs, which keeps every connection; a key with more than ``HOT`` different fingerprints is dealt into
tiles, and pairs of tiles are walked in tasks of their own. Components are found over the forests.

Null ids count as no id: a component's id is its smallest id, null if it has none. Repeated rows are
copies. Equal smallest ids tie for keeper by the text's hash; rows equal in both are marked alike. Very long
texts count whole; a task holds one of them at a time. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.llm.components import connected_components
from signalmill.llm.scratch import materialise
from signalmill.llm.words import lowered, pieces, split_words

SEED, SHINGLE, RADIUS, SEGMENT = 42, 3, 3, 16
#: Fingerprints of one key that a task compares at once.
HOT = 1 << 15
U64 = np.uint64


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """Unsigned 64-bit fingerprints of a text column."""
    w = split_words(lowered(column))
    sizes = w.ends - w.starts
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    # Words of neighbouring documents may touch in w.data, so they are joined document by document.
    text = b" ".join(b" ".join(w.raw(w.doc_ptr[i], w.doc_ptr[i + 1])) for i in range(len(column)) if w.doc_ptr[i] < w.doc_ptr[i + 1])
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(column), dtype=U64)
    weights = U64(1) << np.arange(64, dtype=U64)
    for i in range(len(column)):
        a, b = int(w.doc_ptr[i]), int(w.doc_ptr[i + 1])
        if a == b:
            continue
        m = max(1, b - a - SHINGLE + 1)
        begin, end = at[a : a + m].tolist(), (at[b - m + 1 : b + 1] - 1).tolist()
        counts = np.zeros(64, dtype=np.int64)
        for j in range(0, m, 65536):
            h = np.array([digest(text[s:e], SEED) for s, e in zip(begin[j : j + 65536], end[j : j + 65536])], dtype="<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[counts * 2 > m].sum(dtype=U64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                fp = fingerprints_of(part.column(1)).view(np.int64)
                yield pa.record_batch([part.column(0), part.column(2), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _rotated(fp: np.ndarray, start: int) -> np.ndarray:
    """The ring's segments from ``start`` on, the first in the lowest bits."""
    if start == 0:
        return fp
    s = U64(SEGMENT * start)
    return (fp >> s) | (fp << (U64(64) - s))


def forest(fps: np.ndarray, start: int, bit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span what is connected among fingerprints that share the key (start, bit)."""
    ring = _rotated(fps, start)
    flag = U64(1) << U64(SEGMENT + bit)
    second, third = U64(0xFFFF << SEGMENT), U64(0xFFFF << 2 * SEGMENT)
    if bit and ((ring & flag) == (ring[0] & flag)).all():
        return []  # pairs equal in the second segment are compared under bit 0
    out, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            u = frontier.pop()
            diff = ring[rest] ^ ring[u]
            apart = diff & second
            ok = (apart == flag) | ((apart == 0) if bit == 0 else False)
            chain = ok & (np.bitwise_count(diff & (second | third)) <= 2)  # the third budget
            near = chain.copy()
            near[chain] = np.bitwise_count(diff[chain]) <= RADIUS
            if near.any():
                out.append((np.full(int(near.sum()), fps[u]), fps[rest[near]]))
                frontier.extend(rest[near].tolist())
                rest = rest[~near]
    return out


def filed_under(distinct: DataFrame) -> DataFrame:
    """key, first, fp: each fingerprint under its 64 keys; ``first`` is the start and the whole segment of a key.

    A row becomes 64, so rows are spread before; adaptive execution would see only the small input.
    """
    spark = distinct.sparkSession
    start, bit = F.col("i") % 4, F.floor(F.col("i") / 4).cast("int")
    ring = F.call_function("shiftrightunsigned", F.col("fp"), start * SEGMENT).bitwiseOR(
        F.when(start == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.col("fp"), 64 - start * SEGMENT))
    )
    first = ring.bitwiseAND(F.lit(0xFFFF))
    second = F.call_function("shiftrightunsigned", ring, F.lit(SEGMENT)).bitwiseAND(F.lit(0xFFFF))
    masked = second.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
    key = (F.col("i").cast("long") * F.lit(1 << 32)) + masked * F.lit(1 << 16) + first
    spread = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    return spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(key.alias("key"), (start.cast("long") * F.lit(1 << 16) + first).alias("first"), "fp")


def hot_keys(distinct: DataFrame, filed: DataFrame, hot: int) -> DataFrame | None:
    """key, n of keys with more than ``hot`` fingerprints; None if there are none.

    Counts by start and whole segment come first: they are at most 4 * 65,536 rows, and only where they
    are large can a key be.
    """
    segments = F.explode(F.array(*[F.lit(s << 16).cast("long") + F.call_function("shiftrightunsigned", F.col("fp"), F.lit(s * SEGMENT)).bitwiseAND(F.lit(0xFFFF)) for s in range(4)]))
    full = distinct.select(segments.alias("first")).groupBy("first").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("first")
    full = materialise(full, "full")
    if full.isEmpty():
        return None
    keys = filed.join(F.broadcast(full), "first", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    return materialise(keys, "hot")


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links that connect the distinct fingerprints ``fp`` as far as they are connected."""
    filed = filed_under(distinct)
    hot = hot_keys(distinct, filed, HOT)
    usual = filed if hot is None else filed.join(hot, "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys come in order. Links of each key's fingerprints."""
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def whole(keys: np.ndarray, fps: np.ndarray):
            cut = np.flatnonzero(np.diff(keys)) + 1
            begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
            for s, e in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist()):
                found = forest(fps[s:e].view(U64), *start_and_bit(int(keys[s])))
                if found:
                    x, y = (np.concatenate(z).view(np.int64) for z in zip(*found))
                    yield pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((held_k, batch.column(0).to_numpy()))
            fps = np.concatenate((held_f, batch.column(1).to_numpy()))
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            held_k, held_f = keys[cut:], fps[cut:]
            if cut:
                yield from whole(keys[:cut], fps[:cut])
        if len(held_k):
            yield from whole(held_k, held_f)

    found = usual.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    return found if hot is None else found.unionByName(hot_links(filed, hot, HOT))


def start_and_bit(key: int) -> tuple[int, int]:
    i = key >> 32
    return i % 4, i // 4


def hot_links(filed: DataFrame, keys: DataFrame, hot: int) -> DataFrame:
    """Links under large keys (key, n): each key's fingerprints are dealt into tiles of some ``hot``, and every
    pair of tiles is a group of its own before the shuffle, so no task holds more than two tiles."""
    tiles = keys.select("key", F.ceil(F.col("n") / hot).cast("int").alias("n"))
    tile = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = filed.select("key", "fp").join(tiles, "key").withColumn("t", tile).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    paired = dealt.select("key", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "fp")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = forest(np.unique(pdf.fp.to_numpy()).view(U64), *start_and_bit(int(key[0])))
        a, b = ([np.concatenate(x).view(np.int64) for x in zip(*found)]) if found else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": a, "b": b})

    return paired.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, component_id, keeper for every row of ``docs`` (doc_id, text); keeper
    marks the rows equal to their component's first row by (doc_id, text hash), ids before nulls."""
    rows = materialise(fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.min(order).alias("first"))
    nodes = materialise(nodes, "nodes")
    roots = connected_components(links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = placed.groupBy("root").agg(F.min("smallest").alias("component_id"), F.min("first").alias("first"))
    by_fp = placed.select("fp", "root").join(heads, "root").select("fp", "component_id", "first")
    keeper = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return rows.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "component_id", keeper.alias("keeper"))


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
