"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to owners, each a run of terms from rare to frequent with an equal share of
all postings. An item's bundle visits the owners one after the other and carries sparse accumulators: the
documents met so far with their integer scores. At an owner a cogroup brings bundles and postings together, the
owner's contributions are added, and the bundle goes on to the next; the last owner gives the best documents.

Bundles and postings are keyed by a block of ``BLOCK`` documents that lie together in the input and a group of
``GROUP`` items, so neither a frequent term nor a large bundle is ever in one task as a whole: a task holds the postings
of one owner in one block. Between owners a bundle loses documents that can't come among the best of their own block
any more: those whose score plus all that the remaining owners could add is under the block's k-th score so
far. Nothing is lost by that; all arithmetic is in 64-bit integers.

1. One scan of the texts counts, for each document, its terms and those of them that are in items (the index: ids,
   counts and term numbers, written once).
2. From the index: N, L, and df of each item term, by partial sums; then weights and owners.
3. The owners' stages, each one exchange of bundles, and of postings made from the index.
4. Each block's best documents; Spark keeps ``k`` an item in each task before they meet.

Items go in passes of at most ``PASS_TERMS`` terms with repeats, so that what is sent to the tasks (terms
and items) has a fixed bound; each pass is a scan of its own. Terms are compared by 64-bit hashes and lengths
in bytes. Null and empty texts have no terms: such documents count nowhere and such items get no rows. Texts
of any length count whole; a task holds one at a time. Equal scores go by ascending doc_id, null ids last, then by
place in the input. Repeated documents are ranked each, repeated items get rows each. Other columns are ignored,
whatever their names. An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.llm.scratch import materialise
from signalmill.llm.words import U64, lowered, pieces, split_words, word_hashes

#: Everything of ASCII but digits and letters.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BLOCK, GROUP, OWNERS, PASS_TERMS = 4096, 256, 4, 1_000_000
#: Of the score: numerator and the two factors of its denominator.
TOP, PER_TF, PER_LENGTH = 1_000_000_000, 1000, 12
BUNDLE = "block long, grp int, item int, docs array<int>, scores array<long>"


def term_hashes(column: pa.Array):
    """Words of a text column and their hashes; a hash is of the bytes and their number."""
    w = split_words(lowered(column), SEPARATORS)
    return w, word_hashes(w)


@dataclass
class Items:
    """Items of one pass: terms by hash in ascending order; of item i the terms term[ptr[i]:ptr[i+1]], each once, with how
    often it holds them."""

    hashes: np.ndarray
    ptr: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Items:
        w, h = term_hashes(pa.array(texts, pa.string()))
        hashes, term = np.unique(h, return_inverse=True)
        item = np.repeat(np.arange(len(texts)), np.diff(w.doc_ptr))
        pairs, times = np.unique(item.astype(np.int64) * max(1, len(hashes)) + term, return_counts=True)
        item, term = np.divmod(pairs, max(1, len(hashes)))
        return cls(hashes, np.searchsorted(item, np.arange(len(texts) + 1)), term, times)


@dataclass
class Plan:
    """What the stages need: a weight and an owner for each term, and the mean length."""

    weight: np.ndarray
    owner: np.ndarray
    bound: np.ndarray  # of what a term can add to a document's score
    n_docs: int
    n_terms: int

    @classmethod
    def of(cls, n_docs: int, n_terms: int, df: np.ndarray, max_tf: np.ndarray, owners: int) -> Plan:
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        order = np.argsort(df, kind="stable")
        owner = np.empty(len(df), dtype=np.int64)
        owner[order] = np.maximum(0, (np.cumsum(df[order]) - 1) * owners // max(1, int(df.sum())))
        # No document is shorter than m = 75.
        return cls(weight, owner, weight * impacts(max_tf, np.full(len(df), 75)), n_docs, n_terms)

    def length_part(self, n: np.ndarray) -> np.ndarray:
        return 75 + 25 * n * self.n_docs // max(1, self.n_terms)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return TOP * tf // (PER_TF * tf + PER_LENGTH * m)


def index(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """A row for each document: row, doc_id, n (its terms), terms and tfs (of those in ``hashes``, by their numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2):
                w, h = term_hashes(batch.column(2))
                at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                hit = np.flatnonzero(hashes[at] == h) if len(hashes) else np.zeros(0, dtype=np.int64)
                doc = np.searchsorted(w.doc_ptr, hit, side="right") - 1
                pairs, tf = np.unique(doc * np.int64(len(hashes) or 1) + at[hit], return_counts=True)
                doc, term = np.divmod(pairs, np.int64(len(hashes) or 1))
                ptr = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.diff(w.doc_ptr), pa.int64()), pa.ListArray.from_arrays(ptr, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ptr, pa.array(tf, pa.int64()))],
                    names=["row", "doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, "row long, doc_id long, n long, terms array<int>, tfs array<long>"), "index")


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and how many each row has; no list is null."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    return array.flatten().to_numpy(zero_copy_only=False), array.value_lengths().to_numpy(zero_copy_only=False)


def postings(indexed: DataFrame, items: Items, plan: Plan, owner: int, last: bool) -> DataFrame:
    """What an owner holds, by block and group of items: documents (their places in the block), terms and impacts.
    The last owner's rows tell the ids of all documents too."""
    mine = plan.owner == owner
    n_groups = -(-(len(items.ptr) - 1) // GROUP)
    in_group = [np.zeros(len(items.hashes), dtype=bool) for _ in range(n_groups)]
    for g, flags in enumerate(in_group):
        flags[items.term[items.ptr[g * GROUP] : items.ptr[min(len(items.ptr) - 1, (g + 1) * GROUP)]]] = True
        flags &= mine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column(0).to_numpy()
            term, sizes = _flat(batch.column(3))
            tf, _ = _flat(batch.column(4))
            doc = np.repeat(np.arange(len(row)), sizes)
            m = plan.length_part(batch.column(2).to_numpy())
            block, place = row // BLOCK, (row % BLOCK).astype(np.int32)
            out = {c: [] for c in ("block", "grp", "docs", "terms", "impacts", "rows", "ids")}
            for b in np.unique(block):
                for g, flags in enumerate(in_group):
                    use = np.flatnonzero((block[doc] == b) & flags[term])
                    own = np.flatnonzero(block == b) if last else []
                    if len(use) or len(own):
                        values = (b, g, place[doc[use]], term[use], impacts(tf[use], m[doc[use]]), place[own], batch.column(1).take(pa.array(own, pa.int64())))
                        for c, v in zip(out, values):
                            out[c].append(v)
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x.to_pylist() if isinstance(x, pa.Array) else x for x in v], kind) for v, kind in zip(out.values(), kinds)], names=list(out))

    return indexed.mapInArrow(run, "block long, grp int, docs array<int>, terms array<int>, impacts array<long>, rows array<int>, ids array<long>")


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score; 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def visit(bundles: DataFrame, held: DataFrame, items: Items, plan: Plan, owner: int, k: int, last: bool) -> DataFrame:
    """One owner's stage. Bundles that have nothing yet begin here. The last one gives (item, row, doc_id, score)."""

    def scores(left: pa.Table, right: pa.Table, grp: int) -> Iterator[tuple[int, np.ndarray]]:
        """The items of the group with the accumulators of all documents in the block."""
        docs, _ = _flat(right["docs"])
        term, _ = _flat(right["terms"])
        impact, _ = _flat(right["impacts"])
        order = np.argsort(term, kind="stable")
        term, docs, impact = term[order], docs[order], impact[order]
        had_docs, sizes = _flat(left["docs"])
        had, _ = _flat(left["scores"])
        ends = np.cumsum(sizes)
        carried = {int(i): (e - s, e) for i, s, e in zip(left["item"].to_numpy(), sizes, ends)}
        for i in range(grp * GROUP, min(len(items.ptr) - 1, (grp + 1) * GROUP)):
            own = slice(items.ptr[i], items.ptr[i + 1])
            mine = plan.owner[items.term[own]] == owner
            terms, times = items.term[own][mine], items.times[own][mine]
            first, end = np.searchsorted(term, terms), np.searchsorted(term, terms, side="right")
            if i not in carried and not (end > first).any():
                continue
            acc = np.zeros(BLOCK, dtype=np.int64)
            if i in carried:
                a, b = carried[i]
                acc[had_docs[a:b]] = had[a:b]
            for t, c, s, e in zip(terms, times, first, end):
                acc[docs[s:e]] += c * plan.weight[t] * impact[s:e]
            yield i, acc

    def step(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, grp = key[0].as_py(), key[1].as_py()
        out: list[list] = [[], [], []]
        for i, acc in scores(left, right, grp):
            own = slice(items.ptr[i], items.ptr[i + 1])
            later = plan.owner[items.term[own]] > owner
            rest = int((items.times[own] * plan.bound[items.term[own]])[later].sum())
            met = np.flatnonzero(acc)
            met = met[acc[met] + rest >= kth(acc[met], k)]
            for c, v in zip(out, (i, met.astype(np.int32), acc[met])):
                c.append(v)
        n = len(out[0])
        return pa.table([pa.array([block] * n, pa.int64()), pa.array([grp] * n, pa.int32()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int64()))], names=["block", "grp", "item", "docs", "scores"])

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, grp = key[0].as_py(), key[1].as_py()
        places, _ = _flat(right["rows"])
        ids = pa.concat_arrays([x.flatten() for x in right["ids"].chunks]) if right.num_rows else pa.array([], pa.int64())
        no_id, number = np.ones(BLOCK, dtype=bool), np.zeros(BLOCK, dtype=np.int64)
        no_id[places], number[places] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        out: list[list] = [[], [], []]
        for i, acc in scores(left, right, grp):
            met = np.flatnonzero(acc)
            met = met[acc[met] >= kth(acc[met], k)]
            best = met[np.lexsort((met, number[met], no_id[met], -acc[met]))[:k]]
            for c, v in zip(out, (np.full(len(best), i), best, acc[best])):
                c.append(v)
        item, best, score = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out)
        return pa.table([pa.array(item, pa.int32()), pa.array(block * BLOCK + best, pa.int64()), pa.array(number[best], pa.int64(), mask=no_id[best]), pa.array(score, pa.int64())], names=["item", "row", "doc_id", "score"])

    keys = ("block", "grp")
    pairs = bundles.groupBy(*keys).cogroup(held.groupBy(*keys))
    return pairs.applyInArrow(finish, "item int, row long, doc_id long, score long") if last else pairs.applyInArrow(step, BUNDLE)


def _one_pass(docs: DataFrame, texts: list[str | None], k: int, owners: int) -> DataFrame:
    """item (its place in ``texts``), rank, doc_id, score."""
    spark, items = docs.sparkSession, Items.of(texts)
    indexed = index(docs, items.hashes)
    total = indexed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    seen = indexed.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.count("*").alias("df"), F.max("x.tfs").alias("max_tf")).toArrow()
    df, max_tf = np.zeros(len(items.hashes), dtype=np.int64), np.ones(len(items.hashes), dtype=np.int64)
    df[seen["term"].to_numpy()], max_tf[seen["term"].to_numpy()] = seen["df"].to_numpy(), seen["max_tf"].to_numpy()
    plan = Plan.of(total[0], total[1], df, max_tf, owners)
    bundles = spark.createDataFrame([], BUNDLE)
    for owner in range(owners):
        last = owner == owners - 1
        bundles = visit(bundles, postings(indexed, items, plan, owner, last), items, plan, owner, k, last)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return bundles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, owners: int = OWNERS, pass_terms: int = PASS_TERMS) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out, passed, ids, texts, size = [], 0, [], [], 0

    def flush() -> None:
        nonlocal passed, ids, texts, size
        if ids:
            found = _one_pass(docs, texts, k, owners)
            names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
            out.append(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
        passed, ids, texts, size = passed + 1, [], [], 0

    # Items stream to the driver partition by partition; a pass of them is held at a time.
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        n = len(split_words(pa.array([text], pa.string()), SEPARATORS).starts)
        if n and size + n > pass_terms:
            flush()
        if n:
            ids.append(item_id)
            texts.append(text)
            size += n
    flush()
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
