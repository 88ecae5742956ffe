"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at ``.``, ``!``, ``?`` and line feeds); only documents have
labels. A sentence's probability is a logistic function of its words' weights less the base rate that
sentences without weighted words would have, so that these have probability 0 and no text is toxic by
its length; a document's is the noisy-or of its sentences' probabilities. The weights are fitted to the
documents' labels through the noisy-or and a constant per document for labels that no sentence explains
(it takes no part in scores). Only words whose presence goes with the label, by a z-test over the
sample's documents, have a weight, so that rare words can't learn the labels by heart. The same sentence
probabilities then point at the offending sentences.

Words are runs of bytes other than white space and ASCII punctuation, A-Z lower-cased. The fit uses a
bounded sample of labelled rows, whole texts of any length: at most ``max_documents`` of each label, in
the order of a hash of their ids, up to ``max_bytes`` of text together. What reaches the driver are their
sentences' weighted words. Scoring covers every whole text.

Null and empty texts: no sentences, score 0. Labels other than 0 and 1 are ignored; an id with several
labels has their majority, ties toxic. Without labels of both kinds every score is 0. Repeated rows are
scored alike; of rows that repeat a labelled id one text is learned from. A very long text is scored whole,
and harmless sentences add nothing to it; a task holds one such text at a time. Columns other than doc_id and
text are ignored, or go along in ``passing``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.llm.scratch import materialise
from signalmill.llm.words import SEPARATORS, lowered, pieces, split_words, word_hashes

_PUNCTUATION = np.array([0x20 < b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b < 0x80 for b in range(256)])
#: The logit of a sentence without weighted words, before the base rate is taken off.
BIAS = -8.0
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".!?\n")] = True


@dataclass
class ToxicityModel:
    hashes: np.ndarray  # uint64, sorted
    weights: np.ndarray
    bias: float


def sentences(column: pa.Array):
    """(words' hashes, sentence of each word, words, documents' first sentences).

    Sentences without words don't count; document i has sentences first[i]:first[i+1].
    """
    w = split_words(lowered(column), SEPARATORS | _PUNCTUATION)
    h = word_hashes(w)
    breaks = np.cumsum(_BREAK[w.data])
    new = np.ones(len(h), dtype=bool)
    if len(h):
        at = breaks[w.starts]
        new[1:] = at[1:] != at[:-1]
        new[w.doc_ptr[:-1][w.doc_ptr[:-1] < len(h)]] = True
    sentence = np.cumsum(new) - 1
    first = np.concatenate((sentence, [sentence[-1] + 1 if len(h) else 0]))[w.doc_ptr]
    return h, sentence, w, first


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def gradient(weights: np.ndarray, spare: float, index: np.ndarray, bag: np.ndarray, count: np.ndarray, doc_of_bag: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the mean negative log-likelihood by the weights and, last, by ``spare``, which explains labels that no
    sentence does. It goes through the bound at 0, or words could not come back from below it."""
    z = BIAS + np.bincount(bag, weights[index], minlength=len(doc_of_bag))
    strength = np.maximum(softplus(z) - softplus(BIAS), 0)
    total = np.maximum(softplus(spare) + np.bincount(doc_of_bag, count * strength, minlength=len(y)), 1e-12)
    slope = np.where(y == 1, -1.0 / np.expm1(np.minimum(total, 500)), 1.0) / len(y)
    dz = count * slope[doc_of_bag] / (1 + np.exp(-np.maximum(z, -500)))
    return np.append(np.bincount(index, dz[bag], minlength=len(weights)), slope.sum() / (1 + np.exp(-spare)))


def fit(words: np.ndarray, index: np.ndarray, bag: np.ndarray, count: np.ndarray, doc_of_bag: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-5, rate: float = 0.2) -> ToxicityModel:
    """Noisy-or likelihood, full-batch Adam, small L2 penalty. ``index`` and ``bag`` place weighted words in
    bags, each of which stands for ``count`` sentences of its document."""
    weights, spare = np.zeros(len(words)), -2.0
    m1, m2 = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, rounds + 1):
        grad = gradient(weights, spare, index, bag, count, doc_of_bag, y)
        grad[:-1] += l2 * weights
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        move = rate * m1 / (1 - 0.9**step) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        weights = weights - move[:-1]
        spare -= move[-1]
    return ToxicityModel(words, weights, BIAS)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column | None, max_documents: int, max_bytes: int) -> DataFrame | None:
    """doc_id, text, y of the labelled documents to learn from, whole texts; None without both labels.

    Of each label the first ``max_documents`` in the order of a hash of their ids, ending before their texts
    pass ``max_bytes`` together. Of rows that repeat an id the one with the smallest text hash.
    """
    spark = docs.sparkSession
    marked = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("share"))
        .select("doc_id", (F.col("share") >= 0.5).cast("int").alias("y"))
    )
    if learn is not None:
        marked = marked.where(learn)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = marked.where("y = 1").orderBy(*order).limit(max_documents).union(marked.where("y = 0").orderBy(*order).limit(max_documents))
    sizes = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    # At most max_documents rows of a label.
    found = sizes.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text_hash", "size")).alias("x")).select("doc_id", "y", "x.*", F.xxhash64("doc_id").alias("at")).collect()
    rows, total = [], {0: 0, 1: 0}
    for r in sorted(found, key=lambda r: (r["at"], r["doc_id"])):
        total[r["y"]] += r["size"]
        if total[r["y"]] <= max_bytes or total[r["y"]] == r["size"]:
            rows.append((r["doc_id"], r["text_hash"], r["y"]))
        else:
            total[r["y"]] = max_bytes + 1  # the sample ends here, it doesn't skip what is long
    if len({y for _, _, y in rows}) < 2:
        return None
    kind = ids.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame(rows, f"doc_id {kind}, text_hash long, y int"))
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return materialise(hashed.join(chosen, ["doc_id", "text_hash"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "y"), "sample")


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_documents: int = 2000, min_z: float = 5.0, max_bytes: int = 64 << 20) -> ToxicityModel:
    """``learn``: a condition on doc_id for the rows to learn from."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's distinct words."""
        for batch in batches:
            for part in pieces(batch, 1):
                h, _, w, _ = sentences(part.column(1))
                for i in range(part.num_rows):
                    own = np.unique(h[w.doc_ptr[i] : w.doc_ptr[i + 1]])
                    yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(np.full(len(own), part.column(2)[i].as_py(), np.int64))], names=["hash", "toxic"])

    chosen = labelled_sample(docs, labels, learn, max_documents, max_bytes)
    if chosen is None:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    labelled = {r[0]: r[1] for r in chosen.groupBy("y").count().collect()}
    total, base = sum(labelled.values()), labelled[1] / sum(labelled.values())
    df = chosen.mapInArrow(present, "hash long, toxic long").groupBy("hash").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    spread = F.sqrt(F.col("n") * base * (1 - base) * F.greatest(1 - F.col("n") / total, F.lit(1e-9)))
    words = np.sort(np.array([r[0] for r in df.where(F.abs(F.col("toxic") - F.col("n") * base) >= min_z * spread).select("hash").collect()], np.int64).view(np.uint64))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's distinct bags of weighted words, as places in ``words``, and their numbers of sentences."""
        for batch in batches:
            for part in pieces(batch, 1):
                h, sentence, _, first = sentences(part.column(1))
                place = np.searchsorted(words, h)
                hit = np.flatnonzero(words[np.minimum(place, len(words) - 1)] == h) if len(words) else np.zeros(0, np.int64)
                at, s = place[hit].astype("<i4"), sentence[hit]
                order = np.lexsort((at, s))
                at, s = at[order], s[order]
                cut = np.append(np.flatnonzero(np.diff(s, prepend=-1)), len(s))
                ends = np.searchsorted(s[cut[:-1]], first)
                for i in range(part.num_rows):
                    found = Counter(at[cut[j] : cut[j + 1]].tobytes() for j in range(ends[i], ends[i + 1]))
                    own = sorted(found)
                    yield pa.record_batch(
                        [part.column(0).slice(i, 1), part.column(2).slice(i, 1), pa.array([own], pa.list_(pa.binary())), pa.array([[found[b] for b in own]], pa.list_(pa.int64()))],
                        names=["doc_id", "y", "bags", "counts"],
                    )

    rows = chosen.mapInArrow(bags, "doc_id long, y int, bags array<binary>, counts array<long>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.bags, r.counts))
    found = [np.frombuffer(b, "<i4") for r in rows for b in r.bags]
    index = np.concatenate([np.zeros(0, "<i4"), *found])
    return fit(
        words, index, np.repeat(np.arange(len(found)), np.array([len(b) for b in found], np.int64)), np.array([c for r in rows for c in r.counts], np.float64),
        np.repeat(np.arange(len(rows)), np.array([len(r.bags) for r in rows], np.int64)), np.array([r.y for r in rows]),
    )


def _sentence_strengths(model: ToxicityModel, column: pa.Array):
    """Each sentence's -log(1 - probability), the words, the words' sentences, documents' first sentences."""
    h, sentence, w, first = sentences(column)
    n = int(first[-1])
    if not len(model.hashes):
        return np.zeros(n), w, sentence, first
    place = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
    hit = model.hashes[place] == h
    z = model.bias + np.bincount(sentence[hit], model.weights[place[hit]], minlength=n)
    return np.maximum(softplus(z) - softplus(model.bias), 0), w, sentence, first


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, text_hash, score, n_sentences, n_offending (probability of 0.5 or more) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                strength, _, _, first = _sentence_strengths(model, part.column(1))
                sums = np.concatenate(([0.0], np.cumsum(strength)))
                bad = np.concatenate(([0], np.cumsum(strength >= np.log(2.0))))
                total = np.maximum(sums[first[1:]] - sums[first[:-1]], 0)
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array(-np.expm1(-total)), pa.array(np.diff(first).astype(np.int64)), pa.array((bad[first[1:]] - bad[first[:-1]]).astype(np.int64))],
                    names=["doc_id", "text_hash", "score", "n_sentences", "n_offending"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, score double, n_sentences long, n_offending long")


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, sentence (from 0), start, end (bytes of the text's UTF-8), probability, of sentences at
    or over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                strength, w, sentence, first = _sentence_strengths(model, part.column(1))
                p = -np.expm1(-strength)
                s = np.flatnonzero(p >= threshold)
                doc = np.searchsorted(first, s, side="right") - 1
                a, b = np.searchsorted(sentence, s), np.searchsorted(sentence, s, side="right") - 1
                off = w.doc_off[doc]
                yield pa.record_batch(
                    [part.column(0).take(pa.array(doc)), pa.array(s - first[doc]), pa.array((w.starts[a] if len(s) else a) - off), pa.array((w.ends[b] if len(s) else b) - off), pa.array(p[s])],
                    names=["doc_id", "sentence", "start", "end", "probability"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentence long, start long, end long, probability double")


def passing(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""
    places = docs.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, places):
                strength, _, _, first = _sentence_strengths(model, part.column(places))
                sums = np.concatenate(([0.0], np.cumsum(strength)))
                fine = -np.expm1(-(sums[first[1:]] - sums[first[:-1]])) < threshold
                yield part.filter(pa.array(fine))

    return docs.mapInArrow(run, docs.schema)
