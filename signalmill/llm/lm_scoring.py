"""Language-model scoring by masked pseudo-likelihood.

A small network predicts every word from the ``reach`` words on both of its sides: their embeddings, one
table for each place, are added and passed through tanh, and a two-level softmax gives the word, first
its class, then its place in the class. A document's pseudo-log-likelihood is the sum of the conditional
log-probabilities of its words; its score is the mean.

The vocabulary holds the most frequent words of all documents, counted by Spark, as many as the square root of
the documents' number of words, 960 at least and 262,080 at most, so the network grows with the corpus;
other words share ``unknown`` tokens by their hash. Every row trains the network once: each of its words in turn is
masked and predicted from all words around it. Training is data-parallel: as many tasks as the cluster has cores
stream through the rows, each running stochastic gradient descent in numpy on its own, by steps that grow
with the words it has seen; the tasks' parameters are averaged by a Spark aggregation weighted by words,
and the next part of the rows starts from the average. What is shuffled is cores times parameters, whatever the
number of rows. The parameters, and by them the scores, hang a little on how Spark deals the rows to tasks;
for a fixed network scores are exact and repeatable.

Null and empty texts: no words, sum 0 and mean 0. Null ids train with the first part and are scored like
others. Very long texts are worked through in steps; a task holds one such text at a time. Repeated rows
train as often as they occur and are scored alike; ties in the counts go to the smaller hash. Columns
other than doc_id and text are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.llm.scratch import materialise
from signalmill.llm.words import U64, lowered, pieces, split_words, word_hashes

CLASSES, WIDTH, REACH, UNKNOWN = 32, 24, 2, 64
#: The smallest vocabulary, and the numbers of a network's parameters that travel as one row.
VOCABULARY, BLOCK = CLASSES * CLASSES, 8192
#: The largest vocabulary: what is broadcast, 100 MB of parameters at most, must be bounded.
LARGEST = 1 << 18
#: The most words of a step.
STEP = 8192
#: Rows of outputs that fit a core's cache.
CACHED = 1024
#: Bound of every parameter: an output is within (WIDTH + 1) * LIMIT = 75, and its exponential is a float32.
LIMIT = 3.0


def count_words(docs: DataFrame) -> DataFrame:
    """hash, n of every word of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0, 16_000_000):
                h, n = np.unique(word_hashes(split_words(lowered(part.column(0)))), return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def vocabulary_size(words: int) -> int:
    """For a corpus of so many words; a network rounds it up to a square."""
    return min(LARGEST, max(VOCABULARY, math.isqrt(words)))


class Network:
    """Parameters as one flat vector: embeddings by place, class weights and biases, word weights and
    biases within each class."""

    def __init__(self, known: np.ndarray, flat: np.ndarray | None = None):
        self.known = known  # sorted hashes; token i + UNKNOWN
        self.classes = k = max(CLASSES, math.isqrt(len(known) + UNKNOWN - 1) + 1)
        self.vocabulary = k * k
        self.seen = 0  # words trained on
        shapes = [(2 * REACH, k * k + 1, WIDTH), (WIDTH, k), (k,), (k, WIDTH, k), (k, k)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            flat = np.random.default_rng(7).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat = flat
        cut = np.cumsum([0, *sizes])
        self.embed, self.w1, self.b1, self.w2, self.b2 = (flat[a:b].reshape(s) for a, b, s in zip(cut[:-1], cut[1:], shapes))

    def tokens(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return (h % U64(UNKNOWN)).astype(np.int64)
        place = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[place] == h, place + UNKNOWN, (h % U64(UNKNOWN)).astype(np.int64))

    def contexts(self, tokens: np.ndarray, doc_ptr: np.ndarray) -> np.ndarray:
        """Tokens around each word, a row for each place; the vocabulary's size stands for a place outside the text."""
        doc = np.repeat(np.arange(len(doc_ptr) - 1, dtype=np.int32), np.diff(doc_ptr))
        out = np.full((2 * REACH, len(tokens)), self.vocabulary)
        for i, d in enumerate(range(1, REACH + 1)):
            same = doc[d:] == doc[:-d]
            np.copyto(out[REACH - d, d:], tokens[:-d], where=same)
            np.copyto(out[REACH + i, :-d], tokens[d:], where=same)
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        x = self.embed[0].take(context[0], axis=0)
        for i in range(1, 2 * REACH):
            x += self.embed[i].take(context[i], axis=0)
        return np.tanh(x, out=x)

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the targets by class, and where each class begins in it."""
        own = (target // self.classes).astype(np.uint16)  # short keys are sorted by their digits
        order = np.argsort(own, kind="stable")
        return order, np.concatenate(([0], np.cumsum(np.bincount(own, minlength=self.classes))))

    # Parameters stay within LIMIT and hidden values within 1, so exponentials of the outputs can't overflow.

    def log_probabilities(self, tokens: np.ndarray, doc_ptr: np.ndarray, step: int = 32768) -> np.ndarray:
        out = np.empty(len(tokens), np.float64)
        ones, around = np.ones(self.classes, np.float32), self.contexts(tokens, doc_ptr)
        for a in range(0, len(tokens), step):
            b = min(len(tokens), a + step)
            order, cut = self.by_class(tokens[a:b])
            y, x = tokens[a:b][order], self.hidden(around[:, a + order])
            across, own, within, p = np.arange(b - a), y // self.classes, y % self.classes, np.empty(b - a, np.float32)
            for i in range(0, b - a, CACHED):
                j = min(b - a, i + CACHED)
                z = x[i:j] @ self.w1
                z += self.b1
                p[i:j] = z[across[: j - i], own[i:j]]
                p[i:j] -= np.log(np.exp(z, out=z) @ ones)
            for c in np.flatnonzero(np.diff(cut)):
                i, j = cut[c], cut[c + 1]
                z = x[i:j] @ self.w2[c] + self.b2[c]
                p[i:j] += z[across[: j - i], within[i:j]]
                p[i:j] -= np.log(np.exp(z, out=z) @ ones)
            out[a + order] = p
        return out

    def train(self, tokens: np.ndarray, doc_ptr: np.ndarray, rate: float) -> None:
        """One pass of gradient descent, by steps of 256 words that grow to ``STEP``: every word is predicted once from
        all words around it."""
        b, across, ones, around = 0, np.arange(WIDTH), np.ones(self.classes, np.float32), self.contexts(tokens, doc_ptr)
        while b < len(tokens):
            step = min(STEP, max(256, self.seen // 32))
            a, b = b, min(len(tokens), b + step)
            self.seen += b - a
            order, cut = self.by_class(tokens[a:b])
            at = a + order
            context, y, every = around[:, at], tokens[at], np.arange(b - a)
            x = self.hidden(context)
            own, within, dx, dw1, db1 = y // self.classes, y % self.classes, np.empty_like(x), 0, 0
            for i in range(0, b - a, CACHED):
                j = min(b - a, i + CACHED)
                z = x[i:j] @ self.w1
                z += self.b1
                np.exp(z, out=z)
                z *= (1 / (z @ ones))[:, None]
                z[every[: j - i], own[i:j]] -= 1
                np.matmul(z, self.w1.T, out=dx[i:j])
                dw1, db1 = dw1 + x[i:j].T @ z, db1 + z.sum(axis=0)
            grow = np.float32(rate / step)
            for c in np.flatnonzero(np.diff(cut)):
                i, j = cut[c], cut[c + 1]
                z2 = x[i:j] @ self.w2[c] + self.b2[c]
                np.exp(z2, out=z2)
                z2 *= (1 / (z2 @ ones))[:, None]
                z2[every[: j - i], within[i:j]] -= 1
                dx[i:j] += z2 @ self.w2[c].T
                self.w2[c] -= grow * 8 * (x[i:j].T @ z2)
                self.b2[c] -= grow * 8 * z2.sum(axis=0)
            self.w1 -= grow * dw1
            self.b1 -= grow * db1
            dx *= (1 - x * x) * (grow * 8)
            if b - a < STEP:
                for i in range(2 * REACH):
                    np.subtract.at(self.embed[i].reshape(-1), (context[i][:, None] * WIDTH + across).reshape(-1), dx.reshape(-1))
            else:  # sums over all tokens are the cheaper way once a step has so many words
                shares = dx.reshape(-1).astype(np.float64)
                for i in range(2 * REACH):
                    self.embed[i].reshape(-1)[:] -= np.bincount((context[i][:, None] * WIDTH + across).reshape(-1), shares, self.embed[i].size)
            np.clip(self.flat, -LIMIT, LIMIT, out=self.flat)


def train(docs: DataFrame, parts: int = 2, rate: float = 6.0) -> Network:
    """Every row trains once: the rows fall into ``parts`` by a hash of their ids, and the tasks' networks are
    averaged after each part."""
    counts = materialise(count_words(docs), "counts")
    words = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "hash").limit(vocabulary_size(words) - UNKNOWN).collect()  # LARGEST at most
    net = Network(np.sort(np.array([r[0] for r in top], np.int64).view(U64)))
    sc = docs.sparkSession.sparkContext
    for part in range(parts):
        state = sc.broadcast((net.known, net.flat))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            known, flat = state.value
            own, words = Network(known, flat.astype(np.float32)), 0  # the dtype of a pickled array would slow subtract.at down
            for batch in batches:
                for piece in pieces(batch, 0):
                    w = split_words(lowered(piece.column(0)))
                    own.train(own.tokens(word_hashes(w)), w.doc_ptr, rate)
                    words += len(w.starts)
            if words:
                for i, a in enumerate(range(0, len(flat), BLOCK)):
                    yield pa.record_batch([pa.array([i], pa.int32()), pa.array([own.flat[a : a + BLOCK].tobytes()], pa.binary()), pa.array([words], pa.int64())], names=["i", "value", "words"])

        def average(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, words = 0.0, 0
            for batch in tables:
                for value, n in zip(batch.column("value"), batch.column("words").to_pylist()):
                    total, words = total + np.frombuffer(value.as_buffer(), np.float32).astype(np.float64) * n, words + n
            yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([(total / words).astype(np.float32).tobytes()], pa.binary()), pa.array([words], pa.int64())], names=["i", "value", "words"])

        # Neighbouring splits go to one task, without a shuffle.
        share = docs.where(F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)), F.lit(0)) == part).select("text")
        parameters = "i int, value binary, words long"
        rows = share.coalesce(max(2, sc.defaultParallelism)).mapInArrow(run, parameters).groupBy("i").applyInArrow(average, parameters).collect()  # the network's parameters
        if rows:
            net = Network(net.known, np.concatenate([np.frombuffer(r.value, np.float32) for r in sorted(rows, key=lambda r: r.i)]))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_words, pseudo_log_likelihood, score (its mean per word) for every row."""
    state = docs.sparkSession.sparkContext.broadcast((net.known, net.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*state.value)
        for batch in batches:
            for part in pieces(batch, 1):
                w = split_words(lowered(part.column(1)))
                p = own.log_probabilities(own.tokens(word_hashes(w)), w.doc_ptr)
                doc = np.repeat(np.arange(part.num_rows), np.diff(w.doc_ptr))
                total, n = np.bincount(doc, p, minlength=part.num_rows), np.diff(w.doc_ptr)
                yield pa.record_batch([part.column(0), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], names=["doc_id", "n_words", "pseudo_log_likelihood", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, pseudo_log_likelihood double, score double")
