import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import toxicity


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            sentences[rng.randrange(len(sentences))] += rng.choice([" vile", " Rotten,", " filthy"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic if i % 50 else not toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7), (9999, 1)], "doc_id long, toxic int")


def test_held_out_accuracy(marked):
    docs, labels = marked
    model = toxicity.train(docs, labels, learn=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) > 80
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in rows]) > 0.97


def test_locates_the_sentence(spark, marked):
    model = toxicity.train(*marked)
    text = "una frase buena. otra muy VILE aqui! y fin"
    row = toxicity.offending_sentences(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.sentence, text.encode()[r.start : r.end]) for r in row] == [(1, 1, b"otra muy VILE aqui")]


def test_noisy_or_of_sentences(marked, spark):
    model = toxicity.train(*marked)
    df = spark.createDataFrame([(0, "vile"), (1, "calm"), (2, "vile. calm"), (3, None), (4, ""), (5, "?! ..")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert s[2] == pytest.approx(1 - (1 - s[0]) * (1 - s[1]))
    assert s[3] == s[4] == s[5] == 0


def test_odd_inputs(docs, no_docs, corpus, spark, marked):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    model = toxicity.train(*marked)
    assert toxicity.score(docs, model).count() == len(corpus)
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.offending_sentences(docs, model).count() == 0
    clash = docs.withColumn("score", F.lit("mine")).withColumn("y", F.lit(1))
    kept = toxicity.passing(clash, toxicity.train(clash, marked[1]))
    assert kept.columns == clash.columns
    assert kept.count() <= len(corpus)


def test_length_alone_is_not_toxic(spark, marked):
    docs, labels = marked
    model = toxicity.train(docs, labels)
    clean = ". ".join(r.text for r in docs.where("doc_id % 4 <> 0").orderBy("doc_id").collect())
    clean = ". ".join([clean] * (100_000 // len(clean.split()) + 1))
    assert len(clean.split()) >= 100_000
    df = spark.createDataFrame([(0, clean), (1, clean + ". so vile")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert s[0] < 0.5 <= s[1]
    assert [r.doc_id for r in toxicity.passing(df, model).collect()] == [0]


def test_learns_from_long_documents(spark):
    filler = "uno dos tres. " * 5000
    rows = [(i, filler + ("qué vile" if i % 2 else "qué calm")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int"))
    assert {(r.doc_id % 2, r.score >= 0.5) for r in toxicity.score(docs, model).collect()} == {(0, False), (1, True)}


def plain_loss(weights, spare, bags, y):
    """Mean negative log-likelihood of documents given as lists of (words, count), by loops."""
    total = 0.0
    for doc, label in zip(bags, y):
        keep = 1 / (1 + math.exp(spare))  # that the document isn't toxic for no reason at hand
        for words, count in doc:
            p = 1 / (1 + math.exp(-(toxicity.BIAS + sum(weights[w] for w in words))))
            base = 1 / (1 + math.exp(-toxicity.BIAS))
            keep *= min(1.0, (1 - p) / (1 - base)) ** count
        total -= math.log(1 - keep) if label else math.log(keep)
    return total / len(y)


def test_gradient_equals_plain_loops():
    rng = random.Random(8)
    weights = [rng.uniform(0, 6) for _ in range(7)]
    bags = [[([rng.randrange(7) for _ in range(rng.randint(0, 4))], rng.randint(1, 3)) for _ in range(rng.randint(0, 5))] for _ in range(30)]
    y = [rng.randint(0, 1) for _ in bags]
    flat = [(d, words, n) for d, doc in enumerate(bags) for words, n in doc]
    grad = toxicity.gradient(
        np.array(weights), -1.5, np.array([w for _, words, _ in flat for w in words], np.int64), np.repeat(np.arange(len(flat)), [len(words) for _, words, _ in flat]),
        np.array([n for _, _, n in flat], float), np.array([d for d, _, _ in flat]), np.array(y),
    )
    for i in range(8):
        ends = []
        for e in (1e-5, -1e-5):
            w = [*weights, -1.5]
            w[i] += e
            ends.append(plain_loss(w[:-1], w[-1], bags, y))
        assert grad[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_fit_beats_other_weights(marked):
    """No single word's weight can be moved to make the labels much likelier."""
    words = np.arange(4, dtype=np.uint64)
    bags = [[([i % 4], 1), ([], 3)] for i in range(40)]
    y = [int(i % 4 < 2) if i % 10 else 0 for i in range(40)]
    flat = [(d, w, n) for d, doc in enumerate(bags) for w, n in doc]
    index, bag = np.array([x for _, w, _ in flat for x in w]), np.repeat(np.arange(len(flat)), [len(w) for _, w, _ in flat])
    model = toxicity.fit(words, index, bag, np.array([n for *_, n in flat], float), np.array([d for d, *_ in flat]), np.array(y))
    at = lambda w: min(plain_loss(w, s, bags, y) for s in np.linspace(-9, -1, 17))
    best = at(model.weights.tolist())
    for i in range(4):
        for move in (-2.0, -0.5, 0.5, 2.0):
            w = model.weights.tolist()
            w[i] += move
            assert at(w) > best - 0.01


def test_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(i, f"{i} " + "x" * 1000) for i in range(60)] + [(7, "another text")] * 40 + [(8, None)] * 3
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    whole = toxicity.labelled_sample(docs, labels, None, 100, 1 << 30).collect()
    assert len(whole) == 60 and len({r.doc_id for r in whole}) == 60 and len([r for r in whole if r.doc_id == 7]) == 1
    for rows, size, n in ((5, 1 << 30, 10), (100, 10_500, 22)):
        got = toxicity.labelled_sample(docs, labels, None, rows, size).collect()
        assert n - 4 <= len(got) <= n and {r.y for r in got} == {0, 1}
        assert all(sum(len(r.text or "") for r in got if r.y == y) <= size for y in (0, 1))
    assert toxicity.labelled_sample(docs, labels.where("toxic = 1"), None, 100, 1 << 30) is None
