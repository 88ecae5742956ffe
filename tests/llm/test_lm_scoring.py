import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import lm_scoring
from signalmill.llm.lm_scoring import Network


@pytest.fixture(scope="module")
def chains(spark):
    """Texts in which a word tells its neighbours."""
    rng = random.Random(2)
    after = {i: [rng.randrange(40) for _ in range(2)] for i in range(40)}

    def walk(n):
        at = rng.randrange(40)
        return " ".join(f"w{(at := rng.choice(after[at]))}" for _ in range(n))

    return spark.createDataFrame([(i, walk(200)) for i in range(300)], "doc_id long, text string").repartition(3), [walk(200) for _ in range(20)]


def test_beats_word_frequencies_on_held_out_text(spark, chains):
    docs, fresh = chains
    net = lm_scoring.train(docs)
    held = spark.createDataFrame(list(enumerate(fresh)), "doc_id long, text string")
    score = np.mean([r.score for r in lm_scoring.score(held, net).collect()])
    n = {}
    for r in docs.collect():
        for w in r.text.split():
            n[w] = n.get(w, 0) + 1
    total = sum(n.values())
    words = [w for t in fresh for w in t.split()]
    assert score > np.mean([np.log(n[w] / total) for w in words]) + 0.3
    shuffled = [" ".join(random.Random(i).sample(t.split(), 200)) for i, t in enumerate(fresh)]
    worse = np.mean([r.score for r in lm_scoring.score(spark.createDataFrame(list(enumerate(shuffled)), "doc_id long, text string"), net).collect()])
    assert score > worse + 0.3


def test_probabilities_sum_to_one():
    net = Network(np.zeros(0, np.uint64))
    context = np.array([3, 5, 1000, 7, 9])
    total = 0
    for v in range(lm_scoring.VOCABULARY):
        context[2] = v
        total += np.exp(net.log_probabilities(context, np.array([0, 5]))[2])
    assert total == pytest.approx(1, abs=1e-4)


def test_context_stays_inside_documents():
    net = Network(np.zeros(0, np.uint64))
    tokens = np.arange(10)
    parts = np.concatenate([net.log_probabilities(tokens[:4], np.array([0, 4])), net.log_probabilities(tokens[4:], np.array([0, 0, 6]))])
    assert net.log_probabilities(tokens, np.array([0, 4, 4, 10])) == pytest.approx(parts, abs=1e-5)


def test_odd_inputs(docs, no_docs, corpus):
    net = lm_scoring.train(docs)
    rows = lm_scoring.score(docs.withColumn("score", F.lit("mine")), net).collect()
    assert len(rows) == len(corpus)
    assert all(np.isfinite(r.score) and r.pseudo_log_likelihood <= 0 for r in rows)
    assert {(r.n_words, r.score) for r in rows if r.doc_id in (401, 402, 403)} == {(0, 0.0)}
    assert lm_scoring.score(no_docs, lm_scoring.train(no_docs)).collect() == []


def test_every_row_trains_once(spark, chains):
    docs, _ = chains
    few = docs.where("doc_id < 60").union(spark.createDataFrame([(None, "w1 w2 w3")], docs.schema))
    words = few.selectExpr("sum(size(split(text, ' '))) as n").first().n
    seen = []
    for part in range(3):
        share = few.where(F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)), F.lit(0)) == part)
        seen.append(share.selectExpr("coalesce(sum(size(split(text, ' '))), 0) as n").first().n)
    assert sum(seen) == words and all(seen)
    # No part may be without effect.
    nets = [lm_scoring.train(few.where(~F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).eqNullSafe(part), F.lit(False))).coalesce(1)).flat for part in range(2)]
    whole = lm_scoring.train(few.coalesce(1)).flat
    assert all(np.abs(whole - n).max() > 1e-3 for n in nets)


def plain(net, flat, tokens, doc_ptr):
    """Log-probabilities word by word, in doubles."""
    own = Network(net.known, flat)
    out = []
    for d in range(len(doc_ptr) - 1):
        for t in range(doc_ptr[d], doc_ptr[d + 1]):
            total = [0.0] * lm_scoring.WIDTH
            for i, off in enumerate((-2, -1, 1, 2)):
                inside = doc_ptr[d] <= t + off < doc_ptr[d + 1]
                row = own.embed[i][tokens[t + off] if inside else own.vocabulary]
                total = [x + float(v) for x, v in zip(total, row)]
            x = [math.tanh(v) for v in total]
            c, place = divmod(int(tokens[t]), own.classes)
            log_p = 0.0
            for w, bias, hit in ((own.w1, own.b1, c), (own.w2[c], own.b2[c], place)):
                z = [sum(x[k] * float(w[k, j]) for k in range(len(x))) + float(bias[j]) for j in range(own.classes)]
                log_p += z[hit] - math.log(sum(math.exp(v) for v in z))
            out.append(log_p)
    return np.array(out)


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(3)
    net = Network(np.zeros(0, np.uint64))
    net.flat[:] = rng.normal(0, 0.5, len(net.flat)).astype(np.float32)
    return net, rng.integers(0, 1024, 17), np.array([0, 6, 6, 7, 17])


def test_forward_equals_plain_loops(small):
    net, tokens, doc_ptr = small
    assert net.log_probabilities(tokens, doc_ptr, step=5) == pytest.approx(plain(net, net.flat, tokens, doc_ptr), abs=1e-4)


def test_one_step_is_the_gradient(small):
    net, tokens, doc_ptr = small
    before = net.flat.astype(np.float64)
    after = Network(net.known, net.flat.copy())
    after.train(tokens, doc_ptr, 0.5)
    moved = after.flat.astype(np.float64) - before
    n_embed, n1 = net.embed.size, net.w1.size + net.b1.size
    rng = np.random.default_rng(4)
    touched = np.flatnonzero(np.abs(moved) > 1e-6)
    places = [*rng.choice(touched[touched < n_embed], 12), *rng.choice(np.arange(n_embed, n_embed + n1), 8), *rng.choice(touched[touched >= n_embed + n1], 12)]
    for i in places:
        up, down = before.copy(), before.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (plain(net, up, tokens, doc_ptr).sum() - plain(net, down, tokens, doc_ptr).sum()) / 2e-4
        # Embeddings and the words' weights move by steps eight times as large.
        size = 0.5 / 256 * (1 if n_embed <= i < n_embed + n1 else 8)
        assert moved[i] == pytest.approx(size * slope, rel=2e-2, abs=1e-5)
    assert after.log_probabilities(tokens, doc_ptr).sum() > net.log_probabilities(tokens, doc_ptr).sum()


@pytest.mark.parametrize("seen", [0, 10**6])
def test_every_word_is_a_target_once(small, monkeypatch, seen):
    """With the settings that queries use."""
    _, _, doc_ptr = small
    net, targets = Network(np.zeros(0, np.uint64)), []
    net.seen = seen
    tokens = np.random.default_rng(5).integers(0, 1024, 20_000)
    by_class = net.by_class
    monkeypatch.setattr(net, "by_class", lambda target: targets.extend(target.tolist()) or by_class(target))
    net.train(tokens, np.array([0, 300, 300, 20_000]), lm_scoring.train.__defaults__[1])
    assert targets == tokens.tolist() and net.seen == seen + len(tokens)


def test_vocabulary_follows_the_corpus():
    assert lm_scoring.vocabulary_size(0) == lm_scoring.VOCABULARY
    assert lm_scoring.vocabulary_size(10**10) == 100_000 and lm_scoring.vocabulary_size(10**16) == lm_scoring.LARGEST
    net = Network(np.arange(3000, dtype=np.uint64))
    assert net.vocabulary >= 3000 + lm_scoring.UNKNOWN and len(set(net.tokens(net.known))) == 3000
    context = np.array([3, 5, 1000, 7, net.vocabulary - 1])
    total = 0
    for v in range(net.vocabulary):
        context[2] = v
        total += np.exp(net.log_probabilities(context, np.array([0, 5]))[2])
    assert total == pytest.approx(1, abs=1e-4)
