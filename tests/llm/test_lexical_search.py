import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from signalmill.llm import lexical_search

DOCS = "doc_id long, text string, row string, terms int, n long, item string, rank int, score long"
ITEMS = "item_id long, text string, item string, doc_id long"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    counted = [(d[0], Counter(terms(d[1]))) for d in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = Counter()
    for item in items:
        scored = []
        for place, (i, c, n) in enumerate(counted):
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(item[1]) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, place))
        for rank, (s, no_id, i, _) in enumerate(sorted(scored)[:k], 1):
            out[(item[0], rank, None if no_id else i, -s)] += 1
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Äther", "日本", "THE", "the"]
    heavy = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, heavy, k=n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(260)]
    docs += [(500 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [(600, None), (601, ""), (602, " .,\t"), (None, docs[9][1]), (None, docs[9][1]), docs[3], docs[3], (603, "w0 " * 30_000), (604, "A-b_C é\x00ü 😀w1"), (605, "only here")]
    items = [(i, text(rng.randint(1, 12))) for i in range(30)] + [(40, None), (41, ""), (42, "absent"), (43, "only here"), (44, "w0 w0 W0 the"), (44, "w1"), (None, "w2 日本"), (45, "w3 " * 500)]
    return docs, items


def frames(spark, docs, items, parts=5):
    d = spark.createDataFrame([(*r, "r", 1, 2, "i", 3, 4) for r in docs], DOCS).repartition(parts)
    return d, spark.createDataFrame([(*r, "x", 5) for r in items], ITEMS)


@pytest.mark.parametrize("owners, block, group, pass_terms", [(4, 4096, 256, 1_000_000), (3, 16, 7, 1_000_000), (1, 16, 7, 60), (7, 64, 3, 200)])
def test_equals_brute_force(spark, tables, monkeypatch, owners, block, group, pass_terms):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "GROUP", group)
    found = lexical_search.search(*frames(spark, *tables), owners=owners, pass_terms=pass_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == brute(*tables)


def test_bundles_lose_documents_on_the_way(spark, tables, monkeypatch):
    """Between owners fewer documents are carried than have been met, with the same result."""
    monkeypatch.setattr(lexical_search, "BLOCK", 1 << 20)
    docs, _ = tables
    d, _ = frames(spark, docs, [], 1)
    items = lexical_search.Items.of(["only here w40 w41 the the w0"])
    indexed = lexical_search.index(d.coalesce(1), items.hashes)
    df, tf = [0] * len(items.hashes), [1] * len(items.hashes)
    for r in indexed.collect():
        for t, x in zip(r.terms, r.tfs):
            df[t], tf[t] = df[t] + 1, max(tf[t], x)
    plan = lexical_search.Plan.of(indexed.where("n > 0").count(), indexed.agg({"n": "sum"}).first()[0], np.array(df), np.array(tf), 3)
    assert sorted(set(plan.owner.tolist())) == [0, 1, 2] or sorted(set(plan.owner.tolist())) == [0, 2]
    bundles, sizes = spark.createDataFrame([], lexical_search.BUNDLE), []
    for owner in range(2):
        bundles = lexical_search.visit(bundles, lexical_search.postings(indexed, items, plan, owner, False), items, plan, owner, 1, False)
        sizes.append(len(bundles.first().docs))
    met = {r.row for r in indexed.collect() if any(plan.owner[t] < 2 for t in r.terms)}
    assert sizes[1] < len(met)


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_empty_tables(spark, tables, empty):
    docs, items = tables
    d, i = frames(spark, [] if empty != "items" else docs, [] if empty != "docs" else items)
    assert lexical_search.search(d, i).collect() == []
