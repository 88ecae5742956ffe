from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from signalmill.llm import simhash
from signalmill.llm.components import connected_components


def fingerprint(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = b.split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for j in range(64):
            counts[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * counts[j] > len(shingles))


def groups(fps):
    """Components of the fingerprints by brute force."""
    nodes, root = sorted(set(fps)), {}
    for f in nodes:
        if f in root:
            continue
        root[f], stack = f, [f]
        while stack:
            u = stack.pop()
            for v in nodes:
                if v not in root and (u ^ v).bit_count() <= 3:
                    root[v] = f
                    stack.append(v)
    return root


def test_equals_brute_force(docs, corpus):
    fps = [fingerprint(r[1]) for r in corpus]
    root = groups(fps)
    ids = defaultdict(list)
    for r, f in zip(corpus, fps):
        if r[0] is not None:
            ids[root[f]].append(r[0])
    want = Counter((r[0], format(f, "016x"), min(ids[root[f]], default=None)) for r, f in zip(corpus, fps))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint("fp"), "component_id").collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("hot", [1 << 15, 8])
def test_links_of_dense_clusters(spark, monkeypatch, hot):
    """Random balls of fingerprints: the links connect what brute force connects, dealt into tiles or not."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(12):
        at = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(60):
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                at ^= 1 << int(b)
            fps.append(at)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100" if hot < 100 else "10000")  # keys cross batches
    found = {r.node: r.root for r in connected_components(simhash.links(nodes)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = groups([f & (1 << 64) - 1 for f in signed])
    together = defaultdict(set)
    for f in signed:
        together[want[f & (1 << 64) - 1]].add(found.get(f, f))
    assert all(len(x) == 1 for x in together.values())
    assert len({next(iter(x)) for x in together.values()}) == len(together)


def test_links_stay_few_in_a_large_group(spark):
    fps = {sum(1 << b for b in (i, j)) for i in range(40) for j in range(i)}
    n = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).distinct().count()
    assert n < 64 * len(fps)


def test_keeper_is_one_per_group(docs, corpus):
    rows = simhash.near_duplicates(docs).where("keeper").select("component_id", "doc_id").distinct().collect()
    assert len({r.component_id for r in rows}) == len(rows)
    assert all(r.doc_id == r.component_id for r in rows)


def test_empty_and_extra_columns(spark, no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    odd = spark.createDataFrame([(1, "a b c d", 5, 6)], "doc_id long, text string, fp int, text_hash int")
    assert simhash.near_duplicates(odd).count() == 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}
