import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalmill.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_equals_brute_force(docs, corpus):
    got = substring_dedup.without_repeats(docs, digest=True).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    want = [(r[0], *x) for r, x in zip(corpus, brute([r[1] for r in corpus]))]
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(x[2] for x in want) > 1000


def test_short_windows(docs, corpus):
    got = substring_dedup.without_repeats(docs, window=5, gram=2, digest=True).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *x) for r, x in zip(corpus, brute([r[1] for r in corpus], 5)))


def test_keeps_rows_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, "x", 7), (2, "a " + text, "y", 8)], "doc_id long, text string, kept string, k1 int").withColumn("spans", F.lit(0))
    rows = substring_dedup.without_repeats(df).select("row.*", F.col("kept").alias("left"), "n_removed").orderBy("doc_id").collect()
    assert [(r.kept, r.k1, r.left, r.n_removed) for r in rows] == [("x", 7, "", 80), ("y", 8, "a", 80)]


def brute_parse(phrases, window):
    """Windows of each phrase whose words start anywhere else among the phrases."""
    seen = Counter(tuple(w[i : i + window]) for w in phrases for i in range(len(w) - window + 1))
    return {(n, i) for n, w in enumerate(phrases) for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), max_size=6), st.integers(2, 6))
def test_greedy_parsing_misses_no_window(phrases, window):
    """Factors and the windows at their boundaries are what repeats, whatever the phrases are."""
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 3).astype(np.uint64)
    h = np.array([hashes[x] for w in phrases for x in w], np.uint64)
    ptr = np.cumsum([0, *map(len, phrases)])
    first, count = substring_dedup.parse(h, ptr, window)
    got = {(int(np.searchsorted(ptr, p, side="right")) - 1, int(p)) for a, n in zip(first, count) for p in range(a, a + n)}
    assert {(n, p - int(ptr[n])) for n, p in got} == brute_parse(phrases, window)


def test_factors_are_the_longest_matches():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 60).astype(np.uint64) for _ in range(2))
    h, ptr = np.concatenate((a, b[:5], a[10:50], b[5:9], a[3:9])), np.array([0, 60, 115])
    first, count = substring_dedup.parse(h, ptr, 6)
    assert {(65, 35), (109, 1), (10, 35)} <= set(zip(first.tolist(), count.tolist()))


def test_the_best_of_several_sources_is_taken():
    """Of phrases W+x, W+B, W+B the second has the third as its source, not the first; the parsing alone finds that."""
    rng = np.random.default_rng(4)
    w, x, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (10, 3, 15))
    h, ptr = np.concatenate((w, x, w, b, w, b)), np.array([0, 13, 38, 63])
    first, count = substring_dedup.parse(h, ptr, 10)
    assert sorted(zip(first.tolist(), count.tolist())) == [(0, 1), (13, 16), (38, 16)]


def test_suffix_array():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 3, 200).astype(np.uint64)
    ptr = np.array([0, 40, 40, 90, 91, 200])
    end = np.repeat(ptr[1:], np.diff(ptr))
    order, place = substring_dedup.suffix_order(h, end)
    suffixes = [h[p : end[p]].tolist() for p in order]
    assert suffixes == sorted(suffixes) and place[order].tolist() == list(range(200))


@pytest.mark.parametrize("hot", [0, 3, 10**6])
def test_large_anchors_are_counted_by_windows(spark, hot):
    """Many versions of a passage, all with its anchors; dealt into blocks or by single windows."""
    rng = random.Random(3)
    base = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(90)] = f"x{i}_{rng.random()}"
        rows.append((i, " ".join(own)))
    rows += [rows[5]] * 3 + [(90, "la " * 200), (91, "la le " * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = substring_dedup.repeated_spans(docs, hot=hot)
    words = {r[0]: WORD.findall(r[1]) for r in rows}
    keys = {(r.k1, r.k2): r.doc_id for r in substring_dedup.keyed(docs).collect()}
    got = {}
    for r in spans.collect():
        got[keys[r.k1, r.k2]] = {p for s in r.spans for p in range(s.start, s.start + s.windows + 34)}
    want = {r[0]: len(words[r[0]]) for r in rows}
    for (i, _), (_, n, _) in zip(rows, brute([r[1] for r in rows])):
        assert len(got.get(i, ())) == n <= want[i]


def test_equal_rows_have_their_spans_once(spark):
    text = " ".join(f"w{i}" for i in range(200))
    few, many = (substring_dedup.repeated_spans(spark.createDataFrame([(1, text)] * n, "doc_id long, text string")).first() for n in (2, 60))
    assert len(few.spans) == len(many.spans)


def test_empty(no_docs):
    assert substring_dedup.without_repeats(no_docs).collect() == []


def test_very_common_passages(spark):
    """Phrases with over a thousand rows take the broadcast way."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"x{i} y{i} {passage} z{i}") for i in range(1500)] + [(2000 + i, f"{passage} {i}") for i in range(3)] + [(3000, "alone " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.without_repeats(docs, digest=True).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows])))
