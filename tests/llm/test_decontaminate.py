import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from signalmill.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(words, k):
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs, items, t=0.8):
    out = Counter()
    for i, text in set(items):
        w = WORD.findall(low(text))
        if text is None or not w:
            continue
        k = min(5, len(w))
        q = shingles(w, k)
        for d, body in docs:
            m = len(q & shingles(WORD.findall(low(body)), k))
            if m >= t * len(q) - 1e-9:
                out[d, i, len(q), m] += 1
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(7)
    words = lambda n: [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 10, 15, 40, 64, 300, 7, 7])]
    items += [(90, None), (91, ""), (None, "null id item with some words"), (3, "same id with another text here"), items[9], (92, "la la la la la la la la la")]
    docs = []
    for d in range(40):
        body = words(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            put = rng.choice([x[1] for x in items if x[1]]).split()
            for j in range(len(put)):
                if rng.random() < 0.03:
                    put[j] = "edited"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() for w in put] if rng.random() < 0.3 else put
        docs.append((d, " ".join(body)))
    docs += [(50, None), (51, ""), (None, items[9][1]), docs[0], docs[0], (52, " ".join(words(20000) + items[10][1].split())), (53, "la la la la la")]
    return docs, items


@pytest.mark.parametrize("block", [1_000_000, 100])
def test_equals_brute_force(spark, case, block):
    docs, items = case
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.find_items(d, b, block_shingles=block).select("doc_id", "item_id", "n_shingles", "n_shared").collect()
    want = brute(docs, items)
    assert Counter(map(tuple, got)) == want
    assert sum(want.values()) > 20
    kept = decontaminate.clean(d, b, block_shingles=block)
    assert kept.columns == d.columns
    dirty = {k[0] for k in want}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(x for x, _ in docs if x not in dirty)


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(docs, none).collect() == []
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.find_items(no_docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
