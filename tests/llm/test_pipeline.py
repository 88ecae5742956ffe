import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import test_decontaminate
import test_packing
import test_simhash
import test_substring_dedup
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from signalmill.llm import queries, scratch, toxicity
from signalmill.llm.words import split_words, word_hashes


@pytest.fixture(scope="module")
def tables(spark, docs, corpus, tmp_path_factory):
    rng = random.Random(12)
    path = str(tmp_path_factory.mktemp("sf"))
    bad = [(1000 + i, " ".join(rng.choice("klmnop") + rng.choice("uvw") for _ in range(30)) + (" vile. end" if i % 2 else ". fine end"), "en", "s", 1) for i in range(200)]
    item = "the quick item of a test that nobody may ever train on at all"
    leak = [(2000, f"before it {item} after it", "en", "s", 1)]
    docs.unionByName(spark.createDataFrame([*bad, *leak], docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[0] % 2) for r in bad], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        if name != "packing":
            assert docs.columns == columns
            rows = docs.collect()
            ids[name] = {r.doc_id for r in rows}
            assert len([r for r in rows if r.doc_id == 5]) == (3 if name == "toxicity" else 1)
        docs = scratch.materialise(docs)
    assert not {i for i in ids["toxicity"] if i and 1000 <= i < 1200 and i % 2}
    assert {i for i in range(1000, 1200) if i % 2 == 0} <= ids["toxicity"]
    assert 400 in ids["toxicity"] and 400 not in ids["simhash_near_dedup"] and 0 in ids["simhash_near_dedup"]
    assert 2000 in ids["substring_dedup"] and 2000 not in ids["benchmark_decontamination"]
    assert 202 in ids["simhash_near_dedup"] and 202 not in ids["substring_dedup"]


def noisy_or(model, text):
    """A text's score by the model's words, sentence by sentence."""
    weight, clean = dict(zip(model.hashes.tolist(), model.weights.tolist())), 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = re.findall(rb"[^\x00-\x20!-/:-@\[-`{-\x7f]+", bytes(c + 32 if 65 <= c <= 90 else c for c in sentence.encode()))
        if words:
            hashes = word_hashes(split_words(pa.array([b" ".join(words).decode()])))
            clean *= 1 - 1 / (1 + math.exp(-model.bias - sum(weight.get(h, 0.0) for h in hashes.tolist())))
    return 1 - clean


def test_equals_brute_force(spark, tables):
    """Every stage again in plain Python; only the classifier's weights are taken over."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if noisy_or(model, r.text) < 0.5]
    fps = [test_simhash.fingerprint(t) for _, t in rows]
    root = test_simhash.groups(fps)
    best = {}
    for row, f in zip(rows, fps):
        best[root[f]] = min(best.get(root[f], row), row, key=lambda r: (r[0] is None, r[0]))
    rows = list(best.values())
    kept, seen = [], Counter(tuple(w[i : i + 35]) for w in (test_substring_dedup.WORD.findall(t or "") for _, t in rows) for i in range(len(w) - 34))
    for doc, text in rows:
        w, gone = test_substring_dedup.WORD.findall(text or ""), set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        if not gone or left:
            kept.append((doc, left if gone else text))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    leaked = {k[0] for k in test_decontaminate.brute(kept, items)}
    kept = [r for r in kept if r[0] not in leaked]
    want = Counter()
    for (doc, _), ids in zip(kept, test_packing.whole_ids([t for _, t in kept])):
        for s in range(0, len(ids), 4096):
            want[doc, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids)] += 1
    got = corpus_pipeline.run(spark, tables).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert Counter(map(tuple, got)) == want
    assert leaked == {2000} and len(kept) > 100


def test_run_packs_what_is_left(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.length
    assert rows and max(by.values()) <= 4096


def test_extra_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit(c) for c in ("row", "kept", "fp", "spans", "keeper", "id_key", "n_removed", "score")})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns, name
    assert {r.kept for r in docs.select("kept").distinct().collect()} == {"kept"}


def test_empty_tables(spark, tables, tmp_path):
    read = lambda t: spark.read.parquet(f"{tables}/{t}.parquet")
    for name, empty in (("no_docs", {"documents"}), ("no_guides", {"labels", "benchmark"})):
        for t in ("documents", "labels", "benchmark"):
            (read(t).limit(0) if t in empty else read(t)).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/no_docs").collect() == []
    docs, sf = read("documents"), f"{tmp_path}/no_guides"
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "benchmark_decontamination"):
        assert Counter(map(str, stages[name](spark, docs, sf).collect())) == Counter(map(str, docs.collect())), name


def test_all_queries_are_registered():
    got = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(got) and "pipeline" in got
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
