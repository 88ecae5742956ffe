import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalmill.llm import packing, queries


@cache
def tokenizers():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file()), packing.UnitTokenizer(queries.tokenizer_file())


def whole_ids(texts):
    return [e.ids + [2] for e in tokenizers()[0].encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_cover_and_sequences_are_gapless(docs, corpus):
    rows = packing.pack(docs, queries.tokenizer_file(), window=512).collect()
    want = defaultdict(list)
    for r, ids in zip(corpus, whole_ids([r[1] for r in corpus])):
        want[r[0], zlib.crc32(np.array(ids, "<u4").tobytes())].append(ids)
    by_doc = defaultdict(set)
    for (doc, _), docs_ids in want.items():
        for ids in docs_ids:
            for s in range(0, len(ids), 512):
                by_doc[doc].add((s, min(512, len(ids) - s), zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes()), len(ids)))
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows} == {(d, *x) for d, xs in by_doc.items() for x in xs}
    assert sum(r.length for r in rows) == sum(len(i) for x in want.values() for i in x)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512


def unit_ids(texts):
    ids, ends = tokenizers()[1].ids(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_unit_ids_equal_the_tokenizer(corpus):
    texts = [r[1] or "" for r in corpus] + ["it's a dog's; l'été, co-op 3.14 (a) \"b\" ÀÉ İ ß ẞ é x y ﬁ ªº µ ½ É×a ÷ 你好 \U0001f600!", "--- ... don't 'S 'll", "12a3 42"]
    assert unit_ids(texts) == [x[:-1] for x in whole_ids(texts)]


def test_special_tokens_in_texts_are_the_tokenizers():
    texts = ["hello <|startoftext|> world", "foo<|endoftext|>bar", "<|ENDOFTEXT|>", "a<|b |> <|", "<|endoftext|><|endoftext|>"]
    assert unit_ids(texts) == [x[:-1] for x in whole_ids(texts)]
    assert unit_ids(texts)[0] == [3306, 49406, 1002]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab C'ds!?.,<|>startof éÉßÀ×÷ªµº́ \u00a0\t\n12٣ŁİΣς日本", max_size=25), max_size=5))
def test_any_text_has_the_tokenizers_ids(texts):
    assert unit_ids(texts) == [x[:-1] for x in whole_ids(texts)]


def test_extra_columns_with_clashing_names(spark, docs):
    more = docs.withColumns({c: F.lit(c) for c in ("length", "shard", "start", "rank", "ids_crc32", "sequence_id")})
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    plain, got = (sorted(map(str, packing.pack(d, queries.tokenizer_file()).select(*order).collect())) for d in (docs, more))
    assert got == plain


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 20), st.integers(1, 5), max_size=6))
def test_fill_is_the_best_subset_sum(room, left):
    used = packing.fill(room, sorted((n for n in left if n <= room), reverse=True), left)
    assert all(c <= left[n] for n, c in used.items())
    sums = {0}
    for n, c in left.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert sum(n * c for n, c in used.items()) == max(s for s in sums if s <= room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plan_uses_every_piece_once(counts):
    used = defaultdict(int)
    for lengths, times in packing.plan(counts, 64):
        assert sum(n * c for n, c in lengths.items()) <= 64
        for n, c in lengths.items():
            used[n] += c * times
    assert used == counts


def test_plan_is_short_for_many_pieces():
    counts = {n: 10**6 + n for n in range(1, 4097, 7)}
    plan = packing.plan(counts)
    total, windows = sum(n * c for n, c in counts.items()), sum(t for _, t in plan)
    assert len(plan) < 3000
    assert windows * 4096 < 1.01 * total


def test_empty(no_docs):
    assert packing.pack(no_docs, queries.tokenizer_file()).collect() == []


def test_shards_follow_the_counts(spark, monkeypatch):
    """Ranks in many shards are those of one: each piece has a place of its own and padding is the same."""
    docs = spark.createDataFrame([(i % 40, "word " * (5 + i % 3) if i % 4 else "word " * 600) for i in range(400)], "doc_id long, text string").repartition(7)
    padded = []
    for rows in (5, 1 << 20):
        cut = packing.sharded(packing.materialise(packing.token_pieces(docs, queries.tokenizer_file(), 256, packing.END_ID).withColumn("row", F.monotonically_increasing_id())), 256, rows)
        sizes = {(r.length, r.shard): r["count"] for r in cut.groupBy("length", "shard").count().collect()}
        assert (max(n for (length, _), n in sizes.items() if length < 256) < 40) == (rows == 5)
        assert len([s for length, s in sizes if length == 256]) == 7
        places = sorted((r.sequence_id, r.offset, r.length) for r in packing.pack(docs, queries.tokenizer_file(), window=256, shard_rows=rows).collect())
        ends = {}
        for sequence, offset, length in places:
            assert ends.get(sequence, 0) == offset
            ends[sequence] = offset + length
        assert max(ends.values()) <= 256
        padded.append(sorted(ends.values()))
    assert padded[0] == padded[1]
