"""Every numbered query, as it is registered, on the driver's smallest tables."""

import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import test_packing
import test_simhash
import test_url_filters

from signalmill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")

TYPES = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op3_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_packing": {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")},
    "op7_lm_scoring": {"doc_id": "bigint", "pseudo_log_likelihood": "double"},
    "op8_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op9_decontaminate": {"doc_id": "bigint", "item_id": "bigint"},
    "op11_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op12_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13_merkle": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op10_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def results(spark):
    done = {}

    def of(name):
        if name not in done:
            df = queries.QUERIES[name](spark, SF)
            kinds = dict(df.dtypes)
            assert {c: kinds.get(c) for c in TYPES[name]} == TYPES[name]
            done[name] = df.collect()
        return done[name]

    return of


@pytest.fixture(scope="module")
def documents(db):
    return db.execute("select doc_id, text, lang from documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(results, db, name):
    rows = results(name)
    cur = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(cur.fetchall())


@pytest.mark.parametrize("name, n, rest", [("op1_toxicity", 5, 0), ("op4_language", 3, 1)])
def test_held_out_rows(results, documents, name, n, rest):
    rows = results(name)
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_tells_held_out_labels(results, db):
    toxic = dict(db.execute("select doc_id, toxic from labels where toxic is not null").fetchall())
    rows = results("op1_toxicity")
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert held and sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_tells_held_out_rows(results, documents):
    lang = {d[0]: d[2] for d in documents}
    rows = results("op4_language")
    assert {r.lang_pred for r in rows} <= {*lang.values(), "und"}
    held = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held) > 0


def test_simhash_equals_brute_force(results, documents):
    fps = [test_simhash.fingerprint(d[1]) for d in documents]
    root, ids = test_simhash.groups(fps), defaultdict(list)
    for d, f in zip(documents, fps):
        ids[root[f]].append(d[0])
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in results("op5_simhash")) == Counter((d[0], format(f, "016x"), min(ids[root[f]])) for d, f in zip(documents, fps))


def test_packing_equals_the_tokenizer(results, documents):
    import numpy as np

    rows = results("op6_packing")
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for (doc, text, _), ids in zip(documents, test_packing.whole_ids([d[1] for d in documents])):
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))
            at += r.length
        assert at == len(ids)
    ends = defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.length))
    padded = 0
    for parts in ends.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 0.02 * sum(r.length for r in rows) + 4096


def test_lm_scores_every_document(results, documents):
    rows = {r.doc_id: r for r in results("op7_lm_scoring")}
    assert len(rows) == len(documents)
    for doc, text, _ in documents:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert rows[doc].n_words == n and rows[doc].pseudo_log_likelihood <= 0
        assert rows[doc].score == pytest.approx(rows[doc].pseudo_log_likelihood / n if n else 0)


def test_url_rules_and_verdicts(results, db):
    urls = dict(db.execute("select page_id, url from pages").fetchall())
    rows = results("op10_url_filters")
    assert Counter(r.page_id for r in rows) == Counter(urls.keys())
    for r in rows:
        host, path = test_url_filters.parse(urls[r.page_id])
        rule, verdict = test_url_filters.rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))


def test_rows_without_id_are_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (9,)], "doc_id long")
    found = {r.doc_id: r.held_out for r in rows.select("doc_id", queries.held_out(5, 0)).collect()}
    assert found[None] is False and all(found[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in (1, 2, 9))
