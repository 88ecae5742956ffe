"""The numbered operators as queries over whole tables, in the form their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm import decontaminate, language, lexical_search, lm_scoring, merkle, packing, scratch, secret_scan, simhash, substring_dedup, topk, toxicity, url_filters, warc


def crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def held_out(n: int, remainder: int):
    """A row without an id isn't held out; models don't learn from it either."""
    return F.coalesce(crc_mod(n) == remainder, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=crc_mod(5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending"
    )


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup.without_repeats(docs, digest=True).select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify(docs, language.train(docs, learn=crc_mod(3) != 1))
    return found.select("doc_id", held_out(3, 1), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scoring.score(docs, lm_scoring.train(docs))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.shared_dir(spark) + "/warc"
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.find_items(docs, items)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents name no owner but their source; a source's documents of one language stand for a repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secret_scan.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    base, spans = secret_scan.as_text("base"), secret_scan.as_text("spans")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), "n_owned", "n_copied")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return lexical_search.search(docs, items)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = F.when(crc_mod(7) == 0, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, tampered=more)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language": op4_language,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filters": op10_url_filters,
    "op11_secret_scan": op11_secret_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk": """
        with e as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
          where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
          select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
          from e q join e c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
        ), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
    """,
    "op3_substring_dedup": r"""
        with d as (
          select row_number() over () as r, doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
        ), s as (select r, w, unnest(range(1, len(w) - 33)) as t from d where len(w) >= 35),
        h as (select r, t, sha256(array_to_string(w[t:t+34], ' ')) as k from s),
        dup as (select k from h group by k having count(*) > 1),
        gone as (select r, list_distinct(flatten(list(range(t, t + 35)))) as p from h join dup using (k) group by r),
        kept as (
          select d.doc_id, len(w) as n_words, len(coalesce(p, [])) as n_removed,
            case when p is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(p, x[2])), lambda x: x[1]) end as k
          from d left join gone using (r)
        )
        select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from kept
    """,
    "op8_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
        f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest)
        select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
          case when f.first_id <> p.page_id then 'revisit' else 'response' end as record_type,
          case when f.first_id <> p.page_id then f.first_id end as refers_to
        from p left join f on f.payload_digest = p.payload_digest
    """,
    "op9_decontaminate": r"""
        with t as (
          select 'd' as kind, doc_id as id, text from documents union all select distinct 'i', item_id, text from benchmark
        ), w as (
          select kind, id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') as w from t
        ), i as (select id, w, least(5, len(w)) as k from w where kind = 'i' and len(w) > 0),
        q as (select distinct id, k, array_to_string(w[p:p+k-1], ' ') as s from (select id, w, k, unnest(range(1, len(w) - k + 2)) as p from i)),
        d as (
          select distinct id, k, array_to_string(w[p:p+k-1], ' ') as s
          from (select id, w, k, unnest(range(1, len(w) - k + 2)) as p from w, (select distinct k from i) where kind = 'd' and len(w) >= k)
        ), n as (select id, count(*) as n from q group by id),
        m as (select d.id as doc_id, q.id as item_id, count(*) as m from d join q using (k, s) group by all)
        select doc_id, item_id, n as n_shingles, m as n_shared, m / n as containment from m join n on n.id = m.item_id where m >= 0.8 * n
    """,
    "op11_secret_scan": r"""
        with d as (
          select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(concat('=', source), '') as owner, concat('=', concat_ws('/', source, lang)) as repo from documents
        ), kinds as (
          select * from (values
            (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{6,}$'),
            (1, 'access', '()AKIA([A-Z0-9]+)', '^.{20,}$'), (2, 'hex', '()([0-9a-f]+)', '^.{24,}$'), (3, 'owned', '()([A-Za-z0-9+/_-]{16,})', '[A-Za-z]')
          ) k(kind, name, pattern, must)
        ), hit as (select d.*, k.* from d join kinds k on regexp_matches(text, pattern)),
        m as (
          select r, kind, must, pattern, unnest(list_transform(string_split_regex(text, pattern), lambda x: length(x))) as gap, unnest(regexp_extract_all(text, pattern)) as match, generate_subscripts(string_split_regex(text, pattern), 1) as i
          from hit
        ), p as (
          select *, cast(sum(gap + length(match)) over (partition by r, kind order by i) as integer) as stop, case when kind = 0 then regexp_extract(match, pattern, 2) else match end as value from m where match is not null
        ), c as (
          select r, kind, stop - length(match) as start, stop, stop - length(value) as value_start, value from p
          where regexp_matches(match, must) and (kind < 3 or (regexp_matches(match, '[0-9]') and len(list_distinct(string_split(match, ''))) >= 8))
        ), verdict as (select value from c join d using (r) group by value having count(distinct owner) <= 2 and count(distinct repo) <= 4),
        j as (select c.*, v.value is not null as owned from c left join verdict v on v.value = c.value),
        known as (select r, start, stop from j where kind < 3 union select r, value_start, stop from j where kind < 3),
        s as (
          select j.* from j left join known k on k.r = j.r and k.start = j.start and k.stop = j.stop where kind < 3 or (owned and k.r is null)
        ), t as (
          select r, count_if(kind = 0) as n_assign, count_if(kind = 1) as n_access, count_if(kind = 2) as n_hex, count_if(kind < 3 and owned) as n_owned, count_if(kind < 3 and not owned) as n_copied,
            string_agg(concat(name, ':', start, ':', stop), ',' order by start, kind, stop) filter (kind < 3) as base, string_agg(concat(name, ':', start, ':', stop), ',' order by start, kind, stop) as spans
          from s join (select kind, name from kinds) using (kind) group by r
        )
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
          coalesce(n_owned, 0) as n_owned, coalesce(n_copied, 0) as n_copied
        from d left join t using (r)
    """,
    "op12_lexical_search": r"""
        with t as (
          select 'd' as kind, row_number() over () as r, doc_id as id, text from documents union all select 'i', row_number() over (), item_id, text from benchmark
        ), w as (
          select kind, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from t
        ), n as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_terms from w where kind = 'd' and len(w) > 0),
        tf as (select kind, r, term, count(*) as tf from (select kind, r, unnest(w) as term from w) group by all),
        weight as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as weight from tf, n where kind = 'd' group by term, n_docs),
        m as (select r, id, 75 + (25 * len(w) * n_docs) // n_terms as m from w, n where kind = 'd' and len(w) > 0),
        s as (
          select q.r as item, m.r, m.id as doc_id, cast(sum(q.tf * weight * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m))) as bigint) as score
          from tf q join tf d on d.term = q.term and q.kind = 'i' and d.kind = 'd' join weight on weight.term = q.term join m on m.r = d.r group by q.r, m.r, m.id
        ), k as (select item, doc_id, score, row_number() over (partition by item order by score desc, doc_id, r) as rank from s where score > 0)
        select w.id as item_id, cast(rank as integer) as rank, doc_id, score from k join w on w.kind = 'i' and w.r = k.item where rank <= 20
    """,
    "op13_merkle": r"""
        with recursive d as (
          select row_number() over () as r, doc_id, lang, coalesce(concat(octet_length(encode(doc_id::varchar)), ':', doc_id), '-') as a, coalesce(concat(octet_length(encode(source)), ':', source), '-') as b, coalesce(concat(octet_length(encode(lang)), ':', lang), '-') as c,
            coalesce(concat(octet_length(encode(text)), ':', text), '-') as e, n_chars, case when coalesce(crc, false) then n_chars + 1 else n_chars end as shown
          from (select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b:
            list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint) % 7 = 0 as crc from documents)
        ), l as (
          select r, doc_id, lang, sha256(concat(a, b, c, coalesce(concat(length(n_chars::varchar), ':', n_chars), '-'), e)) as leaf, sha256(concat(a, b, c, coalesce(concat(length(shown::varchar), ':', shown), '-'), e)) as shown from d
        ), leaves as (
          select *, row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by lang) as n from l
        ), nodes as (
          select lang, 0 as level, pos, n, leaf as digest from leaves
          union all
          select lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1 group by lang, level, pos // 2, n
        ), tops as (select lang, digest as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
        crown as (
          select 0 as level, pos, n, subroot as digest from tops
          union all
          select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from crown where n > 1 group by level, pos // 2, n
        ), way as (
          select leaves.r, nodes.level, nodes.digest, leaves.pos >> nodes.level & 1 as right_one from leaves join nodes on nodes.lang is not distinct from leaves.lang and nodes.pos = xor(leaves.pos >> nodes.level, 1) and nodes.n > 1
          union all select leaves.r, 100 + crown.level, crown.digest, tops.pos >> crown.level & 1 from leaves join tops on tops.lang is not distinct from leaves.lang join crown on crown.n > 1 and crown.pos = xor(tops.pos >> crown.level, 1)
        ), steps as (
          select leaves.r, nodes.level, row_number() over (partition by leaves.r order by nodes.level) as i from leaves join nodes on nodes.lang is not distinct from leaves.lang and nodes.pos = leaves.pos >> nodes.level and nodes.n > 1
          union all select leaves.r, 100 + crown.level, (select count(*) from nodes x where x.lang is not distinct from leaves.lang and x.pos = 0 and x.n > 1) + row_number() over (partition by leaves.r order by crown.level)
          from leaves join tops on tops.lang is not distinct from leaves.lang join crown on crown.pos = tops.pos >> crown.level and crown.n > 1
        ), turns as (select s.r, s.i, w.digest, w.right_one from steps s left join way w on w.r = s.r and w.level = s.level),
        folds as (
          select r, 0::bigint as i, shown as digest from leaves
          union all
          select f.r, f.i + 1, sha256(case when t.digest is null then f.digest when t.right_one = 1 then concat(t.digest, f.digest) else concat(f.digest, t.digest) end) from folds f join turns t on t.r = f.r and t.i = f.i + 1
        ), folded as (select r, arg_max(digest, i) as folded_root from folds group by r),
        proofs as (select r, string_agg(digest, '' order by level) as proof from way group by r)
        select doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = root as verified
        from leaves join tops on tops.lang is not distinct from leaves.lang cross join (select digest as root from crown where n = 1) join folded using (r) left join proofs using (r)
    """,
}
