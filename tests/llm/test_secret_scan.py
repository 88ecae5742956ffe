import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from signalmill.llm import secret_scan

SCHEMA = "doc_id long, text string, source string, lang string, row string, kind int, `end` string, digest string"
KEY = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = re.compile(rf"""({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_of(text):
    """(start, kind, end, value start) of the base spans, by Python's own matching."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end(), m.start()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def loose_of(text):
    runs = re.finditer("[A-Za-z0-9+/_-]{16,}", text)
    return [(m.start(), 3, m.end(), m.start()) for m in runs if re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0]) and len(set(m[0])) >= 8]


def brute(rows, max_owners=2, max_repositories=4):
    holders = defaultdict(lambda: (set(), set()))
    for _, text, source, lang, *_ in rows:
        for x in base_of(text or "") + loose_of(text or ""):
            owners, repositories = holders[(text or "")[x[3] : x[2]]]
            owners.add(source)
            repositories.add("/".join(v for v in (source, lang) if v is not None))
    owned = {v for v, (o, r) in holders.items() if len(o) <= max_owners and len(r) <= max_repositories}
    out = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        base = base_of(text)
        known = {(x[0], x[2]) for x in base} | {(x[3], x[2]) for x in base}
        added = [x for x in loose_of(text) if text[x[3] : x[2]] in owned and (x[0], x[2]) not in known]
        shown = lambda xs: ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(xs))
        n = Counter(x[1] for x in base)
        live = sum(text[x[3] : x[2]] in owned for x in base)
        out[(doc_id, n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + added), live, len(base) - live)] += 1
    return out


def found(docs):
    got = secret_scan.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.as_text("base"), 256), secret_scan.as_text("spans"), "n_owned", "n_copied")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    key = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    hexes, big, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijkLMNOPQRST0123456789_-/+"
    copied, example = key(40, hexes), "AKIA" + key(16, big)
    out = []
    for i in range(120):
        parts = [rng.choice(["plain words", "ÄÖ 日本 😀", "deadbeef", "x" * 30]) for _ in range(rng.randint(0, 6))]
        parts.insert(0, rng.choice([f"token = \"{key(40, hexes)}\"", f"Api_Key:'{key(9, mixed)}'", f"passwd=abc secret=token: {key(12, mixed)}", f"AKIA{key(16, big)}", f"AKIA{key(9, big)}", key(24, mixed), copied, example, ""]))
        rng.shuffle(parts)
        out.append((i, " ".join(parts), f"s{i % 7}" if i % 9 else None, rng.choice(["en", "de", None])))
    shared = key(30, mixed) + "1aB"
    out += [(200 + i, f"{shared} and password={copied}", "hot", "en") for i in range(60)]  # owned however often it occurs
    out += [(300, None, None, None), (301, "", "s1", "en"), (None, f"secret={example}", "s1", "en"), (302, "x " * 50_000 + f"token={shared}", "hot", "fr"), (303, f"{key(25, hexes)} " * 3000, "s2", "en")]
    out += [out[3], out[3]]
    return [(*r, "row", 9, "end", "d") for r in out]


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = Counter(tuple(r) for r in found(docs).collect())
    want = brute(rows)
    assert got == want
    assert any("owned:" in k[5] for k in want) and any(k[6] for k in want) and any(k[7] for k in want)


def test_ownership_decides(spark):
    run = "aB3dE6gH9jK2mN5pQ8"
    for n in (2, 3):
        docs = spark.createDataFrame([(i, f"see {run} here", f"s{i % n}", "en") for i in range(6)], "doc_id long, text string, source string, lang string")
        assert {r[5] for r in found(docs).collect()} == ({"owned:4:22"} if n == 2 else {""})


def test_one_owner_many_repositories(spark):
    docs = spark.createDataFrame([(i, "aB3dE6gH9jK2mN5pQ8", "s", f"l{i}") for i in range(5)], "doc_id long, text string, source string, lang string")
    assert {r[5] for r in found(docs).collect()} == {""}


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_in_the_plan(spark, rows):
    plan = found(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
