import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from signalmill.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos long, n int, digest string, part int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    shown = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in shown))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, pos, digest):
    """The siblings on the way up, and the top that a digest at pos gives."""
    way = []
    for level in levels[:-1]:
        pair = [digest if i == pos else level[i] for i in range(pos & ~1, min(len(level), (pos | 1) + 1))]
        way += [level[i] for i in range(pos & ~1, min(len(level), (pos | 1) + 1)) if i != pos]
        digest, pos = sha(*pair), pos // 2
    return way, digest


def tampered(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    trees = {}
    for lang, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in own])
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    crown = tree([trees[x][-1][0] for x in names])
    out = Counter()
    for k, lang in enumerate(names):
        for pos, r in enumerate(groups[lang]):
            way, top = climb(trees[lang], pos, leaf(r, 1 if tampered(r) else 0))
            above, root = climb(crown, k, top)
            out[(r[0], leaf(r), trees[lang][-1][0], crown[-1][0], sha(*way, *above), root, root == crown[-1][0])] += 1
    return out


def found(df, up=12):
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.manifest(df, tampered=more, up=up)
    return got.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    langs = ["en"] * 12 + ["de", "fr", "", None, "日本", "é"] + [f"x{i}" for i in range(9)]
    out = [(i, f"s{i % 5}", rng.choice(langs), rng.randint(0, 99), f"text {i} ü😀") for i in range(300)]
    out += [(None, None, None, None, None), (None, None, None, None, None), (None, "a", "en", 1, "x"), (7, "s", "en", None, None), out[5], out[5], (900, "", "de", 0, ""), (901, "s", "one", 3, "y " * 200_000)]
    return out


@pytest.mark.parametrize("levels", [12, 2, 1])
def test_equals_brute_force(spark, rows, levels):
    """Pieces of two and four leaves make many rounds."""
    df = spark.createDataFrame([(*r, "g", 3, 4, "d", 5) for r in rows], SCHEMA).repartition(5)
    got = Counter(tuple(r) for r in found(df, levels).collect())
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 33])
def test_sizes_of_one_group(spark, n):
    rows = [(i, "s", "en", i, str(i)) for i in range(n)]
    df = spark.createDataFrame([(*r, "g", 3, 4, "d", 5) for r in rows], SCHEMA)
    assert Counter(tuple(r) for r in found(df, 2).collect()) == brute(rows)


def test_queue_hands_over_by_label():
    leaves = [sha(str(i)) for i in range(11)]
    nodes = merkle.sweep(leaves, 4)
    assert nodes == tree(leaves)
    proofs = merkle.reversed_sweep(nodes, "above")
    assert proofs == ["".join(climb(nodes, i, d)[0]) + "above" for i, d in enumerate(leaves)]


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)).collect() == []
