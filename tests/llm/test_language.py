import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import language

ALPHABETS = {"aa": "aeioulnrst", "bb": "aozkwvyjxq", "el": "αβγδεζηθικ", "ja": "日本語漢字文学"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, 60), lang) for i, lang in enumerate([*ALPHABETS] * 40)]
    return language.train(spark.createDataFrame([*rows, (None, "x", "aa"), (900, None, "aa"), (901, "qq", None)], "doc_id long, text string, lang string").repartition(3), max_documents=30)


def label(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang_pred", F.lit("mine"))
    return {r.doc_id: r for r in language.identify(df, model).collect()}


def test_languages_and_scripts(spark, model):
    rng = random.Random(9)
    want = [*ALPHABETS] * 10
    got = label(spark, model, [text(rng, lang, 12) for lang in want])
    assert np.mean([got[i].lang_pred == lang for i, lang in enumerate(want)]) > 0.97
    latin = model.uses[language._NAMES.index("latin")]
    assert [lang for lang, used in zip(model.languages, latin) if used] == ["aa", "bb"]


def test_spans_of_mixed_text(spark, model):
    rng = random.Random(4)
    parts = [text(rng, "aa", 30), text(rng, "bb", 40), text(rng, "el", 20)]
    whole = " ".join(parts)
    row = label(spark, model, [whole])[0]
    assert [s.lang for s in row.spans] == ["aa", "bb", "el"]
    assert abs(row.spans[1].start - len(parts[0]) - 1) <= 16  # a word or two at the seam may go either way
    assert whole[row.spans[2].start : row.spans[2].end] == parts[2]
    assert row.lang_pred == "bb"
    assert 0.3 < row.score < 0.7


def test_shortcut_equals_viterbi():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, k, pen = rng.integers(1, 30), rng.integers(1, 4), 3.0
        scores = np.round(rng.normal(0, 2, (n, k)), 3)
        labels = language.best_labels(scores, pen)
        best = scores[0].copy()
        for t in range(1, n):
            best = np.maximum(best, best.max() - pen) + scores[t]
        value = scores[np.arange(n), labels].sum() - pen * (np.diff(labels) != 0).sum()
        assert value == pytest.approx(best.max())


def test_odd_inputs(spark, model, docs, no_docs, corpus):
    got = label(spark, model, [None, "", "12 34 !", "ខ្មែរ", "a" * 50000, "lone \x00 w"])
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3
    assert all(got[i].score == 0 for i in range(3))
    assert got[3].lang_pred in model.languages
    assert language.identify(docs, model).count() == len(corpus)
    assert language.identify(no_docs, model).count() == 0
    none = language.train(no_docs)
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_two_halves_beat_a_third_language_between():
    scores = np.array([[-5.0, 0, -12], [-5, 0, -12], [-5, -12, 0], [-5, -12, 0]])
    assert language.best_labels(scores, 12.0).tolist() == [1, 1, 2, 2]
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, pen = rng.integers(2, 12), 4.0
        scores = np.stack([np.full(n, -0.5), *-rng.integers(0, 3, (3, n)).astype(float)], axis=1)
        labels = language.best_labels(scores, pen)
        best = scores[0].copy()
        for t in range(1, n):
            best = np.maximum(best, best.max() - pen) + scores[t]
        assert scores[np.arange(n), labels].sum() - pen * (np.diff(labels) != 0).sum() == best.max()


MASK = (1 << 64) - 1


def plain_scores(model, word):
    """A word's scores by language, letter by letter."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in word]
    script = int(language._tables()[2][ord(low[0])])
    fits = [i for i in range(len(model.languages)) if model.uses[script][i]]
    if not fits:
        return [0.0] * len(model.languages)
    total = dict.fromkeys(fits, 0.0)
    for j, c in enumerate(low):
        before, after = ord(low[j - 1]) if j else 1, ord(low[j + 1]) if j + 1 < len(low) else 2
        key = (before * 0x9E3779B97F4A7C15 & MASK) ^ (ord(c) * 0xC2B2AE3D27D4EB4F & MASK) ^ (after * 0x165667B19E3779F9 & MASK)
        for i in fits:
            total[i] += float(model.log_p[(key * 0xD6E8FEB86659FD93 & MASK) >> 48, i])
    return [max(total[i] - max(total.values()), -language.FLOOR) if i in total else -language.FLOOR for i in range(len(model.languages))]


def test_spans_equal_all_labellings(spark, model):
    """Texts of a few words: scores word by word, and the best of all labellings."""
    rng = random.Random(12)
    texts = [" ".join(text(rng, rng.choice([*ALPHABETS]), 1)[: rng.randint(1, 5)] for _ in range(rng.randint(1, 5))) for _ in range(60)]
    got = label(spark, model, texts)
    for i, t in enumerate(texts):
        scores = [plain_scores(model, w) for w in t.split()]
        starts = np.array([0, *np.cumsum([len(w) + 1 for w in t.split()])[:-1]])
        points, a, b, _, _ = language.letter_words([t])
        assert a.tolist() == starts.tolist()
        assert language.word_scores(model, points, a, b) == pytest.approx(np.array(scores), abs=1e-3)
        value = lambda x: sum(s[k] for s, k in zip(scores, x)) - language.SWITCH * sum(p != q for p, q in zip(x, x[1:]))
        best = max(map(value, itertools.product(range(len(model.languages)), repeat=len(scores))))
        found = []
        for s in got[i].spans:
            found += [model.languages.index(s.lang)] * len(t[s.start : s.end].split())
        assert len(found) == len(scores) and value(found) == pytest.approx(best, abs=1e-3)
        letters = {k: sum(len(w) for w, x in zip(t.split(), found) if x == k) for k in found}
        assert got[i].lang_pred == model.languages[min(letters, key=lambda k: (-letters[k], k))]
        assert got[i].score == pytest.approx(max(letters.values()) / sum(letters.values()))


@pytest.mark.parametrize("languages", [3, 4])
def test_shortcut_on_narrow_scores(languages):
    """Scores so narrow that the shortcut often fires, against every labelling."""
    rng = np.random.default_rng(languages)
    constant = 0
    for _ in range(1500):
        n, pen = int(rng.integers(1, 6)), 2.0
        scores = -rng.integers(0, 4, (n, languages)) / 2
        labels = language.best_labels(scores, pen)
        best = max(sum(scores[t, k] for t, k in enumerate(x)) - pen * sum(p != q for p, q in zip(x, x[1:])) for x in itertools.product(range(languages), repeat=n))
        assert scores[np.arange(n), labels].sum() - pen * (np.diff(labels) != 0).sum() == pytest.approx(best)
        constant += len(set(labels.tolist())) == 1
    assert constant > 700


def test_learns_from_whole_texts(spark):
    """What marks a language may stand at the very end of its texts."""
    rows = [(i, "xx " * 20_000 + ("omega" if i % 2 else "kappa"), "aa" if i % 2 else "bb") for i in range(10)]
    found = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = label(spark, found, ["omega omega", "kappa kappa"])
    assert (got[0].lang_pred, got[1].lang_pred) == ("aa", "bb")
