"""Language identification of mixed-language text.

Words are runs of letters. A word's script, by code point ranges of its first letter, narrows the
languages to those that use the script in training; each of these scores the word by its letter
trigrams. A Viterbi pass over a text's words, with a penalty for every switch, labels each word, and
runs of one label are the spans. The language with most letters in its spans is the text's; the score
is its share of the letters.

A constant labelling is the best one if no language gains more than the penalty over the overall
winner on any stretch of words, and the largest gains on a text's beginning and on its end together are
no more than it either, which cumulative sums show at once; only other texts need the word by word pass.

Trigram tables come from a bounded sample: whole texts of at most ``max_documents`` rows of each language,
in the order of a hash of their ids, so that what reaches the driver is a table of counts for each language
that occurs. Every whole text is labelled.

Null texts and texts without a letter: ``und``, score 0. Words in scripts that no learned language uses
favour none. Ties go to the first language in alphabetical order. A very long text is labelled whole: a
task holds one at a time, with some 9 bytes for each of its words and each language. Repeated rows are
labelled alike. Columns other than doc_id, text and lang are ignored, whatever their names. An empty table
gives no rows; without training rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.llm.words import pieces

BUCKETS, FLOOR, SWITCH = 1 << 16, 12.0, 12.0
#: First code points of scripts' main blocks (Unicode): fixed values. 0 is all that is not listed.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1380, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
_NAMES = sorted({name for _, name in SCRIPTS})


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages, float32
    uses: np.ndarray  # scripts x languages, bool


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: is it a letter, its lower case, its script."""
    points = range(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in points), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    starts = np.array([s for s, _ in SCRIPTS])
    index = np.array([_NAMES.index("other"), *(_NAMES.index(n) for _, n in SCRIPTS)], np.uint8)
    return letter, lower, index[np.searchsorted(starts, np.arange(0x110000), side="right")]


def letter_words(texts: list[str]):
    """(code points, starts, ends, words of each text as offsets, characters of each text as offsets)."""
    letter, lower, _ = _tables()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    is_letter = np.zeros(len(points) + 2, dtype=np.int8)
    is_letter[1:-1] = letter[points]
    step = np.diff(is_letter)
    starts = np.flatnonzero(step == 1)
    return lower[points], starts, np.flatnonzero(step == -1), np.searchsorted(starts, off), off


def trigrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(bucket of each letter's trigram, first trigram of each word): a word of n letters has n, with
    its ends marked."""
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(first[-1]) + np.repeat(starts - first[:-1], size)
    here = points[at].astype(np.uint64)
    before, after = np.empty_like(here), np.empty_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[first[:-1]] = 1
    after[first[1:] - 1] = 2
    key = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (here * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
    return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64), first


def train(docs: DataFrame, learn: Column | None = None, max_documents: int = 400) -> LanguageModel:
    """``learn``: a condition for the rows to learn from. The languages are the distinct values of lang."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        known = known.where(learn)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    # A hash threshold first, so that the ranking sees a few times max_documents rows of a language.
    drawn = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) < F.greatest(F.lit(4.0 * max_documents) / F.col("n"), F.lit(0.0)) * (1 << 30)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "lang"), "doc_id")
    # A count for each language is far less than the table of each that the model holds.
    ids = known.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(drawn).withColumn("i", F.row_number().over(order)).where(F.col("i") <= max_documents)
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, script = _tables()
        for batch in batches:
            for part in pieces(batch, 1, 1_000_000):
                for lang in pc.unique(part.column(0)).to_pylist():
                    points, starts, ends, _, _ = letter_words(part.column(1).filter(pc.equal(part.column(0), lang)).to_pylist())
                    key, _ = trigrams(points, starts, ends)
                    tri = np.bincount(key, minlength=BUCKETS)
                    scripts = np.bincount(script[points[starts]], minlength=len(_NAMES))
                    i, j = np.flatnonzero(tri), np.flatnonzero(scripts)
                    n = len(i) + len(j)
                    yield pa.record_batch([pa.array([lang] * n), pa.array(np.concatenate((i, BUCKETS + j))), pa.array(np.concatenate((tri[i], scripts[j])))], names=["lang", "bucket", "n"])

    def table(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A language's counts as one row."""
        out = np.zeros(BUCKETS + len(_NAMES), "<i8")
        for batch in batches:
            out[batch.column("bucket").to_numpy()] = batch.column("n").to_numpy()
        yield pa.record_batch([pa.array([key[0].as_py()]), pa.array([out.tobytes()], pa.binary())], names=["lang", "counts"])

    # A row for each language.
    counted = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sorted(counted.groupBy("lang").applyInArrow(table, "lang string, counts binary").collect())
    languages = [r.lang for r in rows]
    every = np.array([np.frombuffer(r.counts, "<i8") for r in rows], np.float64).reshape(len(rows), BUCKETS + len(_NAMES)).T
    tri, uses = every[:BUCKETS], every[BUCKETS:]
    log_p = np.log((tri + 0.1) / (tri.sum(axis=0) + 0.1 * BUCKETS))
    return LanguageModel(list(languages), log_p.astype(np.float32), uses > 0.01 * uses.sum(axis=0))


def word_scores(model: LanguageModel, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """words x languages: 0 for the best candidate, down to -FLOOR; -FLOOR for languages that don't use
    the word's script; 0 throughout for scripts of no language."""
    out = np.zeros((len(starts), len(model.languages)))
    script = _tables()[2][points[starts]]
    for s in np.unique(script):
        rows = np.flatnonzero(script == s)
        candidates = np.flatnonzero(model.uses[s])
        if not len(candidates):
            continue
        out[rows] = -FLOOR
        key, first = trigrams(points, starts[rows], ends[rows])
        scores = np.stack([np.add.reduceat(model.log_p[key, c], first[:-1]) for c in candidates], axis=1)
        out[rows[:, None], candidates] = np.maximum(scores - scores.max(axis=1, keepdims=True), -FLOOR)
    return out


def best_labels(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of one text's words."""
    n = len(scores)
    total = scores.sum(axis=0)
    winner = int(total.argmax())
    sums = np.zeros((n + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, [winner]], axis=0, out=sums[1:])
    # A stretch of other languages beside the winner costs a switch for each; texts without the winner save one.
    if (sums - np.minimum.accumulate(sums, axis=0)).max() <= switch and sums.max() + (sums[-1] - sums).max() <= switch:
        return np.full(n, winner)
    best, back = scores[0].copy(), np.zeros(scores.shape, np.uint8 if scores.shape[1] <= 256 else np.int32)
    stay = np.arange(scores.shape[1])
    for t in range(1, n):
        top = int(best.argmax())
        moved = best[top] - switch
        back[t] = np.where(best >= moved, stay, top)
        best = np.maximum(best, moved) + scores[t]
    labels = np.empty(n, np.int64)
    labels[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (lang, start, end in characters) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, 1, 1_000_000):
                texts = pc.fill_null(part.column(1), "").to_pylist()
                points, starts, ends, words, off = letter_words(texts)
                scores = word_scores(model, points, starts, ends) if model.languages and len(starts) else np.zeros((len(starts), 0))
                langs, shares, spans = [], [], []
                for i in range(len(texts)):
                    a, b = int(words[i]), int(words[i + 1])
                    if a == b or not model.languages:
                        langs.append("und")
                        shares.append(0.0)
                        spans.append([])
                        continue
                    labels = best_labels(scores[a:b], switch)
                    letters = np.bincount(labels, ends[a:b] - starts[a:b], minlength=len(model.languages))
                    top = int(letters.argmax())
                    langs.append(model.languages[top])
                    shares.append(float(letters[top] / letters.sum()))
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [b - a]))
                    spans.append([{"lang": model.languages[labels[x]], "start": int(starts[a + x] - off[i]), "end": int(ends[a + y - 1] - off[i])} for x, y in zip(cut[:-1], cut[1:])])
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, span)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")
