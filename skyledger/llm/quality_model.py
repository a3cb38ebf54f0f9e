"""A quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or abstain (2) on every text. Expectation-
maximisation over the counts of vote patterns (a few hundred patterns whatever the corpus)
estimates each labeller's accuracy and the share of good texts; a pattern's posterior is the
label of its documents. A linear scorer over hashed words, their shapes and beginnings is then fitted to
the posteriors of a bounded sample (the least hashes of doc_id) and scores every whole text.

Defined results: null is an empty text, which is voted bad by the shortness labeller; equal
texts have equal scores, a row for each; rows without a doc_id are scored but not learnt from; very
long texts are voted on and scored whole; an empty table gives no rows. Only doc_id, of any type, and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashed import Adam, Examples, Scorer, packed, presence, sigmoid, telling
from .textbatch import NOT_SPACE, Words, blocks

#: Documents that the scorer is fitted to, at most.
SAMPLE = 8000
#: A document is kept from this score on.
KEEP_FROM = 0.5
GOOD, BAD, ABSTAIN = 1, 0, 2

LABELLERS = ("length", "symbols", "shouting", "doubled_words", "plain_words", "sentences", "few_words")


def _class_counts(words: Words, flags: np.ndarray) -> np.ndarray:
    """Bytes of a class in each row."""
    sums = np.concatenate([[0], np.cumsum(flags[words.data])])
    return sums[words.offsets[1:]] - sums[words.offsets[:-1]]


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _UPPER, _STOPS = _flags(b"!#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(b".!?")
_INNER = _flags(bytes([*range(97, 123), *range(128, 256)]))
_FIRST, _LAST = _INNER | _UPPER, _INNER | _flags(b".,;:?!")


def _plain_words(words: Words) -> np.ndarray:
    """Which words are letters with a capital at most in front and one stop at most behind."""
    odd = np.concatenate([[0], np.cumsum(~_INNER[words.data])])
    start, end = words.start, words.end
    inside = odd[np.maximum(end - 1, start + 1)] - odd[np.minimum(start + 1, end)]
    return (inside == 0) & _FIRST[words.data[start]] & (_LAST[words.data[end - 1]] | (end - start == 1))


def votes(words: Words) -> np.ndarray:
    """A row of LABELLERS' votes for each text."""
    n = words.counts()
    rows = len(n)
    letters = np.maximum(_class_counts(words, NOT_SPACE), 1)
    symbols, upper, stops = (_class_counts(words, f) for f in (_SYMBOLS, _UPPER, _STOPS))
    row, h = words.row_of_word(), words.hashes()
    distinct = np.bincount((np.unique((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))) >> np.uint64(40)).astype(np.int64), minlength=rows)
    same = np.zeros(words.n, bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    safe = np.maximum(n, 1)
    doubled = np.bincount(row[same], minlength=rows) / safe
    plain = np.bincount(row[_plain_words(words)], minlength=rows) / safe if words.n else np.zeros(rows)
    symbols, upper = symbols / letters, upper / letters

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    some, none = n >= 10, np.zeros(rows, bool)
    return np.stack(
        [
            vote(n < 10, none),
            vote((symbols > 0.05) & some, (symbols < 0.01) & some),
            vote((upper > 0.5) & some, (upper < 0.15) & some),
            vote((doubled > 0.2) & some, none),
            vote((plain < 0.7) & some, (plain > 0.9) & some),
            vote((stops == 0) & (n >= 50), (stops * 60 > n) & (stops * 2 < n) & some),
            vote((distinct < 0.1 * n) & (n >= 30), none),
        ],
        axis=1,
    ).astype(np.int64)


def _pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def fit_labellers(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior that each pattern is good, each labeller's accuracy), by EM.

    Each labeller has, for good and for bad texts, its own chances to vote good, bad or to abstain; votes are
    independent given the class. They start at what a heuristic is built for (bad votes are rare on good texts) and
    are held near it by prior counts of a twentieth of the corpus, so the classes cannot swap.
    """
    v = votes_of(pattern)
    start = np.array([[0.35, 0.25, 0.40], [0.03, 0.57, 0.40]])  # [class][vote: bad, good, abstain]
    chance = np.repeat(start[:, None, :], v.shape[1], axis=1)
    prior, share = 0.05 * count.sum(), 0.8
    labeller = np.arange(v.shape[1])
    for _ in range(rounds):
        p = sigmoid(np.log(share / (1 - share)) + (np.log(chance[1][labeller, v]) - np.log(chance[0][labeller, v])).sum(1))
        for c, weight in ((1, count * p), (0, count * (1 - p))):
            for j in labeller:
                cast = np.bincount(v[:, j], weights=weight, minlength=3)
                chance[c, j] = (cast + prior * start[c]) / (weight.sum() + prior)
        share = float(np.clip((count * p).sum() / count.sum(), 0.01, 0.99))
    right = (count * p) @ (v == GOOD) + (count * (1 - p)) @ (v == BAD)
    return p, right / np.maximum(count @ (v != ABSTAIN), 1e-9)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_pattern(votes(words)) for _, _, words in blocks(batch.column("text"), NOT_SPACE)]
        out = np.concatenate(found) if found else np.zeros(0, np.int64)
        yield pa.record_batch([batch.column("doc_id"), pa.array(out.astype(np.int32))], names=["doc_id", "pattern"])


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern): the votes as digits to the base 3, first labeller lowest."""
    return docs.select("doc_id", "text").mapInArrow(_votes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pattern int")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = []
        pattern: list[np.ndarray] = []
        for first, last, words in blocks(batch.column("text"), NOT_SPACE):
            out += packed(*presence(words, _SHAPES), last - first)
            pattern.append(_pattern(votes(words)))
        yield pa.record_batch([pa.array(np.concatenate(pattern).astype(np.int32) if pattern else [], pa.int32()), pa.array(out, pa.binary())], names=["pattern", "features"])


#: Beginnings of words that the scorer's features have beside whole words.
_SHAPES = (1, 2)


def fit_scorer(examples: Examples, posterior: np.ndarray, epochs: int = 40, rate: float = 0.03, decay: float = 5e-3, seed: int = 11) -> Scorer:
    """Logistic regression to soft labels over the telling features."""
    good, bad = examples.rates(posterior), examples.rates(1 - posterior)
    kept = telling(good, max(posterior.sum(), 1e-6), bad, max((1 - posterior).sum(), 1e-6))
    share = float(np.clip(posterior.mean(), 0.01, 0.99))
    w, bias = np.zeros(len(kept)), np.array([np.log(share / (1 - share))])
    if not len(kept):
        return Scorer(kept, w, float(bias[0]))
    examples.select(kept)
    rng = np.random.default_rng(seed)
    adam, adam_bias = Adam(len(w), rate), Adam(1, rate)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(examples.n), max(1, examples.n // 256)):
            which, feature = examples.take(part)
            g = (sigmoid(bias[0] + np.bincount(which, weights=w[feature], minlength=len(part))) - posterior[part]) / len(part)
            adam.step(w, np.bincount(feature, weights=g[which], minlength=len(w)) + decay * w / len(part))
            adam_bias.step(bias, np.array([g.sum()]))
    return Scorer(kept, w, float(bias[0]))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, patterns, posteriors = shared.value
        for batch in batches:
            score, posterior = [np.zeros(0)], [np.zeros(0)]
            for first, last, words in blocks(batch.column("text"), NOT_SPACE):
                score.append(scorer.scores(words, last - first, _SHAPES))
                posterior.append(posteriors[np.searchsorted(patterns, _pattern(votes(words)))])
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(posterior)), pa.array(np.concatenate(score))], names=["doc_id", "posterior", "score"])

    return run


def classified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, posterior, score, kept) of every row: the labellers' posterior and the scorer's own probability."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = vote_patterns(docs).groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 3 ** labellers rows at most
    out = f"doc_id {kind}, posterior double, score double"
    if not counted:
        return spark.createDataFrame([], f"{out}, kept boolean")
    counted.sort()
    pattern, count = (np.array(x) for x in zip(*counted))
    posterior, _ = fit_labellers(pattern, count)
    chosen = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    table = spark.createDataFrame(chosen.collect(), chosen.schema).withColumnRenamed("doc_id", "__skyledger_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(table), F.col("doc_id") == F.col("__skyledger_id"), "left_semi").select("text").mapInArrow(_features, "pattern int, features binary").collect()
    rows.sort(key=lambda r: (r.pattern, bytes(r.features)))
    label = posterior[np.searchsorted(pattern, np.array([r.pattern for r in rows], np.int64))] if rows else np.zeros(0)
    scorer = fit_scorer(Examples([bytes(r.features) for r in rows]), label) if rows else Scorer(np.zeros(0, np.uint32), np.zeros(0), 0.0)
    shared = spark.sparkContext.broadcast((scorer, pattern, posterior))
    return docs.select("doc_id", "text").mapInArrow(_score(shared), out).withColumn("kept", F.col("score") >= KEEP_FROM)
