"""Toxicity by non-negative positive-unlabelled learning.

A linear scorer over hashed words and word beginnings is trained from confirmed toxic
examples and unlabelled text. The risk is pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1)) with
the class prior pi: unlabelled text stands for both classes, the prior takes the toxic part out
again, and where that estimate turns negative the step goes back up (the non-negative
correction), so the model cannot win by memorising the positives.

Training reads a bounded sample, the least hashes of doc_id among the rows that may be
learnt from: ``positives`` confirmed and ``unlabelled`` other texts, near copies in it
taken once, TRAINING_FEATURES of each at most. Scoring reads every whole text.

The risk leaves the scale of the scores to chance where the classes can be told apart: of samples
of one table, models caught 0.66 to 0.85 at one threshold. So one model is trained for each fold
of the positives, and its scale is set on texts it has not seen, that fold and the confirmed clean
texts (``negatives`` at most), weighted to the prior, a missed toxic text counted MISSED times. The scorer is the mean of these, itself linear.

Defined results: null and empty texts get the score of no features; without a confirmed
toxic row every score is 0; equal texts have equal scores, a row for each; rows that share a doc_id
are scored each by its own text; a row without a doc_id is never learnt from and not held out; very
long texts are scored whole; an empty table gives no rows. Columns of docs keep their names and
values, but for names that begin with __skyledger_, which are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import Adam, Examples, Scorer, packed, presence, sigmoid, telling, without_copies
from .textbatch import ALNUM, blocks

#: Bounds of the training sample in documents.
POSITIVES, UNLABELLED, NEGATIVES = 3000, 5000, 3000
#: Models, each trained without one part of the confirmed texts, and the texts of a class that set a scale, at least.
FOLDS, LEAST_KNOWN = 3, 10
#: Clean texts lost that weigh as much as a toxic one missed, when a scale is set.
MISSED = 2.0
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3


def held_out(doc_id: Column | str) -> Column:
    """crc32 of doc_id as text leaves 2 when divided by 4: never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = []
        for first, last, words in blocks(batch.column("text"), ALNUM, lower=True):
            out += packed(*presence(words), last - first)
        yield pa.record_batch([batch.column("label"), pa.array(out, pa.binary())], names=["label", "features"])


def fit_nnpu(positive: Examples, unlabelled: Examples, prior: float, epochs: int = 60, rate: float = 0.03, decay: float = 2e-3, seed: int = 7) -> Scorer:
    """Minimises the non-negative PU risk under the logistic loss, in minibatches."""
    kept = telling(positive.rates(), positive.n, unlabelled.rates(), unlabelled.n)
    w, bias = np.zeros(len(kept)), np.array([np.log(prior / (1 - prior))])
    if not len(kept):
        return Scorer(kept, w, float(bias[0]))
    positive.select(kept)
    unlabelled.select(kept)
    rng = np.random.default_rng(seed)
    adam, adam_bias = Adam(len(w), rate), Adam(1, rate)
    steps = max(1, unlabelled.n // 256)
    for _ in range(epochs):
        order_p, order_u = rng.permutation(positive.n), rng.permutation(unlabelled.n)
        for part_p, part_u in zip(np.array_split(order_p, steps), np.array_split(order_u, steps)):
            if not len(part_p) or not len(part_u):
                continue
            (pi, pf), (ui, uf) = positive.take(part_p), unlabelled.take(part_u)
            fp = bias[0] + np.bincount(pi, weights=w[pf], minlength=len(part_p))
            fu = bias[0] + np.bincount(ui, weights=w[uf], minlength=len(part_u))
            negative = np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp))
            if negative >= 0:
                gp = -prior * np.ones(len(part_p)) / len(part_p)  # -sigmoid(-f) of R_p(+1), -sigmoid(f) of R_p(-1)
                gu = sigmoid(fu) / len(part_u)
            else:  # back up along the negative part alone
                gp = prior * sigmoid(fp) / len(part_p)
                gu = -sigmoid(fu) / len(part_u)
            g = np.bincount(pf, weights=gp[pi], minlength=len(w)) + np.bincount(uf, weights=gu[ui], minlength=len(w))
            adam.step(w, g + decay * w / len(part_u))
            adam_bias.step(bias, np.array([gp.sum() + gu.sum()]))
    return Scorer(kept, w, float(bias[0]))


def scale(toxic: np.ndarray, clean: np.ndarray, prior: float) -> tuple[float, float]:
    """(a, b) for which sigmoid(a * x + b) of the log odds x is likeliest, by Platt's rounded targets, toxic texts being ``prior`` of all and counted MISSED times.

    A weak pull to (1, 0) keeps it finite; (1, 0) too where fewer than LEAST_KNOWN texts of a class are known.
    """
    if min(len(toxic), len(clean)) < LEAST_KNOWN:
        return 1.0, 0.0
    x = np.stack([np.concatenate([toxic, clean]), np.ones(len(toxic) + len(clean))])
    target = np.repeat([(len(toxic) + 1) / (len(toxic) + 2), 1 / (len(clean) + 2)], [len(toxic), len(clean)])
    weight = np.repeat([MISSED * prior / len(toxic), (1 - prior) / len(clean)], [len(toxic), len(clean)])
    at, start, pull = np.array([1.0, 0.0]), np.array([1.0, 0.0]), 1e-3
    loss = lambda v: float(weight @ (np.logaddexp(0, v @ x) - target * (v @ x)) + pull / 2 * ((v - start) ** 2).sum())
    for _ in range(100):
        p = sigmoid(at @ x)
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + pull * np.eye(2), x @ (weight * (p - target)) + pull * (at - start))
        while np.abs(step).max() > 1e-9 and loss(at - step) > loss(at):
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fit_scaled(toxic: list[bytes], other: list[bytes], clean: list[bytes], prior: float, folds: int = FOLDS) -> Scorer:
    """The mean of one model for each fold of toxic, each scaled on that fold and a part of clean; their texts are left out of ``other``."""
    folds = folds if len(toxic) >= folds * LEAST_KNOWN and len(clean) >= folds * LEAST_KNOWN else 1
    models = []
    for k in range(folds):
        unseen, known = (toxic[k::folds], [t for i, t in enumerate(toxic) if i % folds != k]) if folds > 1 else ([], toxic)
        apart = clean[k::folds] if folds > 1 else []
        left_out = set(unseen) | set(apart)
        model = fit_nnpu(Examples(known), Examples([t for t in other if t not in left_out] or other), prior)
        a, b = scale(model.logits(unseen), model.logits(apart), prior)
        models.append(Scorer(model.features, a * model.weights, a * model.bias + b))
    features = np.unique(np.concatenate([m.features for m in models]))
    weights = np.zeros(len(features))
    for m in models:
        weights[np.searchsorted(features, m.features)] += m.weights / folds
    return Scorer(features, weights, sum(m.bias for m in models) / folds)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, negatives: int = NEGATIVES) -> Scorer | None:
    """A model from labels (doc_id, toxic) and the texts of docs; rows held out are not read."""
    usable = labels.filter("toxic is not null and doc_id is not null").filter(~held_out("doc_id"))
    total, toxic = usable.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return None
    pick = lambda df, n, label: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select(F.col("doc_id").alias("__skyledger_id"), F.lit(label).alias("label"))
    chosen = pick(usable.filter("toxic = 1"), positives, 1).unionByName(pick(docs.filter("doc_id is not null").filter(~held_out("doc_id")), unlabelled, 0))
    chosen = chosen.unionByName(pick(usable.filter("toxic = 0"), negatives, 2))
    picked = chosen.collect()  # positives + unlabelled + negatives rows at most
    table = docs.sparkSession.createDataFrame(picked, chosen.schema)
    texts = docs.select("doc_id", "text").join(F.broadcast(table), F.col("doc_id") == F.col("__skyledger_id")).select("label", "text")
    rows = texts.mapInArrow(_featurise, "label int, features binary").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.features)))  # the order of tasks does not matter
    known, other, clean = (without_copies([bytes(r.features) for r in rows if r.label == x]) for x in (1, 0, 2))
    if not known or not other:
        return None
    return fit_scaled(known, other, clean, min(max(toxic / total, 0.001), 0.9))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Scorer | None = shared.value
        for batch in batches:
            out = []
            for first, last, words in blocks(batch.column("text"), ALNUM, lower=True):
                if model is None:
                    out.append(np.zeros(last - first))
                else:
                    out.append(model.scores(words, last - first))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(score)], names=[*batch.schema.names, SCORE])

    return run


SCORE = "__skyledger_score"


def scored(docs: DataFrame, model: Scorer | None) -> DataFrame:
    """docs and SCORE, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_FEATURES weights at most
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score(shared), f"{schema}, {SCORE} double")


def clean(docs: DataFrame, model: Scorer | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, as they are."""
    return scored(docs, model).filter(F.col(SCORE) < threshold).select(*docs.columns)
