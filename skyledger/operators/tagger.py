"""Learned tags of positioned words: features of a word and its neighbourhood, a linear one-vs-rest tagger in two stages.

Words are (key, line, nth, t, x, y, w, h, kind, tag); key is a page, kind the sort of document, tag the label, ``O`` for none and ``?`` where it is
not known. The first stage tags from a word's own features and its neighbours'; the second also sees the tags that the
first gave to the neighbours. In training these come out of fold, so that the second stage learns from tags as unsure as
those it will meet.

Defined results: words whose tag is not known are not learnt from; a kind of document takes only tags that it had in
training, a new kind any; without any tagged word every word is ``O``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import text_of
from ..functions.scalars import shape
from .pages import word_context

#: Features that a word is hashed to, folds of pages for the first stage's tags, rounds of the solver.
FEATURES, FOLDS, ROUNDS = 1 << 14, 3, 15
_SIDES = ("left", "right", "up", "down")


def word_type(t: Column) -> Column:
    """What a word looks like: a time, a date, a number, a code, capitals, a name or something else."""
    kinds = [(r"^\d{1,2}:\d{2}(Z|[+-]\d)?$", "time"), (r"^\d{1,2}[A-Za-z]{3}\d{0,4}$|^\d{1,2}[/.]\d{1,2}", "date"), (r"^\d+([.,]\d+)?$", "number"), (r"^[A-Z]{3,4}$", "place"), (r"^[A-Z]{1,3}\d+[A-Z]?$", "code"), (r"^[A-Z]+$", "capitals"), (r"^[A-Z][a-z]+$", "name")]
    return F.coalesce(*[F.when(t.rlike(p), n) for p, n in kinds], F.lit("other"))


def features(words: DataFrame, key: str, header: str | None = None) -> DataFrame:
    """Words with ``f``: the names of their features: the word, its shape and type, its column and place, and of its neighbours the same."""
    near = word_context(words, key)
    t = text_of(F.col("t"))
    own = [F.concat(F.lit("t="), F.lower(t)), F.concat(F.lit("s="), shape(t)), F.concat(F.lit("w="), word_type(t)), F.concat(F.lit("p="), F.substring(t, 1, 2)), F.concat(F.lit("x="), F.floor(F.col("x") / 20).cast("string")), F.concat(F.lit("n="), F.least(F.length(t), F.lit(9)).cast("string"))]
    beside = [F.when(F.col(s).isNotNull(), F.concat(F.lit(f"{s}:{n}="), f(F.col(s)))) for s in _SIDES for n, f in (("t", F.lower), ("w", word_type))]
    head = [F.concat(F.lit("h="), F.lower(F.coalesce(header, F.lit(""))))] if header else []
    return near.withColumn("f", F.filter(F.array(*own, *beside, *head), lambda x: x.isNotNull()))


@dataclass
class Stage:
    """A linear scorer for each tag; none where there is only one."""

    models: list[LinearSVCModel]
    tags: list[str]


def _vectors(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="f", outputCol="features", numFeatures=FEATURES, binary=True).transform(df)


def fit_stage(df: DataFrame) -> Stage:
    """One against the rest for each tag over words with ``f``; the list of tags is what comes to the driver."""
    known = df.filter(F.col("tag").isNotNull() & (F.col("tag") != "?"))
    tags = sorted(r.tag for r in known.select("tag").distinct().collect())
    if len(tags) < 2:
        return Stage([], tags or ["O"])
    rows = _vectors(known).select("tag", "features").persist()
    learner = LinearSVC(maxIter=ROUNDS, regParam=1e-3)
    models = [learner.fit(rows.select((F.col("tag") == t).cast("double").alias("label"), "features")) for t in tags]
    rows.unpersist()
    return Stage(models, tags)


def said(stage: Stage, df: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """df with ``said``: the tag of the highest score, of those that allowed (kind, tags) has for the word's kind."""
    if not stage.models:
        return df.withColumn("said", F.lit(stage.tags[0]))
    scored, columns = _vectors(df), []
    for i, model in enumerate(stage.models):
        columns += [f"__s{i}", f"__p{i}"]
        scored = model.setRawPredictionCol(f"__s{i}").setPredictionCol(f"__p{i}").transform(scored)
    if allowed is not None:
        scored = scored.join(F.broadcast(allowed), "kind", "left")  # kinds of documents: a handful
    fits = lambda t: F.lit(True) if allowed is None else F.col("__tags").isNull() | F.array_contains(F.col("__tags"), t)
    ranked = F.array(*[F.struct(F.when(fits(t), vector_to_array(f"__s{i}")[1]).alias("s"), F.lit(t).alias("t")) for i, t in enumerate(stage.tags)])
    return scored.withColumn("said", F.array_max(ranked)["t"]).drop("features", "__tags", *columns)


def _with_tags(df: DataFrame, tagged: DataFrame, key: str) -> DataFrame:
    """Features with the neighbours' tags of a first stage among them."""
    near = word_context(tagged.select(key, "line", "nth", F.col("said").alias("t"), "x", "y"), key).select(key, "nth", *[F.col(s).alias(f"__{s}") for s in _SIDES])
    more = F.filter(F.array(*[F.when(F.col(f"__{s}").isNotNull(), F.concat(F.lit(f"{s}:tag="), F.col(f"__{s}"))) for s in _SIDES]), lambda x: x.isNotNull())
    own = tagged.select(key, "nth", F.concat(F.lit("tag="), "said").alias("__own"))
    return df.join(near, [key, "nth"], "left").join(own, [key, "nth"], "left").withColumn("f", F.concat("f", F.coalesce(more, F.array().cast("array<string>")), F.array(F.coalesce("__own", F.lit("tag="))))).drop("__own", *[f"__{s}" for s in _SIDES])


@dataclass
class Tagger:
    first: Stage
    second: Stage
    allowed: DataFrame


def fit(words: DataFrame, key: str, header: str | None = None) -> Tagger:
    """Both stages; pages are dealt to folds by a hash of their key."""
    df = features(words, key, header).withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(FOLDS))).persist()
    allowed = words.filter("tag <> '?'").groupBy("kind").agg(F.collect_set("tag").alias("__tags"))
    outside = [said(fit_stage(df.filter(F.col("__fold") != f)), df.filter(F.col("__fold") == f)) for f in range(FOLDS)]
    every = outside[0]
    for part in outside[1:]:
        every = every.unionByName(part)
    second = _with_tags(df, every, key).persist()
    out = Tagger(fit_stage(df), fit_stage(second), allowed)
    second.unpersist()
    df.unpersist()
    return out


def tagged(tagger: Tagger, words: DataFrame, key: str, header: str | None = None) -> DataFrame:
    """Words with ``said``."""
    df = features(words, key, header)
    first = said(tagger.first, df, tagger.allowed)
    return said(tagger.second, _with_tags(df, first, key), tagger.allowed).drop("f")
