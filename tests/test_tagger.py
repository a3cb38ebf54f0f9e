"""The two-stage tagger on made pages: tags that a word alone does not tell, but its neighbours do."""

import random

from skyledger.operators import scoring, tagger

SCHEMA = "k int, line int, nth int, t string, x double, y double, w double, h double, kind string, tag string"


def page(rng, k):
    """Lines of a code, a time of departure and one of arrival; sometimes a remark."""
    out = []
    for line in range(6):
        clock = lambda: f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}"
        cells = [(f"Q{rng.randint(100, 999)}", "duty"), (clock(), "begin"), ("to", "O"), (clock(), "end")] + ([(rng.choice(["note", "see"]), "O")] if rng.random() < 0.3 else [])
        for i, (t, tag) in enumerate(cells):
            out.append((k, line, len(out), t, 10.0 + 40 * i, 20.0 * line, 30.0, 8.0, "pdf", tag))
    return out


def test_tags_from_neighbours(spark, monkeypatch):
    monkeypatch.setattr(tagger, "FOLDS", 2)
    monkeypatch.setattr(tagger, "ROUNDS", 6)
    rng = random.Random(1)
    known = [row for k in range(8) for row in page(rng, k)]
    known[3] = (*known[3][:-1], "?")
    fresh = [row for k in range(100, 103) for row in page(rng, k)]
    model = tagger.fit(spark.createDataFrame(known, SCHEMA).coalesce(1), "k")
    found = tagger.tagged(model, spark.createDataFrame(fresh, SCHEMA).coalesce(1), "k")
    assert found.count() == len(fresh)
    (score,) = scoring.word_accuracy(found, ["kind"]).collect()
    assert score.accuracy > 95 and score.words == len(fresh)


def test_without_tags_every_word_is_none(spark):
    rows = [(*r[:-1], "?") for r in page(random.Random(2), 1)]
    stage = tagger.fit_stage(tagger.features(spark.createDataFrame(rows, SCHEMA), "k"))
    assert not stage.models and {r.said for r in tagger.said(stage, tagger.features(spark.createDataFrame(rows, SCHEMA), "k")).collect()} == {"O"}


def test_word_types(spark):
    from pyspark.sql import functions as F

    words = ["09:10Z", "7Jan25", "12", "VIE", "Q310", "REMARKS", "Note", "a/b", ""]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, t string").select("i", tagger.word_type(F.col("t")).alias("k")).collect()
    assert [r.k for r in sorted(rows)] == ["time", "date", "number", "place", "code", "capitals", "name", "other", "other"]
