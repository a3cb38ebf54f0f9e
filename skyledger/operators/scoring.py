"""Readings against labels: aligned rows, scores of fields, rows, sections and files, differences, verdicts on runs.

``compared`` pairs the rows of two tables by alignment of their normal forms, one document at a time; all else is
aggregation over those pairs.

Defined results: a document that only one side has is all missing or all extra; null cells are empty; a share of
nothing is null; ties in a ranking go to the smaller name.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import CORE_FIELDS, error_kind, normal_cell, squeezed, text_of
from ..functions.scalars import round_half_up
from .sequence import align

#: Differences kept of a file, error kinds kept of a field, insights given.
MOST_DIFFS, TOP_KINDS, INSIGHTS = 200, 3, 5


def percent(part: Column, whole: Column) -> Column:
    """Percent to one decimal, halves up; null of nothing."""
    return F.when(whole > 0, round_half_up(100.0 * part / whole, 1))


def plain_cell(field: str, value: Column) -> Column:
    """Documents are compared as written, but for blanks."""
    return squeezed(value)


def compared(read: DataFrame, label: DataFrame, keys: list[str], order: str, fields: list[str] = CORE_FIELDS, normal: Callable[[str, Column], Column] = normal_cell) -> DataFrame:
    """(*keys, idx, in_read, in_label, p_<field>, e_<field>): rows of both tables, aligned by their normal forms.

    A key is one section of one document: its rows meet in one task.
    """
    side = lambda df: df.select(*keys, order, *[normal(f, F.col(f)).alias(f) for f in fields])
    a, b = side(read), side(label)

    def run(key: tuple, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows = [list(map(tuple, d.sort_values(order)[fields].to_numpy().tolist())) for d in (p, e)]
        none = (None,) * len(fields)
        pairs = align(*rows, len(fields))
        made = [(*key, n, i is not None, j is not None, *(none if i is None else rows[0][i]), *(none if j is None else rows[1][j])) for n, (i, j) in enumerate(pairs)]
        return pd.DataFrame(made, columns=[*keys, "idx", "in_read", "in_label", *[f"p_{f}" for f in fields], *[f"e_{f}" for f in fields]])

    kinds = ", ".join(f"`{k}` {label.schema[k].dataType.simpleString()}" for k in keys)
    cells = ", ".join([f"p_{f} string" for f in fields] + [f"e_{f} string" for f in fields])
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, f"{kinds}, idx long, in_read boolean, in_label boolean, {cells}")


def _cells(fields: list[str]) -> Column:
    """array<struct> of a pair's cells, each with its match, distance and kind of error."""

    def one(f: str) -> Column:
        p, e = text_of(F.col(f"p_{f}")), text_of(F.col(f"e_{f}"))
        kind = F.when(F.col("in_read") & F.col("in_label"), error_kind(f, p, e))
        return F.struct(F.lit(f).alias("field"), p.alias("p"), e.alias("e"), (p == e).alias("match"), F.levenshtein(p, e).cast("long").alias("distance"), kind.alias("kind"))

    return F.array(*map(one, fields))


def field_scores(pairs: DataFrame, by: list[str], fields: list[str] = CORE_FIELDS, with_extra: bool = True) -> DataFrame:
    """(*by, field, matches, total, distance, percent); with_extra: rows that only the reading has count too."""
    rows = pairs if with_extra else pairs.filter("in_label")
    long = rows.select(*by, "in_read", F.inline(_cells(fields)))
    hit = F.col("match") if with_extra else F.col("match") & F.col("in_read")
    out = long.groupBy(*by, "field").agg(F.count_if(hit).alias("matches"), F.count("*").alias("total"), F.sum("distance").alias("distance"))
    return out.withColumn("percent", percent(F.col("matches"), F.col("total")))


def row_scores(pairs: DataFrame, by: list[str], fields: list[str] = CORE_FIELDS, core: list[str] = CORE_FIELDS) -> DataFrame:
    """(*by, row_matches, core_matches, row_total, read, labelled): rows right in all fields, and in the core ones."""
    both = F.col("in_read") & F.col("in_label")
    same = lambda names: F.forall(F.array(*[F.struct(F.col(f"p_{f}").alias("p"), F.col(f"e_{f}").alias("e")) for f in names]), lambda x: text_of(x["p"]) == text_of(x["e"]))
    return pairs.groupBy(*by).agg(
        F.count_if(both & same(fields)).alias("row_matches"), F.count_if(both & same([f for f in core if f in fields])).alias("core_matches"), F.count("*").alias("row_total"),
        F.count_if("in_read").alias("read"), F.count_if("in_label").alias("labelled"),
    )


def section_totals(scores: DataFrame, section: str) -> DataFrame:
    """Row scores of files and sections summed by section; with the files that have the table, and those where it was missed."""
    there = F.col("labelled") > 0
    out = scores.groupBy(section).agg(
        *[F.sum(c).alias(c) for c in ("row_matches", "row_total", "read", "labelled")], F.count_if(there).alias("files_with_table"), F.count_if(there & (F.col("read") == 0)).alias("files_missed")
    )
    return out.withColumn("rate", F.coalesce(F.try_divide("row_matches", "row_total"), F.lit(0.0)))


def error_ranking(pairs: DataFrame, fields: list[str] = CORE_FIELDS, top: int = TOP_KINDS) -> DataFrame:
    """(field, kind, n, share, rank): of each field its commonest kinds of error, share in whole percent of the field's errors."""
    counted = pairs.select(F.inline(_cells(fields))).filter("kind is not null").groupBy("field", "kind").agg(F.count("*").alias("n"))
    share = round_half_up(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("field"))).cast("long")
    rank = F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "kind")).cast("long")
    return counted.select("field", "kind", "n", share.alias("share"), rank.alias("rank")).filter(F.col("rank") <= top)


def error_insights(ranking: DataFrame, fields: list[str] = CORE_FIELDS, most: int = INSIGHTS) -> DataFrame:
    """(place, insight): a line for each of the first fields with errors, ``dep: value_mismatch: 4 (80%), ...``."""
    said = F.concat("kind", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), F.col("share").cast("string"), F.lit("%)"))
    lines = ranking.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("rank", said.alias("t")))).alias("k"))
    place = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    numbered = lines.select(F.row_number().over(W.partitionBy().orderBy(place)).cast("long").alias("place"), F.concat("field", F.lit(": "), F.array_join(F.transform("k", lambda x: x["t"]), ", ")).alias("insight"))
    return numbered.filter(F.col("place") <= most)


def differences(pairs: DataFrame, file: str, fields: list[str] = CORE_FIELDS, most: int = MOST_DIFFS) -> DataFrame:
    """(file, nth, kind, field, read, label, idx): extra and missing rows and differing cells in order, the first ``most`` of a file."""
    both = F.col("in_read") & F.col("in_label")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("e")))
    cells = F.filter(F.transform(_cells(fields), lambda c: F.when(~c["match"], F.struct(c["field"].alias("field"), c["p"].alias("p"), c["e"].alias("e")))), lambda c: c.isNotNull())
    kind = F.when(~F.col("in_label"), "extra").when(~F.col("in_read"), "missing").otherwise("field")
    others = [c for c in pairs.columns if c in ("section",)]
    listed = pairs.select(file, *others, "idx", kind.alias("kind"), F.posexplode(F.when(both, cells).otherwise(whole)).alias("at", "c"))
    nth = F.row_number().over(W.partitionBy(file).orderBy(*others, "idx", "at")).cast("long")
    return listed.select(file, *others, nth.alias("nth"), "kind", "c.field", F.col("c.p").alias("read"), F.col("c.e").alias("label"), "idx").filter(F.col("nth") <= most)


def rollups(files: DataFrame) -> DataFrame:
    """File scores (kind, type, layout, row_matches, core_matches, row_total, read) over everything, by kind, by type and by layout, weakest layout first by ``lost``."""
    sums = [F.sum(c).alias(c) for c in ("row_matches", "core_matches", "row_total", "read")]
    out = files.groupingSets([[], ["kind"], ["type"], ["layout"]], "kind", "type", "layout").agg(F.grouping_id().alias("gid"), F.count("*").alias("files"), *sums)
    level = F.when(F.col("gid") == 7, "overall").when(F.col("gid") == 3, "kind").when(F.col("gid") == 5, "type").otherwise("layout")
    return out.select(
        level.alias("level"), F.coalesce("kind", "type", "layout", F.lit("")).alias("value"), "files", "row_matches", "core_matches", "row_total", "read",
        percent(F.col("row_matches"), F.col("row_total")).alias("row_exact"), percent(F.col("core_matches"), F.col("row_total")).alias("core_exact"), (F.col("row_total") - F.col("row_matches")).alias("lost"),
    )


# ---- verdicts ---------------------------------------------------------------------------

#: What makes a label suspicious.
MIN_ROW_MISMATCH, MIN_FIELD_ERRORS, MAX_CONFIDENCE = 0.25, 3, 0.85


def stale_labels(files: DataFrame) -> DataFrame:
    """files (file, row_matches, row_total, field_errors) with mismatch, stale, confidence and suspicious."""
    mismatch = F.when(F.col("row_total") > 0, 1 - F.col("row_matches") / F.col("row_total")).otherwise(1.0)
    error_rate = F.when(F.col("row_total") > 0, F.col("field_errors") / F.col("row_total")).otherwise(F.col("field_errors").cast("double"))
    scored = files.withColumns({"mismatch": mismatch, "stale": F.least(F.lit(1.0), mismatch * 0.6 + F.least(F.lit(1.0), error_rate / 8) * 0.4)})
    scored = scored.withColumn("confidence", F.greatest(F.lit(0.0), 1 - F.col("stale")))
    odd = (F.col("mismatch") >= MIN_ROW_MISMATCH) | (F.col("field_errors") >= MIN_FIELD_ERRORS) | (F.col("confidence") <= MAX_CONFIDENCE)
    return scored.withColumn("suspicious", odd)


def most_suspicious(stale: DataFrame, top: int = 20) -> DataFrame:
    return stale.filter("suspicious").orderBy(F.desc("stale"), F.desc("field_errors"), "file").limit(top)


def reading_quality(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows (*by, order, confidence, critical) -> (*by, n, confidence, low, reason): whether a reading is worth a closer look.

    Confidences are added one by one by ``order`` (give a total one), so the last bits of their mean do not hang on how the rows are dealt.
    """
    upto = F.sum("__c").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    summed = rows.withColumn("__c", F.coalesce("confidence", F.lit(0.5))).withColumn("__upto", upto)
    n, critical = F.count("*"), F.coalesce("critical", F.lit(False)).cast("double")
    told = summed.groupBy(*by).agg(n.alias("n"), (F.max_by("__upto", order) / n).alias("confidence"), F.avg((F.col("__c") < 0.5).cast("double")).alias("weak"), F.avg(critical).alias("critical"))
    whole = lambda x: round_half_up(x * 100).cast("long").cast("string")
    reason = (
        F.when(F.col("n") < 5, F.concat(F.lit("Too few rows extracted ("), F.col("n").cast("string"), F.lit(")")))
        .when(F.col("confidence") < 0.45, F.concat(F.lit("Low average confidence ("), whole(F.col("confidence")), F.lit("%)")))
        .when(F.col("weak") > 0.3, F.concat(whole(F.col("weak")), F.lit("% of rows have low confidence")))
        .when(F.col("critical") > 0.2, F.concat(whole(F.col("critical")), F.lit("% of rows have critical field failures"))).otherwise("")
    )
    return told.select(*by, "n", "confidence", (reason != "").alias("low"), reason.alias("reason"))


def run_verdict(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row of two runs (key, ok, total) over the same documents: sums, wins, losses, and better, tie or worse.

    A run is better or worse by the margin, 0.5 % of the rows and 3 at least.
    """
    both = before.select(key, F.col("ok").alias("b"), F.col("total").alias("t")).join(after.select(key, F.col("ok").alias("a")), key)
    sums = both.agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.sum("t").alias("total"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"))
    margin, gain = F.greatest(F.lit(3.0), round_half_up(0.005 * F.col("total"))), F.col("after") - F.col("before")
    return sums.withColumn("verdict", F.when(gain >= margin, "better").when(gain <= -margin, "worse").otherwise("tie"))


#: Growth of suspect words that stops a model, of one file and of all.
FILE_GROWTH, TOTAL_GROWTH = 200, 1000


def suspect_growth(before: DataFrame, after: DataFrame, key: str, n: str) -> DataFrame:
    """(key, before, after, grown, total, passes): files of both runs; total also takes off what files gone had."""
    joined = before.select(key, F.col(n).alias("before")).join(after.select(key, F.col(n).alias("after")), key, "full_outer")
    change = F.when(F.col("before").isNotNull(), F.coalesce("after", F.lit(0)) - F.col("before")).otherwise(0)
    marked = joined.withColumns({"change": change, "grown": F.col("before").isNotNull() & F.col("after").isNotNull() & (change >= FILE_GROWTH)})
    sums = marked.agg(F.coalesce(F.sum("change"), F.lit(0)).alias("total"), F.coalesce(F.max("grown"), F.lit(False)).alias("any"))
    return sums.select("total", (~F.col("any") & (F.col("total") < TOTAL_GROWTH)).alias("passes"))


def label_check(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Runs (key, rows, total, label_hash): what became of each file of the later run, and whether its label was edited since."""
    b = before.select(key, F.col("rows").alias("rows_before"), F.col("label_hash").alias("hash_before"))
    gain = F.col("rows") - F.col("rows_before")
    state = F.when(F.col("rows_before").isNull(), "new").when(gain > 0, "BETTER").when(gain < 0, "WORSE").otherwise("same")
    edited = F.coalesce(F.col("hash_before").isNotNull() & (F.col("hash_before") != F.col("label_hash")), F.lit(False))
    return after.join(b, key, "left").select(key, "rows_before", "rows", "total", state.alias("state"), edited.alias("label_edited"))


def word_accuracy(words: DataFrame, by: list[str]) -> DataFrame:
    """Tagged words (tag, said): accuracy over all words whose tag is known, and over those that have one (``?`` unknown, ``O`` none)."""
    known, tagged, right = F.col("tag") != "?", (F.col("tag") != "?") & (F.col("tag") != "O"), F.col("tag") == F.col("said")
    return words.groupBy(*by).agg(F.count_if(known).alias("words"), percent(F.count_if(known & right), F.count_if(known)).alias("accuracy"), percent(F.count_if(tagged & right), F.count_if(tagged)).alias("tagged_accuracy"))


def fold_sums(folds: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Counters of all folds together."""
    return folds.groupBy(*by).agg(F.countDistinct("fold").alias("folds"), *[F.sum(c).alias(c) for c in counters])


def error_sources(errors: DataFrame) -> DataFrame:
    """Errors (row, field, source) -> rows by what would mend them: every source of a row must be of the class.

    Sources: ``ocr``, ``label``, ``assembly`` and ``lost``.
    """
    sources = errors.groupBy("row").agg(F.collect_set("source").alias("s"), F.count("*").alias("cells"))
    only = lambda *names: F.forall("s", lambda x: x.isin(*names))
    kind = F.when(only("label"), "label to correct").when(only("assembly", "label"), "rules").when(only("ocr", "label"), "recognition").otherwise("several causes")
    return sources.groupBy(kind.alias("mend")).agg(F.count("*").alias("rows"), F.sum("cells").alias("cells"))


# ---- recognised text against labels -----------------------------------------------------


def closest_stretch(pattern: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of text nearest to pattern by edits; of equal ones the first that ends."""
    # a column is the best way to each end in the text: (edits, start)
    best = [(0, j) for j in range(len(text) + 1)]
    for i, p in enumerate(pattern, 1):
        row = [(i, 0)]
        for j, t in enumerate(text):
            ways = ((best[j][0] + (p != t), 0, best[j][1]), (best[j + 1][0] + 1, 1, best[j + 1][1]), (row[j][0] + 1, 2, row[j][1]))
            edits, _, start = min(ways)
            row.append((edits, start))
        best = row
    end = min(range(len(best)), key=lambda j: best[j][0])
    return best[end][0], best[end][1], end


def ocr_cells(label: DataFrame, keys: list[str], section: str, order: str, fields: list[str] = CORE_FIELDS) -> DataFrame:
    """(*keys, place, order, field, want): the label's cells as they should be read, planned rows last; a day's date and weekday once."""
    numbered = label.withColumn("__first", F.row_number().over(W.partitionBy(*keys, section, "date").orderBy(order)) == 1)
    want = lambda f: F.upper(F.regexp_replace(text_of(F.col(f)), r"\s+", ""))
    each = F.array(*[F.struct(F.lit(f).alias("field"), want(f).alias("want"), (F.col("__first") if f in ("date", "day") else F.lit(True)).alias("counts")) for f in fields])
    return numbered.select(*keys, (F.col(section) == "planned").cast("int").alias("place"), order, F.inline(each)).filter("want <> '' and counts").drop("counts")


def ocr_scores(lines: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """(key, field, cells, exact, chars, errors): cells of ocr_cells found in lines (key, nth, text), each place once, longest cells first.

    What is not found whole costs its edits to the closest stretch of a line. A key is one picture.
    """
    read = lines.select(key, "nth", F.upper(F.regexp_replace(text_of(F.col("text")), r"\s+", "")).alias("text"))

    def run(k: tuple, seen: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        texts = seen.sort_values("nth").text.tolist()
        cells_ = list(want.sort_values([c for c in want.columns if c not in (key, "want", "field")])[["field", "want"]].itertuples(index=False, name=None))
        missed, score = [], {}
        for field, cell in cells_:
            score.setdefault(field, [0, 0, 0, 0])
            score[field][0] += 1
            score[field][2] += len(cell)
        for field, cell in sorted(cells_, key=lambda c: -len(c[1])):
            at = next((n for n, t in enumerate(texts) if cell in t), None)
            if at is None:
                missed.append((field, cell))
            else:
                texts[at] = texts[at].replace(cell, "\x01", 1)
                score[field][1] += 1
        for field, cell in missed:
            score[field][3] += min([len(cell), *(closest_stretch(cell, t)[0] for t in texts if t)])
        return pd.DataFrame([(k[0], f, *v) for f, v in score.items()], columns=[key, "field", "cells", "exact", "chars", "errors"])

    kind = cells.schema[key].dataType.simpleString()
    return read.groupBy(key).cogroup(cells.groupBy(key)).applyInPandas(run, f"{key} {kind}, field string, cells long, exact long, chars long, errors long")


def ocr_accuracy(scores: DataFrame, by: list[str]) -> DataFrame:
    """Word and character accuracy in percent."""
    sums = scores.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("cells", "exact", "chars", "errors")])
    return sums.withColumns({"words": percent(F.col("exact"), F.col("cells")), "characters": percent(F.col("chars") - F.col("errors"), F.col("chars"))})


def record_scores(read: DataFrame, label: DataFrame, key: str, fields: list[str], normal: Callable[[str, Column], Column]) -> DataFrame:
    """(key, all_right, *right_<field>) of flat records: a picture whose reading failed has nothing right."""
    a, b = (df.select(key, *[normal(f, F.col(f)).alias(f"{side}_{f}") for f in fields]) for df, side in ((read, "p"), (label, "e")))
    joined = b.join(a, key, "left")
    right = {f: F.col(f"p_{f}").eqNullSafe(F.col(f"e_{f}")) for f in fields}
    every = F.forall(F.array(*right.values()), lambda x: x)
    return joined.select(key, every.alias("all_right"), *[c.alias(f"right_{f}") for f, c in right.items()])


def record_accuracy(scores: DataFrame, fields: list[str]) -> DataFrame:
    """(field, matches, total, percent) of record_scores, and a row ``*`` of records right in all fields."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"right_{f}").alias("ok")) for f in fields], F.struct(F.lit("*").alias("field"), F.col("all_right").alias("ok")))
    out = scores.select(F.inline(each)).groupBy("field").agg(F.count_if("ok").alias("matches"), F.count("*").alias("total"))
    return out.withColumn("percent", percent(F.col("matches"), F.col("total")))
