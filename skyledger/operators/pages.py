"""Positioned text on pages: boxes to words, words to lines and rows, rows to columns, sections and dates.

A page is one document: what depends on the order of its boxes runs as one group in numpy, everything else as columns
and windows. Boxes have (key, nth, text, confidence, x0, x1, y0, y1); words (key, nth, t, x, y, w, h).

Defined results: boxes without text or extent, or read with less than 0.3 confidence, are left out; a page without boxes
has no rows; ties go to the box that comes first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import day_number, text_of, unglued

#: Least confidence; overlap that puts a box into a row; share of the text height within which centres are one row.
LEAST_CONFIDENCE, ROW_OVERLAP, SAME_ROW = 0.3, 0.5, 0.5
#: A page's text height after scaling, and how near two words of a line are in points.
TEXT_HEIGHT, LINE_TOLERANCE = 8.0, 1.5
#: Slack in pixels below a date line, farthest date line, slack above the bottom cutoff.
DATE_SLACK, DATE_REACH, CUTOFF_SLACK = 8.0, 30.0, 4.0
#: Header words with their weights, and what tells the planned part of a roster.
HEADER_WEIGHTS = {"date": 4, "duty": 4, "dep": 2, "begin": 2, "end": 2, "arr": 2}
PLANNED_TITLE = r"(?i)(rest\s*o[fe]\s*th[il1]?s\s*roster|roster\s*is\s*p[l1i]?ann)"
PUBLISHED_UNTIL = r"(?i)published\s+(?:until|to)\s+(?:[A-Za-z]{3,9}\.?\s+)?(\d{1,2})\s*([A-Za-z]{3,9})\.?\s*(\d{2,4})"
ROW_DATE = r"\d{1,2}\s*[A-Za-z]{2,9}\s*['’]?\d{2,4}\b"


# ---- boxes ------------------------------------------------------------------------------


def boxes(lines: DataFrame, *keep: str) -> DataFrame:
    """Read lines with box (array of [x, y]) as (*keep, text, confidence, x0, x1, y0, y1, yc, h), the unusable left out."""
    xs, ys = F.transform("box", lambda p: p[0]), F.transform("box", lambda p: p[1])
    made = lines.filter(F.size("box") >= 4).select(*keep, F.trim(text_of(F.col("text"))).alias("text"), "confidence", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    good = made.filter((F.col("text") != "") & (F.col("confidence").isNull() | (F.col("confidence") >= LEAST_CONFIDENCE)))
    return good.withColumns({"yc": (F.col("y0") + F.col("y1")) / 2, "h": F.col("y1") - F.col("y0")})


def without_sidebar(page: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes that begin right of the last column's header by more than twice its width, 40 at least, go."""
    whole = W.partitionBy(*keys)
    head = F.lower("text") == "arr"
    edge, width = F.min(F.when(head, F.col("x1"))).over(whole), F.max(F.when(head, F.col("x1") - F.col("x0"))).over(whole)
    return page.withColumn("__cut", edge + F.greatest(F.lit(40.0), 2 * width)).filter(F.col("__cut").isNull() | (F.col("x0") <= F.col("__cut"))).drop("__cut")


def above_cutoff(page: DataFrame, keys: list[str], noise: Column, header_y: str) -> DataFrame:
    """Boxes from the first line of noise below the header on are left out."""
    cut = F.min(F.when(noise & (F.col("yc") > F.col(header_y)), F.col("yc"))).over(W.partitionBy(*keys))
    return page.withColumn("__cut", cut).filter(F.col("__cut").isNull() | (F.col("yc") < F.col("__cut") - CUTOFF_SLACK)).drop("__cut")


def _by_page(df: DataFrame, key: str, columns: list[str], run: Callable[[pd.DataFrame], np.ndarray], name: str, kind: str = "long") -> DataFrame:
    """df with a column that run works out for each page; a page is one document."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def of(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(columns, kind="stable").reset_index(drop=True)
        page[name] = run(page)
        return page

    return df.groupBy(key).applyInPandas(of, f"{fields}, {name} {kind}")


def row_numbers(page: DataFrame, key: str) -> DataFrame:
    """Boxes with ``row``: top down, a box joins the row above when they overlap by half of the lower height of both; a row grows with its boxes."""

    def run(p: pd.DataFrame) -> np.ndarray:
        out, top, bottom, row = np.zeros(len(p), np.int64), np.inf, -np.inf, -1
        for i, (a, b) in enumerate(zip(p.y0, p.y1)):
            if min(bottom, b) - max(top, a) >= ROW_OVERLAP * min(bottom - top, b - a) and row >= 0:
                top, bottom = min(top, a), max(bottom, b)
            else:
                row, top, bottom = row + 1, a, b
            out[i] = row
        return out

    return _by_page(page, key, ["yc"], run, "row")


def anchored_rows(page: DataFrame, key: str, centre: str, reach: Callable[[pd.DataFrame], float], name: str = "row") -> DataFrame:
    """Boxes with ``row``: a new one starts where a centre is farther than reach from the row's first."""

    def run(p: pd.DataFrame) -> np.ndarray:
        far, out, first, row = reach(p), np.zeros(len(p), np.int64), None, -1
        for i, c in enumerate(p[centre]):
            if first is None or abs(c - first) > far:
                row, first = row + 1, c
            out[i] = row
        return out

    return _by_page(page, key, [centre, "x" if "x" in page.columns else "x0"], run, name)


def snapped_rows(page: DataFrame, key: str) -> DataFrame:
    """Rows of boxes whose centres are within half of the page's median height (the upper one of two) of the row's first."""
    return anchored_rows(page, key, "yc", lambda p: SAME_ROW * float(np.sort(p.h.to_numpy())[len(p) // 2]))


def text_lines(words: DataFrame, key: str) -> DataFrame:
    """Words with ``line``: a new line starts 1.5 points below the line's first word."""
    return anchored_rows(words, key, "y", lambda p: LINE_TOLERANCE, "line")


def words_of(page: DataFrame, key: str, split: bool = True) -> DataFrame:
    """(key, row, t, x, y, w, h): words of boxes, scaled so that text is 8 high, those of a row on one y; places by the characters before a word."""
    rows = snapped_rows(page, key)
    whole = W.partitionBy(key)
    ranked = rows.withColumns({"__at": F.row_number().over(whole.orderBy("h")), "__n": F.count("*").over(whole)})
    median = F.max(F.when(F.col("__at") == F.floor(F.col("__n") / 2) + 1, F.col("h"))).over(whole)
    scaled = ranked.withColumns({"s": TEXT_HEIGHT / median, "top": F.min("y0").over(W.partitionBy(key, "row")), "text": unglued(F.col("text")) if split else F.col("text")})
    found = F.regexp_extract_all("text", F.lit(r"\S+|\s+"), F.lit(0))
    # running lengths give each piece its first character
    starts = F.transform(found, lambda p, i: F.struct(p.alias("t"), F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, q: a + F.length(q)).alias("at")))
    each = scaled.select(key, "row", "s", "top", "x0", "h", ((F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))).alias("c"), F.explode(F.filter(starts, lambda p: p["t"].rlike(r"\S"))).alias("p"))
    one = lambda c: F.round(c, 1)
    return each.select(
        key, "row", F.col("p.t").alias("t"), one((F.col("x0") + F.col("p.at") * F.col("c")) * F.col("s")).alias("x"), one(F.col("top") * F.col("s")).alias("y"), one(F.length("p.t") * F.col("c") * F.col("s")).alias("w"), one(F.col("h") * F.col("s")).alias("h")
    )


# ---- rows -------------------------------------------------------------------------------


def rows_of(page: DataFrame, key: str) -> DataFrame:
    """(key, row, text, n, y0, y1, yc, h) of numbered boxes, a row's text from left to right."""
    out = page.groupBy(key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "yc", "text"))), lambda b: b["text"]), " ").alias("text"), F.count("*").alias("n"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return out.withColumns({"yc": (F.col("y0") + F.col("y1")) / 2, "h": F.col("y1") - F.col("y0")})


def split_fused(page: DataFrame, key: str) -> DataFrame:
    """Numbered boxes with the rows split that are much taller than a line and hold two dates or more: each box goes to the nearest date's row."""
    by_row, whole = W.partitionBy(key, "row"), W.partitionBy(key)
    ranked = page.withColumns({"__at": F.row_number().over(whole.orderBy("h")), "__n": F.count("*").over(whole)})
    median = F.max(F.when(F.col("__at") == F.floor(F.col("__n") / 2) + 1, F.col("h"))).over(whole)
    tall = F.max("y1").over(by_row) - F.min("y0").over(by_row) > F.greatest(median * 1.8, F.lit(14.0))
    anchors = F.array_sort(F.collect_list(F.when(F.col("text").rlike(ROW_DATE), F.col("yc"))).over(by_row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    near = F.array_min(F.transform("__anchors", lambda a, i: F.struct(F.abs(a - F.col("yc")).alias("d"), i.alias("i"))))["i"]
    marked = ranked.withColumn("__tall", tall).withColumn("__anchors", anchors)
    part = F.when(F.col("__tall") & (F.size("__anchors") >= 2), near).otherwise(0)
    split = marked.withColumn("__part", part).withColumn("__yc", (F.min("y0").over(W.partitionBy(key, "row", "__part")) + F.max("y1").over(W.partitionBy(key, "row", "__part"))) / 2)
    return split.withColumn("row", F.dense_rank().over(whole.orderBy("__yc", "row", "__part")).cast("long") - 1).select(*page.columns)


def header_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table with is_header (three header words, date or duty among them) and best: the page's heaviest header, the upper one of equals."""
    has = {w: F.col("text").rlike(rf"(?i)\b{w}\b") for w in HEADER_WEIGHTS}
    n = sum((c.cast("int") for c in has.values()), F.lit(0))
    weight = sum((c.cast("int") * HEADER_WEIGHTS[w] for w, c in has.items()), F.lit(0)) + F.least("n", F.lit(6))
    marked = rows.withColumns({"is_header": (n >= 3) & (has["date"] | has["duty"]), "weight": weight})
    best = F.max(F.when(F.col("is_header"), F.struct("weight", (-F.col("yc")).alias("up"), (-F.col("row")).alias("r")))).over(W.partitionBy(key))
    return marked.withColumn("best", F.col("is_header") & (best["r"] == -F.col("row")))


def sections(rows: DataFrame, key: str, date: str) -> DataFrame:
    """header_rows() with ``section``: planned below the planned title, else below the second header, else by date after the day it is published to."""
    whole = W.partitionBy(key)
    title = F.min(F.when(F.col("text").rlike(PLANNED_TITLE), F.col("yc"))).over(whole)
    second = F.get(F.array_sort(F.collect_list(F.when(F.col("is_header"), F.col("yc"))).over(whole)), 1)
    until = F.concat_ws(" ", *[F.regexp_extract("text", PUBLISHED_UNTIL, i) for i in (1, 2, 3)])
    day = day_number(F.regexp_replace(F.regexp_replace(until, r" ([A-Za-z]{3})[A-Za-z]*", " $1"), r" \d\d(\d\d)$", " $1"))
    last = F.min(F.when(F.col("text").rlike(PUBLISHED_UNTIL), day)).over(whole)
    from_y = F.coalesce(title, second)
    planned = F.when(from_y.isNotNull(), F.col("yc") > from_y).when(last.isNotNull(), F.coalesce(day_number(F.col(date)) > last, F.lit(False))).otherwise(False)
    return rows.withColumn("section", F.when(planned, "planned").otherwise("published"))


# ---- neighbours -------------------------------------------------------------------------


def nearest_dates(rows: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """Rows (key, row, yc) with the date line (key, yc, date) that they belong to: the nearest at or above (8 pixels of slack), else the nearest below, within 30."""
    lines = dates.select(key, F.col("yc").alias("__dy"), F.col("date").alias("__date"))
    far = F.abs(F.col("__dy") - F.col("yc"))
    pairs = rows.select(key, "row", "yc").join(lines, key).filter(far < DATE_REACH)
    best = pairs.groupBy(key, "row").agg(F.min(F.struct((F.col("__dy") > F.col("yc") + DATE_SLACK).alias("below"), far.alias("far"), "__dy", F.col("__date").alias("date"))).alias("b"))
    return rows.join(best, [key, "row"], "left").select(*rows.columns, F.col("b.date").alias("date"), F.col("b.below").alias("below"))


def nearest_by(left: DataFrame, right: DataFrame, keys: list[str], distance: Column, name: Column, rank: str) -> DataFrame:
    """left rows (rank tells them apart) with the right row of their keys at least distance; keys are a page or a line, so sides are small."""
    best = left.join(right, keys).groupBy(*keys, rank).agg(F.min(F.struct(distance.alias("d"), name.alias("name"))).alias("b"))
    return left.join(best, [*keys, rank], "left").select(*left.columns, F.col("b.name").alias("nearest"), F.col("b.d").alias("distance"))


def column_of(words: DataFrame, header: DataFrame, keys: list[str], rank: str, left_of: bool = True) -> DataFrame:
    """Words with the header cell (keys, hx, hw, head) that they stand under: the last that begins at or left of them (4 points of slack), else the first;
    of numbers (left_of False) the one whose middle is nearest."""
    if not left_of:
        middle = F.abs(F.col("hx") + F.col("hw") / 2 - F.col("x") - F.col("w") / 2)
        return nearest_by(words, header, keys, middle, F.col("head"), rank)
    apart = F.when(F.col("hx") <= F.col("x") + 4, F.col("x") - F.col("hx")).otherwise(1e9 + F.col("hx"))
    return nearest_by(words, header, keys, apart, F.col("head"), rank)


def header_cells(words: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, head, hx, hw): header words with less than 6 points between them are one cell, named in lower case."""
    w = W.partitionBy(*keys).orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    cell = F.sum(F.coalesce((gap >= 6).cast("int"), F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, 0))
    joined = words.withColumn("__cell", cell).groupBy(*keys, "__cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", F.lower("t").alias("t")))), lambda x: x["t"]), " ").alias("head"), F.min("x").alias("hx"), F.max(F.col("x") + F.col("w")).alias("__end"))
    return joined.select(*keys, "head", "hx", (F.col("__end") - F.col("hx")).alias("hw"))


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How much of the shorter interval two intervals share; 0 where they are apart."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.coalesce(F.try_divide(shared, F.least(a1 - a0, b1 - b0)), F.lit(0.0))


def box_overlaps(a: DataFrame, b: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """(*keys, a, b, share): boxes of two tables on one page that share ``share`` of the smaller's area at least."""
    side = lambda df, s: df.select(*keys, F.col("nth").alias(s), *[F.col(c).alias(f"{s}{c}") for c in ("x0", "x1", "y0", "y1")])
    long = lambda s, d: F.col(f"{s}{d}1") - F.col(f"{s}{d}0")
    common = lambda d: F.greatest(F.lit(0.0), F.least(F.col(f"a{d}1"), F.col(f"b{d}1")) - F.greatest(F.col(f"a{d}0"), F.col(f"b{d}0")))
    part = F.try_divide(common("x") * common("y"), F.least(long("a", "x") * long("a", "y"), long("b", "x") * long("b", "y")))
    return side(a, "a").join(side(b, "b"), keys).withColumn("share", part).filter(F.col("share") >= share).select(*keys, "a", "b", "share")


def line_spans(words: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, span, field, x, text): words of a line with one field in a row, less than 25 points apart; two values of an info field are two spans."""
    w = W.partitionBy(*keys).orderBy("x", "t")
    #: fixed value
    value = r"^(\d{1,3}:\d{2}|\d{1,3}|\d{1,3},\d{1,2})$"
    info = F.col("field").isin("info", "co_info", "ci_info")
    wide = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) >= 25
    cells = info & F.col("t").rlike(value) & F.lag("t").over(w).rlike(value)
    new = F.lag("field").over(w).isNull() | (F.lag("field").over(w) != F.col("field")) | wide | cells
    numbered = words.withColumn("span", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "span", "field").agg(F.min("x").alias("x"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "t"))), lambda p: p["t"]), " ").alias("text"))
    return out.filter("field <> 'O'")


def word_context(words: DataFrame, key: str) -> DataFrame:
    """Numbered words (key, line, nth, t, x, y) with left and right in the line, and up and down: the nearest by x (20 at most) in the line before and after (25 at most)."""
    w = W.partitionBy(key, "line").orderBy("x", "nth")
    own = words.withColumns({"left": F.lag("t").over(w), "right": F.lead("t").over(w)})
    for name, step in (("up", -1), ("down", 1)):
        other = words.select(key, (F.col("line") - step).alias("line"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("t").alias("__t"))
        near = (F.abs(F.col("__x") - F.col("x")) <= 20) & (F.abs(F.col("__y") - F.col("y")) < 25)
        found = words.join(other, [key, "line"]).filter(near).groupBy(key, "nth").agg(F.min(F.struct(F.abs(F.col("__x") - F.col("x")).alias("d"), "__x", "__t")).alias("b"))
        own = own.join(found.select(key, "nth", F.col("b.__t").alias(name)), [key, "nth"], "left")
    return own


def reading_order(words: DataFrame, key: str, page: str, starts: list[float]) -> DataFrame:
    """Words with block and place: page by page, block by block (starts are the blocks' left edges), top down, left to right."""
    block = F.size(F.filter(F.array(*map(F.lit, sorted(starts)[1:] or [float("inf")])), lambda s: F.col("x") >= s))
    return words.withColumn("block", block).withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(page, "block", "y", "x")).cast("long"))


def stacked(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Boxes of several pages as of one tall page: each page's are moved down by the heights of those before it."""
    heights = pages.select(key, page, "height").distinct()
    down = F.coalesce(F.sum("height").over(W.partitionBy(key).orderBy(page).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    moved = pages.join(heights.withColumn("__down", down).select(key, page, "__down"), [key, page])
    return moved.withColumns({c: F.col(c) + F.col("__down") for c in ("y0", "y1")}).drop("__down")


def strips(width: Column, height: Column, ratio: float = 1.3, overlap: float = 40.0) -> Column:
    """array<struct<top, bottom>> that cut a tall page into strips of ratio times its width, overlapping; one strip where it is no taller."""
    tall = F.greatest(width * ratio, F.lit(overlap + 1))
    n = F.greatest(F.lit(1), F.ceil((height - overlap) / (tall - overlap))).cast("int")
    at = lambda i: i * (tall - overlap)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i).cast("double").alias("top"), F.least(at(i) + tall, height).cast("double").alias("bottom")))


def owned_lines(lines: DataFrame, key: str, overlap: float = 40.0) -> DataFrame:
    """Boxes read in strips (strip, top, bottom, y0, y1 within the strip), each kept from the one strip that owns its middle, in the page's own height."""
    middle = F.col("top") + (F.col("y0") + F.col("y1")) / 2
    last = F.max("strip").over(W.partitionBy(key))
    low = F.when(F.col("strip") == 0, F.lit(float("-inf"))).otherwise(F.col("top") + overlap / 2)
    high = F.when(F.col("strip") == last, F.lit(float("inf"))).otherwise(F.col("bottom") - overlap / 2)
    own = lines.withColumns({"__m": middle, "__l": low, "__h": high}).filter("__m >= __l and __m < __h").drop("__m", "__l", "__h")
    return own.withColumns({"y0": F.col("top") + F.col("y0"), "y1": F.col("top") + F.col("y1")})


def trimmed(grid: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Grid rows without the blank cells at their ends and without the blank rows at the end."""
    filled = F.filter(F.transform("cells", lambda c, i: F.when(F.trim(text_of(c)) != "", i + 1)), lambda i: i.isNotNull())
    cut = grid.withColumn("cells", F.slice("cells", 1, F.coalesce(F.array_max(filled), F.lit(0))))
    last = F.max(F.when(F.size("cells") > 0, F.col(line))).over(W.partitionBy(key))
    return cut.withColumn("__last", last).filter(F.col(line) <= F.col("__last")).drop("__last")


def best_cluster(pages: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pages (key, right, duty_left) with the column layout (name, table_right, duty_left) least far from them: the right edge counts whole, the duty's left edge 0.7.

    Layouts are a configuration of a few dozen rows, gathered into one array.
    """
    listed = clusters.groupBy().agg(F.array_sort(F.collect_list(F.struct("name", "table_right", F.col("duty_left").alias("duty")))).alias("__c"))
    far = lambda c: F.abs(c["table_right"] - F.col("right")) + 0.7 * F.abs(c["duty"] - F.col("duty_left"))
    best = F.array_min(F.transform("__c", lambda c: F.struct(far(c).alias("far"), c["name"].alias("name"))))
    return pages.join(F.broadcast(listed)).withColumns({"layout": best["name"], "far": best["far"]}).drop("__c")
