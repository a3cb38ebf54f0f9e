"""Cells, duties, dates, pages, repairs, message pages and scores on small fixtures, against plain versions where there are some."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from skyledger.functions import cells
from skyledger.operators import accounts, acars, airports, curation, dates, duties, metrics, pages, relational, repairs, scoring, sequence
from skyledger.sources import sinks, text
from skyledger.streaming import usage


def each(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


# ---- cells ------------------------------------------------------------------------------


def test_times_are_spelt_one_way(spark):
    same = {
        "06:05 Z 17:40 Z": ["06:05 Z 17:40 Z", "06:05Z17:40Z", "0605Z1740Z", "06 05 Z 17 40 Z", "0605 Z 17:40 Z", "060521740Z"],
        "10:20 Z PMI": ["1020ZPMI", "10:20ZPMI"], "00:00 Z": ["(0:(() Z", "0(:0() Z", "O0:0O Z"], "21:05 Z": ["Z1:05 Z", "21105Z"], "QX 12 VIE 09:10 Z 11:00 Z X": ["QX 12 VIE 0910Z11:00Z X"],
    }
    for want, spelt in same.items():
        assert each(spark, cells.canonical_times, spelt) == [want] * len(spelt)
    kept = ["SBY0830-Z", "SBY1200Z", "FR 2210", "QX 99 08:15 Z", "3 Mar 21 1910", "8861Z", "25:10 Z", "OFF(Z)", "A/L(T)", "", "no times"]
    assert each(spark, cells.canonical_times, kept) == kept
    assert each(spark, cells.row_text, ["07:10219:20Z", "OFF(2) 0FF", "08:30 2 PMI", "x 2 09:00"]) == ["07:10 Z 19:20 Z", "OFF(Z) OFF", "08:30 Z PMI", "x Z 09:00 Z"]
    assert each(spark, cells.times_in, ["09:10 Z to 25:00, 10:61 11:05", None]) == [["09:10 Z", "11:05 Z"], []]


def test_duties_are_put_right(spark):
    read = ["0FF(Z", "OFFZ)", "A/L Z", "OFF/A", "OFFA", "CI9", "RS72", "Z0OF(Z)", " -OFF(Z), ", "OFF(T)", None]
    assert each(spark, cells.bracketed_duty, read) == ["OFF(Z)", "OFF(Z)", "A/L(Z)", "OFF/A", "OFFA", "C19", "RST2", "Z0OFF(Z)", "OFF(Z)", "OFF(T)", ""]
    junk = ["30 Z0 OFF(Z)", "2OFF(Z)", "14MAY A/L(Z)", "QFF(Z)", "OFFZ)", "CHECK-QUT", "CHECK-TN", "CTQ", "S8Y0900", "STM", "UNALOCATD", "DHFR 331", "RST3OPC", "208272", "F21 7710", "8810", "X Y Z", ""]
    assert each(spark, cells.cleaned_duty, junk) == ["OFF(Z)", "OFF(Z)", "A/L(Z)", "OFF(Z)", "OFF(Z)", "CHECK-OUT", "CHECK-IN", "CTO", "SBY0900", "SIM", "Unallocated", "DH FR331", "RST 3 OPC", "8272", "7710", "8810", "X Y Z", ""]


def test_small_readers(spark):
    assert each(spark, cells.fuzzy_weekday, ["Sat", "WED", "Tuo", "xx", "", None]) == ["SAT", "WED", "TUE", None, None, None]
    assert each(spark, lambda c: cells.date_in_text(c)["date"], ["on Sat, 7 Mar 20 x", "19 Jan 25Sun", "7Mar20OFF", "3 Feb 20th", "12-OCT-2021", "no", None]) == ["7 Mar 20", "19 Jan 25", "7 Mar 20", None, "12 Oct 21", None, None]
    assert each(spark, lambda c: cells.date_in_text(c)["day"], ["Sat, 7 Mar 20", "8 Mar 20"]) == ["SAT", "SUN"]
    assert each(spark, cells.tidy_tags, ["[ A 1 ][B 2](c)"]) == ["[A 1] [B 2] (c)"] and each(spark, cells.unglued, ["07:00Z10:20ZPMI", "19Mar24OFF", "4OFF", "QX39"]) == ["07:00Z 10:20Z PMI", "19 Mar 24 OFF", "4 OFF", "QX39"]
    assert each(spark, cells.folded_text, ["Zürich ÅLESUND", "São Tomé", None]) == ["zurich alesund", "sao tome", ""]
    assert each(spark, cells.email_of, [" a@b.co ", "", None, "a b@c.de", "x@y"]) == ["a@b.co", "", "", None, None]
    assert each(spark, cells.file_kind, ["a.JPG", "b.xlsx", "c", "d.exe"]) == ["image", "pdf", None, None] and each(spark, cells.is_data_name, ["x/a.pdf", "a.pdf", ".pdf/.."]) == [False, True, False]
    assert each(spark, lambda c: cells.error_kind("dep", c, F.lit("VIE")), ["VIE", "", "VI", "VIX"]) == [None, "missing_extracted", "format_mismatch", "value_mismatch"]
    assert each(spark, lambda c: cells.error_kind("begin", c, F.lit("09:00 Z")), ["9:00", "09:01 Z"]) == ["format_mismatch", "value_mismatch"]
    assert each(spark, lambda c: cells.error_kind("duty", c, F.lit("OFF(Z)")), ["XX", "OFF(A)"]) == ["pattern_mismatch", "value_mismatch"]
    assert each(spark, repairs.crew_parts, ["AnnLo(77-FO)", "Jo - CA", "One"]) == [["AnnLo", "77", "FO"], ["Jo", "CA"], ["One"]]
    assert each(spark, repairs.crew_tags, ["LO ANN - CA,ROE BO - FA", "Zoe - ZM only", None]) == ["[CA - LO ANN][FA - ROE BO]", "Zoe - ZM only", ""]


# ---- duties -----------------------------------------------------------------------------

ROW = "k int, section string, n int, date string, duty string, dep string, arr string, begin string, end string, info string"
ROSTER = [
    ("1 Apr 25", "ZQ 1", "GRZ", "VIE", "05:00 Z", "05:40 Z", ""), ("2 Apr 25", "C/I", "VIE", "", "20:30 Z", "", ""), ("2 Apr 25", "ZQ 7", "VIE", "SKP", "21:30 Z", "23:05 Z", ""), ("2 Apr 25", "EXT", "", "", "", "", ""),
    ("2 Apr 25", "H9", "SKP", "", "", "", "Inn"), ("3 Apr 25", "SIM", "SKP", "", "02:00 Z", "03:00 Z", ""), ("3 Apr 25", "ZQ 8", "SKP", "VIE", "04:00 Z", "05:30 Z", ""), ("3 Apr 25", "C/O", "", "VIE", "", "06:00 Z", ""),
    ("3 Apr 25", "HT", "VIE", "", "", "", ""), ("4 Apr 25", "HT", "VIE", "", "", "", ""), ("5 Apr 25", "CHXCK-IN", "", "", "08:00 Z", "", ""), ("5 Apr 25", "ZQ 3", "VIE", "OTP", "09:00 Z", "11:00 Z", ""), ("6 Apr 25", "OFF", "", "", "", "", ""),
    ("bad", "X", "", "", "", "", ""), ("9 Apr 25", "C/I", "", "", "06:00 Z", "", ""), ("9 Apr 25", "ZQ 5", "A", "B", "07:00 L", "08:00 L", ""),
]


def test_duties_hotels_and_what_lies_between(spark):
    rows = [(1, "published", i, *r) for i, r in enumerate(ROSTER)] + [(1, "planned", 0, "20 Apr 25", "SBY", "", "", "04:00 Z", "12:00 Z +1", "")]
    events = duties.roster_events(spark.createDataFrame(rows, ROW).repartition(3), "k", "n")
    found = events.orderBy("nth").collect()
    at = lambda t: t and f"{t:%d %H:%M}"
    uids = {r.uid: r.summary for r in found}
    assert [(r.kind, at(r.start), at(r.end), r.summary, uids.get(r.parent)) for r in found] == [
        ("flight", "01 05:00", "01 05:40", "ZQ 1 GRZ → VIE", None), ("duty", "02 20:30", "03 06:00", "Duty VIE → SKP → VIE", None), ("flight", "02 21:30", "02 23:05", "ZQ 7 VIE → SKP", "Duty VIE → SKP → VIE"),
        ("hotel", "02 23:05", "03 02:00", "H9 SKP", "Duty VIE → SKP → VIE"), ("sim", "03 02:00", "03 03:00", "SIM SKP", "Duty VIE → SKP → VIE"), ("flight", "03 04:00", "03 05:30", "ZQ 8 SKP → VIE", "Duty VIE → SKP → VIE"),
        ("hotel", "03 06:00", "05 08:00", "HT VIE", None), ("duty", "05 08:00", "05 11:00", "Duty VIE → OTP", None), ("flight", "05 09:00", "05 11:00", "ZQ 3 VIE → OTP", "Duty VIE → OTP"), ("event", "06 00:00", "07 00:00", "OFF", None),
        ("event", "09 06:00", None, "C/I", None), ("flight", "09 07:00", "09 08:00", "ZQ 5 A → B", None), ("event", "20 04:00", "21 12:00", "SBY", None),
    ]
    duty, hotel = found[1], found[6]
    assert "Also: EXT" in duty.description and "Events:\n  21:30 Z → 23:05 Z  ZQ 7 VIE → SKP" in duty.description and "9h30" in duty.description and hotel.nights == 2 and "Nights: 2" in hotel.description
    assert found[-1].tentative and not found[0].tentative and len(uids) == len(found)
    back = text.calendar_events(sinks.calendar_texts(events, "k", "nth", name="R"), "calendar").orderBy("nth").collect()
    assert [(r.uid, r.kind, r.summary, r.parent or None) for r in back] == [(r.uid, r.kind, r.summary, r.parent) for r in found] and back[1].start == duty.start


def test_a_duty_ends_after_36_hours(spark):
    rows = [(1, "published", i, d, duty, "A", "B", b, "", "") for i, (d, duty, b) in enumerate([("1 Jan 25", "C/I", "06:00 Z"), ("1 Jan 25", "Q1", "07:00 Z"), ("2 Jan 25", "Q2", "18:00 Z"), ("2 Jan 25", "Q3", "18:01 Z"), ("3 Jan 25", "C/O", "09:00 Z")])]
    roles = {r.duty + str(r.ord.row): r.role for r in duties.placed_rows(spark.createDataFrame(rows, ROW), "k", "n").collect()}
    assert roles == {"C/I0": "in", "Q11": "inside", "Q22": "inside", "Q33": "alone", "C/O4": "alone"}


# ---- dates ------------------------------------------------------------------------------


def test_printed_dates_in_parts(spark):
    texts = ["2024-05-21T18:00Z", "20SAT", "14 Feb 20", "Mon10 Feb 20", "25JAN2024", "Jun 21 2024", "22/02/24", "2024 8 14.08.", "04/01", "Thu14", "Wed Feb 20", "7", "Lunes 01/07/2024", "Th11", "F6b 3", "", "nothing", None]
    want = [(21, 5, 24, None), (20, None, None, 6), (14, 2, 20, None), (10, 2, 20, 1), (25, 1, 24, None), (21, 6, 24, None), (22, 2, 24, None), (14, 8, 24, None), (4, 1, None, None), (14, None, None, 4), (None, None, None, 3), (7, None, None, None), (1, 7, 24, 1), (11, None, None, 4)]
    found = each(spark, dates.date_parts, texts)
    assert [(p.day, p.month, p.year, p.weekday) if p.day else (None, None, None, p.weekday) for p in found[:14]] == want and found[-3:] == [None] * 3


def part(day=None, month=None, year=None, weekday=None, numeric=False):
    return {"day": day, "month": month, "year": year, "weekday": weekday, "numeric": numeric}


def test_whole_dates_follow_each_other():
    shown = lambda parts, *period: [None if n is None else f"{datetime.date(1970, 1, 1) + datetime.timedelta(days=n):%d.%m.%y}" for n in dates.whole_dates(parts, *period)]
    assert shown([part(30, 9, 24), part(1), part(2), part(3)]) == ["30.09.24", "01.10.24", "02.10.24", "03.10.24"]
    # a day alone that jumps ahead stays on the day before
    assert shown([part(30, 9, 24), part(1), part(31), part(1)]) == ["30.09.24", "01.10.24", "01.10.24", "01.10.24"]
    # months first, where only that can be or the weekdays say so
    assert shown([part(5, 13, 24, None, True), part(6, 2, 24, None, True)]) == ["13.05.24", "02.06.24"] and shown([part(1, 6, 24, None, True), part(2, 6, 24, None, True)]) == ["01.06.24", "02.06.24"]
    assert shown([part(1, 5, 24, 5, True), part(2, 5, 24, 1, True)]) == ["05.01.24", "05.02.24"] and shown([part(1, 5, 24, 6, True), part(1, 6, 24, 0, True)]) == ["01.05.24", "05.05.24"]
    assert shown([part(3, weekday=3), part(4)], (24, 1), (24, 12)) == ["03.01.24", "04.01.24"] and shown([part(3, weekday=1)], (24, 1), (24, 12)) == ["03.06.24"]
    assert shown([part(10, 3, 24), part(20, weekday=1), part(12)]) == ["10.03.24", "11.03.24", "12.03.24"]
    assert shown([part(10, 3, 24), part(weekday=2), None, part(13)]) == ["10.03.24", "12.03.24", None, "13.03.24"]
    assert shown([part(30, 12), part(2, 1)], (24, 12)) == ["30.12.24", "02.01.25"]


def test_days_are_repaired(spark):
    row = lambda date, read, weekday="", has=None, begin="", duty="X": (1, date, "", begin, "", duty, read, weekday, has)
    made = [row("24 Jun 20", True, "FRI"), row("25 Jan 20", True, "SAT"), row("25 Jan 20", False, "", False, "22:00 Z", "CHECK-OUT"), row("25 Jan 20", False, "", False, "15:00 Z", "Q1"), row("27 Jan 70", True, "MON"), row("9 Aug 20", True, "TUE"), row("28 Jan 20", False, "", True), row("28 Jan 20", False, "", True), row("31 Jan 20", True)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "n int, f int, date string, day string, begin string, end string, duty string, read boolean, weekday string, has_date boolean")
    found = [(r.date, r.day) for r in dates.repaired(rows, ["f"], "n").orderBy("n").collect()]
    assert [d for d, _ in found] == ["24 Jan 20", "25 Jan 20", "25 Jan 20", "26 Jan 20", "27 Jan 20", "28 Jan 20", "29 Jan 20", "30 Jan 20", "31 Jan 20"] and [w for _, w in found][:2] == ["FRI", "SAT"]
    assert dates.repaired_days([], None) == [] and dates.repaired_days([{"key": None, "read": False, "weekday": None, "has_date": None, "minute": None, "duty": ""}] * 2) == [None, None]


def test_periods(spark):
    assert each(spark, dates.printed_period, ["01/02/2024 - 05/08/2024", "(01JAN24 - 06AUG24)", "x", None]) == ["01Feb24 - 05Aug24", "01Jan24 - 06Aug24", None, None]
    rows = spark.createDataFrame([(1, "7 Jul 24"), (1, "3 Aug 24"), (2, "bad")], "f int, date string")
    assert [(r.f, r.period) for r in dates.rows_period(rows, ["f"], "date").collect()] == [(1, "01Jul24 - 31Aug24")]


# ---- pages ------------------------------------------------------------------------------


def box(text_, x, y, w=40.0, h=10.0, confidence=0.9):
    return (1, text_, confidence, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]])


def page_of(spark, lines):
    made = spark.createDataFrame(lines, "k int, text string, confidence double, box array<array<double>>")
    return pages.boxes(made, "k")


def test_rows_of_a_page(spark):
    lines = [box("a", 0.0, 0.0), box("b", 60.0, 4.0), box("c", 0.0, 12.0), box("weak", 0.0, 30.0, confidence=0.2), box(" ", 0.0, 40.0), (1, "no box", 0.9, []), box("d", 0.0, 50.0, confidence=None)]
    rows = {r.text: r.row for r in pages.row_numbers(page_of(spark, lines), "k").collect()}
    assert rows == {"a": 0, "b": 0, "c": 1, "d": 2}
    rng = random.Random(2)
    many = [box(f"t{i}", float(rng.randint(0, 300)), rng.random() * 200, h=rng.choice([6.0, 10.0, 18.0])) for i in range(60)]
    plain, extent = [], None
    for t, top, bottom in sorted(((m[1], m[3][0][1], m[3][2][1]) for m in many), key=lambda b: (b[1] + b[2]) / 2):
        if extent and min(extent[1], bottom) - max(extent[0], top) >= 0.5 * min(extent[1] - extent[0], bottom - top):
            extent = (min(extent[0], top), max(extent[1], bottom))
        else:
            plain.append(set())
            extent = (top, bottom)
        plain[-1].add(t)
    got = {}
    for r in pages.row_numbers(page_of(spark, many), "k").collect():
        got.setdefault(r.row, set()).add(r.text)
    assert [got[i] for i in range(len(got))] == plain


def test_headers_sections_and_fused_rows(spark):
    lines = [box("Date", 0.0, 0.0), box("Duty", 50.0, 0.0), box("Dep", 100.0, 0.0), box("Arr", 150.0, 0.0, 20.0), box("side", 400.0, 0.0), box("1 Jan 25", 0.0, 20.0), box("2 Jan 25", 0.0, 32.0), box("x", 50.0, 19.0, h=22.0), box("The rest of this roster is planned", 0.0, 60.0), box("3 Jan 25", 0.0, 80.0)]
    page = pages.row_numbers(pages.without_sidebar(page_of(spark, lines), ["k"]), "k")
    split = pages.split_fused(page, "k")
    rows = pages.sections(pages.header_rows(pages.rows_of(split, "k"), "k").withColumn("date", F.col("text")), "k", "date").orderBy("row").collect()
    assert [(r.text, r.is_header, r.best, r.section) for r in rows] == [
        ("Date Duty Dep Arr", True, True, "published"), ("1 Jan 25 x", False, False, "published"), ("2 Jan 25", False, False, "published"), ("The rest of this roster is planned", False, False, "published"), ("3 Jan 25", False, False, "planned")
    ]
    until = [(1, 0, "This roster is published until 16 Feb 2020", 1, 0.0, 10.0, 5.0, 10.0, "x"), (1, 1, "a", 1, 20.0, 30.0, 25.0, 10.0, "16 Feb 20"), (1, 2, "b", 1, 40.0, 50.0, 45.0, 10.0, "17 Feb 20")]
    told = pages.sections(pages.header_rows(spark.createDataFrame(until, "k int, row int, text string, n int, y0 double, y1 double, yc double, h double, date string"), "k"), "k", "date")
    assert [r.section for r in told.orderBy("row").collect()] == ["published", "published", "planned"]


def test_words_lines_and_neighbours(spark):
    words = pages.words_of(page_of(spark, [box("07:00Z10:20ZPMI", 0.0, 0.0, 150.0, 16.0), box("x", 200.0, 2.0, 10.0, 16.0), box("y z", 0.0, 40.0, 30.0, 16.0)]), "k")
    assert sorted((r.y, r.x, r.t, r.w, r.h) for r in words.collect()) == [(0.0, 0.0, "07:00Z", 26.5, 8.0), (0.0, 30.9, "10:20Z", 26.5, 8.0), (0.0, 61.8, "PMI", 13.2, 8.0), (0.0, 100.0, "x", 5.0, 8.0), (20.0, 0.0, "y", 5.0, 8.0), (20.0, 10.0, "z", 5.0, 8.0)]
    placed = spark.createDataFrame([(1, i, t, x, y, 10.0) for i, (t, x, y) in enumerate([("a", 0.0, 0.0), ("b", 30.0, 1.4), ("c", 0.0, 1.6), ("d", 32.0, 3.0), ("e", 5.0, 20.0)])], "k int, nth int, t string, x double, y double, w double")
    lined = pages.text_lines(placed, "k")
    assert {r.t: r.line for r in lined.collect()} == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}
    near = {r.t: (r.left, r.right, r.up, r.down) for r in pages.word_context(lined, "k").collect()}
    assert near["c"] == (None, "d", "a", "e") and near["b"] == ("a", None, None, "d")
    heads = spark.createDataFrame([(1, "Blk", 0.0, 12.0), (1, "Hrs", 16.0, 12.0), (1, "Night", 60.0, 20.0)], "k int, t string, x double, w double")
    cells_ = pages.header_cells(heads, ["k"])
    assert sorted((r.head, r.hx, r.hw) for r in cells_.collect()) == [("blk hrs", 0.0, 28.0), ("night", 60.0, 20.0)]
    values = spark.createDataFrame([(1, 1, 45.0, 10.0), (1, 2, 62.0, 10.0)], "k int, nth int, x double, w double")
    assert [{r.nth: r.nearest for r in pages.column_of(values, cells_, ["k"], "nth", left).collect()} for left in (True, False)] == [{1: "blk hrs", 2: "night"}, {1: "night", 2: "night"}]
    order = pages.reading_order(spark.createDataFrame([(1, 0, "a", 0.0, 5.0), (1, 0, "b", 200.0, 0.0), (1, 0, "c", 0.0, 9.0), (1, 1, "d", 0.0, 0.0)], "k int, page int, t string, x double, y double"), "k", "page", [float("-inf"), 150.0])
    assert [r.t for r in order.orderBy("place").collect()] == ["a", "c", "b", "d"]


def test_strips_stacks_grids_and_clusters(spark):
    cut = spark.range(1).select(pages.strips(F.lit(100.0), F.lit(300.0)).alias("s")).first().s
    assert [(round(x.top), round(x.bottom)) for x in cut] == [(0, 130), (90, 220), (180, 300)]
    lines = spark.createDataFrame([(1, 0, 0.0, 130.0, 100.0, 108.0, "a"), (1, 1, 90.0, 220.0, 10.0, 18.0, "a again"), (1, 1, 90.0, 220.0, 30.0, 38.0, "b")], "k int, strip int, top double, bottom double, y0 double, y1 double, t string")
    assert sorted((r.t, r.y0) for r in pages.owned_lines(lines, "k").collect()) == [("a", 100.0), ("b", 120.0)]
    stacked = pages.stacked(spark.createDataFrame([(1, 1, 50.0, 1.0, 2.0), (1, 2, 70.0, 1.0, 2.0), (1, 3, 10.0, 1.0, 2.0)], "k int, page int, height double, y0 double, y1 double"), "k", "page")
    assert sorted((r.page, r.y0) for r in stacked.collect()) == [(1, 1.0), (2, 51.0), (3, 121.0)]
    grid = spark.createDataFrame([(1, 0, ["a", "", " "]), (1, 1, [""]), (1, 2, ["b"]), (1, 3, ["", ""])], "k int, line int, cells array<string>")
    assert [(r.line, r.cells) for r in pages.trimmed(grid, "k").orderBy("line").collect()] == [(0, ["a"]), (1, []), (2, ["b"])]
    best = pages.best_cluster(spark.createDataFrame([(1, 500.0, 120.0)], "k int, right double, duty_left double"), spark.createDataFrame([("wide", 510.0, 100.0), ("narrow", 480.0, 120.0)], "name string, table_right double, duty_left double"))
    assert (best.first().layout, best.first().far) == ("narrow", 20.0)


def test_dates_next_to_rows_and_pairs_by_anchors(spark):
    rows = spark.createDataFrame([(1, i, y) for i, y in enumerate([100.0, 112.0, 200.0, 140.0])], "k int, row int, yc double")
    lines = spark.createDataFrame([(1, 95.0, "1 Jan"), (1, 118.0, "2 Jan"), (1, 160.0, "3 Jan")], "k int, yc double, date string")
    assert {r.row: (r.date, r.below) for r in pages.nearest_dates(rows, lines, "k").collect()} == {0: ("1 Jan", False), 1: ("2 Jan", False), 2: (None, None), 3: ("2 Jan", False)}
    left = spark.createDataFrame([(1, i, a) for i, a in enumerate(["x", None, None, "y", None, "z", "w"])], "k int, n int, a string")
    right = spark.createDataFrame([(1, i, a) for i, a in enumerate(["x", None, "q", "y", None, None, "w", "z"])], "k int, n int, a string")
    assert sorted((r.left, r.right) for r in relational.anchored_pairs(left, right, ["k"], "n", "a").collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (5, 7)]
    extras = spark.createDataFrame([("1 Jan", "Q1", "crew one"), ("1 Jan", "", "of the day")], "date string, flight string, crew string")
    joined = relational.joined_by_flight(spark.createDataFrame([("1 Jan", "Q1"), ("1 Jan", "Q2"), ("2 Jan", "Q1")], "date string, duty string"), extras, "crew")
    assert {(r.date, r.duty): r.crew for r in joined.collect()} == {("1 Jan", "Q1"): "crew one", ("1 Jan", "Q2"): "of the day", ("2 Jan", "Q1"): None}
    words = lambda s: spark.createDataFrame([(1, w) for w in s.split()], "k int, w string")
    assert [r.common for r in relational.words_in_common(words("a a b c"), words("a b b a a"), ["k"], "w").collect()] == [3]


# ---- repairs ----------------------------------------------------------------------------

FLIGHTS = "f int, section string, n int, date string, duty string, dep string, arr string, begin string, end string, crew string"


def test_rows_are_repaired_by_neighbours(spark):
    made = [
        ("1 Jan", "OFFZ)", "GRZ", "", "", ""), ("2 Jan", "FR 100", "GRZ", "", "06:00 Z", ""), ("2 Jan", "FR101", "SKP", "", "08:00 Z", ""), ("3 Jan", "SBY", "GRZ", "", "", ""), ("4 Jan", "SBY", "GR2"[:2] + "S", "", "", ""),
        ("5 Jan", "FR 7", "GRZ", "OTP", "", ""), ("5 Jan", "FR 8", "OTB", "GRZ", "", ""), ("6 Jan", "FR 9", "GRZ", "OTP", "", ""), ("7 Jan", "C19", "GRZ", "", "", ""),
    ]
    rows = spark.createDataFrame([(1, "published", i, *r, "") for i, r in enumerate(made)], FLIGHTS)
    found = repairs.repaired_rows(rows, "f", "section", "n").orderBy("n").collect()
    assert [(r.duty, r.dep, r.arr) for r in found] == [("OFF(Z)", "GRZ", ""), ("FR 100", "GRZ", "SKP"), ("FR101", "SKP", "GRZ"), ("SBY", "GRZ", ""), ("SBY", "GRZ", ""), ("FR 7", "GRZ", "OTP"), ("FR 8", "OTP", "GRZ"), ("FR 9", "GRZ", "OTP"), ("C19", "GRZ", "")]
    assert (found[0].begin, found[0].end, found[8].end) == ("00:00 Z", "21:00 Z", "23:59 Z")
    one = repairs.one_flight_style(spark.createDataFrame([(1, "FR 11"), (1, "FR12"), (1, "FR 13"), (2, "FR14"), (2, "FR 15")], "f int, duty string"), "f").collect()
    assert sorted((r.f, r.duty) for r in one) == [(1, "FR 11"), (1, "FR 12"), (1, "FR 13"), (2, "FR 15"), (2, "FR14")]


def test_within_duties(spark):
    made = [("C/I", "", "", ""), ("Q1", "A", "B", "[CP]"), ("Q2", "B", "C", ""), ("C/O", "", "", ""), ("C/O", "", "", ""), ("C/I", "", "", ""), ("Q3", "C", "D", "")]
    rows = spark.createDataFrame([(1, i, *r) for i, r in enumerate(made)], "f int, n int, duty string, dep string, arr string, crew string")
    found = repairs.within_duties(rows, ["f"], "n").orderBy("n").collect()
    assert [(r.n, r.dep, r.arr, r.crew) for r in found] == [(0, "A", "", ""), (1, "A", "B", "[CP]"), (2, "B", "C", "[CP]"), (4, "", "C", ""), (5, "C", "", ""), (6, "C", "D", "")]


# ---- message pages ----------------------------------------------------------------------


def message(spark, lines):
    """Boxes (text, x, y) of 20 high, 10 a character."""
    made = [(1, t, 0.9, [[x, y], [x + 10.0 * len(t), y], [x + 10.0 * len(t), y + 20.0], [x, y + 20.0]]) for t, x, y in lines]
    page = page_of(spark, made).withColumn("text", acars.fixed_text(F.col("text")))
    return pages.words_of(page, "k", split=False)


OVER = [("FLIGHT NO", 0.0, 0.0), ("DATE", 250.0, 0.0), ("ORIG/DEST", 400.0, 0.0), ("ZQ310", 0.0, 40.0), ("04FEB24", 240.0, 40.0), ("LOWG/LWSK", 400.0, 40.0), ("OUT", 0.0, 90.0), ("OFF", 470.0, 90.0), ("0611Z", 0.0, 130.0), ("0622Z", 450.0, 130.0), ("IN", 0.0, 180.0), ("ON", 480.0, 180.0), ("0745Z", 0.0, 220.0), ("0738Z", 450.0, 220.0), ("BLOCK", 0.0, 270.0), ("FLIGHT", 440.0, 270.0), ("0134", 0.0, 310.0), ("0116", 460.0, 310.0)]
LABEL = {"flt": "ZQ310", "date": "4 Feb 24", "dept": "LOWG", "dest": "LWSK", "out": "06:11", "off": "06:22", "on": "07:38", "in": "07:45", "info": "[Flight: 01:16] [Block: 01:34]"}


def test_message_pages(spark):
    words = message(spark, OVER)
    (r,) = acars.records(words, "k").collect()
    assert {f: r[f] for f in acars.FIELDS} == LABEL
    beside = [("FLT NO", 0.0, 0.0), ("DEPT/DEST", 300.0, 0.0), ("ZQ31/04", 0.0, 40.0), ("LJLJ/LDZA", 300.0, 40.0)] + [(t, x, 80.0 + 40 * i) for i, (a, b) in enumerate([("OUT", "0Z:05"), ("OFF", "02:1S"), ("ON", "02:51"), ("IN", "0256Z")]) for t, x in ((a, 0.0), ("-", 100.0), (b, 150.0))]
    (r,) = acars.records(message(spark, beside), "k").collect()
    assert (r.flt, r.date, r.dept, r.dest, r.out, r.off, r.on, r["in"]) == ("ZQ31", "4", "LJLJ", "LDZA", "02:05", "02:15", "02:51", "02:56")
    label = spark.createDataFrame([(1, *[LABEL[f] for f in acars.FIELDS])], "k int, " + ", ".join(f"`{f}` string" for f in acars.FIELDS))
    tags = acars.tagged(words, label, "k")
    assert {r.t: r.field for r in tags.collect() if r.field != "O"} == {"ZQ310": "flt", "04FEB24": "adate", "LOWG": "dept", "LWSK": "dest", "0611Z": "out", "0622Z": "off", "0738Z": "on", "0745Z": "in", "0134": "block", "0116": "flight"}
    (back,) = acars.assembled(tags, "k").collect()
    assert {f: back[f] for f in acars.FIELDS} == LABEL
    wrong = message(spark, [("738Z7", x, y) if t == "0738Z" else (t, x, y) for t, x, y in OVER])
    assert {r.t: r.field for r in acars.tagged(wrong, label, "k").collect()}["738Z7"] == "?"
    scored = scoring.record_scores(acars.records(wrong, "k"), label, "k", acars.FIELDS, acars.normal_field).first()
    assert not scored.all_right and scored.right_out and scored.right_info


def test_message_cells(spark):
    assert each(spark, acars.clock, ["0611Z", "06:11", "1Z31", "16:20:59", "162059", "01+16", "LOWG", "ZQ310", "1290", "", None]) == ["06:11", "06:11", "12:31", "16:20", "16:20", "01:16", "", "", "", "", ""]
    assert each(spark, acars.printed_date, ["04FEB24", "O4FEB24", "28/11/23", "9/MAY", "19NOV", "17", "/08", "1201", "ZQ48"]) == ["4 Feb 24", "4 Feb 24", "28 Nov 23", "9 May", "19 Nov", "17", "8", "", ""]
    assert each(spark, acars.fixed_text, ["4 Feb 24", "0FF12:10", "LOWG/LWSK", "1 2 0 5", "ZQ8N040CT", "LOWGLWSK", "ZQ31-05"]) == ["4FEB24", "0FF 12:10", "LOWG / LWSK", "1205", "ZQ8N 040CT", "LOWG LWSK", "ZQ31 - 05"]
    letters = lambda c: acars.label_key(acars.label_letters(c))
    assert each(spark, letters, ["FLIGHTNO", "0UT", "ORIGDEST", "BLK", "AIRBORNE", "UTC", "OUTOFF", "hello"]) == ["flt", "out", "route", "block", "off", "other", "outoff", None]


# ---- scores -----------------------------------------------------------------------------


def test_sections_are_compared(spark):
    label = [("1 Jan 25", "OFF", "", ""), ("2 Jan 25", "Q1", "VIE", "PRN"), ("3 Jan 25", "Q2", "PRN", "VIE"), ("4 Jan 25", "Q3", "VIE", "GRZ")]
    read = [("1 jan 25", "0FF", "", ""), ("3 Jan 25", "Q2", "PR", "VIE"), ("4 Jan 25", "Q3", "vie", "GRZ"), ("9 Jan 25", "X", "", "")]
    table = lambda rows: spark.createDataFrame([("f", "published", i, *r) for i, r in enumerate(rows)], "file string, section string, n int, date string, duty string, dep string, arr string")
    fields, keys = ["date", "duty", "dep", "arr"], ["file", "section"]
    pairs = scoring.compared(table(read), table(label), keys, "n", fields)
    assert [(r.in_read, r.in_label) for r in pairs.orderBy("idx").collect()] == [(True, True), (False, True), (True, True), (True, True), (True, False)]
    (score,) = scoring.row_scores(pairs, keys, fields, fields).collect()
    assert (score.row_matches, score.row_total, score["read"], score.labelled) == (2, 5, 4, 4)
    # a missing or extra row differs in all of its cells that are filled
    assert {r.field: (r.matches, r.total, r.distance) for r in scoring.field_scores(pairs, keys, fields).collect()} == {"date": (3, 5, 16), "duty": (3, 5, 3), "dep": (3, 5, 4), "arr": (4, 5, 3)}
    assert {r.field: (r.matches, r.total) for r in scoring.field_scores(pairs, keys, fields, with_extra=False).collect()} == {"date": (3, 4), "duty": (3, 4), "dep": (2, 4), "arr": (3, 4)}
    found = scoring.differences(pairs, "file", fields).orderBy("nth").collect()
    assert [(r.kind, r.field, r["read"], r.label) for r in found] == [("missing", None, None, None), ("field", "dep", "PR", "PRN"), ("extra", None, None, None)]
    ranking = scoring.error_ranking(pairs, fields)
    assert [(r.field, r.kind, r.n, r.share) for r in ranking.collect()] == [("dep", "format_mismatch", 1, 100)] and [r.insight for r in scoring.error_insights(ranking).collect()] == ["dep: format_mismatch: 1 (100%)"]
    only = scoring.compared(table(read).filter("n < 0"), table(label), keys, "n", fields, scoring.plain_cell)
    assert scoring.row_scores(only, keys, fields, fields).first().row_matches == 0


def test_reading_quality_adds_in_order(spark):
    many = [(u, n, (None, 0.1, 0.2, 0.3, 0.7)[(n * 7 + u) % 5], n % 9 == 0) for u in range(20) for n in range(101)]
    want = {}
    for u, _, c, _ in many:
        want[u] = want.get(u, 0.0) + (0.5 if c is None else c)
    for seed in range(3):
        random.Random(seed).shuffle(many)
        rows = spark.createDataFrame(many, "u int, at int, confidence double, critical boolean").repartition(seed + 2)
        found = scoring.reading_quality(rows, ["u"], "at").collect()
        assert {r.u: (r.n, r.confidence) for r in found} == {u: (101, total / 101) for u, total in want.items()}


def test_long_alignments_are_least_cost_too():
    rng = random.Random(9)
    a = [(rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 3)) for _ in range(120)]
    b = [r for r in a if rng.random() < 0.9]
    for i in rng.sample(range(len(b)), 20):
        b[i] = (9, *b[i][1:])
    pairs = sequence.align(a, b, 3)
    cost = sum(3 if i is None or j is None else sum(x != y for x, y in zip(a[i], b[j])) for i, j in pairs)
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        ways = [table[i - 1][j] + 3] * (i > 0) + [table[i][j - 1] + 3] * (j > 0) + ([table[i - 1][j - 1] + sum(x != y for x, y in zip(a[i - 1], b[j - 1]))] if i and j else [])
        table[i][j] = min(ways, default=0)
    assert cost == table[-1][-1] and [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_read_text_against_labels(spark):
    rng = random.Random(5)
    for _ in range(60):
        pattern, line = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (5, 12))
        distance, start, end = scoring.closest_stretch(pattern, line)
        every = [(edits(pattern, line[i:j]), j) for i in range(len(line) + 1) for j in range(i, len(line) + 1)]
        assert (distance, end) == min(every) and edits(pattern, line[start:end]) == distance
    label = spark.createDataFrame([("f", "published", 0, "1 Jan", "20", "20:55 Z"), ("f", "published", 1, "1 Jan", "Q7", "")], "k string, section string, n int, date string, duty string, begin string")
    cells_ = scoring.ocr_cells(label, ["k"], "section", "n", ["date", "duty", "begin"])
    assert cells_.count() == 4  # the day's second date is not printed
    lines = spark.createDataFrame([("f", 0, "1 Jan 20:55Z"), ("f", 1, "Q1")], "k string, nth int, text string")
    found = {r.field: (r.cells, r.exact, r.chars, r.errors) for r in scoring.ocr_scores(lines, cells_, "k").collect()}
    assert found == {"date": (1, 1, 4, 0), "duty": (2, 0, 4, 3), "begin": (1, 1, 6, 0)}
    assert scoring.ocr_accuracy(scoring.ocr_scores(lines, cells_, "k"), ["k"]).first().words == 50.0


# ---- the rest ---------------------------------------------------------------------------


def test_quotas_with_reads_are_those_of_a_scan(spark):
    rng = random.Random(7)
    calls = [(u, n, rng.random() < 0.4) for u in range(6) for n in range(30)]
    got = {(r.u, r.n): r.admitted for r in accounts.spent(spark.createDataFrame(calls, "u int, n int, is_read boolean"), ["u"], ["n"], F.lit(12), F.lit(5)).collect()}
    for u in range(6):
        requests = reads = 0
        for _, n, read in (c for c in calls if c[0] == u):
            ok = requests < 12 and not (read and reads >= 5)
            requests, reads = requests + ok, reads + (ok and read)
            assert got[u, n] == ok


def test_offers_and_rankings(spark):
    plans = spark.createDataFrame([("pro", "Pro", (9.0, 90.0, None), 100, 10), ("free", "Free", None, 5, 1), ("gone", "G", (0.0, None, "EUR"), 1, 1)], "plan string, label string, prices struct<month:double,year:double,currency:string>, requests int, reads int")
    assert sorted((r.key, float(r.price), r.currency) for r in accounts.offers(plans).collect()) == [("pro-month", 9.0, "USD"), ("pro-year", 90.0, "USD")]
    assert [r.n for r in accounts.newest_first(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, t string"), "t", "n", 2).collect()] == [2, 1]
    stale = scoring.stale_labels(spark.createDataFrame([("a", 10, 10, 0), ("b", 5, 10, 8), ("c", 0, 0, 2)], "file string, row_matches int, row_total int, field_errors int"))
    assert [r.file for r in scoring.most_suspicious(stale).collect()] == ["c", "b"]


def test_medians_and_quantiles_of_repeated_values(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.choice([1, 2, 2, 3, 50]) if k else rng.random())) for k in (0, 1) for _ in range(301)] + [(2, 5.0), (3, None)]
    table = spark.createDataFrame(rows, "k int, v double")
    of = lambda k: sorted(v for q, v in rows if q == k and v is not None)
    assert {r.k: r.median for r in metrics.upper_median(table, ["k"], "v").collect()} == {k: of(k)[len(of(k)) // 2] for k in (0, 1, 2)}
    for r in metrics.quantiles(table, ["k"], "v", {"q": 0.95}).collect():
        v, rank = of(r.k), 0.95 * (len(of(r.k)) - 1)
        assert r.q == pytest.approx(v[int(rank)] + (v[min(int(rank) + 1, len(v) - 1)] - v[int(rank)]) * (rank % 1)) and r.n == len(v)


def test_folds_are_those_of_a_greedy_scan(spark):
    rng = random.Random(6)
    sizes = [(f"c{i}", rng.choice([1, 1, 1, 2, 3, 7])) for i in range(80)]
    found = curation.folds(spark.createDataFrame(sizes, "k string, n long"), "k", "n", 4).collect()
    loads, taken = [0] * 4, {}
    for _, n in sorted(sizes, key=lambda s: -s[1]):
        f = loads.index(min(loads))
        loads[f] += n
        taken[f, n] = taken.get((f, n), 0) + 1
    got = {}
    for r in found:
        got[r.fold, r.size] = got.get((r.fold, r.size), 0) + 1
    assert got == taken and len(found) == 80


def test_jobs_and_counters(spark):
    at = lambda m: datetime.datetime(2025, 1, 1, 10, m)
    log = spark.createDataFrame([("a", 1, 0, at(0), "start"), ("a", 1, 1, at(1), "done"), ("a", 2, 0, at(5), "start"), ("a", 2, 1, at(6), "file"), ("b", 1, 0, at(1), "start"), ("b", 1, 1, at(2), "end")], "job string, run int, nth int, time timestamp, type string")
    now = lambda m: F.lit(at(m)).cast("timestamp")
    assert [(r.job, r.run, r.nth) for r in usage.job_events(log, "job", "time", now(10)).collect()] == [("a", 2, 0), ("a", 2, 1), ("b", 1, 0), ("b", 1, 1)]
    assert {r.job for r in usage.job_events(log, "job", "time", now(40)).collect()} == {"a"}


def test_airports_from_their_tables(spark):
    raw = spark.createDataFrame(
        [("1", "KQQQ", "large_airport", "Big", "US", "US-X", "KQQQ", "KQQQ", "QQQ", "QQ1", "1.123456", "2", "100", "yes", "Town"), ("2", "X-1", "small_airport", "Strip", "CA", "CA-Y", "", "", "", "", "", "", "", "no", ""), ("3", "CY1", "small_airport", "Field", "CA", "CA-Y", "", "CYZZ", "", "ZZ1", "5", "6", "", "no", None), ("4", "H", "heliport", "H", "US", "US-X", "HHHH", "", "", "", "", "", "", "no", "")],
        "n string, ident string, type string, name string, iso_country string, iso_region string, icao_code string, gps_code string, iata_code string, local_code string, latitude_deg string, longitude_deg string, elevation_ft string, scheduled_service string, municipality string",
    ).withColumns({"home_link": F.lit(None).cast("string"), "wikipedia_link": F.lit("")})
    regions = spark.createDataFrame([("US-X", "Xland")], "code string, name string")
    stations = spark.createDataFrame([("KQQQ", "123450", "20200101"), ("KQQQ", "543210", "20240101"), ("KQQQ", "999990", "20250101"), ("bad", "111110", "1")], "ICAO string, USAF string, END string")
    found = {r.id: r for r in airports.airport_dimension(raw, regions, stations).collect()}
    assert set(found) == {"KQQQ", "CY1"} and (found["KQQQ"].wmo, found["KQQQ"].faa, found["KQQQ"].local, found["KQQQ"].lat, found["KQQQ"].region, found["KQQQ"].scheduled) == ("54321", "QQ1", "", 1.12346, "Xland", True)
    assert (found["CY1"].icao, found["CY1"].local, found["CY1"].faa, found["CY1"].elev) == ("CYZZ", "ZZ1", "", None)
    dimension = airports.airport_dimension(raw, regions, stations)
    asked = airports.looked_up(spark.createDataFrame([("qqq",), ("zz1",), ("none",)], "c string"), "c", dimension)
    assert {r.c: (r.matched_by, r.airport and r.airport.id) for r in asked.collect()} == {"qqq": ("iata", "KQQQ"), "zz1": ("local", "CY1"), "none": (None, None)}
    assert [r["name"] for r in airports.searched(dimension, "xland big").collect()] == ["Big"] and airports.searched(dimension, " ").count() == 0
    flights = spark.createDataFrame([("r", "AAA", "BBB", "2025-01", False, 2), ("r", "BBB", "AAA", "2025-01", True, 1), ("s", "AAA", "BBB", "2025-02", False, 1), ("r", "AAA", "AAA", "", False, 1), ("r", "AAA", "ZZZ", "", False, 1)], "roster string, dep string, arr string, month string, planned boolean, count long")
    places = spark.createDataFrame([("AAA", 0.0, 0.0), ("BBB", 0.0, 1.0)], "code string, lat double, lon double")
    legs = airports.routes(flights, places)
    (total,) = airports.pair_totals(legs).collect()
    assert (total.n, total.directions, [(x["name"], x.flights) for x in total.rosters]) == (4, ["AAA-BBB", "BBB-AAA"], [("r", 3), ("s", 1)]) and abs(total.km - 111.2) < 0.1
    assert [r.code for r in airports.unknown_codes(flights, places).collect()] == ["ZZZ"] and airports.route_stats(legs).first().flights == 4 and airports.routes(flights, places, "2025-01", False).first().n == 2
