"""Loose text, calendars, layouts and night time on small fixtures."""

import datetime
import hashlib
import json
import random
import zipfile

import numpy as np
from pyspark.sql import functions as F

from skyledger.functions import sun
from skyledger.sources import records, sinks, text, workbooks


def epoch(*t):
    return int(datetime.datetime(*t, tzinfo=datetime.UTC).timestamp())


def one(spark, value, *args):
    return spark.range(1).select(value(*map(F.lit, args)).alias("x")).first().x


def test_bytes_and_kinds(spark):
    kinds = spark.createDataFrame([(b"PK\x03\x04..",), (b"%PDF-1.7",), (b"\x00\x01\x02ab",), (b"date,dep",), (b"",)], "b binary")
    assert [r.k for r in kinds.select(text.content_kind(F.col("b")).alias("k")).collect()] == ["excel", "binary", "binary", "text", "text"]
    raw = spark.createDataFrame([("é".encode(),), ("é".encode("cp1252"),), (b"\xef\xbb\xbfa\x00b",), (None,)], "b binary")
    assert [r.t for r in raw.select(text.decoded(F.col("b")).alias("t")).collect()] == ["é", "é", "ab", None]


def test_grids(spark):
    assert one(spark, text.expand_tabs, "ab\tc\td") == "ab      c       d"
    assert one(spark, text.grid, "a\tb  c\nd\te") == [["a", "b c"], ["d", "e"]]
    assert one(spark, text.grid, "one two   three\n\n  four") == [["one two", "three"], [], ["four"]]
    assert one(spark, text.unwrapped, '"a,""b, c"""\n"d,""e"""') == '"a","b, c"\n"d","e"'
    assert one(spark, text.grid, " ".join(["word"] * 50_000)) == [[" ".join(["word"] * 50_000)]]
    assert one(spark, text.unwrapped, '"a"\nb') == '"a"\nb'


def test_grid_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Datum  Von\n1 Mär   VIE\n".encode("cp1252"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    assert [(r.line, r.cells) for r in text.read_grid(spark, str(tmp_path)).orderBy("line").collect()] == [(0, ["Datum", "Von"]), (1, ["1 Mär", "VIE"])]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "l.json").write_text('{"published": [{"dep": "VIE"}, {"dep": "PRN"}], "planned": []}')
    assert [(r.section, r.row_idx, r.dep) for r in text.read_labels(spark, str(tmp_path / "c")).orderBy("row_idx").collect()] == [("published", 0, "VIE"), ("published", 1, "PRN")]


def test_calendars(spark):
    doc = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART;TZID=Europe/Vienna:20250107T0200\r\nDURATION:PT1H30M\r\nSUMMARY:A\\, b\r\n  c\r\nSUMMARY:second\r\nBEGIN:VALARM\r\nSUMMARY:ring\r\nEND:VALARM\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20250228\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART:soon\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    frame = spark.createDataFrame([(doc,), ("",), (None,)], "t string")
    a, b = text.calendar_events(frame, "t").orderBy("nth").collect()
    moment = datetime.datetime
    assert (a.summary, a.tzid, a.start, a.end, a.all_day) == ("A, b c", "Europe/Vienna", moment(2025, 1, 7, 2), moment(2025, 1, 7, 3, 30), False)
    assert (b.start, b.end, b.all_day) == (moment(2025, 2, 28), moment(2025, 3, 1), True)
    assert [one(spark, text.duration_minutes_iso, d) for d in ("P1DT2H30M", "-PT15M", "P2W", "x")] == [1590, -15, 20160, None]
    rest = "\r\n".join(["BEGIN:VCALENDAR", "X-WR-CALNAME:Mine\\, all", "BEGIN:VEVENT", "DTSTART:20250301T1000Z", r"SUMMARY:C:\\new\, a\nb", "CATEGORIES:One,Two\\, three", "RELATED-TO;RELTYPE=CHILD:x", "END:VEVENT", "BEGIN:VEVENT", "DTSTART:20250302", "RELATED-TO:y", "END:VEVENT", "END:VCALENDAR"])
    c, d = text.calendar_events(spark.createDataFrame([(rest,)], "t string"), "t").orderBy("nth").collect()
    assert (c.summary, c.categories, c.parent, c.utc) == ("C:\\new, a\nb", ["One", "Two", "three"], "", True) and (d.summary, d.parent, d.all_day) == ("(no title)", "y", True)
    assert [r.name for r in text.calendar_names(spark.createDataFrame([(rest,), (doc,)], "t string"), "t").collect()] == ["Mine, all", ""]
    line = "SUMMARY:" + "ü" * 60
    cut = one(spark, sinks.folded, line)
    assert cut.replace("\r\n ", "") == line and all(len(p.encode()) <= 75 for p in cut.split("\r\n"))


def test_night(spark):
    vie, prn = (48.1103, 16.5697), (42.5728, 21.0358)

    def night(a, b, start, stop, **rule):
        at = [F.lit(x) for x in (*a, *b)]
        t = [F.lit(x).cast("long") for x in (start, stop)]
        return spark.range(1).select(sun.night_seconds(sun.night_edges(*at, *t, **rule), *t).alias("s")).first().s

    assert night(vie, prn, epoch(2025, 1, 5, 21, 45), epoch(2025, 1, 5, 23, 20)) == 95 * 60
    assert night(vie, prn, epoch(2025, 6, 21, 11), epoch(2025, 6, 21, 12)) == 0
    dusk = night(vie, prn, epoch(2025, 1, 5, 14), epoch(2025, 1, 5, 17))
    assert 0 < dusk < 3 * 3600
    half = night((0.0, 0.0), (0.0, 1.0), epoch(2025, 1, 5, 17), epoch(2025, 1, 5, 19), rule="fixed")
    assert abs(half - 3600) < 240
    assert [one(spark, sun.unwrapped_longitude, *x) for x in ((-179.0, 179.0), (10.0, 20.0))] == [181.0, 10.0]


def test_route_lists(spark):
    frame = spark.createDataFrame([("Jan|#4a90e2|AUH-GYD*3,gyd-auh,AUH-AUH,bad",), ("none",), (None,)], "t string")
    assert sorted((r["name"], r.dep, r.arr, r.n) for r in text.routes_of(frame, "t").collect()) == [("Jan", "AUH", "GYD", 3), ("Jan", "GYD", "AUH", 1)]


def test_routes_of_many_flights_are_read_back(spark):
    flown = spark.createDataFrame([("Jan", "AUH", "GYD", 9999), ("Jan", "GYD", "AUH", 6000), ("Jan", "GYD", "AUH", 4000), ("Jan", "AUH", "DOH", 3_000_000_000)], "name string, dep string, arr string, n long")
    lists = sinks.route_lists(flown, "name").select(F.concat_ws("|", "name", F.lit("#4a90e2"), "list").alias("t"))
    assert sorted((r.dep, r.arr, r.n) for r in text.routes_of(lists, "t").collect()) == [("AUH", "DOH", 3_000_000_000), ("AUH", "GYD", 9999), ("GYD", "AUH", 10_000)]
    odd = spark.createDataFrame([("Jan||AUH-GYD*,AUH-DOH*x,AUH-DXB*99999999999999999999,DOH-AUH*00012",)], "t string")
    assert [(r.dep, r.arr, r.n) for r in text.routes_of(odd, "t").collect()] == [("DOH", "AUH", 12)]


def test_backslashes_survive_a_calendar(spark):
    texts = ["a\\b", "\\n is no line end", "one\ntwo", "x; y, z\\", "\\\;", ""]
    rows = [(i, f"u{i}", datetime.datetime(2025, 1, 1), datetime.datetime(2025, 1, 2), True, True, "s", "", t, "event", False) for i, t in enumerate(texts)]
    events = spark.createDataFrame(rows, "n int, uid string, start timestamp_ntz, end timestamp_ntz, all_day boolean, utc boolean, summary string, location string, description string, kind string, tentative boolean").withColumn("k", F.lit(1))
    back = text.calendar_events(sinks.calendar_texts(events, "k", "n", name="A, b"), "calendar")
    assert [r.description for r in back.orderBy("nth").collect()] == texts


def test_exports(spark):
    invoices = spark.createDataFrame([("RP-2", "2025-07-02", 'x "y", z'), ("RP-1", "2025-07-01", "plain"), ("RP-0", "2025-06-30", None)], "number string, paidAt string, note string")
    assert "".join(r.line for r in sinks.invoice_file(invoices, ["number", "paidAt", "note"], "2025-07").collect()) == '\ufeffnumber,paidAt,note\r\nRP-1,2025-07-01,plain\r\nRP-2,2025-07-02,"x ""y"", z"\r\n'
    grid = spark.createDataFrame([("s", 0, ["a", "<b>"]), ("s", 1, ["c"])], "k string, line int, cells array<string>")
    assert sinks.html_tables(grid, "k", "line", "cells").first().html == '<table><tr><td class="n">1</td><td>a</td><td>&lt;b&gt;</td></tr><tr><td class="n">2</td><td>c</td><td></td></tr></table>'
    packed = json.loads(sinks.compact_table(spark.createDataFrame([("b", 1.5, None), ("a", None, True)], "id string, lat double, on boolean"), "id", "made").first().json)
    assert packed == {"source": "made", "fields": ["id", "lat", "on"], "rows": [["a", None, True], ["b", 1.5, None]]}
    features = spark.createDataFrame([("b", '{"n":2}'), ("a", '{"n":1}')], "k string, f string")
    assert json.loads(sinks.feature_collection(features, "f", "k").first().geojson) == {"type": "FeatureCollection", "features": [{"n": 1}, {"n": 2}]}


def test_stores(spark, tmp_path):
    store = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "name string, n int")
    left = sinks.moved_to_trash(store, F.col("n") > 2, F.lit("2025-01-01"), str(tmp_path / "trash"))
    assert sorted(r.name for r in left.collect()) == ["a", "b"] and [(r.name, str(r.trashed)) for r in spark.read.parquet(str(tmp_path / "trash")).collect()] == [("c", "2025-01-01")]
    sinks.recorded_runs(spark.createDataFrame([("1", "pdf", False), ("2", "pdf", True), ("3", "image", None)], "id string, kind string, stopped boolean"), str(tmp_path / "runs"))
    assert sorted((r.id, r.kind) for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == [("1", "pdf"), ("3", "image")]
    sinks.text_pairs(spark.createDataFrame([("train", "x.png", "a b")], "split string, image string, truth string"), str(tmp_path / "pairs"))
    assert [r.value for r in spark.read.text(str(tmp_path / "pairs" / "split=train")).collect()] == ["x.png\ta b"]
    (tmp_path / "files").mkdir()
    for name in ("a.PDF", "b.jpg", "c.exe"):
        (tmp_path / "files" / name).write_bytes(name.encode())
    index = records.object_index(spark, str(tmp_path / "files"))
    assert [r.name for r in records.listed(index).collect()] == ["a.PDF", "b.jpg"] and [r.name for r in records.listed(index, "image").collect()] == ["b.jpg"]
    assert {r.name: r.md5 for r in index.collect()}["b.jpg"] == hashlib.md5(b"b.jpg").hexdigest()
    states = records.label_states(index, spark.createDataFrame([("a.PDF", None), ("b.jpg", "open")], "name string, review string"))
    assert {r.name: (r.labelled, r.reviewed) for r in states.collect()} == {"a.PDF": (True, True), "b.jpg": (True, False)}
    saved = records.saved_label(spark.createDataFrame([("f", " VIE ", "x")], "file string, dep string, other string"), ["file"], ["dep", "arr"])
    assert saved.collect() == [("f", "VIE", "")]
    assert [r.code for r in records.known_duties(spark.createDataFrame([(["SBY", "CHECK-IN", "OFF(Z)", "SBY", ""],)], "codes array<string>"), "codes").collect()] == ["OFF(Z)", "SBY"]


def workbook(path, rows):
    """A workbook of one sheet, cells as (type, style, value)."""
    style = '<styleSheet><numFmts><numFmt numFmtId="200" formatCode="d/m/yy\\ h:mm;@"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="20"/><xf numFmtId="200"/></cellXfs></styleSheet>'
    kinds = {"s": '<c t="s"><v>{}</v></c>', "i": '<c t="inlineStr"><is><t>{}</t></is></c>', "b": '<c t="b"><v>{}</v></c>'}
    cell = lambda c: "<c/>" if c is None else kinds[c[0]].format(c[1]) if c[0] in kinds else f'<c s="{c[0]}"><v>{c[1]}</v></c>'
    sheet = "<worksheet><sheetData>" + "".join(f'<row r="{i + 1}">{"".join(map(cell, r))}</row>' for i, r in enumerate(rows)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Date</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/styles.xml", style)
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [[("s", 0), ("s", 1), ("i", " x \n y ")], [("1", 45658), ("2", 0.40277), ("3", 45658.999)], [("0", 7), ("0", 1.5), ("b", 1), None], [None]])
    (tmp_path / "b.xlsx").write_bytes(b"PK\x03\x04 damaged")
    (tmp_path / "c.csv").write_text("a,b")
    rows = workbooks.read_workbooks(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.sheet, r.line, r.cells) for r in rows] == [("One", 0, ["Date", "two runs", "x\ny"]), ("One", 1, ["01/01/2025", "09:40", "01/01/2025 23:59"]), ("One", 2, ["7", "1.5", "TRUE"])]


def test_night_polygons():
    for when in (epoch(2025, 3, 20, 9), epoch(2025, 6, 21, 12), epoch(2025, 12, 21, 3)):
        lat, lon = sun.subsolar_point(np.float64(when), np)
        assert abs(sun.sun_altitude(when, lat, lon, np) - 90) < 0.3
        ring, rng = sun.night_polygon(when, -6.0), random.Random(4)
        for _ in range(300):
            y, x = rng.uniform(-85, 85), rng.uniform(-180, 180)
            altitude = sun.sun_altitude(when, y, x, np)
            assert abs(altitude + 6) < 1.0 or sun.inside_ring(ring, x, y) == (altitude < -6)
    band = sun.fixed_night_band(epoch(2025, 1, 1, 12), 360, 1080)
    assert (min(x for x, _ in band), max(x for x, _ in band)) == (90.0, 270.0) and sun.inside_ring(band, 180.0, 0.0) and not sun.inside_ring(band, 0.0, 0.0)
    there = sun.destination(0.0, 0.0, 90.0, 10.0, np)
    assert abs(there[0]) < 1e-9 and abs(there[1] - 10) < 1e-9
