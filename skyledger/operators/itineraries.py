"""Table layouts whose lines give several rows, or depend on the lines around them.

A spec says which headers a layout has, what it works out of a line (``line``), which lines count (``keep``), what it
takes from neighbouring lines by windows over the file (``around``) and which rows a line gives (``rows``): check-in, leg,
check-out and so on, each with the condition under which it is there.

Cells are asked for by header: ``City`` is the first such column, ``City#2`` the second, ``Time>Airport#2`` the first
Time behind the second Airport, ``SALIDA+1`` the column right of SALIDA. A column that a file lacks is empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import let
from .dates import printed_period
from .layouts import FIELDS, Cell, _clock, _count, _minutes_clock, crew, iso_date, named_date, numeric_date, tags, zoned

Rows = list[tuple[Column, dict[str, Column]] | Column]
_AIRPORT, _CODE = r"^\*?[A-Z]{3}$", "^[A-Z]{3,4}$"


@dataclass(frozen=True)
class Itinerary:
    """headers: alternatives, each a tuple of headers that must all be there; read by ``tidy``."""

    name: str
    headers: tuple[tuple[str, ...], ...]
    date: Callable[[Cell], Column]
    rows: Callable[[Cell], Rows]
    line: Callable[[Cell], dict[str, Column]] = field(default=lambda c: {})
    keep: Callable[[Cell], Column] = field(default=lambda c: F.col("d").isNotNull())
    around: Callable[[Cell, W, W], list[dict[str, Column]]] = field(default=lambda c, lines, upto: [])
    numeric: str | None = None
    tidy: Callable[[Column], Column] = field(default=lambda h: h)
    carried: bool = False


def row(**cells: Column | str) -> dict[str, Column]:
    return {k.rstrip("_"): F.lit(v) if isinstance(v, str) else v for k, v in cells.items()}


def _struct(cells: dict[str, Column], date: str = "d") -> Column:
    day = cells.get("on", F.col(date))
    return F.struct(day.alias("on"), *[F.coalesce(cells.get(f, F.lit("")), F.lit("")).alias(f) for f in FIELDS[2:]])


def _on_line(name: str, header: Column) -> Column:
    """The place, from 1, of a column asked for; null where there is none."""
    behind, plus = re.match(r"([^>]*)>(.*)$", name), re.match(r"(.*)\+(\d+)$", name)
    if behind:
        after = _on_line(behind[2], header)
        return let(after, lambda a: F.array_min(F.filter(_places(behind[1], header), lambda p: p > a)))
    if plus:
        return _on_line(plus[1], header) + int(plus[2])
    nth = re.match(r"(.*)#(\d+)$", name)
    return F.get(_places(nth[1], header), int(nth[2]) - 1) if nth else F.array_min(_places(name, header))


def _places(name: str, header: Column) -> Column:
    return F.filter(F.transform(header, lambda h, i: F.when(h == name, i + 1)), lambda p: p.isNotNull())


class _Asked:
    """Cells by the names above, each looked up once a line."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}

    def __call__(self, name: str) -> Column:
        return F.get(F.col("__cells"), self.names.setdefault(name, len(self.names)))


# ---- small parts ------------------------------------------------------------------------


def _signed(days: Column) -> Column:
    return F.when(days > 0, F.concat(F.lit(" +"), days.cast("string"))).when(days < 0, F.concat(F.lit(" "), days.cast("string"))).otherwise("")


def _later(day: Column, than: Column) -> Column:
    return F.when(day > than, " +1").otherwise("")


def _has(*cells: Column) -> Column:
    out = cells[0] != ""
    for c in cells[1:]:
        out = out & (c != "")
    return out


def month_first_date(text: Column) -> Column:
    """``Jun 21 2024``."""
    pattern = r"^([A-Za-z]{3}) (\d{1,2}),? (\d{4})$"
    parts = F.concat_ws(" ", F.regexp_extract(text, pattern, 2), F.initcap(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 3))
    return F.when(text.rlike(pattern), F.try_to_date(parts, "d MMM yyyy"))


def _stamped(text: Column) -> Column:
    """struct<day, time> of ``2026-07-16 09:00:00`` or with slashes; null if it is none."""
    pattern = r"^(\d{4})[-/](\d{2})[-/](\d{2})[ T](\d{2}):(\d{2})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd").alias("day"), F.concat(part(4), F.lit(":"), part(5)).alias("time")))


def _at(stamp: Column, zone: str, since: Column, prefix: Column | str = "") -> Column:
    front = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.when(stamp.isNull(), "").otherwise(F.concat(front, stamp["time"], F.lit(f" {zone}"), _later(stamp["day"], since)))


def _numeric(text: Column) -> Column:
    return numeric_date(text, F.col("__month_first"))


def _whole_minutes(text: Column) -> Column:
    """``01:24`` of ``84``; empty of nothing or 0."""
    n = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    return F.when(n > 0, _minutes_clock(n)).otherwise("")


def _counted(*pairs: tuple[str, Column]) -> Column:
    return tags(*[(k, _count(v)) for k, v in pairs])


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def _month_day(day: Column, lines: W, upto: W) -> list[dict[str, Column]]:
    """``d`` of days of the month: in the printed period's first month, the next one each time that the number goes back."""
    before = F.last("__number", ignorenulls=True).over(lines.rowsBetween(W.unboundedPreceding, -1))
    return [
        {"__number": day},
        {"__back": F.coalesce((F.col("__number") < before).cast("int"), F.lit(0))},
        {"d": F.coalesce(F.col("d"), F.when(F.col("__number").isNotNull() & F.col("__period").isNotNull(), F.date_add(F.add_months(F.trunc("__period", "month"), F.sum("__back").over(upto).cast("int")), F.col("__number") - 1)))},
    ]


def _carried(lines: W, upto: W, ends: Column) -> list[dict[str, Column]]:
    """``d`` of the last dated line; a line that ends the days (a footer, a blank one) takes it away."""
    told = F.when(F.col("d").isNotNull() | ends, F.struct("d"))
    return [{"__told": told}, {"dated": F.col("d").isNotNull(), "d": F.last("__told", ignorenulls=True).over(upto)["d"]}]


# ---- the layouts ------------------------------------------------------------------------


def _pilot_log(names: dict[str, str]) -> Callable[[Cell], Rows]:
    def rows(c: Cell) -> Rows:
        n = lambda k: c(names[k])
        time = lambda t: F.when(F.col("__local"), zoned(t, "L")).otherwise(zoned(t))
        sim = _has(n("simTime")) & (n("registration") == "")
        info = _joined(
            F.when(sim, "").otherwise(tags(("Flight", n("flt")))), _counted(("Takeoff Day", n("tkDay")), ("Takeoff Night", n("tkNight")), ("Landing Day", n("ldDay")), ("Landing Night", n("ldNight"))),
            tags(("PIC", n("pic")), ("CoPilot", n("coPilot")), ("Instructor", n("instructor")), ("Sim", n("simTime"))),
        )
        cells = row(duty=F.when(sim, n("simType")).otherwise(""), dep=n("dep"), begin=time(n("begin")), arr=n("arr"), end=time(n("end")), ac=n("ac"), registration=n("registration"), crew=crew(("PIC", n("picName"))), info=info)
        return [(n("dep").rlike(_AIRPORT), cells)]

    return rows


#: Columns of the pilot's log in its two forms.
_PRINTED_LOG = {
    "dep": "Airport", "arr": "Airport#2", "begin": "Time>Airport", "end": "Time>Airport#2", "ac": "Type", "registration": "Reg.", "flt": "Flt time", "picName": "Name PIC", "tkDay": "Day>Flt time", "tkNight": "Night>Flt time",
    "ldDay": "Day>Day>Flt time", "ldNight": "Night>Night>Flt time", "pic": "PIC>Flt time", "coPilot": "Co-Plt", "instructor": "Instr", "simTime": "Time>Flt time", "simType": "Type>Flt time",
}
_FLAT_LOG = {
    "dep": "DepPlace", "arr": "ArrPlace", "begin": "DepTime", "end": "ArrTime", "ac": "ACType", "registration": "Reg", "flt": "FltTime", "picName": "PicName", "tkDay": "TKoffsDay", "tkNight": "TKoffsNight", "ldDay": "LandsDay",
    "ldNight": "LandsNight", "pic": "PIC", "coPilot": "CoPlt", "instructor": "Instr", "simTime": "SimTime", "simType": "SimType",
}


def _ac_logbook(c: Cell) -> Rows:
    number = r"^[A-Z0-9]{2}\d{1,4}[A-Z]?$"
    flight = F.when(c("Flt#").rlike(number), c("Flt#")).when(c("FIN").rlike(number), c("FIN")).otherwise(c("Flt#"))
    return [(F.lit(True), row(duty=flight, dep=c("Station"), begin=zoned(c("Time(L)>Station"), "L"), arr=c("Station#2"), end=zoned(c("Time(L)>Station#2"), "L"), ac=c("Type"), registration=c("Reg")))]


def _crew_legs_line(c: Cell) -> dict[str, Column]:
    times = {k: _stamped(c(n)) for k, n in (("std", "schld_dprt_lcl_dttm"), ("sta", "schld_arr_lcl_dttm"), ("atd", "actl_dprt_lcl_dttm"), ("ata", "actl_arr_lcl_dttm"), ("report", "actl_duty_rpt_lcl_dttm"), ("release", "actl_duty_rls_lcl_dttm"))}
    return times | {"period": F.concat_ws("|", c("rotn_beg_dt"), c("rotn_prng_nbr"), c("duty_perd_id")), "pairing": c("rotn_prng_nbr"), "layover": _whole_minutes(c("duty_layovr_tm_mnt_cnt"))}


def _crew_legs_around(c: Cell, lines: W, upto: W) -> list[dict[str, Column]]:
    own = W.partitionBy("file", "__duty").orderBy("line")
    first = lambda n: F.first(n).over(own)
    return [
        {"opens": F.coalesce(F.lag("period").over(lines) != F.col("period"), F.lit(True)), "closes": F.coalesce(F.lead("period").over(lines) != F.col("period"), F.lit(True))},
        {"__duty": F.sum(F.col("opens").cast("int")).over(upto)},
        {"out": first("release"), "began": F.coalesce(first("report")["day"], first("d")), "trip": first("pairing"), "rest": first("layover")},
    ]


def _crew_legs(c: Cell) -> Rows:
    d, report, began = F.col("d"), F.col("report"), F.col("began")
    begin, end = (F.when(F.col(a).isNotNull(), _at(F.col(a), "L", d, "A")).otherwise(_at(F.col(s), "L", d, "E")) for a, s in (("atd", "std"), ("ata", "sta")))
    block = F.when(_whole_minutes(c("actl_leg_blk_tm_mnt_cnt")) != "", _whole_minutes(c("actl_leg_blk_tm_mnt_cnt"))).otherwise(_whole_minutes(c("schld_leg_blk_tm_mnt_cnt")))
    leg = row(duty=c("flt_nbr"), dep=c("dprt_arpt_cd"), arr=c("arr_arpt_cd"), begin=begin, end=end, ac=c("actl_crew_schlg_ac_typ_cd"), info=tags(("Pairing", c("rotn_prng_nbr")), ("Block", block)))
    return [
        (F.col("opens") & report.isNotNull(), row(on=report["day"], duty="C/I", begin=_at(report, "L", report["day"]))), (F.lit(True), leg),
        (F.col("closes") & F.col("out").isNotNull(), row(on=began, duty="C/O", end=_at(F.col("out"), "L", began), info=tags(("Pairing", F.col("trip")), ("Layover", F.col("rest"))))),
    ]


#: Columns of one report under its printed headers and under its field names.
_REPORT = {"date": "Date", "des": "Des.", "code": "Code", "ac": "Type", "registration": "Registration", "dep": "Dep", "arr": "Arr", "ci": "CI", "std": "STD", "atd": "ATD", "sta": "STA", "ata": "ATA", "co": "CO", "block": "-"}
_REPORT_FIELDS = {
    "date": "RaidoLab_Name", "des": "Text4", "code": "Text2", "ac": "Text8", "registration": "Text10", "dep": "Text11", "arr": "Text12", "ci": "TimeText_CI", "std": "TimeText_ValidFrom", "atd": "TimeText_ActualValidFrom",
    "sta": "TimeText_ValidToString", "ata": "TimeText_ActualValidToString", "co": "TimeText_CO_String", "block": "MimerValue1",
}


def _report(name: str, headers: tuple[str, ...], n: dict[str, str], exact: bool) -> Itinerary:
    crew_of = lambda: F.get(F.filter(F.col("cells"), lambda x: x.rlike("^Crew:")), 0)
    form = r"([A-Z]{2,4}(?:\([^)]*\))?):\s*(.*?)(?=,\s*[A-Z]{2,4}(?:\([^)]*\))?:|$)"

    def line(c: Cell) -> dict[str, Column]:
        beside = F.when(c(n["ci"]) != "", c(n["ci"])).otherwise(F.lit("") if exact else c(f"{n['ci']}-1"))
        flies = crew_of().isNull() & _has(c(n["code"])) & c(n["dep"]).rlike(_AIRPORT) & c(n["arr"]).rlike(_AIRPORT)
        return {"crew_line": crew_of(), "ci": beside, "flies": flies}

    def around(c: Cell, lines: W, upto: W) -> list[dict[str, Column]]:
        number = F.regexp_extract(c(n["date"]), r"^(\d{1,2})\s+[A-Za-z]{2,3}$", 1).try_cast("int")
        following = W.partitionBy("file", "__flight").orderBy("line").rowsBetween(0, W.unboundedFollowing)
        return [
            *_month_day(F.when(F.col("crew_line").isNull(), number), lines, upto),
            {"d": F.last("d", ignorenulls=True).over(upto)},
            {"flies": F.col("flies") & F.col("d").isNotNull()},
            {"__flight": F.sum(F.col("flies").cast("int")).over(upto)},
            {"crew_line": F.last("crew_line", ignorenulls=True).over(following)},
        ]

    def rows(c: Cell) -> Rows:
        time = lambda t: F.when(F.col("__local"), zoned(t, "L")).otherwise(zoned(t))
        listed = F.regexp_replace(F.coalesce("crew_line", F.lit("")), r"^Crew:\s*", "")
        roles, people = (F.regexp_extract_all(listed, F.lit(form), F.lit(i)) for i in (1, 2))
        staff = F.array_join(F.zip_with(roles, people, lambda r, p: F.concat(F.lit("["), r, F.lit(" - "), F.trim(p), F.lit("]"))), "")
        said = lambda k, t: F.when(c(n[t]) != "", F.concat(F.lit(f"[{k} "), time(c(n[t])) if k != "Des." else c(n[t]), F.lit("]")))
        info = F.concat_ws(" ", said("Des.", "des"), said("ATD", "atd"), said("ATA", "ata"), F.when(c(n["block"]).rlike(r"^\d+:\d{2}$"), F.concat(F.lit("[Block: "), c(n["block"]), F.lit("]"))))
        leg = row(duty=c(n["code"]), dep=c(n["dep"]), arr=c(n["arr"]), begin=time(c(n["std"])), end=time(c(n["sta"])), ac=c(n["ac"]), registration=c(n["registration"]), crew=staff, info=info)
        return [(_has(F.col("ci")) & ~F.col("ci").rlike("^0+$"), row(duty="C/I", begin=time(F.col("ci")))), (F.lit(True), leg), (_has(c(n["co"])), row(duty="C/O", end=time(c(n["co"]))))]

    return Itinerary(name, (headers,), lambda c: F.when(crew_of().isNull(), named_date(c(n["date"]))), rows, line, lambda c: F.col("flies"), around, carried=True)


def _roster_report(zone: str) -> Itinerary:
    at = lambda n, z: f"{n}({z})"
    stamp = r"^(\d{2})(\d{2})([+-]\d)?$"

    def one(t: Column, z: str) -> Column:
        shift = F.regexp_extract(t, stamp, 3)
        return F.when(t.rlike(stamp), F.concat(F.regexp_extract(t, stamp, 1), F.lit(":"), F.regexp_extract(t, stamp, 2), F.lit(f" {z}"), F.when(shift != "", F.concat(F.lit(" "), shift)).otherwise("")))

    def both(c: Cell, n: str) -> Column:
        return F.concat_ws(" / ", one(c(at(n, "Z")), "Z"), *([one(c(at(n, zone)), zone)] if zone != "Z" else []))

    def rows(c: Cell) -> Rows:
        took = lambda *pairs: tags(*[(k, F.when(c(n).rlike(r"^\d+:\d{2}$"), c(n)).otherwise("")) for k, n in pairs])
        activity = row(
            dc=c("DC"), duty=c("Activity"), dep=c("From"), arr=c("To"), begin=both(c, "Start"), end=both(c, "Finish"), registration=c("A/C Reg"), ac=c("AC Type"), info=_joined(took(("Turn", "Turn"), ("Block", "BH")), c("Hotel"))
        )
        return [
            (both(c, "C/I") != "", row(duty="C/I", dep=c("From"), begin=both(c, "C/I"))), (F.lit(True), activity),
            (both(c, "C/O") != "", row(duty="C/O", arr=c("To"), end=both(c, "C/O"), info=took(("Duty", "DHrs"), ("FDP", "FDP"), ("Max FDP", "Max FDP")))),
        ]

    need = ("Date", "Activity", "From", "To", at("Start", zone), at("Finish", zone))
    return Itinerary(
        "roster-report", (need,), lambda c: named_date(c("Date")), rows, keep=lambda c: F.col("d").isNotNull() & _has(c("Activity")), around=lambda c, lines, upto: _carried(lines, upto, c("Date") != ""),
        tidy=lambda h: F.transform(h, lambda x: F.regexp_replace(x, r"\$$", "")), carried=True,
    )


def _crew_flights(c: Cell) -> Rows:
    person = r"(\d{3,})\s+(.+?)(?=\s+\d{3,}\s|$)"
    people = lambda role, n: F.array_join(F.zip_with(F.regexp_extract_all(c(n), F.lit(person), F.lit(1)), F.regexp_extract_all(c(n), F.lit(person), F.lit(2)), lambda a, b: F.concat(F.lit(f"[{role} - "), a, F.lit(" - "), b, F.lit("]"))), "")
    minutes = lambda n: F.floor(c(n).try_cast("double") * 60 + 0.5).cast("int")
    hours = lambda n: F.when(c(n).rlike(r"^\d+:\d{2}$"), c(n)).when(c(n).rlike(r"^\d+\.\d+$"), _minutes_clock(minutes(n))).otherwise("")
    staff = F.concat(people("CP", "Captain"), people("FO", "First Officer"), people("FA", "Flight Attendant"))
    cells = row(duty=c("Flight"), dep=c("Origin"), begin=zoned(c("Depart"), "L"), arr=c("Dest"), end=zoned(c("Arrive"), "L"), ac=c("A/C Type"), registration=c("Tail"), crew=staff, info=tags(("Block", hours("Block")), ("Credit", hours("Credit"))))
    return [(c("Origin").rlike(_AIRPORT), cells)]


def _route_log(c: Cell) -> Rows:
    route = r"^([A-Z]{3})-([A-Z]{3})$"
    person = lambda n: F.when(c(n) != "Y", c(n)).otherwise("")
    took = lambda n: F.when(c(n).rlike(r"^\d+:\d{2}$"), c(n)).otherwise("")
    one = lambda k, n: F.when(c(n).rlike("(?i)^(DAY|NIGHT)$"), F.concat(F.lit(f"[{k} "), F.initcap(c(n)), F.lit(": 1]"))).otherwise("")
    minutes = F.when(c("Instrument Minutes").rlike(r"^[1-9]\d*$"), c("Instrument Minutes")).otherwise("")
    info = _joined(tags(("Day", took("Day Hours")), ("Night", took("Night Hours"))), one("Takeoff", "Takeoff"), one("Landing", "Landing"), tags(("Approach", c("Approach")), ("Instrument", minutes)))
    leg = row(dep=F.regexp_extract(c("Route"), route, 1), arr=F.regexp_extract(c("Route"), route, 2), ac=c("Fleet"), registration=c("Rego"), crew=crew(("PIC", person("PIC")), ("FO", person("FO"))), info=info)
    return [(_has(c("Code")), row(duty=c("Code"))), (c("Route").rlike(route), leg)]


def _calendar_line(c: Cell) -> dict[str, Column]:
    lines = F.filter(F.transform(F.split(c("description"), r"\\n|\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2})"
    at = F.regexp_extract(c("dtstart"), start, 2).try_cast("int") * 60 + F.regexp_extract(c("dtstart"), start, 3).try_cast("int")
    return {"told": lines, "at": F.when(c("dtstart").rlike(start), at), "line": F.when(c("dtstart").rlike(start), F.unix_date(iso_date(c("dtstart"))) * 1440 + at).cast("int")}


def _calendar(c: Cell) -> Rows:
    def said(name: str) -> Column:
        found = F.get(F.filter("told", lambda x: x.startswith(f"{name} ") | x.startswith(f"{name}:")), 0)
        return F.coalesce(F.trim(F.regexp_replace(F.substr(found, F.lit(len(name) + 1)), "^:", "")), F.lit(""))

    head = r"^(\S+)(?:\s+\((.*)\))?\s+([A-Z]{3})(?:\s+-\s+([A-Z]{3}))?$"
    part = lambda i: F.regexp_extract(F.get("told", 0), head, i)
    both = r"^(\d{2})(\d{2})Z\s*/\s*(\d{2})(\d{2})L$"
    flight = said("STD") != ""
    printed = F.array(said("CI"), F.when(flight, said("STD")).otherwise(said("Start")), F.when(flight, said("STA")).otherwise(said("End")), said("CO"))

    def step(acc: Column, t: Column) -> Column:
        """UTC minutes since the date's midnight never fall behind those before (a first time may by six hours); the local clock follows by its offset."""
        n = lambda i: F.regexp_extract(t, both, i).try_cast("int")
        utc, local = n(1) * 60 + n(2), n(3) * 60 + n(4)
        today = F.floor(acc["last"] / 1440) * 1440 + utc
        moved = F.when(today < acc["last"] - F.when(acc["first"], 360).otherwise(0), today + 1440).otherwise(today).cast("long")
        away = F.pmod(local - utc + 720, F.lit(1440)) - 720
        day = lambda m: _signed(F.floor(m / 1440).cast("int"))
        text = F.concat(F.regexp_extract(t, both, 1), F.lit(":"), F.regexp_extract(t, both, 2), F.lit(" Z"), day(moved), F.lit(" / "), F.regexp_extract(t, both, 3), F.lit(":"), F.regexp_extract(t, both, 4), F.lit(" L"), day(moved + away))
        got = t.rlike(both)
        return F.struct(F.when(got, moved).otherwise(acc["last"]).alias("last"), (acc["first"] & ~got).alias("first"), F.concat(acc["out"], F.array(F.when(got, text).otherwise(""))).alias("out"))

    start = F.struct(F.col("at").cast("long").alias("last"), F.lit(True).alias("first"), F.expr("cast(array() as array<string>)").alias("out"))
    times = F.aggregate(printed, start, step, lambda acc: acc["out"])
    code, dep, arr = part(1), part(3), F.when(part(4) != "", part(4)).otherwise(part(3))
    craft = F.filter(F.split(said("Aircraft"), r"\s+-\s+"), lambda x: F.trim(x) != "")
    duration, block = F.regexp_extract(said("Duration"), r"^(\d+:\d{2})", 1), F.regexp_extract(said("Duration"), r"BLH:\s*(\d+:\d{2})", 1)
    name, hotel = F.when(part(2) != "", F.concat(F.lit("["), part(2), F.lit("]"))).otherwise(""), F.when(said("Hotel") == "-", "").otherwise(said("Hotel"))
    info = _joined(name, tags(("Block", block), ("Duration", duration), ("RD", said("RD")), ("STC", said("STC")), ("Hotel", hotel)))
    sure = F.get("told", 0).rlike(head)
    registration = F.when(flight & (F.size(craft) > 1), F.trim(F.element_at(craft, -1))).otherwise("")
    event = row(duty=code, dep=dep, arr=arr, begin=F.get(times, 1), end=F.get(times, 2), ac=F.when(flight, F.coalesce(F.trim(F.get(craft, 0)), F.lit(""))).otherwise(""), registration=registration, info=info)
    return [(sure & (F.get(times, 0) != ""), row(duty="C/I", dep=dep, begin=F.get(times, 0))), (sure, event), (sure & (F.get(times, 3) != ""), row(duty="C/O", arr=arr, end=F.get(times, 3)))]


#: Columns of special duty codes, by their titles.
_SPECIAL = (("Act SDC", "act_assign_sdc"), ("Trip assign SDC", "trip_assign_sdc"), ("Trip SDC", "trip_sdc"), ("Item SDC", "item_sdc"))


def _day_time(text: Column) -> Column:
    pattern = r"^(\S+)\s+(\d{1,2}:\d{2})$"
    day = _numeric(F.regexp_extract(text, pattern, 1))
    return F.when(text.rlike(pattern) & day.isNotNull(), F.struct(day.alias("day"), F.lpad(F.regexp_extract(text, pattern, 2), 5, "0").alias("time")))


def _z(stamp: Column, since: Column) -> Column:
    return F.when(stamp.isNull(), "").otherwise(F.concat(stamp["time"], F.lit(" Z"), _signed(F.date_diff(stamp["day"], since))))


def _crew_duties_line(c: Cell) -> dict[str, Column]:
    start, end, off, on = (_day_time(c(n)) for n in ("duty_start", "duty_en", "leg_start", "leg_end"))
    flies = _has(c("flight"))
    special = [tags((k, c(n))) for k, n in _SPECIAL]
    block = F.when(c("flh").rlike(r"^\d+$"), F.concat(F.lit("[Block: "), _minutes_clock(c("flh").try_cast("int")), F.lit("]"))).otherwise("")
    other = F.when((c("FOB") != "") & (c("FOB") != c("rank_cd")), F.concat(F.lit("[FOB: "), c("FOB"), F.lit("]"))).otherwise("")
    parts = F.filter(F.concat(F.when(flies, F.array(block, other)).otherwise(F.array(F.lit(""))), F.array(*special)), lambda x: x != "")
    at, until = F.when(flies, off).otherwise(start), F.when(flies, on).otherwise(end)
    sure = start.isNotNull() & F.when(flies, off.isNotNull()).otherwise(_has(c("act")))
    return {
        "flies": flies, "sure": start.isNotNull(), "whole": sure, "key": c("duty_start"), "start": start, "stop": end, "at": at, "until": until, "parts": parts, "mins": c("duty_mins"),
        "what": F.struct(at["day"].alias("day"), F.when(flies, c("flight")).otherwise(c("act")).alias("duty"), _z(at, at["day"]).alias("begin"), _z(until, at["day"]).alias("end"), F.when(flies, c("dep_stat")).otherwise("").alias("dep"), F.when(flies, c("arr_stat")).otherwise("").alias("arr")),
    }


def _crew_duties_around(c: Cell, lines: W, upto: W) -> list[dict[str, Column]]:
    own, island = W.partitionBy("file", "__duty"), W.partitionBy("file", "__island")
    ordered = lambda w: w.orderBy("line").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    leg = F.col("flies") & F.col("whole")
    return [
        {"__new": F.coalesce(~F.lag("flies").over(lines) | ~F.col("flies") | (F.lag("key").over(lines) != F.col("key")), F.lit(True))},
        {"__duty": F.sum(F.col("__new").cast("int")).over(upto)},
        {"__fresh": F.coalesce(F.col("__new") & F.col("flies") | (F.lag("what").over(lines) != F.col("what")) | (F.lag("flies").over(lines) != F.col("flies")) | ~F.lag("whole").over(lines), F.lit(True))},
        {"__island": F.sum(F.col("__fresh").cast("int")).over(upto)},
        {"parts": F.array_distinct(F.flatten(F.collect_list("parts").over(ordered(island)))), "first_dep": F.first(F.when(leg, F.col("what.dep")), ignorenulls=True).over(ordered(own)), "last_arr": F.last(F.when(leg, F.col("what.arr")), ignorenulls=True).over(ordered(own)),
         "closes": F.row_number().over(own.orderBy(F.desc("line"))) == 1, "begun": F.first("start").over(ordered(own)), "ended": F.first("stop").over(ordered(own)), "worked": F.first("mins").over(ordered(own))},
    ]


def _crew_duties(c: Cell) -> Rows:
    flies, begun, ended, what = F.col("flies"), F.col("begun"), F.col("ended"), F.col("what")
    duty = F.when(F.col("worked").rlike(r"^\d+$"), F.concat(F.lit("[Duty: "), _minutes_clock(F.col("worked").try_cast("int")), F.lit("]"))).otherwise("")
    main = row(
        on=what["day"], dc=F.when(flies & (c("item_work_cd") == "PS"), "PS").otherwise(""), duty=what["duty"], dep=what["dep"], arr=what["arr"], begin=what["begin"], end=what["end"],
        ac=F.when(flies, c("subtype")).otherwise(""), registration=F.when(flies, c("ac_reg")).otherwise(""), info=F.array_join("parts", " "),
    )
    return [
        (F.col("__new") & flies, row(on=begun["day"], duty="C/I", dep=F.col("first_dep"), begin=_z(begun, begun["day"]))), (F.col("__fresh") & F.col("whole"), main),
        (F.col("closes") & flies & ended.isNotNull(), row(on=begun["day"], duty="C/O", arr=F.col("last_arr"), end=_z(ended, begun["day"]), info=duty)),
    ]


#: The columns of the detailed report where its headers are merged, from 1.
_MERGED = {"Day/Date": 2, "Duty/Trip Code": 9, "Label": 12, "Report": 14, "Time(Dep-Arv)": 15, "Duty Details": 16, "A/C": 19, "End": 22, "Block Hours": 26}


def _detailed(merged: bool) -> Itinerary:
    name = lambda n: f"@{_MERGED[n]}" if merged else n

    def rows(c: Cell) -> Rows:
        n = lambda k: c(name(k))
        time = lambda t: F.when(t.rlike(r"^\d{2}:\d{2}\s*(\(\+\))?$"), F.concat(F.substring(t, 1, 5), F.lit(" L"), F.when(t.endswith("(+)"), " +1").otherwise(""))).otherwise("")
        all_ = lambda k, p, i: F.regexp_extract_all(n(k), F.lit(p), F.lit(i))
        leg, pair, took = r"(\S+) \[([A-Z]{3})-([A-Z]{3})\]", r"(\d{2}:\d{2})-(\d{2}:\d{2}(?:\(\+\))?)", r"(\d+):\s*(\d{2})"
        flights, deps, arrs = (all_("Duty Details", leg, i) for i in (1, 2, 3))
        begins, ends, hours, minutes = all_("Time(Dep-Arv)", pair, 1), all_("Time(Dep-Arv)", pair, 2), all_("Block Hours", took, 1), all_("Block Hours", took, 2)
        crafts, code = F.filter(F.split(n("A/C"), r"\s+"), lambda x: x != ""), F.coalesce(F.get(F.split(n("Duty/Trip Code"), r"\s+"), 0), F.lit(""))
        trip = F.when(code == F.coalesce(F.get(flights, 0), F.lit("")), "").otherwise(code)
        block = lambda i: F.concat(F.when(F.length(F.get(hours, i)) < 2, F.lpad(F.get(hours, i), 2, "0")).otherwise(F.get(hours, i)), F.lit(":"), F.get(minutes, i))

        def of_leg(f: Column, i: Column) -> Column:
            worked = F.when(F.coalesce(block(i), F.lit("00:00")) == "00:00", "").otherwise(block(i))
            info = _joined(tags(("Block", worked)), F.when(i == 0, tags(("Trip", trip), ("Label", n("Label")))).otherwise(""))
            return _struct(row(duty=f, dep=F.get(deps, i), arr=F.get(arrs, i), begin=time(F.coalesce(F.get(begins, i), F.lit(""))), end=time(F.coalesce(F.get(ends, i), F.lit(""))), ac=F.coalesce(F.get(crafts, i), F.lit("")), info=info))

        flying = F.size(flights) > 0
        details = F.when(n("Duty Details") == "-", "").otherwise(n("Duty Details"))
        alone = row(duty=F.when(code != "", code).otherwise(details), begin=time(n("Report")), end=time(n("End")), info=_joined(F.when(_has(code, details), F.concat(F.lit("["), code, F.lit(": "), details, F.lit("]"))).otherwise(""), tags(("Label", n("Label")))))
        return [
            (flying & (time(n("Report")) != ""), row(duty="C/I", dep=F.get(deps, 0), begin=time(n("Report")))), F.transform(flights, of_leg),
            (flying & (time(n("End")) != ""), row(duty="C/O", arr=F.element_at(F.concat(F.array(F.lit("")), arrs), -1), end=time(n("End")))), (~flying & ((code != "") | (details != "")), alone),
        ]

    around = lambda c, lines, upto: _month_day(F.regexp_extract(c(name("Day/Date")), r"^(\d{2})-[A-Z]{3}$", 1).try_cast("int"), lines, upto)
    need = ("Day/Date", "Label", "Report", "Time(Dep-Arv)", "Duty Details") + (() if merged else ("Duty/Trip Code",))
    return Itinerary("emirates-detailed", (need,), lambda c: F.lit(None).cast("date"), rows, around=around, carried=True)


def _spanish(c: Cell) -> Rows:
    said = lambda n: F.when(c(n) == "--", "").otherwise(c(n))
    took = lambda n: F.when(c(n).rlike("[1-9]"), _clock(c(n), r"^(\d{1,3})[.:](\d{2})$")).otherwise("")
    flight, day = F.col("d").isNotNull() & c("SALIDA").rlike(_CODE), _numeric(c("SESION DE ENTRENADOR SINTETICO"))
    remarks = _joined(said("OBSERVACIONES"), said("REMARK"))
    info = _joined(
        tags(("Flight", took("TIEMPO TOTAL VUELO"))), _counted(("Landing Day", c("ATERRIZAJES")), ("Landing Night", c("ATERRIZAJES+1"))), tags(("Night", took("HORA Y CONDICION")), ("IFR", took("HORA Y CONDICION+1"))),
        tags(("PIC", took("FUNCION")), ("CoPilot", took("FUNCION+1")), ("Dual", took("FUNCION+2")), ("Instructor", took("FUNCION+3"))), remarks,
    )
    main = row(dep=c("SALIDA"), begin=zoned(c("SALIDA+1")), arr=c("LLEGADA"), end=zoned(c("LLEGADA+1")), ac=said("AERONAVE"), registration=said("AERONAVE+1"), crew=crew(("PIC", said("NOMBRE PIC"))), info=info)
    kind = "SESION DE ENTRENADOR SINTETICO+1"
    sim = row(on=F.coalesce(day, F.col("d")), duty=c(kind), info=_joined(tags(("Sim", took("SESION DE ENTRENADOR SINTETICO+2"))), F.when(c("SALIDA").rlike(_CODE), "").otherwise(remarks)))
    return [(flight, main), ((said(kind) != "") & F.coalesce(day, F.col("d")).isNotNull(), sim)]


def _duty_legs(c: Cell) -> Rows:
    form = r"^([A-Z]{3,4}) - ([A-Z]{3,4})$"
    took = lambda n: F.when(c(n).rlike(r"^\d{1,2}:\d{2}$") & c(n).rlike("[1-9]"), F.lpad(c(n), 5, "0")).otherwise("")
    flies, dep, arr = c("Duty").rlike(form), F.regexp_extract(c("Duty"), form, 1), F.regexp_extract(c("Duty"), form, 2)
    info = tags(("Flight", took("Flight Time")), ("Block", took("Block Time (DP)")), ("FDP", took("Flight Duty Period (act)")), ("Duty", took("Duty Period (DP)")))
    leg = row(dep=dep, arr=arr, registration=c("AC"), begin=zoned(c("Off-Block")), takeoff=zoned(c("Take Off")), landing=zoned(c("Ldg")), end=zoned(c("On-Block")))
    return [
        (~flies & _has(c("Duty")), row(duty=c("Duty"), begin=zoned(c("Start Duty")), end=zoned(c("Check-Out")))), (flies & _has(c("Start Duty")), row(duty="C/I", dep=dep, begin=zoned(c("Start Duty")))), (flies, leg),
        (flies & _has(c("Check-Out")), row(duty="C/O", arr=arr, end=zoned(c("Check-Out")), info=info)),
    ]


def _duty_sectors(c: Cell) -> Rows:
    form, stamp = r"^([A-Z]{3})-([A-Z]{3})$", r"^(\S+) (\d{4})L$"
    time = lambda n: F.regexp_extract(c(n), stamp, 2)
    starts, ends = c("Duty Start").rlike(stamp), c("Duty End").rlike(stamp)
    end = F.concat(zoned(time("Duty End"), "L"), _later(_numeric(F.regexp_extract(c("Duty End"), stamp, 1)), F.col("d")))
    flies, dep, arr = c("Sector").rlike(form), F.regexp_extract(c("Sector"), form, 1), F.regexp_extract(c("Sector"), form, 2)
    left, came = (F.regexp_replace(c(n), "L$", "") for n in ("Dep", "Arr"))
    code = row(duty=c("Flt/GD"), begin=F.when(starts, zoned(time("Duty Start"), "L")).otherwise(""), end=F.when(ends, end).otherwise(""), info=tags(("SD", c("SD"))))
    leg = row(duty=c("Flt/GD"), dep=dep, arr=arr, begin=zoned(left, "L"), end=zoned(came, "L", came < left), ac=c("A/C"), info=tags(("SD", c("SD"))))
    return [(~flies, code), (flies & starts, row(duty="C/I", dep=dep, begin=zoned(time("Duty Start"), "L"))), (flies, leg), (flies & ends, row(duty="C/O", arr=arr, end=end))]


_DAY_TIME = r"^(\S+) (\d{2}:\d{2})$"


def _planning_line(c: Cell) -> dict[str, Column]:
    flight = c("Duty").rlike(r"^[A-Z]{2,3}\d{1,4}[A-Z]?$") & (c("Duty") != "VS")
    return {"flight": flight, "moves": flight | (c("Duty") == "VS"), "out": c("Duty end").rlike(r"^\d{2}:\d{2}$")}


def _planning_around(c: Cell, lines: W, upto: W) -> list[dict[str, Column]]:
    own = W.partitionBy("file", "__duty").orderBy("line")
    return [
        {"__duty": F.coalesce(F.sum(F.col("out").cast("int")).over(lines.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))},
        {"before": F.coalesce(F.max("moves").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)), "so_far": F.max("moves").over(own.rowsBetween(W.unboundedPreceding, 0))},
    ]


def _planning(c: Cell) -> Rows:
    at = lambda n: F.regexp_extract(c(n), _DAY_TIME, 2)
    flight, duty, person = F.col("flight"), c("Duty"), r"([A-Z]{2,3}):([A-ZÀ-Ü][A-ZÀ-Ü' -]*?)(?=\s+[A-Z]{2,3}:|$)"
    end = F.when(c("End").rlike(_DAY_TIME), zoned(at("End"), "Z", _numeric(F.regexp_extract(c("End"), _DAY_TIME, 1)) > F.col("d"))).otherwise("")
    staff = F.array_join(F.zip_with(F.regexp_extract_all(c("Description"), F.lit(person), F.lit(1)), F.regexp_extract_all(c("Description"), F.lit(person), F.lit(2)), lambda a, b: F.concat(F.lit("["), a, F.lit(" - "), F.trim(b), F.lit("]"))), "")
    craft = lambda i: F.regexp_extract(c("Notes"), r"Aircraft : (\S+) Aircraft type : ([A-Z0-9]+)", i)
    other = ~flight & ~duty.isin("VS", "HOTEL") & (c("Notes") != duty)
    info = _joined(F.when(flight, tags(("Pax", c("Pax")))).otherwise(""), F.when((duty == "VS") | other, c("Notes")).otherwise(""))
    main = row(
        duty=F.when(duty == "HOTEL", "H").otherwise(duty), dc=F.when(duty == "VS", "DH").otherwise(""), dep=c("City"), arr=F.when((c("City#2") != c("City")) | flight, c("City#2")).otherwise(""), begin=zoned(at("Start")), end=end,
        registration=craft(1), ac=craft(2), crew=F.when(flight, staff).otherwise(""), info=info,
    )
    return [
        (F.col("moves") & c("Check-in").rlike(_DAY_TIME) & ~F.col("before"), row(duty="C/I", dep=c("City"), begin=zoned(at("Check-in")))), (F.lit(True), main),
        (F.col("out") & F.col("so_far"), row(duty="C/O", arr=c("City#2"), end=zoned(c("Duty end"), "Z", c("Duty end") < at("Start")))),
    ]


def _activities_around(c: Cell, lines: W, upto: W) -> list[dict[str, Column]]:
    flight = c("Activity").rlike(r"^[A-Z0-9]{2}\d{1,4}[A-Z]?$")
    return [{"flight": flight}, {"next_dep": F.first(F.when(F.col("flight") & (c("From") != ""), c("From")), ignorenulls=True).over(lines.rowsBetween(0, W.unboundedFollowing)), "last_arr": F.last(F.when(F.col("flight"), c("To")), ignorenulls=True).over(upto)}]


def _activities(c: Cell) -> Rows:
    act, flight, std, sta = c("Activity"), F.col("flight"), c("STD"), c("STA")
    into, out, hotel = act.rlike("(?i)^checkin$"), act.rlike("(?i)^checkout$"), act.rlike("(?i)^NightStop$")
    leg = row(duty=act, dep=c("From"), arr=c("To"), begin=zoned(std, "L"), end=zoned(sta, "L", sta < std), info=tags(("Duty", c("Duty")), ("Meal", c("Meal"))))
    other = row(duty=F.when(hotel, "H").otherwise(act), dep=F.when(hotel, F.col("last_arr")).otherwise(""), begin=zoned(std, "L"), end=zoned(sta, "L", sta < std))
    return [(into, row(duty="C/I", dep=F.col("next_dep"), begin=zoned(std, "L"))), (out, row(duty="C/O", arr=F.col("last_arr"), end=zoned(sta, "L"))), (flight & ~into & ~out, leg), (~flight & ~into & ~out, other)]


#: The columns of a calendar export in Spanish and in English.
_OUTLOOK = {
    "subject": ("Asunto", "Subject"), "startDate": ("Fecha de comienzo", "Start Date"), "start": ("Comienzo", "Start Time"), "endDate": ("Fecha de finalización", "End Date"), "end": ("Finalización", "End Time"), "allDay": ("Todo el día", "All day event")
}
_SIGN_ON, _FLIGHT_SUBJECT = r"^Firma\s+(\d{2}:\d{2})(?:\s+Pairing\s+(\S+))?", r"^([A-Z0-9]{2}\d{1,4}[A-Z]?)\s+([A-Z]{3})(\d{4})-([A-Z]{3})(\d{4})(?:\s*/\s*(\S+))?(?:\s+(\S+))?\s*$"


def _outlook(language: int) -> Itinerary:
    n = {k: v[language] for k, v in _OUTLOOK.items()}
    day = lambda t: F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), numeric_date(t, F.lit(False)))
    member = r"^(\S+?)(?:->\S+)?\s+(\d{5,6})\s+(.+?)\s*,\s*(.+?)\s*$"

    def line(c: Cell) -> dict[str, Column]:
        people = F.filter(F.flatten(F.transform("cells", lambda x: F.split(x, "\n"))), lambda x: x.rlike(member))
        tag = lambda x: F.concat(F.lit("["), F.regexp_extract(x, member, 1), F.lit(" - "), F.regexp_extract(x, member, 2), F.lit(" - "), F.regexp_extract(x, member, 3), F.lit(", "), F.regexp_extract(x, member, 4), F.lit("]"))
        return {"subject": c(n["subject"]), "people": F.array_join(F.transform(people, tag), "")}

    def around(c: Cell, lines: W, upto: W) -> list[dict[str, Column]]:
        following = F.lead("subject").over(lines)
        return [{"next_dep": F.when(following.rlike(_FLIGHT_SUBJECT), F.regexp_extract(following, _FLIGHT_SUBJECT, 2))}]

    def rows(c: Cell) -> Rows:
        s = F.col("subject")
        part = lambda i: F.regexp_extract(s, _FLIGHT_SUBJECT, i)
        clock = lambda t: F.concat(F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2))
        into, flight = s.rlike(_SIGN_ON), s.rlike(_FLIGHT_SUBJECT)
        named, mark = r"^(\S+?)\s*-\s*(.+?)\s*$", F.when(part(7) != "", F.concat(F.lit("["), part(7), F.lit("]"))).otherwise("")
        duty = F.when(s.rlike(named), F.regexp_extract(s, named, 1)).otherwise(F.trim(s))
        info = F.when(s.rlike(named), F.concat(F.lit("["), F.regexp_extract(s, named, 1), F.lit(": "), F.regexp_extract(s, named, 2), F.lit("]"))).otherwise("")
        ends, whole = day(c(n["endDate"])), c(n["allDay"]).rlike("(?i)^(Verdadero|True)$")
        leg = row(duty=part(1), dep=part(2), arr=part(4), begin=zoned(clock(part(3))), end=zoned(clock(part(5)), "Z", part(5) < part(3)), ac=part(6), crew=F.col("people"), info=mark)
        last = F.when(ends >= F.col("d"), ends).when(ends.isNull(), F.col("d"))
        days = F.when(~into & ~flight & whole & last.isNotNull(), F.transform(F.sequence(F.col("d"), last), lambda x: _struct(row(on=x, duty=duty, info=info))))
        timed = row(duty=duty, begin=zoned(c(n["start"]), "L"), end=zoned(c(n["end"]), "L", ends > F.col("d")), crew=F.col("people"), info=info)
        return [
            (into, row(duty="C/I", dep=F.col("next_dep"), begin=zoned(F.regexp_extract(s, _SIGN_ON, 1), "L"), info=tags(("Pairing", F.regexp_extract(s, _SIGN_ON, 2))))), (~into & flight, leg), days, (~into & ~flight & ~whole, timed)
        ]

    return Itinerary("outlook-calendar", (tuple(n.values()),), lambda c: day(c(n["startDate"])), rows, line, lambda c: F.col("d").isNotNull() & _has(c(n["subject"])), around)


def _flight_records(c: Cell) -> Rows:
    zone = lambda s, since: F.when(F.col("__local"), _at(s, "L", since)).otherwise(_at(s, "Z", since))
    off, up, down, on, into, out = (_stamped(c(n)) for n in ("actualdeparturetime", "takeofftime", "landingtime", "actualarrivaltime", "ondutytime", "offdutytime"))
    d = F.col("d")
    info = _joined(tags(("Block", c("totaltime"))), _counted(("Takeoff Day", c("daytakeoffs")), ("Takeoff Night", c("nighttakeoffs")), ("Landing Day", c("daylandings")), ("Landing Night", c("nightlandings"))))
    leg = row(duty=c("flightnumber"), dep=c("from"), arr=c("to"), begin=zone(off, d), takeoff=zone(up, d), landing=zone(down, d), end=zone(on, d), ac=c("selectedaircrafttype"), registration=c("selectedaircraftid"), info=info)
    return [(into.isNotNull(), row(on=into["day"], duty="C/I", begin=zone(into, into["day"]))), (F.lit(True), leg), (out.isNotNull(), row(duty="C/O", end=zone(out, d)))]


#: The headers of each export format, in the order in which they are tried among themselves.
ITINERARIES = [
    Itinerary("logbook", (("Date", "Airport", "Reg.", "Flt time"),), lambda c: _numeric(c("Date")), _pilot_log(_PRINTED_LOG), numeric="Date"),
    Itinerary("logbook", (("Date", "DepPlace", "DepTime", "ArrPlace", "ArrTime"),), lambda c: _numeric(c("Date")), _pilot_log(_FLAT_LOG), numeric="Date"),
    Itinerary("ac-logbook", (("Flt#", "FIN", "Station", "Time(L)"),), lambda c: month_first_date(c("Date")), _ac_logbook),
    Itinerary(
        "crew-legs", (("flt_nbr", "dprt_arpt_cd", "arr_arpt_cd", "schld_dprt_lcl_dttm", "schld_arr_lcl_dttm"),), lambda c: F.coalesce(iso_date(c("flt_orig_dt")), _stamped(c("schld_dprt_lcl_dttm"))["day"]), _crew_legs, _crew_legs_line,
        lambda c: F.col("d").isNotNull() & _has(c("flt_nbr")) & c("dprt_arpt_cd").rlike(_AIRPORT), _crew_legs_around, tidy=lambda h: F.transform(h, F.lower),
    ),
    _report("raido", ("RaidoLab_Name", "Text2", "Text11", "Text12", "TimeText_CI", "TimeText_ValidFrom", "TimeText_ValidToString"), _REPORT_FIELDS, True),
    _report("raido", ("Code", "Dep", "Arr", "STD", "STA"), _REPORT, False),
    _roster_report("L"), _roster_report("B"), _roster_report("Z"),
    Itinerary("crew-flights", (("Flight", "Date", "Origin", "Dest", "Depart", "Arrive"),), lambda c: _numeric(c("Date")), _crew_flights, numeric="Date"),
    Itinerary(
        "route-log", (("Date", "Code", "Rego", "Route", "Day Hours", "Night Hours"),), lambda c: month_first_date(c("Date")), _route_log,
        around=lambda c, lines, upto: _carried(lines, upto, (c("Date") != "") | F.forall("cells", lambda x: x == "")), carried=True,
    ),
    Itinerary("calendar-events", (("dtstart", "dtend", "description", "summary"),), lambda c: iso_date(c("dtstart")), _calendar, _calendar_line, lambda c: F.col("at").isNotNull() & (F.size("told") > 0)),
    Itinerary(
        "crew-duties", (("duty_start", "act", "flight", "dep_stat", "arr_stat", "leg_start", "leg_end", "duty_en"),), lambda c: _day_time(c("duty_start"))["day"], _crew_duties, _crew_duties_line,
        lambda c: F.col("sure") & (F.col("flies") | F.col("whole")), _crew_duties_around, numeric="duty_start",
    ),
    _detailed(False), _detailed(True),
    Itinerary("spanish-logbook", (("FECHA", "SALIDA", "LLEGADA", "AERONAVE", "TIEMPO TOTAL VUELO"),), lambda c: _numeric(c("FECHA")), _spanish, keep=lambda c: F.lit(True), numeric="FECHA"),
    Itinerary("duty-legs", (("Start Duty", "Off-Block", "On-Block", "Check-Out"),), lambda c: _numeric(c("Date")), _duty_legs, numeric="Date"),
    Itinerary(
        "duty-sectors", (("Duty Start", "Flt/GD", "Sector", "Dep", "Arr", "Duty End"),), lambda c: _numeric(c("Duty Start")), _duty_sectors, keep=lambda c: F.col("d").isNotNull() & _has(c("Flt/GD")),
        around=lambda c, lines, upto: [{"d": F.last("d", ignorenulls=True).over(upto)}], numeric="Duty Start", carried=True,
    ),
    Itinerary(
        "planning-checkin", (("Check-in", "Start", "End", "Duty end", "Duty", "Description", "Notes"),), lambda c: F.when(c("Start").rlike(_DAY_TIME), _numeric(F.regexp_extract(c("Start"), _DAY_TIME, 1))), _planning, _planning_line,
        lambda c: F.col("d").isNotNull() & _has(c("Duty")), _planning_around, numeric="Start",
    ),
    Itinerary(
        "activity-lines", (("Day", "Date", "Duty", "Meal", "Activity", "From", "STD", "STA", "To", "Stop time"),), lambda c: F.coalesce(_numeric(c("Date")), named_date(c("Date"))), _activities,
        keep=lambda c: F.col("d").isNotNull() & _has(c("Activity")), around=_activities_around, numeric="Date",
    ),
    _outlook(0), _outlook(1),
    Itinerary(
        "flight-records", (("flightdate", "flightnumber", "from", "to", "actualdeparturetime", "actualarrivaltime", "takeofftime", "landingtime"),), lambda c: iso_date(F.replace(c("flightdate"), F.lit("/"), F.lit("-"))), _flight_records,
        keep=lambda c: F.col("d").isNotNull() & _has(c("from")), tidy=lambda h: F.transform(h, F.lower),
    ),
]


def fits(spec: Itinerary, header: Column) -> Column:
    tidy = spec.tidy(header)
    return F.coalesce(*[F.when(F.size(F.array_except(F.array(*map(F.lit, need)), tidy)) == 0, True) for need in spec.headers], F.lit(False))


def rows_of(below: DataFrame, spec: Itinerary) -> DataFrame:
    """(file, line, place, layout, *FIELDS) of lines (file, line, cells, __header, __local, __period) of files with this layout."""
    asked = _Asked()
    lines = W.partitionBy("file").orderBy("line")
    upto, whole = lines.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("file")
    # what the spec asks for is known only after all of it has been written down
    date, told, keep = spec.date(asked), spec.line(asked), spec.keep(asked)
    steps, made = spec.around(asked, lines, upto), spec.rows(asked)
    numeric = asked(spec.numeric) if spec.numeric else F.lit("")
    header = spec.tidy(F.col("__header"))
    place = lambda n: F.lit(int(n[1:])) if n[0] == "@" else _on_line(n[:-2], header) - 1 if n.endswith("-1") and n[:-2] in ("CI", "TimeText_CI") else _on_line(n, header)
    df = below.withColumn("__places", F.array(*map(place, asked.names)))
    df = df.withColumn("__cells", F.transform("__places", lambda p: F.coalesce(F.when(p > 0, F.get("cells", p - 1)), F.lit(""))))
    part = lambda i: F.regexp_extract(numeric, r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})\b", i).try_cast("int")
    df = df.withColumn("__month_first", (F.coalesce(F.max(part(2)).over(whole), F.lit(0)) > 12) & (F.coalesce(F.max(part(1)).over(whole), F.lit(0)) <= 12))
    df = df.withColumn("d", date)
    if told:
        df = df.withColumns(told)
    if not spec.carried:
        df = df.filter(keep)
    for step in steps:
        df = df.withColumns(step)
    if spec.carried:
        df = df.filter(keep)
    none = F.lit(None).cast(_ROWS)
    parts = [F.coalesce(x, none) if isinstance(x, Column) else F.array(F.when(x[0], _struct(x[1]))) for x in made]
    listed = F.filter(F.concat(*[F.coalesce(p, F.expr(f"cast(array() as {_ROWS})")) for p in parts]), lambda r: r.isNotNull())
    each = df.select("file", "line", F.posexplode(listed).alias("place", "r"))
    return each.select("file", "line", "place", F.lit(spec.name).alias("layout"), F.date_format("r.on", "d MMM yy").alias("date"), F.date_format("r.on", "EEE").alias("day"), *[f"r.{f}" for f in FIELDS[2:]])


_ROWS = "array<struct<`on`:date," + ",".join(f"`{f}`:string" for f in FIELDS[2:]) + ">>"


def period_start(line: Column, cells: Column) -> Column:
    """struct<line, day> of a period printed among a file's first fifteen lines; null elsewhere."""
    found = F.get(F.filter(F.transform(cells, printed_period), lambda p: p.isNotNull()), 0)
    month = F.get(F.filter(cells, lambda x: x.rlike(r"^01/\d{2}/\d{4}$")), 0)
    day = F.coalesce(F.when(F.array_contains(cells, "Staff :") & month.isNotNull(), numeric_date(month, F.lit(False))), F.try_to_date(F.substring_index(found, " - ", 1), "ddMMMyy"))
    return F.when((line < 15) & day.isNotNull(), F.struct(line.alias("line"), day.alias("day")))
