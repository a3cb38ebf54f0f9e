"""Dates of rows that were read one by one: parts of printed dates, whole dates from their order, repairs, periods.

Rows of one section come in order; a section is one document's table and runs as one group where each row's date
depends on the one before it.

Defined results: a text without a day or weekday gives null parts; rows before anything known keep null; a section
with no date read is left as it is.
"""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import MONTHS, WEEKDAYS, chained, day_number, let, printed_day, text_of, weekday_name

#: Weekdays in English and Spanish by number, Sunday 0; month names as they are misread.
DAY_NAMES = {
    "mon": 1, "tue": 2, "wed": 3, "thu": 4, "fri": 5, "sat": 6, "sun": 0, "lunes": 1, "martes": 2, "miércoles": 3, "miercoles": 3, "jueves": 4, "viernes": 5, "sábado": 6, "sabado": 6, "domingo": 0
}
MISREAD_MONTHS = [(r"\bF[6b]b\b|\bFb\b", "Feb"), (r"\b[0O]ct?\b|\b0c\b", "Oct"), (r"\bJu[1l]\b", "Jul"), (r"\bS[e]?p\b", "Sep"), (r"\bMa[yv]\b", "May"), (r"\bDe[cç]\b", "Dec")]
#: Days beyond which the next date is no sequel; minutes back that start a new day.
SEQUEL, BACK = 14, 60
_NAME = "|".join(MONTHS)


def _capitalised(text: Column) -> Column:
    """Month names of three letters in any capitals as they are printed in English."""
    for m in MONTHS:
        text = F.regexp_replace(text, rf"(?<![A-Za-z])(?:{m.upper()}|{m})(?![A-Za-z])", m)
    return text


def date_parts(text: Column) -> Column:
    """struct<day, month, year, weekday, numeric> of a printed date: month from 1, year of two digits, weekday from Sunday 0; null for what is missing.

    The forms are tried in order: year first; a day and its weekday; then, after weekdays are taken out, a day with a
    month's name, a month's name first, numbers, ``14.08.`` with a year beside it, day and month, a day glued behind
    its weekday, a month and a year, a day alone.
    """
    t = _capitalised(chained(text_of(text), *MISREAD_MONTHS))
    number = lambda s, p, i: F.regexp_extract(s, p, i).try_cast("int")
    month = lambda s, p, i: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(s, p, i)).cast("int"), F.lit(0))
    none = F.lit(None).cast("int")

    def made(day: Column = none, mon: Column = none, year: Column = none, weekday: Column = none, numeric: bool = False) -> Column:
        return F.struct(day.cast("int").alias("day"), mon.cast("int").alias("month"), (year.cast("int") % 100).alias("year"), weekday.cast("int").alias("weekday"), F.lit(numeric).alias("numeric"))

    first = r"(?:^|\s)((?:19|20)\d{2})([-/]?)(\d{2})\2(\d{2})(?=T|\s|$)"
    short = F.map_from_arrays(F.array(*[F.lit(k) for k in DAY_NAMES]), F.array(*[F.lit(v) for v in DAY_NAMES.values()]))
    named = r"(?i)^(\d{1,2})[-\s.]?(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?$"

    def rest(s: Column) -> Column:
        bare = F.transform(F.filter(F.split(s, r"\s+"), lambda w: ~w.rlike(r"\d")), lambda w: F.lower(F.regexp_replace(w, "[.,]$", "")))
        said = F.element_at(F.filter(F.transform(bare, lambda w: F.try_element_at(short, F.when(F.length(w) > 4, w).otherwise(F.substring(w, 1, 3)))), lambda v: v.isNotNull()), -1)
        said = F.when(F.exists(bare, lambda w: F.try_element_at(short, F.when(F.length(w) > 4, w).otherwise(F.substring(w, 1, 3))).isNotNull()), said)
        glue = r"(?i)(?:^|\s)(Mo|Tu|We|Th|Fr|Sa|Su)[a-z]{0,4}[,.]?(\d{1,3})(?!\d)"
        glued = s.rlike(glue) & ~F.trim(s).rlike(r"(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\d{2}$")
        two = F.array_position(F.array(*[F.lit(d[:2].lower()) for d in WEEKDAYS]), F.lower(F.regexp_extract(s, glue, 1))) - 1
        loose = F.regexp_replace(F.regexp_replace(s, r"(?i)(^|\s)(?:Mo|Tu|We|Th|Fr|Sa|Su)[a-z]{0,4}[,.]?\d(\d{2})(?!\d)", "$1 $2"), r"(?i)(^|\s)(?:Mo|Tu|We|Th|Fr|Sa|Su)[a-z]{0,4}[,.]?(\d{1,2})(?!\d)", "$1 $2")
        weekday, plain = F.when(glued, two).otherwise(said), F.when(glued, loose).otherwise(s)

        def forms(x: Column) -> Column:
            spaced = rf"(\d{{1,2}})(?:\s+|-|(?=[A-Z]))({_NAME})[a-z]*\.?(?:(?:\s+|-)?(\d{{4}}|\d{{2}})(?!\d))?"
            leading = rf"({_NAME})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?!\d)"
            numbers, dotted, slash = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?!\d)", r"(?:^|\s)(\d{1,2})\.(\d{1,2})\.(?:\s|$)", r"^(\d{1,2})/(0?[1-9]|1[0-2])$"
            behind, ending, alone = r"(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)(\d{1,2})$", rf"({_NAME})[a-z]*\.?\s+(\d{{2}})(?!\d)", r"(?:^|\s)(\d{1,2})\.?(?:\s|$)"
            own = F.try_element_at(short, F.lower(F.regexp_extract(x, behind, 1)))
            beside = F.regexp_extract(x, r"(?:^|\s)((?:19|20)\d{2})(?:\s|$)", 1).try_cast("int")
            found = (
                F.when(x.rlike(spaced), made(number(x, spaced, 1), month(x, spaced, 2), number(x, spaced, 3), weekday))
                .when(x.rlike(leading), made(number(x, leading, 2), month(x, leading, 1), number(x, leading, 3), weekday))
                .when(x.rlike(numbers), made(number(x, numbers, 1), number(x, numbers, 2), number(x, numbers, 3), weekday, True))
                .when(x.rlike(dotted), made(number(x, dotted, 1), number(x, dotted, 2), beside, weekday))
                .when(F.trim(x).rlike(slash), made(number(F.trim(x), slash, 1), number(F.trim(x), slash, 2), none, weekday))
                .when(x.rlike(behind), made(number(x, behind, 2), none, none, own))
                .when(x.rlike(ending), made(none, month(x, ending, 1), number(x, ending, 2), weekday))
                .when(x.rlike(alone), made(number(x, alone, 1), none, none, weekday)).otherwise(made(weekday=weekday))
            )
            return let(found, lambda p: F.when((p["day"] > 0) | p["weekday"].isNotNull(), p))

        return let(plain, forms)

    whole = (number(t, first, 3).between(1, 12)) & number(t, first, 4).between(1, 31)
    by_name = F.try_element_at(short, F.lower(F.substring(F.regexp_extract(F.trim(t), named, 2), 1, 3)))
    return F.when(t.rlike(first) & whole, made(number(t, first, 4), number(t, first, 3), number(t, first, 1))).when(F.trim(t).rlike(named), made(number(F.trim(t), named, 1), none, none, by_name)).otherwise(rest(t))


# ---- whole dates from parts -------------------------------------------------------------


def _day(year: int, month: int, day: int) -> int:
    """Days since 1970; months and days that are too large run over."""
    return (datetime.date(2000 + year + (month - 1) // 12, (month - 1) % 12 + 1, 1) - datetime.date(1970, 1, 1)).days + day - 1


def _weekday(number: int) -> int:
    return (number + 4) % 7


def whole_dates(parts: list[dict | None], start: tuple[int, int] | None = None, stop: tuple[int, int] | None = None) -> list[int | None]:
    """Day numbers of date parts in order. start and stop: (year, month) of the document's period.

    A day alone goes on from the month before, into the next where it falls; where printed weekdays disagree the first
    month of the period that fits all of them is taken. Then dates that break the order are moved to the first day from
    the one before that has their weekday or number.
    """
    numeric = [p for p in parts if p and p["numeric"] and p["year"] is not None]
    swapped = lambda p: p | {"day": p["month"], "month": p["day"]} if p and p["numeric"] and p["day"] <= 12 else p
    misfits = lambda ps: sum(p["month"] > 12 or (p["weekday"] is not None and _weekday(_day(p["year"], p["month"], p["day"])) != p["weekday"]) for p in ps)
    if numeric and all(p["day"] <= 12 for p in numeric) and misfits([swapped(p) for p in numeric]) < misfits(numeric):
        parts = [swapped(p) for p in parts]

    def placed(year: int, month: int) -> list[int | None]:
        out, last = [], None
        for p in parts:
            if not p or not p["day"]:
                out.append(None)
                continue
            if p["month"] is not None:
                year = p["year"] if p["year"] is not None else year + (last is not None and p["month"] < month - 6)
                month = p["month"]
            elif last is not None and p["day"] < last:
                year, month = year + month // 12, month % 12 + 1
            last = p["day"]
            out.append(_day(year, month, last))
        return out

    wrong = lambda days: any(d is not None and p["weekday"] is not None and _weekday(d) != p["weekday"] for d, p in zip(days, parts))
    days = placed(*(start or (0, 1)))
    if start and stop and wrong(days):
        months = ((y, m) for y in range(start[0], stop[0] + 1) for m in range(1, 13) if start <= (y, m) <= stop)
        days = next((found for ym in months if not wrong(found := placed(*ym))), days)
    before = None
    for i, (d, p) in enumerate(zip(days, parts)):
        if before is None or not p:
            before = days[i] if days[i] is not None else before
            continue
        if d is None:
            if p["weekday"] is not None and not p["day"]:
                days[i] = before + ((p["weekday"] - _weekday(before) - 1) % 7 + 1)
        else:
            full, gap = p["month"] is not None and p["year"] is not None, d - before
            after = days[i + 1] - d if i + 1 < len(days) and days[i + 1] is not None else None
            on = p["month"] is not None and i + 1 < len(parts) and parts[i + 1] and parts[i + 1]["month"] is not None and gap > SEQUEL and after is not None and 0 <= after <= SEQUEL
            agrees = p["weekday"] is None or _weekday(d) == p["weekday"]
            if not agrees or (not full and p["weekday"] is None and not on and not 0 <= gap <= SEQUEL):
                near = (before + k for k in range(7 if p["weekday"] is not None else SEQUEL + 1))
                number = lambda n: (datetime.date(1970, 1, 1) + datetime.timedelta(days=n)).day
                fits = (n for n in near if (_weekday(n) == p["weekday"] if p["weekday"] is not None else number(n) == p["day"]))
                days[i] = next(fits, d if full else before)
        before = days[i] if days[i] is not None else before
    return days


def resolved(rows: DataFrame, keys: list[str], order: str, parts: str) -> DataFrame:
    """Rows with date and day worked out from the parts of all rows of a section, in order."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, order).schema)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        listed = [None if x is None else {k: None if v is None or v != v else v for k, v in (x if isinstance(x, dict) else x.asDict()).items()} for x in p[parts]]
        return p[[*keys, order]].assign(__number=pd.array(whole_dates(listed), "Int64"))

    found = rows.select(*keys, order, parts).groupBy(*keys).applyInPandas(run, f"{fields}, __number long")
    return rows.join(found, [*keys, order]).withColumns({"date": printed_day(F.col("__number")), "day": weekday_name(F.col("__number"))}).drop("__number")


# ---- repair -----------------------------------------------------------------------------


def repaired_days(rows: list[dict], seed: int | None = None) -> list[int | None]:
    """Day numbers of a section's rows {key, read, weekday, has_date, minute, duty}, put right from their order.

    key is the day as read (or carried), read whether it stands in the row itself; seed is the day before the first row.
    A date holds where it was read, its weekday agrees and it follows within two weeks. Other rows go by their weekday, by
    whether anything is printed in the date column, or by a time that starts over after a check-out; then rows ahead of the
    first sure one are counted back, and runs of unsure ones get a day each where that fits exactly.
    """
    if len(rows) < (2 if seed is None else 1) or not any(r["read"] and r["key"] is not None for r in rows):
        return [r["key"] for r in rows]
    days, sure = [r["key"] for r in rows], [False] * len(rows)
    now, minute = seed, None
    out = lambda r: "CHECKOUT" in r["duty"].upper().replace("-", "").replace(" ", "")
    into = lambda r: "CHECKIN" in r["duty"].upper().replace("-", "").replace(" ", "")
    for i, r in enumerate(rows):
        day, wanted, was = r["key"], r["weekday"], now
        over = r["minute"] is not None and minute is not None and r["minute"] < minute - BACK and (into(r) or (i > 0 and out(rows[i - 1])))
        fits = r["read"] and day is not None and (wanted is None or _weekday(day) == wanted)
        begins = i == 0 and seed is not None
        if fits and (now is None or 0 <= day - now <= SEQUEL):
            sure[i] = True
        elif now is not None and wanted is not None:
            day, sure[i] = now + (wanted - _weekday(now)) % 7, True
        elif now is not None and r["has_date"] is False and not begins and not over:
            day = now
        elif now is not None and (r["has_date"] or over or into(r) or begins) and (day is None or day <= now):
            day = now + 1
        elif now is not None and (day is None or day < now):
            day = now
        days[i] = day
        if day is not None and (now is not None or sure[i]):
            now = day
        minute = None if now != was else minute
        minute = r["minute"] if r["minute"] is not None else minute
    if any(sure):
        first = sure.index(True)
        after = days[first]
        for i in reversed(range(first)):
            if rows[i]["weekday"] is not None:
                days[i], sure[i] = after - (_weekday(after) - rows[i]["weekday"]) % 7, True
            elif days[i] is None or days[i] > after:
                days[i] = after
            after = days[i]
    known = ([] if seed is None else [(-1, seed)]) + [(i, days[i]) for i in range(len(rows)) if sure[i]]
    for (i, a), (j, b) in zip(known, known[1:]):
        if b - a == j - i:
            days[i + 1 : j] = range(a + 1, b)
    return days


def repaired(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows (date, begin, end, duty, read, weekday, has_date) with date and day put right within their section."""
    minute = F.regexp_extract(F.coalesce(F.nullif(F.col("begin"), F.lit("")), F.col("end")), r"^(\d{2}):(\d{2})", 1).try_cast("int") * 60 + F.regexp_extract(F.coalesce(F.nullif(F.col("begin"), F.lit("")), F.col("end")), r"^(\d{2}):(\d{2})", 2).try_cast("int")
    weekday = F.nullif(F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.col("weekday")).cast("int"), F.lit(0)) - 1
    # a year far from the section's commonest is a misreading of it
    year = F.regexp_extract("date", r" (\d{2})$", 1).try_cast("int")
    counted = rows.withColumn("__y", F.when(F.col("read"), year)).filter("__y is not null").groupBy(*keys, "__y").agg(F.count("*").alias("__n"))
    usual = counted.groupBy(*keys).agg(F.max_by("__y", F.struct("__n", (-F.col("__y")).alias("less"))).alias("__usual"))
    dated = rows.join(usual, keys, "left")
    own = F.when(F.abs(year - F.col("__usual")) > 1, F.regexp_replace("date", r"\d{2}$", "")).otherwise(None)
    text = F.when(own.isNotNull(), F.concat(own, F.lpad(F.col("__usual").cast("string"), 2, "0"))).otherwise(F.col("date"))
    cells = dated.select(*keys, order, day_number(text).cast("long").alias("key"), "read", weekday.cast("long").alias("weekday"), "has_date", minute.cast("long").alias("minute"), text_of(F.col("duty")).alias("duty"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keys, order).schema)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        whole = lambda v: None if v is None or v != v else v
        listed = [{k: whole(v) for k, v in r.items()} for r in p[["key", "read", "weekday", "has_date", "minute", "duty"]].to_dict("records")]
        listed = [r | {k: None if r[k] is None else int(r[k]) for k in ("key", "weekday", "minute")} for r in listed]
        return p[[*keys, order]].assign(__number=pd.array(repaired_days(listed), "Int64"))

    found = cells.groupBy(*keys).applyInPandas(run, f"{fields}, __number long")
    kept = [c for c in rows.columns if c not in ("date", "day")]
    date, day = F.coalesce(printed_day(F.col("__number")), F.col("date")), weekday_name(F.col("__number"))
    return rows.join(found, [*keys, order]).select(*kept, date.alias("date"), F.coalesce(day, F.col("day") if "day" in rows.columns else F.lit("")).alias("day"))


# ---- periods ----------------------------------------------------------------------------


def rows_period(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """(*keys, period): ``01Jul24 - 31Aug24``, the months from the first row's to the last row's."""
    n = day_number(F.col(date))
    found = rows.groupBy(*keys).agg(F.date_from_unix_date(F.min(n).cast("int")).alias("a"), F.date_from_unix_date(F.max(n).cast("int")).alias("b"))
    return found.filter("a is not null").select(*keys, F.concat(F.lit("01"), F.date_format("a", "MMMyy"), F.lit(" - "), F.date_format(F.last_day("b"), "ddMMMyy")).alias("period"))


def printed_period(text: Column) -> Column:
    """``01Feb24 - 05Aug24`` of ``01/02/2024 - 05/08/2024`` (day first) or ``(01JAN24 - 06AUG24)``; null if it is none."""
    numbers, names = r"^(\d{2})[/.](\d{2})[/.]\d{2}(\d{2})\s*-\s*(\d{2})[/.](\d{2})[/.]\d{2}(\d{2})", r"^\(?(\d{2})([A-Za-z]{3})(\d{2})\s*-\s*(\d{2})([A-Za-z]{3})(\d{2})\)?$"
    month = lambda i: F.get(F.array(*map(F.lit, MONTHS)), F.regexp_extract(text, numbers, i).try_cast("int") - 1)
    part = lambda p, i: F.regexp_extract(text, p, i)
    of = lambda p, m: F.concat(part(p, 1), m(2), part(p, 3), F.lit(" - "), part(p, 4), m(5), part(p, 6))
    return F.when(text.rlike(numbers), of(numbers, month)).when(text.rlike(names), of(names, lambda i: F.initcap(part(names, i))))
