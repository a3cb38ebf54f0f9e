"""Cockpit message pages: printed times and dates, label words, records read, tagged, assembled and compared.

Words are (key, t, x, y, w, h) as pages.words_of gives them with text through ``fixed_text``; words of one y are a line. A page
is one document and is read in one group.

Defined results: what a page does not show is empty; of several values under one label the first in reading order
counts; a value that a label has but no word shows for sure is marked ``?`` and taught to nobody.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import MONTHS, chained, rewritten, text_of

#: The fields of a record, and the tags of its words.
FIELDS = ["flt", "date", "dept", "dest", "out", "off", "on", "in", "info"]
TAGS = ["flt", "adate", "dept", "dest", "out", "off", "on", "in", "block", "flight"]
TIMES = ["out", "off", "on", "in", "block", "flight"]
#: Digits read as letters and the other way.
LETTERS_FOR_DIGITS, DIGITS = "ODQIL|TZSBG", "00011112586"
DIGITS_FOR_LETTERS, LETTERS = "012586", "OIZSBG"
#: What a label's letters mean; the first that fits counts.
LABELS = [
    ("flt", r"(ATC|AIC|ATG)?(FLIGHT|FLIGHI|FLT|FLI)(NO|NBR|NUM|NUMBER|ID|IO)(DAY|DATE|DAIE)?|CALLSIGN(DATE)?"), ("fltroute", r"(FLT|FLIGHT)(NO|NUM|ID)(DATE|DAIE)?(ORIG|DEP)(DEST|DES)"),
    ("dept", r"DEPT|ORIG|FROM"), ("dest", r"DEST|TO"), ("flight", r"TRIP|AIR"), ("route", r"(DEPT|DEP|DEPI|DPT|ORIG|ORIGIN|FROM)(DEST|DES|DESI|DESJ|TO)|(FLTNUM|FLTNUMDATE|FLTID|FLTIDDATE|NUMDATE)?(DATE|DAIE)?(ORIG|DEP)(DEST|DES)"),
    ("out", r"(OUT|QUT)(TIME|FUEL)?|OFFBLOCKS?"), ("outoff", r"OUTOFF"), ("onin", r"ONIN"), ("off", r"OFF(TIME|FUEL)?|AIRBORNE"), ("on", r"ON(TIME|FUEL)?|TOUCHDOWN"), ("in", r"(IN|TN|IIN)(TIME|FUEL)?|ONBLOCKS?"),
    ("block", r"(BLOCK|BLOC|BLK)(TIME|IIME|TIMES)?"), ("flight", r"(FLIGHT|FLIGHI|FLT|AIRTIME|FLTTIME)(TIME|TIMES|IIME)?"), ("date", r"DATE|DAIE|DAY"),
    ("other", r"UTC|ETA|ETE|FOB|F0B|FUEL|RETURN|RETURNTO|TIME|TIMES|GROUNDACK|GSTIME|GSIIIME|GSIZTIME|PRINT|MENU|STATUS|SENSORS"),
]
#: Labels that values are glued to, and words of eight letters that are no two airports.
GLUED = ["OUT", "OFF", "ON", "IN", "BLOCK", "BLOC", "BLK", "FLT", "FLIGHT", "ETA", "UTC", "RETURN", "TIME", "FUEL"]
WHOLE = ["FLIGHTNO", "FLTNOBR", "ORIGDEST", "DEPTDEST"]
#: Fixed value: a flight number, with or without its carrier.
FLIGHT = r"[A-Z0-9]{2,3}\d{1,5}[A-Z]{0,2}|\d{2,5}"
_UPPER_MONTHS = [m.upper() for m in MONTHS]
_DAY2 = "[0-9OIZSBGLT]"


# ---- cells ------------------------------------------------------------------------------


def label_letters(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(text_of(text)), DIGITS_FOR_LETTERS, LETTERS), "[^A-Z]", "")


def label_key(letters: Column) -> Column:
    """What a label phrase names; null if it is none."""
    return F.coalesce(*[F.when(letters.rlike(f"^({p})$"), key) for key, p in LABELS])


def clock(text: Column) -> Column:
    """``HH:MM`` of a printed time or duration: ``0958Z``, ``1Z11``, ``15:32:25``, ``141228``, ``01+16``; empty if it is none."""
    t = F.regexp_replace(F.upper(text_of(text)), r"\s+", "")
    body = F.regexp_replace(t, "Z$", "")
    seconds = r"^(\w{1,2})[:.](\w{2})[:.](\w{2})$"
    core = F.when(body.rlike(seconds), F.concat(F.regexp_extract(body, seconds, 1), F.regexp_extract(body, seconds, 2))).otherwise(body)
    digits = F.translate(F.regexp_replace(core, "[:.+]", ""), LETTERS_FOR_DIGITS, DIGITS)
    digits = F.when(digits.rlike(r"^\d{6}$") & ~core.rlike("[:.+]"), F.substring(digits, 1, 4)).otherwise(digits)
    full = F.lpad(digits, 4, "0")
    good = ~body.rlike("[A-Z]{3}") & body.rlike(r"^[0-9OQDILTZSBG|:.+]+$") & digits.rlike(r"^\d{3,4}$") & (F.substring(full, 3, 2).try_cast("int") < 60)
    return F.when(good, F.concat(F.substring(full, 1, 2), F.lit(":"), F.substring(full, 3, 2))).otherwise("")


def printed_date(text: Column, day_only: bool = True) -> Column:
    """``2 Sep 22``, ``28 May`` or ``14``, as much as the page prints; empty if it is none."""
    t = F.regexp_replace(F.regexp_replace(F.upper(text_of(text)), r"\s+", ""), r"^[/-](?=\d)", "")
    digits = lambda c: F.translate(c, LETTERS_FOR_DIGITS, DIGITS)
    day = lambda c: F.when(digits(c).try_cast("int").between(1, 31), digits(c).try_cast("int").cast("string"))
    name = lambda c: F.when(c.isin(_UPPER_MONTHS), F.initcap(c))
    glued, slashes, named = rf"^({_DAY2}{{1,2}})([A-Z0-9]{{3}})({_DAY2}{{2}})?$", r"^([0-9OIZS]{1,2})/([0-9OIZS]{1,2})/([0-9OIZS]{2}|[0-9OIZS]{4})$", r"^([0-9OIZS]{1,2})/([A-Z]{3})$"
    part = lambda p, i: F.regexp_extract(t, p, i)
    month = name(F.translate(part(glued, 2), DIGITS_FOR_LETTERS, LETTERS))
    year = digits(part(glued, 3))
    one = F.when(t.rlike(glued) & part(glued, 2).rlike("[A-Z]") & month.isNotNull() & ((year == "") | year.rlike(r"^\d{2}$")) & day(part(glued, 1)).isNotNull(), F.concat_ws(" ", day(part(glued, 1)), month, F.nullif(year, F.lit(""))))
    number = digits(part(slashes, 2)).try_cast("int")
    two = F.when(t.rlike(slashes) & number.between(1, 12), F.concat(day(part(slashes, 1)), F.lit(" "), F.get(F.array(*map(F.lit, MONTHS)), number - 1), F.lit(" "), F.right(digits(part(slashes, 3)), F.lit(2))))
    three = F.when(t.rlike(named), F.concat(day(part(named, 1)), F.lit(" "), name(part(named, 2))))
    four = F.when(t.rlike(r"^\d{1,2}$"), day(t)) if day_only else F.lit(None)
    return F.coalesce(one, two, three, four, F.lit(""))


def fixed_text(text: Column) -> Column:
    """A box's text as words that can be read: dates and gapped times joined, glued labels, airports and pairs of values set apart."""
    months = "|".join(_UPPER_MONTHS)
    s = F.trim(text_of(text))
    s = F.when(s.rlike(r"\d") & s.rlike(r"\s") & s.rlike(r"^[\dOZISB:.\s]+$"), F.regexp_replace(s, r"\s+", "")).otherwise(s)
    s = rewritten(s, rf"(?i)\b\d{{1,2}} (?:{months}) \d{{2}}\b", lambda p: F.upper(F.regexp_replace(p, " ", "")))
    s = rewritten(s, r"\b\d \d[A-Z0-9]{3}[0-9OIZS]{2}\b", lambda p: F.when(printed_date(p, False) != "", F.regexp_replace(p, " ", "")).otherwise(p))
    s = chained(
        s, (r"\b([0-9OIZS]{1,2})/([0-9OIZS]{1,2})/([0-9OIZS]{2,4})\b", "$1⁄$2⁄$3"), (rf"\b([0-9OIZS]{{1,2}})/({months})\b", "$1⁄$2"), (r"([^\s/])/(?=[^\s/])", "$1 / "), ("⁄", "/"), (r"([A-Z0-9]{2,})-(?=[A-Z0-9]{2,})", "$1 - ")
    )
    time, date = r"^([A-Z0-9]*[A-Z][A-Z0-9]*?)(\d{1,2}[:.]\d{2}(?:[:.]\d{2})?Z?|\d{4}Z)$", r"^([A-Z0-9]*?[A-Z][A-Z0-9]*?)([0-3]\d[A-Z0-9]{3}(?:[0-9OIZS]{2})?)$"
    two = lambda w, p: F.concat(F.regexp_extract(w, p, 1), F.lit(" "), F.regexp_extract(w, p, 2))

    def word(w: Column) -> Column:
        flight = w.rlike(date) & F.regexp_extract(w, date, 1).rlike(r"\d") & (printed_date(F.regexp_extract(w, date, 2), False) != "")
        airports = w.rlike("^[A-Z]{8}$") & ~w.isin(WHOLE)
        return F.when(w.rlike(time) & label_letters(F.regexp_extract(w, time, 1)).isin(GLUED), two(w, time)).when(flight, two(w, date)).when(airports, F.concat(F.left(w, F.lit(4)), F.lit(" "), F.right(w, F.lit(4)))).otherwise(w)

    return F.array_join(F.transform(F.split(s, r"\s+"), word), " ")


def info_time(info: Column, name: str) -> Column:
    return F.regexp_extract(text_of(info), rf"(?i)\[{name}:\s*(\d{{1,3}}:\d{{2}})\]", 1)


def info_of(flight: Column, block: Column) -> Column:
    return F.concat_ws(" ", F.when(flight != "", F.concat(F.lit("[Flight: "), flight, F.lit("]"))), F.when(block != "", F.concat(F.lit("[Block: "), block, F.lit("]"))))


def normal_field(field: str, value: Column) -> Column:
    """A field as it is compared."""
    v = F.trim(text_of(value))
    if field == "info":
        return F.concat_ws("|", info_time(v, "Flight"), info_time(v, "Block"))
    read = printed_date(v) if field == "date" else clock(v) if field in TIMES else None
    return F.regexp_replace(F.upper(v), r"\s+", "") if read is None else F.when(read != "", read).otherwise(F.upper(v))


# ---- pages ------------------------------------------------------------------------------


def _label_places(line: pd.DataFrame) -> list[str | None]:
    """Of each word of a line the key of the label phrase that it is part of; the longest phrase of words that stand close wins."""
    sep = line.t.isin(["/", "-"]).tolist()
    words, letters, x, end, height = line.t.tolist(), line.letters.tolist(), line.x.tolist(), (line.x + line.w).tolist(), line.h.tolist()
    can = [s or (len(t) > 1 and re.search("[A-Za-z]", t) is not None and sum(c.isdigit() for c in t) < 2 and ":" not in t[:-1]) for t, s in zip(words, sep)]
    out: list[str | None] = [None] * len(words)
    at = 0
    while at < len(words):
        step = 1
        for n in range(5, 0, -1):
            part = range(at, at + n)
            if sep[at] or at + n > len(words) or sep[at + n - 1] or not all(can[i] for i in part):
                continue
            if any(x[i] - end[i - 1] > 2.5 * max(height[i], 4) for i in part[1:]):
                continue
            phrase = "".join(letters[i] for i in part)
            key = next((k for k, p in LABELS if re.fullmatch(p, phrase)), None)
            if key and (n == 1 or key not in ("outoff", "onin") or "/" in words[at : at + n]):
                out[at : at + n], step = [key] * n, n
                break
        at += step
    return out


def _with_labels(page: pd.DataFrame) -> pd.DataFrame:
    """Words in reading order with key and is_label: the label that a word is part of, or that stands left of it or over it."""
    page = page.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
    page["line"] = (page.y != page.y.shift()).cumsum() - 1
    own = [k for _, line in page.groupby("line", sort=True) for k in _label_places(line)]
    page["key"], page["is_label"] = own, [k is not None for k in own]
    centre, sep = page.x + page.w / 2, page.t.isin(["/", "-"])
    keys = list(own)
    for i in range(len(page)):
        if own[i]:
            continue
        k = i - 1
        while k >= 0 and page.line[k] == page.line[i] and sep[k] and not own[k]:
            k -= 1
        if k >= 0 and page.line[k] == page.line[i] and own[k]:
            keys[i] = own[k]
            continue
        for above in (page.line[i] - 1, page.line[i] - 2):
            over = page[(page.line == above) & page.is_label & ~sep]
            if len(over):
                cover = over[(over.x < page.x[i] + page.w[i]) & (page.x[i] < over.x + over.w)]
                far = (centre[(cover if len(cover) else over).index] - centre[i]).abs()
                best = far.idxmin()
                if len(cover) or far[best] < 6 * max(page.h[i], 4):
                    keys[i] = own[best]
                break
    page["key"] = keys
    return page


def _day_after_flight(page: pd.DataFrame) -> list[int]:
    """Words that stand where a day is printed behind a flight number."""
    out = []
    for i in range(len(page) - 1):
        if page.key[i] in ("flt", "fltroute") and re.fullmatch(FLIGHT, page.t[i]) and page.line[i + 1] == page.line[i]:
            beyond = i + 2 if page.t[i + 1] in ("/", "-") else i + 1
            if beyond < len(page) and page.line[beyond] == page.line[i]:
                out.append(beyond)
    return out


def _values(page: pd.DataFrame, key: str) -> pd.DataFrame:
    """Words under a label; one label may stand for a flight number and a route."""
    meant = (page.key == key) | ((page.key == "fltroute") & (key in ("flt", "route")))
    return page[meant & ~page.is_label]


def _read(page: pd.DataFrame) -> dict[str, str]:
    first = lambda column, rows: next((v for v in rows[column] if v), "")
    found = {k: first("clock", _values(page, k)) for k in TIMES}
    for pair, a, b in (("outoff", "out", "off"), ("onin", "on", "in")):
        both = [v for v in _values(page, pair).clock if v]
        found[a], found[b] = found[a] or "".join(both[:1]), found[b] or "".join(both[1:2])
    airports = lambda key: [t for t in _values(page, key).t if re.fullmatch("[A-Z]{3,4}", t)]
    route, dept, dest = airports("route"), airports("dept"), airports("dest")
    flight = next((t for t in _values(page, "flt").t if re.fullmatch(FLIGHT, t)), "")
    labelled = first("day", _values(page, "date"))
    after = next((page.day[i] for i in _day_after_flight(page) if not page.is_label[i] and page.day[i]), "")
    anywhere = next((d for d, k in zip(page.whole, page.key) if d and k != "other"), "")
    return found | {"flt": flight, "dept": (dept or route or [""])[0], "dest": (dest or route[1:] or dept[1:] or [""])[0], "date": labelled or after or anywhere}


def _prepared(words: DataFrame, key: str) -> DataFrame:
    t = F.col("t")
    return words.select(key, "t", "x", "y", "w", "h", *[c for c in ("field", "box") if c in words.columns], label_letters(t).alias("letters"), clock(t).alias("clock"), printed_date(t).alias("day"), printed_date(t, False).alias("whole"))


def records(words: DataFrame, key: str) -> DataFrame:
    """(key, *FIELDS) of pages by their label words."""

    def run(k: tuple, page: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: k[0], **_read(_with_labels(page))}])

    found = _prepared(words, key).groupBy(key).applyInPandas(run, f"{key} {words.schema[key].dataType.simpleString()}, " + ", ".join(f"`{c}` string" for c in [*TIMES, "flt", "dept", "dest", "date"]))
    return found.withColumn("info", info_of(F.col("flight"), F.col("block"))).select(key, *FIELDS)


def tagged(words: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Words with field: a tag of TAGS, ``O`` or ``?``, from the page's label (key, *FIELDS)."""
    want = {**{f: text_of(F.col(f)) for f in ("flt", "dept", "dest", "out", "off", "on", "in")}, "flight": info_time(F.col("info"), "Flight"), "block": info_time(F.col("info"), "Block"), "adate": printed_date(F.col("date"))}
    plain = lambda c: F.translate(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), LETTERS_FOR_DIGITS, DIGITS)
    wanted = labels.select(key, *[(plain(c) if f in ("flt", "dept", "dest") else c).alias(f"want_{f}") for f, c in want.items()])
    ready = _prepared(words.drop("field"), key).withColumn("plain", plain(F.col("t"))).join(wanted, key, "left")
    covers = {"out": ("outoff",), "off": ("outoff",), "on": ("onin",), "in": ("onin",), "dept": ("route", "fltroute"), "dest": ("route", "fltroute"), "flt": ("fltroute",), "adate": ("date",)}

    def run(k: tuple, page: pd.DataFrame) -> pd.DataFrame:
        page = _with_labels(page)
        field, after = ["O"] * len(page), set(_day_after_flight(page))
        column = {**dict.fromkeys(TIMES, "clock"), "adate": "day"}
        for f in ("out", "off", "on", "in", "block", "flight", "dept", "dest", "flt", "adate"):
            value = page[f"want_{f}"].iloc[0]
            if not value:
                continue
            fits = [kk == f or kk in covers.get(f, ()) or (f == "adate" and i in after) for i, kk in enumerate(page.key)]
            free = [i for i in range(len(page)) if field[i] in ("O", "?")]
            same = [i for i in free if page[column.get(f, "plain")][i] == value]
            pick = next((i for i in same if fits[i]), same[0] if len(same) == 1 and (f != "adate" or re.search("[A-Za-z]", value)) else None)
            if pick is not None:
                field[pick] = f
                continue
            for i in same or [i for i in free if fits[i] and not page.is_label[i]]:
                field[i] = "?" if field[i] == "O" else field[i]
        return page.assign(field=field)[[key, "t", "x", "y", "w", "h", "field"]]

    return ready.groupBy(key).applyInPandas(run, f"{key} {words.schema[key].dataType.simpleString()}, t string, x double, y double, w double, h double, field string")


def assembled(words: DataFrame, key: str) -> DataFrame:
    """(key, *FIELDS) of tagged words: the first readable word of each tag in reading order."""
    t, at = F.col("t"), F.struct("y", "x")
    value = F.when(F.col("field").isin(TIMES), clock(t)).when(F.col("field") == "adate", printed_date(t)).otherwise(t)
    read = words.withColumn("v", value).filter("v <> '' and field not in ('O', '?')")
    first = lambda f: F.coalesce(F.min_by(F.when(F.col("field") == f, F.col("v")), F.when(F.col("field") == f, at)), F.lit(""))
    every = words.select(key).distinct()
    one = every.join(read.groupBy(key).agg(*[first(f).alias(f) for f in TAGS]), key, "left").fillna("", TAGS)
    return one.select(key, *[info_of(F.col("flight"), F.col("block")).alias(f) if f == "info" else F.col("adate" if f == "date" else f).alias(f) for f in FIELDS])
