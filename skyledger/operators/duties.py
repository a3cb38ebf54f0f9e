"""Roster rows as calendar events: duties with what lies inside them, hotel nights and stays, stable uids.

A roster is one document (``key``); its rows come in order (``order``) under ``section`` (published before planned)
with the cells date, duty, dep, arr, begin, end, info and so on, all text.

A duty opens at a timed check-in and holds what follows up to the next check-out; a next check-in, a row on
another clock or one more than 36 hours on ends it before. Without a check-out it ends with its last timed
event, and what follows stands alone. All of it is windows over a roster: the group of a row is the number of
check-ins so far, the row that ends it is the group's first that is no part of it.

Defined results: rows whose date cannot be read are left out; a row without times is all day; a time before the
begin on the same clock is the next day; null cells are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import CHECK_IN, CHECK_OUT, HOTEL, MONTHS, let, text_of
from ..functions.scalars import fnv1a32
from .sequence import sessions

#: Fixed value: minutes after a check-in beyond which nothing belongs to its duty.
LONGEST_DUTY = 36 * 60
#: Cells that a description lists, with their titles.
TITLES = {"dc": "DC", "registration": "Reg", "takeoff": "Takeoff", "landing": "Landing", "ac": "AC", "crew": "Crew", "info": "Info"}
_CELLS = ["date", "day", "duty", "dep", "arr", "begin", "end", *TITLES]


# ---- times ------------------------------------------------------------------------------


def printed_date(text: Column) -> Column:
    """Midnight of ``7 Jan 25`` or ``07 JANUARY 2025`` as a timestamp without zone; null if it is none."""
    pattern = r"^\s*(\d{1,2})\s*([A-Za-z]{3})[A-Za-z]*\.?\s*(\d{2}|\d{4})\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(part(2)))
    year = part(3).try_cast("int") + F.when(F.length(part(3)) == 2, 2000).otherwise(0)
    day = part(1).try_cast("int")
    return F.when(text.rlike(pattern) & (month > 0) & day.between(1, 31), F.date_add(F.make_date(year, month.cast("int"), F.lit(1)), day - 1).cast("timestamp_ntz"))


def printed_time(text: Column) -> Column:
    """struct<minute, utc, days> of ``A02:00 Z +1``, of two times with a slash between the first; null if it is none."""
    first = F.get(F.split(text, "/"), 0)
    pattern = r"(?i)^\s*[AE]?\s*(\d{1,2}):(\d{2})\s*(Z|LB|L|B)?\s*([+-]\s*\d+)?"
    part = lambda i: F.regexp_extract(first, pattern, i)
    hour, minute = part(1).try_cast("int"), part(2).try_cast("int")
    days = F.coalesce(F.regexp_replace(part(4), r"[\s+]", "").try_cast("int"), F.lit(0))
    return F.when(first.rlike(pattern) & (hour <= 24) & (minute <= 59), F.struct((hour * 60 + minute).alias("minute"), F.upper(part(3)).isin("", "Z").alias("utc"), days.alias("days")))


def row_times(date: Column, begin: Column, end: Column) -> Column:
    """struct<all_day, utc, start, stop> of a row; stop is null for a moment, the whole is null without a date."""
    none = F.lit(None).cast("timestamp_ntz")
    made = lambda all_day, utc, start, stop: F.struct(F.lit(all_day).alias("all_day"), utc.alias("utc"), start.alias("start"), stop.alias("stop"))

    def timed(x: Column) -> Column:
        day, b, e = x["day"], x["b"], x["e"]
        at = lambda t: F.timestamp_add("MINUTE", t["minute"] + t["days"] * 1440, day)
        ends = lambda y: made(False, b["utc"], at(b), F.when(y > at(b), y))
        later = F.when((at(e) < at(b)) & (e["days"] == 0), F.timestamp_add("DAY", F.lit(1), at(e))).otherwise(at(e))
        one = made(False, F.coalesce(b["utc"], e["utc"]), F.coalesce(at(b), at(e)), none)
        whole = made(True, F.lit(True), day, F.timestamp_add("DAY", F.lit(1), day))
        return F.when(day.isNull(), None).when(b.isNull() & e.isNull(), whole).when(b.isNotNull() & e.isNotNull() & (b["utc"] == e["utc"]), let(later, ends)).otherwise(one)

    return let(F.struct(printed_date(date).alias("day"), printed_time(begin).alias("b"), printed_time(end).alias("e")), timed)


# ---- rows -------------------------------------------------------------------------------


def _hotel(duty: Column) -> Column:
    bare = (F.col("begin") == "") & (F.col("end") == "") & (F.col("arr") == "")
    return duty.rlike(HOTEL) & (duty.rlike("(?i)^HTL?$") | bare)


def kind_of_row() -> Column:
    route = (F.col("dep") != "") & (F.col("arr") != "") & (F.col("dep") != F.col("arr"))
    return F.when(_hotel(F.col("duty")), "hotel").when(F.col("duty").rlike("(?i)SIM"), "sim").when(route, "flight").otherwise("event")


def _summary() -> Column:
    dep, arr, duty = F.col("dep"), F.col("arr"), F.col("duty")
    route = F.when((dep != "") & (arr != ""), F.concat(dep, F.lit(" → "), arr)).otherwise(F.concat(dep, arr))
    said = F.trim(F.concat_ws(" ", F.when(duty != "", duty), F.when(route != "", route)))
    tag = F.regexp_extract("info", r"^\[([^\]]+)\]", 1)
    return F.when(said != "", said).when(tag != "", tag).otherwise("Roster")


def _description() -> Column:
    on = F.concat(F.when(F.col("section") == "planned", "Planned").otherwise("Published"), F.lit(" · "), "date", F.when(F.col("day") != "", F.concat(F.lit(" ("), "day", F.lit(")"))).otherwise(""))
    or_ = lambda c, other: F.when(F.col(c) != "", F.col(c)).otherwise(other)
    pair = lambda name, a, b, other: F.when((F.col(a) != "") | (F.col(b) != ""), F.concat(F.lit(f"{name}: "), or_(a, other), F.lit(" → "), or_(b, other)))

    def titled(c: str, title: str) -> Column:
        parts = F.regexp_extract_all(F.col(c), F.lit(r"\[([^\]]*)\]"), F.lit(1))
        whole = F.array_join(F.regexp_extract_all(F.col(c), F.lit(r"\[[^\]]*\]"), F.lit(0)), "") == F.trim(F.col(c))
        listed = F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("  "), p)), "\n"))
        return F.when(F.col(c) == "", None).when(whole, listed).otherwise(F.concat(F.lit(f"{title}: "), F.col(c)))

    lines = [on, F.when(F.col("duty") != "", F.concat(F.lit("Duty: "), "duty")), pair("Route", "dep", "arr", "?"), pair("Time", "begin", "end", "–"), *[titled(c, t) for c, t in TITLES.items()]]
    return F.concat_ws("\n", *lines)


def placed_rows(rosters: DataFrame, key: str, order: str) -> DataFrame:
    """(key, ord, section, *cells, t, kind, group, role) of the rows with a date; role: in, out, inside or alone.

    A row inside a duty has the duty's group; all others have none.
    """
    cells = [F.trim(text_of(F.col(c))).alias(c) if c in rosters.columns else F.lit("").alias(c) for c in _CELLS]
    ord_ = F.struct((F.col("section") == "planned").alias("late"), F.col(order).cast("long").alias("row"))
    rows = rosters.select(key, ord_.alias("ord"), "section", *cells)
    rows = rows.withColumns({"t": row_times(F.col("date"), F.col("begin"), F.col("end")), "kind": kind_of_row()}).filter("t is not null")
    timed = ~F.col("t.all_day")
    opens, closes = timed & F.col("duty").rlike(CHECK_IN), timed & F.col("duty").rlike(CHECK_OUT)
    rows = sessions(rows.withColumns({"opens": opens, "closes": closes}), [key], ["ord"], F.col("opens"), "group")
    whole = W.partitionBy(key, "group")
    # an all-day row stands at its day's start, on the duty's clock
    rows = rows.withColumn("ci", F.first(F.when(F.col("opens"), F.col("t")), ignorenulls=True).over(whole.orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    off_clock = timed & (F.col("t.utc") != F.col("ci.utc"))
    minutes = F.timestamp_diff("MINUTE", F.col("ci.start"), F.col("t.start"))
    ends = ~F.col("opens") & (F.col("closes") | off_clock | (minutes > LONGEST_DUTY))
    rows = rows.withColumn("last", F.min(F.when(ends, F.struct("ord", "closes"))).over(whole))
    before = F.col("last").isNull() | (F.col("ord") < F.col("last.ord"))
    child = timed & (F.col("kind") != "hotel") & ~F.col("opens") & before
    rows = rows.withColumns({"shut": F.coalesce(F.col("last.closes"), F.lit(False)), "last_child": F.max(F.when(child, F.col("ord"))).over(whole)})
    inside = (F.col("group") > 0) & before & ~F.col("opens") & (F.col("shut") | (F.col("ord") <= F.col("last_child")))
    role = F.when(F.col("opens"), "in").when(F.col("shut") & (F.col("ord") == F.col("last.ord")), "out").when(inside, "inside").otherwise("alone")
    rows = rows.withColumn("role", F.coalesce(role, F.lit("alone")))
    # what a duty spans: to its check-out, else to the last moment of its timed events
    until = F.coalesce("t.stop", "t.start")
    same = F.col("t.utc") == F.col("ci.utc")
    out = F.max(F.when((F.col("role") == "out") & same & (until >= F.col("ci.start")), until)).over(whole)
    last = F.max(F.when((F.col("role") == "inside") & timed & (F.col("kind") != "hotel") & same, until)).over(whole)
    rows = rows.withColumn("until", F.coalesce(out, last))
    spans = F.coalesce(F.col("until") > F.col("ci.start"), F.lit(False))
    role = F.when(spans, F.col("role")).otherwise("alone")
    return rows.withColumn("role", role).withColumn("group", F.when(role != "alone", F.col("group"))).drop("last", "shut", "last_child", "opens", "closes")


# ---- events -----------------------------------------------------------------------------


def roster_events(rosters: DataFrame, key: str, order: str, name: str = "Roster", domain: str = "skyledger") -> DataFrame:
    """(key, nth, uid, parent, kind, summary, location, description, tentative, all_day, utc, start, end, nights).

    Duties come before what lies inside them; rows without a time inside a duty are named in its description alone.
    """
    rows = placed_rows(rosters, key, order)
    note = (F.col("role") == "inside") & F.col("t.all_day") & (F.col("kind") != "hotel")
    of_row = rows.filter(~note & ~F.col("role").isin("in", "out")).select(
        key, "ord", F.lit(1).alias("level"), "group", F.concat_ws("|", F.lit(name), "section", "date", "duty", "dep", "arr", "begin", "end").alias("identity"), "kind", _summary().alias("summary"),
        F.col("dep").alias("location"), _description().alias("description"), (F.col("section") == "planned").alias("tentative"), "t.all_day", "t.utc", F.col("t.start").alias("start"), F.col("t.stop").alias("end"),
        F.struct("duty", "dep", "info").alias("hotel"),
    )
    events = of_row.unionByName(_duties(rows, key, name))
    nth = F.row_number().over(W.partitionBy(key, "identity").orderBy("ord", "level"))
    uid = F.concat(F.lower(F.lpad(F.hex(fnv1a32(F.col("identity"))), 8, "0")), F.lit("-"), nth.cast("string"), F.lit(f"@{domain}"))
    events = events.withColumn("uid", uid)
    owner = F.max(F.when(F.col("kind") == "duty", F.col("uid"))).over(W.partitionBy(key, "group"))
    events = events.withColumn("parent", F.when(F.col("group").isNotNull() & (F.col("kind") != "duty"), owner))
    told = _listed(stays(nights(events, key), key), key)
    place = F.row_number().over(W.partitionBy(key).orderBy("ord", "level")).cast("long")
    return told.select(key, place.alias("nth"), "uid", "parent", "kind", "summary", "location", "description", "tentative", "all_day", "utc", "start", "end", "nights")


def _duties(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One event for each check-in whose duty spans some time."""
    row = F.struct("ord", *_CELLS, "section", "role", "kind", F.col("t.all_day").alias("all_day"), _summary().alias("said"))
    grouped = rows.filter("group is not null").groupBy(key, "group").agg(F.sort_array(F.collect_list(row)).alias("r"), F.first("ci").alias("ci"), F.first("until").alias("until"))
    only = lambda role: F.get(F.filter("r", lambda x: x["role"] == role), 0)
    legs = F.filter("r", lambda x: (x["role"] == "inside") & ~x["all_day"] & (x["kind"] != "hotel"))
    stops = F.filter(F.flatten(F.transform(legs, lambda x: F.array(x["dep"], x["arr"]))), lambda p: p != "")
    route = F.filter(F.transform(stops, lambda p, i: F.when((i == 0) | (F.get(stops, i - 1) != p), p)), lambda p: p.isNotNull())
    notes = F.transform(F.filter("r", lambda x: (x["role"] == "inside") & x["all_day"] & (x["kind"] != "hotel")), lambda x: x["said"])
    d = grouped.withColumns({"i": only("in"), "o": only("out"), "route": route, "notes": notes, "leg": F.get(legs, 0)["dep"]})
    dep = F.col("i.dep")
    where = F.when(F.size("route") > 1, F.array_join("route", " → ")).when(dep != "", dep).otherwise(F.coalesce(F.get("route", 0), F.lit("")))
    span = F.timestamp_diff("MINUTE", F.col("ci.start"), F.col("until"))
    tail = lambda c: F.when(F.col(c) != "", F.concat(F.lit(" "), c)).otherwise("")
    text = F.concat_ws(
        "\n",
        F.concat(F.when(F.col("i.section") == "planned", "Planned").otherwise("Published"), F.lit(" duty · "), F.floor(span / 60).cast("string"), F.lit("h"), F.lpad((span % 60).cast("string"), 2, "0")),
        F.concat(F.lit("Check-in: "), "i.date", F.lit(" "), "i.begin", tail("i.dep")),
        F.when(F.col("o").isNotNull(), F.concat(F.lit("Check-out: "), "o.date", F.lit(" "), F.when(F.col("o.end") != "", F.col("o.end")).otherwise(F.col("o.begin")), tail("o.arr"))).otherwise("Check-out: (not in the roster: until the last event)"),
        F.lit("{events}"), F.when(F.size("notes") > 0, F.concat(F.lit("Also: "), F.array_join("notes", ", "))), *[F.when(F.col(c) != "", F.concat(F.lit("Info: "), c)) for c in ("i.info", "o.info")],
    )
    identity = F.concat_ws("|", F.lit(name), F.lit("duty"), "i.section", "i.date", "i.begin", "i.dep")
    return d.select(
        key, F.col("i.ord").alias("ord"), F.lit(0).alias("level"), "group", identity.alias("identity"), F.lit("duty").alias("kind"), F.concat(F.lit("Duty"), F.when(where != "", F.concat(F.lit(" "), where)).otherwise("")).alias("summary"),
        F.when(dep != "", dep).otherwise(F.coalesce("leg", F.lit(""))).alias("location"), text.alias("description"), (F.col("i.section") == "planned").alias("tentative"), F.lit(False).alias("all_day"), "ci.utc",
        F.col("ci.start").alias("start"), F.col("until").alias("end"), F.lit(None).cast("struct<duty:string,dep:string,info:string>").alias("hotel"),
    )


def nights(events: DataFrame, key: str) -> DataFrame:
    """Nights in a row in the same hotel as one event, with their number."""
    w = W.partitionBy(key).orderBy("ord", "level")
    before = lambda c: F.lag(c).over(w)
    night = (F.col("kind") == "hotel") & F.col("all_day")
    goes_on = night & before(night) & F.col("parent").eqNullSafe(before("parent")) & (F.col("hotel") == before("hotel")) & (before("end") >= F.col("start"))
    marked = events.withColumn("fresh", ~F.coalesce(goes_on, F.lit(False)))
    marked = sessions(marked, [key], ["ord", "level"], F.col("fresh"), "stay")
    first = [c for c in events.columns if c not in (key, "end")]
    return marked.groupBy(key, "stay").agg(F.min_by(F.struct(*first), F.struct("ord", "level")).alias("e"), F.max("end").alias("end"), F.count("*").alias("nights")).select(key, "e.*", "end", "nights")


def stays(events: DataFrame, key: str) -> DataFrame:
    """All-day hotels from the end of the event before to the start of the next one at their level, where both are near."""
    at = F.struct("ord", "level")
    level = W.partitionBy(key, "parent").orderBy("ord", "level").rowsBetween(W.unboundedPreceding, -1)
    other = F.when(F.col("kind") != "hotel", F.struct("all_day", "utc", F.coalesce("end", "start").alias("until")))
    open_ = events.withColumn("before", F.last(other, ignorenulls=True).over(level))
    hotel = (F.col("kind") == "hotel") & F.col("all_day") & ~F.col("before.all_day") & (F.col("before.until") >= F.timestamp_add("DAY", F.lit(-1), F.col("start")))
    wanted = open_.filter(hotel).select(key, "uid", F.coalesce("parent", F.lit("")).alias("p"), at.alias("at"), "before", F.col("end").alias("leaves"))
    others = events.filter("kind <> 'hotel'").select(key, F.coalesce("parent", F.lit("")).alias("p"), at.alias("on"), F.struct(F.col("all_day").alias("whole"), F.col("utc").alias("clock"), F.col("start").alias("next")).alias("n"))
    fits = F.col("n.whole") | ((F.col("n.clock") == F.col("before.utc")) & (F.col("n.next") > F.col("before.until")))
    found = wanted.join(others, [key, "p"]).filter((F.col("on") > F.col("at")) & fits).groupBy(key, "uid").agg(F.min_by("n", "on").alias("n"), F.first("before").alias("before"), F.first("leaves").alias("leaves"))
    near = found.filter(~F.col("n.whole") & (F.col("n.next") <= F.timestamp_add("DAY", F.lit(1), F.col("leaves")))).select(key, "uid", F.col("before.until").alias("from"), F.col("n.next").alias("to"), F.col("before.utc").alias("clock"))
    said = F.concat("description", F.when(F.col("nights") > 1, F.concat(F.lit("\nNights: "), F.col("nights").cast("string"))).otherwise(""), F.lit("\nFrom the end of the event before to the start of the event after."))
    has = F.col("from").isNotNull()
    new = {"all_day": F.col("all_day") & ~has, "start": F.coalesce("from", "start"), "end": F.coalesce("to", "end"), "utc": F.coalesce("clock", "utc"), "description": F.when(has, said).otherwise(F.col("description"))}
    return events.join(near, [key, "uid"], "left").withColumns(new).drop("from", "to", "clock")


def _listed(events: DataFrame, key: str) -> DataFrame:
    """A duty's description lists its events with their times."""
    clock = lambda c: F.concat(F.date_format(c, "HH:mm"), F.when(F.col("utc"), " Z").otherwise(""))
    when = F.when(F.col("all_day"), "all day").otherwise(F.concat(clock("start"), F.when(F.col("end").isNotNull(), F.concat(F.lit(" → "), clock("end"))).otherwise("")))
    line = F.struct("ord", "level", F.concat(F.lit("  "), when, F.lit("  "), "summary").alias("t"))
    inside = events.filter("parent is not null").groupBy(key, F.col("parent").alias("uid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("inside"))
    listed = F.when(F.col("inside").isNull(), F.replace(F.col("description"), F.lit("{events}\n"), F.lit(""))).otherwise(F.replace(F.col("description"), F.lit("{events}"), F.concat(F.lit("Events:\n"), "inside")))
    text = F.when(F.col("kind") == "duty", F.regexp_replace(listed, r"\n\{events\}$", "")).otherwise(F.col("description"))
    return events.join(inside, [key, "uid"], "left").withColumn("description", text).drop("inside")
