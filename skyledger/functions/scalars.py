"""Column functions for printed times, durations, codes, tags, hashes and geography; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radii in km, of night time and of the route map.
NIGHT_RADIUS_KM, ROUTE_RADIUS_KM = 6371.0088, 6371.0


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / F.lit(k)


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(round_half_up(part / whole, digits))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the characters of an ASCII text, as a non-negative long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = ROUTE_RADIUS_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def initial_course(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, points: int = 65) -> Column:
    """array<struct<lat,lon>> along the great circle, ends included."""
    d = haversine_km(lat1, lon1, lat2, lon2, 1.0)

    def at(i: Column) -> Column:
        f = i / (points - 1)
        a, b = F.sin((1 - f) * d) / F.sin(d), F.sin(f * d) / F.sin(d)
        x = a * F.cos(F.radians(lat1)) * F.cos(F.radians(lon1)) + b * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2))
        y = a * F.cos(F.radians(lat1)) * F.sin(F.radians(lon1)) + b * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2))
        z = a * F.sin(F.radians(lat1)) + b * F.sin(F.radians(lat2))
        same = d < 1e-12
        return F.struct(F.when(same, lat1).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))).alias("lat"), F.when(same, lon1).otherwise(F.degrees(F.atan2(y, x))).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def hhmm(minutes: Column) -> Column:
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(minutes, F.lit(60)).cast("int").cast("string"), 2, "0"))


def duration_minutes(text: Column) -> Column:
    """Minutes of ``1:05``, ``2h05``, ``12+33``, ``1.5`` (hours) or ``0057``; null if none of these."""
    two = lambda p: F.try_to_number(F.regexp_extract(text, p, 1), F.lit("999999")) * 60 + F.try_to_number(F.regexp_extract(text, p, 2), F.lit("99"))
    pair, packed = r"^\s*(\d{1,4})[:h+](\d{2})\s*$", r"^\s*(\d{2})(\d{2})\s*$"
    return (
        F.when(text.rlike(pair), two(pair)).when(text.rlike(packed), two(packed))
        .when(text.rlike(r"^\s*\d+\.\d+\s*$"), F.floor(F.trim(text).try_cast("double") * 60 + 0.5))
        .cast("long")
    )


def loose_time(text: Column) -> Column:
    """``HH:MM`` of ``601``, ``8:25PM``, ``2259+``; null for impossible ones."""
    raw = F.upper(F.regexp_replace(text, r"[\s+]", ""))
    pattern = r"^(\d{1,2}):?(\d{2})(AM|PM)?$"
    hour = F.regexp_extract(raw, pattern, 1).try_cast("int")
    minute, half = F.regexp_extract(raw, pattern, 2).try_cast("int"), F.regexp_extract(raw, pattern, 3)
    hour = F.when(half == "PM", F.pmod(hour, F.lit(12)) + 12).when(half == "AM", F.pmod(hour, F.lit(12))).otherwise(hour)
    return F.when(raw.rlike(pattern) & (hour <= 24) & (minute <= 59), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))


def bracket_tags(text: Column) -> Column:
    """map of ``[Key: value]`` tags; of a repeated key the last stays."""
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"\[([A-Za-z][\w ]*): ([^\]]*)\]"), F.lit(1)), lambda k: F.trim(k))
    values = F.regexp_extract_all(text, F.lit(r"\[([A-Za-z][\w ]*): ([^\]]*)\]"), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    latest = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(keys, p["i"] + 2, F.greatest(F.size(keys), F.lit(1))), lambda k: k == p["k"]))
    return F.map_from_entries(F.transform(latest, lambda p: F.struct(p["k"], p["v"])))


def shape(text: Column) -> Column:
    """Letters to X or x, digits to 9, runs cut to two."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[A-Z]", "X"), "[a-z]", "x"), "[0-9]", "9")
    return F.regexp_replace(plain, r"(.)\1{2,}", "$1$1")


def one_apart(a: Column, b: Column) -> Column:
    """Same length, exactly one different character."""
    chars = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return (F.length(a) == F.length(b)) & (F.aggregate(chars, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) == 1)


def csv_cell(text: Column) -> Column:
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def add_months_overflowing(day: Column, months: Column) -> Column:
    """A date some months on; a day that the month lacks runs over into the next one."""
    first = F.add_months(F.trunc(day, "month"), months)
    return F.date_add(first, F.dayofmonth(day) - 1)
