"""Night time along a flight: sun altitude, fixed hours, segments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Night begins with the sun this many degrees high.
NIGHT_ALTITUDE = {"civil": -6.0, "nautical": -12.0, "sunset": -0.833}
#: Taxi times in seconds of a flight without take-off or landing time, and the sampling step.
TAXI_OUT, TAXI_IN, STEP = 600, 300, 30


def sun_altitude(epoch, lat, lon, m=F):
    """Degrees, by the low-precision formulae of the Astronomical Almanac; epoch in seconds. Columns, or arrays with numpy as m."""
    days = epoch / 86400.0 - 10957.5
    anomaly = m.radians(357.5291 + 0.98560028 * days)
    centre = m.radians(1.9148 * m.sin(anomaly) + 0.02 * m.sin(2 * anomaly) + 0.0003 * m.sin(3 * anomaly))
    ecliptic = anomaly + centre + math.radians(102.9372) + math.pi
    tilt = math.radians(23.4397)
    declination = m.asin(m.sin(ecliptic) * math.sin(tilt))
    ascension = m.atan2(m.sin(ecliptic) * math.cos(tilt), m.cos(ecliptic))
    hour = m.radians(280.16 + 360.9856235 * days) + m.radians(lon) - ascension
    return m.degrees(m.asin(m.sin(m.radians(lat)) * m.sin(declination) + m.cos(m.radians(lat)) * m.cos(declination) * m.cos(hour)))


def local_minutes(epoch: Column, lon: Column) -> Column:
    """Local mean time, minutes after midnight."""
    return F.pmod(epoch / 60.0 + lon * 4, F.lit(1440.0))


def unwrapped_longitude(lon: Column, before: Column) -> Column:
    """A longitude within 180 degrees of the one before."""
    return F.when(before.isNull(), lon).otherwise(lon + 360 * F.floor((before - lon) / 360 + 0.5))


def fixed_night(minutes, sunrise: int, sunset: int):
    """Night by the clock; the window may pass midnight."""
    return (minutes < sunrise) | (minutes >= sunset) if sunrise < sunset else (minutes >= sunset) & (minutes < sunrise)


def airborne(off: Column, on: Column, takeoff: Column, landing: Column) -> Column:
    """struct<takeoff,landing> in epoch seconds; taxi times stand in for missing ones unless the block is too short for them."""
    up, down = F.coalesce(takeoff, off + TAXI_OUT), F.coalesce(landing, on - TAXI_IN)
    short = (down <= up) & (takeoff.isNull() | landing.isNull())
    return F.struct(F.when(short & takeoff.isNull(), off).otherwise(up).alias("takeoff"), F.when(short & landing.isNull(), on).otherwise(down).alias("landing"))


def _flight_edges(lat1: float, lon1: float, lat2: float, lon2: float, start: int, stop: int, rule: str, sunrise: int, sunset: int) -> tuple[bool, list[int]]:
    ends = np.radians([[lat1, lon1], [lat2, lon2]])
    a, b = np.stack([np.cos(ends[:, 0]) * np.cos(ends[:, 1]), np.cos(ends[:, 0]) * np.sin(ends[:, 1]), np.sin(ends[:, 0])], axis=1)
    angle = np.acos(np.clip(a @ b, -1, 1))

    def night(t: np.ndarray) -> np.ndarray:
        share = ((t - start) / max(stop - start, 1))[:, None]
        p = (1 - share) * a + share * b if angle < 1e-9 else (np.sin((1 - share) * angle) * a + np.sin(share * angle) * b) / np.sin(angle)
        lat, lon = np.degrees(np.atan2(p[:, 2], np.hypot(p[:, 0], p[:, 1]))), np.degrees(np.atan2(p[:, 1], p[:, 0]))
        return fixed_night((t / 60 + lon * 4) % 1440, sunrise, sunset) if rule == "fixed" else sun_altitude(t, lat, lon, np) < NIGHT_ALTITUDE[rule]

    times = np.append(np.arange(start, stop, STEP), stop)
    dark = night(times)
    edges = []
    for i in np.flatnonzero(dark[1:] != dark[:-1]):
        seconds = np.arange(times[i] + 1, times[i + 1] + 1)
        edges.append(int(seconds[np.argmax(night(seconds) == dark[i + 1])]))
    return bool(dark[0]), edges


def night_edges(lat1: Column, lon1: Column, lat2: Column, lon2: Column, start: Column, stop: Column, rule: str = "civil", sunrise: int = 360, sunset: int = 1080) -> Column:
    """struct<first,edges>: whether it is night at the start, and the epoch seconds at which day and night change.

    The flight is looked at every 30 s along the great circle; a change is placed to the
    second. Null where a value is missing or the flight ends before it starts. In numpy: as
    columns every sample would repeat the whole trigonometry, interpreted.
    """

    @F.pandas_udf("struct<first: boolean, edges: array<bigint>>")
    def edges(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, s: pd.Series, e: pd.Series) -> pd.DataFrame:
        flights = [None if any(map(pd.isna, f)) or f[5] < f[4] else _flight_edges(*f[:4], int(f[4]), int(f[5]), rule, sunrise, sunset) for f in zip(a, b, c, d, s, e)]
        return pd.DataFrame({"first": [f and f[0] for f in flights], "edges": [f and f[1] for f in flights]})

    return edges(*[x.cast("double") for x in (lat1, lon1, lat2, lon2)], start.cast("long"), stop.cast("long"))


def night_seconds(found: Column, start: Column, stop: Column) -> Column:
    """Seconds of night between start and stop of night_edges()."""
    acc = F.struct(found["first"].alias("night"), start.alias("t"), F.lit(0).cast("long").alias("s"))
    add = lambda a, t: a["s"] + F.when(a["night"], t - a["t"]).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.concat(found["edges"], F.array(stop)), acc, lambda a, t: F.struct((~a["night"]).alias("night"), t.alias("t"), add(a, t).alias("s")), lambda a: a["s"])


def subsolar_point(epoch, m=F):
    """(lat, lon) in degrees where the sun is overhead; Astronomical Almanac, good to a hundredth of a degree. Columns, or arrays with numpy as m."""
    days = epoch / 86400.0 - 10957.5
    anomaly = m.radians(357.528 + 0.9856003 * days)
    ecliptic = m.radians(280.460 + 0.9856474 * days + 1.915 * m.sin(anomaly) + 0.020 * m.sin(2 * anomaly))
    tilt = m.radians(23.439 - 0.0000004 * days)
    ascension = m.degrees(m.atan2(m.cos(tilt) * m.sin(ecliptic), m.cos(ecliptic)))
    turned = ascension - 280.46061837 - 360.98564736629 * days
    return m.degrees(m.asin(m.sin(tilt) * m.sin(ecliptic))), turned - 360 * m.floor((turned + 180) / 360)


def destination(lat, lon, course, arc, m=F):
    """(lat, lon) of the point ``arc`` degrees away on a course; the longitude goes on from lon and may pass 180."""
    a, c, d = m.radians(lat), m.radians(course), m.radians(arc)
    there = m.asin(m.sin(a) * m.cos(d) + m.cos(a) * m.sin(d) * m.cos(c))
    return m.degrees(there), lon + m.degrees(m.atan2(m.sin(c) * m.sin(d) * m.cos(a), m.cos(d) - m.sin(a) * m.sin(there)))


def night_polygon(epoch: float, altitude: float = 0.0, steps: int = 180) -> list[list[float]]:
    """Ring of [lon, lat] around the part of the Earth where the sun is lower than altitude: a circle around the point opposite the sun.

    Where it holds a pole it is a band from -180 to 180 that is closed along that pole; else longitudes run on and may pass 180.
    """
    lat, lon = subsolar_point(np.float64(epoch), np)
    courses = np.arange(steps + 1) * 360.0 / steps
    lats, lons = destination(-lat, lon + 180.0, courses, 90.0 + altitude, np)
    if 90 - abs(lat) > 90 + altitude:
        return np.stack([np.unwrap(lons, period=360.0), lats], axis=1).tolist()
    around = np.mod(lons[:-1] + 180, 360) - 180
    order = np.argsort(around, kind="stable")
    x, y = around[order], lats[:-1][order]
    gap = x[0] + 360 - x[-1]
    seam = y[-1] + (180 - x[-1]) / gap * (y[0] - y[-1]) if gap > 0 else y[0]
    pole = 90.0 if lat <= 0 else -90.0
    return [[-180.0, float(seam)], *np.stack([x, y], axis=1).tolist(), [180.0, float(seam)], [180.0, pole], [-180.0, pole], [-180.0, float(seam)]]


def fixed_night_band(epoch: float, sunrise: int, sunset: int, lat: float = 89.9) -> list[list[float]]:
    """Ring of [lon, lat] around the longitudes where local mean time lies between sunset and sunrise, in minutes; corners every 2 and 10 degrees."""
    west = ((sunset - epoch / 60 % 1440) / 4 + 540) % 360 - 180
    east = west + (sunrise - sunset) % 1440 / 4
    across, up = np.append(np.arange(west, east, 2.0), east), np.append(np.arange(-lat, lat, 10.0), lat)
    sides = [[[x, -lat] for x in across], [[east, y] for y in up], [[x, lat] for x in across[::-1]], [[west, y] for y in up[::-1]]]
    return [[float(x), float(y)] for side in sides for x, y in side]


def night_rings(times: Column, altitude: float = 0.0) -> Column:
    """array<array<double>>: the night polygon at epoch seconds."""

    @F.pandas_udf("array<array<double>>")
    def rings(t: pd.Series) -> pd.Series:
        return t.map(lambda e: None if pd.isna(e) else night_polygon(float(e), altitude))

    return rings(times.cast("double"))


def inside_ring(ring: list[list[float]], lon: float, lat: float) -> bool:
    """Whether a point lies in a ring, its longitude taken to the ring's own turn."""
    inside = False
    low = min(x for x, _ in ring)
    lon = lon + 360 * math.ceil((low - lon) / 360)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1):
            inside = not inside
    return inside
