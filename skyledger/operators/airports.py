"""The airport dimension: built from three public tables, looked up by any code, searched by name.

Defined results: an airport without any code or of another type is left out; a code that none has gives no row; ties
go to the scheduled, then the larger airport, then the first name and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import folded_text
from ..functions.scalars import ROUTE_RADIUS_KM, great_circle, haversine_km
from .relational import keep_first

#: Types of airports that count, largest first; code columns by precedence; a code that rosters use for another airport's.
TYPES = ["large_airport", "medium_airport", "small_airport", "seaplane_base"]
RANKS = ["large", "medium", "small", "seaplane"]
CODES = ["iata", "icao", "faa", "gps", "local", "id", "wmo"]
FIXES = {"FRU": "UCFM"}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, cells as text: quotes doubled, cells over several lines."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)


def latest_stations(stations: DataFrame) -> DataFrame:
    """(icao, wmo): of several stations with one code the one that reported last."""
    usable = stations.withColumn("icao", F.trim("ICAO")).filter("icao rlike '^[A-Z0-9]{4}$' and USAF rlike '^[0-9]{5}0$' and USAF not like '99%'")
    return usable.groupBy("icao").agg(F.max_by(F.substring("USAF", 1, 5), F.struct("END", "USAF")).alias("wmo"))


def airport_dimension(airports: DataFrame, regions: DataFrame, stations: DataFrame) -> DataFrame:
    """The 18 columns of the dimension from the three tables as downloaded (all text)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    icao = F.when(text("icao_code") != "", text("icao_code")).when(text("gps_code").rlike("^[A-Z]{4}$"), text("gps_code")).otherwise("")
    home = F.col("iso_country") == "US"
    coded = airports.filter(F.col("type").isin(TYPES)).withColumn("icao", icao).filter(F.concat("icao", text("iata_code"), text("gps_code"), text("local_code")) != "")
    named = coded.join(regions.select(F.col("code").alias("iso_region"), F.col("name").alias("region")), "iso_region", "left").join(latest_stations(stations), "icao", "left")
    number = lambda c: F.round(F.col(c).try_cast("double"), 5)
    return named.select(
        F.col("ident").alias("id"), "icao", text("iata_code").alias("iata"), F.when(home, text("local_code")).otherwise("").alias("faa"), text("gps_code").alias("gps"), F.when(home, "").otherwise(text("local_code")).alias("local"),
        text("wmo").alias("wmo"), "name", F.regexp_replace("type", "_airport|_base", "").alias("type"), number("latitude_deg").alias("lat"), number("longitude_deg").alias("lon"), F.col("elevation_ft").try_cast("double").alias("elev"),
        text("municipality").alias("city"), text("region").alias("region"), F.col("iso_country").alias("country"), (F.col("scheduled_service") == "yes").alias("scheduled"), text("home_link").alias("web"), text("wikipedia_link").alias("wiki"),
    )


def airport_rank() -> Column:
    """Smaller is better: scheduled ones first, then by size."""
    size = F.array_position(F.array(*map(F.lit, RANKS)), F.col("type"))
    return F.when(F.col("scheduled"), 0).otherwise(10) + F.when(size > 0, size - 1).otherwise(5)


def by_code(dimension: DataFrame) -> DataFrame:
    """(code, matched_by, airport): every code in use with the airport that it means."""
    row = F.struct(*dimension.columns)
    codes = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("matched_by"), F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("code")) for i, c in enumerate(CODES)])
    fixed = [F.struct(F.lit(-1).alias("place"), F.lit("iata").alias("matched_by"), F.when(F.col("icao") == icao, code).otherwise("").alias("code")) for code, icao in FIXES.items()]
    each = dimension.select(airport_rank().alias("rank"), "name", "id", row.alias("airport"), F.inline(F.concat(codes, F.array(*fixed)))).filter("code <> ''")
    return keep_first(each, ["code"], "place", "rank", "name", "id").select("code", "matched_by", "airport")


def looked_up(codes: DataFrame, code: str, dimension: DataFrame) -> DataFrame:
    """codes with matched_by and airport; null where no airport has the code."""
    found = by_code(dimension).withColumnRenamed("code", "__code")
    return codes.withColumn("__code", F.upper(F.trim(F.col(code)))).join(found, "__code", "left").drop("__code")


def searched(dimension: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(place, total, *dimension) of the airports that a query names: those with it as a code first, then those all of whose words
    stand in name, city, region or country, names and cities that begin with the first word before others. Two letters at least for names."""
    q = query.strip()
    exact = F.exists(F.array(*[F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in CODES]), lambda c: c == q.upper()) if q else F.lit(False)
    spark = dimension.sparkSession
    words = spark.range(1).select(F.split(F.trim(folded_text(F.lit(q))), r"\s+").alias("w")).first().w if q else []
    text = folded_text(F.concat_ws(" ", "name", "city", "region", "country"))
    named = F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if len(q) >= 2 else F.lit(False)
    first = F.startswith(folded_text(F.col("name")), F.lit(words[0])) | F.startswith(folded_text(F.col("city")), F.lit(words[0])) if words else F.lit(False)
    hits = dimension.withColumns({"__exact": exact, "__first": F.coalesce(first, F.lit(False)), "__rank": airport_rank()}).filter(F.col("__exact") | named)
    order = [F.desc("__exact"), F.desc(F.when(F.col("__exact"), False).otherwise(F.col("__first"))), "__rank", "name", "id"]
    total = hits.agg(F.count("*").alias("total"))
    best = hits.orderBy(*order).limit(max(1, min(50, limit)))
    numbered = best.withColumn("place", F.row_number().over(W.partitionBy().orderBy(*order)).cast("long"))
    return numbered.join(F.broadcast(total)).select("place", "total", *dimension.columns)  # the total is one row


# ---- routes -----------------------------------------------------------------------------


def routes(flights: DataFrame, places: DataFrame, month: str = "", planned: bool = True) -> DataFrame:
    """(roster, a, b, n, km, directions) of flights (roster, dep, arr, month, planned, count) between places (code, lat, lon).

    Flights to the place that they left, and those with an end that is no place, are left out.
    """
    chosen = flights.filter("dep <> arr").filter(F.lit(not month) | (F.col("month") == month)).filter(F.lit(planned) | ~F.col("planned"))
    pairs = chosen.groupBy("roster", F.least("dep", "arr").alias("a"), F.greatest("dep", "arr").alias("b")).agg(F.sum("count").alias("n"), F.array_sort(F.collect_set(F.concat_ws("-", "dep", "arr"))).alias("directions"))
    end = lambda k: places.select(F.col("code").alias(k), F.col("lat").alias(f"lat_{k}"), F.col("lon").alias(f"lon_{k}"))
    placed = pairs.join(end("a"), "a").join(end("b"), "b")
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), ROUTE_RADIUS_KM)
    return placed.withColumn("km", km).select("roster", "a", "b", "n", "km", "directions", "lat_a", "lon_a", "lat_b", "lon_b")


def unknown_codes(flights: DataFrame, places: DataFrame) -> DataFrame:
    used = flights.select(F.explode(F.array("dep", "arr")).alias("code")).distinct()
    return used.join(places.select("code"), "code", "left_anti")


def pair_totals(found: DataFrame) -> DataFrame:
    """(a, b, n, km, directions, rosters) over all rosters, each with its share; busiest and longest first by these columns."""
    share = F.struct(F.col("roster").alias("name"), F.col("n").alias("flights"))
    out = found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("km").alias("km"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("directions")))).alias("directions"), F.array_sort(F.collect_list(share)).alias("rosters"))
    return out.withColumn("km", F.floor(F.col("km") * 10 + 0.5) / 10)


def route_stats(found: DataFrame) -> DataFrame:
    """One row: flights, routes, places in use and kilometres flown."""
    places = found.select(F.explode(F.array("a", "b")).alias("code")).agg(F.countDistinct("code").alias("airports"))
    sums = found.agg(F.sum("n").alias("flights"), F.countDistinct("a", "b").alias("routes"), (F.floor(F.sum(F.col("km") * F.col("n")) * 10 + 0.5) / 10).alias("km"))
    return sums.join(F.broadcast(places))  # one row each


def route_lines(found: DataFrame, points: int = 65) -> Column:
    """array<array<double>> of a route's great circle, longitude first, four digits."""
    ends = [F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")]
    return F.transform(great_circle(*ends, points), lambda p: F.array(F.round(p["lon"], 4), F.round(p["lat"], 4)))
