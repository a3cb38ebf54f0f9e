"""Writers: calendars, delimited exports, HTML previews, GeoJSON collections, route lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_cell, html_escape


def folded(line: Column, octets: int = 75) -> Column:
    """A calendar line in pieces of at most ``octets`` bytes, never cut inside a character."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(acc: Column, ch: Column) -> Column:
        over = acc["n"] + F.octet_length(ch) > octets
        return F.struct(F.concat(acc["text"], F.when(over, F.lit("\r\n ")).otherwise(F.lit("")), ch).alias("text"), F.when(over, F.octet_length(ch) + 1).otherwise(acc["n"] + F.octet_length(ch)).alias("n"))

    chars = F.filter(F.split(line, ""), lambda c: c != "")
    return F.when(F.octet_length(line) <= octets, line).otherwise(F.aggregate(chars, start, step, lambda acc: acc["text"]))


def _escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def calendar_texts(events: DataFrame, key: str, order: str, stamp: str = "19700101T000000Z", name: str | None = None) -> DataFrame:
    """(key, calendar): the events (uid, start, end, all_day, utc, summary, location, description, kind, tentative) of each key as one iCalendar text.

    A key's events make one text, so a key is one roster. A moment has no end; an event may have a parent.
    """

    def when(prop: str, at: str) -> Column:
        full = F.concat(F.lit(f"{prop}:"), F.date_format(at, "yyyyMMdd'T'HHmm'00'"), F.when(F.col("utc"), F.lit("Z")).otherwise(F.lit("")))
        return F.when(F.col(at).isNull(), None).when(F.col("all_day"), F.concat(F.lit(f"{prop};VALUE=DATE:"), F.date_format(at, "yyyyMMdd"))).otherwise(full)

    text = lambda prop, c: F.when(F.col(c) != "", F.concat(F.lit(f"{prop}:"), _escaped(F.col(c))))
    state = lambda prop, yes, no: F.when(F.col("tentative"), F.lit(f"{prop}:{yes}")).otherwise(F.lit(f"{prop}:{no}"))
    parent = F.when(F.col("parent") != "", F.concat(F.lit("RELATED-TO;RELTYPE=PARENT:"), "parent")) if "parent" in events.columns else F.lit(None).cast("string")
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "uid"), F.lit(f"DTSTAMP:{stamp}"), when("DTSTART", "start"), when("DTEND", "end"), F.when(F.col("all_day"), "TRANSP:TRANSPARENT"), text("SUMMARY", "summary"),
        text("LOCATION", "location"), text("DESCRIPTION", "description"), parent, F.concat(F.lit("X-ROSTER-KIND:"), "kind"), state("CATEGORIES", "Planned", "Published"), state("STATUS", "TENTATIVE", "CONFIRMED"), F.lit("END:VEVENT"),
    )
    event = F.array_join(F.transform(F.filter(lines, lambda x: x.isNotNull()), lambda x: folded(x)), "\r\n")
    listed = events.select(key, F.struct(F.col(order).alias("o"), event.alias("t")).alias("e")).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("e"))
    body = F.array_join(F.transform("e", lambda x: x["t"]), "\r\n")
    head = "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nCALSCALE:GREGORIAN\r\nMETHOD:PUBLISH\r\n"
    titled = F.concat(folded(F.concat(F.lit("X-WR-CALNAME:"), _escaped(F.lit(name)))), F.lit("\r\n")) if name else F.lit("")
    return listed.select(key, F.concat(F.lit(head), titled, body, F.lit("\r\nEND:VCALENDAR\r\n")).alias("calendar"))


def csv_lines(df: DataFrame, *columns: str) -> Column:
    """One delimited line of the columns, quoted where needed."""
    return F.concat_ws(",", *[csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns or df.columns])


def html_row(number: Column, cells: Column) -> Column:
    """A grid's row as a table row, its number first."""
    inside = F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), html_escape(c), F.lit("</td>"))), "")
    return F.concat(F.lit('<tr><td class="n">'), number.cast("string"), F.lit("</td>"), inside, F.lit("</tr>"))


def route_lists(routes: DataFrame, key: str, dep: str = "dep", arr: str = "arr", n: str = "n") -> DataFrame:
    """(key, list): ``AAA-BBB*3,BBB-AAA`` of each key, a route once with its count, by name."""
    counted = routes.groupBy(key, dep, arr).agg(F.sum(n).alias("n"))
    item = F.concat(F.col(dep), F.lit("-"), F.col(arr), F.when(F.col("n") > 1, F.concat(F.lit("*"), F.col("n").cast("string"))).otherwise(F.lit("")))
    return counted.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("list"))


def invoice_file(invoices: DataFrame, columns: list[str], month: str | None = None) -> DataFrame:
    """(line, at): header and rows of an export, at in order; ``month`` (``2025-07``) of paidAt alone. Lines end in CRLF, the file begins with a mark."""
    chosen = invoices if month is None else invoices.filter(F.substring("paidAt", 1, 7) == month)
    end = F.lit("\r\n")
    head = chosen.sparkSession.range(1).select(F.lit(0).alias("at"), F.lit("").alias("number"), F.concat(F.lit("\ufeff"), F.lit(",".join(columns)), end).alias("line"))
    return head.unionByName(chosen.select(F.lit(1).alias("at"), F.col("number"), F.concat(csv_lines(chosen, *columns), end).alias("line"))).orderBy("at", "number").select("line", "at")


def html_tables(rows: DataFrame, key: str, order: str, cells: str) -> DataFrame:
    """(key, html): each grid as one table; a grid is one sheet."""
    width = F.max(F.size(cells)).alias("w")
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cells).alias("c")))).alias("r"), width)
    padded = lambda c: F.concat(c, F.array_repeat(F.lit(""), F.col("w") - F.size(c)))
    body = F.array_join(F.transform("r", lambda x, i: html_row(i + 1, padded(x["c"]))), "")
    return listed.select(key, F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def feature_collection(features: DataFrame, feature: str, order: str) -> DataFrame:
    """One row with the GeoJSON collection of all features; a map for the eye, so its features fit in a row."""
    listed = features.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(feature).alias("f")))).alias("x"))
    return listed.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("x", lambda e: e["f"]), ","), F.lit("]}")).alias("geojson"))


def compact_table(df: DataFrame, order: str, source: str) -> DataFrame:
    """One row of JSON: the column names once, then a row of values each; a published dimension of bounded size."""

    def value(c: str) -> Column:
        wrapped = F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})  # {"v":...}
        return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)

    cells = F.concat(F.lit("["), F.concat_ws(",", *map(value, df.columns)), F.lit("]"))
    listed = df.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cells.alias("r")))).alias("x"))
    names = ",".join(f'"{c}"' for c in df.columns)
    return listed.select(F.concat(F.lit(f'{{"source":"{source}","fields":[{names}],"rows":['), F.array_join(F.transform("x", lambda e: e["r"]), ","), F.lit("]}")).alias("json"))


def write_by(df: DataFrame, path: str, *partition: str) -> None:
    """Appends to a folder by partition: run histories by kind, trash by date, datasets by split."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


def moved_to_trash(store: DataFrame, gone: Column, day: Column, path: str) -> DataFrame:
    """Soft delete: rows that are gone are appended to the trash under their day, and what is left of the store is returned."""
    write_by(store.filter(gone).withColumn("trashed", day), path, "trashed")
    return store.filter(~F.coalesce(gone, F.lit(False)))


def recorded_runs(runs: DataFrame, path: str) -> None:
    """Finished runs (id, kind, stopped, ...) appended to their history by kind; stopped ones are not kept."""
    write_by(runs.filter("not coalesce(stopped, false)").drop("stopped"), path, "kind")


def text_pairs(lines: DataFrame, path: str) -> None:
    """A recognition dataset's lists: (split, image, truth) as tab-separated files, a folder each for train and val."""
    lines.select("split", F.concat_ws("\t", "image", "truth").alias("value")).write.mode("overwrite").partitionBy("split").text(path)
