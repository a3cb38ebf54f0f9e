"""Repairs of rows by their neighbours: missing arrivals, airports a letter apart, one way of writing flights, crew and check-outs of a duty.

Rows (date, duty, dep, begin, end, arr, ...) come in order within a section of a file.

Defined results: empty cells are empty text; what no neighbour settles stays; ties between two spellings stay.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import FLIGHT_DUTY, bracketed_duty, cleaned_duty, spaced_flights, text_of

#: Times of duties that have no others; rows of the home base that settle it.
FIXED_TIMES = {"OFF(Z)": ("00:00 Z", "21:00 Z"), "C19": ("00:00 Z", "23:59 Z")}
BASE_ROWS = 3


def _apart(a: str, b: str) -> bool:
    return len(a) == len(b) == 3 and sum(x != y for x, y in zip(a, b)) == 1


def clean_duties(rows: DataFrame) -> DataFrame:
    """Duties without misreadings and debris, and the times that go with a duty alone."""
    duty = cleaned_duty(bracketed_duty(F.col("duty")))
    fixed = lambda i: F.coalesce(*[F.when(F.col("duty") == d, t[i]) for d, t in FIXED_TIMES.items()], F.lit(""))
    out = rows.withColumn("duty", duty)
    return out.withColumns({c: F.when(text_of(F.col(c)) != "", F.col(c)).otherwise(fixed(i)) for i, c in enumerate(("begin", "end"))})


def missing_arrivals(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An empty arrival of a flight: where the next row of the day leaves from; else, after a leg that came here, where that leg began.

    That leg's own arrival may be one that was filled in here before; it is this row's departure then, and fits.
    """
    w = W.partitionBy(*keys).orderBy(order)
    flight = F.col("duty").rlike(FLIGHT_DUTY)
    at = lambda f, c: f(c).over(w)
    onward = F.when((at(F.lead, "date") == F.col("date")) & (at(F.lead, "dep") != ""), at(F.lead, "dep"))
    # what the row before has after its own turn: its arrival, or this row's departure where it was empty
    came = F.when(at(F.lag, "arr") != "", at(F.lag, "arr")).when(at(F.lag, "flight"), F.col("dep"))
    differ = F.aggregate(F.zip_with(F.split(came, ""), F.split(F.col("dep"), ""), lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    back = F.when((at(F.lag, "date") == F.col("date")) & at(F.lag, "flight") & (at(F.lag, "dep") != "") & (F.col("dep") != "") & (came != "") & (differ <= 1), at(F.lag, "dep"))
    marked = rows.withColumn("flight", flight)
    return marked.withColumn("arr", F.when((F.col("arr") == "") & flight, F.coalesce(onward, back, F.lit(""))).otherwise(F.col("arr"))).drop("flight")


def reconciled_airports(rows: DataFrame, file: str, section: str, order: str) -> DataFrame:
    """Airports of a file that are read one letter apart where they must be the same: the rarer spelling becomes the commoner one.

    They must be the same where a leg ends and the next of the day begins, where a row that is no flight stands (the home base),
    and where a leg comes home on a day that began there. A file is one document.
    """

    def settle(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([section, order], ascending=[False, True], kind="stable").reset_index(drop=True)
        dep, arr, date = p.dep.tolist(), p.arr.tolist(), p.date.tolist()
        flies = [bool(re.match(FLIGHT_DUTY, d)) for d in p.duty]
        seen = Counter(a for pair in zip(dep, arr) for a in pair if a)
        homes = Counter(d for d, f in zip(dep, flies) if d and not f)
        base, n = homes.most_common(1)[0] if homes else ("", 0)
        for i in range(len(p)) if n >= BASE_ROWS else ():
            if not flies[i]:
                dep[i] = base if _apart(dep[i], base) else dep[i]
            elif dep[i] and dep[i] != base and not _apart(dep[i], base) and _apart(arr[i], base) and 4 * seen[arr[i]] <= n:
                first = next(dep[k] for k in range(len(p)) if flies[k] and date[k] == date[i])
                arr[i] = base if first == base else arr[i]
        for i in range(len(p) - 1):
            if p[section][i] == p[section][i + 1] and date[i] == date[i + 1] and _apart(arr[i], dep[i + 1]):
                if seen[arr[i]] > seen[dep[i + 1]]:
                    dep[i + 1] = arr[i]
                elif seen[arr[i]] < seen[dep[i + 1]]:
                    arr[i] = dep[i + 1]
        return p.assign(dep=dep, arr=arr)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(file).applyInPandas(settle, kinds)


def one_flight_style(rows: DataFrame, file: str) -> DataFrame:
    """Flight numbers of a file with the blank after the carrier, or without, as most of them are written; a tie stays."""
    found = F.regexp_extract_all(text_of(F.col("duty")), F.lit(r"\bFR( ?)\d{2,5}[A-Z]?\b"), F.lit(1))
    balance = F.sum(F.aggregate(found, F.lit(0), lambda s, x: s + F.when(x == " ", 1).otherwise(-1))).over(W.partitionBy(file))
    marked = rows.withColumn("__b", balance)
    return marked.withColumn("duty", F.when(F.col("__b") == 0, F.col("duty")).otherwise(spaced_flights(F.col("duty"), F.col("__b") > 0))).drop("__b")


def repaired_rows(rows: DataFrame, file: str, section: str, order: str) -> DataFrame:
    """All repairs, for rows that were read from a picture in any way."""
    filled = missing_arrivals(clean_duties(rows), [file, section], order)
    return one_flight_style(reconciled_airports(filled, file, section, order), file)


def within_duties(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with crew carried to the duty's later flights, check-ins at the next departure, check-outs at the last arrival; of a duty's check-outs the last stays."""
    w = W.partitionBy(*keys).orderBy(order)
    starts = (F.col("duty") == "C/I").cast("int")
    numbered = rows.withColumn("__duty", F.sum(starts).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy(*keys, "__duty").orderBy(order)
    flight = (F.col("dep") != "") & (F.col("arr") != "")
    crew = F.last(F.when(F.col("crew") != "", F.col("crew")), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0))
    leaves = F.first(F.when(flight, F.col("dep")), ignorenulls=True).over(own.rowsBetween(1, W.unboundedFollowing))
    lands = F.last(F.when(flight, F.col("arr")), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    out = F.col("duty") == "C/O"
    last_out = F.max(F.when(out, F.col(order))).over(W.partitionBy(*keys, "__duty"))
    keep = numbered.withColumns({
        "crew": F.when(flight & (F.col("crew") == ""), F.coalesce(crew, F.lit(""))).otherwise(F.col("crew")),
        "dep": F.when((F.col("duty") == "C/I") & (F.col("dep") == ""), F.coalesce(leaves, F.lit(""))).otherwise(F.col("dep")),
        "arr": F.when(out & (F.col("arr") == ""), F.coalesce(lands, F.lit(""))).otherwise(F.col("arr")), "__last": last_out,
    })
    return keep.filter(~out | (F.col(order) == F.col("__last"))).drop("__duty", "__last")


def first_of_day(section: list[str], order: str) -> Column:
    """Whether a row is its date's first in the section."""
    return F.row_number().over(W.partitionBy(*section, "date").orderBy(order)) == 1


def crew_tags(text: Column) -> Column:
    """``NAME - FA,NAME - CA`` as ``[FA - NAME][CA - NAME]``, a list in which every part is a name and a role; else as it is."""
    parts = F.transform(F.split(F.trim(F.regexp_replace(text_of(text), r"\s+", " ")), r"\s*,\s*"), lambda p: F.trim(p))
    filled = F.filter(parts, lambda p: p != "")
    form = r"^(.+?)\s+-\s+([A-Z]{2,4})$"
    tag = lambda p: F.concat(F.lit("["), F.regexp_extract(p, form, 2), F.lit(" - "), F.regexp_extract(p, form, 1), F.lit("]"))
    return F.when((F.size(filled) > 0) & F.forall(filled, lambda p: p.rlike(form)), F.array_join(F.transform(filled, tag), "")).otherwise(F.trim(F.regexp_replace(text_of(text), r"\s+", " ")))


def crew_parts(item: Column) -> Column:
    """Name, number and role of one crew member: the name, and what stands in brackets behind it cut at dashes; else the text cut at spaced dashes."""
    form = r"^\s*(.*?)\((.*)\)\s*$"
    cut = F.concat(F.array(F.regexp_extract(item, form, 1)), F.split(F.regexp_extract(item, form, 2), "-"))
    return F.filter(F.transform(F.when(item.rlike(form), cut).otherwise(F.split(item, r"\s+-\s+")), lambda p: F.trim(p)), lambda p: p != "")
