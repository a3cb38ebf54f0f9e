"""Folders of files as an index, and JSON records: labels as they are saved, forecasts, payment pages, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import file_kind, is_data_name, is_duty_noise, projected


def object_index(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """(name, path, size, modified, md5) of a folder's files of known types, whatever store the path names; without digest nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select(name.alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.md5("content").alias("md5")] if digest else []))
    return listed.filter(is_data_name(F.col("name")))


def listed(index: DataFrame, kind: str | None = None) -> DataFrame:
    """Names of one kind (image or pdf) or of all, in order."""
    chosen = index if kind is None else index.filter(file_kind(F.col("name")) == kind)
    return chosen.select("name").orderBy("name")


def label_states(index: DataFrame, labels: DataFrame) -> DataFrame:
    """The index with labelled and reviewed; labels: (name, review): one under review is labelled but not reviewed."""
    return index.join(labels.select("name", F.lit(True).alias("__l"), F.col("review").isNull().alias("__r")), "name", "left").withColumns({"labelled": F.coalesce("__l", F.lit(False)), "reviewed": F.coalesce("__r", F.lit(False))}).drop("__l", "__r")


def saved_label(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Label rows as they are stored: exactly the known fields, trimmed."""
    return rows.select(*keys, *projected(rows.columns, fields))


def forecast_days(answers: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row a day of a forecast's parallel arrays: (*keep, day, high, low, code, rain)."""
    daily = F.from_json(text, "daily struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,weather_code:array<int>,precipitation_probability_max:array<int>>")["daily"]
    names = {"time": "day", "temperature_2m_max": "high", "temperature_2m_min": "low", "weather_code": "code", "precipitation_probability_max": "rain"}
    each = F.inline(F.arrays_zip(*[daily[n] for n in names]))
    return answers.select(*keep, each).toDF(*keep, *names.values())


def payment_pages(pages: DataFrame, text: str) -> DataFrame:
    """(tx, state, paid_at, gross, fee, net, currency) of pages of transactions, each once."""
    money = "struct<value:string,currency_code:string>"
    schema = f"transactions array<struct<id:string,status:string,time:string,amount_with_breakdown:struct<gross_amount:{money},fee_amount:{money},net_amount:{money}>>>"
    each = pages.select(F.explode(F.from_json(text, schema)["transactions"]).alias("t"))
    value = lambda c: F.col(f"t.amount_with_breakdown.{c}.value").try_cast("decimal(14,2)")
    return each.select(F.col("t.id").alias("tx"), F.col("t.status").alias("state"), F.col("t.time").alias("paid_at"), value("gross_amount").alias("gross"), value("fee_amount").alias("fee"), F.coalesce(value("net_amount"), value("gross_amount")).alias("net"), F.col("t.amount_with_breakdown.gross_amount.currency_code").alias("currency")).dropDuplicates(["tx"])


def known_duties(config: DataFrame, codes: str) -> DataFrame:
    """A configuration's duty codes without noise, each once, in order."""
    return config.select(F.explode(codes).alias("code")).distinct().filter(~is_duty_noise(F.col("code"))).orderBy("code")


def clamped(rate: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(rate, F.lit(0.0)))), F.lit(0.0))
