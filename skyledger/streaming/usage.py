"""Streams of usage calls: tumbling counters with a watermark, counters merged by batch, idempotent events, jobs followed by their log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir


def tumbling_usage(calls: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    counted = calls.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("requests"))
    return counted.select(F.col("window.start").alias("start"), key, "requests")


def once(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def replayed(spark: SparkSession, path: str, schema, name_glob: str, files: int = 4) -> DataFrame:
    """A folder's files as a stream, at most ``files`` a trigger; what comes later is followed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name_glob).parquet(path)


def written(stream: DataFrame, mode: str, trigger: dict | None = None, folder: str | None = None):
    """(query, folder): a stream whose batches are written to the shared folder, each once: a batch that is run again replaces its own files."""
    out = folder or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batches/batch={number}")

    started = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    return started, f"{out}/batches"


def drained(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an aggregating stream over all that is there; of each key the last update counts. Nothing is held by the driver."""
    query, folder = written(stream, "update")
    query.awaitTermination()
    spark, schema = stream.sparkSession, stream.schema
    updates = spark.read.schema(schema.add("batch", "long")).option("basePath", folder).parquet(f"{folder}/*")
    others = [c for c in stream.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__last")).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in others])


def appended(stream: DataFrame) -> DataFrame:
    """Runs a stream without aggregation over all that is there and reads what it wrote."""
    query, folder = written(stream, "append")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("basePath", folder).parquet(f"{folder}/*").select(*stream.columns)


def merged_counters(stored: DataFrame, batch: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """The stored counters after a micro-batch of increments."""
    return stored.select(*keys, *counters).unionByName(batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def job_events(log: DataFrame, job: str, time: str, now: Column, kept_minutes: int = 30) -> DataFrame:
    """Events of the newest run of each job (job, run, nth, time, type), replayed in order; runs that ended more than half an hour ago are gone."""
    newest = log.groupBy(job).agg(F.max_by("run", F.struct(time, "nth")).alias("run"))
    ended = log.filter("type in ('done', 'error', 'end')").groupBy(job, "run").agg(F.max(time).alias("__end"))
    live = newest.join(ended, [job, "run"], "left").filter(F.col("__end").isNull() | (F.timestamp_diff("MINUTE", F.col("__end"), now) < kept_minutes))
    return log.join(live.select(job, "run"), [job, "run"]).orderBy(job, "nth")


def progress(lines: DataFrame, text: str) -> DataFrame:
    """Log lines with step, done and total where they tell of progress: ``[name] 12/40`` or ``epoch: [3/10]``; and percent."""
    t = F.col(text)
    step, of = r"^\[([^\]]+)\]", r"(\d+)\s*/\s*(\d+)"
    done, total = (F.when(t.rlike(of), F.regexp_extract(t, of, i).try_cast("long")) for i in (1, 2))
    return lines.select("*", F.nullif(F.regexp_extract(t, step, 1), F.lit("")).alias("step"), done.alias("done"), total.alias("total"), F.floor(F.try_divide(done * 100, total)).alias("percent"))
