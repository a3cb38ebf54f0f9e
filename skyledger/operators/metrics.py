"""Accuracy roll-ups, medians, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import DOCUMENT_TYPES, extension, file_type
from ..functions.scalars import rate
from .relational import value_ranks, with_zeros


def field_accuracy(pairs: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """matches, total and summed edit distance per field; pairs has p_<field> and e_<field>."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p_{f}").cast("string").alias("p"), F.col(f"e_{f}").cast("string").alias("e")) for f in fields])
    long = pairs.select(*by, F.inline(each))
    p, e = F.coalesce("p", F.lit("")), F.coalesce("e", F.lit(""))
    out = long.groupBy(*by, "field").agg(F.sum((p == e).cast("long")).alias("matches"), F.count("*").alias("total"), F.sum(F.levenshtein(p, e).cast("long")).alias("lev_sum"))
    return out.withColumn("rate", rate(F.col("matches"), F.col("total")))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at floor(n / 2) of the sorted values: the first whose rank passes that."""
    ranks = value_ranks(df, keys, value)
    return ranks.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles between the two values around rank share * (n - 1), with total, top and mean."""
    ranks = value_ranks(df, keys, value).withColumn("__from", F.col("upto") - F.col("n"))

    def at(rank: Column) -> Column:
        return F.min(F.when((F.col("__from") <= rank) & (rank < F.col("upto")), F.col(value)))

    def quantile(p: float) -> Column:
        rank = (F.col("total") - 1) * F.lit(p)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        part = F.max(rank - F.floor(rank))
        return low + (high - low) * part

    return ranks.groupBy(*keys).agg(*[quantile(p).alias(n) for n, p in shares.items()], F.max(value).alias("top"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), F.max("total").alias("n"))


def throughput(calls: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """(*keys, n, seconds, per_second) from the first start to the last end."""
    out = calls.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(stop).cast("double") - F.min(start).cast("double")).alias("seconds"))
    return out.withColumn("per_second", F.try_divide("n", "seconds"))


def storage_stats(files: DataFrame) -> DataFrame:
    """(extension, files, labelled, bytes), and a row without extension for all; files: (name, size, labelled)."""
    out = files.select(extension(F.col("name")).alias("extension"), "size", "labelled")
    return out.groupingSets([[], ["extension"]], "extension").agg(F.count("*").alias("files"), F.count_if("labelled").alias("labelled"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def labelled_by_type(files: DataFrame) -> DataFrame:
    """(type, n) of labelled files, zeros included."""
    types = ["image", *DOCUMENT_TYPES]
    return with_zeros(files.filter("labelled").withColumn("type", file_type(F.col("name"))), "type", types)


def suspect_words(words: DataFrame, file: str, suspect: Column, examples: int = 5) -> DataFrame:
    """(file, words, suspects, examples): how many words of a file look wrong, with the first of them."""
    w = W.partitionBy(file).orderBy("place")
    marked = words.withColumn("__bad", F.coalesce(suspect, F.lit(False))).withColumn("__nth", F.sum(F.col("__bad").cast("int")).over(w))
    shown = F.array_sort(F.collect_list(F.when(F.col("__bad") & (F.col("__nth") <= examples), F.struct("__nth", "t"))))
    return marked.groupBy(file).agg(F.count("*").alias("words"), F.count_if("__bad").alias("suspects"), F.transform(shown, lambda x: x["t"]).alias("examples"))


def inputs_fingerprint(files: DataFrame) -> DataFrame:
    """One row: sha1 over name, label digest and file digest of all files by name."""
    line = F.concat_ws("\t", "name", F.coalesce("label_digest", F.lit("")), F.coalesce("file_digest", F.lit("")))
    return files.groupBy().agg(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("fingerprint"), F.count("*").alias("files"))


def compared_runs(before: DataFrame, after: DataFrame, key: str, right: str, total: str) -> DataFrame:
    """Per file: scores of both runs, a file that failed after counts as 0, and what became of it."""
    b = before.select(key, F.col(right).alias("before_right"), F.col(total).alias("before_total"))
    a = after.select(key, F.col(right).alias("after_right"), F.col(total).alias("after_total"))
    state = F.when(F.col("before_total").isNull(), "new").when(F.col("after_total").isNull(), "failed").when(F.col("after_right") > F.col("before_right"), "better").when(F.col("after_right") < F.col("before_right"), "worse").otherwise("same")
    joined = b.join(a, key, "full_outer").withColumn("state", state)
    return joined.select(key, "before_right", F.coalesce("after_right", F.lit(0)).alias("after_right"), F.coalesce("before_total", "after_total").alias("total"), "state")


def gate(compared: DataFrame, layout: Column, overall: float = 0.005, layout_least: int = 50, layout_share: float = 0.1) -> DataFrame:
    """One row: whether the new run passes; it must not lose over ``overall`` of all rows, nor too much of one layout."""
    old = compared.filter("state <> 'new'").groupBy(layout.alias("layout")).agg(F.sum("before_right").alias("b"), F.sum("after_right").alias("a"), F.sum("total").alias("t"))
    lost = F.max((F.col("b") - F.col("a") > F.greatest(F.lit(layout_least), layout_share * F.col("b"))).cast("int"))
    total = old.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.sum("t").alias("t"), lost.alias("l"))
    return total.select("b", "a", "t", ((F.col("b") - F.col("a") <= overall * F.col("t")) & (F.col("l") == 0)).alias("passes"))
