"""Joins, set operations and keyed selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key, the first by order (give a total one)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def prioritised_lookup(codes: DataFrame, dimension: DataFrame, key_columns: list[str], *order: Column | str) -> DataFrame:
    """Each code with the dimension row that has it in the earliest of key_columns, then first by order."""
    keyed = dimension.select("*", F.posexplode(F.array(*[F.col(c).cast("string") for c in key_columns])).alias("priority", "code")).filter("code is not null")
    return keep_first(codes.select("code").distinct().join(keyed, "code"), ["code"], "priority", *order)


def changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed, changed or same, by a digest of the row."""
    b, a = before.select(key, F.col(digest).alias("b")), after.select(key, F.col(digest).alias("a"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return b.join(a, key, "full_outer").select(key, kind.alias("change"))


def insert_new(store: DataFrame, incoming: DataFrame, digest: Column, order: str) -> DataFrame:
    """Incoming rows whose content the store lacks, one per content."""
    fresh = keep_first(incoming.withColumn("digest", digest), ["digest"], order)
    return fresh.join(store.select(digest.alias("digest")).distinct(), "digest", "left_anti")


def upsert(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The store with incoming rows in place of those with their keys."""
    return store.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value per key; the smaller value wins a tie."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return keep_first(counted, keys, F.desc("n"), value)


def with_zeros(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts per value of a fixed domain, zeros included."""
    every = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def item_sets(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(r, items, members): groups of equal item sets with their least member; items are 128 bits of the items' SHA-256, sorted."""
    digest = F.unhex(F.substring(F.sha2(F.col(item).cast("string").cast("binary"), 256), 1, 32))
    sets = rows.select(F.col(group).alias("g"), digest.alias("i")).groupBy("g").agg(F.sort_array(F.collect_set("i")).alias("items"))
    return sets.groupBy("items").agg(F.min("g").alias("r"), F.sort_array(F.collect_list("g")).alias("members"))


#: Sets that meet at one place of an item, about: the sets that hold an item are dealt over as many places as that takes.
MEETING = 1024


def _shared_items(sets: DataFrame) -> DataFrame:
    """(r, n, ids, x) of item_sets(): their items (f, i) that f sets hold, two at least, the rare ones first, and these alone as ids; n counts all items."""
    items = sets.select("r", F.size("items").alias("n"), F.explode("items").alias("i"))
    often = items.groupBy("i").agg(F.count("*").alias("f")).filter("f > 1")
    held = items.join(often, "i").groupBy("r").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "i"))).alias("x"))
    return held.withColumn("ids", F.transform("x", lambda e: e["i"]))


def _rarest(held: DataFrame, share: float) -> DataFrame:
    """(s, ns, si, f, i): the rarest n - ceil(share * n) + 1 items of each set, of which one is in any set that shares enough; items of no other set are left out."""
    prefix = F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * share - 1e-9)).cast("int") + 1
    among = F.slice("x", 1, F.greatest(F.lit(0), prefix - (F.col("n") - F.size("x"))))
    return held.select(F.col("r").alias("s"), F.col("n").alias("ns"), F.col("ids").alias("si"), F.explode(among).alias("e")).select("s", "ns", "si", "e.f", "e.i")


def _meetings(rarest: DataFrame, held: DataFrame, share: float) -> DataFrame:
    """(a, b, common, share) of the rarest items of sets and all sets that hold them.

    A pair is compared where it meets and kept at its rarest common item, so no pair is shuffled, only the sets' shared items.
    """
    places = lambda f: (F.floor(f / MEETING) + 1).cast("int")
    small = rarest.withColumn("place", F.explode(F.sequence(F.lit(0), places(F.col("f")) - 1))).drop("f")
    large = held.select(F.col("r").alias("l"), F.col("n").alias("nl"), F.col("ids").alias("li"), F.explode("x").alias("e"))
    large = large.select("l", "nl", "li", "e.i", F.pmod(F.xxhash64("l"), places(F.col("e.f"))).cast("int").alias("place"))
    both = F.when(F.size("si") == 1, F.col("si")).otherwise(F.array_intersect("si", "li"))
    met = small.join(large, ["i", "place"]).filter("ns < nl or ns = nl and s < l").select("s", "l", "ns", "i", both.alias("both"))
    found = met.filter((F.get("both", 0) == F.col("i")) & (F.size("both") / F.col("ns") >= share))
    common = F.size("both").cast("long")
    return found.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"), common.alias("common"), (common / F.col("ns")).alias("share"))


def set_pairs(sets: DataFrame, share: float = 0.5) -> DataFrame:
    """(a, b, common, share) of item_sets() that share at least ``share`` of the smaller one's items.

    A smaller set that shares enough has a common item among its rarest n - ceil(share * n) + 1:
    only those meet the other sets that hold them. So an item that very many sets hold makes
    pairs only where it is rare for its own set.
    """
    held = _shared_items(sets)
    return _meetings(_rarest(held, share), held, share)


def set_links(sets: DataFrame, share: float = 0.5) -> DataFrame:
    """(a, b): pairs of set_pairs(), few of them, that tie together what all of them tie together.

    A set for which one common item is enough is a pair with every larger set that holds one of its items. So the least such set of an item
    is linked to all others that hold it, one row each, and two sets with this item need no further link; other items meet as in set_pairs().
    """
    held = _shared_items(sets)
    each = held.select("r", "n", F.explode(F.col("ids")).alias("i"))
    hubs = each.filter(F.lit(1) / F.col("n") >= share).groupBy("i").agg(F.min(F.struct("n", "r")).alias("hub"))
    stars = each.join(hubs, "i").filter("hub.r <> r").select(F.col("hub.r").alias("a"), F.col("r").alias("b"))
    return stars.unionByName(_meetings(_rarest(held, share).join(hubs.select("i"), "i", "left_anti"), held, share).select("a", "b"))


def set_members(sets: DataFrame) -> DataFrame:
    """(g, r): every group with the one that stands for its item set."""
    return sets.select(F.explode("members").alias("g"), "r")


def nearest_before(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its keys at or before its time (as-of join, by union and window)."""
    tagged = left.withColumns({"__side": F.lit(1), "__value": F.lit(None)}).unionByName(right.select(*keys, time, F.lit(0).alias("__side"), F.struct(value, time).alias("__value")), allowMissingColumns=True)
    last = F.last("__value", ignorenulls=True).over(W.partitionBy(*keys).orderBy(time, "__side").rowsBetween(W.unboundedPreceding, 0))
    return tagged.withColumn("__found", last).filter("__side = 1").withColumns({f"nearest_{value}": F.col(f"__found.{value}"), f"nearest_{time}": F.col(f"__found.{time}")}).drop("__side", "__value", "__found")


def nearest_around(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, reach: float, slack: float = 0.0) -> DataFrame:
    """Each left row with the value of the nearest right row at or before it (``slack`` beyond counts as before), else of the nearest behind it, both nearer than reach.

    A union and two windows, so a key's rows are sorted and never paired.
    """
    none = F.lit(None).cast("struct<at:double,value:string>")
    mine = left.withColumns({"__p": F.col(at).cast("double") + slack, "__mine": F.lit(1), "__r": none})
    theirs = right.select(*keys, F.col(at).cast("double").alias("__p"), F.lit(0).alias("__mine"), F.struct(F.col(at).cast("double").alias("at"), F.col(value).cast("string").alias("value")).alias("__r"))
    w = W.partitionBy(*keys)
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumns({
        "__before": F.last("__r", ignorenulls=True).over(w.orderBy("__p", "__mine").rowsBetween(W.unboundedPreceding, 0)), "__behind": F.last("__r", ignorenulls=True).over(w.orderBy(F.desc("__p"), F.desc("__mine")).rowsBetween(W.unboundedPreceding, 0)),
    })
    own = F.col("__p") - slack
    near = lambda c: F.when(F.abs(F.col(f"{c}.at") - own) < reach, F.col(f"{c}.value"))
    found = both.filter("__mine = 1").withColumns({"nearest": F.coalesce(near("__before"), near("__behind")), "is_behind": near("__before").isNull() & near("__behind").isNotNull()})
    return found.select(*left.columns, "nearest", "is_behind")


def anchored_pairs(left: DataFrame, right: DataFrame, keys: list[str], order: str, anchor: str) -> DataFrame:
    """(*keys, left, right): rows of two ordered tables by their orders: those with one anchor, its first on each side and in step with the anchors
    before, and the rows between two anchors one by one where both sides have as many of them."""
    first = lambda df, s: df.filter(F.col(anchor).isNotNull()).groupBy(*keys, anchor).agg(F.min(order).alias(s))
    met = first(left, "left").join(first(right, "right"), [*keys, anchor])
    ahead = F.max("right").over(W.partitionBy(*keys).orderBy("left").rowsBetween(W.unboundedPreceding, -1))
    pairs = met.withColumn("__ahead", ahead).filter(F.col("__ahead").isNull() | (F.col("right") > F.col("__ahead"))).select(*keys, "left", "right")

    def gaps(df: DataFrame, s: str) -> DataFrame:
        marked = df.select(*keys, F.col(order).alias(s)).join(pairs.select(*keys, F.col(s), F.lit(1).alias("__a")), [*keys, s], "left")
        gap = F.coalesce(F.sum("__a").over(W.partitionBy(*keys).orderBy(s).rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
        inside = marked.withColumn("gap", gap).filter("__a is null")
        own = W.partitionBy(*keys, "gap")
        return inside.withColumns({f"n_{s}": F.count("*").over(own), "nth": F.row_number().over(own.orderBy(s))}).select(*keys, "gap", "nth", s, f"n_{s}")

    between = gaps(left, "left").join(gaps(right, "right"), [*keys, "gap", "nth"]).filter("n_left = n_right").select(*keys, "left", "right")
    return pairs.unionByName(between)


def words_in_common(a: DataFrame, b: DataFrame, keys: list[str], word: str) -> DataFrame:
    """(*keys, common): how many words two tables share under a key, each as often as the rarer side has it; keys that share none have no row."""
    counted = lambda df, n: df.groupBy(*keys, word).agg(F.count("*").alias(n))
    both = counted(a, "__a").join(counted(b, "__b"), [*keys, word])
    return both.groupBy(*keys).agg(F.sum(F.least("__a", "__b")).cast("long").alias("common"))


def joined_by_flight(rows: DataFrame, extras: DataFrame, value: str) -> DataFrame:
    """rows (date, duty) with the value that extras (date, flight, value) have for their date and flight, else for their date alone (flight empty)."""
    exact = extras.filter("flight <> ''").groupBy("date", F.col("flight").alias("duty")).agg(F.min(value).alias("__exact"))
    of_day = extras.filter("flight = ''").groupBy("date").agg(F.min(value).alias("__day"))
    return rows.join(exact, ["date", "duty"], "left").join(of_day, "date", "left").withColumn(value, F.coalesce("__exact", "__day")).drop("__exact", "__day")


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A dimension that may be paired with itself or broadcast: more than ``most`` rows are refused."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a dimension of more than {most} rows is not paired with itself")
    return F.broadcast(df)


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, value, n, upto, total): distinct values with their counts, rows up to and including them, and all rows of the key.

    Sums run over the distinct values of a key in blocks of their order, so no key's rows come together in one row or window:
    counts first, then each block's sum, then a window over a block with the sums of the blocks before.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    whole = counted.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("n").alias("total"))
    span = (F.col("__hi") - F.col("__lo")).cast("double")
    block = F.when(span > 0, F.floor((F.col(value) - F.col("__lo")).cast("double") / span * 4096)).otherwise(0).cast("int")
    placed = counted.join(whole, keys).withColumn("__block", block)
    sums = placed.groupBy(*keys, "__block").agg(F.sum("n").alias("__s"))
    before = F.coalesce(F.sum("__s").over(W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = sums.withColumn("__before", before).drop("__s")
    inside = F.sum("n").over(W.partitionBy(*keys, "__block").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("__inside", inside).join(offset, [*keys, "__block"]).select(*keys, value, "n", (F.col("__before") + F.col("__inside")).alias("upto"), "total")
