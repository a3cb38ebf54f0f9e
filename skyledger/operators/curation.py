"""Train and validation splits, clusters of similar groups, canonical copies, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import fnv1a32
from .relational import keep_first
from .storage import ready_checkpoints


def split_of(group_id: Column, ratio: float = 0.8) -> Column:
    """train or val, by a hash of the group's id alone."""
    return F.when(fnv1a32(group_id) % 1000 < int(ratio * 1000 + 0.5), "train").otherwise("val")


def clusters(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, cluster): the least node that pairs (a, b) lead to, by min-label rounds with pointer jumping."""
    ready_checkpoints(nodes.sparkSession)
    edges = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("cluster")).checkpoint()
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("cluster").alias("least"))
        hop = labels.join(near, labels["node"] == near["a"], "left").select("node", "cluster", F.least("cluster", F.coalesce("least", "cluster")).alias("least"))
        jump = hop.join(labels.select(F.col("node").alias("least"), F.col("cluster").alias("root")), "least", "left").select("node", F.least("least", "root").alias("cluster"), (F.least("least", "root") != F.col("cluster")).alias("moved")).checkpoint()
        labels = jump.select("node", "cluster")
        if not jump.filter("moved").take(1):
            return labels


def canonical_copies(cells: DataFrame, group: str, copy: str, cell: str) -> DataFrame:
    """Per group the copy whose cells are the commonest overall: the mean of ln(1 + frequency); ties to the first name.

    Cells are counted by copy first, so that what meets the frequencies are a copy's distinct cells.
    """
    counted = cells.filter(F.col(cell) != "").groupBy(group, copy, cell).agg(F.count("*").alias("n"))
    frequency = counted.groupBy(cell).agg(F.sum("n").alias("f"))
    scored = counted.join(frequency, cell).groupBy(group, copy).agg((F.sum(F.log1p("f") * F.col("n")) / F.sum("n")).alias("score"))
    # a copy without any cell is scored 0
    every = cells.select(group, copy).distinct().join(scored, [group, copy], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    return keep_first(every, [group], F.desc("score"), copy)


def conflicts(rows: DataFrame, chosen: DataFrame, group: str, copy: str, place: str, digest: str) -> DataFrame:
    """(group, copies, chosen, differing) of groups whose copies disagree: rows at one place that differ from the chosen copy's, or that one of both lacks.

    rows: (group, copy, place, digest); chosen: (group, copy).
    """
    best = chosen.select(group, F.col(copy).alias("__best"))
    others = rows.select(group, copy).distinct().join(best, group).filter(F.col(copy) != F.col("__best"))
    mine = others.join(rows.select(group, copy, place, F.col(digest).alias("__mine")), [group, copy])
    theirs = others.join(rows.select(group, F.col(copy).alias("__best"), place, F.col(digest).alias("__theirs")), [group, "__best"])
    both = mine.join(theirs, [group, copy, "__best", place], "full_outer").filter(~F.col("__mine").eqNullSafe(F.col("__theirs")))
    differing = both.groupBy(group).agg(F.count("*").alias("differing"))
    copies = rows.groupBy(group).agg(F.array_sort(F.collect_set(copy)).alias("copies"))
    return differing.join(copies, group).join(best, group).select(group, "copies", F.col("__best").alias("chosen"), "differing")


def content_groups(files: DataFrame, digest: str, name: str) -> DataFrame:
    """(digest, members): files of one content, by name."""
    return files.groupBy(digest).agg(F.array_sort(F.collect_list(name)).alias("members"))


def unseen_tests(hashes: DataFrame, seen: DataFrame, least: int) -> DataFrame:
    """hashes with is_test: of those not seen before, where there are ``least`` of them, a quarter by their first two digits; where none of these fits, the first quarter."""
    fresh = hashes.join(seen.select("hash").withColumn("__seen", F.lit(True)), "hash", "left").withColumn("fresh", F.col("__seen").isNull()).drop("__seen")
    fourth = F.conv(F.substring("hash", 1, 2), 16, 10).cast("long") % 4 == 0
    sums = fresh.agg(F.count_if("fresh").alias("__n"), F.count_if(F.col("fresh") & fourth).alias("__hit"))
    place = F.row_number().over(W.partitionBy("fresh").orderBy("hash"))
    chosen = F.when(F.col("__hit") > 0, fourth).otherwise(place <= F.ceil(F.col("__n") / 4))
    return fresh.join(F.broadcast(sums)).withColumn("is_test", F.col("fresh") & (F.col("__n") >= least) & chosen).drop("__n", "__hit")  # one row of sums


def set_key(hashes: DataFrame, by: list[str], digest: str) -> DataFrame:
    """(*by, fingerprint) of a set whatever its order: a run over the same inputs is found by it."""
    return hashes.groupBy(*by).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(digest)), ",")).alias("fingerprint"))


# ---- votes ------------------------------------------------------------------------------


def merged_votes(*votes: DataFrame) -> DataFrame:
    """(part, key, answer, n) of several tables of votes together; ``first`` orders answers by when they came first."""
    every = votes[0].select("part", "key", "answer", "n", "first")
    for v in votes[1:]:
        every = every.unionByName(v.select("part", "key", "answer", "n", "first"))
    return every.groupBy("part", "key", "answer").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def conventions(votes: DataFrame, least: int = 1) -> DataFrame:
    """(part, key, answer): the answer with the most votes, of equal ones that which came first; below ``least`` votes none."""
    return keep_first(votes.filter(F.col("n") >= least), ["part", "key"], F.desc("n"), "first").select("part", "key", "answer")


def leave_one_out(votes: DataFrame, file: str) -> DataFrame:
    """(file, part, key, answer): what all other files agree on, from votes (file, part, key, answer, n, first): sums less the file's own."""
    total = votes.groupBy("part", "key", "answer").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    asked = votes.select(file, "part", "key").distinct()
    own = votes.groupBy(file, "part", "key", "answer").agg(F.sum("n").alias("own"))
    left = asked.join(total, ["part", "key"]).join(own, [file, "part", "key", "answer"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).filter("n > 0")
    return keep_first(left, [file, "part", "key"], F.desc("n"), "first").select(file, "part", "key", "answer")


def balanced_weights(df: DataFrame, by: str, most: float = 100.0) -> DataFrame:
    """df with weight: rows / (classes * rows of the class), capped."""
    counted = df.groupBy(by).agg(F.count("*").alias("__n"))
    sums = counted.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    weight = F.least(F.lit(most), F.col("__all") / (F.col("__k") * F.col("__n")))
    return df.join(counted.join(F.broadcast(sums)).select(by, weight.alias("weight")), by)  # one row of sums


def layout_weights(df: DataFrame, by: str) -> DataFrame:
    """df with weight: a class of n rows weighs as much as sqrt(n) of them, the mean over all rows being 1."""
    counted = df.groupBy(by).agg(F.count("*").alias("__n"))
    mean = counted.agg((F.sum(F.sqrt("__n")) / F.sum("__n")).alias("__m"))
    return df.join(counted.join(F.broadcast(mean)).select(by, (F.sqrt("__n") / F.col("__n") / F.col("__m")).alias("weight")), by)  # one row


def cross_folds(df: DataFrame, fold: str, k: int, fit, score) -> DataFrame:
    """Scores of k models, each fitted to all folds but one and applied to that one; fit(train) gives a model, score(model, test) a table."""
    found = None
    for f in range(k):
        part = score(fit(df.filter(F.col(fold) != f)), df.filter(F.col(fold) == f)).withColumn("fold", F.lit(f))
        found = part if found is None else found.unionByName(part)
    return found


def folds(sizes: DataFrame, key: str, size: str, k: int) -> DataFrame:
    """(key, size, fold): largest first to the least loaded fold, the first on ties.

    Clusters of one size are dealt as a block: a fold over one row of (size, count), of which a table of n documents has
    fewer than sqrt(2n); single clusters are numbered within their size and take the block's folds in turn.
    """
    hashed = sizes.select(F.col(key).alias("key"), F.col(size).alias("size"), fnv1a32(F.md5(F.col(key).cast("string"))).alias("h"))
    classes = hashed.groupBy("size").agg(F.count("*").alias("n"))
    listed = classes.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "n"))).alias("c"))

    def step(acc: Column, c: Column) -> Column:
        """The loads after dealing n clusters of one size, and each fold's clusters of it as the loads at which they are taken."""
        size_ = -c["less"]
        # a cluster goes to the fold where load + size * taken is least: the n least of all such numbers
        most = F.greatest(F.lit(0), F.ceil(c["n"] / k) + F.ceil((F.array_max(acc["loads"]) - F.array_min(acc["loads"])) / F.greatest(size_, F.lit(1))))
        offers = F.flatten(F.transform(acc["loads"], lambda load, f: F.transform(F.sequence(F.lit(0).cast("long"), most.cast("long")), lambda t: F.struct((load + size_ * t).alias("at"), f.alias("f")))))
        taken = F.slice(F.sort_array(offers), 1, c["n"].cast("int"))

        def dealt(x: Column) -> Column:
            loads = F.transform(acc["loads"], lambda load, f: load + size_ * F.size(F.filter(x, lambda o: o["f"] == f)))
            return F.struct(loads.alias("loads"), F.concat(acc["out"], F.transform(x, lambda o, i: F.struct(size_.alias("size"), (i + 1).cast("long").alias("nth"), o["f"].alias("fold")))).alias("out"))

        return F.transform(F.array(taken), dealt)[0]

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("loads"), F.expr("cast(array() as array<struct<size:bigint,nth:bigint,fold:int>>)").alias("out"))
    dealt = listed.select(F.inline(F.aggregate("c", start, step)["out"]))
    nth = F.row_number().over(W.partitionBy("size").orderBy("h", "key")).cast("long")
    return hashed.withColumn("nth", nth).join(dealt, ["size", "nth"]).select(F.col("key").alias(key), "size", "fold")
