"""All reference queries by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import sun
from ..operators import accounts, curation, layouts, metrics, relational, scoring, sequence
from ..sources import sinks
from ..sources import text as T
from ..streaming import usage

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- routes: edges, roll-ups, geography -------------------------------------------------


def _legs(spark: SparkSession, sf: str) -> DataFrame:
    nation = lambda k, n: _t(spark, sf, "nation").select(F.col("n_nationkey").alias(k), F.col("n_name").alias(n))
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        lines.join(_t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation("s_nationkey", "dep"), "s_nationkey").join(nation("c_nationkey", "arr"), "c_nationkey").filter("dep <> arr")
    )


_LEGS = """legs AS (SELECT a.n_name AS dep, b.n_name AS arr, a.n_nationkey AS dk, b.n_nationkey AS ak, o_orderdate, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_name <> b.n_name)"""


@_query(f"WITH {_LEGS} SELECT least(dep, arr) AS a, greatest(dep, arr) AS b, count(*) AS n, count(DISTINCT dep) AS dirs FROM legs GROUP BY 1, 2")
def route_rollup(spark, sf):
    return _legs(spark, sf).groupBy(F.least("dep", "arr").alias("a"), F.greatest("dep", "arr").alias("b")).agg(F.count("*").alias("n"), F.countDistinct("dep").alias("dirs"))


@_query(f"WITH {_LEGS}, r AS (SELECT least(dep, arr) AS a, greatest(dep, arr) AS b, count(*) AS n FROM legs GROUP BY 1, 2) SELECT * FROM r ORDER BY n DESC, a, b LIMIT 20")
def route_pairs_top(spark, sf):
    return route_rollup(spark, sf).select("a", "b", "n").orderBy(F.desc("n"), "a", "b").limit(20)


@_query(f"WITH {_LEGS} SELECT strftime(o_orderdate, '%Y-%m') AS month, dep, arr, count(*) AS n FROM legs GROUP BY ALL")
def route_months(spark, sf):
    return _legs(spark, sf).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "dep", "arr").agg(F.count("*").alias("n"))


@_query(f"WITH {_LEGS} SELECT DISTINCT dep AS code FROM legs WHERE dep NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 3)")
def unknown_nodes(spark, sf):
    known = _t(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_name").alias("code"))
    return _legs(spark, sf).select(F.col("dep").alias("code")).distinct().join(known, "code", "left_anti")


def _nodes(spark, sf):
    k = F.col("n_nationkey")
    return _t(spark, sf, "nation").select("n_name", (k * 7 % 140 - 70).cast("double").alias("lat"), (k * 29 % 360 - 180).cast("double").alias("lon"))


_PAIR = "WITH n AS (SELECT n_name, CAST(n_nationkey * 7 % 140 - 70 AS DOUBLE) AS lat, CAST(n_nationkey * 29 % 360 - 180 AS DOUBLE) AS lon FROM nation)"


@_query(f"""{_PAIR} SELECT a.n_name AS a, b.n_name AS b, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS km
 FROM n a JOIN n b ON a.n_name < b.n_name""")
def haversine_km(spark, sf):
    a, b = (_nodes(spark, sf).withColumnsRenamed({"n_name": s, "lat": f"lat_{s}", "lon": f"lon_{s}"}) for s in "ab")
    km = S.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.join(relational.small(b), F.col("a") < F.col("b")).select("a", "b", F.round(km, 3).alias("km"))


@_query(f"""{_PAIR} SELECT a.n_name AS a, b.n_name AS b, round(fmod(degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360, 360), 4) AS course
 FROM n a JOIN n b ON a.n_name < b.n_name""")
def initial_course(spark, sf):
    a, b = (_nodes(spark, sf).withColumnsRenamed({"n_name": s, "lat": f"lat_{s}", "lon": f"lon_{s}"}) for s in "ab")
    return a.join(relational.small(b), F.col("a") < F.col("b")).select("a", "b", F.round(S.initial_course(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 4).alias("course"))


@_query()
def route_geojson(spark, sf):
    """A feature for each route, a line of 65 points, and one for each node in use, a point (b is null)."""
    routes = _legs(spark, sf).groupBy(F.least("dep", "arr").alias("a"), F.greatest("dep", "arr").alias("b")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.struct("dep", "arr"))).alias("dirs"))
    a, b = (_nodes(spark, sf).withColumnsRenamed({"n_name": s, "lat": f"lat_{s}", "lon": f"lon_{s}"}) for s in "ab")
    ends = [F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")]
    line = F.transform(S.great_circle(*ends), lambda p: F.array(F.round(p["lon"], 5), F.round(p["lat"], 5)))
    directions = F.transform("dirs", lambda x: F.concat_ws("-", x["dep"], x["arr"])).alias("directions")
    said = F.struct("a", "b", "n", F.lit("#4a90e2").alias("color"), F.round(S.haversine_km(*ends), 1).alias("distanceKm"), directions)
    feature = lambda kind, at, properties: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), at.alias("coordinates")).alias("geometry"), properties.alias("properties")))
    lines = routes.join(a, "a").join(b, "b").select("a", "b", feature("LineString", line, said).alias("feature"))
    used = routes.select(F.explode(F.array("a", "b")).alias("n_name")).distinct().join(_nodes(spark, sf), "n_name")
    node = F.struct(F.col("n_name").alias("code"), "lat", "lon")
    points = used.select(F.col("n_name").alias("a"), F.lit(None).cast("string").alias("b"), feature("Point", F.array("lon", "lat"), node).alias("feature"))
    return lines.union(points)


# ---- lookups, labels, copies ------------------------------------------------------------


@_query("""WITH k AS (SELECT p_brand AS code, 0 AS priority, p_partkey, p_name FROM part UNION ALL SELECT p_type, 1, p_partkey, p_name FROM part UNION ALL SELECT CAST(p_size AS VARCHAR), 2, p_partkey, p_name FROM part)
 SELECT code, CAST(priority AS BIGINT) AS priority, p_partkey FROM k QUALIFY row_number() OVER (PARTITION BY code ORDER BY priority, p_name, p_partkey) = 1""")
def code_lookup_priority(spark, sf):
    part = _t(spark, sf, "part")
    codes = part.select(F.explode(F.array("p_brand", "p_type", F.col("p_size").cast("string"))).alias("code"))
    found = relational.prioritised_lookup(codes, part, ["p_brand", "p_type", "p_size"], "p_name", "p_partkey")
    return found.select("code", F.col("priority").cast("long").alias("priority"), "p_partkey")


@_query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 'e') ORDER BY starts_with(lower(p_name), 'a') DESC, p_name, p_partkey LIMIT 25")
def name_search_rank(spark, sf):
    folded = F.lower("p_name")
    hit = F.forall(F.split(F.lit("a e"), " "), lambda w: F.contains(folded, w))
    return _t(spark, sf, "part").filter(hit).orderBy(F.desc(F.startswith(folded, F.lit("a"))), "p_name", "p_partkey").limit(25).select("p_partkey", "p_name")


@_query("SELECT source, count(*) AS files, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS unlabelled, count(*) FILTER (l.quality = 0) AS to_review FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def label_tally(spark, sf):
    joined = _t(spark, sf, "documents").select("doc_id", "source").join(_t(spark, sf, "labels").select(F.col("doc_id"), "quality", F.lit(1).alias("hit")), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("files"), F.count("hit").alias("labelled"), (F.count("*") - F.count("hit")).alias("unlabelled"), F.count_if(F.col("quality") == 0).alias("to_review"))


@_query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_docs(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "source").join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@_query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def reviewed_only(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "lang").join(_t(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@_query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest")).groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.sum("doc_id").alias("id_sum")).filter("copies > 1")


@_query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)")
def dedupe_keep_first(spark, sf):
    return _t(spark, sf, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@_query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents WHERE source >= 'src5' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source < 'src5') GROUP BY 2")
def store_dedup_insert(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    return relational.insert_new(docs.filter("source < 'src5'"), docs.filter("source >= 'src5'"), F.col("digest"), "doc_id").select("doc_id", "digest")


@_query("""WITH b AS (SELECT doc_id, md5(text) AS d FROM documents WHERE doc_id % 3 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(lang) ELSE md5(text) END AS d FROM documents WHERE doc_id % 5 <> 0)
 SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.d IS NULL THEN 'added' WHEN a.d IS NULL THEN 'removed' WHEN a.d <> b.d THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id""")
def sync_diff(spark, sf):
    docs = _t(spark, sf, "documents")
    before = docs.filter("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("d"))
    after = docs.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.md5("lang")).otherwise(F.md5("text")).alias("d"))
    return relational.changes(before, after, "doc_id", "d")


_FNV = "list_reduce(list_concat([CAST(2166136261 AS BIGINT)], [CAST(ascii(substr(md5(text), CAST(i AS INT), 1)) AS BIGINT) for i in range(1, 33)]), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


@_query(f"SELECT doc_id, CASE WHEN {_FNV} % 1000 < 800 THEN 'train' ELSE 'val' END AS split FROM documents")
def split_train_val(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", curation.split_of(F.md5("text")).alias("split"))


@_query("SELECT doc_id, CAST(('0x' || substr(md5(text), 1, 2)) AS BIGINT) % 4 = 0 AS in_test FROM documents")
def testset_hash_mod(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", (F.conv(F.substring(F.md5("text"), 1, 2), 16, 10).cast("long") % 4 == 0).alias("in_test"))


@_query("""WITH c0 AS (SELECT lang, source, unnest(string_split(text, ' ')) AS cell FROM documents), c AS (SELECT * FROM c0 WHERE cell <> ''), f AS (SELECT cell, count(*) AS f FROM c GROUP BY cell),
 s AS (SELECT lang, source, round(avg(ln(1 + f)), 6) AS score FROM c JOIN f USING (cell) GROUP BY ALL) SELECT lang, source, score FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, source) = 1""")
def canonical_copy(spark, sf):
    cells = _t(spark, sf, "documents").select("lang", "source", F.explode(F.split("text", " ")).alias("cell"))
    return curation.canonical_copies(cells, "lang", "source", "cell").select("lang", "source", "score")


_LINES = """l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), g AS (SELECT doc_id, list_sort(list(line)) AS items FROM l GROUP BY 1),
 c AS (SELECT items, min(doc_id) AS r, list(doc_id) AS members FROM g GROUP BY 1), m AS (SELECT unnest(members) AS doc_id, r FROM c), i AS (SELECT r, unnest(items) AS line, len(items) AS n FROM c),
 p AS (SELECT x.r AS a, y.r AS b, count(*) AS common, any_value(least(x.n, y.n)) AS n FROM i x JOIN i y ON x.line = y.line AND x.r < y.r GROUP BY 1, 2), q AS (SELECT a, b, common, common / n AS share FROM p WHERE common / n >= 0.5)"""


def _line_sets(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return relational.item_sets(lines, "doc_id", "line")


@_query(f"WITH {_LINES} SELECT a, b, common, share FROM q")
def near_dup_pairs(spark, sf):
    """Pairs of documents that stand for all with the same lines (near_dup_members) and share half of the smaller one's."""
    return relational.set_pairs(_line_sets(spark, sf))


@_query(f"WITH {_LINES} SELECT doc_id, r AS same_lines_as FROM m")
def near_dup_members(spark, sf):
    return relational.set_members(_line_sets(spark, sf)).select(F.col("g").alias("doc_id"), F.col("r").alias("same_lines_as"))


@_query(f"""WITH RECURSIVE {_LINES}, e AS (SELECT a, b FROM q UNION SELECT b, a FROM q), t AS (SELECT r AS node, r AS c FROM c UNION SELECT t.node, e.b FROM t JOIN e ON t.c = e.a),
 k AS (SELECT node, min(c) AS cluster FROM t GROUP BY node) SELECT documents.doc_id AS node, coalesce(cluster, documents.doc_id) AS cluster FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN k ON k.node = m.r""")
def near_dup_clusters(spark, sf):
    """Clusters of documents over near_dup_pairs; documents of the same lines go through the rounds as one, and links stand in for all pairs of a common line."""
    curation.ready_checkpoints(spark)
    sets = _line_sets(spark, sf).checkpoint()
    found = curation.clusters(sets.select(F.col("r").alias("node")), relational.set_links(sets)).withColumnRenamed("node", "r")
    of = relational.set_members(sets).withColumnRenamed("g", "node").join(found, "r").select("node", "cluster")
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("node")).join(of, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


@_query()
def folds(spark, sf):
    return curation.folds(_t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("size")), "source", "size", 5)


@_query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1")
def majority_lang(spark, sf):
    return relational.majority(_t(spark, sf, "documents"), ["source"], "lang")


@_query("SELECT doc_id, source FROM documents QUALIFY (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10 = 0")
def evenly_sampled(spark, sf):
    return sequence.every_nth(_t(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 10)


# ---- accuracy ---------------------------------------------------------------------------


@_query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS d FROM part")
def edit_distance(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("d"))


def _pairs(spark, sf):
    o = _t(spark, sf, "orders")
    p = lambda c, n: F.when(F.col("o_orderkey") % n == 0, F.concat(F.col(c), F.lit("x"))).when(F.col("o_orderkey") % n == 1, F.lit(None)).otherwise(F.col(c))
    return o.select(p("o_orderstatus", 7).alias("p_status"), F.col("o_orderstatus").alias("e_status"), p("o_orderpriority", 11).alias("p_priority"), F.col("o_orderpriority").alias("e_priority"))


_PAIRS = """p AS (SELECT 'status' AS field, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus || 'x' WHEN o_orderkey % 7 = 1 THEN '' ELSE o_orderstatus END AS p, o_orderstatus AS e FROM orders
 UNION ALL SELECT 'priority', CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority || 'x' WHEN o_orderkey % 11 = 1 THEN '' ELSE o_orderpriority END, o_orderpriority FROM orders)"""


@_query(f"WITH {_PAIRS} SELECT field, CAST(count(*) FILTER (p = e) AS BIGINT) AS matches, count(*) AS total, CAST(sum(levenshtein(p, e)) AS BIGINT) AS lev_sum, floor(count(*) FILTER (p = e) / count(*) * 10000 + 0.5) / 10000 AS rate FROM p GROUP BY field")
def field_accuracy(spark, sf):
    return metrics.field_accuracy(_pairs(spark, sf), ["status", "priority"], [])


_READ = """r AS (SELECT 'duty' AS field, CASE WHEN o_orderkey % 7 = 0 THEN 'SBY' || o_orderpriority WHEN o_orderkey % 7 = 1 THEN '' WHEN o_orderkey % 7 = 2 THEN lower(o_orderpriority) ELSE o_orderpriority END AS p, o_orderpriority AS e FROM orders
 UNION ALL SELECT 'dep', CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus || 'XY' WHEN o_orderkey % 11 = 1 THEN '' WHEN o_orderkey % 11 = 2 THEN 'XX' ELSE o_orderstatus END, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderstatus END FROM orders)"""


@_query(f"""WITH {_READ}, k AS (SELECT field, CASE WHEN p = e THEN NULL WHEN e = '' THEN 'missing_expected' WHEN p = '' THEN 'missing_extracted' WHEN field = 'dep' THEN CASE WHEN length(p) <> 3 THEN 'format_mismatch' ELSE 'value_mismatch' END
 WHEN NOT regexp_matches(p, '^(OFF|SBY|RST|FR|DH|A/L|F/D|SIM|TRG|C[0-9]|IDP)') AND length(e) > 2 THEN 'pattern_mismatch' ELSE 'value_mismatch' END AS kind FROM r)
 SELECT field, kind, count(*) AS n, CAST(floor(100 * count(*) / sum(count(*)) OVER (PARTITION BY field) + 0.5) AS BIGINT) AS share, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, kind) AS rank
 FROM k WHERE kind IS NOT NULL GROUP BY field, kind QUALIFY rank <= 3""")
def error_top3(spark, sf):
    o, key = _t(spark, sf, "orders"), F.col("o_orderkey")
    duty = F.when(key % 7 == 0, F.concat(F.lit("SBY"), "o_orderpriority")).when(key % 7 == 1, "").when(key % 7 == 2, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    dep = F.when(key % 11 == 0, F.concat("o_orderstatus", F.lit("XY"))).when(key % 11 == 1, "").when(key % 11 == 2, "XX").otherwise(F.col("o_orderstatus"))
    cells = {"p_duty": duty, "e_duty": F.col("o_orderpriority"), "p_dep": dep, "e_dep": F.when(key % 13 == 0, "").otherwise(F.col("o_orderstatus"))}
    pairs = o.select(F.lit(True).alias("in_read"), F.lit(True).alias("in_label"), *[c.alias(n) for n, c in cells.items()])
    return scoring.error_ranking(pairs, ["duty", "dep"])


@_query("SELECT event_type, CAST(user_id AS VARCHAR) AS kind, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, user_id % 3 AS user_id, value FROM events) GROUP BY GROUPING SETS ((), (event_type), (user_id))")
def benchmark_grouping_sets(spark, sf):
    e = _t(spark, sf, "events").select("event_type", (F.col("user_id") % 3).cast("string").alias("kind"), "value")
    return e.groupingSets([[], ["event_type"], ["kind"]], "event_type", "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_RUNS = """b AS (SELECT doc_id, n_chars % 90 AS br, 100 AS bt FROM documents WHERE doc_id % 4 <> 0), a AS (SELECT doc_id, n_chars % 91 AS ar, 100 AS atot FROM documents WHERE doc_id % 5 <> 0),
 c AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, br, coalesce(ar, 0) AS ar, coalesce(bt, atot) AS t, CASE WHEN bt IS NULL THEN 'new' WHEN atot IS NULL THEN 'failed' WHEN ar > br THEN 'better' WHEN ar < br THEN 'worse' ELSE 'same' END AS state FROM b FULL JOIN a ON a.doc_id = b.doc_id)"""


def _compared(spark, sf):
    d = _t(spark, sf, "documents")
    run = lambda keep, m: d.filter(f"doc_id % {keep} <> 0").select("doc_id", (F.col("n_chars") % m).alias("right"), F.lit(100).cast("long").alias("rows"))
    return metrics.compared_runs(run(4, 90), run(5, 91), "doc_id", "right", "rows")


@_query(f"WITH {_RUNS} SELECT state, count(*) AS n, CAST(coalesce(sum(br), 0) AS BIGINT) AS before_right, CAST(sum(ar) AS BIGINT) AS after_right FROM c GROUP BY state")
def run_compare(spark, sf):
    return _compared(spark, sf).groupBy("state").agg(F.count("*").alias("n"), F.coalesce(F.sum("before_right"), F.lit(0)).alias("before_right"), F.sum("after_right").alias("after_right"))


@_query(f"""WITH {_RUNS}, l AS (SELECT doc_id % 6 AS layout, sum(br) AS b, sum(ar) AS a, sum(t) AS t FROM c WHERE state <> 'new' GROUP BY 1)
 SELECT CAST(sum(b) AS BIGINT) AS b, CAST(sum(a) AS BIGINT) AS a, CAST(sum(t) AS BIGINT) AS t, sum(b) - sum(a) <= 0.005 * sum(t) AND max(CAST(b - a > greatest(50, 0.1 * b) AS INT)) = 0 AS passes FROM l""")
def run_gate(spark, sf):
    return metrics.gate(_compared(spark, sf), F.col("doc_id") % 6)


@_query("SELECT event_type, list_sort(list(value))[CAST(floor(count(value) / 2) AS INT) + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def median_upper(spark, sf):
    return metrics.upper_median(_t(spark, sf, "events"), ["event_type"], "value")


@_query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS top, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def percentiles(spark, sf):
    found = metrics.quantiles(_t(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "top", F.round("mean", 6).alias("mean"))



@_query()
def align_rows(spark, sf):
    """Turns as read against the turns themselves by role and whole text; of the read ones every fifth is lost and every seventh is changed."""
    c = _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    at = F.col("conv_id") + F.col("turn")
    read = c.filter(at % 5 != 0).withColumn("text", F.when(at % 7 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    return sequence.aligned(read, c, "conv_id", "turn", ["role", "text"])


# ---- sequences --------------------------------------------------------------------------

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@_query("SELECT user_id, d AS session, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS d FROM events) WHERE d > 0 GROUP BY ALL")
def duty_sessions(spark, sf):
    s = sequence.sessions(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return s.filter("session > 0").groupBy("user_id", "session").agg(F.count("*").alias("n"))


@_query(f"""WITH m AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) {_W} OR row_number() {_W} = 1 AS fresh FROM events), i AS (SELECT *, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m)
 SELECT user_id, island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island""")
def hotel_islands(spark, sf):
    return sequence.islands(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@_query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_view FROM events")
def carry_forward(spark, sf):
    e = _t(spark, sf, "events").withColumn("v", F.when(F.col("event_type") == "view", F.col("value")))
    return sequence.carried(e, ["user_id"], ["ts", "event_id"], "v", "last_view").select("event_id", "last_view")


@_query(f"SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, lead(event_type) {_W}) AS filled FROM events")
def lead_fill(spark, sf):
    e = _t(spark, sf, "events").withColumn("filled", F.when(F.col("event_type") != "error", F.col("event_type")))
    return sequence.filled_from_next(e, ["user_id"], ["ts", "event_id"], "filled", "event_type").select("event_id", "filled")


@_query(f"""WITH b AS (SELECT *, coalesce(event_id % 31 < lag(event_id % 31) {_W}, false) AS back FROM events) SELECT event_id, CAST(sum(CAST(back AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS months FROM b""")
def day_rollover(spark, sf):
    e = _t(spark, sf, "events").withColumn("day", F.col("event_id") % 31)
    return sequence.rollovers(e, ["user_id"], ["ts", "event_id"], "day", "months").select("event_id", "months")


@_query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events")
def nth_uid(spark, sf):
    return sequence.nth_key(_t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "nth")


@_query("""SELECT e.event_id, max(v.ts) AS nearest_ts FROM events e LEFT JOIN events v ON v.user_id = e.user_id AND v.event_type = 'view' AND v.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id""")
def nearest_prior_event(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = relational.nearest_before(e.filter("event_type = 'purchase'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type"), ["user_id"], "ts", "value")
    return found.select("event_id", "nearest_ts")


@_query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS used, used <= 3 AS admitted FROM events")
def quota_spend(spark, sf):
    e = _t(spark, sf, "events").withColumns({"day": F.to_date("ts"), "at": F.struct("ts", "event_id")})
    return sequence.spend(e, ["user_id", "day"], "at", 3).select("event_id", "used", "admitted")


# ---- billing and usage ------------------------------------------------------------------


@_query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS currency, count(*) AS count, CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(14,2)) END), 0) AS DOUBLE) AS paid,
 CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(14,2)) END), 0) AS DOUBLE) AS refunded, CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice - 1 AS DECIMAL(14,2)) END), 0) AS DOUBLE) AS net FROM orders GROUP BY 1, 2""")
def month_summary(spark, sf):
    o = _t(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "refunded").otherwise("paid")
    invoices = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("paid_at"), F.col("o_orderpriority").alias("currency"), status.alias("status"), F.col("o_totalprice").alias("amount"), (F.col("o_totalprice") - 1).alias("net"))
    return accounts.month_summary(invoices).select("month", "currency", "count", *[F.col(c).cast("double").alias(c) for c in ("paid", "refunded", "net")])



@_query("SELECT count(*) FILTER (o_orderstatus = 'O') AS active, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice / CASE WHEN o_orderpriority LIKE '1%' THEN 12 ELSE 1 END END), 2) AS mrr FROM orders")
def mrr(spark, sf):
    active = F.col("o_orderstatus") == "O"
    price = F.col("o_totalprice") / F.when(F.col("o_orderpriority").startswith("1"), 12).otherwise(1)
    return _t(spark, sf, "orders").agg(F.count_if(active).alias("active"), F.round(F.sum(F.when(active, price)), 2).alias("mrr"))


@_query("SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS requests, count(*) FILTER (event_type = 'view') AS reads FROM events GROUP BY 1, 2")
def usage_by_day(spark, sf):
    return _t(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "view").alias("reads"))


@_query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def hourly_counts(spark, sf):
    return _t(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@_query("SELECT o_custkey, strftime(max(CAST(o_orderdate AS DATE)) + 3, '%Y-%m-%d') AS plan_until, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS plan FROM orders GROUP BY o_custkey")
def plan_until(spark, sf):
    return _t(spark, sf, "orders").groupBy("o_custkey").agg(F.date_format(F.date_add(F.max(F.to_date("o_orderdate")), 3), "yyyy-MM-dd").alias("plan_until"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("plan"))


@_query("SELECT o_orderkey, 'RP-' || strftime(o_orderdate, '%Y') || '-' || lpad(CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 6, '0') AS number FROM orders")
def invoice_numbers(spark, sf):
    numbered = accounts.gapless_numbers(_t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.year("o_orderdate"), F.to_date("o_orderdate"), ["o_orderdate", "o_orderkey"])
    return numbered.select("o_orderkey", F.concat(F.lit("RP-"), F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("number"))



@_query("SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1")
def status_counts_with_zeros(spark, sf):
    return relational.with_zeros(_t(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), "status", ["F", "O", "P", "X"])


@_query("SELECT o_orderkey, strftime(CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + CAST(day(o_orderdate) - 1 AS INT), '%Y-%m-%d') AS next_day FROM orders")
def add_month_overflow(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", F.date_format(S.add_months_overflowing(F.to_date("o_orderdate"), F.lit(1)), "yyyy-MM-dd").alias("next_day"))


@_query("SELECT l_orderkey, l_linenumber, lpad(CAST(CAST(floor(l_quantity * 37 / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(l_quantity * 37 % 60 AS INT) AS VARCHAR), 2, '0') AS block FROM lineitem")
def duration_text(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.hhmm((F.col("l_quantity") * 37).cast("int")).alias("block"))


@_query("SELECT event_id, list_sort(json_keys(props)) AS keys FROM events")
def json_props(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.array_sort(F.json_object_keys("props")).alias("keys"))


@_query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<[a-zA-Z]+')) AS BIGINT) AS tags FROM pages")
def html_tokens(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<[a-zA-Z]+"), F.lit(0))).cast("long").alias("tags"))


@_query("""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_brand, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', '9', 'g'), 'X{3,}', 'XX', 'g'), 'x{3,}', 'xx', 'g'), '9{3,}', '99', 'g') AS shape FROM part""")
def word_shape(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", S.shape(F.col("p_brand")).alias("shape"))


@_query("SELECT vec_id, label, round(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding]), 4) AS norm2 FROM embeddings")
def embedding_norms(spark, sf):
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return _t(spark, sf, "embeddings").select("vec_id", "label", F.round(square, 4).alias("norm2"))


@_query("SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS requests FROM events GROUP BY 1, 2")
def stream_daily_usage(spark, sf):
    """The daily counters as a stream over the folder's file, run to its end."""
    schema = _t(spark, sf, "events").schema
    calls = usage.replayed(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = usage.drained(usage.tumbling_usage(calls, "ts", "user_id"), ["start", "user_id"])
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "user_id", "requests")



# ---- loose text, calendars, layouts, night ----------------------------------------------


@_query("""SELECT doc_id, CASE WHEN length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0E-\\x1F]', '', 'g')) > 0.1 * length(text) THEN 'binary' ELSE 'text' END AS kind,
 CAST(len(string_split_regex(text, '\\r\\n|\\r|\\n')) AS BIGINT) AS lines FROM documents""")
def content_kinds(spark, sf):
    raw = F.col("text").cast("binary")
    return _t(spark, sf, "documents").select("doc_id", T.content_kind(raw).alias("kind"), F.size(T.lines_of(T.decoded(raw))).cast("long").alias("lines"))


@_query("""WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents WHERE text IS NOT NULL),
 k AS (SELECT doc_id, ls, len(list_filter(ls, lambda x: contains(x, chr(9)))) AS tabbed, len(list_filter(ls, lambda x: trim(x) <> '')) AS filled FROM l), r AS (SELECT doc_id, unnest(ls) AS line, filled > 0 AND tabbed >= filled / 2 AS by_tab FROM k),
 c AS (SELECT doc_id, CASE WHEN by_tab THEN list_transform(string_split(line, chr(9)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))
  ELSE regexp_extract_all(list_reduce(string_split(line, chr(9)), lambda s, p: s || repeat(' ', 8 - length(s) % 8) || p), '\\S+(?: \\S+)*') END AS cells FROM r), f AS (SELECT doc_id, len(cells) AS n, len(list_filter(cells, lambda x: x <> '')) > 0 AS hit FROM c)
 SELECT doc_id, count(*) FILTER (hit) AS rows, CAST(coalesce(sum(n) FILTER (hit), 0) AS BIGINT) AS cells FROM f GROUP BY doc_id""")
def fixed_width_grid(spark, sf):
    """Rows and cells of each text's grid, by tabs or by columns."""
    cut = _t(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.filter(T.grid(F.col("text")), lambda r: F.exists(r, lambda c: c != "")).alias("g"))
    size = F.aggregate("g", F.lit(0), lambda s, r: s + F.size(r)).cast("long")
    return cut.select("doc_id", F.size("g").cast("long").alias("rows"), size.alias("cells"))


@_query(f"""WITH {_LEGS}, r AS (SELECT dep AS name, ('N' || lpad(substr(dep, 8), 2, '0')) AS d, ('N' || lpad(substr(arr, 8), 2, '0')) AS a, count(*) AS n FROM legs GROUP BY ALL), s AS (SELECT name, d, a, sum(n) AS n FROM r WHERE d <> a GROUP BY ALL)
 SELECT name, string_agg(d || '-' || a || CASE WHEN n > 1 THEN '*' || CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE '' END, ',' ORDER BY d || '-' || a || CASE WHEN n > 1 THEN '*' || CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE '' END) AS list FROM s GROUP BY name""")
def route_param(spark, sf):
    code = lambda c: F.concat(F.lit("N"), F.lpad(F.substring(c, 8, 9), 2, "0"))
    routes = _legs(spark, sf).select(F.col("dep").alias("name"), code("dep").alias("dep"), code("arr").alias("arr"), F.lit(1).alias("n")).filter("dep <> arr")
    return sinks.route_lists(routes, "name")


@_query(f"""WITH {_LEGS} SELECT dep AS name, ('N' || lpad(substr(dep, 8), 2, '0')) AS dep, ('N' || lpad(substr(arr, 8), 2, '0')) AS arr, count(*) AS n FROM legs WHERE ('N' || lpad(substr(dep, 8), 2, '0')) <> ('N' || lpad(substr(arr, 8), 2, '0')) GROUP BY ALL""")
def route_param_read(spark, sf):
    lists = route_param(spark, sf).select(F.concat_ws("|", "name", F.lit("#4a90e2"), "list").alias("text"))
    return T.routes_of(lists, "text")


def _user_events(spark, sf):
    e = _t(spark, sf, "events")
    text = lambda v: F.lit(v)
    return e.select(
        "user_id", "event_id", F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("uid"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("start"),
        F.timestamp_add("MINUTE", F.lit(90), F.date_trunc("minute", "ts")).cast("timestamp_ntz").alias("end"), F.lit(False).alias("all_day"), F.lit(True).alias("utc"),
        F.concat("event_type", text("; of, "), "props").alias("summary"), F.concat(text("Zürich "), F.col("user_id").cast("string")).alias("location"), F.concat("props", text("\n"), "event_type").alias("description"),
        F.col("event_type").alias("kind"), (F.col("event_id") % 3 == 0).alias("tentative"),
    )


@_query("""SELECT user_id, 'event-' || event_id AS uid, event_type || '; of, ' || props AS summary, 'Zürich ' || user_id AS location, props || chr(10) || event_type AS description, event_type AS kind,
 CASE WHEN event_id % 3 = 0 THEN 'TENTATIVE' ELSE 'CONFIRMED' END AS status, strftime(ts, '%Y-%m-%d %H:%M') AS starts, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS ends FROM events""")
def calendar_round_trip(spark, sf):
    """Events written as one calendar text a user, and read again."""
    texts = sinks.calendar_texts(_user_events(spark, sf), "user_id", "event_id")
    at = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm").alias(n)
    return T.calendar_events(texts, "calendar", "user_id").select("user_id", "uid", "summary", "location", "description", "kind", "status", at("start", "starts"), at("end", "ends"))


@_query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ',' || '"' || o_orderpriority || ', ""' || o_orderstatus || repeat('"', 3) || ',' || strftime(o_orderdate, '%Y-%m-%d') AS line FROM orders""")
def invoice_csv(spark, sf):
    o = _t(spark, sf, "orders").withColumns({"note": F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')), "day": F.date_format("o_orderdate", "yyyy-MM-dd")})
    return o.select("o_orderkey", sinks.csv_lines(o, "o_orderkey", "note", "day").alias("line"))


@_query("""SELECT p_partkey, '<tr><td class="n">' || p_partkey || '</td><td>' || p_name || '</td><td>&lt;' || p_brand || ' &amp; &quot;' || p_type || '&quot;&gt;</td></tr>' AS html FROM part""")
def preview_rows(spark, sf):
    note = F.concat(F.lit("<"), "p_brand", F.lit(' & "'), "p_type", F.lit('">'))
    return _t(spark, sf, "part").select("p_partkey", sinks.html_row(F.col("p_partkey"), F.array("p_name", note)).alias("html"))


@_query("SELECT event_id, round(fmod(fmod(epoch(ts) / 60.0 + (user_id % 360 - 180) * 4, 1440) + 1440, 1440), 3) AS local FROM events")
def local_mean_time(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.round(sun.local_minutes(_epoch("ts"), F.col("user_id") % 360 - 180), 3).alias("local"))


def _epoch(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


@_query("""WITH b AS (SELECT o_orderkey, o_orderkey % 40 * 60 AS block, CASE WHEN o_orderkey % 3 = 0 THEN 700 END AS up, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 40 * 60 - 100 END AS down FROM orders),
 e AS (SELECT *, coalesce(up, 600) AS u, coalesce(down, block - 300) AS d FROM b)
 SELECT o_orderkey, CAST(CASE WHEN d <= u AND up IS NULL THEN 0 ELSE u END AS BIGINT) AS takeoff, CAST(CASE WHEN d <= u AND down IS NULL THEN block ELSE d END AS BIGINT) AS landing FROM e""")
def airborne_times(spark, sf):
    key = F.col("o_orderkey")
    block = key % 40 * 60
    up = sun.airborne(F.lit(0).cast("long"), block, F.when(key % 3 == 0, F.lit(700).cast("long")), F.when(key % 5 == 0, block - 100))
    return _t(spark, sf, "orders").select("o_orderkey", up.alias("up")).select("o_orderkey", "up.*")


@_query()
def night_segments(spark, sf):
    """Night of a flight between every two nations at 800 km/h from noon UTC; trigonometry to the second, so tested on fixtures."""
    a, b = (_nodes(spark, sf).withColumnsRenamed({"n_name": s, "lat": f"lat_{s}", "lon": f"lon_{s}"}) for s in "ab")
    flights = a.join(relational.small(b), F.col("a") < F.col("b"))
    place = [F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")]
    timed = flights.withColumn("start", F.lit(1718452800).cast("long")).withColumn("stop", F.col("start") + 60 + F.floor(S.haversine_km(*place) * 4.5))
    found = timed.withColumn("n", sun.night_edges(*place, F.col("start"), F.col("stop")))
    return found.select("a", "b", (F.col("stop") - F.col("start")).alias("flown_s"), sun.night_seconds(F.col("n"), F.col("start"), F.col("stop")).alias("night_s"), F.size("n.edges").cast("long").alias("changes"))


@_query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, l_quantity FROM lineitem)
 SELECT l_orderkey, l_linenumber, 'utc-crew-legs' AS layout, strftime(d, '%-d %b %y') AS date, strftime(d, '%a') AS day, '[CA - A ' || l_linenumber || '][FO - B]' AS crew, '[Block: ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ']' AS info,
 '10:05 Z' AS begin, '01:30 Z +1' AS "end" FROM s""")
def layout_rows(spark, sf):
    """Line items printed as a crew-leg export, a file an order, and read by their layout."""
    li = _t(spark, sf, "lineitem")
    head = F.array(*map(F.lit, ["departUTC", "arriveUTC", "fltNum", "origin", "destination", "acRegistration", "acType", "crew", "hours"]))
    day = lambda n: F.date_format(F.date_add(F.to_date("l_shipdate"), n), "yyyy-MM-dd")
    number = F.col("l_linenumber").cast("string")
    cells = F.array(F.concat(day(0), F.lit("T10:05")), F.concat(day(1), F.lit("T01:30")), number, F.lit("VIE"), F.lit("PRN"), F.lit(""), F.lit(""), F.concat(F.lit("CA: A "), number, F.lit(" / FO: B")), F.col("l_quantity").cast("int").cast("string"))
    body = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("line"), cells.alias("cells"))
    heads = li.select(F.col("l_orderkey").alias("file")).distinct().select("file", F.lit(0).alias("line"), head.alias("cells"))
    return layouts.schedule_rows(heads.unionByName(body)).select(F.col("file").alias("l_orderkey"), F.col("line").alias("l_linenumber"), "layout", "date", "day", "crew", "info", "begin", "end")


def _all() -> None:
    from . import more  # noqa: F401  (registers its queries here)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
