"""Reference operators on small fixtures, and query twins against DuckDB."""

import json
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.functions import scalars
from skyledger.operators import curation, relational, sequence
from skyledger.plans import catalog

SF = "/root/testdata/sf0.001"


def shown(x):
    if hasattr(x, "__len__") and not isinstance(x, str):
        return str(list(x))
    if x is None or x is pd.NA or x != x:
        return ""
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def values(frame):
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert values(catalog.queries()[name](spark, SF).toPandas()) == values(duck.execute(catalog.oracle_sql()[name]).df())


def test_times_and_distances(spark):
    row = spark.range(1).select(
        scalars.loose_time(F.lit("601")).alias("a"), scalars.loose_time(F.lit("8:25PM")).alias("b"), scalars.loose_time(F.lit("2259+")).alias("c"), scalars.loose_time(F.lit("9959")).alias("d"),
        scalars.duration_minutes(F.lit("2h05")).alias("e"), scalars.duration_minutes(F.lit("12+33")).alias("f"), scalars.duration_minutes(F.lit("0057")).alias("g"), scalars.duration_minutes(F.lit("1.5")).alias("h"),
        scalars.haversine_km(F.lit(51.4706), F.lit(-0.461941), F.lit(40.639801), F.lit(-73.7789)).alias("km"), scalars.one_apart(F.lit("ABC"), F.lit("ABD")).alias("one"),
    ).first()
    assert tuple(row)[:8] == ("06:01", "20:25", "22:59", None, 125, 753, 57, 90)
    assert abs(row.km - 5540) < 10 and row.one


def test_alignment_is_least_cost():
    def cost(pairs, a, b, gap):
        return sum(gap if i is None or j is None else sum(x != y for x, y in zip(a[i], b[j])) for i, j in pairs)

    def best(a, b, gap):
        if not a or not b:
            return gap * (len(a) + len(b))
        return min(best(a[1:], b[1:], gap) + sum(x != y for x, y in zip(a[0], b[0])), best(a[1:], b, gap) + gap, best(a, b[1:], gap) + gap)

    rng = random.Random(3)
    for _ in range(60):
        a, b = ([(rng.choice("xy"), rng.choice("pq")) for _ in range(rng.randint(0, 5))] for _ in range(2))
        pairs = sequence.align(a, b, 2)
        assert cost(pairs, a, b, 2) == best(a, b, 2)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a)))
        assert [j for _, j in pairs if j is not None] == list(range(len(b)))


def test_folds_and_upsert(spark):
    sizes = spark.createDataFrame([(k, n) for k, n in zip("abcdef", (9, 7, 5, 4, 3, 2))], "k string, n long")
    loads = {}
    for r in curation.folds(sizes, "k", "n", 2).collect():
        loads[r.fold] = loads.get(r.fold, 0) + r.size
    assert sorted(loads.values()) == [15, 15]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


@pytest.fixture()
def folder(spark, tmp_path):
    """A table folder of its own: folder({table: (rows, schema)})."""

    def put(tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_near_dups_take_short_lines(spark, folder):
    rng = random.Random(3)
    short = ["Of.", "Les.", "", "a", "b", "c"]
    texts = ["Of.", "Of.", "Of.\nOf.", "Les.\nOf.", "z", None, ""] + ["\n".join(rng.choice(short + [f"a line of its own, number {rng.randint(0, 25)}"] * 2) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    sf = folder({"documents": (list(enumerate(texts)), "doc_id long, text string")})
    sets = {i: set(t.split("\n")) for i, t in enumerate(texts) if t is not None}
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= min(len(sets[a]), len(sets[b]))}
    stands = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {r.doc_id: r.same_lines_as for r in catalog.queries()["near_dup_members"](spark, sf).collect()} == stands and stands[1] == 0
    got = catalog.queries()["near_dup_pairs"](spark, sf).collect()
    # equal documents are pairs through the one that stands for them
    assert {(r.a, r.b): r.common for r in got} == {p: n for p, n in want.items() if stands[p[0]] == p[0] and stands[p[1]] == p[1]} and len(got) > 20
    assert {(min(stands[a], stands[b]), max(stands[a], stands[b])) for a, b in want if stands[a] != stands[b]} == {(r.a, r.b) for r in got}
    assert all(r.share == r.common / min(len(sets[r.a]), len(sets[r.b])) for r in got)
    least = {i: i for i in range(len(texts))}
    for _ in texts:
        for a, b in want:
            least[a] = least[b] = min(least[a], least[b])
    assert {r.node: r.cluster for r in catalog.queries()["near_dup_clusters"](spark, sf).collect()} == least


def components(nodes, pairs):
    least = {x: x for x in nodes}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_a_common_line_makes_few_links_and_no_pair_is_shuffled(spark):
    rng = random.Random(8)
    sets = {g: {"common"} | {f"of {g}"} for g in range(0, 150)} | {g: {"common", *(f"rare {rng.randint(0, 40)}" for _ in range(4))} for g in range(150, 250)}
    sets |= {g: {f"rare {rng.randint(0, 60)}" for _ in range(rng.randint(1, 5))} for g in range(250, 400)} | {g: {f"apart {g // 3} {k}" for k in rng.sample(range(6), 4)} for g in range(400, 460)}
    found = relational.item_sets(spark.createDataFrame([(g, x) for g, s in sets.items() for x in s], "g long, x string"), "g", "x")
    stands = {r.r: sets[r.r] for r in found.collect()}
    want = {(a, b): len(stands[a] & stands[b]) for a in stands for b in stands if a < b and 2 * len(stands[a] & stands[b]) >= min(len(stands[a]), len(stands[b]))}
    pairs = relational.set_pairs(found)
    assert {(r.a, r.b): r.common for r in pairs.collect()} == want and pairs.count() == len(want)
    # texts go no further than the first step, and pairs stay where they meet
    plan = pairs._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert all(len(i) == 16 for r in found.collect() for i in r["items"]) and not re.search(r"hashpartitioning\((s|l)#", plan)
    links = {(min(r), max(r)) for r in relational.set_links(found).collect()}
    assert links <= want.keys() and components(stands, links) == components(stands, want)
    assert len(want) > 20_000 and len(links) < 2_000


def test_pairs_of_an_item_meet_at_many_places(spark, monkeypatch):
    monkeypatch.setattr(relational, "MEETING", 7)
    sets = {g: {"common", f"of {g}", *(["also common"] if g % 2 else [])} for g in range(60)}
    found = relational.item_sets(spark.createDataFrame([(g, x) for g, s in sets.items() for x in s], "g long, x string"), "g", "x")
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= min(len(sets[a]), len(sets[b]))}
    got = relational.set_pairs(found).collect()
    assert {(r.a, r.b): r.common for r in got} == want and len(got) == len(want)


def test_align_and_shape_take_whole_texts(spark, folder):
    turns = [(2, t, "user", x) for t, x in enumerate(["same start, one", "same start,  two", "same start, three", "same start, four", "same start, five", "same start, six", "same start, seven"])]
    brands = [(1, "Brand#16"), (2, "ABcd#7"), (3, None), (4, "")]
    sf = folder({"conversations": (turns, "conv_id long, turn long, role string, text string"), "part": (brands, "p_partkey long, p_brand string")})
    got = [(r.predicted_at, r.expected_at, r.differing) for r in catalog.queries()["align_rows"](spark, sf).orderBy("step").collect()]
    # turn 3 is lost, turn 5 is changed
    assert got == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (None, 3, 2), (3, 4, 0), (4, 5, 1), (5, 6, 0)]
    assert {r.p_partkey: r.shape for r in catalog.queries()["word_shape"](spark, sf).collect()} == {1: "Xxx#99", 2: "XXxx#9", 3: None, 4: ""}


def test_geojson_has_all_routes_and_nodes(spark):
    routes = {(r.a, r.b): r for r in catalog.queries()["route_rollup"](spark, SF).collect()}
    rows = catalog.queries()["route_geojson"](spark, SF).collect()
    lines = {(r.a, r.b): json.loads(r.feature) for r in rows if r.b is not None}
    points = {r.a: json.loads(r.feature) for r in rows if r.b is None}
    assert len(routes) > 20 and lines.keys() == routes.keys() and points.keys() == {x for pair in routes for x in pair} and len(rows) == len(lines) + len(points)
    km = {(r.a, r.b): r.km for r in catalog.queries()["haversine_km"](spark, SF).collect()}
    for (a, b), f in lines.items():
        said, at = f["properties"], f["geometry"]["coordinates"]
        assert (said["a"], said["b"], said["n"]) == (a, b, routes[a, b].n) and len(at) == 65 and said["color"] == "#4a90e2"
        assert len(said["directions"]) == routes[a, b].dirs and {*said["directions"]} <= {f"{a}-{b}", f"{b}-{a}"} and abs(said["distanceKm"] - km[a, b]) < 0.06
        assert at[0] == points[a]["geometry"]["coordinates"] and points[b]["geometry"]["type"] == "Point"


def test_grid_takes_texts_with_tabs(spark, folder):
    texts = ["a  b c\n\nd", "a\tb\tc\nd\t\te\n\n", "a\tb c  d\ne f\ng  h\ni", "\t\n\t", None, ""]
    sf = folder({"documents": (list(enumerate(texts)), "doc_id long, text string")})
    want = {}
    for i, t in enumerate(texts):
        if t is not None:
            lines = t.split("\n")
            tabbed, filled = sum("\t" in x for x in lines), sum(x.strip(" ") != "" for x in lines)
            cut = [x.split("\t") if filled and tabbed >= filled / 2 else [c for c in re.split(" {2,}", x.expandtabs(8).strip()) if c] for x in lines]
            cut = [r for r in cut if any(c.strip() for c in r)]
            want[i] = (len(cut), sum(map(len, cut)))
    assert {r.doc_id: (r.rows, r.cells) for r in catalog.queries()["fixed_width_grid"](spark, sf).collect()} == want and want[1] == (2, 6) and want[2] == (4, 7)
    for at in (SF, sf):
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet{'/*.parquet' if at == sf else ''}')")
        assert values(catalog.queries()["fixed_width_grid"](spark, at).toPandas()) == values(db.execute(catalog.oracle_sql()["fixed_width_grid"]).df())
