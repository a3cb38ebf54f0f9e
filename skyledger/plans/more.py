"""Queries over cells, scores, duties, pages, accounts, airports and curation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells
from ..functions import scalars as S
from ..operators import accounts, acars, airports, curation, dates, duties, metrics, pages, relational, repairs, scoring
from ..sources import records
from ..sources import text as T
from ..streaming import usage
from .catalog import _query, _t

# ---- cells ------------------------------------------------------------------------------


@_query("""SELECT event_id, strftime(ts, '%a') AS d, upper(strftime(ts, '%a')) AS day, strftime(ts, '%-d %b %y') AS date, strftime(ts, '%H:%M') || ' Z' AS begin, CASE WHEN event_id % 3 = 0 THEN 'OFF(Z)' WHEN event_id % 3 = 1 THEN 'A/L(T)' ELSE upper(event_type) END AS duty,
 upper(substr(event_type, 1, 3)) AS dep FROM events""")
def normalized_cells(spark, sf):
    """Cells printed in several ways, in their normal forms."""
    e, n = _t(spark, sf, "events"), F.col("event_id")
    at = lambda f: F.date_format("ts", f)
    raw = {
        "day": F.lower(at("EEEE")), "date": F.concat(at("d"), F.lit("  "), F.when(n % 2 == 0, F.upper(at("MMMM"))).otherwise(F.lower(at("MMM"))), F.lit(" "), at("yy")), "begin": F.concat(at("HH"), F.when(n % 2 == 0, ".").otherwise(""), at("mm"), F.lit("z")),
        "duty": F.when(n % 3 == 0, " 0ff ( 2 )").when(n % 3 == 1, "a/l .(t)").otherwise(F.concat(F.lit(" "), "event_type")), "dep": F.concat(F.substring("event_type", 1, 3), F.lit(" ")),
    }
    return e.select("event_id", at("EEE").alias("d"), *[cells.normal_cell(f, c).alias(f) for f, c in raw.items()])


_DUTY = """CASE l_linenumber % 7 WHEN 0 THEN 'fr' || l_partkey WHEN 1 THEN 'off ( 2 )' WHEN 2 THEN ' a/l  . ( z )' WHEN 3 THEN 'sbyd' || (l_partkey % 900 + 100) WHEN 4 THEN 'CHECK-IN' WHEN 5 THEN '12 34' ELSE 'one two three four' END"""


@_query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, upper(trim(regexp_replace({_DUTY}, '\\s+', ' ', 'g'))) AS t FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^0FF\\b', 'OFF'),
 '\\bOFF\\s*\\(\\s*[0O2Z]\\s*\\)', 'OFF(Z)', 'g'), '\\bA/L\\s*\\.\\s*\\(\\s*([A-Z0-9])\\s*\\)', 'A/L(\\1)', 'g'), '\\bFR(\\d{{2,5}})\\b', 'FR \\1', 'g'), '\\bSBYD(\\d{{3,4}})\\b', 'SBY0\\1', 'g') AS code FROM d)
 SELECT l_orderkey, l_linenumber, code, code IN ('CHECK-IN', '12 34', 'ONE TWO THREE FOUR') AS noise FROM c""")
def duty_codes(spark, sf):
    n, p = F.col("l_linenumber") % 7, F.col("l_partkey")
    raw = (
        F.when(n == 0, F.concat(F.lit("fr"), p.cast("string"))).when(n == 1, "off ( 2 )").when(n == 2, " a/l  . ( z )").when(n == 3, F.concat(F.lit("sbyd"), (p % 900 + 100).cast("string")))
        .when(n == 4, "CHECK-IN").when(n == 5, "12 34").otherwise("one two three four")
    )
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cells.duty_code(raw).alias("code"), cells.is_duty_noise(raw).alias("noise"))


@_query("""SELECT o_orderkey, code, regexp_matches(code, '^[A-Z]{3}$') AND code NOT IN ('MON', 'FRI', 'JAN', 'MAY', 'SBY', 'SIM', 'CAB', 'OFF') AS is_airport
 FROM (SELECT o_orderkey, ['VIE', 'MON', 'SBY', 'A/L', 'Vie', 'JAN', 'SIM', 'LHR', 'CAB', '1AB', 'LHRX', 'OFF', 'FRI', 'MAY'][CAST(o_orderkey % 14 AS INT) + 1] AS code FROM orders)""")
def airport_codes(spark, sf):
    code = F.get(F.array(*map(F.lit, ["VIE", "MON", "SBY", "A/L", "Vie", "JAN", "SIM", "LHR", "CAB", "1AB", "LHRX", "OFF", "FRI", "MAY"])), (F.col("o_orderkey") % 14).cast("int"))
    return _t(spark, sf, "orders").select("o_orderkey", code.alias("code")).withColumn("is_airport", cells.is_airport_code(F.col("code")))


@_query("""WITH m AS (SELECT o_orderkey, lower(CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%b') WHEN o_orderkey % 3 = 1 THEN substr(strftime(o_orderdate, '%b'), 1, 2) ELSE 'x' || substr(strftime(o_orderdate, '%b'), 2, 2) END) AS t FROM orders),
 n AS (SELECT o_orderkey, t, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'] AS names FROM m)
 SELECT o_orderkey, coalesce(list_filter(names, lambda n: lower(n) = t)[1], list_filter(names, lambda n: levenshtein(lower(n), t) <= 1)[1]) AS month FROM n""")
def fuzzy_months(spark, sf):
    k, m = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "MMM")
    read = F.when(k == 0, F.upper(m)).when(k == 1, F.substring(m, 1, 2)).otherwise(F.concat(F.lit("x"), F.substring(m, 2, 2)))
    return _t(spark, sf, "orders").select("o_orderkey", cells.fuzzy_month(read).alias("month"))


@_query("""SELECT o_orderkey, strftime(d, '%-d %b %y') AS date, upper(strftime(d, '%a')) AS day FROM (SELECT o_orderkey, o_orderdate + INTERVAL 25 YEAR AS d FROM orders)""")
def dates_in_text(spark, sf):
    """A date of this century with and without its weekday, blanks and century, found among other words."""
    k, at = F.col("o_orderkey") % 4, lambda f: F.date_format(F.add_months("o_orderdate", 300), f)
    text = F.when(k == 0, F.concat(F.lit("x "), at("EEEE, d MMM yy"), F.lit(" FR 12"))).when(k == 1, F.concat(at("dMMMyy"), F.lit("OFF"))).when(k == 2, F.concat(F.lit("no 5 "), F.upper(at("d-MMM-yyyy")), F.lit(" 10:00"))).otherwise(at("dd MMM yy"))
    return _t(spark, sf, "orders").select("o_orderkey", cells.date_in_text(text).alias("d")).select("o_orderkey", "d.date", "d.day")


@_query("""SELECT o_orderkey, CAST(day(o_orderdate) AS INT) AS day, CASE WHEN o_orderkey % 6 <> 5 THEN CAST(month(o_orderdate) AS INT) END AS month, CASE WHEN o_orderkey % 6 < 4 THEN CAST(year(o_orderdate) % 100 AS INT) END AS year,
 CASE WHEN o_orderkey % 6 IN (1, 5) THEN CAST(dayofweek(o_orderdate) AS INT) END AS weekday FROM orders""")
def printed_date_parts(spark, sf):
    k, at = F.col("o_orderkey") % 6, lambda f: F.date_format("o_orderdate", f)
    text = F.when(k == 0, at("yyyy-MM-dd")).when(k == 1, at("EEE d MMM yy")).when(k == 2, F.upper(at("ddMMMyy"))).when(k == 3, at("dd/MM/yyyy")).when(k == 4, at("d MMM")).otherwise(F.concat(at("dd"), F.upper(at("EEE"))))
    return _t(spark, sf, "orders").select("o_orderkey", dates.date_parts(text).alias("p")).select("o_orderkey", "p.day", "p.month", "p.year", "p.weekday")


@_query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\s\\x{A0}]+', ' ', 'g')) AS text FROM pages""")
def text_normalize(spark, sf):
    return _t(spark, sf, "pages").select("page_id", cells.squeezed(F.regexp_replace("html", "<[^>]*>", " ")).alias("text"))


@_query("SELECT o_orderkey, o_orderpriority AS prio, CAST(o_custkey AS VARCHAR) AS cust, CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'a' END AS twice FROM orders")
def tag_extract(spark, sf):
    """Tags of an info cell; of a repeated one the last counts."""
    info = F.concat(F.lit("[Twice: a] text [Prio: "), "o_orderpriority", F.lit("] [Cust: "), F.col("o_custkey").cast("string"), F.lit("]"), F.when(F.col("o_orderkey") % 2 == 0, " [Twice: b]").otherwise(""))
    tags = _t(spark, sf, "orders").select("o_orderkey", S.bracket_tags(info).alias("t"))
    return tags.select("o_orderkey", *[F.col("t")[k].alias(n) for k, n in (("Prio", "prio"), ("Cust", "cust"), ("Twice", "twice"))])


@_query("""SELECT event_id, lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS hhmm, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%-d %b %y') ELSE strftime(ts, '%-d %b') END AS date FROM events""")
def message_cells(spark, sf):
    """Times and dates as cockpit pages print them, digits read as letters among them."""
    n, two = F.col("event_id"), lambda c: F.lpad(c.cast("string"), 2, "0")
    mixed = F.concat(F.translate(two(n % 24), "025", "OZS"), F.when(n % 3 == 0, ":").when(n % 3 == 1, "").otherwise("+"), two(n % 60), F.lit("Z"))
    at = lambda f: F.upper(F.date_format("ts", f))
    return _t(spark, sf, "events").select("event_id", acars.clock(mixed).alias("hhmm"), acars.printed_date(F.when(n % 2 == 0, F.translate(at("ddMMMyy"), "0", "O")).otherwise(at("dd/MMM"))).alias("date"))


@_query("""SELECT l_orderkey, l_linenumber, '[' || l_returnflag || l_linestatus || ' - N ' || l_partkey || '][FA - M]' AS crew, 'n@m' || l_partkey || '.org' AS email FROM lineitem""")
def crew_lists(spark, sf):
    text = F.concat(F.lit("N "), F.col("l_partkey").cast("string"), F.lit("  - "), "l_returnflag", "l_linestatus", F.lit(" ,M - FA"))
    mail = F.concat(F.lit(" n@m"), F.col("l_partkey").cast("string"), F.lit(".org "))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", repairs.crew_tags(text).alias("crew"), cells.email_of(mail).alias("email"))


# ---- scores -----------------------------------------------------------------------------

_FILES = "f AS (SELECT doc_id AS file, CASE WHEN doc_id % 3 = 0 THEN 'image' ELSE 'pdf' END AS kind, lang AS type, source AS layout, n_chars % 40 AS row_matches, n_chars % 50 AS core_matches, n_chars % 50 + 1 AS row_total, n_chars % 45 AS read, n_chars % 7 AS field_errors FROM documents)"


def _files(spark, sf):
    d, n = _t(spark, sf, "documents"), F.col("n_chars")
    kind = F.when(F.col("doc_id") % 3 == 0, "image").otherwise("pdf")
    return d.select(F.col("doc_id").alias("file"), kind.alias("kind"), F.col("lang").alias("type"), F.col("source").alias("layout"), (n % 40).alias("row_matches"), (n % 50).alias("core_matches"), (n % 50 + 1).alias("row_total"), (n % 45).alias("read"), (n % 7).alias("field_errors"))


@_query(f"""WITH {_FILES}, r AS (SELECT CASE grouping_id(kind, type, layout) WHEN 7 THEN 'overall' WHEN 3 THEN 'kind' WHEN 5 THEN 'type' ELSE 'layout' END AS level, coalesce(kind, type, layout, '') AS value, count(*) AS files, CAST(sum(row_matches) AS BIGINT) AS row_matches,
 CAST(sum(core_matches) AS BIGINT) AS core_matches, CAST(sum(row_total) AS BIGINT) AS row_total, CAST(sum(read) AS BIGINT) AS read FROM f GROUP BY GROUPING SETS ((), (kind), (type), (layout)))
 SELECT *, floor(100.0 * row_matches / row_total * 10 + 0.5) / 10 AS row_exact, floor(100.0 * core_matches / row_total * 10 + 0.5) / 10 AS core_exact, row_total - row_matches AS lost FROM r""")
def model_rollups(spark, sf):
    return scoring.rollups(_files(spark, sf))


@_query(f"""WITH {_FILES}, s AS (SELECT layout AS section, sum(row_matches) AS row_matches, sum(row_total) AS row_total, sum(CASE WHEN file % 5 = 0 THEN 0 ELSE read END) AS read, sum(core_matches) AS labelled, count(*) FILTER (core_matches > 0) AS files_with_table,
 count(*) FILTER (core_matches > 0 AND (file % 5 = 0 OR read = 0)) AS files_missed FROM f GROUP BY 1) SELECT section, CAST(row_matches AS BIGINT) AS row_matches, CAST(row_total AS BIGINT) AS row_total, CAST(read AS BIGINT) AS read, CAST(labelled AS BIGINT) AS labelled, files_with_table, files_missed,
 row_matches / row_total AS rate FROM s""")
def section_rates(spark, sf):
    f = _files(spark, sf).withColumns({"read": F.when(F.col("file") % 5 == 0, 0).otherwise(F.col("read")), "labelled": F.col("core_matches"), "section": F.col("layout")})
    return scoring.section_totals(f, "section")


@_query(f"""WITH {_FILES}, s AS (SELECT file, field_errors, 1 - row_matches / row_total AS mismatch, field_errors / row_total AS rate FROM f), t AS (SELECT file, field_errors, mismatch, least(1.0, mismatch * 0.6 + least(1.0, rate / 8) * 0.4) AS stale FROM s)
 SELECT file, round(mismatch, 9) AS mismatch, round(stale, 9) AS stale, mismatch >= 0.25 OR field_errors >= 3 OR greatest(0.0, 1 - stale) <= 0.85 AS suspicious FROM t""")
def label_audit(spark, sf):
    return scoring.stale_labels(_files(spark, sf)).select("file", F.round("mismatch", 9).alias("mismatch"), F.round("stale", 9).alias("stale"), "suspicious")


@_query("""WITH r AS (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE event_id % 100 / 100.0 END AS c, event_id % 6 = 0 AS critical FROM events), s AS (SELECT user_id, count(*) AS n, avg(c) AS confidence, avg(CAST(c < 0.5 AS DOUBLE)) AS weak, avg(CAST(critical AS DOUBLE)) AS crit FROM r GROUP BY 1)
 SELECT user_id, n, round(confidence, 6) AS confidence, CASE WHEN n < 5 THEN 'few' WHEN confidence < 0.45 THEN 'confidence' WHEN weak > 0.3 THEN 'weak' WHEN crit > 0.2 THEN 'critical' ELSE '' END AS why FROM s""")
def reading_quality(spark, sf):
    n = F.col("event_id")
    rows = _t(spark, sf, "events").select("user_id", "event_id", F.when(n % 4 == 0, F.lit(None)).otherwise((n % 100) / 100.0).alias("confidence"), (n % 6 == 0).alias("critical"))
    r = F.col("reason")
    why = F.when(r.startswith("Too few"), "few").when(r.startswith("Low"), "confidence").when(r.endswith("low confidence"), "weak").when(r.endswith("failures"), "critical").otherwise("")
    return scoring.reading_quality(rows, ["user_id"], "event_id").select("user_id", "n", (F.floor(F.col("confidence") * 1e6 + 0.5) / 1e6).alias("confidence"), why.alias("why"))


def _run(spark, sf, m):
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("file"), (F.col("n_chars") % m).alias("ok"), F.lit(100).alias("total"))


@_query("""WITH r AS (SELECT n_chars % 90 AS b, n_chars % 91 AS a FROM documents), s AS (SELECT CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after, 100 * count(*) AS total, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses FROM r)
 SELECT *, CASE WHEN after - before >= greatest(3, floor(0.005 * total + 0.5)) THEN 'better' WHEN after - before <= -greatest(3, floor(0.005 * total + 0.5)) THEN 'worse' ELSE 'tie' END AS verdict FROM s""")
def run_verdict(spark, sf):
    return scoring.run_verdict(_run(spark, sf, 90), _run(spark, sf, 91), "file")


@_query("""WITH b AS (SELECT doc_id, n_chars % 500 AS n FROM documents WHERE doc_id % 4 <> 0), a AS (SELECT doc_id, n_chars % 700 AS n FROM documents WHERE doc_id % 5 <> 0),
 j AS (SELECT b.n AS b, a.n AS a FROM b FULL JOIN a ON a.doc_id = b.doc_id), t AS (SELECT CAST(sum(CASE WHEN b IS NOT NULL THEN coalesce(a, 0) - b ELSE 0 END) AS BIGINT) AS total, bool_or(coalesce(a - b >= 200, false)) AS grown FROM j) SELECT total, NOT grown AND total < 1000 AS passes FROM t""")
def suspect_growth(spark, sf):
    d = _t(spark, sf, "documents")
    run = lambda keep, m: d.filter(f"doc_id % {keep} <> 0").select("doc_id", (F.col("n_chars") % m).alias("n"))
    return scoring.suspect_growth(run(4, 500), run(5, 700), "doc_id", "n")


@_query("""SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'new' WHEN n_chars % 91 > n_chars % 90 THEN 'BETTER' WHEN n_chars % 91 < n_chars % 90 THEN 'WORSE' ELSE 'same' END AS state, d.doc_id % 4 <> 0 AND d.doc_id % 7 = 0 AS label_edited FROM documents d""")
def label_check(spark, sf):
    d = _t(spark, sf, "documents")
    before = d.filter("doc_id % 4 <> 0").select("doc_id", (F.col("n_chars") % 90).alias("rows"), F.lit(100).alias("total"), F.lit("a").alias("label_hash"))
    after = d.select("doc_id", (F.col("n_chars") % 91).alias("rows"), F.lit(100).alias("total"), F.when(F.col("doc_id") % 7 == 0, "b").otherwise("a").alias("label_hash"))
    return scoring.label_check(before, after, "doc_id").select("doc_id", "state", "label_edited")


@_query("""WITH w AS (SELECT source, CASE WHEN doc_id % 5 = 0 THEN '?' WHEN doc_id % 3 = 0 THEN 'O' ELSE lang END AS tag, CASE WHEN doc_id % 7 = 0 THEN 'O' ELSE lang END AS said FROM documents)
 SELECT source, count(*) FILTER (tag <> '?') AS words, floor(1000.0 * count(*) FILTER (tag <> '?' AND tag = said) / count(*) FILTER (tag <> '?') + 0.5) / 10 AS accuracy,
 floor(1000.0 * count(*) FILTER (tag NOT IN ('?', 'O') AND tag = said) / count(*) FILTER (tag NOT IN ('?', 'O')) + 0.5) / 10 AS tagged_accuracy FROM w GROUP BY source""")
def tagger_scores(spark, sf):
    k = F.col("doc_id")
    words = _t(spark, sf, "documents").select("source", F.when(k % 5 == 0, "?").when(k % 3 == 0, "O").otherwise(F.col("lang")).alias("tag"), F.when(k % 7 == 0, "O").otherwise(F.col("lang")).alias("said"))
    return scoring.word_accuracy(words, ["source"])


@_query("""WITH r AS (SELECT o_orderkey % 5 <> 0 AS flt, o_orderkey % 7 <> 0 AS out FROM orders) SELECT field, matches, total, floor(1000.0 * matches / total + 0.5) / 10 AS percent FROM (SELECT 'flt' AS field, count(*) FILTER (flt) AS matches, count(*) AS total FROM r
 UNION ALL SELECT 'out', count(*) FILTER (out), count(*) FROM r UNION ALL SELECT '*', count(*) FILTER (flt AND out), count(*) FROM r)""")
def message_accuracy(spark, sf):
    o, k = _t(spark, sf, "orders"), F.col("o_orderkey")
    label = o.select("o_orderkey", F.concat(F.lit("AB"), k.cast("string")).alias("flt"), F.lit("09:58").alias("out"))
    read = o.select("o_orderkey", F.when(k % 5 == 0, "X").otherwise(F.concat(F.lit("ab "), k.cast("string"))).alias("flt"), F.when(k % 7 == 0, "").otherwise("0958Z").alias("out"))
    return scoring.record_accuracy(scoring.record_scores(read, label, "o_orderkey", ["flt", "out"], acars.normal_field), ["flt", "out"])


@_query("""WITH e AS (SELECT doc_id, unnest(['ocr', 'label', 'assembly']) AS s, doc_id % 4 AS k FROM documents), f AS (SELECT doc_id, s FROM e WHERE (s = 'ocr' AND k IN (0, 3)) OR (s = 'label' AND k IN (1, 3)) OR (s = 'assembly' AND k IN (2, 0))),
 g AS (SELECT doc_id, list(s) AS l, count(*) AS n FROM f GROUP BY 1) SELECT CASE WHEN l = ['label'] THEN 'label to correct' WHEN l = ['assembly'] THEN 'rules' WHEN NOT list_contains(l, 'assembly') THEN 'recognition' ELSE 'several causes' END AS mend, count(*) AS rows, CAST(sum(n) AS BIGINT) AS cells FROM g GROUP BY 1""")
def error_sources(spark, sf):
    k = F.col("doc_id") % 4
    every = F.array(F.when(k.isin(0, 3), "ocr"), F.when(k.isin(1, 3), "label"), F.when(k.isin(2, 0), "assembly"))
    errors = _t(spark, sf, "documents").select(F.col("doc_id").alias("row"), F.lit("dep").alias("field"), F.explode(every).alias("source")).filter("source is not null")
    return scoring.error_sources(errors)


@_query("SELECT source, count(DISTINCT doc_id % 5) AS folds, CAST(sum(n_chars) AS BIGINT) AS cells FROM documents GROUP BY source")
def fold_sums(spark, sf):
    return scoring.fold_sums(_t(spark, sf, "documents").select("source", (F.col("doc_id") % 5).alias("fold"), F.col("n_chars").cast("long").alias("cells")), ["source"], ["cells"])


# ---- duties, dates, pages ---------------------------------------------------------------

_ROWS = """r AS (SELECT user_id, event_id, ts, event_type = 'signup' AS ci, event_type = 'error' AS co, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT user_id, event_id, event_type, date_trunc('minute', ts) AS ts FROM events)),
 g AS (SELECT *, sum(CAST(ci AS INT)) OVER (PARTITION BY user_id ORDER BY n) AS g FROM r), w AS (SELECT *, first_value(ts) OVER (PARTITION BY user_id, g ORDER BY n) AS t0 FROM g WHERE g > 0),
 b AS (SELECT *, min(CASE WHEN NOT ci AND (co OR ts > t0 + INTERVAL 36 HOUR) THEN n END) OVER (PARTITION BY user_id, g) AS stop FROM w), s AS (SELECT *, max(CASE WHEN n = stop THEN co END) OVER (PARTITION BY user_id, g) AS shut FROM b),
 k AS (SELECT user_id, g, t0, max(CASE WHEN n = stop AND co THEN ts END) AS out_at, max(CASE WHEN NOT ci AND (stop IS NULL OR n < stop) THEN ts + INTERVAL 1 HOUR END) AS last_at, count(*) FILTER (NOT ci AND (stop IS NULL OR n < stop)) AS inside FROM s GROUP BY 1, 2, 3)"""


@_query(f"WITH {_ROWS} SELECT user_id, strftime(t0, '%Y-%m-%d %H:%M') AS starts, strftime(coalesce(out_at, last_at), '%Y-%m-%d %H:%M') AS ends, inside FROM k WHERE coalesce(out_at, last_at) > t0")
def duty_calendar(spark, sf):
    """Duties of users whose signups are check-ins and whose errors are check-outs; all else lasts an hour."""
    e = _t(spark, sf, "events")
    clock = lambda c: F.concat(F.date_format(c, "HH:mm"), F.lit(" Z"))
    stop = F.timestamp_add("MINUTE", F.lit(60), F.col("ts"))
    alone = F.col("event_type").isin("signup", "error")
    over = F.when(F.to_date(stop) > F.to_date("ts"), " +1").otherwise("")
    duty = F.when(F.col("event_type") == "signup", "C/I").when(F.col("event_type") == "error", "C/O").otherwise(F.col("event_type"))
    w = F.row_number().over(duties.W.partitionBy("user_id").orderBy(F.date_trunc("minute", "ts"), "event_id"))
    rows = e.select("user_id", w.alias("n"), F.lit("published").alias("section"), F.date_format("ts", "d MMM yy").alias("date"), duty.alias("duty"), F.when(F.col("event_type") == "error", "").otherwise(clock("ts")).alias("begin"), F.when(alone, F.when(duty == "C/O", clock("ts")).otherwise("")).otherwise(F.concat(clock(stop), over)).alias("end"))
    found = duties.placed_rows(rows, "user_id", "n").filter("`group` is not null")
    inside = F.count_if(F.col("role") == "inside")
    out = found.groupBy("user_id", "group").agg(F.min("ci.start").alias("a"), F.max("until").alias("b"), inside.alias("inside"))
    return out.select("user_id", F.date_format("a", "yyyy-MM-dd HH:mm").alias("starts"), F.date_format("b", "yyyy-MM-dd HH:mm").alias("ends"), "inside")


@_query("""SELECT user_id, '01' || strftime(min(ts), '%b%y') || ' - ' || strftime(last_day(CAST(max(ts) AS DATE)), '%d%b%y') AS period FROM events GROUP BY user_id""")
def row_periods(spark, sf):
    return dates.rows_period(_t(spark, sf, "events").select("user_id", F.date_format("ts", "d MMM yy").alias("date")), ["user_id"], "date")


@_query("""WITH l AS (SELECT user_id, event_id, CAST(event_id * 37 % 4000 AS DOUBLE) AS y FROM events WHERE event_type <> 'view'), r AS (SELECT user_id, CAST(event_id * 53 % 4000 AS DOUBLE) AS y, max(CAST(event_id AS VARCHAR)) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
 a AS (SELECT l.event_id, arg_max(r.v, r.y) AS v FROM l JOIN r ON r.user_id = l.user_id AND r.y <= l.y + 8 AND abs(r.y - l.y) < 30 GROUP BY 1), b AS (SELECT l.event_id, arg_min(r.v, r.y) AS v FROM l JOIN r ON r.user_id = l.user_id AND r.y > l.y + 8 AND abs(r.y - l.y) < 30 GROUP BY 1)
 SELECT l.event_id, coalesce(a.v, b.v) AS nearest, a.v IS NULL AND b.v IS NOT NULL AS is_behind FROM l LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""")
def nearest_lines(spark, sf):
    """Rows with the line nearest at or above them, 8 of slack, else the nearest below, within 30."""
    e, n = _t(spark, sf, "events"), F.col("event_id")
    left = e.filter("event_type <> 'view'").select("user_id", "event_id", (n * 37 % 4000).cast("double").alias("y"))
    right = e.filter("event_type = 'view'").groupBy("user_id", (n * 53 % 4000).cast("double").alias("y")).agg(F.max(n.cast("string")).alias("v"))
    return relational.nearest_around(left, right, ["user_id"], "y", "v", 30.0, 8.0).select("event_id", "nearest", "is_behind")


_WORDS = "w AS (SELECT user_id, CAST(ts AS DATE) AS line, event_type AS t, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) * 20 + event_id % 11 AS DOUBLE) AS x, CASE WHEN event_id % 4 = 0 THEN 'O' WHEN event_id % 3 = 0 THEN 'duty' ELSE 'info' END AS field FROM events)"


@_query(f"""WITH {_WORDS}, n AS (SELECT *, sum(CASE WHEN lag_f IS NULL OR lag_f <> field OR x - lag_x >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, line ORDER BY x, t) AS span FROM (SELECT *, lag(field) OVER o AS lag_f, lag(x + 3) OVER o AS lag_x FROM w WINDOW o AS (PARTITION BY user_id, line ORDER BY x, t)))
 SELECT user_id, strftime(line, '%Y-%m-%d') AS line, field, min(x) AS x, string_agg(t, ' ' ORDER BY x, t) AS text FROM n WHERE field <> 'O' GROUP BY user_id, line, span, field""")
def word_spans(spark, sf):
    e, n = _t(spark, sf, "events"), F.col("event_id")
    at = F.row_number().over(duties.W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")) * 20 + n % 11
    field = F.when(n % 4 == 0, "O").when(n % 3 == 0, "duty").otherwise("info")
    words = e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("line"), F.col("event_type").alias("t"), at.cast("double").alias("x"), F.lit(3.0).alias("w"), field.alias("field"))
    return pages.line_spans(words, ["user_id", "line"]).drop("span")


_BOXES = "SELECT user_id, event_id AS nth, CAST(event_id * 7 % 300 AS DOUBLE) AS x0, CAST(event_id * 7 % 300 + 20 AS DOUBLE) AS x1, CAST(event_id * 13 % 200 AS DOUBLE) AS y0, CAST(event_id * 13 % 200 + 30 AS DOUBLE) AS y1 FROM events"


@_query(f"""WITH a AS ({_BOXES} WHERE event_type = 'view'), b AS ({_BOXES} WHERE event_type = 'click'), o AS (SELECT a.user_id, a.nth AS a, b.nth AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 600 AS share FROM a JOIN b USING (user_id))
 SELECT user_id, a, b, round(share, 6) AS share FROM o WHERE share >= 0.5""")
def box_overlaps(spark, sf):
    e, n = _t(spark, sf, "events"), F.col("event_id")
    side = lambda kind: e.filter(F.col("event_type") == kind).select("user_id", n.alias("nth"), *[(n * k % m + d).cast("double").alias(c) for c, k, m, d in (("x0", 7, 300, 0), ("x1", 7, 300, 20), ("y0", 13, 200, 0), ("y1", 13, 200, 30))])
    return pages.box_overlaps(side("view"), side("click"), ["user_id"]).withColumn("share", F.round("share", 6))


@_query("""WITH c AS (SELECT label, [avg(e[1]), avg(e[2]), avg(e[3])] AS m FROM (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) GROUP BY label),
 d AS (SELECT vec_id, c.label AS nearest, round(sqrt(pow(embedding[1] - m[1], 2) + pow(embedding[2] - m[2], 2) + pow(embedding[3] - m[3], 2)), 4) AS distance FROM embeddings, c) SELECT vec_id, nearest, distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) = 1""")
def embedding_nearest_centroid(spark, sf):
    """The label whose mean is nearest in the first three dimensions; the means are one row."""
    e = _t(spark, sf, "embeddings")
    value = lambda i: F.get("embedding", i).cast("double")
    means = e.groupBy("label").agg(*[F.avg(value(i)).alias(f"m{i}") for i in range(3)])
    listed = means.groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "m0", "m1", "m2"))).alias("c"))
    far = lambda c: F.round(F.sqrt(sum((F.pow(value(i) - c[f"m{i}"], F.lit(2)) for i in range(3)), F.lit(0.0))), 4)
    best = F.array_min(F.transform("c", lambda c: F.struct(far(c).alias("distance"), c["label"].alias("nearest"))))
    return e.join(relational.small(listed)).select("vec_id", best.alias("b")).select("vec_id", "b.nearest", "b.distance")


# ---- accounts ---------------------------------------------------------------------------

_CALLS = "c AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, ts, event_type = 'view' AS is_read FROM events)"


@_query(f"""WITH {_CALLS}, r AS (SELECT *, sum(CAST(is_read AS INT)) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS nth FROM c), e AS (SELECT *, NOT is_read OR nth <= 1 AS ok FROM r)
 SELECT event_id, ok AND sum(CAST(ok AS INT)) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) <= 3 AS admitted FROM e""")
def quota_with_reads(spark, sf):
    calls = _t(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "ts", (F.col("event_type") == "view").alias("is_read"))
    return accounts.spent(calls, ["user_id", "day"], ["ts", "event_id"], F.lit(3), F.lit(1)).select("event_id", "admitted")


@_query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (event_type = 'view') AS reads FROM events GROUP BY 1, 2""")
def flushed_usage(spark, sf):
    """Stored counters of the odd events with the even ones' increments added."""
    e = _t(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(1).cast("long").alias("requests"), (F.col("event_type") == "view").cast("long").alias("reads"), (F.col("event_id") % 2).alias("odd"))
    keys, counters = ["user_id", "day"], ["requests", "reads"]
    stored = e.filter("odd = 1").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
    return accounts.flushed(stored, e.filter("odd = 0"), keys, counters)


_PLANS = "(VALUES ('free', 5, 1), ('pro', 100, 10)) p(plan, requests, reads)"


@_query(f"""WITH a AS (SELECT c_custkey AS uid, CASE WHEN c_custkey % 3 = 0 THEN 'pro' WHEN c_custkey % 3 = 1 THEN 'gone' END AS plan, CASE WHEN c_custkey % 2 = 0 THEN DATE '2020-01-01' ELSE DATE '2030-01-01' END AS until, CASE WHEN c_custkey % 5 = 0 THEN 7 END AS own FROM customer),
 e AS (SELECT a.*, CASE WHEN plan = 'pro' AND until >= DATE '2025-01-01' THEN 'pro' ELSE 'free' END AS eff FROM a), k AS (SELECT o_custkey AS uid, count(*) AS n FROM orders GROUP BY 1)
 SELECT e.uid, eff AS effective_plan, coalesce(own, p.requests) AS limit_requests, p.reads AS limit_reads, coalesce(k.n, 0) AS keys, CASE WHEN e.uid % 4 = 0 THEN 9 ELSE 0 END AS requests FROM e JOIN {_PLANS} ON p.plan = eff LEFT JOIN k USING (uid)""")
def account_listing(spark, sf):
    """Customers as users, their orders as keys, with the plan in force, limits and usage."""
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    users = c.select(k.alias("uid"))
    own = c.select(k.alias("uid"), F.when(k % 3 == 0, "pro").when(k % 3 == 1, "gone").alias("plan"), F.when(k % 2 == 0, F.lit("2020-01-01")).otherwise("2030-01-01").cast("date").alias("plan_until"), F.when(k % 5 == 0, 7).alias("own_requests"), F.lit(-1).alias("own_reads"))
    plans = spark.createDataFrame([("free", "Free", 5, 1), ("pro", "Pro", 100, 10)], "plan string, label string, requests int, reads int")
    keys = _t(spark, sf, "orders").select(F.col("o_custkey").alias("uid"))
    used = c.filter("c_custkey % 4 = 0").select(k.alias("uid"), F.lit(9).cast("long").alias("requests"), F.lit(0).cast("long").alias("reads"))
    listed = accounts.account_listing(users, own, keys, used, plans, F.lit("2025-01-01").cast("date"))
    return listed.select("uid", "effective_plan", "limit_requests", "limit_reads", "keys", F.col("requests").cast("int").alias("requests"))


@_query("""WITH p AS (SELECT o_orderkey AS tx, o_orderstatus, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'refunded' WHEN 'O' THEN 'paid' ELSE 'partially refunded' END AS status FROM orders),
 n AS (SELECT *, row_number() OVER (PARTITION BY year(o_orderdate), tx % 10 = 0 ORDER BY o_orderdate, CAST(tx AS VARCHAR)) AS k FROM p), l AS (SELECT year(o_orderdate) AS y, max(k) AS last FROM n WHERE tx % 10 = 0 GROUP BY 1)
 SELECT tx, 'RP-' || year(o_orderdate) || '-' || CASE WHEN nth >= 1000 THEN CAST(nth AS VARCHAR) ELSE lpad(CAST(nth AS VARCHAR), 4, '0') END AS number, status
 FROM (SELECT n.*, CASE WHEN tx % 10 = 0 THEN k ELSE k + coalesce(last, 0) END AS nth FROM n LEFT JOIN l ON l.y = year(n.o_orderdate))""")
def recorded_payments(spark, sf):
    """Orders as payments: each tenth is an invoice already, the others are numbered on; all take their state."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("tx"), "o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd").alias("paid_at"), F.when(F.col("o_orderstatus") == "F", "REFUNDED").when(F.col("o_orderstatus") == "O", "COMPLETED").otherwise("PARTIALLY_REFUNDED").alias("state"))
    old = accounts.gapless_numbers(o.filter("o_orderkey % 10 = 0"), F.year("o_orderdate"), F.to_date("o_orderdate"), ["o_orderdate", "tx"], "nth").withColumn("year", F.year("o_orderdate"))
    number = F.concat(F.lit("RP-"), F.col("year").cast("string"), F.lit("-"), F.when(F.col("nth") >= 1000, F.col("nth").cast("string")).otherwise(F.lpad(F.col("nth").cast("string"), 4, "0")))
    invoices = old.select("tx", number.alias("number"), "year", "nth", F.lit("paid").alias("status"))
    twice = o.unionByName(o.filter("o_orderkey % 3 = 0"))
    return accounts.recorded(invoices, twice.select("tx", "state", "paid_at")).select(F.col("tx").cast("long").alias("tx"), "number", "status")


@_query("""WITH i AS (SELECT o_custkey AS uid, o_orderpriority AS plan, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY AS until FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT c_custkey, 'sub', TIMESTAMP '1997-01-01' FROM customer WHERE c_custkey % 4 = 0),
 l AS (SELECT uid, arg_max(plan, (until, plan)) AS plan, max(until) AS until FROM i GROUP BY 1), a AS (SELECT c_custkey AS uid, CASE WHEN c_custkey % 5 = 0 THEN 'admin' WHEN c_custkey % 5 = 1 THEN 'billing' END AS src FROM customer)
 SELECT a.uid, CASE WHEN src = 'admin' THEN 'own' WHEN l.plan IS NOT NULL THEN l.plan WHEN src = 'billing' THEN 'free' ELSE 'own' END AS plan, CASE WHEN src = 'admin' OR l.plan IS NULL THEN NULL ELSE strftime(until + INTERVAL 3 DAY, '%Y-%m-%d') END AS plan_until FROM a LEFT JOIN l USING (uid)""")
def updated_plans(spark, sf):
    c, o, k = _t(spark, sf, "customer"), _t(spark, sf, "orders"), F.col("c_custkey")
    own = c.select(k.alias("uid"), F.lit("own").alias("plan"), F.lit(None).cast("timestamp").alias("plan_until"), F.when(k % 5 == 0, "admin").when(k % 5 == 1, "billing").alias("plan_source"))
    status = F.when(F.col("o_orderstatus") == "F", "refunded").when(F.col("o_orderstatus") == "O", "paid").otherwise("partially refunded")
    invoices = o.select(F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("plan"), status.alias("status"), F.timestamp_add("DAY", F.lit(30), F.col("o_orderdate").cast("timestamp")).alias("period_end"))
    subs = c.filter("c_custkey % 4 = 0").select(k.alias("uid"), F.lit("sub").alias("plan"), F.lit("ACTIVE").alias("status"), F.lit("1997-01-01").cast("timestamp").alias("next_billing"))
    return accounts.updated_plans(own, invoices, subs).select("uid", "plan", F.date_format("plan_until", "yyyy-MM-dd").alias("plan_until"))


@_query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'sub-' || user_id WHEN event_id % 3 = 1 THEN 'agr-' || user_id ELSE 'inv-' || (event_id % 50) END AS subscription FROM events WHERE event_id % 10 <> 0""")
def handled_events(spark, sf):
    """Events as provider messages that come twice; each tenth was seen before."""
    e, n = _t(spark, sf, "events"), F.col("event_id")
    named = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    made = e.select(n.alias("id"), F.when(n % 3 == 0, "subscription").when(n % 3 == 1, "sale").otherwise("refund").alias("resource_type"), named("sub-").alias("resource_id"), named("agr-").alias("agreement_id"), (n % 50).cast("string").alias("sale_id"))
    invoices = spark.range(50).select(F.col("id").cast("string").alias("tx"), F.concat(F.lit("inv-"), F.col("id").cast("string")).alias("subscription"))
    return accounts.handled_events(made.unionByName(made), e.filter("event_id % 10 = 0").select(n.alias("id")), invoices)


@_query("""WITH s AS (SELECT doc_id, ['pending', 'accepted', 'dismissed', NULL][CAST(doc_id % 4 AS INT) + 1] AS status, CASE WHEN doc_id % 7 = 0 THEN 'resolved' ELSE '' END AS ticket FROM documents),
 t AS (SELECT CASE WHEN ticket <> '' THEN ticket WHEN status = 'accepted' THEN 'in_progress' WHEN status = 'dismissed' THEN 'closed' ELSE 'open' END AS ticket FROM s) SELECT d.ticket, count(t.ticket) AS n FROM (VALUES ('open'), ('in_progress'), ('resolved'), ('closed')) d(ticket) LEFT JOIN t ON t.ticket = d.ticket GROUP BY 1""")
def ticket_counts(spark, sf):
    k = F.col("doc_id")
    none = F.expr("cast(null as array<string>)")
    s = _t(spark, sf, "documents").select("doc_id", F.when(k % 4 == 0, "pending").when(k % 4 == 1, "accepted").when(k % 4 == 2, "dismissed").alias("status"), F.when(k % 7 == 0, "resolved").otherwise("").alias("ticket"), none.alias("published"), none.alias("planned"))
    return relational.with_zeros(accounts.tickets(s), "ticket", accounts.TICKETS)


_PATHS = ["/api/airports/VIE", "/API/files/", "/label", "/", "/api/account/keys", "/api/roster/upload", "/api/billing/webhook", "/api/billing/invoices/RP-1", "/account/", "/api/openapi.json", "/map"]


@_query(f"""SELECT event_id, ['public', 'admin', 'admin', 'page', 'account', 'reading', 'open', 'account', 'account', 'open', 'page'][CAST(event_id % {len(_PATHS)} AS INT) + 1] AS kind FROM events""")
def path_classes(spark, sf):
    at = (F.col("event_id") % len(_PATHS)).cast("int")
    method = F.when(at.isin(5, 6), "post").otherwise("HEAD")
    return _t(spark, sf, "events").select("event_id", accounts.path_class(method, F.get(F.array(*map(F.lit, _PATHS)), at)).alias("kind"))


# ---- airports ---------------------------------------------------------------------------

_AIRPORTS = """a AS (SELECT c_custkey AS id, upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 3)) AS iata, upper(substr(md5(c_name), 1, 4)) AS icao, upper(substr(md5(CAST(c_custkey AS VARCHAR)), 4, 3)) AS local, c_name AS name, c_mktsegment AS city,
 ['large', 'medium', 'small', 'seaplane'][CAST(c_custkey % 4 AS INT) + 1] AS type, c_custkey % 3 = 0 AS scheduled FROM customer), r AS (SELECT *, CASE WHEN scheduled THEN 0 ELSE 10 END + id % 4 AS rank FROM a)"""


def _dimension(spark, sf):
    k = F.col("c_custkey")
    code = lambda c, i, n: F.upper(F.substring(F.md5(c.cast("string")), i, n))
    none = [F.lit("").alias(c) for c in ("faa", "gps", "wmo", "region", "country", "web", "wiki")]
    kind = F.get(F.array(*map(F.lit, airports.RANKS)), (k % 4).cast("int"))
    return _t(spark, sf, "customer").select(k.cast("string").alias("id"), code(k, 1, 3).alias("iata"), code(F.col("c_name"), 1, 4).alias("icao"), code(k, 4, 3).alias("local"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), kind.alias("type"), (k % 3 == 0).alias("scheduled"), *none)


@_query(f"""WITH {_AIRPORTS}, k AS (SELECT iata AS code, 0 AS p, 'iata' AS f, rank, name, id FROM r UNION ALL SELECT icao, 1, 'icao', rank, name, id FROM r UNION ALL SELECT local, 4, 'local', rank, name, id FROM r UNION ALL SELECT CAST(id AS VARCHAR), 5, 'id', rank, name, id FROM r)
 SELECT code, f AS matched_by, name FROM k QUALIFY row_number() OVER (PARTITION BY code ORDER BY p, rank, name, CAST(id AS VARCHAR)) = 1""")
def airport_by_code(spark, sf):
    return airports.by_code(_dimension(spark, sf)).select("code", "matched_by", "airport.name")


@_query(f"""WITH {_AIRPORTS}, h AS (SELECT *, iata = 'BUI' OR icao = 'BUI' OR local = 'BUI' AS exact, starts_with(lower(name), 'bui') OR starts_with(lower(city), 'bui') AS first FROM r WHERE contains(lower(name || ' ' || city), 'bui') OR iata = 'BUI' OR icao = 'BUI' OR local = 'BUI')
 SELECT row_number() OVER (ORDER BY exact DESC, NOT exact AND first DESC, rank, name, CAST(id AS VARCHAR)) AS place, count(*) OVER () AS total, name FROM h ORDER BY place LIMIT 20""")
def airport_search(spark, sf):
    """The first twenty for one query, with the number of all: a limit is the feature."""
    return airports.searched(_dimension(spark, sf), "Bui", 20).select("place", "total", "name")


@_query("""SELECT 'S' || lpad(CAST(ps % 100 AS VARCHAR), 3, '0') AS icao, arg_max(w, (e, u)) AS wmo FROM (SELECT s_suppkey AS ps, lpad(CAST(s_suppkey % 89000 + 10000 AS VARCHAR), 5, '0') AS w, CAST(s_suppkey * 7 % 1000 AS VARCHAR) AS e, CAST(s_suppkey % 89000 + 10000 AS VARCHAR) || '0' AS u FROM supplier) GROUP BY 1""")
def latest_stations(spark, sf):
    k = F.col("s_suppkey")
    stations = _t(spark, sf, "supplier").select(F.concat(F.lit("S"), F.lpad((k % 100).cast("string"), 3, "0")).alias("ICAO"), F.concat((k % 89000 + 10000).cast("string"), F.lit("0")).alias("USAF"), (k * 7 % 1000).cast("string").alias("END"))
    return airports.latest_stations(stations)


# ---- curation ---------------------------------------------------------------------------

_VOTES = "v AS (SELECT o_custkey % 20 AS file, o_orderstatus AS part, o_orderpriority AS key, CAST(o_custkey % 4 AS VARCHAR) AS answer, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL)"


def _votes(spark, sf):
    o = _t(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("file"), F.col("o_orderstatus").alias("part"), F.col("o_orderpriority").alias("key"), (F.col("o_custkey") % 4).cast("string").alias("answer"), "o_orderkey")
    return o.groupBy("file", "part", "key", "answer").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@_query(f"WITH {_VOTES}, m AS (SELECT part, key, answer, sum(n) AS n, min(first) AS first FROM v GROUP BY 1, 2, 3) SELECT part, key, answer FROM m QUALIFY row_number() OVER (PARTITION BY part, key ORDER BY n DESC, first) = 1")
def learned_conventions(spark, sf):
    v = _votes(spark, sf)
    return curation.conventions(curation.merged_votes(v.filter("file < 10"), v.filter("file >= 10")))


@_query(f"""WITH {_VOTES}, t AS (SELECT part, key, answer, sum(n) AS n, min(first) AS first FROM v GROUP BY 1, 2, 3), q AS (SELECT DISTINCT file, part, key FROM v),
 l AS (SELECT q.file, t.part, t.key, t.answer, t.n - coalesce(o.n, 0) AS n, t.first FROM q JOIN t USING (part, key) LEFT JOIN v o ON o.file = q.file AND o.part = t.part AND o.key = t.key AND o.answer = t.answer)
 SELECT file, part, key, answer FROM l WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY file, part, key ORDER BY n DESC, first) = 1""")
def conventions_without_own(spark, sf):
    return curation.leave_one_out(_votes(spark, sf), "file")


_COPIES = "r AS (SELECT p_brand AS g, p_partkey % 3 AS copy, (row_number() OVER (PARTITION BY p_brand, p_partkey % 3 ORDER BY p_partkey)) AS place, p_size % 4 AS digest FROM part)"


@_query(f"""WITH {_COPIES}, o AS (SELECT * FROM r WHERE copy <> 0), k AS (SELECT DISTINCT g, copy FROM o), m AS (SELECT k.g, k.copy, b.place, b.digest FROM k JOIN r b ON b.g = k.g AND b.copy = 0),
 d AS (SELECT coalesce(o.g, m.g) AS g, count(*) AS differing FROM o FULL JOIN m ON m.g = o.g AND m.copy = o.copy AND m.place = o.place WHERE o.digest IS DISTINCT FROM m.digest GROUP BY 1) SELECT g, differing FROM d WHERE g IN (SELECT g FROM r WHERE copy = 0)""")
def label_conflicts(spark, sf):
    n = F.row_number().over(duties.W.partitionBy("p_brand", F.col("p_partkey") % 3).orderBy("p_partkey"))
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("g"), (F.col("p_partkey") % 3).alias("copy"), n.alias("place"), (F.col("p_size") % 4).alias("digest"))
    chosen = rows.filter("copy = 0").select("g", "copy").distinct()
    return curation.conflicts(rows, chosen, "g", "copy", "place", "digest").select("g", "differing")


@_query("""WITH h AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS hash, doc_id % 3 <> 0 AS fresh FROM documents) SELECT hash, fresh, fresh AND CAST(('0x' || substr(hash, 1, 2)) AS BIGINT) % 4 = 0 AS is_test FROM h""")
def unseen_tests(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("hash"))
    return curation.unseen_tests(d.select("hash"), d.filter("doc_id % 3 = 0").select("hash"), 10).select("hash", "fresh", "is_test")


@_query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT sum(n) AS t, count(*) AS k, sum(sqrt(n)) / sum(n) AS m FROM c) SELECT source, round(least(100.0, t / (k * n)), 6) AS balanced, round(sqrt(n) / n / m, 6) AS by_layout FROM c, s""")
def class_weights(spark, sf):
    d = _t(spark, sf, "documents").select("source")
    both = curation.layout_weights(curation.balanced_weights(d, "source").withColumnRenamed("weight", "balanced"), "source")
    return both.groupBy("source").agg(F.round(F.max("balanced"), 6).alias("balanced"), F.round(F.max("weight"), 6).alias("by_layout"))


@_query("""SELECT sha1(string_agg(line, chr(10) ORDER BY line)) AS fingerprint, count(*) AS files FROM (SELECT 'f' || doc_id || chr(9) || CASE WHEN doc_id % 2 = 0 THEN md5(lang) ELSE '' END || chr(9) || md5(text) AS line FROM documents)""")
def inputs_fingerprint(spark, sf):
    k = F.col("doc_id")
    return metrics.inputs_fingerprint(_t(spark, sf, "documents").select(F.concat(F.lit("f"), k.cast("string")).alias("name"), F.when(k % 2 == 0, F.md5("lang")).alias("label_digest"), F.md5("text").alias("file_digest")))


_STORED = "f AS (SELECT 'f' || doc_id || '.' || ['pdf', 'JPG', 'csv'][CAST(doc_id % 3 AS INT) + 1] AS name, n_chars AS size, doc_id % 4 = 0 AS labelled FROM documents)"


def _stored(spark, sf):
    k = F.col("doc_id")
    ending = F.get(F.array(*map(F.lit, ["pdf", "JPG", "csv"])), (k % 3).cast("int"))
    return _t(spark, sf, "documents").select(F.concat(F.lit("f"), k.cast("string"), F.lit("."), ending).alias("name"), F.col("n_chars").alias("size"), (k % 4 == 0).alias("labelled"))


@_query(f"WITH {_STORED} SELECT CASE WHEN grouping(e) = 0 THEN e END AS extension, count(*) AS files, count(*) FILTER (labelled) AS labelled, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT *, lower(regexp_extract(name, '\\.([a-zA-Z0-9]+)$', 1)) AS e FROM f) GROUP BY GROUPING SETS ((), (e))")
def storage_stats(spark, sf):
    return metrics.storage_stats(_stored(spark, sf))


@_query(f"WITH {_STORED}, t AS (SELECT CASE WHEN name LIKE '%.pdf' THEN 'pdf' WHEN name LIKE '%.csv' THEN 'csv' ELSE 'image' END AS type FROM f WHERE labelled) SELECT d.type, count(t.type) AS n FROM (VALUES ('image'), ('pdf'), ('csv'), ('xls'), ('xlsx'), ('txt')) d(type) LEFT JOIN t ON t.type = d.type GROUP BY 1")
def labelled_by_type(spark, sf):
    return metrics.labelled_by_type(_stored(spark, sf))


@_query("""WITH w AS (SELECT conv_id, turn, role, length(text) % 3 = 0 AS bad FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, bad ORDER BY turn) AS k FROM w)
 SELECT conv_id, count(*) AS words, count(*) FILTER (bad) AS suspects, coalesce(list(role ORDER BY turn) FILTER (bad AND k <= 5), []) AS examples FROM n GROUP BY conv_id""")
def suspect_words(spark, sf):
    words = _t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("place"), F.col("role").alias("t"), F.length("text").alias("n"))
    return metrics.suspect_words(words, "conv_id", F.col("n") % 3 == 0)


@_query("""WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2)
 SELECT a.doc_id, CAST(sum(least(a.n, b.n)) AS BIGINT) AS common FROM c a JOIN c b ON b.doc_id = a.doc_id + 1 AND b.word = a.word GROUP BY 1""")
def common_words(spark, sf):
    """Words that neighbouring documents share, each as often as the rarer side has it."""
    words = _t(spark, sf, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).filter("word <> ''")
    return relational.words_in_common(words, words.withColumn("doc_id", F.col("doc_id") - 1), ["doc_id"], "word")


# ---- records and streams ----------------------------------------------------------------


@_query("""SELECT event_id, strftime(CAST(ts AS DATE) + CAST(k AS INT), '%Y-%m-%d') AS day, CAST(event_id % 30 + k AS DOUBLE) AS high, CAST(event_id % 30 - k AS DOUBLE) AS low, CAST(k AS INT) AS code, CAST(event_id % 100 AS INT) AS rain FROM events, (VALUES (0), (1), (2)) d(k) WHERE event_type = 'purchase'""")
def forecast_days(spark, sf):
    """Answers of parallel arrays, three days each, as a row a day."""
    e, n = _t(spark, sf, "events").filter("event_type = 'purchase'"), F.col("event_id")
    days = lambda f: F.array(*map(f, range(3)))
    answer = F.to_json(F.struct(F.struct(
        days(lambda k: F.date_format(F.date_add(F.to_date("ts"), k), "yyyy-MM-dd")).alias("time"), days(lambda k: (n % 30 + k).cast("double")).alias("temperature_2m_max"), days(lambda k: (n % 30 - k).cast("double")).alias("temperature_2m_min"),
        days(F.lit).alias("weather_code"), days(lambda k: (n % 100).cast("int")).alias("precipitation_probability_max"),
    ).alias("daily")))
    return records.forecast_days(e.select("event_id", answer.alias("answer")), "answer", "event_id")


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS tx, 'COMPLETED' AS state, CAST(o_totalprice AS DECIMAL(14,2))::DOUBLE AS gross, CASE WHEN o_orderkey % 2 = 0 THEN 1.5 ELSE CAST(o_totalprice AS DECIMAL(14,2))::DOUBLE END AS net, 'USD' AS currency FROM orders""")
def payment_pages(spark, sf):
    """Pages of ten payments that overlap, each payment once."""
    o, k = _t(spark, sf, "orders"), F.col("o_orderkey")
    money = lambda v: F.struct(v.alias("value"), F.lit("USD").alias("currency_code"))
    price = F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    amount = F.struct(money(price).alias("gross_amount"), money(F.lit("0.10")).alias("fee_amount"), F.when(k % 2 == 0, money(F.lit("1.50"))).alias("net_amount"))
    one = F.struct(k.cast("string").alias("id"), F.lit("COMPLETED").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"), amount.alias("amount_with_breakdown"))
    page = o.select(F.explode(F.array(F.floor(k / 10), F.floor(k / 10) + 1)).alias("page"), one.alias("t")).groupBy("page").agg(F.collect_list("t").alias("transactions"))
    found = records.payment_pages(page.select(F.to_json(F.struct("transactions")).alias("body")), "body")
    return found.select("tx", "state", F.col("gross").cast("double").alias("gross"), F.col("net").cast("double").alias("net"), "currency")


@_query("""SELECT event_id, event_type AS step, event_id % 40 AS done, 40 AS total, floor(event_id % 40 * 100 / 40) AS percent FROM events""")
def log_progress(spark, sf):
    n = F.col("event_id")
    line = F.concat(F.lit("["), "event_type", F.lit("] "), (n % 40).cast("string"), F.lit("/40 files"))
    return usage.progress(_t(spark, sf, "events").select("event_id", line.alias("line")), "line").drop("line")


@_query("SELECT event_id, user_id FROM events")
def stream_once(spark, sf):
    """The folder's events as a stream in which every event comes twice, each kept once."""
    schema = _t(spark, sf, "events").schema
    calls = usage.replayed(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = calls.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return usage.appended(usage.once(twice.select("event_id", "user_id", "ts"), "event_id", "ts", "400 days").select("event_id", "user_id"))


@_query("""SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id""")
def merged_batches(spark, sf):
    """Counters of two micro-batches merged into a store."""
    e = _t(spark, sf, "events").select("user_id", "event_id", F.lit(1).cast("long").alias("events"), (F.col("event_type") == "error").cast("long").alias("errors"))
    store = spark.createDataFrame([], "user_id long, events long, errors long").select(F.col("user_id").cast(e.schema["user_id"].dataType).alias("user_id"), "events", "errors")
    for k in (0, 1):
        store = usage.merged_counters(store, e.filter(F.col("event_id") % 2 == k), ["user_id"], ["events", "errors"])
    return store


@_query("""SELECT o_orderkey, '"' || o_orderpriority || '"' || chr(10) || '"x, y",b' AS text FROM orders""")
def unwrapped_lines(spark, sf):
    """Exports whose lines were quoted a second time."""
    text = F.concat(F.lit('"""'), "o_orderpriority", F.lit('"""\n"""x, y"",b"'))
    return _t(spark, sf, "orders").select("o_orderkey", T.unwrapped(text).alias("text"))
