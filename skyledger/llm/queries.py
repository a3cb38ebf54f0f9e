"""Queries opN_<name> over the tables of a folder, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, licenses, quality_model, quality_rules, sharding, simhash, substring, toxicity, urlfilter

#: Fixed values of the url filter's query.
URL_RULES = [
    urlfilter.Rule("allow", "com/"),
    urlfilter.Rule("block", "example.com/en/"),
    urlfilter.Rule("allow", "www.example.com/en/"),
    urlfilter.Rule("block", "net/es/"),
    urlfilter.Rule("block", "net/fr/"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(_read(spark, sf_dir, "pages"), URL_RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate
    found = d.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col(d.N_WORDS).alias("n_words"), F.col(d.N_HIT).alias("n_hit"), F.size(d.ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(d.ITEMS), ","), 256).alias("items_sha256"), (F.col(d.N_HIT) > 0).alias("contaminated"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.verdicts(quality_rules.stored_ledger(_read(spark, sf_dir, "documents")), 2)
    base = F.lit(quality_rules.mask_of(quality_rules.POLICIES[1])).cast("long")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy 2 costs, from the bits of the ledger."""
    return quality_rules.ablation(quality_rules.stored_ledger(_read(spark, sf_dir, "documents")), 2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    score = F.col(toxicity.SCORE)
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, reach=4)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), vocabulary())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(_read(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring
    found = d.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), window=13, with_text=False)
    return found.select("doc_id", F.col(d.N_WORDS).alias("n_words"), F.col(d.N_REMOVED).alias("n_removed"), F.col(d.KEPT_SHA256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classified(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = (op1_url_filter, op2_decontamination, op3_quality_rules, op4_toxicity, op5_simhash, op6_license_scan, op7_bpe, op8_sharding, op9_substring_dedup, op10_quality_classifier)
    return {f.__name__: f for f in (*found, quality_ablation)} | {"pipeline": corpus_pipeline.run}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _windows(size: int, words: str = "w") -> str:
    return f"[array_to_string(list_slice({words}, i, i + {size} - 1), ' ') for i in range(1, len({words}) - {size} + 2)]"


_MEASURED = f"""
        WITH base AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        wins AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base)),
        twice AS (SELECT doc_id, gram FROM wins GROUP BY doc_id, gram HAVING count(*) > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM wins JOIN twice USING (doc_id, gram)) GROUP BY doc_id),
        lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM base),
        m AS (SELECT base.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
                     CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
              FROM base JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
        f AS (SELECT *, n_words < 10 AS r0, 100 * n_repeat_words > 20 * n_words AS r1, word_chars > 25 * n_words AS r2, 100 * n_symbols > 8 * word_chars AS r3,
                     100 * n_upper > 60 * word_chars AS r4, n_lines >= 5 AND 100 * n_dup_lines > 50 * n_lines AS r5 FROM m)"""

ORACLE_SQL = {
    "op2_decontamination": f"""
        WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE text IS NOT NULL),
        sized AS (SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
        grams AS (SELECT DISTINCT item, k, unnest([array_to_string(list_slice(w, i, i + k - 1), ' ') for i in range(1, len(w) - k + 2)]) AS gram FROM sized),
        docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        ks AS (SELECT DISTINCT k FROM sized),
        spread AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, ks WHERE len(w) >= k),
        wins AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM spread),
        hits AS (SELECT wins.doc_id, wins.i, wins.k, grams.item FROM wins JOIN grams USING (k, gram)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
        who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN who USING (doc_id)""",
    "op3_quality_rules": f"""{_MEASURED}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5) AS kept,
               CAST(r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT AS BIGINT) AS fail_bits FROM f""",
    "quality_ablation": f"""{_MEASURED},
        p AS (SELECT r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT AS bits FROM f),
        r AS (SELECT * FROM (VALUES ('too_short', 1), ('repetitive', 2), ('long_words', 4), ('symbols', 8), ('shouting', 16), ('dup_lines', 32)) r(rule, bit))
        SELECT rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_only, count(*) FILTER (bits & ~bit = 0) AS n_kept_without, count(*) FILTER (bits = 0) AS n_kept
        FROM p, r GROUP BY rule""",
    "op9_substring_dedup": f"""
        WITH base AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        wins AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM base)),
        firsts AS (SELECT gram, min(doc_id) AS first_doc FROM wins GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM wins JOIN firsts USING (gram) WHERE doc_id > first_doc),
        gone_of AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM base),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM base LEFT JOIN gone_of USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
