"""Every stage of the pipeline, on what its predecessor kept, against brute force."""

import hashlib
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from brute import brute_fingerprint, brute_repeats
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import bpe, toxicity
from skyledger.llm.queries import vocabulary
from skyledger.llm.textbatch import ALNUM, blocks

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """sf0.001's documents with odd rows among them and further columns."""
    at = tmp_path_factory.mktemp("corpus")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(1)
    fresh = lambda: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(60))
    passage, twin = fresh(), fresh()
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 120").first().text
    texts = [(9001, passage + " one"), (9002, fresh() + " " + passage), (9003, twin), (9004, twin + " more"), (None, twin), (None, fresh()), (None, fresh()), (9005, None), (9006, ""), (9007, fresh() + " " + leak), (9007, fresh())]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], docs.schema)
    docs.unionByName(odd).withColumn("key", F.lit(4)).withColumn("_n_words", F.lit("own")).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def chain(spark, folder):
    """(name, rows in, rows out) of every stage."""
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet").cache()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder).cache()
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return {name: (a, b) for name, a, b in out}


def pairs(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=lambda x: tuple((y is None, y) for y in x))


def test_toxic_documents_go_and_all_others_stay(spark, folder, chain):
    before, after = chain["toxicity"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = lambda t: model.scores(next(blocks(pa.array([t]), ALNUM, lower=True))[2], 1)[0]
    assert pairs(after) == pairs([r for r in before if score(r.text) < toxicity.THRESHOLD]) and 0 < len(after) < len(before)
    assert all(r.key == 4 and r["_n_words"] == "own" for r in after)


def test_one_of_each_group_of_near_copies_stays(chain):
    before, after = chain["near_copies"]
    prints = [brute_fingerprint(r.text) for r in before]
    near = [[j for j in range(len(before)) if (prints[i] ^ prints[j]).bit_count() <= 4] for i in range(len(before))]
    group, n = [-1] * len(before), 0
    for i in range(len(before)):
        todo = [i] if group[i] < 0 else []
        while todo:
            x = todo.pop()
            if group[x] < 0:
                group[x] = n
                todo += near[x]
        n += 1
    order = lambda k: (before[k].doc_id is None, before[k].doc_id or 0, prints[k] - (prints[k] >> 63 << 64), hashlib.sha256(before[k].text.encode()).hexdigest() if before[k].text is not None else "~")
    kept = [min((k for k in range(len(before)) if group[k] == g), key=order) for g in sorted(set(group))]
    assert pairs(after) == pairs([before[k] for k in kept]) and len(after) < len(before)


def test_repeated_passages_are_cut(chain):
    before, after = chain["repeats"]
    want = sorted(x[2] for x in brute_repeats([(r.doc_id, r.text) for r in before]))
    assert sorted(hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).encode()).hexdigest() for r in after) == want
    assert any(r.doc_id == 9002 and len(r.text.split()) == 60 for r in after)


def test_leaks_go(spark, folder, chain):
    before, after = chain["benchmark_leaks"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    leaks = lambda t: any(tuple(w[i : i + k]) in grams for w in [words(t)] for k in sizes for i in range(len(w) - k + 1))
    assert pairs(after) == pairs([r for r in before if not leaks(r.text)]) and 9007 in {r.doc_id for r in before}


def test_tokens_and_whole_run(spark, folder, chain):
    before, after = chain["tokens"]
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary()), special_tokens={})
    want = []
    for r in before:
        ids = theirs.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    key = lambda x: tuple((y is None, y) for y in x)
    assert sorted(map(tuple, after), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=key) == sorted(want, key=key)
