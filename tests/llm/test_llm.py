"""Training-data operators against brute force, on a small table with every odd case."""

import base64
import hashlib
import random
import re
import zlib

import pytest
import tiktoken
from brute import brute_fingerprint, brute_repeats
from pyspark.sql import functions as F

from skyledger.llm import bpe, components, decontaminate, hashed, licenses, quality_model, quality_rules, scratch, sharding, simhash, substring, toxicity, urlfilter
from skyledger.llm.queries import URL_RULES, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, first int, spans string, bucket long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "d", "épée", "zeta.", "eta", "x|y", "9", "the"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [None, "", " \n\t ", "one", "a b c", "Ab " * 400, passage, passage, passage + " tail", "\n".join([passage] * 3), "Z" * 5000, "don't we'll  go\n\n now 😀"]
    for _ in range(40):
        body = " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 200)))
        texts.append(body if rng.random() < 0.5 else body + "\n" + passage + "\nLicensed under CC BY-NC 4.0.")
    out = [(i, t, None if i % 5 == 0 else "en", "s", None, 1, "x", 7) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids, rows that repeat, and one id with two texts."""
    return spark.createDataFrame([*rows[:9], rows[0], rows[3], (None, "no id at all", None, None, None, None, None, None), (1, "another text of id one", None, None, None, None, None, None)], SCHEMA)


def counts_of(found):
    return [(r[substring.N_WORDS], r[substring.N_REMOVED], r[substring.KEPT_SHA256]) for r in found]


@pytest.mark.parametrize("largest", [substring.LARGEST, 2000, 0])
def test_substring(docs, rows, largest):
    want = dict(zip((r[0] for r in rows), brute_repeats(rows)))
    for r in substring.remove_repeats(docs, largest=largest).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        assert counts_of([r]) == [want[r.doc_id]] and r.bucket == 7
        assert hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest() == want[r.doc_id][2] and (want[r.doc_id][1] or r.text == text)


def test_substring_null_shared_ids_and_clashing_names(spark):
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join(rng.choice("abcdef") for _ in range(40)) + " " + passage for _ in range(6)]
    made = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (5, "a " * 30), (5, "a " * 20), (7, "a " * 15), (None, ""), (None, None), (9, texts[0]), (9, texts[3]), (9, texts[3])]
    table = spark.createDataFrame([(*r, i, "x", 3) for i, r in enumerate(made)], "doc_id long, text string, _n_words int, _kept_sha256 string, key int").repartition(3)
    for largest in (substring.LARGEST, 0):
        found = sorted(substring.remove_repeats(table, largest=largest).collect(), key=lambda r: r["_n_words"])
        assert counts_of(found) == brute_repeats(made) and [r.doc_id for r in found] == [r[0] for r in made]
        assert {(r["_kept_sha256"], r.key) for r in found} == {("x", 3)}


def test_simhash(docs, rows):
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    least = {i: i for i in prints}
    for _ in prints:
        least = {i: min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", least[i]) for i, p in prints.items()}
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == sorted({*least.values()})


def test_simhash_null_and_shared_ids(spark):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(300)) for _ in range(8)]
    near = [t + " x" for t in base]
    assert all((brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() <= 4 for a, b in zip(base, near))
    made = [(3, base[0]), (9, base[1]), (None, near[0]), (None, near[1]), (None, base[2]), (None, base[3]), (None, near[3]), (None, base[4]), (None, base[4]), (5, base[5]), (5, base[6]), (5, near[6]), (7, base[7]), (7, base[7])]
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    prints = [brute_fingerprint(t) for _, t in made]
    order = lambda k: (made[k][0] is None, made[k][0] or 0, prints[k] - (prints[k] >> 63 << 64), hashlib.sha256(made[k][1].encode()).hexdigest())
    group = [min((j for j in range(len(made)) if (prints[i] ^ prints[j]).bit_count() <= 4), key=order) for i in range(len(made))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = simhash.near_duplicates(table).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted([(made[i][0], f"{prints[i]:016x}", made[group[i]][0]) for i in range(len(made))], key=key)
    kept = sorted(map(tuple, simhash.representatives(table).collect()), key=key)
    assert kept == sorted({made[i] for i in group}, key=key) and len(kept) == 8


def test_pigeonring_loses_no_link():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    f = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]))
    forest = simhash._Forest(len(f))
    starts = np.concatenate([[0], np.cumsum(simhash.segment_widths(4))])
    for s in range(5):
        mask = np.uint64(((1 << int(starts[s + 1] - starts[s])) - 1) << int(starts[s]))
        for v in np.unique(f & mask):
            at = np.flatnonzero((f & mask) == v)
            for a, b in simhash.link_bucket(f[at], s, 4):
                forest.join(int(at[a]), int(at[b]))
    brute = simhash._Forest(len(f))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4):
            brute.join(i, int(j))
    assert [forest.root(i) for i in range(len(f))] == [brute.root(i) for i in range(len(f))]


def test_decontamination_both_ways(spark, docs):
    bench = spark.createDataFrame([(1, "Alpha beta gamma d"), (2, None), (3, ""), (4, "licensed under cc by nc 4 0"), (4, "the")], "item_id long, text string")
    d = decontaminate
    pick = lambda df: sorted((r.doc_id, r[d.N_WORDS], r[d.N_HIT], tuple(r[d.ITEMS])) for r in df.collect())
    narrow = docs.select("doc_id", "text")
    found = pick(d.scan(narrow, bench))
    assert found == pick(d.scan(narrow, bench, broadcast_bytes=0)) and any(r[2] for r in found)
    assert all(r[2] == 0 for r in pick(d.scan(d.spans_removed(narrow, bench.filter("item_id = 4 and length(text) > 3")), bench.filter("item_id = 4 and length(text) > 3"))))


def test_decontamination_cuts_alike_both_ways(spark):
    d = decontaminate
    texts = ["a, b - c! d", "x a, b; c y b c d; z", "b, c", None, "", "q a-b-c a b c. e", "none of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c"), (2, "b c d")], "item_id long, text string")
    spans = lambda size: {r.doc_id: [tuple(s) for s in r[d.SPANS]] for r in d.scan(docs, bench, broadcast_bytes=size).collect()}
    texts_left = lambda size: {r.doc_id: r.text for r in d.spans_removed(docs, bench, broadcast_bytes=size).collect()}
    assert spans(0) == spans(1 << 20) and spans(0)[1] == [(1, 4), (5, 8)] and spans(0)[5] == [(1, 7)]
    assert texts_left(0) == texts_left(1 << 20) and texts_left(0)[0] == "" and texts_left(0)[1] == "x  y ; z" and texts_left(0)[5] == "q . e"


def test_bpe_equals_tiktoken():
    ranks = bpe.load_ranks(vocabulary())
    import public_tokenizers

    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, ours = random.Random(2), bpe.Encoding(ranks)
    parts = ["'", "'s", "'re", "ll", " ", "  ", "\n", "a", "É", "１2", "!?", "\u00a0", "😀", "中", "the", "\x00", "\x1c", "tion"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["a" * 20000, " " * 500, "abcab" * 3000]
    for text, ids in zip(texts, ours.encode_all(texts)):
        assert ids.tolist() == theirs.encode_ordinary(text) and ours.decode(ids.tolist()) == text.encode()
    assert base64.b64encode(ours.pieces[0])


def test_quality_rules(docs, rows):
    texts = {r[0]: r[1] or "" for r in rows}
    found = quality_rules.verdicts(quality_rules.ledger(docs), 2)
    for r in found.collect():
        text = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {p for i, x in enumerate(wins) if wins.count(x) > 1 for p in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text) and (r.fail_bits & 1 == 1) == (len(w) < 10)
    for r in quality_rules.ablation(found, 2).collect():
        assert r.n_kept_without == r.n_kept + r.n_only


def test_sharding(spark, docs, rows):
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(None, f"no id {i}") for i in range(30)] + [(3, "again"), (3, "again")], "doc_id long, text string"))
    found, sizes = sharding.records(table, 64), sharding.slot_bytes(sharding.records(table, 64))
    assert len({r.vslot for r in found.filter("doc_id is null").collect()}) > 10
    bytes_of = {r.vslot: r.bytes for r in sizes.collect()}
    loads, want = [0] * 4, {}
    for v in sorted(bytes_of, key=lambda v: (-bytes_of[v], v)):
        want[v] = loads.index(min(loads))
        loads[want[v]] += bytes_of[v]
    got = sharding.sharded(table, shards=4, slots=64).collect()
    assert {(r.vslot, r.shard) for r in got} == set(want.items())
    for shard in range(4):
        own = sorted((r for r in got if r.shard == shard), key=lambda r: (r.vslot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]))
        alike = lambda r: (r.vslot, r.doc_id, r.text_crc32)
        assert sorted(r.slot for r in own) == list(range(len(own))) and sum(r["size"] for r in own) == loads[shard]
        assert [alike(r) for r in sorted(own, key=lambda r: r.slot)] == [alike(r) for r in own]
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id])) for r in got if r.doc_id is not None and r.doc_id != 3)
    first = sharding.first_map(sizes, 4)
    grown = {r.vslot: r.shard for r in sharding.grown_map(first, sizes, 4).collect()}
    assert all(s == grown[v] or grown[v] == 4 for _, v, s in map(tuple, first.collect())) and 4 in grown.values()


def test_shards_are_near_equal_and_rebalance(spark):
    rng = random.Random(3)
    table = spark.createDataFrame([(i, "x" * rng.randint(1, 900)) for i in range(6000)], "doc_id long, text string")
    sizes = sharding.slot_bytes(sharding.records(table, 512))
    before = sharding.first_map(sizes, 8)
    # the slots of one shard grow
    hot = before.filter("shard = 2").select("vslot")
    later = sizes.join(hot.withColumn("hot", F.lit(3)), "vslot", "left").select("vslot", (F.col("bytes") * F.coalesce("hot", F.lit(1))).alias("bytes"), "n")
    after = sharding.rebalanced_map(before, later, 8)
    moved = before.join(after.select("vslot", F.col("shard").alias("new")), "vslot")
    spread = lambda m, s: [r.b for r in m.join(s, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert max(spread(before, sizes)) < 1.01 * min(spread(before, sizes)) and len(spread(before, sizes)) == 8
    assert max(spread(after, later)) < 1.1 * min(spread(after, later)) and max(spread(before, later)) > 2.5 * min(spread(before, later))
    assert moved.filter("shard <> new and shard <> 2").count() == 0 and after.select("version").distinct().collect()[0][0] == 2


def test_licenses(spark):
    texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "cc by cc by", "released under the MITT license", None, "This work is licensed under the GNU General Public License, version 3."]
    found = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert found[0].labels == "mit-notice" and found[1].labels == "cc-by,cc-by-notice" and found[1].first_word == 2
    assert (found[2].n_base, found[2].first_word, found[2].last_word) == (2, 0, 2) and found[3].labels == "" and found[4].n_words == 0 and found[4].first_word is None
    assert found[5].labels == "gpl,gpl-notice"


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""


def test_whole_licences():
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.TEMPLATES)
    labels = lambda t: {x[0] for x in scanner.matches(licenses.normal(t))}
    for label, text in (("mit-text", MIT), ("bsd-text", BSD), ("isc-text", ISC)):
        assert labels(text) == {label} and labels("x y\n" + "\n".join(" * " + x for x in text.split("\n")) + " z") == {label}
        assert scanner.matches(licenses.normal("x y " + text + " z")) == [(label, 2, len(licenses.normal(text).split()))]
        parts = text.split("\n\n")
        # the opening alone, the disclaimer left out or alone, one word more, less or other
        for other in (parts[0], text[: len(text) // 2], "\n".join(parts[:-1]), parts[-1], text.replace("LIABLE", "HELD LIABLE"), text.replace("fee ", "").replace("notice ", "", 1), text.replace("IN NO EVENT", "IN ANY EVENT")):
            assert other == text or labels(other) == set()
    assert labels(BSD.replace("3. Neither", "Neither")) == {"bsd-text"} and labels("".join(x for x in BSD.splitlines(True) if not x.startswith("3."))) == {"bsd-text"}
    assert labels("".join(x for x in BSD.splitlines(True) if not x.startswith("2."))) == set() and labels(BSD.replace("without specific prior", "with no")) == set()
    assert labels("Licensed under the MIT License") == {"mit-notice"} and labels("unlicensed under the MITT License") == set()
    assert labels(GPL) == {"gpl-header"} and labels(GPL.replace("General", "Lesser General")) == {"lgpl-header"} and labels(GPL.replace("either version 3", "either version 2.1")) == {"gpl-header"}
    assert labels(GPL.replace("you can redistribute", "you cannot redistribute")) == set()


def as_pattern(markup):
    """A template as a regular expression over words that end in a blank each."""
    out = []
    for token in licenses._MARKUP.findall(markup):
        fixed = {"[[": "(?:", "]]": ")?", "<<": "(?:", ">>": ")", "|": "|"}
        out.append(fixed.get(token) or (r"(?:\S+ ){0,%d}" % int(token[2:-2]) if token.startswith("{{") else re.escape(token) + " "))
    return re.compile("".join(out))


def test_licences_against_patterns():
    rng = random.Random(8)
    small = {
        "a": "alpha [[beta]] gamma {{2}} delta", "b": "<<alpha|beta gamma>> delta [[beta]] alpha", "c": "[[gamma]] {{1}} beta beta", "d": "delta <<[[alpha]] beta|gamma {{1}}>> gamma", "e": "alpha beta"
    }
    patterns, scanner = {k: as_pattern(m) for k, m in small.items()}, licenses.Scanner({"beta gamma": "bg", "beta": "b"}, small)
    for _ in range(400):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "x"]) for _ in range(rng.randint(0, 25))]
        found = scanner.matches(licenses.normal(" ".join(words)))
        want = {k for k, p in patterns.items() for i in range(len(words)) if p.match("".join(w + " " for w in words[i:]))}
        assert {x[0] for x in found} == want
        for label, at, n in found:
            assert patterns[label].fullmatch("".join(w + " " for w in words[at : at + n]))
        places = [("bg", i) for i in range(len(words) - 1) if words[i : i + 2] == ["beta", "gamma"]] + [("b", i) for i, w in enumerate(words) if w == "beta"]
        assert sorted(scanner.places(licenses.normal(" ".join(words)))) == sorted(places)


def test_urls(spark):
    urls = [None, "nothing", "http://WWW.Example.com/en/1?x#y", "https://a.example.com/en/2", "http://b.net/es/", "x://example.com", "http://other.com/a#b/c", "http://b.net/es/"]
    table = spark.createDataFrame([(i, u, None, 1.5) for i, u in enumerate(urls)], "page_id int, url string, html string, score double")
    found = {r.page_id: r for r in urlfilter.judged(table, URL_RULES).collect()}
    assert len(found) == 8 and (found[2].host, found[2].path, found[2].rule) == ("www.example.com", "/en/1", "www.example.com/en/") and found[2].verdict == "allow"
    assert [found[i].rule for i in (0, 1, 3, 4, 5, 6)] == [None, None, "example.com/en/", "net/es/", None, "com/"] and found[6].path == "/a"
    assert [(found[i].host, found[i].path) for i in (0, 1)] == [("", "")] * 2 and found[4].verdict == found[7].verdict == "block"
    assert urlfilter.judged(table.limit(0), URL_RULES).count() == 0


def spam_and_news(rng, n):
    for _ in range(n):
        spam = rng.random() < 0.4
        host = f"{rng.choice(['cheap', 'win'])}-pills{rng.randint(0, 300)}.{rng.choice(['biz', 'com', 'net'])}" if spam and rng.random() < 0.9 else f"{rng.choice(['news', 'lab'])}{rng.randint(0, 300)}.{rng.choice(['org', 'com', 'net'])}"
        query = "?" + "&".join(f"k{j}={rng.randint(0, 999)}" for j in range(rng.randint(1, 5))) if spam and rng.random() < 0.7 else ""
        yield f"http://{host}/" + "/".join(f"page{rng.randint(0, 10**6 if spam else 50)}" for _ in range(rng.randint(1, 4))) + query, int(spam)


def test_url_trees_judge_hosts_that_they_have_not_seen(spark):
    rng = random.Random(4)
    made = [(u, s, u.split("/")[2]) for u, s in spam_and_news(rng, 3000)]
    seen, unseen = ([x for x in made if zlib.crc32(x[2].encode() + b"#") % 2 == k] for k in (0, 1))
    pages = spark.createDataFrame([(i, u, None) for i, (u, _, _) in enumerate(unseen)], "page_id int, url string, html string")
    verdicts = {r.page_id: r for r in urlfilter.judged(pages, [urlfilter.Rule("allow", "biz/")], spark.createDataFrame([x[:2] for x in seen], "url string, label int")).collect()}
    assert all(r.verdict == "allow" for r in verdicts.values() if r.rule)
    right = [(verdicts[i].verdict == "block") == bool(s) for i, (_, s, _) in enumerate(unseen) if not verdicts[i].rule]
    assert len(right) > 500 and sum(right) > 0.95 * len(right) and {r.verdict for r in verdicts.values() if not r.rule} == {"allow", "block"}


def test_url_labels_without_meaning_leave_no_trees():
    rng = random.Random(6)
    import numpy as np

    urls = [(f"http://h{rng.randint(0, 500)}.org/{i}", f"h{rng.randint(0, 500)}.org", f"/{i}") for i in range(2000)]
    model = urlfilter.fit(urls, np.array([float(rng.random() < 0.2) for _ in urls]))
    assert max(model.scores(urls)) < 0.5


def test_junk_pages(spark):
    words = "some plain words of a page that goes on for a while with sentences and stops. " * 6
    pages = [f"<p>{words}</p><script>{'#$%' * 900}</script>", "<p>few words</p>", f"<p>{words}</p>{'<b>| # $ %</b>' * 90}", f"<p>{words.upper()}</p>", None, f"<p>{words}</p>{' 12345678' * 60}"]
    found = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", urlfilter.junk_page(F.col("html")).alias("junk")).collect()
    assert [r.junk for r in sorted(found)] == [0, 1, 1, 1, 1, 1]


def test_boosted_trees_split_where_labels_do():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.7)).astype(float)
    model = urlfilter.Boosted(40).fit(x[:1000], y[:1000])
    assert ((model.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.97
    losses = model.losses(x[1000:], y[1000:])
    assert len(losses) == 41 and losses[-1] < 0.2 < losses[0]


def test_toxicity_holds_out(spark):
    rng = random.Random(9)
    plain = [f"w{rng.randint(0, 50)}" for _ in range(400)]
    made = [(i, " ".join(rng.choice(plain) for _ in range(40)) + (" awful nasty" if i % 6 == 0 else ""), int(i % 6 == 0)) for i in range(600)]
    table = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    held = toxicity.scored(table, model).filter(toxicity.held_out("doc_id")).collect()
    assert sum((r[toxicity.SCORE] >= 0.3) == (r.toxic == 1) for r in held) > 0.95 * len(held)
    assert toxicity.train(table.select("doc_id", "text"), table.filter("toxic = 0").select("doc_id", "toxic")) is None


def test_toxicity_catches_at_its_threshold_whatever_the_sample():
    import numpy as np

    for seed in range(3):
        rng = np.random.default_rng(seed)
        text = lambda k: np.unique(np.concatenate([rng.integers(1000, 1400, 40), rng.choice(150, k, replace=False)]).astype(np.uint32)).tobytes()  # noqa: E731, B023
        toxic, clean, other = [text(3) for _ in range(900)], [text(0) for _ in range(900)], [text(0 if i % 10 else 3) for i in range(2500)]
        model = toxicity.fit_scaled(toxic, other, clean, 0.1)
        new, plain = (hashed.sigmoid(model.logits([text(k) for _ in range(n)])) for k, n in ((3, 400), (0, 800)))
        # the bare risk catches 0.96 to 0.983 of such texts
        assert (new >= toxicity.THRESHOLD).mean() > 0.985 and (plain < toxicity.THRESHOLD).mean() > 0.99
        few = toxicity.fit_scaled(toxic[:20], other, clean[:5], 0.1)  # too few known texts to set a scale
        assert len(few.logits(new_texts := [text(3), text(0)])) == len(new_texts) and np.isfinite(few.logits(new_texts)).all()
    x = np.linspace(-4, 4, 401)
    p = 1 / (1 + np.exp(-(2 * x + 1)))
    drawn = np.random.default_rng(1).random((50, 401)) < p
    every = np.tile(x, (50, 1))
    a, b = toxicity.scale(every[drawn], every[~drawn], drawn.mean() / (drawn.mean() + toxicity.MISSED * (1 - drawn.mean())))
    assert abs(a - 2) < 0.15 and abs(b - 1) < 0.15
    assert toxicity.scale(x[:3], x, 0.5) == (1.0, 0.0) and toxicity.scale(-x[x > 0], x[x > 0], 0.5) == (1.0, 0.0)


def auc(labels, scores):
    order = sorted(range(len(labels)), key=lambda i: scores[i])
    ranks = [r + 1 for r, i in enumerate(order) if labels[i]]
    n = len(ranks)
    return (sum(ranks) - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_quality_scores_follow_labels_never_seen(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality_model.classified(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality is not null"), "doc_id").select("quality", "score", "posterior", "kept").collect()
    assert len(rows) > 300 and auc([r.quality == 1 for r in rows], [r.score for r in rows]) > 0.95
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.9 * len(rows)


def test_labeller_accuracies_are_found():
    import numpy as np

    rng = np.random.default_rng(5)
    truth = rng.random(20000) < 0.75
    cast = np.full((20000, len(quality_model.LABELLERS)), quality_model.ABSTAIN)
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.9]
    for j, p in enumerate(right):
        speaks, good = rng.random(20000) < 0.7, rng.random(20000) < p
        cast[speaks, j] = np.where(good == truth, quality_model.GOOD, quality_model.BAD)[speaks]
    pattern, count = np.unique(quality_model._pattern(cast), return_counts=True)
    posterior, accuracy = quality_model.fit_labellers(pattern, count)
    assert np.abs(accuracy - right).max() < 0.05
    assert ((posterior[np.searchsorted(pattern, quality_model._pattern(cast))] > 0.5) == truth).mean() > 0.95


def test_very_long_texts(spark):
    rng = random.Random(10)
    vocabulary_ = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(vocabulary_) for _ in range(250_000)) + "\nLicensed under the MIT License and all rights reserved"
    made = [(1, long), (2, "head " + long[700_000:] + " tail"), (3, "short text")]
    assert min(len(t) for _, t in made[:2]) > 700_000
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert counts_of(sorted(substring.remove_repeats(table).collect())) == brute_repeats(made)
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(table).collect()} == {i: f"{brute_fingerprint(t):016x}" for i, t in made}
    scan = {r.doc_id: r for r in licenses.license_scan(table).collect()}
    last = len(licenses.normal(long).split())
    assert (scan[1].n_words, scan[1].n_base, scan[1].first_word) == (last, 1, last - 3) and scan[1].labels == "mit-notice,reserved"
    rules = {r.doc_id: r for r in quality_rules.ledger(table).collect()}
    assert rules[1].n_words == len(long.split()) and rules[1].word_chars == sum(map(len, long.split())) and rules[1].n_repeat_words == 0
    bench = spark.createDataFrame([(1, " ".join(long.split()[200_000:200_040]))], "item_id long, text string")
    hits = {r.doc_id: r[decontaminate.N_HIT] for r in decontaminate.scan(table, bench).collect()}
    assert hits[1] == 40 and hits[3] == 0
    assert {r.doc_id for r in quality_model.classified(table).collect()} == {1, 2, 3} == {r.doc_id for r in toxicity.scored(table, None).collect()}


def test_training_texts_give_a_bounded_number_of_features():
    import numpy as np

    rng = np.random.default_rng(1)
    feature = np.unique(rng.integers(0, 2**32, 30_000, dtype=np.uint32))
    row = np.concatenate([np.zeros(len(feature), np.int64), np.full(3, 2)])
    out = hashed.packed(row, np.concatenate([feature, feature[:3]]), 4, most=1000)
    got = np.frombuffer(out[0], np.uint32)
    assert [len(x) // 4 for x in out] == [1000, 0, 3, 0] and np.isin(got, feature).all() and (np.diff(got.astype(np.int64)) > 0).all()
    assert abs(np.searchsorted(feature, got).mean() / len(feature) - 0.5) < 0.05


@pytest.mark.parametrize("links", [256, 3])
def test_components_of_hubs_chains_and_random_links(spark, monkeypatch, links):
    monkeypatch.setattr(scratch, "HOT_ROWS", links)
    rng = random.Random(1)
    edges = [(500, i) for i in range(300)] + [(i, i + 1) for i in range(600, 640)] + [(rng.randint(700, 900), rng.randint(700, 900)) for _ in range(150)] + [(100, 901)]
    edges = [e for e in edges if e[0] != e[1]]
    forest = simhash._Forest(1000)
    for a, b in edges:
        forest.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*edges, *edges[:50]], "a long, b long")).collect()}
    assert got == {x: forest.root(x) for e in edges for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_and_empty_tables(spark, odd):
    """Null ids, ids with two texts, repeated rows: each row by its own text; and no rows at all."""
    empty, made = spark.createDataFrame([], SCHEMA), [(r.doc_id, r.text) for r in odd.collect()]
    bench = spark.createDataFrame([(1, "no id at all")], "item_id long, text string")
    none = bench.limit(0)
    every = lambda f: sorted(f, key=lambda x: tuple((y is None, y) for y in x))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    alnum = lambda t: licenses.normal(t).split()
    crc = lambda t: zlib.crc32((t or "").encode())
    d = decontaminate
    assert every(counts_of(substring.remove_repeats(odd).collect())) == every(brute_repeats(made))
    assert every((r.doc_id, r.fingerprint) for r in simhash.near_duplicates(odd).collect()) == every((i, f"{brute_fingerprint(t):016x}") for i, t in made)
    assert every((r.doc_id, r[d.N_WORDS], r[d.N_HIT]) for r in d.scan(odd, bench).collect()) == every((i, len(alnum(t)), 4 * (t == "no id at all")) for i, t in made)
    assert all(r[d.N_HIT] == 0 for r in d.scan(odd, none).collect())
    assert every((r.doc_id, r.n_words) for r in quality_rules.ledger(odd).collect()) == every((i, len(words(t))) for i, t in made)
    assert every((r.doc_id, r.text_crc32) for r in sharding.sharded(odd, 4, 64).collect()) == every((i, crc(t)) for i, t in made)
    assert every((r.doc_id, r.n_words) for r in licenses.license_scan(odd).collect()) == every((i, len(alnum(t))) for i, t in made)
    assert every((r.doc_id, r.decoded_sha256) for r in bpe.digests(odd, vocabulary()).collect()) == every((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in made)
    scores = {}
    for r in quality_model.classified(odd).collect():
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(x) <= len({t or "" for i, t in made if i == k}) for k, x in scores.items()) and len(scores) == len({i for i, _ in made})
    assert every((r.doc_id, r.text) for r in toxicity.scored(odd, None).collect()) == every(made)
    for found in (
        substring.remove_repeats(empty), simhash.near_duplicates(empty), simhash.representatives(empty), d.scan(empty, none), d.scan(empty, bench), quality_rules.ledger(empty), sharding.sharded(empty, 4, 64),
        licenses.license_scan(empty), bpe.digests(empty, vocabulary()), quality_model.classified(empty), toxicity.scored(empty, None),
    ):
        assert found.count() == 0
    assert every((r.doc_id, r.text) for r in simhash.representatives(odd).collect()) == every(set(map(tuple, simhash.representatives(odd).select("doc_id", "text").collect())))
