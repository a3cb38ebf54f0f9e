"""Benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark's windows (``size`` consecutive words of an item; an item with fewer is one
window) are hashed and broadcast as sorted arrays over the benchmark's packed words: 24 bytes a
window and the words once, so at most 14 times the text, whose bytes are measured first and
must stay within ``broadcast_bytes``. Documents are scanned once: every window's hash is
looked up, and a hit counts only after its words equal the benchmark's. A larger
benchmark takes the other way, a join of document and benchmark windows on their words, where
a window that very many documents have is one that the adaptive plan splits.

Defined results: null and empty texts have no words and no hits; items without words never
occur; items that share an id count once, a null id counts as an empty one; equal rows give
equal results, a row for each; very long texts are read whole; an empty table gives no rows, an
empty benchmark no hits. Columns of docs keep their names and values, but for names that begin
with __skyledger_, which are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import ALNUM, blocks, window_hashes

#: Largest benchmark, in bytes of text, that is broadcast.
BROADCAST_BYTES = 16 << 20
#: Log2 of the bits in the filter that most document windows end at.
_FILTER_BITS = 22

_HITS = "n_words long, n_hit long, items array<string>, spans array<struct<first:int,last:int>>"


class NgramSet:
    """Benchmark windows by length k: sorted hashes, and of each where its words stand in ``text`` and whose they are."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.names = sorted({i for i, _ in items})
        number = {name: n for n, name in enumerate(self.names)}
        owner = np.array([number[i] for i, _ in items], np.int32)
        texts, found, base = [], {}, 0
        for first, last, words in blocks(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True) if items else ():
            text, start, end = words.joined()
            counts, h, row = words.counts(), words.hashes(), words.row_of_word()
            for k in np.unique(np.minimum(counts[counts > 0], size)).tolist():
                at = np.flatnonzero(row[: words.n - k + 1] == row[k - 1 :])
                if k < size:
                    at = at[counts[row[at]] == k]
                place = np.stack([base + start[at], end[at + k - 1] - start[at], owner[first + row[at]]])
                found.setdefault(k, []).append((window_hashes(h, k)[at], place))
            texts.append(text)
            base += len(text)
        self.text = b"".join(texts)
        self.hashes, self.start, self.length, self.owner, self.filters = {}, {}, {}, {}, {}
        for k, parts in found.items():
            h, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
            order = np.argsort(h, kind="stable")
            self.hashes[k], self.start[k] = h[order], place[0, order]
            self.length[k], self.owner[k] = place[1, order].astype(np.int32), place[2, order].astype(np.int32)
            self.filters[k] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[k][self.hashes[k] >> np.uint64(64 - _FILTER_BITS)] = True
        self.seen: dict[tuple[int, bytes], frozenset[str]] = {}

    def candidates(self, h: np.ndarray, k: int) -> np.ndarray:
        at = np.flatnonzero(self.filters[k][h >> np.uint64(64 - _FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.hashes[k], h[at]), len(self.hashes[k]) - 1)
        return at[self.hashes[k][place] == h[at]]

    def items_with(self, k: int, h: np.uint64, words: bytes) -> frozenset[str]:
        """Items that have these words, looked up by their hash and compared."""
        if (k, words) not in self.seen:
            low, high = np.searchsorted(self.hashes[k], h, "left"), np.searchsorted(self.hashes[k], h, "right")
            spans = zip(self.start[k][low:high].tolist(), self.length[k][low:high].tolist(), self.owner[k][low:high].tolist())
            self.seen[k, words] = frozenset(self.names[o] for a, n, o in spans if self.text[a : a + n] == words)
        return self.seen[k, words]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: NgramSet = shared.value
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for first, last, words in blocks(batch.column(TEXT), ALNUM, lower=True):
                h, row = words.hashes(), None
                hits: dict[int, list[tuple[int, int, set[str]]]] = {}
                joined = None
                for k in grams.hashes:
                    of_window = window_hashes(h, k)
                    for i in grams.candidates(of_window, k).tolist():
                        if row is None:
                            row, joined = words.row_of_word(), words.joined()
                        if row[i] != row[i + k - 1]:
                            continue
                        text, start, end = joined
                        if who := grams.items_with(k, of_window[i], text[start[i] : end[i + k - 1]]):
                            at = i - int(words.row[row[i]])
                            hits.setdefault(int(row[i]), []).append((at, at + k, who))
                n_words += words.counts().tolist()
                for r in range(last - first):
                    merged: list[list[int]] = []
                    who: set[str] = set()
                    for a, b, x in sorted(hits.get(r, ()), key=lambda s: s[:2]):
                        who |= x
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    n_hit.append(sum(b - a for a, b in merged))
                    items.append(sorted(who))
                    spans.append([{"first": a, "last": b} for a, b in merged])
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            added = {N_WORDS: pa.array(n_words, pa.int64()), N_HIT: pa.array(n_hit, pa.int64()), ITEMS: pa.array(items, pa.list_(pa.string())), SPANS: pa.array(spans, span)}
            yield pa.record_batch([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    return run


#: Columns that the scan adds; the text it reads is given under TEXT's name.
TEXT, N_WORDS, N_HIT, ITEMS, SPANS = "text", "__skyledger_n_words", "__skyledger_n_hit", "__skyledger_items", "__skyledger_spans"


def _word_array(text: str) -> str:
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lowered}, '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', 0)"


def _scan_by_join(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """The same columns for benchmarks of any size: document windows meet benchmark windows in a shuffle."""
    id_ = "__skyledger_row"
    docs = docs.withColumn(id_, F.struct(F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit("second"), *docs.columns).alias("b")))
    bench = items.select("item", F.expr(_word_array("text")).alias("w")).filter("size(w) > 0").withColumn("k", F.expr(f"least(size(w), {size})"))
    grams = bench.select("item", "k", F.explode(F.expr("transform(sequence(0, size(w) - k), i -> array_join(slice(w, i + 1, k), ' '))")).alias("gram")).distinct()
    lengths = F.broadcast(bench.groupBy().agg(F.collect_set("k").alias("ks")))  # one row, size values at most
    words = docs.select(id_, F.coalesce(F.expr(_word_array(TEXT)), F.expr("cast(array() as array<string>)")).alias("w"))
    windows = (
        words.distinct().join(lengths).select(id_, "w", F.explode("ks").alias("k")).filter("size(w) >= k")
        .select(id_, "k", F.posexplode(F.expr("transform(sequence(0, size(w) - k), i -> array_join(slice(w, i + 1, k), ' '))")).alias("at", "gram"))
    )
    hits = windows.join(grams, ["k", "gram"])
    covered = hits.select(id_, F.explode(F.expr("sequence(at, at + k - 1)")).alias("p")).distinct().groupBy(id_).agg(F.count("*").alias(N_HIT), F.sort_array(F.collect_set("p")).alias("ps"))
    # runs of consecutive words are one range, as in _scan
    firsts, lasts = "filter(ps, (p, i) -> coalesce(get(ps, i - 1) <> p - 1, true))", "filter(ps, (p, i) -> coalesce(get(ps, i + 1) <> p + 1, true))"
    covered = covered.select(id_, N_HIT, F.expr(f"zip_with({firsts}, {lasts}, (a, b) -> named_struct('first', a, 'last', b + 1))").alias(SPANS))
    who = hits.groupBy(id_).agg(F.sort_array(F.collect_set("item")).alias(ITEMS))
    counted = docs.withColumn(N_WORDS, F.coalesce(F.size(F.expr(_word_array(TEXT))), F.lit(0)).cast("long"))
    out = counted.join(covered, id_, "left").join(who, id_, "left").drop(id_)
    none = {N_HIT: F.lit(0).cast("long"), ITEMS: F.expr("cast(array() as array<string>)"), SPANS: F.expr("cast(array() as array<struct<first:int,last:int>>)")}
    return out.select(*docs.drop(id_).columns, N_WORDS, *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with the number of words, of hit words, the items that occur and the hit word ranges."""
    items = benchmark.filter("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    size_of = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size_of > broadcast_bytes:
        return _scan_by_join(docs, items, size)
    grams = NgramSet([tuple(r) for r in items.collect()], size)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    added = f"{N_WORDS} long, {N_HIT} long, {ITEMS} array<string>, {SPANS} array<struct<first:int,last:int>>"
    return docs.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(grams)), f"{schema}, {added}")


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs, as they are."""
    return scan(docs, benchmark, size).filter(F.col(N_HIT) == 0).select(*docs.columns)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(TEXT), batch.column(SPANS).to_pylist()):
            raw = text.as_py()
            if spans:
                data = raw.encode()
                for _, _, words in blocks(pa.array([raw]), ALNUM, lower=True):
                    for s in reversed(spans):
                        data = data[: words.start[s["first"]]] + data[words.end[s["last"] - 1] :]
                raw = data.decode()
            texts.append(raw)
        at = batch.schema.get_field_index(TEXT)
        yield batch.set_column(at, TEXT, pa.array(texts, pa.string()))


def spans_removed(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All documents, with the hit words and what stands between them cut out of their texts."""
    found = scan(docs, benchmark, size, broadcast_bytes)
    return found.mapInArrow(_cut, found.schema).select(*docs.columns)

