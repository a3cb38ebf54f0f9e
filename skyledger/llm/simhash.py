"""SimHash near-dedup with pigeonring candidate filtering.

The 64 bits are dealt to ``reach + 1`` segments on a ring. If two fingerprints differ in
at most ``reach`` bits, some segment starts a chain whose every prefix of j segments
differs in at most j * reach / (reach + 1) bits; so the first segment is equal, the first
two differ in one bit at most, and so on. Fingerprints meet in the bucket of each segment's
value, candidates come from the next segment with at most one bit changed, longer
chains prune them, and only then all 64 bits are compared.

Before any pairing equal fingerprints collapse to one node: (least doc_id, fingerprint). A
bucket returns at most one link per member (a spanning forest), never its pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; only
fingerprints link, so rows that share a doc_id or have none stay apart where their texts
do; a null doc_id counts as larger than all others (the largest long stands for it) and comes
back as null; rows alike in id and text give a row each in near_duplicates and one in
representatives; very long texts are hashed whole; an empty table gives no rows. doc_id is an integer
column. Columns of docs keep their names and values, but for names that begin with __skyledger_.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import id_or_null, join_hot, store
from .textbatch import LOWER, NO_ID, NOT_SPACE, blocks, doc_ids

#: Shingles whose bits are counted at once.
_CHUNK = 1 << 16
#: Candidate pairs that a bucket compares at once.
_PAIRS = 1 << 18


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            ids, out = doc_ids(batch.column("id")), np.zeros(batch.num_rows, np.uint64)
            for first_row, last_row, words in blocks(batch.column("text"), NOT_SPACE, lower=True):
                text, start, end = words.joined()
                for r in range(last_row - first_row):
                    a, b = words.row[r], words.row[r + 1]
                    if a == b:
                        continue
                    k = min(shingle, b - a)
                    spans = zip(start[a : b - k + 1].tolist(), end[a + k - 1 : b].tolist())
                    h = np.fromiter((digest(text[i:j], 42) for i, j in spans), np.uint64, b - a - k + 1)
                    out[first_row + r] = _majority(h)
            more = [n for n in batch.schema.names if n not in ("id", "text")]
            yield pa.record_batch([pa.array(ids), pa.array(out.view(np.int64)), *(batch.column(n) for n in more)], names=["id", "fingerprint", *more])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, digest: bool = False) -> DataFrame:
    """(id, fingerprint): SimHash over XXH64 (seed 42) of word shingles; id is doc_id, NO_ID for null.

    digest: with the text's digest beside them.
    """
    texts = docs.select(_row_id().alias("id"), "text", *([_digest().alias("digest")] if digest else []))
    return texts.mapInArrow(_fingerprints(shingle), "id long, fingerprint long" + ", digest string" * digest)


def _row_id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long")


def _digest() -> Column:
    """SHA-256 of the text; a null text's comes after all others."""
    return F.coalesce(F.sha2("text", 256), F.lit("~"))


def segment_widths(reach: int) -> list[int]:
    n = reach + 1
    return [64 // n + (i < 64 % n) for i in range(n)]


class _Forest:
    """Union-find whose root is the member of least index."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _passes(x: np.ndarray, masks: list[np.ndarray], reach: int) -> np.ndarray:
    """Which differences x hold the chain's budgets segment by segment, then the full distance."""
    stay = np.arange(len(x))
    total = np.zeros(len(x), np.int64)
    for j, mask in enumerate(masks, 1):
        total = total + np.bitwise_count(x & mask)
        fits = total * (reach + 1) <= j * reach
        stay, x, total = stay[fits], x[fits], total[fits]
        if not len(stay):
            break
    return stay


def link_bucket(f: np.ndarray, segment: int, reach: int) -> list[tuple[int, int]]:
    """Links (member, root) that join f, distinct and alike in the segment, as full comparison would."""
    widths = segment_widths(reach)
    ring = [(segment + j) % (reach + 1) for j in range(reach + 1)]
    starts = np.concatenate([[0], np.cumsum(widths)])
    masks = [np.uint64(((1 << widths[s]) - 1) << int(starts[s])) for s in ring]
    shift, width = np.uint64(int(starts[ring[1]])), widths[ring[1]]
    order = np.argsort((f & masks[1]) >> shift, kind="stable")
    g = f[order]
    value = ((g & masks[1]) >> shift).astype(np.int64)
    forest = _Forest(len(f))
    keys, group = np.unique(value, return_index=True)
    bounds = np.append(group, len(g))
    size = np.diff(bounds)
    # equal next segment, and each one-bit neighbour with a larger value, taken once
    tasks = [(np.arange(len(keys)), np.arange(len(keys)))]
    for bit in range(width):
        other = keys ^ (1 << bit)
        at = np.searchsorted(keys, other)
        hit = (other > keys) & (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == other)
        tasks.append((np.flatnonzero(hit), at[hit]))
    left, right = (np.concatenate(x) for x in zip(*tasks))
    weight = size[left] * size[right]
    small = weight <= _PAIRS
    # sparse groups: all their pairs, vectorised over many groups
    at = 0
    l, r, w = left[small], right[small], weight[small]
    while at < len(l):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(w[at:]), _PAIRS, side="right")) + at)
        ll, rr, ww = l[at:stop], r[at:stop], w[at:stop]
        k = np.arange(int(ww.sum())) - np.repeat(np.cumsum(ww) - ww, ww)
        across = np.repeat(size[rr], ww)
        i, j = np.repeat(bounds[ll], ww) + k // across, np.repeat(bounds[rr], ww) + k % across
        once = np.flatnonzero(i < j)
        i, j = i[once], j[once]
        ok = _passes(g[i] ^ g[j], masks, reach)
        for a, b in zip(i[ok].tolist(), j[ok].tolist()):
            forest.join(a, b)
        at = stop
    # dense groups: grow each component from a member; what it has reached is not compared again
    for a, b in zip(left[~small].tolist(), right[~small].tolist()):
        members = np.arange(bounds[a], bounds[a + 1])
        if a != b:
            members = np.concatenate([members, np.arange(bounds[b], bounds[b + 1])])
        open_ = members
        while len(open_):
            frontier, open_ = [int(open_[0])], open_[1:]
            while frontier and len(open_):
                x = frontier.pop()
                hit = np.zeros(len(open_), bool)
                hit[_passes(g[open_] ^ g[x], masks, reach)] = True
                for y in open_[hit].tolist():
                    forest.join(x, y)
                    frontier.append(y)
                open_ = open_[~hit]
    roots = [forest.root(x) for x in range(len(f))]
    return [(int(order[x]), int(order[y])) for x, y in enumerate(roots) if x != y]


def _link(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: tuple[int, int], ids: list, prints: list) -> pa.RecordBatch | None:
            ids, prints = np.concatenate(ids), np.concatenate(prints).view(np.uint64)
            found = link_bucket(prints, key[0], reach) if len(ids) > 1 else []
            if not found:
                return None
            nodes = (pa.StructArray.from_arrays([ids[x], prints[x].view(np.int64)], names=["id", "fingerprint"]) for x in np.array(found).T)
            return pa.record_batch(list(nodes), names=["a", "b"])

        key, ids, prints = None, [], []
        for batch in batches:
            segment, value, own, f = (batch.column(c).to_numpy() for c in ("segment", "value", "id", "fingerprint"))
            cut = np.concatenate([[0], np.flatnonzero((np.diff(segment) != 0) | (np.diff(value) != 0)) + 1, [len(f)]])
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if i == j:
                    continue
                here = (int(segment[i]), int(value[i]))
                if here != key:
                    if ids and (out := links(key, ids, prints)):
                        yield out
                    key, ids, prints = here, [], []
                ids.append(own[i:j])
                prints.append(f[i:j])
        if ids and (out := links(key, ids, prints)):
            yield out

    return run


def links(distinct: DataFrame, reach: int = 4) -> DataFrame:
    """(a, b) linked nodes (id, fingerprint), a spanning forest of each bucket; distinct: (id, fingerprint), each fingerprint once."""
    widths, at, parts = segment_widths(reach), 0, []
    for i, width in enumerate(widths):
        value = F.shiftrightunsigned("fingerprint", at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        parts.append(F.struct(F.lit(i).alias("segment"), value.alias("value")))
        at += width
    spread = distinct.select("id", "fingerprint", F.explode(F.array(*parts)).alias("s")).select("s.segment", "s.value", "id", "fingerprint")
    sorted_ = spread.repartition("segment", "value").sortWithinPartitions("segment", "value")
    return sorted_.mapInArrow(_link(reach), "a struct<id:long,fingerprint:long>, b struct<id:long,fingerprint:long>")


def _grouped(docs: DataFrame, shingle: int, reach: int, digest: bool = False) -> DataFrame:
    """fingerprints() with component, the least (id, fingerprint) that each can reach."""
    prints, _ = store(fingerprints(docs, shingle, digest), "fingerprints")
    distinct, _ = store(prints.groupBy("fingerprint").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct")
    linked = components(links(distinct, reach)).select(F.col("node.fingerprint").alias("fingerprint"), "component")
    own = F.struct("id", "fingerprint")
    class_of = distinct.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component", own).alias("component"), "n")
    return join_hot(prints, class_of, "fingerprint", prints.count())


def near_duplicates(docs: DataFrame, shingle: int = 4, reach: int = 4) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id), a row for each row of docs."""
    out = _grouped(docs, shingle, reach)
    return out.select(id_or_null(F.col("id")).alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), id_or_null(F.col("component.id")).alias("component_id"))


def representatives(docs: DataFrame, shingle: int = 4, reach: int = 4) -> DataFrame:
    """Of each component of docs one row: that of least doc_id (null last), then fingerprint and text digest."""
    row = F.struct("id", "fingerprint", "digest")
    keep = _grouped(docs, shingle, reach, digest=True).groupBy("component").agg(F.min(row).alias("row"))
    keep = keep.select(F.col("row.id").alias("__skyledger_id"), F.col("row.digest").alias("__skyledger_digest"))
    own = docs.withColumns({"__skyledger_id": _row_id(), "__skyledger_digest": _digest()})
    # rows alike in id and text are one
    return own.join(keep, ["__skyledger_id", "__skyledger_digest"]).dropDuplicates(["__skyledger_id", "__skyledger_digest"]).select(*docs.columns)
