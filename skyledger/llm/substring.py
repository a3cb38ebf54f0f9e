"""Substring dedup by super-k-mers of words.

Every window of ``window`` words has a minimiser: the least hash among its
``mini``-word grams. Consecutive windows of a document with the same minimiser
travel as one packed string (a super-k-mer) to the minimiser's bucket, so equal
windows of any two documents always meet. A bucket sorts its windows by (hash,
doc_id) and removes those that a smaller doc_id has as well, after comparing the
words themselves.

Hot passages are combined before the shuffle: of equal super-k-mers in one block of
input only those of the smallest doc_id travel, the others are decided on the spot.
Super-k-mers of one bucket travel as compressed blobs.

Hot minimisers: a bucket is judged in one task's memory, so one whose packed bytes pass
``LARGEST`` is not judged there. Its windows go on one by one to a second shuffle, by their
own words instead of the minimiser, where Spark sorts them (words, doc_id) on disk as needed
and each group of equal windows is streamed past its first.

Defined results: a null or empty text has no words; rows that share a doc_id are
judged each by its own text and never against each other; a null doc_id counts as
larger than all others (the largest long stands for it); equal rows give equal results;
very long texts are cut into super-k-mers of LONGEST windows at most; an empty table gives
no rows. doc_id is an integer column. Columns of docs keep their names and values whatever
they are called, but for names that begin with __skyledger_, which are the operator's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import store
from .textbatch import NO_ID, NOT_SPACE, Words, blocks, mix, window_hashes

#: Longest super-k-mer in windows: bounds a packed string where a text repeats one word.
LONGEST = 1024
#: Packed bytes that a map task gathers before it sends blobs.
GATHER_BYTES = 16 << 20
#: Bytes of texts whose equal super-k-mers are combined.
COMBINED_BYTES = 2 << 20
#: Bytes of a bucket whose windows are hashed at once, and windows that are compared at once.
JUDGED_BYTES, COMPARED = 1 << 19, 1 << 16
#: Packed bytes up to which a bucket is judged in memory.
LARGEST = 24 << 20
#: Bytes of text for each task of the shuffle, where the session's number of partitions gives more.
TASK_BYTES = 192 << 20

#: Helper columns that stand beside a caller's own, and the counts that remove_repeats adds.
ID, KEY, KEY2, SPANS = "__skyledger_id", "__skyledger_key", "__skyledger_key2", "__skyledger_spans"
N_WORDS, N_REMOVED, KEPT_SHA256 = "__skyledger_n_words", "__skyledger_n_removed", "__skyledger_kept_sha256"

#: key and key2 tell rows of one doc_id apart: 128 bits of the text's hash, zeros where ids are not shared.
_ROW = "id long, key long, key2 long"
_PACK = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])


def _sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        g = np.minimum(g[:-step], g[step:])
        have += step
    return g


def super_kmers(words: Words, window: int, mini: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window (a word's index), number of windows and minimiser of each super-k-mer."""
    row = words.row_of_word()
    n = words.n - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    least = _sliding_min(window_hashes(words.hashes(), mini), window - mini + 1)[:n]
    valid = row[:n] == row[window - 1 :]
    place = np.arange(n) - words.row[row[:n]]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1]) | (place[1:] % LONGEST == 0) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.append((new | ~valid)[1:], True) & valid) + 1
    return first, stop - first, least[first]


def _pack_blob(items: list, decided: bool, compressor) -> bytes:
    """Columns of (packed, id, key, key2, place, windows): ids as differences, packed strings a line each.

    What was decided on the spot has no string and carries its number of windows instead.
    """
    items.sort(key=lambda x: x[1])
    n = len(items)
    wide = [np.array([x[c] for x in items], np.int64) for c in (1, 2, 3)]
    wide[0] = np.diff(wide[0], prepend=np.int64(0))
    narrow = [np.array([x[c] for x in items], np.int64).astype(np.int32).tobytes() for c in ((4, 5) if decided else (4,))]
    return compressor.compress(b"".join([np.int64(n).tobytes(), *(w.tobytes() for w in wide), *narrow, b"" if decided else b"\n".join(x[0] for x in items)]))


def _open_blob(blob: bytes, decided: bool, decompressor) -> tuple[np.ndarray, bytes]:
    """(ids, keys, second keys, places and, of what was decided, windows) as int64 rows, and the packed strings."""
    raw = decompressor.decompress(blob)
    n, columns = int(np.frombuffer(raw, np.int64, 1)[0]), 2 if decided else 1
    wide = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n).copy()
    wide[0] = np.cumsum(wide[0])
    narrow = np.frombuffer(raw, np.int32, columns * n, 8 + 24 * n).reshape(columns, n)
    return np.vstack([wide, narrow.astype(np.int64)]), raw[8 + (24 + 4 * columns) * n :]


def _cut(window: int, mini: int, buckets: int):
    """Rows (bucket, blob), and those of bucket -1: intervals that the block itself has decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=4)
        waiting: dict[int, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = sorted(waiting)
            out = pa.record_batch([pa.array(keys, pa.int64()), pa.array([_pack_blob(waiting[k], k < 0, compressor) for k in keys], pa.binary())], schema=_PACK)
            waiting.clear()
            return out

        for batch in batches:
            ids, keys, keys2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key", "key2"))
            for first_row, _, words in blocks(batch.column("text"), NOT_SPACE, limit=COMBINED_BYTES):
                first, count, least = super_kmers(words, window, mini)
                if not len(first):
                    continue
                text, start, end = words.joined()
                row = words.row_of_word()[first]
                doc = ids[first_row + row].tolist()
                packed = [text[a:b] for a, b in zip(start[first].tolist(), end[first + count + window - 2].tolist())]
                smallest: dict[bytes, int] = {}
                for p, d in zip(packed, doc):
                    if d < smallest.setdefault(p, d):
                        smallest[p] = d
                bucket = (mix(least) % np.uint64(buckets)).astype(np.int64).tolist()
                place = (first - words.row[row]).tolist()
                for p, d, k, k2, at, c, b in zip(packed, doc, keys[first_row + row].tolist(), keys2[first_row + row].tolist(), place, count.tolist(), bucket):
                    if d > smallest[p]:
                        waiting.setdefault(-1 - b, []).append((b"", d, k, k2, at, c))
                        size += 40
                    else:
                        waiting.setdefault(b, []).append((p, d, k, k2, at, c))
                        size += len(p) + 40
                if size >= GATHER_BYTES:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    return run


def _windows(data: bytes, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Hash, item, first and last byte of every window, hashed a block of items at a time: the hashing needs many times a block's bytes."""
    items = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    parts = []
    for first, _, words in blocks(items, NOT_SPACE, limit=JUDGED_BYTES):
        row = words.row_of_word()
        h = window_hashes(words.hashes(), window)
        at = np.flatnonzero(row[: len(h)] == row[window - 1 :])
        parts.append((h[at], first + row[at], offsets[first] + words.start[at], offsets[first] + words.end[at + window - 1]))
    return tuple(map(np.concatenate, zip(*parts)))


def _repeats(head: np.ndarray, text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first window, window after the last) of runs of windows that a smaller doc_id has too."""
    order = np.argsort(head[0], kind="stable")
    lines = text.split(b"\n")
    lines = [lines[i] for i in order.tolist()]
    data = b"".join(lines)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))])
    h, item, start, end = _windows(data, offsets, window)
    doc = head[0][order][item]
    sort = np.argsort(h, kind="stable")  # items stand by doc_id, so a group's first has the smallest
    hs = h[sort]
    group = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
    leader = np.repeat(sort[group], np.diff(np.append(group, len(hs))))
    later = doc[sort] > doc[leader]
    if not later.any():
        return (np.zeros(0, np.int64),) * 3
    mine, theirs = sort[later], leader[later]
    same = np.zeros(len(mine), bool)
    for at in range(0, len(mine), COMPARED):
        m, t = mine[at : at + COMPARED], theirs[at : at + COMPARED]
        ends = zip(start[m].tolist(), end[m].tolist(), start[t].tolist(), end[t].tolist())
        same[at : at + COMPARED] = [data[a:b] == data[c:d] for a, b, c, d in ends]
    flag = np.zeros(len(h), bool)
    flag[mine[same]] = True
    if not same.all():  # two windows of one hash: tell them apart by their words
        seen: dict[bytes, int] = {}
        clash = np.flatnonzero(np.isin(h, h[mine[~same]]))
        for w in clash.tolist():  # by doc_id
            key = data[start[w] : end[w]]
            flag[w] = doc[w] > seen.setdefault(key, int(doc[w]))
    run = np.flatnonzero(flag)
    new = np.concatenate([[True], (np.diff(run) != 1) | (np.diff(item[run]) != 0)])
    begin = run[new]
    stop = run[np.append(np.flatnonzero(new)[1:] - 1, len(run) - 1)] + 1
    first_window = np.searchsorted(item, item[begin])
    return order[item[begin]], begin - first_window, stop - first_window


_FOUND = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("words", pa.binary())])


def _found(rows: np.ndarray, first: np.ndarray, last: np.ndarray, words: list[bytes] | None = None) -> pa.RecordBatch:
    """rows: ids and both keys; words are those of windows that are still to be judged."""
    columns = [*(pa.array(r) for r in rows[:3]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
    return pa.record_batch([*columns, pa.nulls(len(first), pa.binary()) if words is None else pa.array(words, pa.binary())], schema=_FOUND)


def _passed_on(head: np.ndarray, text: bytes, window: int) -> Iterator[pa.RecordBatch]:
    """Every window of a blob with its words."""
    lines = text.split(b"\n")
    data, offsets = b"".join(lines), np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))])
    items = pa.Array.from_buffers(pa.large_binary(), len(lines), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    for first, _, words in blocks(items, NOT_SPACE, limit=JUDGED_BYTES):
        row, n = words.row_of_word(), words.n - window + 1
        at = np.flatnonzero(row[:n] == row[window - 1 :])
        item, begin, raw = first + row[at], at - words.row[row[at]], data[offsets[first] : offsets[first] + len(words.data)]
        place = head[3][item] + begin
        spans = zip(words.start[at].tolist(), words.end[at + window - 1].tolist())
        yield _found(head[:, item], place, place + window, [raw[i:j] for i, j in spans])


def _judge(window: int, largest: int):
    """Spans that a bucket decides; windows of a bucket of more than ``largest`` packed bytes come back with their words instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()

        def judged(opened: list[tuple[np.ndarray, bytes]], decided: bool) -> Iterator[pa.RecordBatch]:
            head = np.concatenate([h for h, _ in opened], axis=1)
            if decided:
                item, begin, stop = np.arange(head.shape[1]), np.zeros(head.shape[1], np.int64), head[4]
            elif head.shape[1] < 2 or (head[0] == head[0][0]).all():
                return
            else:
                item, begin, stop = _repeats(head, b"\n".join(t for _, t in opened), window)
            if len(item):
                at = head[3][item]
                yield _found(head[:, item], at + begin, at + stop + window - 1)

        bucket, opened, size = None, [], 0
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                if b != bucket:
                    if opened:
                        yield from judged(opened, bucket < 0)
                    bucket, opened, size = b, [], 0
                one = _open_blob(blob.as_py(), b < 0, decompressor)
                size += len(one[1])
                if b < 0 and opened:  # nothing of these is compared
                    yield from judged(opened, True)
                    opened = []
                if size > largest:
                    for waiting in [*opened, one]:
                        yield from _passed_on(*waiting, window)
                    opened = []
                else:
                    opened.append(one)
        if opened:
            yield from judged(opened, bucket < 0)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (words, id), those whose id is not their words' first."""
    words, least = None, 0
    for batch in batches:
        ids, at = batch.column("id").to_pylist(), []
        for i, (w, d) in enumerate(zip(batch.column("words").to_pylist(), ids)):
            if w != words:
                words, least = w, d
            elif d > least:
                at.append(i)
        if at:
            yield batch.take(pa.array(at)).drop_columns(["words"])


def _identified(docs: DataFrame) -> dict[str, Column]:
    """ID, KEY and KEY2 of each row: ids that rows share (a null id among them) are told apart by 128 bits of the text."""
    shared = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__skyledger_n")).filter("__skyledger_n > 1").take(1)
    apart = F.lit(True) if shared else F.col("doc_id").isNull()
    bits = lambda *c: F.when(apart, F.xxhash64(*c)).otherwise(F.lit(0).cast("long"))
    return {ID: F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long"), KEY: bits(F.col("text")), KEY2: bits(F.lit("second"), F.col("text"))}


def repeated_spans(docs: DataFrame, window: int = 13, mini: int = 3, bucket_bytes: int = 4 << 20, largest: int = LARGEST, identity: dict[str, Column] | None = None) -> DataFrame:
    """(id, key, key2, first, last): word ranges that windows of smaller doc_ids cover; the keys tell rows of one doc_id apart.

    bucket_bytes sets how many buckets the measured bytes of all texts are dealt to; a bucket of more
    than ``largest`` packed bytes goes through the second shuffle.
    """
    spark = docs.sparkSession
    texts = docs.select(*[c.alias(n) for c, n in zip((identity or _identified(docs)).values(), ("id", "key", "key2"))], "text")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, int(total * 3 // bucket_bytes))
    packed = texts.mapInArrow(_cut(window, mini, buckets), "bucket long, blob binary")
    tasks = int(total // TASK_BYTES)
    by = (tasks, "bucket") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else ("bucket",)
    spans = f"{_ROW}, first int, last int"
    first, _ = store(packed.repartition(*by).sortWithinPartitions("bucket").mapInArrow(_judge(window, largest), f"{spans}, words binary"), "spans")
    hot = first.filter("words is not null")
    done = first.filter("words is null").drop("words")
    if not hot.take(1):
        return done
    return done.unionByName(hot.repartition("words").sortWithinPartitions("words", "id").mapInArrow(_later, spans))


def _keep(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, texts = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column(SPANS)):
                raw = text.as_py()
                words = (raw or "").encode().split()
                kept = words
                if spans.is_valid:
                    gone = np.zeros(len(words) + 1, np.int32)
                    ranges = np.array([(s["first"], s["last"]) for s in spans.as_py()], np.int64)
                    np.add.at(gone, ranges[:, 0], 1)
                    np.add.at(gone, ranges[:, 1], -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    kept = [w for w, s in zip(words, stay.tolist()) if s]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                sha.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(raw if len(kept) == len(words) else joined.decode())
            out = batch.drop_columns(["text", SPANS])
            columns = {name: out.column(name) for name in out.schema.names}
            if with_text:
                columns["text"] = pa.array(texts, pa.string())
            columns |= {N_WORDS: pa.array(n_words, pa.int64()), N_REMOVED: pa.array(n_removed, pa.int64()), KEPT_SHA256: pa.array(sha, pa.string())}
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def remove_repeats(docs: DataFrame, window: int = 13, mini: int = 3, with_text: bool = True, largest: int = LARGEST) -> DataFrame:
    """All columns of docs with the repeated words cut out of text, and N_WORDS, N_REMOVED, KEPT_SHA256.

    A text that loses nothing stays byte for byte; otherwise the kept words stand joined by one space.
    """
    row, identity = [ID, KEY, KEY2], _identified(docs)
    found = repeated_spans(docs, window, mini, largest=largest, identity=identity)
    spans = found.groupBy("id", "key", "key2").agg(F.collect_list(F.struct("first", "last")).alias(SPANS)).withColumnsRenamed({"id": ID, "key": KEY, "key2": KEY2})
    joined = docs.withColumns(identity).join(spans, row, "left").drop(*row)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    added = [N_WORDS, N_REMOVED, KEPT_SHA256]
    schema = ", ".join([*kept, *["text string"] * with_text, f"{N_WORDS} long, {N_REMOVED} long, {KEPT_SHA256} string"])
    out = joined.mapInArrow(_keep(with_text), schema)
    return out.select(*[c for c in docs.columns if with_text or c != "text"], *added)
