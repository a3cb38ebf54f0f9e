"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's parts form a linked list. Every adjacent pair that the vocabulary can merge is
put into the bucket of its merge rank; a two-level bitmap over the ranks gives the next
rank by find-first-set. Entries whose pair has changed since are stale and skipped.
A merge costs a constant number of queue steps, so a pre-token of n bytes takes O(n log n)
at most (ties of one rank leave a bucket left to right), however long it is.

Pre-tokens are cut without a regular expression engine: code points are mapped to classes
(letter, number, space, other) and the boundaries follow from runs of classes. Texts are encoded in groups of bounded size:
each distinct pre-token of a group is merged once, all of them over one queue.

Defined results: null is an empty text; an empty text has no tokens and decodes to nothing; of
pairs of one rank the left one merges first; equal texts have equal ids, a row for each; very long
texts and pre-tokens are encoded whole; an empty table gives no rows. Only doc_id, of any type, and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textbatch import _BYTE, _powers, mix

#: Distinct pre-tokens whose ids are kept from group to group.
CACHE_ENTRIES = 200_000
#: Characters of texts that are encoded together.
GATHER_CHARS = 1 << 20
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_TABLE_BITS, _EMPTY, _SPREAD = 19, np.uint64((1 << 64) - 1), np.uint64(0x9E3779B97F4A7C15)
_WIDTH = 8  # the bitmap's words have 2 ** _WIDTH bits


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def code_point_classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\s+", _SPACE), (r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    out[0xD800:0xE000] = _OTHER
    return out


class PreTokens:
    """Boundaries of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""

    #: What may follow an apostrophe as a piece of its own.
    SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self) -> None:
        self.classes = code_point_classes()

    def starts(self, text: str, edges: np.ndarray) -> np.ndarray:
        """Code points where a pre-token begins; edges: where the texts in text begin, and its length."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        if not n:
            return np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        kind = self.classes[code]
        start = edge[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # the last of a run of spaces stands alone or, if it is U+0020, goes with what follows
        space = kind == _SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        for at in np.flatnonzero((code == 39) & start).tolist():
            if at + 1 < n and start[at + 1] and not edge[at + 1] and kind[at + 1] == _LETTER:
                for suffix in self.SUFFIXES:
                    if text.startswith(suffix, at + 1) and not edge[at + 2 : at + 1 + len(suffix)].any():
                        start[at + 1] = False
                        if at + 1 + len(suffix) < n:
                            start[at + 1 + len(suffix)] = True
                        break
        return np.flatnonzero(start)

    def split(self, text: str) -> list[str]:
        at = self.starts(text, np.array([0, len(text)])).tolist()
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


class RankQueue:
    """Buckets of list positions by rank, under a bitmap of two levels."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> _WIDTH) + 1)
        self.high = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            self.mark(rank)
        else:
            heappush(bucket, at)

    def pop(self) -> tuple[int, int]:
        """The least rank and its leftmost position."""
        high = self.high
        word = (high & -high).bit_length() - 1
        low = self.low[word]
        bit = low & -low
        rank = (word << _WIDTH) | (bit.bit_length() - 1)
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] = low ^ bit
            if low == bit:
                self.high = high ^ (1 << word)
        return rank, at


    def mark(self, rank: int) -> None:
        word = rank >> _WIDTH
        self.low[word] |= 1 << (rank & ((1 << _WIDTH) - 1))
        self.high |= 1 << word

    def pop_bucket(self) -> tuple[int, list]:
        """The least rank with all that its bucket holds."""
        word = (self.high & -self.high).bit_length() - 1
        bit = self.low[word] & -self.low[word]
        self.low[word] ^= bit
        if not self.low[word]:
            self.high ^= 1 << word
        rank = (word << _WIDTH) | (bit.bit_length() - 1)
        return rank, self.buckets.pop(rank)


class Encoding:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.decimal = [b"%d" % i for i in range(len(self.pieces))]
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        #: (left id, right id) as one number -> id of both together
        self.pairs: dict[int, int] = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.table_keys = np.full(1 << _TABLE_BITS, _EMPTY, np.uint64)
        self.table_ranks = np.zeros(1 << _TABLE_BITS, np.int32)
        for key, rank in self.pairs.items():
            slot = (key * int(_SPREAD) & (1 << 64) - 1) >> (64 - _TABLE_BITS)
            while self.table_keys[slot] != _EMPTY:
                slot = (slot + 1) & ((1 << _TABLE_BITS) - 1)
            self.table_keys[slot], self.table_ranks[slot] = key, rank
        self.queue = RankQueue(len(self.pieces))
        self.pre = PreTokens()
        # what was merged so far: sorted hashes, when last used, and ids in a pool
        self.seen, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.used = self.begin = self.size = np.zeros(0, np.int64)
        self.turn = 0
        #: Ranks of pairs of bytes, by 256 * left + right.
        self.bytes = np.array([[self.pairs.get(a << 32 | b, -1) for b in self.single] for a in self.single], np.int32).ravel()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        n = len(ids)
        pairs, queue = self.pairs, self.queue
        push, pop = queue.push, queue.pop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                push(rank, i)
        while queue.high:
            rank, i = pop()
            j = after[i]
            left = ids[i]
            if left < 0 or j >= n or pairs.get(left << 32 | ids[j]) != rank:
                continue  # stale
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get(rank << 32 | ids[k])) is not None:
                    push(r, i)
            if (h := before[i]) >= 0 and (r := pairs.get(ids[h] << 32 | rank)) is not None:
                push(r, h)
        return [x for x in ids if x >= 0]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where the vocabulary has none; ids of -1 match nothing."""
        key = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = ((key * _SPREAD) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        have = self.table_keys[slot]
        out = np.where(have == key, self.table_ranks[slot], np.int32(-1))
        todo = np.flatnonzero((have != key) & (have != _EMPTY))
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & ((1 << _TABLE_BITS) - 1)
            have = self.table_keys[at]
            hit = have == key[todo]
            out[todo[hit]] = self.table_ranks[at[hit]]
            todo = todo[~hit & (have != _EMPTY)]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of many pre-tokens over one rank queue, as bytes of uint32 ids.

        The pre-tokens lie end to end in one linked list, cut at their ends. The queue hands out
        a whole bucket: that rank's places in all pre-tokens at once. Only where a merge makes a
        pair of lower rank does the order inside a pre-token matter; such a pre-token is
        done again by itself.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        ids = np.append(np.array(self.single, np.int32)[data], np.int32(-1))
        after, before = (np.append(np.arange(d, n + d, dtype=np.int32), np.int32(n)) for d in (1, -1))
        after[ends[lengths > 0] - 1] = n
        before[(ends - lengths)[lengths > 0]] = n
        current = np.full(n + 1, -1, np.int32)
        current[: n - 1] = self.bytes[data[:-1].astype(np.int64) * 256 + data[1:]]
        current[ends[lengths > 0] - 1] = -1
        queue = RankQueue(len(self.pieces))
        buckets: dict[int, list] = queue.buckets
        redo: set[int] = set()

        def add(ranks: np.ndarray, at: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for rank, places in zip(ranks[np.append(0, cut)].tolist(), np.split(at, cut)):
                queue.mark(rank)
                buckets.setdefault(rank, []).append(places)

        first = np.flatnonzero(current >= 0)
        if len(first):
            add(current[first], first)
        while queue.high:
            rank, parts = queue.pop_bucket()
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[current[at] == rank]  # the rest is stale
            if not len(at):
                continue
            right = after[at]
            touch = right[:-1] == at[1:]
            if touch.any():  # overlapping places of one rank: left to right
                free = np.ones(len(at), bool)
                for m in np.flatnonzero(touch).tolist():
                    free[m + 1] = not free[m]
                at = at[free]
                right = after[at]
            beyond = after[right]
            ids[at], ids[right], current[right] = rank, -1, -1
            after[at], before[beyond] = beyond, at
            left = before[at]
            r, l = self._look_up(ids[at], ids[beyond]), self._look_up(ids[left], ids[at])
            current[at], current[left] = r, l
            current[n] = -1
            new, where = np.concatenate([r, l]), np.concatenate([at, left])
            fits = new >= 0
            if fits.any():
                new, where = new[fits], where[fits]
                if (new < rank).any():
                    redo.update(np.searchsorted(ends, where[new < rank], side="right").tolist())
                add(new, where)
        alive = ids[:-1] >= 0
        count = np.add.reduceat(np.append(alive, False).astype(np.int64), ends - lengths) if len(pieces) else np.zeros(0, np.int64)
        count[lengths == 0] = 0
        raw, stop = ids[:-1][alive].astype(np.uint32).tobytes(), (4 * np.cumsum(count)).tolist()
        out = [raw[i:j] for i, j in zip([0, *stop[:-1]], stop)]
        for i, piece in enumerate(pieces):
            if i in redo or piece in self.ranks:
                out[i] = np.array(self.merge(piece), np.uint32).tobytes()
        return out

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text: its pre-tokens are told apart by hash, and each distinct one is merged once."""
        joined = "".join(texts)
        data = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
        chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        points = self.pre.starts(joined, chars)
        if not len(points):
            yield from (np.zeros(0, np.uint32) for _ in texts)
            return
        start = lead[points]
        length = np.diff(np.append(start, len(data)))
        place = np.arange(len(data)) - np.repeat(start, length)
        h = mix(np.add.reduceat(np.take(_BYTE, data) * _powers.get(int(length.max()) + 1)[0][place], start) + length.astype(np.uint64))
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        pool, begin, size = self._ids_of(distinct, data, start[first], length[first])
        cut = np.searchsorted(points, chars)
        take = size[which]
        at = np.cumsum(take) - take
        ids = pool[np.arange(int(take.sum())) - np.repeat(at - begin[which], take)]
        bounds = np.append(at, len(ids))[cut].tolist()
        for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
            own = ids[a:b]
            if self.decode(own.tolist()) != text.encode("utf-8", "replace"):  # two pre-tokens of one hash
                own = np.array([x for t in self.pre.split(text) for x in self.merge(t.encode("utf-8", "replace"))], np.uint32)
            yield own

    def _ids_of(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where each distinct pre-token's lie in it; what earlier groups had is not merged again."""
        self.turn += 1
        at = np.minimum(np.searchsorted(self.seen, h), max(len(self.seen) - 1, 0))
        known = self.seen[at] == h if len(self.seen) else np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        found = self.merge_many([raw[a : a + b] for a, b in zip(start[new].tolist(), length[new].tolist())])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.used[at[known]] = self.turn
        seen, used = np.concatenate([self.seen, h[new]]), np.concatenate([self.used, np.full(len(new), self.turn)])
        begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        size, pool = np.concatenate([self.size, size]), np.concatenate([self.pool, np.frombuffer(b"".join(found), np.uint32)])
        order = np.argsort(seen, kind="stable")
        if len(order) > CACHE_ENTRIES:  # the least recently used go, never those of this turn
            oldest = np.partition(used, len(used) - CACHE_ENTRIES)[len(used) - CACHE_ENTRIES]
            order = order[(used[order] > oldest) | (used[order] == self.turn)]
        keep, length = begin[order], size[order]
        stop = np.cumsum(length)
        pool = pool[np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - length - keep, length)]
        self.seen, self.used, self.pool, self.begin, self.size = seen[order], used[order], pool, stop - length, length
        at = np.searchsorted(self.seen, h)
        return self.pool, self.begin[at], self.size[at]

    def encode_all(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, in order; short texts are gathered, a long one makes a group of its own."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            if waiting and size + len(text) > GATHER_CHARS:
                yield from self._group(waiting)
                waiting, size = [], 0
            waiting.append(text)
            size += len(text)
        if waiting:
            yield from self._group(waiting)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_encodings: dict[str, Encoding] = {}


def encoding(path: str) -> Encoding:
    """One for each worker process and vocabulary."""
    if path not in _encodings:
        _encodings[path] = Encoding(load_ranks(path))
    return _encodings[path]


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoding(path)
        for batch in batches:
            n, sha, back = [], [], []
            for ids in use.encode_all(t.as_py() or "" for t in batch.column("text")):
                ids = ids.tolist()
                n.append(len(ids))
                sha.append(hashlib.sha256(b" ".join(map(use.decimal.__getitem__, ids))).hexdigest())
                back.append(hashlib.sha256(use.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoding(path)
        for batch in batches:
            ids = [i.astype(np.int32) for i in use.encode_all(t.as_py() or "" for t in batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoding(path)
        for batch in batches:
            texts = [use.decode(i or []).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>)"""
    return docs.select("doc_id", "text").mapInArrow(_encode(path), f"doc_id {_id_type(docs)}, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>)"""
    return ids.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {_id_type(ids)}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids alone."""
    return docs.select("doc_id", "text").mapInArrow(_digest(path), f"doc_id {_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
