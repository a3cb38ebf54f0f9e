"""Hashed presence features of texts, and linear scorers over selected ones in numpy.

Defined results: an empty text has no features and gets the score of the bias alone; a repeated
word is one feature; equal texts have equal features and scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .textbatch import Words, mix

#: Beginnings (in bytes) of longer words that are features beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)
#: Most features that a scorer keeps, and how far (in standard errors) their rates must differ.
MOST_FEATURES, LEAST_Z = 20_000, 4.0
#: Features that a training text gives, at most: bounds what the driver gathers from a sample of texts.
TRAINING_FEATURES = 8192
_FILTER_BITS = 20


def occurrences(words: Words, prefixes: tuple[int, ...] = PREFIXES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, 32-bit feature) of all words, then of all beginnings of each length."""
    row, high = words.row_of_word().astype(np.uint32), np.uint64(32)
    yield row, (words.hashes() >> high).astype(np.uint32)
    for k in prefixes:
        at = np.flatnonzero(words.end - words.start > k)
        start = words.start[at]
        yield row[at], ((words.hashes(start, start + k) * np.uint64(2 * k + 1)) >> high).astype(np.uint32)


def _once(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row.astype(np.uint64) << np.uint64(32)) | feature)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def presence(words: Words, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each feature once for a row, sorted by row."""
    row, feature = (np.concatenate(x) for x in zip(*occurrences(words, prefixes)))
    return _once(row, feature)


def packed(row: np.ndarray, feature: np.ndarray, n: int, most: int = TRAINING_FEATURES) -> list[bytes]:
    """Each row's features as uint32 bytes; of a very long text ``most``, chosen by a hash of its own."""
    out = []
    for part in np.split(feature, np.searchsorted(row, np.arange(1, n)))[:n]:
        if len(part) > most:
            own = mix((part.astype(np.uint64) << np.uint64(32)) | np.uint64(int(part.sum(dtype=np.uint64)) & 0xFFFFFFFF))
            part = np.sort(part[np.argpartition(own, most)[:most]])
        out.append(part.tobytes())
    return out


def without_copies(rows: list[bytes], least: int = 8) -> list[bytes]:
    """Rows less those that share, under one of three hashes, their ``least`` smallest features with an earlier row.

    A training sample would otherwise learn the ordinary words of a text that was copied many times.
    """
    seen: set[tuple[int, bytes]] = set()
    out = []
    for row in rows:
        feature = np.frombuffer(row, np.uint32)
        signs = {(k, np.sort(feature * np.uint32(k))[:least].tobytes()) for k in (2654435761, 2246822519, 3266489917)}
        if not signs & seen:
            out.append(row)
        seen |= signs
    return out


class Examples:
    """Sparse rows of presence features."""

    def __init__(self, rows: list[bytes]) -> None:
        parts = [np.frombuffer(r, np.uint32) for r in rows]
        self.n = len(parts)
        self.row = np.repeat(np.arange(self.n), [len(p) for p in parts])
        self.feature = np.concatenate([*parts, np.zeros(0, np.uint32)])

    def rates(self, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features and the (weighted) number of rows that have each."""
        found, back = np.unique(self.feature, return_inverse=True)
        return found, np.bincount(back, weights=None if weights is None else weights[self.row], minlength=len(found)).astype(float)

    def select(self, kept: np.ndarray) -> None:
        """From now on only kept features, numbered by their places."""
        at = np.minimum(np.searchsorted(kept, self.feature), len(kept) - 1)
        hit = kept[at] == self.feature
        self.row, self.feature = self.row[hit], at[hit]
        self.start = np.searchsorted(self.row, np.arange(self.n + 1))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in at, feature)"""
        size = self.start[at + 1] - self.start[at]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - self.start[at], size)
        return np.repeat(np.arange(len(at)), size), self.feature[place]


def telling(one: tuple[np.ndarray, np.ndarray], n_one: float, two: tuple[np.ndarray, np.ndarray], n_two: float, most: int = MOST_FEATURES, least_z: float = LEAST_Z) -> np.ndarray:
    """Sorted features whose rates in two sets of n_one and n_two rows differ by least_z standard errors."""
    every = np.union1d(one[0], two[0])
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, one[0])], b[np.searchsorted(every, two[0])] = one[1], two[1]
    p = (a + b + 1) / (n_one + n_two + 2)
    z = np.abs(a / n_one - b / n_two) / np.sqrt(p * (1 - p) * (1 / n_one + 1 / n_two))
    best = np.flatnonzero((z >= least_z) & (a + b >= 5))
    if len(best) > most:
        best = np.sort(best[np.lexsort((every[best], -z[best]))[:most]])
    return every[best]


@dataclass
class Scorer:
    """sigmoid(bias + sum of the weights of a text's selected features)"""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.features >> np.uint32(32 - _FILTER_BITS)] = True

    def logits(self, rows: list[bytes]) -> np.ndarray:
        """Log odds of packed() rows."""
        out = np.full(len(rows), float(self.bias))
        for i, row in enumerate(rows if len(self.features) else []):
            out[i] += self.weights[np.isin(self.features, np.frombuffer(row, np.uint32))].sum()
        return out

    def scores(self, words: Words, n: int, prefixes: tuple[int, ...] = PREFIXES) -> np.ndarray:
        rows, features = [], []
        for row, feature in occurrences(words, prefixes):
            maybe = np.flatnonzero(self.filter[feature >> np.uint32(32 - _FILTER_BITS)])
            rows.append(row[maybe])
            features.append(feature[maybe])
        row, feature = _once(np.concatenate(rows), np.concatenate(features))
        if not len(self.features) or not len(row):
            return np.full(n, sigmoid(np.float64(self.bias)))
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = self.features[at] == feature
        return sigmoid(self.bias + np.bincount(row[hit], weights=self.weights[at[hit]], minlength=n))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, n: int, rate: float) -> None:
        self.m, self.v, self.rate, self.t = np.zeros(n), np.zeros(n), rate, 0

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
