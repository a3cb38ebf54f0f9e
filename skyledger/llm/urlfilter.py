"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs: a caller's own table, or else the pages themselves, a
url being labelled by evidence in its page's html (``junk_page``), never by the rules. Training
reads a bounded sample, ``SAMPLE`` urls by least hash. Features: length, depth, digit ratio,
entropy, numbers of parameters, host labels, hyphens, and block rates of host and path
suffixes. A training url's rates come from the other folds of hosts, and how many trees are
kept is decided on hosts that they were not fitted to; where urls tell nothing, that is none, and every
url gets the share of blocked ones as its score.

Defined results: null, and a url without ``://``, has an empty host and path; no rule fits those,
they get the trees' verdict on an empty url; without both labels in training every url that
no rule fits is allowed; equal urls have equal verdicts, a row for each; an empty table gives no rows;
a null html has no words; very long urls are read whole. Only page_id, of any type, url and html are
read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Training URLs, at most.
SAMPLE = 20_000
#: Folds of hosts: one decides on the number of trees, and suffix rates are taken out of fold.
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, _UPPER, _LOWER), F.substr(rest, F.char_length(host) + 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule whose host is the url's or a parent of it, and whose path begins the url's."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _suffixes(host: str, path: str) -> tuple[str, str, str]:
    labels = host.split(".")
    last = path.rstrip("/").rsplit("/", 1)[-1]
    return labels[-1], ".".join(labels[-2:]), last.rpartition(".")[2] if "." in last else ""


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "host_entropy", "parameters", "hyphens", "percent", "fragment", "tld_rate", "domain_rate", "extension_rate")

Url = tuple[str, str, str]


def lexical(url: str, host: str, path: str) -> list[float]:
    """FEATURES but for the rates."""
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(c.isdigit() for c in url) / max(len(url), 1)
    marks = (query.count("=") + query.count("&"), host.count("-"), url.count("%"), float("#" in url))
    return [len(url), len(host), len(path), path.count("/"), host.count(".") + 1, digits, _entropy(url), _entropy(host), *marks]


class SuffixRates:
    """Block rates by host and path suffix, shrunk towards the mean."""

    def __init__(self, urls: list[Url], labels: np.ndarray) -> None:
        self.mean = float(labels.mean()) if len(labels) else 0.0
        self.rates: list[dict[str, float]] = []
        for suffixes in zip(*(_suffixes(h, p) for _, h, p in urls)) if urls else ((), (), ()):
            total, blocked = Counter(suffixes), Counter()
            for key, label in zip(suffixes, labels.tolist()):
                blocked[key] += label
            self.rates.append({k: (blocked[k] + 5 * self.mean) / (n + 5) for k, n in total.items()})

    def of(self, urls: list[Url]) -> np.ndarray:
        return np.array([[r.get(s, self.mean) for r, s in zip(self.rates, _suffixes(h, p))] for _, h, p in urls], float).reshape(len(urls), 3)


def host_folds(urls: list[Url]) -> np.ndarray:
    return np.array([crc32(h.encode()) % FOLDS for _, h, _ in urls], np.int64)


def out_of_fold(urls: list[Url], labels: np.ndarray) -> np.ndarray:
    """Rows of FEATURES; a url's suffix rates are those of the other folds."""
    fold, rates = host_folds(urls), np.zeros((len(urls), 3))
    for f in range(FOLDS):
        inside, outside = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        rates[inside] = SuffixRates([urls[i] for i in outside], labels[outside]).of([urls[i] for i in inside])
    return np.hstack([np.array([lexical(*u) for u in urls], float), rates])


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on histograms of at most ``bins`` quantiles."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20, shrink: float = 1.0) -> None:
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.shrink = trees, depth, rate, bins, least, shrink
        self.trees: list[list[tuple[int, float, float]]] = []  # (feature or -1, threshold, value) in heap order
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = math.log(share / (1 - share))
        f = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            members = {0: np.arange(len(y))}
            for node in range(len(tree)):
                at = members.pop(node, None)
                if at is None:
                    continue
                tree[node] = (-1, 0.0, self.rate * g[at].sum() / (h[at].sum() + self.shrink))
                split = self._split(code, g, h, at) if 2 * node + 2 < len(tree) else None
                if split:
                    j, cut = split
                    tree[node] = (j, float(edges[j][cut]), 0.0)
                    left = code[at, j] <= cut
                    members[2 * node + 1], members[2 * node + 2] = at[left], at[~left]
            self.trees.append(tree)
            f += self._tree(tree, x)
        return self

    def _split(self, code: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[int, int] | None:
        best, gain = None, 1e-6
        all_g, all_h, n = g[at].sum(), h[at].sum(), len(at)
        for j in range(code.shape[1]):
            c = code[at, j]
            lg, lh, ln = (np.cumsum(np.bincount(c, weights=w, minlength=self.bins))[:-1] for w in (g[at], h[at], np.ones(n)))
            value = lg**2 / (lh + self.shrink) + (all_g - lg) ** 2 / (all_h - lh + self.shrink) - all_g**2 / (all_h + self.shrink)
            value[(ln < self.least) | (n - ln < self.least)] = 0
            k = int(np.argmax(value))
            if value[k] > gain:
                best, gain = (j, k), float(value[k])
        return best

    def _tree(self, tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, threshold, value = (np.array(v) for v in zip(*tree))
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            j = feature[at]
            down = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(j, 0)] > threshold[at])
            at = np.where(j >= 0, down, at)
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum((self._tree(t, x) for t in self.trees), np.zeros(len(x))))))


    def losses(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Mean logistic loss with none, one, two ... of the trees."""
        steps = np.stack([np.full(len(x), self.base), *(self._tree(t, x) for t in self.trees)])
        f = np.cumsum(steps, axis=0)
        return np.mean(np.logaddexp(0, f) - y * f, axis=1)


@dataclass
class Model:
    rates: SuffixRates
    trees: Boosted

    def scores(self, urls: list[Url]) -> np.ndarray:
        if not urls:
            return np.zeros(0)
        return self.trees.probability(np.hstack([np.array([lexical(*u) for u in urls], float), self.rates.of(urls)]))


def fit(urls: list[Url], labels: np.ndarray) -> Model:
    """Trees on out-of-fold features; as many as serve hosts of a fold best that they were not fitted to."""
    x, fold = out_of_fold(urls, labels), host_folds(urls)
    known, other = fold != 0, fold == 0
    trees = 0
    if known.any() and other.any():
        trees = int(np.argmin(Boosted().fit(x[known], labels[known]).losses(x[other], labels[other])))
    return Model(SuffixRates(urls, labels), Boosted(trees).fit(x, labels))


def junk_page(html: Column) -> Column:
    """Evidence that a page is junk: hardly any words, or its text is symbols, capitals or digits in large part."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    upper, digits = _UPPER, "0123456789"

    def judge(text: Column) -> Column:
        lacking = lambda chars: F.char_length(F.translate(text, chars, ""))
        n, solid = F.char_length(text), lacking(" \t\n\r\f\x0b")
        words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
        return (words < 50) | (n - lacking("|#*$%&<>!=_~^") > solid * 0.08) | (n - lacking(upper) > solid * 0.3) | (n - lacking(digits) > solid * 0.1)

    # the text without tags is worked out once
    return F.transform(F.array(F.regexp_replace(body, r"<[^>]*+>", " ")), judge)[0].cast("int")


def sampled(urls: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(url): distinct urls of least hash, ``sample`` at most. Only about twice as many are ever brought together."""
    some = urls.filter("url is not null").select("url", F.xxhash64("url").alias("__skyledger_h"))
    n = some.agg(F.approx_count_distinct("__skyledger_h")).first()[0]
    if n > 2 * sample:
        some = some.filter(F.col("__skyledger_h") < -(2**63) + 2**64 * 2 * sample // n)
    return some.distinct().orderBy("__skyledger_h", "url").limit(sample).select("url")


def train(labelled: DataFrame, sample: int = SAMPLE, label: Column | None = None) -> Model | None:
    """A model from (url, label): label 1 is to be blocked; of urls with both labels the greater counts.

    label is worked out of the chosen urls' rows alone; by default it is the column of that name.
    """
    host, path = host_and_path(F.col("url"))
    rows = sampled(labelled.select("url"), sample).collect()  # before any label is worked out
    chosen = labelled.sparkSession.createDataFrame(rows, "url string").withColumnRenamed("url", "__skyledger_url")  # sample rows at most
    own = labelled.join(F.broadcast(chosen), F.col("url") == F.col("__skyledger_url"), "left_semi")
    found = own.groupBy("url").agg(F.max(F.col("label") if label is None else label).alias("label")).filter("label is not null").select("url", host.alias("host"), path.alias("path"), "label").collect()
    found.sort()
    labels = np.array([r.label for r in found], float)
    if len(set(labels.tolist())) < 2:
        return None
    return fit([(r.url, r.host, r.path) for r in found], labels)


SCORE = "__skyledger_block_score"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            urls, hosts, paths = (batch.column(c).to_pylist() for c in ("url", "host", "path"))
            score = np.zeros(len(urls)) if model is None else model.scores([(u or "", h, p) for u, h, p in zip(urls, hosts, paths)])
            yield pa.record_batch([*batch.columns, pa.array(score)], names=[*batch.schema.names, SCORE])

    return run


def judged(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every url.

    labelled: (url, label) to train from; by default the pages' urls by junk_page() of their html.
    """
    host, path = host_and_path(F.col("url"))
    found = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    found = found.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(verdict)
    found = found.withColumn("rule_verdict", verdict)
    model = train(pages.select("url", "html"), label=junk_page(F.col("html"))) if labelled is None else train(labelled)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few dozen trees, and rates of at most three suffixes a url
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    scored = found.mapInArrow(_score(shared), f"{schema}, {SCORE} double")
    judged_so = F.when(F.col(SCORE) >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", judged_so).alias("verdict"), F.col(SCORE).alias("score"))
