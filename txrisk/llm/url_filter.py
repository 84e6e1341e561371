"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

The rules label the URLs that they fit; trees learn those labels from the URL alone (length, depth,
digit ratio, entropy, parameter counts and suffix statistics) and judge the URLs that no rule fits.
Trees are trained on at most ``SAMPLE`` distinct labelled URLs, chosen by hash, of which the driver gets
lexical features and hashes of the suffixes and the first folder, whatever the URLs' lengths.  Suffix
statistics of a training URL come from the other folds, so that no URL's own label is among its features.

A null URL or one without ``://`` has an empty host and path, and no rule; the trees judge it like any
other.  Without labelled URLs of both verdicts every URL gets the only verdict seen, or ``allow``.
Repeated rows are judged alike, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SAMPLE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules of the query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> Column:
    """``struct(host, path)``; both empty without ``://``."""

    def parts(rest: Column) -> Column:
        host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
        path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
        return F.struct(host.alias("host"), path.alias("path"))

    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return let(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit("")), parts)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits the host or a parent and the path's start; else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: str) -> tuple[str, str]:
    """The last label of a host and its last two."""
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


LEXICAL = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy",
    "params", "query_length", "fragment", "hyphens", "https", "longest_label",
)
#: What statistics of labels are kept for: the last label of the host, its last two, and the first folder.
KEYS = ("suffix", "suffix2", "folder")
FOLDS = 5


def lexical(url: str, host: str, path: str) -> list[float]:
    n = max(1, len(url))
    query = url.partition("?")[2].partition("#")[0]
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum(map(str.isdigit, url)) / n,
        sum(map(str.isdigit, host)) / max(1, len(host)), entropy(url), entropy(host), query.count("&") + bool(query), len(query),
        "#" in url, host.count("-") + path.count("-"), url.startswith("https"), max(map(len, host.split("."))),
    ]


def keys(host: str, path: str) -> list[int]:
    """Hashes of what statistics are kept for."""
    from xxhash import xxh64_intdigest

    folder = path.split("/", 2)[1] if path.count("/") > 1 else ""
    return [xxh64_intdigest(f"{k}:{v}".encode()) for k, v in zip(KEYS, (*suffixes(host), folder))]


def described(urls: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(lexical features, keys), one row per URL."""
    x = np.array([lexical(*u) for u in urls], float).reshape(-1, len(LEXICAL))
    return x, np.array([keys(h, p) for _, h, p in urls], np.uint64).reshape(-1, len(KEYS))


def rates_of(k: np.ndarray, y: np.ndarray, prior: float, weight: float = 20.0) -> dict[int, float]:
    """Smoothed share of blocked URLs by key."""
    own, at = np.unique(k, return_inverse=True)
    n, hit = np.bincount(at.ravel(), minlength=len(own)), np.bincount(at.ravel(), np.repeat(y, k.shape[1]), len(own))
    return dict(zip(own.tolist(), ((hit + weight * prior) / (n + weight)).tolist()))


@dataclass
class Trees:
    """Boosted regression trees on binned features, with the suffix statistics they use."""

    prior: float = 0.0
    rates: dict[int, float] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def features(self, x: np.ndarray, k: np.ndarray, rates: dict[int, float] | None = None) -> np.ndarray:
        middle, rates = 1 / (1 + math.exp(-self.prior)), self.rates if rates is None else rates
        return np.column_stack([x, np.array([[rates.get(v, middle) for v in row] for row in k.tolist()], float).reshape(k.shape)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1) if self.edges else x
        out = np.full(len(x), self.prior)
        for feature, cut, leaf in self.trees:
            out += leaf[_leaves(bins, feature, cut)]
        return out


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Leaf of each row in a complete tree whose nodes are numbered level by level."""
    node = np.zeros(len(bins), np.int64)
    for _ in range(int(math.log2(len(feature) + 1))):
        node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])
    return node - len(feature)


def train(x: np.ndarray, k: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32) -> Trees:
    """Second-order boosting of the logistic loss; ``y`` is 1 for blocked URLs, ``x`` and ``k`` as in ``described``."""
    p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.0
    model = Trees(prior=math.log(p / (1 - p)) if 0 < p < 1 else -20.0)
    if len(y) == 0 or y.min() == y.max():
        model.prior = 20.0 if len(y) and y[0] else -20.0
        return model
    model.rates = rates_of(k, y, p)
    fold = np.random.default_rng(13).permutation(len(y)) % FOLDS
    parts = [model.features(x[fold == f], k[fold == f], rates_of(k[fold != f], y[fold != f], p)) for f in range(FOLDS)]
    x = np.empty((len(y), x.shape[1] + k.shape[1]))
    for f, part in enumerate(parts):
        x[fold == f] = part
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    b = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(model.edges)], 1)
    score = np.full(len(y), model.prior)
    inner = (1 << depth) - 1
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            best = np.full(n, 1e-9)
            total_g, total_h = np.bincount(node - first, g, n), np.bincount(node - first, h, n)
            for k in range(b.shape[1]):
                at = (node - first) * bins + b[:, k]
                lg = np.cumsum(np.bincount(at, g, n * bins).reshape(n, bins), 1)
                lh = np.cumsum(np.bincount(at, h, n * bins).reshape(n, bins), 1)
                rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - (total_g**2 / (total_h + 1))[:, None]
                gain[(lh < 1) | (rh < 1)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best
                best = np.where(better, gain[np.arange(n), top], best)
                feature[first : first + n][better] = k
                cut[first : first + n][better] = top[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        leaf = -rate * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + 1)
        score += leaf[node - inner]
        model.trees.append((feature, cut, leaf))
    return model


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    hp = host_and_path(F.col("url"))
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), hp.alias("p"))
    return p.select("page_id", "url", "p.host", "p.path", rule_of(F.col("p.host"), F.col("p.path"), rules).alias("r"))


def labelled_sample(p: DataFrame, n: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lexical features, keys, labels) of at most ``n`` distinct URLs that a rule fits, those with the smallest hashes."""
    known = p.where("r is not null").select(F.xxhash64("url").alias("h"), "url", "host", "path", (F.col("r.verdict") == "block").alias("y"))
    last = known.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    columns = [f"x{i}" for i in range(len(LEXICAL))] + [f"k{i}" for i in range(len(KEYS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, k = described(list(zip(b["url"], b["host"], b["path"])))
            cols = [*x.T, *k.view(np.int64).T]
            yield pd.DataFrame({"h": b["h"].to_numpy(), "y": b["y"].to_numpy(), **dict(zip(columns, cols))})

    if last is None:
        return np.zeros((0, len(LEXICAL))), np.zeros((0, len(KEYS)), np.uint64), np.zeros(0)
    schema = "h bigint, y boolean, " + ", ".join(f"{c} {'double' if c[0] == 'x' else 'bigint'}" for c in columns)
    rows = known.where(F.col("h") <= last).mapInPandas(run, schema).dropDuplicates(["h"]).toPandas().sort_values("h")
    return rows[columns[: len(LEXICAL)]].to_numpy(float), rows[columns[len(LEXICAL) :]].to_numpy(np.int64).view(np.uint64), rows["y"].to_numpy(float)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: host, path, the rule that fits, the verdict, and the trees' score."""
    p = parsed(pages, rules)
    model = train(*labelled_sample(p))

    @F.pandas_udf("double")
    def blocked(url: pd.Series, host: pd.Series, path: pd.Series) -> pd.Series:
        if not len(url):
            return pd.Series([], dtype=float)
        return pd.Series(1 / (1 + np.exp(-model.raw(model.features(*described(list(zip(url, host, path))))))))

    s = p.withColumn("score", blocked("url", "host", "path"))
    own = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return s.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "score")
