"""URL filters: a rule list, and gradient-boosted trees on lexical features for
the URLs that no rule decides.

The trees are trained in numpy on a bounded sample of labelled URLs: length,
depth, digit ratio, character entropy, parameter counts and smoothed label
statistics of the host's suffixes. Where no labelled table is given, the URLs
that a rule decides are the labelled ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, lowest_by_hash

#: (rule, verdict); a rule is a host and the path its URLs start with.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits host and path, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


# --------------------------------------------------------------------------
# features and trees


#: Host, path, query and fragment of a URL; the host ends as it does for rules.
URL = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?(#.*)?")


def parts(url: str) -> tuple[str, str, str, str]:
    found = URL.fullmatch(url)
    return tuple(x or "" for x in found.groups()) if found else ("", "", "", "")


def suffixes(url: str) -> list[str]:
    host = parts(url)[0].lower()
    labels = host.split(".")
    return [".".join(labels[-n:]) for n in (1, 2, 3) if len(labels) >= n] if host else []


class SuffixStatistics:
    """Smoothed share of blocked URLs under each host suffix; a suffix seen
    fewer than ``least`` times counts as the next shorter one."""

    def __init__(self, urls: list[str], labels: np.ndarray, least: int = 5, smooth: float = 2.0):
        seen, bad = Counter(), Counter()
        for url, label in zip(urls, labels, strict=True):
            for s in suffixes(url):
                seen[s] += 1
                bad[s] += int(label)
        self.prior = (float(np.sum(labels)) + 1) / (len(labels) + 2)
        self.share = {s: (bad[s] + smooth * self.prior) / (n + smooth) for s, n in seen.items() if n >= least}

    def of(self, url: str) -> list[float]:
        out, last = [], self.prior
        for s in suffixes(url):
            last = self.share.get(s, last)
            out.append(last)
        return (out + [last] * 3)[:3]


def features(urls: list[str], statistics: SuffixStatistics) -> np.ndarray:
    rows = []
    for url in urls:
        host, path, query, fragment = parts(url)
        n = max(1, len(url))
        counts = Counter(url).values()
        entropy = -sum(c / n * math.log2(c / n) for c in counts)
        digits = sum(c.isdigit() for c in url)
        rows.append([len(url), len(host), len(path), path.count("/"), host.count("."), host.count("-"), digits / n, entropy, query.count("&") + bool(query), query.count("="), bool(fragment), url.startswith("https"), *statistics.of(url)])
    return np.array(rows, np.float64).reshape(len(urls), 15)


class BoostedTrees:
    """Second-order gradient boosting for the logistic loss, histogram splits."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = math.log(share / (1 - share))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-12)
            feature, cut, node = np.full(inner, -1), np.zeros(inner), np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for at in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    rows = np.flatnonzero(node == at)
                    best = self._split(binned[rows], g[rows], h[rows], cuts) if len(rows) > 1 else None
                    if best:
                        feature[at], cut[at] = best[0], cuts[best[0]][best[1]]
                        right = binned[rows, best[0]] > best[1]
                    else:
                        right = np.zeros(len(rows), bool)
                    node[rows] = 2 * at + 1 + right
            leaf = node - inner
            sums = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value = -self.rate * sums[0] / (sums[1] + self.ridge)
            margin = margin + value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _split(self, binned, g, h, cuts):
        whole, best = g.sum() ** 2 / (h.sum() + self.ridge), None
        most = 1e-9
        for j, c in enumerate(cuts):
            gl = np.cumsum(np.bincount(binned[:, j], g, len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[:, j], h, len(c) + 1))[:-1]
            gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - whole
            if len(gain) and gain.max() > most:
                most, best = gain.max(), (j, int(gain.argmax()))
        return best

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node])
                node = 2 * node + 1 + right
            margin = margin + value[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def train(labelled: DataFrame, rows: int = 20_000) -> tuple[SuffixStatistics, BoostedTrees]:
    """Fits suffix statistics and trees on at most ``rows`` distinct labelled URLs
    (url, label: 1 to block), those of the lowest hash."""
    usable = labelled.select("url", F.col("label").cast("int")).where("url IS NOT NULL AND label IS NOT NULL")
    some = lowest_by_hash(usable, "url", rows, "label").collect()
    urls, labels = [r["url"] for r in some], np.array([r["label"] for r in some], np.float64)
    # Statistics come from one half and trees from the other, so that the trees
    # see statistics of URLs that did not make them.
    half = np.arange(len(urls)) % 2 == 0
    statistics = SuffixStatistics([u for u, keep in zip(urls, half, strict=True) if keep], labels[half])
    rest = [u for u, keep in zip(urls, half, strict=True) if not keep]
    return statistics, BoostedTrees().fit(features(rest, statistics), labels[~half])


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, limit: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (the rule's, else
    the trees': block from probability ``limit``), probability (null where a
    rule decides).

    A null url, or one without "://", has empty host and path; repeated rows
    stay; an empty table gives no rows; columns other than page_id and url are
    ignored. Without labelled URLs of both kinds the trees return the prior.
    """
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    parsed = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ruled = parsed.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    ruled = ruled.withColumn("by_rule", by_rule)
    if labelled is None:
        labelled = ruled.where("by_rule IS NOT NULL").select("url", (F.col("by_rule") == "block").cast("int").alias("label"))
    model = base.sparkSession.sparkContext.broadcast(train(labelled))

    @F.pandas_udf("double")
    def probability(urls: pd.Series, decided: pd.Series) -> pd.Series:
        statistics, trees = model.value
        out = np.full(len(urls), np.nan)
        rest = np.flatnonzero(~decided.to_numpy(bool))
        out[rest] = trees.probability(features([urls.iloc[k] or "" for k in rest], statistics))
        return pd.Series(out)

    # A decided URL is sent without its text and gets no features.
    open_url = F.when(F.col("by_rule").isNull(), F.col("url"))
    scored = ruled.withColumn("raw", probability(open_url, F.col("by_rule").isNotNull()))
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.col("raw") >= limit, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("by_rule").isNull(), F.round("raw", 6)).alias("probability"),
    )
