"""URL verdicts: host and path rules, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import keep, lookup, url_parts

#: The rules a url is judged by (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Distinct urls that the classifier is fitted on at most.
TRAIN_ROWS = 20_000
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "host_entropy", "parameters", "query_length", "hyphens", "marks", "longest_label", "secure", "suffix_1_rate", "suffix_1_seen", "suffix_2_rate", "suffix_2_seen")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (``host + path``) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def lexical(url: str, host: str, path: str) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".")
    return [
        len(url), len(host), len(path), sum(bool(x) for x in path.split("/")), len(labels), sum(c.isdigit() for c in url) / max(1, len(url)), _entropy(url), _entropy(host),
        len([x for x in re.split("[&;]", query) if x]), len(query), url.count("-"), sum(not c.isalnum() for c in url), max(map(len, labels)), float(url[:8].lower() == "https://"),
    ]


@dataclass
class SuffixRates:
    """Smoothed share of blocked urls per host suffix, the longer suffix shrunk towards the shorter."""

    prior: float = 0.5
    weight: float = 10.0
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def fit(cls, hosts, labels) -> SuffixRates:
        rates = cls(prior=float(np.mean(labels)) if len(labels) else 0.5)
        for host, y in zip(hosts, labels, strict=True):
            for s in dict.fromkeys(suffixes(host)):
                n, k = rates.counts.get(s, (0, 0))
                rates.counts[s] = (n + 1, k + int(y))
        return rates

    def of(self, host: str, without: int | None = None) -> list[float]:
        """Rates and counts of both suffixes; without: the label of a training row to leave out."""
        counts = [self.counts.get(s, (0, 0)) for s in suffixes(host)]
        return self.smoothed([(n - 1, k - without) if without is not None and n else (n, k) for n, k in counts])

    def smoothed(self, counts) -> list[float]:
        out, rate = [], self.prior
        for n, k in counts:
            rate = (k + self.weight * rate) / (n + self.weight)
            out += [rate, float(np.log1p(n))]
        return out


@dataclass
class BoostedTrees:
    """Binary gradient boosting with histogram splits on quantile bins and logistic loss."""

    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 32
    leaf: float = 1.0
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if len(y) == 0 or y.min() == y.max():
            return self
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, f, n_bins = self._binned(x), np.full(len(y), self.base), self.bins + 1
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-f))
            g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            size = 2**self.depth - 1
            column, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(2 * size + 1)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                gn, hn = np.bincount(at - first, g, width), np.bincount(at - first, h, width)
                for j in range(x.shape[1]):
                    cell = (at - first) * n_bins + b[:, j]
                    gl = np.bincount(cell, g, width * n_bins).reshape(width, n_bins).cumsum(1)[:, :-1]
                    hl = np.bincount(cell, h, width * n_bins).reshape(width, n_bins).cumsum(1)[:, :-1]
                    gr, hr = gn[:, None] - gl, hn[:, None] - hl
                    gain = gl**2 / (hl + self.leaf) + gr**2 / (hr + self.leaf) - (gn**2 / (hn + self.leaf))[:, None]
                    gain[(hl < 1e-3) | (hr < 1e-3)] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(width), k] > best + 1e-9
                    best[better] = gain[np.arange(width), k][better]
                    column[first : first + width][better] = j
                    cut[first : first + width][better] = k[better]
                right = np.where(column[at] >= 0, b[np.arange(len(y)), np.maximum(column[at], 0)] > cut[at], False)
                at = 2 * at + 1 + right
            total = np.bincount(at, g, 2 * size + 1), np.bincount(at, h, 2 * size + 1)
            value = -self.rate * total[0] / (total[1] + self.leaf)
            f += value[at]
            self.nodes.append((column, cut, value))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if not self.nodes:
            return f
        b, rows = self._binned(x), np.arange(len(x))
        for column, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = column[at]
                at = 2 * at + 1 + np.where(j >= 0, b[rows, np.maximum(j, 0)] > cut[at], False)
            f += value[at]
        return f


@dataclass
class UrlModel:
    rates: SuffixRates
    trees: BoostedTrees

    @classmethod
    def fit(cls, urls: list[tuple[str, str, str]], blocked: list[int]) -> UrlModel:
        rates = SuffixRates.fit([h for _, h, _ in urls], blocked)
        x = np.array([lexical(u, h, p) + rates.of(h, y) for (u, h, p), y in zip(urls, blocked, strict=True)], dtype=np.float64).reshape(len(urls), len(FEATURES))
        return cls(rates, BoostedTrees().fit(x, np.array(blocked, dtype=np.float64)))

    @classmethod
    def fit_counted(cls, urls: list[tuple[str, str, str]], blocked: list[int], copies: list[int], counts, prior: float) -> UrlModel:
        """counts: (rows, blocked rows) of both suffixes of each url; its own copies are left out."""
        rates = SuffixRates(prior=prior)
        others = [[(n - c, k - c * y) for n, k in pair] for pair, c, y in zip(counts, copies, blocked, strict=True)]
        x = np.array([lexical(*u) + rates.smoothed(o) for u, o in zip(urls, others, strict=True)], dtype=np.float64).reshape(len(urls), len(FEATURES))
        return cls(rates, BoostedTrees().fit(x, np.array(blocked, dtype=np.float64)))

    def block_probability(self, urls: list[tuple[str, str, str]], counts=None) -> np.ndarray:
        known = [self.rates.of(h) for _, h, _ in urls] if counts is None else [self.rates.smoothed(pair) for pair in counts]
        x = np.array([lexical(*u) + r for u, r in zip(urls, known, strict=True)], dtype=np.float64).reshape(len(urls), len(FEATURES))
        return 1 / (1 + np.exp(-self.trees.logits(x)))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A verdict for every url: its longest rule's, else the boosted trees'.

    The trees learn from distinct urls that a rule decides, at most ``train_rows`` of them,
    taken in the order of a hash of the url (the bound of what reaches the driver), unsigned
    and in its upper bits; suffix rates come from a grouped aggregation over all decided
    rows. Rules and parts stay DataFrame expressions; urls reach Python in Arrow batches.

    Defined cases: a null url, or one without ``://``, has an empty host and path and is
    judged by the trees; with no decided url, or one kind only, the trees give that base
    rate (one half counts as block); repeated urls get equal verdicts; an empty table gives
    no rows; other columns are not read.
    """
    host, path = url_parts(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_told": verdict})
    ends = [F.substring_index("host", ".", -k) for k in (1, 2)]
    decided = rows.where(F.col("_told").isNotNull()).withColumn("_y", (F.col("_told") == "block").cast("long"))
    counts = decided.select(F.explode(F.array_distinct(F.array(*ends))).alias("_suffix"), "_y").groupBy("_suffix").agg(F.count("*").alias("n"), F.sum("_y").alias("k"))
    counts = keep(counts.select("_suffix", F.struct("n", "k").alias("_seen")))
    prior, distinct = decided.agg(F.avg("_y"), F.approx_count_distinct("_url", 0.02)).first()

    def counted(df: DataFrame) -> DataFrame:
        for k, end in enumerate(ends, 1):
            df = lookup(df.withColumn(f"_end{k}", end), counts.select(F.col("_suffix").alias(f"_end{k}"), F.col("_seen").alias(f"_seen{k}")), f"_end{k}").drop(f"_end{k}")
        return df.withColumns({f"_{c}{k}": F.coalesce(F.col(f"_seen{k}.{c}"), F.lit(0)) for k in (1, 2) for c in "nk"}).drop("_seen1", "_seen2")

    # Urls whose hash is below a share of about 1.5 samples, so that tasks send few rows beyond those taken.
    unit = F.shiftrightunsigned(F.xxhash64("_url"), 11) / F.lit(float(1 << 53))
    drawn = decided.where(unit < F.lit(min(2.0, 1.5 * train_rows / max(1, distinct or 0))))
    sample = drawn.groupBy("_url", "host", "path", "_y").agg(F.count("*").alias("_copies")).orderBy(unit, "_url").limit(train_rows)
    seen = counted(sample).orderBy(unit, "_url").collect()
    model = UrlModel.fit_counted([(r["_url"], r["host"], r["path"]) for r in seen], [r["_y"] for r in seen], [r["_copies"] for r in seen], [((r["_n1"], r["_k1"]), (r["_n2"], r["_k2"])) for r in seen], 0.5 if prior is None else prior)

    @F.pandas_udf("double")
    def judged(url: pd.Series, host: pd.Series, path: pd.Series, n1: pd.Series, k1: pd.Series, n2: pd.Series, k2: pd.Series) -> pd.Series:
        pairs = list(zip(zip(n1, k1, strict=True), zip(n2, k2, strict=True), strict=True))
        return pd.Series(model.block_probability(list(zip(url.fillna(""), host, path, strict=True)), pairs))

    rows = counted(rows).withColumn("block_score", judged("_url", "host", "path", "_n1", "_k1", "_n2", "_k2"))
    told = F.coalesce("_told", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", told.alias("verdict"), F.round("block_score", 6).alias("block_score"))
