"""URL filter: host and path rules, and a logistic regression on hashed character n-grams.

The model is trained from a small labelled table of urls. At most ``MAX_LABELLED`` of its rows are
used (those with the smallest hash of the url), so that the training set that reaches the driver
is bounded; every url is judged.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path and is
judged by the method like any other. Repeated rows are judged alike. Columns of the input that are
called like an output (host, path, rule, score, verdict) are replaced, all others are kept. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, table
from tallyloom.llm.registry import query
from tallyloom.session import small_table

MAX_LABELLED = 20_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host/path; it fits the host and its subdomains below the path."""

    pattern: str
    allow: bool


@dataclass
class UrlModel:
    """Weights of hashed n-grams; ``bits`` is the logarithm of the number of buckets."""

    bits: int = 15
    sizes: tuple[int, ...] = (3, 4, 5)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def features(self, host: str, path: str) -> np.ndarray:
        """Distinct buckets of the n-grams of host and path; each part has its own n-grams."""
        mask, out = (1 << self.bits) - 1, set()
        for part, text in (("h", f".{host}."), ("p", path)):
            raw = text.encode()
            for n in self.sizes:
                seed = zlib.crc32(f"{part}{n}".encode())
                out.update(zlib.crc32(raw[i : i + n], seed) & mask for i in range(len(raw) - n + 1))
        return np.fromiter(out, np.int64, len(out))

    def score(self, host: str, path: str) -> float:
        f = self.features(host, path)
        return self.probability(self.weights[f].sum() / np.sqrt(max(1, len(f))) + self.bias)

    @staticmethod
    def probability(z: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, rows: list[tuple[str, str, int]], epochs: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> UrlModel:
        """Adaptive gradient descent over the rows in a fixed order."""
        self.weights, self.bias = np.zeros(1 << self.bits), 0.0
        seen, seen_bias = np.full(1 << self.bits, 1e-6), 1e-6
        rows = sorted(rows, key=lambda r: zlib.crc32(f"{r[0]}{r[1]}".encode()))
        data = [(self.features(h, p), y) for h, p, y in rows]
        for _ in range(epochs):
            for f, y in data:
                norm = np.sqrt(max(1, len(f)))
                gap = self.probability(self.weights[f].sum() / norm + self.bias) - y
                g = gap / norm + ridge * self.weights[f]
                seen[f] += g * g
                seen_bias += gap * gap
                self.weights[f] -= rate * g / np.sqrt(seen[f])
                self.bias -= rate * gap / np.sqrt(seen_bias)
        return self


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, else null; one expression, for a bounded list."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        name, _, below = r.pattern.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{below}")
        out = F.when(fits, F.lit(r.pattern)).otherwise(out)
    return out


def train_url_model(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> UrlModel:
    """Fit on ``labelled`` (url, label: 1 unwanted), at most ``max_rows`` of them."""
    host, path = split_url(F.col("url"))
    sample = labelled.where("label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    rows = sample.select(host.alias("h"), path.alias("p"), F.col("label").cast("int").alias("y")).collect()
    return UrlModel().fit([tuple(r) for r in rows])


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Every row with host, path, rule, score (0 to 1, higher: unwanted) and verdict."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = shared.value
        for hosts, paths in batches:
            yield pd.Series([m.score(h, p) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    host, path = split_url(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    out = out.withColumns({"rule": longest_rule(F.col("host"), F.col("path"), rules), "score": score("host", "path")})
    allowed = [r.pattern for r in rules if r.allow]
    by_rule = F.when(F.col("rule").isin(allowed), "allow").otherwise("block")
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_model))


#: Rules of the registered query.
RULES = [Rule("net/", False), Rule("example.net/en/", True), Rule("example.com/de/", False), Rule("org/fr/", True)]

#: The labelled table of the registered query: names of unwanted and of ordinary sites.
UNWANTED = (
    "casino-royal online-casino best-casino sports-bets bet-now poker-bets pills-online "
    "buy-pills diet-pills link-farm seo-farm farm-spam ad-track track-clicks click-ads pop-ads "
    "adult-cams x-adult xxx-video free-xxx win-money easy-money fast-loans payday-loans replica-watches cheap-viagra"
)
ORDINARY = (
    "news library museum university garden recipes weather travel history science music theatre health school council "
    "gallery sports daily review journal archive forum hikers cycling books maps astronomy chess kitchen heron thandor "
    "winter-walks city-guide old-town tea-house bird-watch open-data code-notes river-path"
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The names above on several kinds of host and path."""
    heads, tops, paths = ("www.", "blog.", "m.", ""), ("com", "org", "net"), ("/en/12", "/de/7.html", "/fr/3/", "/es/45?page=2")
    rows = [
        (f"https://{heads[i % 4]}{name}.example.{tops[i % 3]}{paths[(i // 2) % 4]}", label)
        for label, names in ((1, UNWANTED), (0, ORDINARY))
        for i, name in enumerate(names.split())
    ]
    return small_table(spark, rows, "url string, label int")


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_url_model(labelled_urls(spark))
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, model)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("unwanted"))
