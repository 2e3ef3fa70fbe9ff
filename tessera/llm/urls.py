"""URL filters: a list of rules, then gradient-boosted trees over lexical features.

The rule list is policy and is compiled into one column expression. All other URLs are judged by trees that are trained
from labelled URLs on what their text looks like: lengths, depth, digit ratio, entropy, parameter counts, and how much
oftener hosts of the same suffix (last label, last two labels) are bad among the labelled ones. There are no word lists.

Labels are a table of URLs marked 1 (bad) or 0. Where there is none, the table's own URLs are labelled by a published
rule, the URL heuristics of CANTINA (Zhang, Hong and Cranor, WWW 2007): an at sign or a dash in the domain name, an IP
address for a host, or five dots or more. None of the features counts dashes or at signs, so the trees have to find
what else such URLs have in common.

Scale: no exchange but one aggregation of distinct URLs by hash; a bounded set of labelled URLs reaches the driver, the
model is a few kilobytes.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import only, smallest, table
from tessera.llm.trees import Boosted, boost

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A URL is blocked if the trees find it bad with this probability.
THRESHOLD = 0.5
#: At most so many labelled URLs are used, those with the smallest hashes.
LABELLED = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_IP = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]*)?$"


def suspicious(url: Column) -> Column:
    """1 where the published URL heuristics fire: at sign or dash in the domain name, IP address, five or more dots; else 0."""
    host = host_of(url)
    dots = F.length(url) - F.length(F.replace(url, F.lit("."), F.lit("")))
    return (host.contains("@") | host.contains("-") | host.rlike(_IP) | (dots >= 5)).cast("int")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _pieces(url: str | None) -> tuple[str, str, str]:
    _, found, rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)(.*)", rest if found else "", re.S)
    return m[1].lower(), m[2], m[3]


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


#: A suffix with fewer labelled hosts has no statistics; as many hosts of the overall share are added to each.
HOSTS = 10
FEATURES = (
    "length", "host_length", "path_length", "name_length", "path_depth", "host_depth", "digit_ratio", "host_digits", "entropy", "name_entropy",
    "parameters", "query_length", "suffix_rate", "domain_rate",
)


class UrlModel:
    """The trees with the suffix statistics they were trained with."""

    def __init__(self, labelled: Sequence[tuple[str | None, int]]):
        hosts: dict[str, int] = {}
        for url, bad in labelled:
            host = _pieces(url)[0]
            hosts[host] = max(hosts.get(host, 0), bad)
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for host, bad in hosts.items():
            for s in dict.fromkeys(_suffixes(host)):
                seen[s][0] += bad
                seen[s][1] += 1
        # hosts, not URLs, and only suffixes of several: the share must not give away a host's own label
        among = sum(hosts.values()) / max(len(hosts), 1)
        self.rates = {s: (b + HOSTS * among) / (n + HOSTS) - among for s, (b, n) in seen.items() if n >= HOSTS}
        y = np.array([b for _, b in labelled], dtype=float)
        self.trees: Boosted = boost(self.features([u for u, _ in labelled]), y, trees=120, depth=4)

    def features(self, urls: Sequence[str | None]) -> np.ndarray:
        """FEATURES of each URL; zeros for a null URL or one without ``://``."""
        rows = []
        for url in urls:
            host, path, query = _pieces(url)
            name = host.rpartition(".")[0] or host
            last, two = _suffixes(host)
            text = host + path + query
            n = max(len(text), 1)
            rows.append((
                len(text), len(host), len(path), max(map(len, name.split("."))), path.count("/"), host.count("."), sum(c.isdigit() for c in text) / n,
                sum(c.isdigit() for c in host), _entropy(text), _entropy(name), query.count("=") + query.count("&"), len(query),
                self.rates.get(last, 0.0), self.rates.get(two, 0.0),
            ))
        return np.array(rows, dtype=float).reshape(-1, len(FEATURES))

    def score(self, urls: Sequence[str | None]) -> np.ndarray:
        return self.trees.score(self.features(urls)) if len(urls) else np.zeros(0)


def train(labelled: DataFrame, *, bound: int = LABELLED) -> UrlModel:
    """A model from at most ``bound`` rows (url, label; 1 is bad), those whose URLs have the smallest hashes.

    Null URLs and labels are left out; a URL with several labels counts as bad if one says so. Without rows, or with one
    class only, the score is a constant.
    """
    rows = only(labelled, url="url", label="label").where("url IS NOT NULL AND label IS NOT NULL").groupBy("url").agg(F.max("label").alias("label"))
    return UrlModel(sorted((u, int(b > 0)) for u, b in smallest(rows, "url", bound).collect()))


def judge(pages: DataFrame, model: UrlModel, *, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad): the longest rule that fits decides, else the trees.

    A null URL or one without ``://`` has an empty host and path, fits no rule, and is judged by the trees like any other.
    Repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
    """
    packed = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def bad(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pickle.loads(packed.value)
        for part in urls:
            yield pd.Series(own.score(part.tolist()))

    rows = only(pages, id=id_col, url=url_col).select("id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"), bad("url").alias("bad"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("bad") >= threshold, "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "bad")


def self_labelled(pages: DataFrame, *, url_col: str = "url") -> DataFrame:
    """(url, label) of the table's distinct URLs by the published rule."""
    return only(pages, url=url_col).where("url IS NOT NULL").distinct().select("url", suspicious(F.col("url")).alias("label"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, train(self_labelled(pages)))
