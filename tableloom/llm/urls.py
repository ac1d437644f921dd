"""URL verdicts: listed rules first, then a logistic regression on hashed character n-grams of host and path.

The model is trained from a small table of labelled URLs. N-grams of all URLs of a batch are hashed at once over one
byte array; the hash says whether host or path, and how long the n-gram is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import named, smallest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIMENSIONS = 1 << 18
LENGTHS = (3, 4, 5)
STEPS = np.array([1, 1000003, 998244353, 1000000007, 2147483647], dtype=np.uint64)


@dataclass(frozen=True)
class Rule:
    """Decides URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``,
    ``#`` or the end. Both empty for null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does. Rules are a short list of the caller's."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked last and wins
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def ngrams(texts: Sequence[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram; each text is framed by zero bytes, so its ends count too."""
    framed = [b"\0" + t.encode("utf-8", "surrogatepass") + b"\0" for t in texts]
    data = np.frombuffer(b"".join(framed), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(framed)), [len(f) for f in framed])
    rows, features = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in LENGTHS:
        if len(data) < n:
            continue
        mixed = np.full(len(data) - n + 1, 7919 * (kind * 16 + n), dtype=np.uint64)
        for i in range(n):
            mixed = (mixed ^ data[i : len(data) - n + 1 + i]) * STEPS[4] + STEPS[2]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        whole = row[: len(mixed)] == row[n - 1 :]
        rows.append(row[: len(mixed)][whole])
        features.append((mixed[whole] >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


def design(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and values: host and path n-grams, each part scaled to length one."""
    parts = []
    for kind, texts in enumerate((hosts, paths)):
        row, feature = ngrams(texts, kind)
        share = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(texts))))
        parts.append((row, feature, share[row]))
    return tuple(np.concatenate(p) for p in zip(*parts))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def probability(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Of being blocked."""
        row, feature, value = design(hosts, paths)
        z = self.bias + np.bincount(row, self.weights[feature] * value, len(hosts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(hosts: Sequence[str], paths: Sequence[str], blocked: Sequence[int], steps: int = 200) -> UrlModel:
    """Logistic regression by Adam over all labelled URLs. Without both classes: a constant, allow for an empty table."""
    y = np.asarray(blocked, dtype=float)
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros(DIMENSIONS), 10.0 if len(y) and y[0] else -10.0)
    row, feature, value = design(hosts, paths)
    used, column = np.unique(feature, return_inverse=True)
    theta, first, second = np.zeros(len(used) + 1), 0.0, 0.0
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(row, theta[column] * value, len(y))
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        total = np.append(np.bincount(column, g[row] * value, len(used)) + 1e-5 * theta[:-1], g.sum())
        first = 0.9 * first + 0.1 * total
        second = 0.999 * second + 0.001 * total**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(DIMENSIONS)
    weights[used] = theta[:-1]
    return UrlModel(weights, float(theta[-1]))


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    url: str = "url",
    labelled: DataFrame | None = None,
    max_labelled: int = 5_000,
) -> DataFrame:
    """Adds host, path, rule and verdict to every row; replaces columns of these names.

    ``labelled`` is a small table (url, blocked 0/1); without it, the distinct URLs that rules decide are the labels. At
    most ``max_labelled`` of either class are learnt from, those with the smallest hashes. Where no rule fits, the model
    decides: block from a probability of 0.5. Null URLs and those without ``://`` have an empty host and path and go to
    the model like all others; equal URLs get equal verdicts; an empty table stays empty.
    """
    host, path = host_and_path(named(url))
    text, verdict = rule_for(host, path, rules)
    if labelled is None:
        known = pages.select(host.alias("h"), path.alias("p"), (verdict == "block").cast("int").alias("y"))
    else:
        h, p = host_and_path(F.col("url"))
        known = labelled.select(h.alias("h"), p.alias("p"), F.col("blocked").cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1)).distinct()
    small = [
        r for y in (0, 1)
        for r in smallest(known.filter(F.col("y") == y), F.xxhash64("h", "p"), ["h", "p"], max_labelled).collect()
    ]
    model = train([r["h"] for r in small], [r["p"] for r in small], [r["y"] for r in small])
    shared = pages.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights

    @F.pandas_udf("boolean")
    def blocks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(shared.value.probability(hosts.tolist(), paths.tolist()) >= 0.5)

    own = blocks(host, path)
    return pages.withColumns({
        "host": host, "path": path, "rule": text,
        "verdict": F.coalesce(verdict, F.when(own, F.lit("block")).otherwise(F.lit("allow"))),
    })
