"""URL filter: longest-match rules, then a logistic model of hashed character n-grams.

DataFrame functions only, training included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.sources.shared import scratch_folder, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    """Weights by n-gram bucket; the last one is the constant. All 0: no training rows."""

    weights: tuple[float, ...]


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. The list is short text."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):  # longest last, outermost
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(
            path, F.lit(r.path)
        )
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _grams(part: Column, kind: str, sizes: tuple[int, ...], buckets: int) -> list[Column]:
    """Bucket numbers of all n-grams of ``<part>`` with end marks."""
    marked = F.concat(F.lit("<"), part, F.lit(">"))

    def hashed(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        gram = lambda i: F.xxhash64(F.lit(kind), F.substr(marked, i, F.lit(n)))
        found = F.transform(starts, lambda i: F.pmod(gram(i), F.lit(buckets)).cast("int"))
        return F.when(F.length(marked) >= n, found).otherwise(F.array().cast("array<int>"))

    return [hashed(n) for n in sizes]


def features(host: Column, path: Column, buckets: int, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """The distinct buckets of a URL, ascending, and the constant's."""
    found = _grams(host, "host", sizes, buckets) + _grams(path, "path", sizes, buckets)
    return F.array_sort(F.array_distinct(F.concat(*found, F.array(F.lit(buckets)))))


def _margin(grams: Column, weights: list[float]) -> Column:
    """Sum of the weights over the root of their number. The text is folded into one constant."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table, g))
    return total / F.sqrt(F.size(grams))


def train(
    labelled: DataFrame,
    *,
    buckets: int = 4096,
    rows: int = 2000,
    steps: int = 25,
    rate: float = 3.0,
    penalty: float = 1e-3,
) -> UrlModel:
    """Fit on a small table (url, blocked 0/1).

    ``rows`` bounds the training sample: the distinct labelled URLs with the
    smallest hashes. Accelerated gradient descent on the mean loss; each step is
    one aggregate of at most ``buckets`` + 1 sums. Null URLs are not trained on.
    """
    spark = labelled.sparkSession
    url = F.col("url")
    sample = (
        labelled.where(url.isNotNull() & F.col("blocked").isNotNull())
        .groupBy(url)
        .agg(F.max(F.col("blocked").cast("double")).alias("y"))
        .orderBy(F.xxhash64("url"), "url")
        .limit(rows)
        .select("y", features(host_of(url), path_of(url), buckets).alias("grams"))
    )
    sample = stored(sample.coalesce(1), scratch_folder(spark, "urls"))
    n = sample.count()
    now = [0.0] * (buckets + 1)
    ahead = list(now)
    for step in range(steps if n else 0):
        error = F.col("y") - 1 / (1 + F.exp(-_margin(F.col("grams"), ahead)))
        sums = (
            sample.select((error / F.sqrt(F.size("grams"))).alias("e"), F.explode("grams").alias("g"))
            .groupBy("g")
            .agg(F.sum("e").alias("e"))
            .collect()
        )
        new = [w * (1 - rate * penalty) for w in ahead]
        for g, e in sums:
            new[g] += rate * round(e / n, 9)  # the order of a sum must not show
        momentum = step / (step + 3)
        ahead = [a + momentum * (a - b) for a, b in zip(new, now)]
        now = new
    return UrlModel(tuple(round(w, 9) for w in now))


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict (the last two null without a rule)."""
    url = F.col("url")
    parts = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.select(
        "page_id", "url", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path"))
    )
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return parts.select("*", name.alias("rule"), verdict.alias("rule_verdict"))


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel) -> DataFrame:
    """A verdict for every row of ``pages`` (page_id, url).

    Null or scheme-less URLs have an empty host and path, are covered by no
    rule and get the model's verdict like any other. Without training rows the
    model allows. Repeated rows are judged one by one.
    """
    buckets = len(model.weights) - 1
    margin = _margin(features(F.col("host"), F.col("path"), buckets), list(model.weights))
    by_model = F.when(margin > 0, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged(pages, rules).select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict")
    )
