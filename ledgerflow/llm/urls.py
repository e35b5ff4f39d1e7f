"""URL filters from stated rules and mined associations.

Stated rules name a host with all its subdomains and the beginning of a path; the longest
that fits decides. URLs that a stated rule decides are the labelled examples from which
Spark's FP-growth mines combinations of URL tokens that imply a verdict. Combinations are
pruned by support and confidence and by any part of them that is at least as sure, whatever
their sizes, then found through an inverted index on the rarest of their tokens. Of the combinations that fit a URL the
surest decides, then the better supported, then the longer; ``block`` wins a tie. A URL that
nothing fits is allowed. Null URLs and those without ``://`` have an empty host and path, no
tokens and are allowed. Long URLs are read whole; a path segment that is a number as a whole
is no token. Repeated rows, also those with a null id, are judged alike and all returned; an
empty table gives no rows, and other columns are ignored.

Everything is DataFrame and ML API; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
VERDICTS = ("block", "allow")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    begin = F.locate("://", url)
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def stated(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = rule.fits(host, path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: its host's labels, whole host suffixes and path segments."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    suffix = F.concat(F.lit("top="), F.element_at(labels, -1))
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
            F.when(F.size(labels) > 0, F.array(suffix)).otherwise(F.array().cast("array<string>")),
            F.transform(segments, lambda x: F.concat(F.lit("path="), x)),
        )
    )


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(token, items, verdict, confidence, support) from rows of (tokens, verdict); ``token`` is the
    rarest of the items, the first of those in order.

    The number of combinations is bounded by ``min_support`` and not by the rows.
    """
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("is="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.select(
        F.array_sort("antecedent").alias("items"),
        F.regexp_replace(F.element_at("consequent", 1), "^is=", "").alias("verdict"),
        "confidence",
        "support",
        F.element_at("consequent", 1).startswith("is=").alias("wanted"),
    ).filter("wanted").drop("wanted")
    rules = rules.filter((F.size("items") > 0) & ~F.exists("items", lambda x: x.startswith("is=")))
    alone = model.freqItemsets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    rarest = rules.select("items", "verdict", F.explode("items").alias("token")).join(alone, "token")
    rarest = rarest.groupBy("items", "verdict").agg(F.min_by("token", F.struct("freq", "token")).alias("token"))
    rules = rules.join(rarest, ["items", "verdict"])
    # A combination that is no surer than one of its parts says nothing new. A part's rarest token
    # is among the tokens of the whole.
    parts = rules.select("token", F.col("items").alias("fewer"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"))
    whole = rules.select("items", "verdict", "confidence", F.explode("items").alias("token")).join(parts, "token")
    whole = whole.filter((F.col("verdict") == F.col("same")) & (F.col("sure") >= F.col("confidence")) & (F.size("fewer") < F.size("items")))
    told = whole.filter(F.size(F.array_except("fewer", "items")) == 0).select("items", "verdict").distinct()
    return rules.join(told, ["items", "verdict"], "left_anti")


def judged(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", **mining: float) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``.

    Only the distinct token sets of undecided URLs meet the index, so a host with a third of
    all pages is matched once per kind of path.
    """
    host, path = parts(F.col(url))
    rule, verdict = stated(rules, F.col("host"), F.col("path"))
    known = (
        pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
        .withColumns({"rule": rule, "stated": verdict})
        .withColumn("tokens", F.array_sort(tokens(F.col("host"), F.col("path"))))
    )
    found = mined(known.filter("stated is not null").select("tokens", F.col("stated").alias("verdict")), **mining)
    kinds = known.filter("stated is null").select("tokens").distinct()
    order = F.struct("confidence", "support", F.size("items"), F.col("verdict") == "block")
    guessed = (
        kinds.select("tokens", F.explode("tokens").alias("token"))
        .join(found, "token")
        .filter(F.size(F.array_except("items", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max_by("verdict", order).alias("guess"))
    )
    return known.join(guessed, "tokens", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("stated", F.when(F.col("stated").isNull(), F.col("guess")), F.lit("allow")).alias("verdict")
    )
