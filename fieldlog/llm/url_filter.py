"""URL verdicts: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the start of a path. The trees are trained on the URLs that a rule decides, all of them: those verdicts are
the labels. Features are lexical: length, depth, digit ratio, entropy, counts of parameters, labels and hyphens, and the share of
blocked URLs under the host's last label (for a training row, in the other folds).

Defined cases: a null URL, or one without ://, has an empty host and path and no rule; the trees judge it like any other. Without
labelled URLs everything else is allowed; with one kind of label, that is the verdict. Repeated rows get equal verdicts.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The contract's rules: verdict and host with the path's start.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
TREES, DEPTH, SEED = 12, 4, 5
#: Imagined URLs at the overall share, for rare suffixes.
PRIOR = 20.0
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, start = self.text.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def deciding(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = r.fits(host, path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def count_of(sign: str, x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))).cast("double")


def entropy(x: Column) -> Column:
    """Of the characters, in bits."""
    n = F.length(x)
    share = lambda c: (n - F.length(F.replace(x, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    asks = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return {
        "url_length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count_of("/", path),
        "digit_ratio": F.when(F.length(u) > 0, F.length(F.regexp_replace(u, "[^0-9]", "")) / F.length(u)).otherwise(0.0),
        "host_digits": F.length(F.regexp_replace(host, "[^0-9]", "")).cast("double"),
        "entropy": entropy(u),
        "host_entropy": entropy(host),
        "parameters": F.when(asks != "", count_of("&", asks) + 1).otherwise(0.0),
        "labels": count_of(".", host),
        "hyphens": count_of("-", host),
        "secure": u.startswith("https://").cast("double"),
        "anchored": F.contains(u, F.lit("#")).cast("double"),
    }


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """One row per row: page_id, host, path, rule, verdict, score (the trees' chance of a block; null where a rule decides)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rules = rules if rules is not None else [Rule(*r) for r in RULES]
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = deciding(rules, F.col("host"), F.col("path"))
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    pages = pages.select("page_id", "host", "path", text.alias("rule"), (verdict == "block").cast("double").alias("label"), F.element_at(F.split("host", r"\."), -1).alias("suffix"), *[c.alias(n) for n, c in features.items()])

    # A training row's suffix share comes from the other folds, so that it can't tell the row's own label.
    pages = pages.withColumn("fold", F.pmod(F.xxhash64("page_id"), F.lit(FOLDS)))
    folds = pages.where(F.col("label").isNotNull()).groupBy("suffix", "fold").agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("seen"))
    by_suffix = folds.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("seen").alias("seen"), F.collect_list(F.struct("fold", "blocked", "seen")).alias("folds"))
    whole = by_suffix.agg(F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("blocked"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen")).first()
    result = ["page_id", "host", "path", "rule"]
    if whole.blocked in (0, whole.seen):
        rest = "block" if whole.blocked else "allow"
        return pages.select(*result, F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow").otherwise(rest).alias("verdict"), F.when(F.col("label").isNull(), float(rest == "block")).alias("score"))

    share = whole.blocked / whole.seen
    others = F.filter(F.coalesce("folds", F.array()), lambda x: F.col("label").isNull() | (x["fold"] != F.col("fold")))
    sum_of = lambda name: F.aggregate(others, F.lit(0.0), lambda acc, x: acc + x[name])
    pages = pages.join(by_suffix, "suffix", "left").withColumn("suffix_share", (sum_of("blocked") + PRIOR * share) / (sum_of("seen") + PRIOR))
    pages = written(pages.drop("suffix", "blocked", "seen", "folds", "fold"), "urls")
    with_vector = VectorAssembler(inputCols=[*features, "suffix_share"], outputCol="vector", handleInvalid="keep").transform(pages)
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(with_vector.where(F.col("label").isNotNull()).select("vector", "label"))
    judged = model.transform(with_vector).withColumn("chance", vector_to_array("probability")[1])
    score = F.when(F.col("label").isNull(), F.col("chance"))
    return judged.select(*result, F.when(F.coalesce("label", F.when(score >= 0.5, 1.0).otherwise(0.0)) == 1, "block").otherwise("allow").alias("verdict"), score.alias("score"))
