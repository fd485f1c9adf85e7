"""URL filter: rules by host and path, and boosted trees on lexical features. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.shared import checkpointed

ALLOW, BLOCK = "allow", "block"
# A rule is a verdict and host/path, the path with its first slash.
RULES = ((ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"),
         (BLOCK, "net/es/"), (BLOCK, "net/fr/"))
MAX_RULES = 500
# Labelled URLs of each verdict that the trees are trained on, at most.
PER_CLASS = 10_000
TREES, DEPTH, RATE = 20, 4, 0.2
# Rows that a suffix's own share counts against the share of all.
PRIOR_ROWS = 20.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A(?:(?!://).)*+://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER),
            F.regexp_extract(text, _URL, 2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES
            ) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does.

    A rule fits its host and all subdomains where the path starts with its path. Rules are written into
    the plan, so their number is bounded.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} are the bound")
    name = verdict = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty one."""
    n = F.length(text)
    kinds = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.filter(kinds, lambda c: F.length(c) > 0), F.lit(0.0),
                       lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def _counted(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers read off the URL alone."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    length = F.length(text)
    digits = _counted(text, "[0-9]")
    return {name: column.cast("double") for name, column in {
        "url_length": length, "host_length": F.length(host), "path_length": F.length(path),
        "path_depth": _counted(path, "/"), "host_depth": _counted(host, r"\."),
        "digit_ratio": F.when(length > 0, digits / length).otherwise(0.0),
        "host_digits": _counted(host, "[0-9]"), "hyphens": _counted(text, "-"),
        "url_entropy": entropy(text), "host_entropy": entropy(host),
        "parameters": F.when(F.length(query) > 0, 1 + _counted(query, "&")).otherwise(0),
        "query_length": F.length(query), "fragment": F.contains(text, F.lit("#")).cast("int"),
        "file": path.rlike(r"\.[A-Za-z0-9]+$").cast("int"),
        "secure": text.startswith("https:").cast("int"),
    }.items()}


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


_SUFFIXES = {"suffix_1": 1, "suffix_2": 2, "suffix_3": 3}


@dataclass(frozen=True)
class UrlModel:
    """Boosted trees (None without labels of both verdicts) and the share blocked by host suffix."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    share: float
    seen: int


def _features(urls: DataFrame, model: UrlModel) -> DataFrame:
    """``urls`` (with ``_url``, ``_host``, ``_path``) with the vector of its features."""
    parts = lexical_features(F.col("_url"), F.col("_host"), F.col("_path"))
    rows = urls.withColumns({f"_f_{n}": c for n, c in parts.items()})
    names = [f"_f_{n}" for n in parts]
    for name, labels in _SUFFIXES.items():
        own = model.suffixes.where(F.col("labels") == labels).select(
            F.col("suffix").alias("_suffix"), F.col("share").alias(f"_f_{name}"))
        # At most as many suffixes as the bounded sample has rows.
        rows = rows.withColumn("_suffix", _suffix(F.col("_host"), labels)).join(
            F.broadcast(own), "_suffix", "left").drop("_suffix").fillna(model.share, [f"_f_{name}"])
        names.append(f"_f_{name}")
    return VectorAssembler(inputCols=names, outputCol="_vector").transform(rows)


def fit_urls(labelled: DataFrame, per_class: int = PER_CLASS, seed: int = 42) -> UrlModel:
    """Trains on rows of ``url`` and ``verdict``: of each verdict those with the smallest seeded hash of
    the URL, ``per_class`` at most. Suffix shares come from the same sample. Without both verdicts the
    model gives the only one there is, and ``allow`` without any."""
    order = F.xxhash64(F.lit(seed), "_url")
    host, path = host_and_path(F.col("url"))
    rows = labelled.where(F.col("verdict").isin(ALLOW, BLOCK)).select(
        F.col("url").alias("_url"), host.alias("_host"), path.alias("_path"),
        (F.col("verdict") == BLOCK).cast("double").alias("label"))
    chosen = [rows.where(F.col("label") == k).orderBy(order, "_url").limit(per_class) for k in (0, 1)]
    sample = checkpointed(chosen[0].unionByName(chosen[1]).repartition(4, "_url"))
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    seen = sum(counts.values())
    share = counts.get(1.0, 0) / seen if seen else 0.0
    if len(counts) < 2:
        return UrlModel(None, None, share, seen)
    suffixes = sample.select("label", F.explode(F.array(*[
        F.struct(F.lit(n).alias("labels"), _suffix(F.col("_host"), n).alias("suffix"))
        for n in _SUFFIXES.values()])).alias("s")).groupBy("s.labels", "s.suffix").agg(
        ((F.sum("label") + PRIOR_ROWS * share) / (F.count("*") + PRIOR_ROWS)).alias("share"))
    model = UrlModel(None, checkpointed(suffixes), share, seen)
    train = checkpointed(_features(sample, model).select("label", "_vector", F.when(
        F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)).alias("weight")))
    trees = GBTClassifier(featuresCol="_vector", labelCol="label", weightCol="weight", maxIter=TREES,
                          maxDepth=DEPTH, stepSize=RATE, seed=seed, cacheNodeIds=False).fit(train)
    return UrlModel(trees, model.suffixes, share, seen)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
               model: UrlModel | None = None, url_column: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (replacing columns of
    these names).

    The longest rule that fits decides; the rest is decided by the trees. Without a ``model`` they are
    trained on the URLs of ``pages`` that a rule decides, labelled by it. The score is null where a
    rule decides. Null URLs have empty host and path and are scored as empty texts. Nothing is
    shuffled but the bounded sample; the suffix shares are broadcast.
    """
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    own = {c: f"_page_{c}" for c in pages.columns}
    rows = pages.select(*[F.col(c).alias(n) for c, n in own.items()]).withColumns(
        {"_url": F.col(own[url_column])})
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumns({"_host": host, "_path": path}).withColumns(
        {"_rule": rule, "_verdict": verdict})
    if model is None:
        model = fit_urls(rows.where(F.col("_verdict").isNotNull()).select(
            F.col("_url").alias("url"), F.col("_verdict").alias("verdict")))
    score = F.lit(model.share)
    if model.trees is not None:
        rows = model.trees.transform(_features(rows, model))
        score = vector_to_array(F.col("probability"))[1]
    judged = F.coalesce("_verdict", F.when(score >= 0.5, BLOCK).otherwise(ALLOW))
    new = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule"), "verdict": judged,
           "block_score": F.when(F.col("_rule").isNull(), score)}
    return rows.select(*[F.col(n).alias(c) for c, n in own.items() if c not in new],
                       *[c.alias(n) for n, c in new.items()])
