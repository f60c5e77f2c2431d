"""URL filtering: host and path rules, then gradient-boosted trees on lexical features.

DataFrame functions only. The trees are fitted on a bounded sample of labelled
URLs and then written out as column expressions, so scoring is one projection
and one join with the suffix statistics.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import checkpointed, lower_ascii

MAX_ROWS = 20_000
TREES = 12
DEPTH = 3
#: Weight of the overall block rate in a suffix's rate, in URLs.
PRIOR = 20.0

# Words in host names that mark a URL as one to block, for labels where none are given.
BLOCK_WORDS = "ad ads adult advert adserver banner bet bets betting casino cialis doubleclick escort gambling jackpot malware payday phish pills poker porn sex slots spam spyware track tracker tracking viagra warez xxx".split()


class Rule(NamedTuple):
    """``host`` and its subdomains, where the path starts with ``path`` ("" for any)."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + (self.path or "/")


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def first_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits (ties: block before allow), else null."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict == "allow", r.name))
    out = None
    for r in order:
        own = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        fits = own & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return none if out is None else out


def blocked_by_words(host: Column, words: list[str] = BLOCK_WORDS) -> Column:
    """1 where a part of the host between dots, dashes and underscores is one of ``words``."""
    return F.arrays_overlap(F.split(host, r"[._-]"), F.array(*[F.lit(w) for w in words])).cast("int")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(urls: DataFrame) -> tuple[DataFrame, list[str]]:
    """``urls`` (key, url, host, path) with one double column per lexical feature, and their names."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    long = lambda c: F.greatest(F.length(c), F.lit(1)).cast("double")
    features = {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": _count(path, "/"),
        "f_labels": _count(host, r"\."),
        "f_dashes": _count(host, "-"),
        "f_digits": _count(url, "[0-9]") / long(url),
        "f_host_digits": _count(host, "[0-9]") / long(host),
        "f_params": F.when(query == "", F.lit(0.0)).otherwise(_count(query, "&") + 1),
        "f_entropy": _entropy(host),
        "f_secure": F.startswith(url, F.lit("https")).cast("double"),
    }
    return urls.withColumns(features), list(features)


def suffixes(host: Column) -> dict[str, Column]:
    """The last two and three labels of a host."""
    return {"s2": F.substring_index(host, ".", -2), "s3": F.substring_index(host, ".", -3)}


class Model(NamedTuple):
    features: list[str]
    trees: list[tuple[float, object]]
    rates: DataFrame
    rate: float

    def probability(self) -> Column:
        """Chance of label 1 from the feature columns."""
        margin = F.lit(0.0)
        for weight, root in self.trees:
            margin = margin + F.lit(weight) * _expression(root, self.features)
        return 1 / (1 + F.exp(-2 * margin))


def _read_tree(node) -> object:
    """A fitted tree as nested tuples (feature, threshold, left, right), a leaf as its value."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _read_tree(node.leftChild()), _read_tree(node.rightChild())


def _expression(node: object, features: list[str]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    k, threshold, left, right = node
    return F.when(F.col(features[k]) <= threshold, _expression(left, features)).otherwise(_expression(right, features))


def _with_rates(urls: DataFrame, rates: DataFrame, rate: float) -> DataFrame:
    """Adds the suffix statistics; a suffix not seen in training has the overall rate.

    One row a suffix on the right; a frequent suffix on the left is split by AQE.
    """
    for s, column in suffixes(F.col("host")).items():
        own = rates.where(F.col("level") == s).select(F.col("suffix").alias(f"__{s}"), F.col("block_rate").alias(f"f_{s}"))
        urls = urls.withColumn(s, column)
        urls = urls.join(own, F.col(s) == F.col(f"__{s}"), "left").drop(s, f"__{s}").withColumn(f"f_{s}", F.coalesce(f"f_{s}", F.lit(rate)))
    return urls


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Fit on ``labelled`` (url, host, path, label 0/1; null labels are left out).

    Suffix statistics come from one half of the URLs (by hash), over all of
    them; the trees from at most ``max_rows`` of the other half, so that a
    suffix's own rows don't give its label away. One class alone, or no rows:
    no trees, and the class's constant answer.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.where("label is not null and url is not null").select("url", "host", "path", F.col("label").cast("double").alias("label"))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("url"), F.lit(2)))
    first = rows.where("half = 0")
    stack = F.explode(F.array(*[F.struct(F.lit(s).alias("level"), c.alias("suffix")) for s, c in suffixes(F.col("host")).items()])).alias("k")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    rate = ones / n if n else 0.0
    rates = first.select(stack, "label").groupBy("k.level", "k.suffix").agg(((F.sum("label") + PRIOR * rate) / (F.count("*") + PRIOR)).alias("block_rate"))
    rates = checkpointed(rates)
    base, names = lexical(rows.where("half = 1").orderBy(F.xxhash64("url", F.lit(7)), "url").limit(max_rows))
    names = [*names, "f_s2", "f_s3"]
    if not 0 < ones < n:
        return Model(names, [(1.0, 20.0 if ones else -20.0)], rates, rate)
    sample = checkpointed(_with_rates(base, rates, rate).select(*names, "label"))
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        return Model(names, [(1.0, math.log(rate / (1 - rate)) / 2)], rates, rate)
    ready = VectorAssembler(inputCols=names, outputCol="x").transform(sample).select("x", "label")
    fitted = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(ready)
    return Model(names, [(w, _read_tree(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)], rates, rate)


def judge(pages: DataFrame, rules: list[Rule], model: Model | None = None, labels: Column | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score (of block).

    ``verdict`` is the longest fitting rule's, else ``block`` where the trees'
    score is ``threshold`` or more. Without a model one is fitted on these
    URLs with ``labels`` (a column of host and path; default: words in the
    host). Null URLs, and URLs without ://, have empty host and path, no rule,
    score 0 and verdict allow. Other columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if model is None:
        model = fit(urls.where("host != ''").withColumn("label", blocked_by_words(F.col("host")) if labels is None else labels))
    scored, _ = lexical(urls)
    scored = _with_rates(scored, model.rates, model.rate)
    score = F.when(F.col("host") == "", F.lit(0.0)).otherwise(model.probability())
    scored = scored.select("key", "host", "path", first_rule(F.col("host"), F.col("path"), rules).alias("r"), score.alias("score"))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(F.col("key").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "score")
