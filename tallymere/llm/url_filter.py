"""URL filter: rules for hosts and paths, and gradient-boosted trees on lexical features for the rest.

The longest rule that fits an url decides; where none fits, boosted trees
trained on the urls that a rule labels do; urls without a rule teach nothing.
Features: lengths, depth, digit ratio, character
entropy, counts of parameters, labels and hyphens, and for the last two labels
of the host how many labelled urls have them and the smoothed share of those
that is blocked.  In training that share leaves out the urls of the row's own
fold of hosts, so no label tells on itself.

Everything is DataFrame expressions and MLlib.  Training takes at most about
``sample_rows`` labelled rows, chosen by a hash of the url.  The statistics of
suffixes are broadcast while their counted rows are few.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is judged on its features (all zero for null); with no
labelled url, or labels of one class, nothing can be learnt and all others are
allowed; repeated rows get equal verdicts.  Input columns are kept inside the struct
``row``.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import let
from ..plans.graph import sized
from ..plans.scratch import Scratch
from .sampling import distinct_sample

FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "suffix_count", "suffix_blocked"]
SMOOTHING = 5.0
#: Folds of hosts, for the shares of blocked urls that training sees.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    action: str  #: allow or block
    target: str  #: host/path, such as example.net/en/

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, path = self.target.partition("/")
        return host, slash + path


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The target of the longest rule that fits, else null. Rules are settings: a short list in the plan."""
    targets = []
    for rule in sorted(rules, key=lambda r: (-len(r.target), r.target)):
        own, start = rule.parts
        targets.append(F.when(((host == own) | host.endswith(f".{own}")) & path.startswith(start), F.lit(rule.target)))
    return F.coalesce(*targets, F.lit(None).cast("string"))


def _entropy(text: Column) -> Column:
    def of(x: Column) -> Column:
        size = F.length(x)
        shares = F.transform(F.array_distinct(F.split(x, "")), lambda c: (size - F.length(F.replace(x, c, F.lit("")))) / size)
        return F.when(size == 0, 0.0).otherwise(-F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda total, p: total + p * F.log2(p)))

    return let(text, of)


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and suffix to rows with columns url, host and path."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    count = lambda text, char: (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("double")
    return urls.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"),
        "digit_ratio": F.when(F.length(url) == 0, 0.0).otherwise(F.length(F.regexp_replace(url, "[^0-9]", "")) / F.length(url)),
        "entropy": _entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "host_labels": count(F.col("host"), ".") + 1,
        "hyphens": count(F.col("host"), "-"),
        "suffix": F.substring_index("host", ".", -2),
    })


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame | None  #: suffix, suffix_count, suffix_blocked
    prior: float  #: share of blocked labelled urls

    def blocked(self, urls: DataFrame) -> DataFrame:
        """Adds ``blocked`` (boolean) to rows with columns url, host and path."""
        if self.trees is None:
            return urls.withColumn("blocked", F.lit(False))
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self.met(with_features(urls), self.suffixes, ["suffix"]))
        return self.trees.transform(ready).select(*urls.columns, (F.col("prediction") > 0.5).alias("blocked"))

    def met(self, rows: DataFrame, statistics: DataFrame, by: list[str]) -> DataFrame:
        met = rows.join(sized(statistics), by, "left")
        return met.withColumns({"suffix_count": F.log1p(F.coalesce("suffix_count", F.lit(0))), "suffix_blocked": F.coalesce("suffix_blocked", F.lit(self.prior))})


def train(labelled: DataFrame, sample_rows: int = 20_000, rounds: int = 10, depth: int = 4, seed: int = 17) -> UrlModel:
    """Learn from rows with columns url, host, path and label (1: block): shares of suffixes from all, trees from about ``sample_rows`` different urls at most."""
    scratch = Scratch(labelled.sparkSession, "url-model")
    rows = with_features(labelled.select("url", "host", "path", F.col("label").cast("double").alias("label")).where("label is not null"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    folds = scratch.save(rows.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")), "folds")
    suffixes = scratch.save(folds.groupBy("suffix").agg(F.sum("n").alias("suffix_count"), F.sum("bad").alias("blocked")), "suffixes")
    n, blocked = suffixes.agg(F.coalesce(F.sum("suffix_count"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    prior = blocked / n if n else 0.0
    if prior in (0.0, 1.0):
        return UrlModel(None, None, prior)
    share = lambda bad, of: ((bad + SMOOTHING * prior) / (of + SMOOTHING)).alias("suffix_blocked")
    others = folds.join(suffixes, "suffix").select("suffix", "fold", "suffix_count", share(F.col("blocked") - F.col("bad"), F.col("suffix_count") - F.col("n")))
    suffixes = suffixes.select("suffix", "suffix_count", share(F.col("blocked"), F.col("suffix_count")))
    model = UrlModel(None, suffixes, prior)
    rows = distinct_sample(rows, "url", sample_rows, "label")
    sample = scratch.save(model.met(rows, others, ["suffix", "fold"]).select("label", *FEATURES), "sample")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    model.trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed).fit(ready)
    return model


def judge(urls: DataFrame, rules: Sequence[Rule], sample_rows: int = 20_000) -> DataFrame:
    """Columns row (struct of the input's columns), host, path, rule, verdict.

    The rules give the labels: what they block is learnt as bad, what they
    allow as good, and an url without a rule is only judged.  So where all
    labelled urls of a suffix have one label, its other urls mostly get it too.
    """
    actions = {r.target: r.action for r in rules}
    packed = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"), F.col("url"))
    placed = packed.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    placed = placed.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    action = F.coalesce(*[F.when(F.col("rule") == target, F.lit(a)) for target, a in actions.items()], F.lit(None).cast("string"))
    placed = placed.withColumn("action", action)
    label = (F.col("action") == "block").cast("double")
    model = train(placed.where("url is not null").withColumn("label", label), sample_rows)
    verdict = F.coalesce("action", F.when(F.col("blocked"), "block").otherwise("allow"))
    return model.blocked(placed).select("row", "host", "path", "rule", verdict.alias("verdict"))


RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")
