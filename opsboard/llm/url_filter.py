"""URL filter: gradient-boosted trees on lexical features, with allow and block rules before them.

All of it is DataFrame functions and Spark ML: features are column expressions, rules are one CASE, the
trees are fitted and applied in the JVM. The trees are fitted on at most `sample_rows` distinct labelled URLs
(those with the smallest hash), weighted by how often they occur, so training does not grow with the input and
no URL fills the sample. Every suffix of the sample has its own block rate, in a table no longer than the
sample, which is broadcast; others have the overall rate. Judging is one narrow pass.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule and is judged
by its features; an empty URL likewise; repeated rows are judged each; without labelled URLs of both kinds
the trees are not fitted and the verdict is that of the only kind seen, else allow; extra columns are
ignored by `judge`'s caller and kept by `judge` itself, unless they bear the name of an output column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard.sources.dictionaries import small_table

SAMPLE_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`text` is a host, then a path that begins with `/`."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text of the longest fitting rule, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))

    def fits(rule: Rule) -> Column:
        return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)

    return F.coalesce(*(F.when(fits(r), F.lit(r.text)) for r in ordered), F.lit(None).cast("string"))


def rule_verdict(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return reduce(lambda done, r: F.when(rule == r.text, F.lit(r.verdict)).otherwise(done), rules, F.lit(None).cast("string"))


def _share(count: Column, of: Column) -> Column:
    return count.cast("double") / F.greatest(of, F.lit(1))


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(F.concat(F.lit("."), host), r"\."), -1)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL's characters, named."""
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    left = lambda pattern: n - F.length(F.regexp_replace(url, pattern, ""))  # noqa: E731  how many characters fit the pattern
    once = F.array_distinct(F.split(url, ""))
    logs = F.aggregate(
        once,
        F.lit(0.0),
        lambda total, c: total + F.when(c == "", 0.0).otherwise(_n_log_n(n - F.length(F.replace(url, c, F.lit(""))))),
    )
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        "labels": (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))).cast("double"),
        "digit_ratio": _share(left("[0-9]"), n),
        "upper_ratio": _share(left("[A-Z]"), n),
        "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "escapes": (n - F.length(F.replace(url, F.lit("%"), F.lit("")))).cast("double"),
        "entropy": F.when(n > 0, F.log(n.cast("double")) - logs / n).otherwise(0.0),
        "parameters": F.when(query == "", 0.0).otherwise(
            (F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).cast("double")
        ),
        "longest_segment": F.coalesce(F.array_max(F.transform(F.split(path, "/"), F.length)), F.lit(0)).cast("double"),
        "secure": url.startswith("https").cast("double"),
        "fragment": url.contains("#").cast("double"),
    }


def _n_log_n(count: Column) -> Column:
    return count * F.log(F.greatest(count, F.lit(1)).cast("double"))


@dataclass(frozen=True)
class Model:
    """Trees (None: only one kind of label was seen), block rates of suffixes, and the rate of all."""

    trees: GBTClassificationModel | None
    suffixes: tuple[tuple[str, float], ...]
    rate: float

    def features(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """`row` (the columns of a frame with url, host and path) next to its features, and their names."""
        made = lexical(F.col("url"), F.col("host"), F.col("path"))
        suffix = suffix_of(F.col("host"))
        packed = df.select(
            F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(v.alias(k) for k, v in made.items()), suffix.alias("suffix")
        )
        rates = small_table(df.sparkSession, list(self.suffixes), _RATES)
        joined = packed.join(F.broadcast(rates), "suffix", "left")  # at most as many rows as the sample
        length, rate = F.length("suffix").cast("double"), F.coalesce("suffix_rate", F.lit(self.rate))
        return joined.withColumns({"suffix_length": length, "suffix_rate": rate}).drop("suffix"), [*made, "suffix_length", "suffix_rate"]

    def block_score(self, df: DataFrame) -> DataFrame:
        """Adds `block_score`, the probability of block, to a frame with url, host and path."""
        if self.trees is None:
            return df.withColumn("block_score", F.lit(self.rate))
        featured, names = self.features(df)
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(featured)
        judged = self.trees.transform(vectors)
        return judged.select("row.*", vector_to_array("probability")[1].alias("block_score"))


_RATES = T.StructType([T.StructField("suffix", T.StringType()), T.StructField("suffix_rate", T.DoubleType())])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a frame of url and block (0 or 1): at most `sample_rows` distinct rows of it, chosen by hash."""
    sample = (
        labelled.filter(F.col("url").isNotNull() & F.col("block").isNotNull())
        .groupBy("url", F.col("block").cast("double").alias("block"))
        .agg(F.count("*").cast("double").alias("times"))
        .orderBy(F.xxhash64("url"), "url", "block")
        .limit(sample_rows)
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .cache()  # at most sample_rows short rows
    )
    try:
        blocked_times = F.sum(F.col("block") * F.col("times"))
        n, blocked = sample.agg(F.coalesce(F.sum("times"), F.lit(0.0)), F.coalesce(blocked_times, F.lit(0.0))).first()
        rate = (blocked + 1) / (n + 2) if n else 0.0
        suffixes = sample.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.sum("times").alias("n"), blocked_times.alias("blocked"))
        rates = tuple((r["suffix"], (r["blocked"] + rate) / (r["n"] + 1)) for r in suffixes.orderBy("suffix").collect())
        if blocked in (0, n):
            return Model(None, rates, float(blocked > 0))
        featured, names = Model(None, rates, rate).features(sample)
        rows = featured.coalesce(1).select("row.block", "row.times", *names)
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("block", "times", "features")
        trees = GBTClassifier(labelCol="block", weightCol="times", maxIter=12, maxDepth=4, stepSize=0.3, seed=7, minInstancesPerNode=5)
        return Model(trees.fit(vectors), rates, rate)
    finally:
        sample.unpersist()


def judge(pages: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`pages` with host, path, rule, block_score and verdict for its url."""
    added = ("host", "path", "rule", "block_score", "verdict")
    kept = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c.lower() not in added))
    parts = kept.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parts.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return model.block_score(ruled).withColumn("verdict", F.coalesce(rule_verdict(F.col("rule"), rules), by_method))


def labelled_by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """url and block of the pages that a rule decides: the labels at hand for URLs."""
    url = F.col("url")
    verdict = rule_verdict(longest_rule(host_of(url), path_of(url), rules), rules)
    return pages.select("url", (verdict == "block").cast("int").alias("block")).filter(F.col("block").isNotNull())
