"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features for what no rule fits.

The rules' own verdicts are the labels. Trees (pyspark.ml) learn from at most LABELLED labelled URLs, those with the smallest hash. The
suffix statistics, which are the share of blocked URLs for the last label, the last two labels and the first path segment, count all
labelled URLs, and are kept for SUFFIXES hash buckets each, so that the tables joined to every row have a fixed bound and can be broadcast.
What the trees learn from has out-of-fold statistics: hosts are dealt out to FOLDS folds, and a URL's shares are counted without its fold,
so that trees see how much a suffix says of hosts they don't know. Trees draw rows and features, and so differ.

Nulls and edges: a null url, or one without ://, has an empty host and path, no rule, and is judged by the trees. Without labels of
both kinds the trees' verdict is the only kind there is, or allow. Repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import saved

#: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LABELLED = 20_000
SUFFIXES = 4096
TREES, DEPTH, SHARE = 16, 4, 0.7
FOLDS = 5
LEXICAL = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "sign_ratio", "entropy", "parameters", "has_fragment", "longest_segment", "hyphens")
STATISTICS = ("last_label", "last_labels", "first_segment")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where there is no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    best_rule, best_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best_rule, best_verdict = F.when(fits, rule_host + rule_path).otherwise(best_rule), F.when(fits, verdict).otherwise(best_verdict)
    return best_rule, best_verdict


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """page_id, host, path, rule, given (the rule's verdict), the lexical features, and the bucket of each suffix."""
    host, path = split_url(F.col(url))
    rows = pages.select("page_id", F.coalesce(F.col(url), F.lit("")).alias("u"), host.alias("host"), path.alias("path"))
    rule, given = matched_rule(F.col("host"), F.col("path"))
    u, n = F.col("u"), F.greatest(F.length("u"), F.lit(1))
    # Shannon entropy of the characters, in bits
    share = F.transform(F.array_distinct(F.split("u", "")), lambda c: (F.length("u") - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    count = lambda pattern: F.length(u) - F.length(F.regexp_replace(u, pattern, ""))
    labels, segments = F.split("host", r"\."), F.split(F.regexp_replace("path", "^/", ""), "/")
    bucket = lambda x, seed: F.pmod(F.xxhash64(F.lit(seed), x), F.lit(SUFFIXES)).cast("int")
    values = {
        "length": F.length(u), "host_length": F.length("host"), "path_length": F.length("path"), "labels": F.size(labels), "depth": F.size(segments), "digit_ratio": count("[0-9]") / n, "sign_ratio": count("[^A-Za-z0-9]") / n,
        "entropy": F.when(F.length(u) > 0, entropy).otherwise(0.0), "parameters": count("[?&]"), "has_fragment": F.instr(u, "#") > 0, "longest_segment": F.array_max(F.transform(segments, F.length)), "hyphens": count("-"),
    }
    return rows.select(
        "page_id", "u", "host", "path", rule.alias("rule"), given.alias("given"), *(v.cast("double").alias(k) for k, v in values.items()),
        bucket(F.element_at(labels, -1), 1).alias("last_label"), bucket(F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), "."), 2).alias("last_labels"), bucket(F.get(segments, F.lit(0)), 3).alias("first_segment"),
    )


INPUTS = [*LEXICAL, *(f"p_{n}" for n in STATISTICS)]


def _fold(host: str = "host") -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), host), F.lit(FOLDS)).cast("int")


def suffix_counts(known: DataFrame) -> DataFrame:
    """name, bucket, fold, blocked, n of labelled rows: at most a row for each statistic, bucket and fold."""
    each = known.select(_fold().alias("fold"), "given", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bucket")) for n in STATISTICS])).alias("s"))
    return each.groupBy("s.name", "s.bucket", "fold").agg(F.count_if(F.col("given") == "block").alias("blocked"), F.count("*").alias("n"))


def with_statistics(rows: DataFrame, counts: DataFrame, out_of_fold: bool) -> DataFrame:
    """rows with the share of blocked URLs for each suffix, smoothed by one URL of each kind; out_of_fold: without those of the row's fold."""
    total = counts.groupBy("name", "bucket").agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
    for name in STATISTICS:
        share = total.where(F.col("name") == name).select(F.col("bucket").alias(name), "all_blocked", "all_n")
        rows = rows.join(F.broadcast(share), name, "left")
        blocked, n = F.coalesce("all_blocked", F.lit(0)), F.coalesce("all_n", F.lit(0))
        if out_of_fold:
            own = counts.where(F.col("name") == name).select(F.col("bucket").alias(name), F.col("fold").alias("fold "), F.col("blocked").alias("own_blocked"), F.col("n").alias("own_n"))
            rows = rows.withColumn("fold ", _fold()).join(F.broadcast(own), [name, "fold "], "left")
            blocked, n = blocked - F.coalesce("own_blocked", F.lit(0)), n - F.coalesce("own_n", F.lit(0))
        rows = rows.withColumn(f"p_{name}", (blocked + 1) / (n + 2)).drop("all_blocked", "all_n", "own_blocked", "own_n", "fold ")
    return rows


def with_p_block(rows: DataFrame, known: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """rows with p_block, the probability that trees learned from known give."""
    counts = saved(suffix_counts(known), "suffixes")
    # fully determined by the rows, whatever their order: equal URLs have equal features
    sample = known.orderBy(F.xxhash64("u"), "u").limit(labelled)
    sample = saved(with_statistics(sample, counts, out_of_fold=True).select(*INPUTS, (F.col("given") == "block").cast("double").alias("label")), "labelled")
    kinds = [r[0] for r in sample.select("label").distinct().collect()]
    result = with_statistics(rows, counts, out_of_fold=False)
    if len(kinds) < 2:
        return result.withColumn("p_block", F.lit(float(kinds[0]) if kinds else 0.0))
    assembler = VectorAssembler(inputCols=INPUTS, outputCol="features ")
    model = GBTClassifier(featuresCol="features ", labelCol="label", maxIter=TREES, maxDepth=DEPTH, subsamplingRate=SHARE, featureSubsetStrategy="onethird", seed=11).fit(assembler.transform(sample.orderBy(*INPUTS, "label").repartition(1)))
    model = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("probability ")
    return model.transform(assembler.transform(result)).withColumn("p_block", vector_to_array("probability ")[1])


def judge(pages: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row of pages."""
    rows = with_features(pages)
    result = with_p_block(rows, rows.where(F.col("given").isNotNull()), labelled)
    verdict = F.coalesce("given", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return result.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("p_block", 6).alias("p_block"))


def held_out(pages: DataFrame, fold: int = 0, labelled: int = LABELLED) -> DataFrame:
    """page_id, given, p_block of the labelled URLs of one fold of hosts, by trees and statistics that know none of its hosts."""
    rows = with_features(pages).where(F.col("given").isNotNull())
    return with_p_block(rows.where(_fold() == fold), rows.where(_fold() != fold), labelled).select("page_id", "given", F.round("p_block", 6).alias("p_block"))
