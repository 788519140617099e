"""URL filter: rules by host and path first, gradient-boosted trees on lexical features for the rest.

Everything is column expressions and the tree learner of Spark's ML library; no Python runs on
the executors. URLs that a rule settles are the labelled examples for the trees.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark.plans.scale import attach, stored

FEATURES = [
    "length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "host_hyphens", "entropy", "parameters",
    "has_fragment", "secure", "page_file", "longest_label", "vowels", "host_entropy", "suffix_block_rate", "suffix_share", "section_length",
]
PRIOR = 20.0


def lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """Lower-case host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    domain, _, rest = rule.partition("/")
    return ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)


def settle(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        hit = fits(name, host, path)
        rule = F.when(hit, F.lit(name)).otherwise(rule)
        verdict = F.when(hit, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _share(c: Column, kind: str) -> Column:
    """Share of characters of a class, given as a regular expression."""
    return F.length(F.regexp_replace(c, f"[^{kind}]", "")) / F.greatest(F.length(c), F.lit(1))


def _entropy(c: Column) -> Column:
    """Bits per character of the letters, digits and marks in use, counted without exploding the text."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    total: Column = F.lit(0.0)
    for sign in string.ascii_lowercase + string.digits + "./-_?=&#:%":
        p = (F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))) / n
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def described(urls: DataFrame) -> DataFrame:
    """Lexical features of ``u`` (text, never null), ``host`` and ``path``; the suffix is the last label of the host."""
    u, host, path = F.col("u"), F.col("host"), F.col("path")
    rest = F.regexp_extract(u, r"(?s)^[^?#]*([?][^#]*)?", 1)
    labels = F.split(host, r"\.")
    number = lambda c: c.cast("double")
    return urls.withColumns(
        {
            "suffix": F.element_at(labels, -1),
            "length": number(F.length(u)),
            "host_length": number(F.length(host)),
            "path_length": number(F.length(path)),
            "depth": number(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))),
            "labels": number(F.size(labels)),
            "digits": _share(u, "0-9"),
            "host_digits": _share(host, "0-9"),
            "hyphens": _share(u, "_-"),
            "host_hyphens": number(F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))),
            "entropy": _entropy(lower(u)),
            "parameters": F.when(F.length(rest) > 1, F.size(F.split(rest, "&"))).otherwise(0).cast("double"),
            "has_fragment": number(F.instr(u, "#") > 0),
            "secure": number(u.startswith("https")),
            "page_file": number(path.rlike(r"\.[A-Za-z0-9]{1,5}$")),
            "longest_label": number(F.array_max(F.transform(labels, F.length))),
            "vowels": _share(host, "aeiou"),
            "host_entropy": _entropy(host),
            "section_length": number(F.length(F.regexp_extract(path, r"^/([^/]*)", 1))),
        }
    )


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]], sample_rows: int = 20_000, trees: int = 20, depth: int = 4, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``block_score``.

    ``rules`` are pairs of verdict and host/path. The trees are fitted on at most
    ``sample_rows`` different URLs with a rule (smallest hash); if those are all of one verdict, that is the verdict of every
    other URL, and with none at all it is allow. A null URL, or one without ``://``, has empty host and path and is
    judged by its text like any other. ``block_score`` is the probability to block, 1 or 0 where a rule decides.
    """
    address = F.col("url")
    split = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).select(
        "page_id", F.coalesce(address, F.lit("")).alias("u"), host_of(address).alias("host"), path_of(address).alias("path")
    )
    rule, verdict = settle(rules, F.col("host"), F.col("path"))
    rows = stored(described(split.withColumns({"rule": rule, "given": verdict})))
    blocked = (F.col("given") == "block").cast("double")
    total = rows.agg(F.count(F.lit(1)), F.sum(blocked), F.count("given")).first()
    n, blocks, given = total[0], total[1] or 0.0, total[2]
    share = (blocks + 1) / (given + 2)
    suffixes = rows.groupBy("suffix").agg(
        ((F.coalesce(F.sum(blocked), F.lit(0.0)) + PRIOR * share) / (F.count("given") + PRIOR)).alias("suffix_block_rate"),
        (F.count(F.lit(1)) / F.lit(max(n, 1))).alias("suffix_share"),
    )
    full = attach(rows, suffixes, ["suffix"], "left")
    if blocks in (0.0, float(given)):
        score = F.lit(1.0 if given and blocks else 0.0)
    else:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        known = full.filter("given is not null").select("u", blocked.alias("label"), *FEATURES).dropDuplicates(["u"])
        sample = stored(known.withColumn("draw", F.xxhash64("u")).orderBy("draw", "u").limit(sample_rows))
        both = sample.select("label").distinct().count() == 2
        if both:
            learner = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=1, cacheNodeIds=False)
            model = learner.fit(assemble.transform(sample))
            full = model.transform(assemble.transform(full))
            score = vector_to_array("probability")[1]
        else:
            score = F.lit(float(sample.first()["label"]))
    final = F.when(F.col("given").isNotNull(), blocked).otherwise(score)
    judged = full.select("page_id", "host", "path", "rule", "given", final.alias("block_score"))
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_score"
    )
