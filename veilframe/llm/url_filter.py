"""URL filtering by mined association rules, on built-in Spark functions and Spark's FP-growth alone.

A short list of given rules (host and path prefix) decides first.  For the urls it leaves open, FP-growth
mines combinations of url tokens from labelled urls; rules below the support or confidence asked for go,
and so do those that a part of their own combination already decides as surely.  The kept rules form an
inverted index: each hangs under its rarest token, a url looks up its tokens, and a rule matches when
all its tokens are there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import ascii_lower, bounded_broadcast, written

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.8
ALLOW, BLOCK = "allow", "block"
_LABEL = "label="


@dataclass(frozen=True)
class UrlRule:
    """``where`` is a host and a path prefix in one, like ``example.org/en/``."""

    verdict: str
    where: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.where.partition("/")[2] if "/" in self.where else ""


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for a null url or one without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(host: Column, path: Column, rules: list[UrlRule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.where)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: scheme, host and its parent domains, path words with their depth,
    file ending, names of query fields.  Runs of digits become one sign, so ids do not make tokens."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
                          lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda w: w != "")
    steps = F.transform(words, lambda w, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), w))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fields = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""),
                         lambda q: F.concat(F.lit("field="), F.substring_index(q, "=", 1)))
    rest = F.array(F.concat(F.lit("scheme="), F.substring_index(url, "://", 1)),
                   F.concat(F.lit("ending="), F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))
    return F.array_distinct(F.when(host == "", F.array().cast("array<string>"))
                            .otherwise(F.concat(parents, steps, fields, rest)))


def token_classes(baskets: DataFrame, least: int) -> DataFrame:
    """(token, rep, members) for the tokens in at least ``least`` of ``baskets`` (tokens): tokens that occur in exactly the
    same rows are one class, called by its first member.

    A row counts by two hashes of its tokens, and exact sums of these tell the sets of rows apart.  Members of a class
    stand in one row together, so a class is no longer than a row.
    """
    hashed = [F.xxhash64("tokens", F.lit(seed)).cast("decimal(20,0)").alias(f"h{seed}") for seed in (1, 2)]
    each = baskets.select(F.explode(F.array_distinct("tokens")).alias("token"), *hashed)
    rows = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h1").alias("s1"), F.sum("h2").alias("s2")).where(F.col("n") >= least)
    groups = rows.groupBy("n", "s1", "s2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return groups.select(F.explode("members").alias("token"), F.col("members")[0].alias("rep"), "members")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, classes, verdict, confidence, support, anchor) from ``labelled`` (tokens array, label string).

    Tokens that always occur together are mined as one, since k of them have 2^k frequent sets that all say the same.  ``tokens``
    holds one of each class that a rule needs and ``classes`` all members: a url fits if it has one member of each
    class, as it would fit one of the rules that single members make.  ``anchor`` is the rule's rarest class.  Rows without
    tokens or label teach nothing.  Support and confidence bound what is kept; no rule is cut off by a count.
    """
    spark = labelled.sparkSession
    taught = written(labelled.where("label is not null and size(tokens) > 0").select(
        F.monotonically_increasing_id().alias("row"), "tokens", "label"), "url-baskets")
    n = taught.count()
    none = spark.createDataFrame(
        [], "tokens array<string>, classes array<array<string>>, verdict string, confidence double, support double, anchor string")
    if not n:
        return none
    classes = written(token_classes(taught, max(1, math.ceil(min_support * n))), "url-classes")
    names = classes.select("token", "rep")
    baskets = taught.select("row", "label", F.explode("tokens").alias("token")).join(bounded_broadcast(names), "token").groupBy("row").agg(
        F.collect_set("rep").alias("reps"), F.first("label").alias("label"))
    # Rows without a frequent token count towards the support all the same.
    baskets = taught.select("row", "label").join(baskets.select("row", "reps"), "row", "left").select(
        F.concat(F.coalesce("reps", F.array().cast("array<string>")), F.array(F.concat(F.lit(_LABEL), "label"))).alias("items"))
    model = FPGrowth(minSupport=min_support, minConfidence=min_confidence).fit(written(baskets, "url-items"))
    mined = written(
        model.associationRules.where(F.col("consequent")[0].startswith(_LABEL))
        .select(F.col("antecedent").alias("tokens"), F.expr(f"substring(consequent[0], {len(_LABEL) + 1})").alias("verdict"),
                "confidence", "support"), "url-mined")
    single = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    members = classes.where("token = rep").select("token", "members")
    anchors = (
        mined.select("tokens", F.explode("tokens").alias("token")).join(single, "token").join(members, "token")
        .groupBy("tokens").agg(F.min(F.struct("freq", "token")).alias("a"), F.collect_list("members").alias("classes"))
        .select("tokens", "classes", F.col("a.token").alias("anchor")))
    mined = written(mined.join(anchors, "tokens"), "url-anchored")
    # A rule says nothing new if a part of it leads to the same verdict as surely.
    wide = mined.select("tokens", "verdict", "confidence", F.explode("tokens").alias("anchor"))
    less = mined.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("sure"), "anchor")
    idle = wide.join(less, ["anchor", "verdict"]).where(
        (F.size("part") < F.size("tokens")) & (F.col("sure") >= F.col("confidence"))
        & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens", "verdict").distinct()
    return written(mined.join(idle, ["tokens", "verdict"], "left_anti").select(*none.columns), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, verdict) for the rows of ``urls`` (row, tokens) that a rule matches: the surest rule wins,
    then the better supported, then the longer, then block before allow."""
    # A rule stands in the index under every member of its rarest class.
    listed = rules.withColumn("needed", F.transform("classes", lambda c: F.array_sort(c)))
    anchors = F.flatten(F.filter("needed", lambda c: F.array_contains(c, F.col("anchor"))))
    index = bounded_broadcast(listed.select(F.explode(anchors).alias("anchor"), "needed", "verdict", "confidence", "support"))
    rank = F.struct("confidence", "support", F.size("needed"), "verdict")
    return (
        urls.select("row", "tokens", F.explode("tokens").alias("anchor")).join(index, "anchor")
        .where(F.forall("needed", lambda c: F.arrays_overlap(c, F.col("tokens"))))
        .groupBy("row").agg(F.max(rank).alias("best")).select("row", F.col("best.verdict").alias("verdict")))


def filter_urls(pages: DataFrame, rules: list[UrlRule], labels: DataFrame | None = None, id_col: str = "page_id",
                url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
                default: str = ALLOW) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule (null if none fits), verdict.

    ``labels`` (url, label) are what FP-growth learns from; without them it learns from the urls that the
    given rules decide.  A url that neither a given nor a mined rule decides gets ``default``, as do null
    urls and those without ``://``, whose host and path are empty.  Ids may repeat or be null: every
    row is judged by itself.  Columns other than the two named are not read.  Urls are read whole, however long.
    """
    url = F.col("url")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                        F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = rows.select("row", "id", "url", url_host(url).alias("host"), url_path(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    rows = written(rows.select(
        "row", "id", "host", "path", url_tokens(url, host, path).alias("tokens"),
        rule_match(host, path, rules, lambda r: r.where).alias("rule"),
        rule_match(host, path, rules, lambda r: r.verdict).alias("given")), "url-rows")
    if labels is None:
        learn = rows.select("tokens", F.col("given").alias("label"))
    else:
        named = labels.select(F.col("url"), F.col("label").cast("string").alias("label"))
        learn = named.select(url_tokens(url, url_host(url), url_path(url)).alias("tokens"), "label")
    mined = mine_rules(learn, min_support, min_confidence)
    found = matched(rows.where("rule is null").select("row", "tokens"), mined)
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("given", "verdict", F.lit(default)).alias("verdict"))
