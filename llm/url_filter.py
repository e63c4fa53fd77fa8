"""URL filters with a path-template tree.

For each host the path's segments form a tree.  Digits in a segment become ``*``; then, level by
level from the top, segments below a node that have neither a significant share of its pages nor a significantly
other share of bad pages are one wildcard.  All nodes of the tree count their rated pages and bad pages.  Sibling branches of a
node whose rates of bad pages do not differ significantly (a two-sample z test on smoothed rates)
share one purity estimate, which is smoothed toward their parent's and that of the same node on other hosts, that
toward the host's, and that toward the share over all pages, so labels reach branches and hosts that have none.  A template is
rejected if its smoothed share of bad pages is above one half.

All of it is counted, so a host that holds a third of all pages is a few rows per task after the
partial aggregation.  Null urls and urls without ``://`` have an empty host and an empty path and form
one template of their own.  Repeated pages count each time; an empty table gives an empty result.  Very long paths end in one
segment with all that follows the first ones.  Other columns of the input pass through, also if their names are those used
inside; only ``template``, ``bad_share`` and ``rejected`` are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEPTH = 8
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: from
    there up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest of ``rules`` (``host/path``) that fits, or null.  It fits its host and all subdomains if
    the path starts with its path."""
    out = F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r.partition("/")[0]), len(r))):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The first DEPTH segments, the last of them with all that follows; runs of digits become ``*``."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "*"), "/", DEPTH)


def _interval(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Wilson's bounds of the share of ``k`` in ``n``; null without rows."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return tuple((p + z * z / (2 * n) + sign * half) / (1 + z * z / n) for sign in (-1, 1))


def templates(pages: DataFrame, min_share: float = 1 / 64) -> DataFrame:
    """``pages`` (columns host, path, n, rated, bad) with ``template``: the path with wildcards.  Below each node a segment stays
    if it surely (2 standard errors) has ``min_share`` of the node's pages, or if its share of bad pages surely (3) differs
    from that of the other segments; the rest are ``*``.  Neither depends on how many pages or segments there are."""
    df = materialize(pages.withColumn("_left", segments("path")).withColumn("template", F.lit("")))
    deepest = df.agg(F.max(F.size("_left"))).collect()[0][0] or 0
    for level in range(deepest):
        here = F.get("_left", F.lit(level))
        parts = df.where(here.isNotNull()).groupBy("host", "template", here.alias("_seg")).agg(*(F.sum(c).alias(c) for c in ("n", "rated", "bad")))
        whole = parts.groupBy("host", "template").agg(*(F.sum(c).alias(f"_{c}") for c in ("n", "rated", "bad")))
        low, high = _interval(F.col("bad"), F.col("rated"), 3.0)
        rest_low, rest_high = _interval(F.col("_bad") - F.col("bad"), F.col("_rated") - F.col("rated"), 3.0)
        kept = (_interval(F.col("n"), F.col("_n"), 2.0)[0] >= min_share) | F.coalesce((low > rest_high) | (high < rest_low), F.lit(False))
        literal = parts.join(whole, ["host", "template"]).where(kept).select("host", "template", "_seg", F.lit(True).alias("_literal"))
        df = df.withColumn("_seg", here).join(literal, ["host", "template", "_seg"], "left").withColumn(
            "template", F.when(here.isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("_literal"), here).otherwise("*")))
        ).drop("_seg", "_literal")
        df = materialize(df)  # a level leans on the ones above; cut off, its plan stays small
    return df.drop("_left")


def _nodes(counted: DataFrame) -> DataFrame:
    """``counted`` with a row for each node on the way from the host (depth 0, node ``""``) down to the template."""
    parts = F.split("template", "/", DEPTH + 1)
    nodes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, 1, d + 1), "/"))
    return counted.select("*", F.posexplode(nodes).alias("depth", "node"), F.when(F.col("depth") > 0, F.array_join(F.slice(parts, 1, F.col("depth")), "/")).alias("parent"))


def merged(rated: np.ndarray, bad: np.ndarray, prior: float, prior_weight: float, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Rated and bad pages of the branch that each sibling belongs to.  In order of their smoothed rates, neighbours merge
    while a two-sample z test does not tell them apart."""
    start = prior_weight * prior
    branches: list[list] = []  # rated, bad, members
    for i in np.lexsort((rated, (bad + start) / (rated + prior_weight))).tolist():
        branches.append([int(rated[i]), int(bad[i]), [i]])
        while len(branches) > 1:
            (r1, b1, m1), (r2, b2, m2) = branches[-2:]
            p = (b1 + b2 + start) / (r1 + r2 + prior_weight)
            apart = abs((b1 + start) / (r1 + prior_weight) - (b2 + start) / (r2 + prior_weight))
            if apart > z * math.sqrt(p * (1 - p) * (1 / r1 + 1 / r2)):
                break
            if len(m1) < len(m2):
                m1, m2 = m2, m1
            m1.extend(m2)
            branches[-2:] = [[r1 + r2, b1 + b2, m1]]
    out = np.zeros((2, len(rated)), np.int64)
    for r, b, members in branches:
        out[0, members], out[1, members] = r, b
    return out[0], out[1]


def purity(counted: DataFrame, prior_weight: float = 4.0, pool_weight: float = 2.0, z: float = 2.0) -> DataFrame:
    """``counted`` (host, template, rated, bad) with ``bad_share``: the smoothed share of bad pages.

    All nodes on the way from the host to a template count the pages below them, and siblings merge to branches
    (``merged``).  Down that way, the share over all pages is smoothed by the pages of the host, then of the first
    segment's branch, and so on, each without those of the next one, so that no page counts twice.  At each node what the
    other hosts have under the same node counts, too, as ``pool_weight`` pages at most.  Unrated templates thus take the share
    of the lowest rated branch above them, and hosts without labels that of their templates elsewhere.
    """
    overall = counted.agg(((F.sum("bad") + 1) / (F.sum("rated") + 10)).alias("_prior"))
    # cut off: read for the branches, for the pools and again for the shares
    nodes = materialize(_nodes(counted).groupBy("host", "depth", "node", "parent").agg(F.sum("rated").alias("rated"), F.sum("bad").alias("bad")).where("rated > 0"))
    # siblings with equal counts never differ, so a row for each pair of counts; few even where a node has very many children
    kinds = nodes.where("depth > 0").groupBy("host", "parent", "rated", "bad").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(overall))  # one row

    def branch(pdf: pd.DataFrame) -> pd.DataFrame:
        r, b = merged((pdf["rated"] * pdf["n"]).to_numpy(), (pdf["bad"] * pdf["n"]).to_numpy(), float(pdf["_prior"].iloc[0]), prior_weight, z)
        return pd.DataFrame({"host": pdf["host"], "parent": pdf["parent"], "rated": pdf["rated"], "bad": pdf["bad"], "_r": r, "_b": b})

    branches = kinds.groupBy("host", "parent").applyInPandas(branch, "host string, parent string, rated long, bad long, _r long, _b long")
    known = nodes.join(branches, ["host", "parent", "rated", "bad"], "left").select("host", "node", "rated", "bad", F.coalesce("_r", "rated").alias("r"), F.coalesce("_b", "bad").alias("b"))
    # the same node on all hosts; very many hosts may have it, so its row is there once for each of SALTS groups of hosts
    pools = nodes.where("depth > 0").groupBy("node").agg(F.sum("rated").alias("_pr"), F.sum("bad").alias("_pb"))
    pools = pools.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    zero = lambda c: F.coalesce(c, F.lit(0))
    way = _nodes(counted.select("host", "template")).withColumn("_salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int"))
    way = way.join(known, ["host", "node"], "left").join(pools, ["node", "_salt"], "left").groupBy("host", "template").agg(
        F.array_sort(F.collect_list(F.struct("depth", zero("r").alias("r"), zero("b").alias("b"), (zero("_pr") - zero("rated")).alias("pr"), (zero("_pb") - zero("bad")).alias("pb")))).alias("_way")
    )
    # the host's row (depth 0) has no pool; what a level adds is what the next one down doesn't have
    below = lambda i, c: zero(F.get(F.col("_way"), i + 1)[c])
    part = lambda x, i, c: F.when((x["depth"] > 0) | F.lit(c in "rb"), x[c] - below(i, c)).otherwise(F.lit(0).cast("long")).alias(c)
    own = F.transform("_way", lambda x, i: F.struct(*(part(x, i, c) for c in ("r", "b", "pr", "pb"))))

    def down(up: Column, x: Column) -> Column:
        elsewhere = F.least(x["pr"].cast("double"), F.lit(pool_weight))
        return (x["b"] + prior_weight * up + elsewhere * x["pb"] / F.greatest(x["pr"], F.lit(1))) / (x["r"] + prior_weight + elsewhere)

    df = counted.join(way, ["host", "template"]).crossJoin(F.broadcast(overall))
    return df.withColumn("bad_share", F.aggregate(own, F.col("_prior"), down)).drop("_way", "_prior")


def template_verdicts(pages: DataFrame, min_share: float = 1 / 64, threshold: float = 0.5) -> DataFrame:
    """``pages`` (columns host, path, bad: 1, 0 or null where not rated) with template, bad_share, rejected."""
    pages = pages.drop("template", "bad_share", "rejected")
    row = pages.select(F.struct("*").alias("_row"), F.col("host"), F.concat_ws("/", segments("path")).alias("_shape"), F.col("bad").cast("int").alias("bad"))
    # one row for each host and generalised path, however many pages
    shapes = row.groupBy("host", "_shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("rated"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    placed = materialize(templates(shapes.withColumn("path", F.concat(F.lit("/"), "_shape")), min_share))
    counted = placed.groupBy("host", "template").agg(F.sum("rated").alias("rated"), F.sum("bad").alias("bad"))
    judged = placed.select("host", "_shape", "template").join(purity(counted).select("host", "template", "bad_share"), ["host", "template"])
    return row.join(judged, ["host", "_shape"], "left").select("_row.*", "template", "bad_share", (F.col("bad_share") > threshold).alias("rejected"))
