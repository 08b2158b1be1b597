"""Operator 1 — URL filters by a path-template tree, in DataFrame functions only.

Rules come first (the longest that fits wins).  All other urls are judged by
templates: per host, the paths form a tree; level by level

* a branch whose labelled block rate differs from that of its siblings together
  (two-proportion z-test) stays a branch of its own, however many there are;
* all others, those without labels too, are merged into one branch: ``*`` if
  the segment is variable (many children, or several that all hold digits),
  otherwise ``~``; a segment that all paths of a node share keeps its name.

From ``children`` labelled siblings on, the test asks for more (z squared plus
twice the logarithm of their number over ``children``, a Bonferroni bound), so
that a variable segment does not lose the branches that differ by chance.

Every node has a smoothed purity, (blocked + weight * parent's purity) /
(labelled + weight), from the whole table down to the host and its templates.
A url is blocked when its template's purity reaches ``reject``.  The labelled
rows are the urls that rules decide, unless the caller gives labels.

Work is done on the distinct (host, path) with their counts, so a host or a
url with a third of all rows is pre-aggregated before any shuffle; the joins
back have unique right sides, which AQE may split.  Each round is written to
the shared folder, with the paths that go on only.  A node passes all the
segments that its paths share at once, up to the first where they differ (a
path alone: to its end), so the rounds follow the tree's forks, not the length
of its paths.  They go on until no path is left.

Null urls and urls without ``://`` have empty host and path and are judged by
the template of the empty host; repeated rows are judged alike, one row each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

#: Fixed values of the registered query: (verdict, host and path prefix).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.regexp_extract(after, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(after, r"^([^/?#]*)([^?#]*)", 2)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits (its host or a subdomain, a prefix of the path), or null; equal lengths: the first."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _verdict_of(rule: Column, rules) -> Column:
    blocked = [r for verdict, r in rules if verdict == "block"]
    return F.when(rule.isNull(), None).when(rule.isin(blocked) if blocked else F.lit(False), "block").otherwise("allow")


def _smoothed(bad: str, known: str, prior, weight: float) -> Column:
    return (F.col(bad) + F.lit(weight) * prior) / (F.col(known) + F.lit(weight))


def path_templates(urls: DataFrame, children: int = 8, z: float = 1.96, weight: float = 8.0) -> DataFrame:
    """Templates of distinct (host, path, n, known, bad): host, path, template, purity."""
    whole = urls.agg(F.sum("bad"), F.sum("known")).first()
    overall = ((whole[0] or 0) + 1) / ((whole[1] or 0) + 2)
    hosts = (urls.groupBy("host").agg(F.sum("known").alias("host_known"), F.sum("bad").alias("host_bad"))
             .select("host", _smoothed("host_bad", "host_known", F.lit(overall), weight).alias("purity")))
    tree = (urls.join(hosts, "host", "left").withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != ""))
            .withColumn("template", F.lit("")).withColumn("ended", F.size("segments") == 0))
    tree, done = stored(tree, "url-tree"), []
    while True:
        done.append(tree.where("ended").select("host", "path", "template", "purity"))
        here = tree.where("not ended")
        if here.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        here = (here.withColumn("segment", F.get("segments", F.lit(0))).withColumn("rest", F.slice("segments", F.lit(2), F.size("segments"))))
        kids = (here.groupBy("host", "template", "segment")
                .agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"), F.first("purity").alias("purity"), F.min("rest").alias("low"), F.max("rest").alias("high")))
        family = kids.groupBy("host", "template").agg(
            F.count("*").alias("kids"), F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"),
            F.count_if(F.col("known") > 0).alias("all_labelled"), F.min(F.col("segment").rlike("[0-9]")).alias("all_digits"))
        rest_known, rest_bad = F.col("all_known") - F.col("known"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide("all_bad", "all_known")
        strict = F.sqrt(F.lit(z * z) + 2 * F.log(F.greatest(F.col("all_labelled") / F.lit(children), F.lit(1.0))))
        differs = ((F.col("known") > 0) & (rest_known > 0) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_known"))
                   & (F.abs(F.try_divide("bad", "known") - F.try_divide(rest_bad, rest_known))
                      >= strict * F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("known")) + F.try_divide(F.lit(1), rest_known)))))
        variable = (F.col("kids") >= children) | ((F.col("kids") >= 2) & F.col("all_digits"))
        branch = (F.when(F.coalesce(differs, F.lit(False)), F.col("segment")).when(variable, "*")
                  .when(F.col("kids") == 1, F.col("segment")).otherwise("~"))
        named = (kids.join(family, ["host", "template"])
                 .select("host", "template", "segment", "known", "bad", "purity", "low", "high", F.concat("template", F.lit("/"), branch).alias("next")))
        nodes = named.groupBy("host", "next").agg(F.sum("known").alias("node_known"), F.sum("bad").alias("node_bad"), F.first("purity").alias("above"),
                                                  F.min("low").alias("low"), F.max("high").alias("high"))
        # the least and the greatest of a node's rests share what all of them share
        unlike = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        nodes = nodes.withColumn("shared", F.when(unlike == 0, F.size("low")).otherwise(unlike - 1))
        # the same counts smooth the purity again at each shared segment
        once = _smoothed("node_bad", "node_known", F.col("above"), weight)
        rate, kept = F.try_divide("node_bad", "node_known"), F.pow(F.lit(weight) / (F.col("node_known") + F.lit(weight)), F.col("shared"))
        chain = F.transform(F.slice("low", F.lit(1), F.col("shared")), lambda s: F.concat(F.lit("/"), s if children > 1 else F.lit("*")))
        nodes = nodes.select("host", "next", "shared", F.concat("next", F.array_join(chain, "")).alias("node"),
                             F.when((F.col("node_known") > 0) & (F.col("shared") > 0), rate + (once - rate) * kept).otherwise(once).alias("node_purity"))
        step = named.select("host", "template", "segment", "next").join(nodes, ["host", "next"])
        tree = stored(here.join(step, ["host", "template", "segment"])
                      .select("host", "path", "known", "bad", F.slice("rest", F.col("shared") + 1, F.size("rest")).alias("segments"),
                              F.col("node_purity").alias("purity"), F.col("node").alias("template"), (F.size("rest") == F.col("shared")).alias("ended")), "url-tree")


def judge_urls(pages: DataFrame, rules=None, labels: DataFrame | None = None, reject: float = 0.8,
               id_column: str = "page_id", url_column: str = "url", **tree) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    ``labels`` (id column, boolean ``bad``; one row per id) replaces the rules'
    verdicts as the labelled rows.
    """
    rules = RULES if rules is None else rules
    url = F.col(url_column).cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = _verdict_of(F.col("rule"), rules)
    if labels is None:
        marked = rows.withColumn("mark", verdict == "block")
    else:
        marked = rows.join(labels.select(F.col(id_column).alias("page_id"), F.col("bad").alias("mark")), "page_id", "left")
    urls = marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("mark").alias("known"),
                                              F.sum(F.coalesce(F.col("mark"), F.lit(False)).cast("long")).alias("bad"))
    templates = path_templates(stored(urls, "url-counts"), **tree)
    return (rows.join(templates, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce(verdict, F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"), "template", "purity"))


def op1_url_templates(spark, sf_dir: str) -> DataFrame:
    """Registered query: every url of ``pages``."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
