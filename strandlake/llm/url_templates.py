"""URL filter: rules first, then a path-template tree learned per host.

A URL's host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; its path is
what follows up to `?`, `#` or the end. A rule (host, path, verdict) fits its host and all subdomains, if the
URL's path starts with the rule's; of several the longest host, then the longest path, wins.

URLs that no rule judges get the verdict of their template:

1. Per host, paths form a tree by segment. A segment is variable where it looks like an id (digits make up
   half of it but for a file extension, or it is long hex), or where its place under one parent has many values: at least
   MIN_VALUES, each with less than MAX_REPEATS rows on average. Variable segments become `*`, level by level,
   so that a parent is generalised before its children are counted. The tree has DEPTH + 1 levels: what follows
   the first DEPTH segments is one segment, whole.
2. From the host down, the branches of one parent merge when they are statistically similar: each has too
   little labelled evidence to be told from its parent (fewer than MIN_LABELLED labelled rows, or a blocked
   share within Z standard errors of the parent's). Branches with less than that evidence go on as one subtree.
3. A branch's purity is the blocked share among the labelled rows of those it merged with, smoothed towards its
   parent's, at the top its host's, and that towards all rows' share, each with the weight of PRIOR rows. Without
   labelled rows it is thus the parent's. A template whose purity is above LIMIT is rejected.

The labels are the rules' own verdicts on the URLs they fit. Statistics are sums by (host, template), so a
host with a third of all rows is summed before it is shuffled; templates, not URLs, meet at a parent. URLs
get the verdict of a frequent segment list by broadcast: there are fewer than FREQUENT lists that each have
more than one row in FREQUENT. The others join by exchange, and none of them is larger than that share.

Defined cases: a null URL or one without `://` has an empty host and path and forms its own template;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut

#: Rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEPTH = 6
MIN_VALUES, MAX_REPEATS = 20, 3.0
MIN_LABELLED, Z = 5, 2.0
PRIOR, LIMIT = 5.0, 0.8
FREQUENT = 10_000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The name (`host` + `path`) and verdict of the rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (len(r[0]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruling."""
    rows = pages.select(F.col("page_id").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruling = ruled(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), ruling.alias("ruling"))


def levels(parts: Column) -> Column:
    """Segments by level of the tree: those beyond DEPTH are one."""
    rest = F.array_join(F.slice(parts, DEPTH + 1, F.greatest(F.size(parts) - DEPTH, F.lit(0))), "/")
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(rest))).otherwise(parts)


def segments(path: Column) -> Column:
    """The path's segments by level; what looks like an id is `*`."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    stem = lambda s: F.regexp_replace(s, "\\.[A-Za-z][A-Za-z0-9]{0,4}$", "")  # noqa: E731  without a file extension
    digits = lambda s: F.length(F.regexp_replace(s, "[^0-9]", ""))
    variable = lambda s: (digits(s) > 0) & ((2 * digits(stem(s)) >= F.length(stem(s))) | stem(s).rlike("^[0-9a-fA-F-]{12,}$"))
    return levels(F.transform(parts, lambda s: F.when(variable(s), F.lit("*")).otherwise(s)))


def templates(rows: DataFrame) -> DataFrame:
    """(host, segs, n, template): each distinct segment list of a host, how many rows have it, and its generalised form.

    Level by level: a place with many values under one generalised parent becomes a wildcard there."""
    paths = rows.groupBy("host", segments(F.col("path")).alias("segs")).agg(F.count("*").alias("n")).withColumn("done", F.lit(""))
    paths = cut(paths)
    deepest = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(deepest):
        here = F.coalesce(F.get("segs", F.lit(level)), F.lit(""))
        places = paths.withColumn("here", here).groupBy("host", "done", "here").agg(F.sum("n").alias("n"))
        wide = (
            places.where("here NOT IN ('', '*')")
            .groupBy("host", "done")
            .agg(F.count("*").alias("values"), F.sum("n").alias("n"))
            .where((F.col("values") >= MIN_VALUES) & (F.col("n") < MAX_REPEATS * F.col("values")))
            .select("host", "done", F.lit(True).alias("wide"))
        )
        step = F.when(F.col("here") == "", F.lit("")).when(F.col("wide") & ~F.col("here").isin("*", "**"), F.lit("/*")).otherwise(F.concat(F.lit("/"), F.col("here")))
        paths = (
            paths.withColumn("here", here).join(wide, ["host", "done"], "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
            .withColumn("done", F.concat("done", step)).drop("here", "wide")
        )
        paths = cut(paths)
    return paths.select("host", "segs", "n", F.col("done").alias("template"))


def merged_purity(rows: DataFrame) -> DataFrame:
    """(host, template, n, labelled, blocked) to (host, template, purity).

    Level by level from the host down: a place's branches merge and take their group's purity, smoothed towards
    that of the place. Branches with enough labelled rows keep their own subtrees; the others' are one."""
    labelled, blocked = rows.agg(F.sum("labelled"), F.sum("blocked")).first()  # two sums
    base = ((blocked or 0) + 1.0) / ((labelled or 0) + 2.0)
    hosts = rows.groupBy("host").agg(((F.sum("blocked") + PRIOR * base) / (F.sum("labelled") + PRIOR)).alias("purity"))
    # a template's own place ends its segments
    segs = F.concat(levels(F.filter(F.split("template", "/"), lambda s: s != "")), F.array(F.lit("")))
    found = cut(rows.join(hosts, "host").select("host", "template", segs.alias("segs"), "labelled", "blocked", F.lit("").alias("done"), "purity"))
    deepest = found.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(deepest):
        here = F.get("segs", F.lit(level))
        live = found.where(here.isNotNull()).withColumn("here", here)
        branches = live.groupBy("host", "done", "here").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.first("purity").alias("purity"))
        places = branches.groupBy("host", "done").agg(F.sum("labelled").alias("p_labelled"), F.sum("blocked").alias("p_blocked"))
        share = F.coalesce(F.try_divide("p_blocked", "p_labelled"), F.lit(0.0))
        error = F.sqrt(share * (1 - share) / F.greatest(F.col("labelled"), F.lit(1))) + 1e-9
        few = F.col("labelled") < MIN_LABELLED
        similar = few | (F.abs(F.col("blocked") / F.greatest(F.col("labelled"), F.lit(1)) - share) <= Z * error)
        # no path holds a `?`
        named = branches.join(places, ["host", "done"]).select(
            "host", "done", "here", "labelled", "blocked", "purity", "p_labelled",
            F.when(similar, F.lit("?")).otherwise(F.col("here")).alias("merged"), F.when(few, F.lit("?")).otherwise(F.col("here")).alias("under"),
        )
        groups = named.groupBy("host", "done", "merged").agg(F.sum("labelled").alias("m_labelled"), F.sum("blocked").alias("m_blocked"))
        smoothed = (F.col("m_blocked") + PRIOR * F.col("purity")) / (F.col("m_labelled") + PRIOR)
        if level > 0:
            # the same evidence isn't counted again level by level
            smoothed = F.when(F.col("m_labelled") == F.col("p_labelled"), F.col("purity")).otherwise(smoothed)
        scored = named.join(groups, ["host", "done", "merged"]).select("host", "done", "here", "under", smoothed.alias("new"))
        stepped = found.withColumn("here", here).join(scored, ["host", "done", "here"], "left")
        found = cut(
            stepped.select(
                "host", "template", "segs", "labelled", "blocked",
                F.when(F.col("new").isNull(), F.col("done")).otherwise(F.concat("done", F.lit("/"), "under")).alias("done"), F.coalesce("new", "purity").alias("purity"),
            )
        )
    return found.select("host", "template", "purity")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row."""
    rows = parsed(pages, rules).withColumn("segs", segments(F.col("path")))
    tree = templates(rows)
    sums = rows.groupBy("host", "segs").agg(F.count("ruling").alias("labelled"), F.count_if(F.col("ruling") == "block").alias("blocked"))
    by_template = sums.join(tree, ["host", "segs"]).groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
    by_template = cut(by_template)
    found = cut(tree.join(merged_purity(by_template), ["host", "template"]).select("host", "segs", "n", "template", "purity"))
    most = (found.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    frequent = found.where(F.col("n") > most).drop("n")  # fewer than FREQUENT rows
    marked = rows.join(F.broadcast(frequent), ["host", "segs"], "left")
    rare = marked.where("template IS NULL").drop("template", "purity").join(found.where(F.col("n") <= most).drop("n"), ["host", "segs"])
    learned = F.when(F.col("purity") > LIMIT, "block").otherwise("allow")
    return marked.where("template IS NOT NULL").unionByName(rare).select(
        "page_id", "host", "path", "rule", F.coalesce("ruling", learned).alias("verdict"), "template", "purity"
    )


def op9_url_templates(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
