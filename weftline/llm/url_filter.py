"""URL filters from a path-template tree.

Labels come from host and path rules. Per host, paths become templates: runs of digits turn into ``#``, and then, level
by level from the root, the children of a node that are too many for its rows turn into ``*``; what lies deeper than
``DEPTH`` segments is one ``**``. Sibling branches whose labelled block shares don't differ (a chi-square test of
homogeneity) are merged into ``+``, whole, and siblings without labels join them. A template is rejected if its smoothed
labelled purity reaches ``REJECT``; one without labels takes the labels of its nearest parent that has some, short of the
host's root, or else keeps the neutral prior and is allowed. Rules overrule templates.

All steps are DataFrame functions over sums by template; only the last join looks at the pages again, and rows of a hot
template are split by the adaptive join (or the template table is broadcast where Spark has found it to be small).

Nulls and urls without ``://`` have an empty host and path, no rule, and get the verdict of the empty template. Repeated
rows are kept one for one; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import ascii_lower, table
from weftline.session import cut

DEPTH = 4
#: A node's children are variable if they are at least so many, and at least this share of its rows.
MANY, SPREAD = 8, 0.25
#: Pseudo-counts for a neutral prior, and the purity from which a template is rejected.
PRIOR, REJECT = 2.0, 0.8

#: (verdict, host, start of path); a rule holds for subdomains too.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (its string, its verdict); nulls if none does."""
    which, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = which.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(kind))
    return which, verdict


def _segments(shape: Column) -> Column:
    """Segments after the first slash, at most DEPTH and then one for the rest."""
    parts = F.split(F.regexp_replace(shape, "^/", ""), "/", -1)
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**")))).otherwise(parts)


def _replaced(segments: Column, level: int, by: str) -> Column:
    return F.transform(segments, lambda x, i: F.when(i == level, F.lit(by)).otherwise(x))


def templates(pages: DataFrame) -> DataFrame:
    """host, shape, template, n, labelled, blocked for pages with host, path and a verdict by rule or null.

    blocked and labelled are those of the whole template, or of its nearest parent below the root with labels if it has none.
    """
    shapes = pages.groupBy("host", F.regexp_replace("path", "[0-9]+", "#").alias("shape")).agg(
        F.count("*").alias("n"),
        F.count("verdict").alias("labelled"),
        F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"),
    )
    tree = cut(shapes.withColumn("segments", _segments(F.col("shape"))))
    for level in range(DEPTH):
        here = tree.where(F.size("segments") > level).withColumns({"above": F.slice("segments", 1, level), "child": F.get("segments", F.lit(level))})
        nodes = here.groupBy("host", "above", "child").agg(F.sum("n").alias("n")).groupBy("host", "above").agg(F.count("*").alias("children"), F.sum("n").alias("rows"))
        variable = nodes.where((F.col("children") >= MANY) & (F.col("children") >= SPREAD * F.col("rows"))).select("host", "above", F.lit(True).alias("variable"))
        keyed = tree.withColumn("above", F.slice("segments", 1, level))
        tree = cut(
            keyed.join(variable, ["host", "above"], "left")
            .withColumn("segments", F.when(F.col("variable") & (F.size("segments") > level), _replaced(F.col("segments"), level, "*")).otherwise(F.col("segments")))
            .drop("above", "variable")
        )
    for level in range(DEPTH):
        leaves = tree.where(F.size("segments") > level).groupBy("host", "segments").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b"))
        siblings = leaves.where("m > 0").groupBy("host", _replaced(F.col("segments"), level, "+").alias("merged")).agg(F.count("*").alias("k"), F.sum("m").alias("m"), F.sum("b").alias("b"), F.sum(F.col("b") * F.col("b") / F.col("m")).alias("s"))
        p = F.col("b") / F.col("m")
        chi = F.coalesce(F.try_divide(F.col("s") - F.col("m") * p * p, p * (1 - p)), F.lit(0.0))
        df = F.col("k") - 1
        alike = siblings.where((F.col("k") > 1) & (chi <= df + 1.645 * F.sqrt(2 * df))).select("host", "merged", F.lit(True).alias("alike"))
        keyed = tree.withColumn("merged", _replaced(F.col("segments"), level, "+"))
        tree = cut(keyed.join(alike, ["host", "merged"], "left").withColumn("segments", F.when(F.col("alike"), F.col("merged")).otherwise(F.col("segments"))).drop("merged", "alike"))
    leaves = cut(tree.groupBy("host", "segments").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")))
    above = leaves.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("segments")))).withColumn("parent", F.slice("segments", F.lit(1), F.col("depth")))
    parents = above.groupBy("host", "parent").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b")).where("m > 0")
    nearest = above.where("labelled = 0").select("host", "segments", "depth", "parent").join(parents, ["host", "parent"])
    nearest = nearest.groupBy("host", "segments").agg(F.max_by(F.struct("m", "b"), "depth").alias("up"))
    whole = leaves.join(nearest, ["host", "segments"], "left").select("host", "segments", F.coalesce("up.m", "labelled").alias("labelled"), F.coalesce("up.b", "blocked").alias("blocked"))
    got = tree.drop("labelled", "blocked").join(whole, ["host", "segments"])
    return got.withColumn("template", F.concat(F.lit("/"), F.array_join("segments", "/"))).drop("segments")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": by_rule})
    purity = (F.col("blocked") + PRIOR / 2) / (F.col("labelled") + PRIOR)
    judged = cut(templates(rows).select("host", "shape", "template", purity.alias("purity")))
    got = rows.withColumn("shape", F.regexp_replace("path", "[0-9]+", "#")).join(judged, ["host", "shape"], "left")
    by_template = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return got.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_template).alias("verdict"), "template", "purity")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
