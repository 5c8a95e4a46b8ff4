"""URL filter: explicit rules first, then a per-host tree of path templates judged by labelled purity.

1. Paths are cut into segments. Segments from depth ``MAX_DEPTH`` on become one segment, so the
   tree's depth is bounded; nothing is dropped.
2. Level by level, a segment is generalised to ``*`` where it is a number (an ending such as
   ``.html`` stays) or where its parent has more than ``MAX_BRANCHES`` different children that
   repeat less than twice on average.
3. At every depth, sibling branches that hold labelled pages (two at least, counted with all that lies
   below) and whose share of bad pages differs from their parent's by less than ``Z`` standard errors are
   merged into the branch ``~``, and what lies below them with it; a branch without labels stays by itself.
4. A template's smoothed purity is (bad + ALPHA * prior) / (labelled + ALPHA); prior is the share of bad
   pages among all labelled ones. A template without labels takes its nearest ancestor's that has some, up
   to the host. It is rejected when that is at least ``REJECT``; a host without labels keeps the prior as
   its purity and nothing of it is rejected.

Labels are pages an explicit rule decides, or a column ``bad`` (0/1/null) the caller gives.
All steps are grouped counts (partial sums first: a host with a third of all pages is one row per
task and branch) and equi-joins on (host, branch).

Cases: a null url, or one without ``://``, has an empty host and path; repeated urls count and are
judged one by one; no labels: nothing is rejected; an empty table gives an empty result; further
columns pass through (columns named like an output are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import ascii_lower, stored

MAX_DEPTH = 6
MAX_BRANCHES = 32
Z = 1.96
ALPHA = 4.0
REJECT = 0.9
OUTPUTS = ("host", "path", "rule", "verdict", "template", "purity")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest of ``rules`` [(verdict, "host/path")] that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):          # longer ones end up outside
        h, p = r.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def templates(pages: DataFrame, max_depth: int = MAX_DEPTH, max_branches: int = MAX_BRANCHES) -> DataFrame:
    """``pages`` (host, path, ...) with ``_branch``: the generalised path of each distinct (host, path)."""
    paths = pages.select("host", "path", "_bad").groupBy("host", "path") \
        .agg(F.count("*").alias("n"), F.count("_bad").alias("labelled"), F.sum("_bad").alias("bad"))
    parts = F.split(F.regexp_replace("path", r"^/", ""), "/")
    head = F.when(F.size(parts) <= max_depth, parts).otherwise(F.concat(
        F.slice(parts, 1, max_depth - 1), F.array(F.array_join(F.slice(parts, max_depth, 1 << 30), "/"))))
    shaped = F.transform(head, lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"),
                                               F.regexp_replace(s, r"^[0-9]+", "*")).otherwise(s))
    tree = paths.withColumn("_segs", shaped).withColumn("_branch", F.lit(""))
    for depth in range(max_depth):
        seg = F.get("_segs", F.lit(depth))
        kids = tree.filter(seg.isNotNull()).groupBy("host", "_branch", seg.alias("_seg")) \
            .agg(F.sum("n").alias("n"))
        wide = kids.groupBy("host", "_branch").agg(F.count("*").alias("_kids"), F.sum("n").alias("_rows")) \
            .filter((F.col("_kids") > max_branches) & (F.col("_rows") < 2 * F.col("_kids"))) \
            .select("host", "_branch", F.lit(True).alias("_wide"))
        tree = stored(tree.join(wide, ["host", "_branch"], "left").withColumn(
            "_branch", F.when(seg.isNull(), F.col("_branch")).otherwise(F.concat(
                "_branch", F.lit("/"), F.when(F.coalesce("_wide", F.lit(False)), F.lit("*")).otherwise(seg))))
            .drop("_wide"), f"tree{depth}")
    return tree.select("host", "path", "_branch", "n", "labelled", "bad")


def _prefixes(branches: DataFrame, branch: str, *keep: str) -> DataFrame:
    """A row per branch and depth: ``_depth`` segments of it as ``_prefix`` (depth 0: the host)."""
    parts = F.split(branch, "/", MAX_DEPTH + 1)
    return branches.select("host", branch, *keep, F.posexplode(parts).alias("_depth", "_seg")) \
        .withColumn("_prefix", F.array_join(F.slice(parts, F.lit(1), F.col("_depth") + 1), "/"))


def judge(tree: DataFrame, z: float = Z, alpha: float = ALPHA) -> DataFrame:
    """(host, path, template, purity, labelled_host) of every distinct (host, path) of ``templates``."""
    leaves = stored(tree.groupBy("host", "_branch").agg(F.sum("labelled").alias("labelled"),
                                                       F.sum(F.coalesce("bad", F.lit(0))).alias("bad")), "leaves")
    inner = _prefixes(leaves, "_branch", "labelled", "bad").filter("_depth > 0")
    nodes = inner.groupBy("host", "_depth", "_prefix").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")) \
        .filter("labelled > 0").withColumn("_parent", F.array_join(F.slice(F.split("_prefix", "/", MAX_DEPTH + 1), F.lit(1), F.col("_depth")), "/"))
    above = nodes.groupBy("host", "_depth", "_parent").agg(F.sum("labelled").alias("_n"), F.sum("bad").alias("_b"), F.count("*").alias("_kids"))
    share = F.col("_b") / F.col("_n")
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / F.col("labelled"))
    alike = nodes.join(above, ["host", "_depth", "_parent"]) \
        .filter((F.col("_kids") > 1) & (F.abs(F.col("bad") / F.col("labelled") - share) <= z * error)) \
        .select("host", "_depth", "_prefix", F.lit(True).alias("_alike"))
    depths = inner.select("host", "_branch", "_depth", "_prefix").join(alike, ["host", "_depth", "_prefix"]) \
        .groupBy("host", "_branch").agg(F.collect_set("_depth").alias("_merged"))          # MAX_DEPTH at most
    merged = F.coalesce("_merged", F.array().cast("array<int>"))
    template = F.array_join(F.transform(F.split("_branch", "/", MAX_DEPTH + 1), lambda s, i: F.when(
        F.array_contains(merged, i), F.lit("~")).otherwise(s)), "/")
    marked = stored(leaves.join(depths, ["host", "_branch"], "left").withColumn("template", template).drop("_merged"), "marked")
    prior = marked.agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("p")).first()["p"] or 0.0
    spread = _prefixes(marked.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")),
                       "template", "labelled", "bad")
    pooled = spread.groupBy("host", "_depth", "_prefix").agg(F.sum("labelled").alias("_n"), F.sum("bad").alias("_b")).filter("_n > 0") \
        .select("host", "_depth", "_prefix", ((F.col("_b") + alpha * prior) / (F.col("_n") + alpha)).alias("_purity"))
    nearest = spread.select("host", "template", "_depth", "_prefix").join(pooled, ["host", "_depth", "_prefix"]) \
        .groupBy("host", "template").agg(F.max_by("_purity", "_depth").alias("_purity"))
    scored = marked.select("host", "_branch", "template").join(nearest, ["host", "template"], "left").select(
        "host", "_branch", "template", F.coalesce("_purity", F.lit(prior)).alias("purity"), F.col("_purity").isNotNull().alias("labelled_host"))
    return tree.select("host", "path", "_branch").join(scored, ["host", "_branch"]).drop("_branch")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", bad_col: str | None = None,
                reject: float = REJECT) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    kept = [c for c in pages.columns if c not in OUTPUTS or c == bad_col]
    cut = pages.select(*kept, host.alias("host"), path.alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    cut = cut.withColumns({"rule": rule, "_by_rule": by_rule})
    label = F.when(F.col("_by_rule").isNotNull(), (F.col("_by_rule") == "block").cast("int"))
    if bad_col:
        label = F.coalesce(label, F.col(bad_col).cast("int"))
    labelled = cut.withColumn("_bad", label)
    judged = stored(judge(templates(labelled)), "templates")
    verdict = F.coalesce("_by_rule", F.when(F.col("labelled_host") & (F.col("purity") >= reject), F.lit("block")).otherwise(F.lit("allow")))
    return labelled.join(judged, ["host", "path"], "left").select(
        *kept, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
