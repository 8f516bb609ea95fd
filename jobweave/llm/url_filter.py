"""Allow or block urls by a path-template tree per host, in DataFrame operations only.

Paths become templates: digits in a segment become ``*``. The tree of a host is walked
from the host downwards, one level at a time, to the depth at which every template stands
alone. Where a node has more than ``WIDE`` different next segments, these become one
wildcard. The rows that a rule decides are the labelled ones, and every branch has its
count of labelled and blocked rows. Branches of one node are ordered by their share of
blocked rows; neighbours in this order whose shares do not differ significantly are merged
and pool their counts. A merged branch whose share does not differ from that of the node
above keeps that of the node, another gets its own, smoothed towards it. A template is
rejected only if it has labelled rows of its own and the lower confidence bound of its
smoothed share reaches ``REJECT``; without evidence it is allowed. Rules decide first, the
longest fitting one; templates the rest.

Templates and tree are aggregates of the pages. After widening a node has at most
``WIDE`` + 1 branches, so siblings meet in windows of bounded size. Rows and templates are
joined with them by key, heavy keys by broadcast (at most a thousand). Segments that all
templates of a branch share are passed over, so there are as many levels as a path has
branching nodes.

Defined results: a null url, or one without ``://``, has an empty host and path and is
judged like any other by the rows with an empty host. Branches with equal shares are
neighbours, so their order does not matter. Repeated pages count each. Paths are read
whole, however long. Extra columns are not used. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.html_text import host_of, path_of
from jobweave.llm.links import join_by_key
from jobweave.session import stage

WIDE = 50
#: Labelled rows that the share of the branch above is worth.
PRIOR_ROWS = 5.0
#: Standard errors within which shares of branches count as similar.
SIMILAR = 2.0
#: Standard errors that the confidence bound of a share lies below it.
SURE = 1.645
REJECT = 0.5
#: The rules of the task, as (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def fits(rule: str) -> Column:
    """Whether a rule covers the columns host and path: its host or a subdomain, and a path that starts like its own."""
    host, slash, path = rule.partition("/")
    same = (F.col("host") == host) | F.col("host").endswith(f".{host}") if host else F.lit(True)
    return same & F.col("path").startswith(slash + path)


def longest_rule(rules: list[tuple[str, str]]) -> Column:
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    return reduce(lambda c, r: c.when(fits(r[1]), F.lit(r[1])), ordered[1:], F.when(fits(ordered[0][1]), F.lit(ordered[0][1])))


def template(path: Column) -> Column:
    """Segments with digits made wild."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "*"))


def smoothed(n: Column, blocked: Column, over: Column) -> Column:
    """Share of blocked rows, smoothed towards that of the branch above."""
    return (blocked + PRIOR_ROWS * over) / (n + PRIOR_ROWS)


def lower_bound(n: Column, share: Column) -> Column:
    return share - SURE * F.sqrt(share * (1 - share) / (n + PRIOR_ROWS))


def apart(difference: Column, share: Column, weight: Column) -> Column:
    """Whether a difference of shares is significant; ``weight`` is the sum of the inverse counts."""
    return F.abs(difference) > SIMILAR * F.sqrt(F.greatest(share * (1 - share), F.lit(1e-4)) * weight)


def widened(leaves: DataFrame) -> DataFrame:
    """``branch`` of each template below its node: its next segment, one wildcard where there are too many, empty where it ends."""
    rows = leaves.withColumn("branch", F.coalesce(F.get("segments", F.col("level")), F.lit("")))
    kinds = rows.where("branch <> ''").groupBy("host", "node", "branch").agg(F.count("*").alias("leaves"))
    nodes = kinds.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("leaves").alias("leaves"))
    wide = stage(nodes.where(F.col("kinds") > WIDE).select("host", "node", "leaves"), "wide-nodes")
    if wide.isEmpty():
        return rows
    total = wide.agg(F.sum("leaves")).first()[0]
    found = join_by_key(rows, wide.withColumn("wide", F.lit(True)), ["host", "node"], "leaves", total, "left").drop("leaves")
    return found.withColumn("branch", F.when(F.col("wide") & (F.col("branch") != ""), "*").otherwise(F.col("branch"))).drop("wide")


def merged(branches: DataFrame) -> DataFrame:
    """Share and bound of every branch (host, node, branch, n, blocked, over, floor), similar siblings taken together."""
    n = F.nullif(F.col("n"), F.lit(0))
    own = F.col("blocked") / n
    beside = Window.partitionBy("host", "node", F.col("n") > 0).orderBy("own", "branch")
    last_n, last_b = F.lag(n).over(beside), F.lag("blocked").over(beside)
    pooled = (F.col("blocked") + last_b) / (n + last_n)
    new = apart(own - last_b / last_n, pooled, 1 / n + 1 / last_n)
    ordered = branches.withColumn("own", own).withColumn("new", F.coalesce(new, F.lit(False)).cast("int"))
    classes = ordered.withColumn("class", F.sum("new").over(beside.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("host", "node", F.col("n") > 0, "class")
    sums = classes.withColumns({"class_n": F.sum("n").over(whole), "class_b": F.sum("blocked").over(whole)})
    n, over = F.nullif(F.col("class_n"), F.lit(0)), F.col("over")
    differs = F.coalesce(apart(F.col("class_b") / n - over, over, 1 / n), F.lit(False))
    share = F.when(differs, smoothed(n, F.col("class_b"), over)).otherwise(over)
    return sums.withColumn("share", share).withColumn("bound", F.when(differs, lower_bound(n, share)).otherwise(F.col("floor")))


def in_common(first: Column, last: Column) -> Column:
    """How many segments all lists between the first and the last in order start with."""
    differs = F.array_position(F.zip_with(first, last, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(first)).cast("int")


def shares(leaves: DataFrame) -> DataFrame:
    """(host, template, rows, share, bound, evidence) of each template; evidence is its own number of labelled rows."""
    whole = leaves.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.count("*").alias("leaves"))
    whole = whole.first()
    base = F.lit((whole["b"] + 1) / (whole["n"] + 2))
    n, b = F.col("n"), F.col("b")
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"), F.count("*").alias("leaves"))
    hosts = hosts.withColumn("over", smoothed(n, b, base)).withColumn("floor", lower_bound(n, F.col("over")))
    left = join_by_key(leaves, stage(hosts.drop("n", "b"), "host-shares"), ["host"], "leaves", whole["leaves"]).drop("leaves")
    left = left.withColumns({"node": F.lit(""), "level": F.lit(0)})
    done = None
    while True:
        left = stage(widened(left), "open-templates")
        below = F.expr("slice(segments, level + 2, size(segments))")
        branches = left.groupBy("host", "node", "branch").agg(
            in_common(F.min(below), F.max(below)).alias("jump"),
            F.sum("labelled").alias("n"),
            F.sum("blocked").alias("blocked"),
            F.first("over").alias("over"),
            F.first("floor").alias("floor"),
            F.count("*").alias("leaves"),
        )
        found = merged(branches).select("host", "node", "branch", "share", "bound", F.col("n").alias("evidence"), "leaves", "jump", F.col("leaves").alias("size"))
        keys = ["host", "node", "branch"]
        met = stage(join_by_key(left.drop("over", "floor"), stage(found, "branches"), keys, "size", whole["leaves"]).drop("size"), "met-templates")
        ends = (F.col("leaves") == 1) | (F.col("branch") == "")
        part = met.where(ends).select("host", "template", "rows", "share", "bound", "evidence")
        done = part if done is None else done.unionByName(part)
        left = (
            met.where(~ends)
            .withColumns({"node": F.concat_ws("/", "node", "branch"), "level": F.col("level") + 1 + F.col("jump")})
            .select("host", "template", "segments", "rows", "labelled", "blocked", F.col("share").alias("over"), F.col("bound").alias("floor"), "node", "level")
        )
        if left.isEmpty():
            return done


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, share) of every page."""
    verdicts = dict((r, v) for v, r in rules)
    blocked = F.col("rule").isin([r for r, v in verdicts.items() if v == "block"])
    rows = (
        pages.select(F.col(id_column).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
        .withColumn("rule", longest_rule(rules) if rules else F.lit(None).cast("string"))
        .withColumn("segments", template(F.col("path")))
        .withColumn("template", F.array_join("segments", "/"))
    )
    leaves = rows.groupBy("host", "template").agg(
        F.first("segments").alias("segments"),
        F.count("*").alias("rows"),
        F.count("rule").alias("labelled"),
        F.coalesce(F.sum(F.when(blocked, 1).otherwise(0)), F.lit(0)).alias("blocked"),
    )
    leaves = stage(leaves, "leaves")
    total = leaves.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    known = stage(shares(leaves), "template-shares")
    joined = join_by_key(rows.drop("segments"), known, ["host", "template"], "rows", total)
    method = F.when((F.col("evidence") > 0) & (F.col("bound") >= REJECT), F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.when(F.col("rule").isNull(), method).when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(F.col("page_id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), "template", "share")
