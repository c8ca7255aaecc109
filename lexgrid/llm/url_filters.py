"""URL filters: fixed rules first, then a path-template tree learnt from the urls that the rules label.

Each host's paths form a tree of segments. Segments with digits, or long ones, are wildcards from the start; where a node has
more than WIDE children, they become one wildcard, and their subtrees one; this goes on until no node changes. Then, from the
host down, each node's labelled urls, with all below it, are counted, and siblings whose shares of blocked urls cannot be
told apart, neighbours in the order of these shares, are merged. A template's purity is the smoothed share along its path: the
merged node's, leaning on that of the node above, which leans at last on the same template of all hosts, which leans on all
urls. A template is rejected when it is above one half.

DataFrame functions only. Counts are grouped by (host, path) before anything else, children of a node by grouped aggregates, so
a host of any width is spread over tasks by its children; windows hold the siblings of one node, WIDE + 1 at most after the
wildcards. Rounds are as many as wildcards under wildcards, and one; paths may be of any depth.

Defined cases: a null url or one without `://` has an empty host and path, no rule, and the verdict of the empty
template. Repeated rows count and are judged each. Long paths are read whole. An empty table gives no rows. Extra columns pass
through; one named as the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, Workspace, lower_ascii

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Children of a node without wildcard; weight of what a share leans on; squared normal quantile of the test (5 in 100).
WIDE, PRIOR, Z2 = 20, 4.0, 3.8416


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments, those with digits and long ones as `*`."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]") | (F.length(x) > 24), F.lit("*")).otherwise(x))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows and the bytes of its texts are found to be few."""
    texts = [F.array_join(f"`{c}`", "/") if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes if "string" in t]
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)).cast("long") for t in texts), F.lit(16))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def path_to(k: Column) -> Column:
    """The first k segments of a template, as a string."""
    return F.array_join(F.slice("tpl", F.lit(1), k), "/")


def generalise(tree: DataFrame, space: Workspace) -> DataFrame:
    """tree (host, seg, n, b) with its templates `tpl`: seg with the children of wide nodes as `*`."""
    tree = space.keep(tree.withColumn("tpl", F.col("seg")))
    while True:
        at = tree.select("host", "tpl").distinct().select("host", "tpl", F.posexplode("tpl").alias("k", "child"))
        children = at.select("host", path_to(F.col("k")).alias("node"), "k", "child").distinct()
        wide = space.keep(children.groupBy("host", "node", "k").count().where(F.col("count") > WIDE).select("host", "node", "k"))
        if wide.isEmpty():
            return tree
        hit = at.select("host", "tpl", "k", path_to(F.col("k")).alias("node")).join(small(wide), ["host", "node", "k"], "left_semi")
        hit = hit.groupBy("host", "tpl").agg(F.collect_set("k").alias("ks"))
        star = F.transform("tpl", lambda x, k: F.when(F.array_contains("ks", k), F.lit("*")).otherwise(x))
        new = tree.join(hit, ["host", "tpl"], "left").withColumn("tpl", F.when(F.col("ks").isNull(), F.col("tpl")).otherwise(star)).drop("ks")
        old, tree = tree, space.keep(new.select(*tree.columns))
        space.drop(old, wide)


def merged(nodes: DataFrame) -> DataFrame:
    """(host, k, node, gn, gb): counts of each labelled node (host, k, up, child, node, n, b) with the siblings like it.

    Siblings stand in the order of their shares; where two neighbours' shares differ, by the test of two proportions, a new
    group begins.
    """
    siblings = W.partitionBy("host", "up", "k").orderBy(F.col("b") / F.col("n"), "child")
    d = nodes.where("n > 0").withColumn("n", F.col("n").cast("double")).withColumn("b", F.col("b").cast("double"))
    d = d.withColumn("n0", F.lag("n").over(siblings)).withColumn("b0", F.lag("b").over(siblings))
    off = F.col("b") * F.col("n0") - F.col("b0") * F.col("n")
    both, blocked = F.col("n") + F.col("n0"), F.col("b") + F.col("b0")
    differ = off * off * both > F.lit(Z2) * F.col("n") * F.col("n0") * blocked * (both - blocked)
    d = d.withColumn("g", F.sum(F.coalesce(differ, F.lit(False)).cast("int")).over(siblings))
    group = W.partitionBy("host", "up", "k", "g")
    return d.select("host", "k", "node", F.sum("n").over(group).alias("gn"), F.sum("b").over(group).alias("gb"))


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, name: str = "url_filter") -> DataFrame:
    """All columns of pages plus a struct column: host, path, rule, verdict, template, n_labelled, n_blocked."""
    space = Workspace(pages.sparkSession)
    host, path = split_url(F.col(f"`{url}`"))
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != name]).alias("row"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", rule).withColumn("rv", verdict).withColumn("seg", segments(F.col("path")))
    labelled, blocked = F.col("rv").isNotNull().cast("long"), F.coalesce((F.col("rv") == "block").cast("long"), F.lit(0))
    tree = generalise(d.groupBy("host", "seg").agg(F.sum(labelled).alias("n"), F.sum(blocked).alias("b")), space)
    leaves = space.keep(tree.groupBy("host", "tpl").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    # Nodes: the host itself (k = 0) and the prefixes of its templates.
    down = leaves.select("host", "tpl", "n", "b", F.explode(F.sequence(F.lit(0), F.size("tpl"))).alias("k"))
    down = down.withColumn("node", path_to(F.col("k")))
    nodes = down.groupBy("host", "k", "node").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.first("tpl").alias("tpl"))
    inner = nodes.where("k > 0").withColumn("up", path_to(F.col("k") - 1)).withColumn("child", F.get("tpl", F.col("k") - 1))
    roots = nodes.where("k = 0 AND n > 0").select("host", "k", "node", F.col("n").cast("double").alias("gn"), F.col("b").cast("double").alias("gb"))
    groups = space.keep(roots.unionByName(merged(inner)))
    # A template over all hosts, and all urls.
    by_tpl = leaves.groupBy("tpl").agg(F.sum("n").alias("tn"), F.sum("b").alias("tb"))
    p_all = by_tpl.agg((F.sum("tb") + 1.0) / (F.sum("tn") + 2.0)).scalar()
    chain = down.select("host", "tpl", "k", "node").join(small(groups), ["host", "k", "node"]).groupBy("host", "tpl").agg(F.sort_array(F.collect_list(F.struct("k", "gn", "gb"))).alias("chain"))
    verdicts = leaves.join(by_tpl, "tpl").join(chain, ["host", "tpl"], "left").withColumn("p_all", p_all)
    p_tpl = (F.col("tb") + PRIOR * F.col("p_all")) / (F.col("tn") + PRIOR)
    purity = F.when(F.col("chain").isNull(), p_tpl).otherwise(F.aggregate("chain", p_tpl, lambda p, x: (x["gb"] + PRIOR * p) / (x["gn"] + PRIOR)))
    verdicts = verdicts.select("host", "tpl", F.when(purity > 0.5, "block").otherwise("allow").alias("tv"), "n", "b")
    of = tree.select("host", "seg", "tpl").join(verdicts, ["host", "tpl"])
    template = F.concat(F.lit("/"), F.array_join("tpl", "/"))
    found = F.struct("host", "path", "rule", F.coalesce("rv", "tv").alias("verdict"), template.alias("template"), F.col("n").alias("n_labelled"), F.col("b").alias("n_blocked"))
    return d.join(small(space.keep(of)), ["host", "seg"], "left").select("row.*", found.alias(name))
