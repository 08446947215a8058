"""URL filters by a path-template tree per host.

Urls that a rule judges are the labelled ones. All urls of a host form a tree of path segments,
grown a level at a time over whole tables: runs of digits are wildcards from the start, segments
that few of a node's urls have become the node's wildcard, and branches whose urls look alike
(shares of blocked, allowed, ending and numbered ones within a Hoeffding bound) are merged.
A leaf is a template. It is rejected where the share of its labelled urls that are blocked,
smoothed towards the share in the whole corpus, is high; urls that no rule judges take their
template's verdict.

A host may hold a third of all urls: the counts have map-side sums, and a key is looked up by a
broadcast where it holds a thousandth of all urls or more (there are at most a thousand such
keys) and by a shuffle where it holds less.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Scratch, map_batches, stored

#: Segments of a path that the tree tells apart; what lies deeper has no part in a template.
MOST_DEPTH = 12
#: A segment is a branch of its own where so many urls, and such a share of the node's, have it.
LEAST_URLS, LEAST_SHARE = 8, 0.02
#: Chance that two branches of one distribution are taken for different ones, at each share.
ALPHA = 0.05
#: Weight of the corpus in a template's share of blocked urls, and the share from which it is rejected.
PRIOR_WEIGHT, REJECT = 4.0, 0.8
#: A key with this part of all rows is hot.
HOT_PART = 1000
SHARES = ("blocked", "allowed", "ending", "numbered")

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path; both empty for a null url and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), letters, letters.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest of the rules (verdict, host, path) that fits, as struct (rule, verdict); null if none does."""
    fits = [(F.concat(F.lit("."), host).endswith("." + h) & path.startswith(p), h + p, v) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    return F.coalesce(*(F.when(fit, F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"))) for fit, r, v in fits), F.lit(None).cast("struct<rule:string,verdict:string>"))


def shape(path: Column) -> Column:
    """A path's segments, runs of digits as ``{n}``, at most ``MOST_DEPTH`` of them."""
    plain = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"%{ord(x):X}")), "{}*|", path)
    segments = F.split(F.regexp_replace(plain, "[0-9]+", "{n}"), "/", MOST_DEPTH + 2)
    return F.slice(segments, 2, MOST_DEPTH)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row for each key) but its ``weight``; null where a key isn't in it.

    ``weight`` is at least the number of rows that have the key, and sums to ``total`` at most.
    """
    names = [c for c in table.columns if c not in (*keys, weight)]
    hot = F.broadcast(table.where(F.col(weight) * HOT_PART >= total).select(*keys, F.struct(*names).alias("_hot")))
    met = rows.join(hot, keys, "left")
    cold = table.where(F.col(weight) * HOT_PART < total).select(*keys, F.struct(*names).alias("_cold"))
    found = met.where("_hot is not null").select(*rows.columns, "_hot.*")
    return found.unionByName(met.where("_hot is null").select(*rows.columns).join(cold, keys, "left").select(*rows.columns, "_cold.*"))


def alike(x: dict, y: dict) -> bool:
    """Whether two branches may be of one distribution."""
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (x["n"] ** -0.5 + y["n"] ** -0.5)
    return all(abs(x[s] / x["n"] - y[s] / y["n"]) <= bound for s in SHARES)


def merged(branches: list[dict]) -> dict[str, tuple[str, int]]:
    """The name after merging, and the urls, of each branch: (name, n) by name. Larger ones come first, and each joins the first that it is like."""
    groups: list[dict] = []
    for b in sorted(branches, key=lambda b: (-b["n"], b["name"])):
        near = next((g for g in groups if alike(g, b)), None)
        if near is None:
            groups.append({**b, "names": [b["name"]]})
        else:
            near.update({k: near[k] + b[k] for k in ("n", *SHARES)}, names=[*near["names"], b["name"]])
    return {name: ("|".join(sorted(g["names"])), g["n"]) for g in groups for name in g["names"]}


def _merged(nodes: DataFrame) -> DataFrame:
    """(host, node, name, branch, urls) of nodes (host, node, branches); a node has 1 / ``LEAST_SHARE`` branches and a wildcard at most."""

    def run(batches):
        for batch in batches:
            out = [(host, node, name, *to) for host, node, branches in zip(*(c.to_pylist() for c in batch.columns)) for name, to in merged(branches).items()]
            kinds = [pa.string()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["host", "node", "name", "branch", "urls"])

    return map_batches(nodes, run, "host string, node string, name string, branch string, urls long")


def learn(urls: DataFrame) -> DataFrame:
    """The templates of urls (host, path, blocked): a row for each host and shape that occurs.

    ``blocked`` is true, false, or null for urls without a label. Columns: host, shape, template,
    n, blocked and allowed (urls of the template), purity, rejected, and shape_n (urls of the
    shape). Hosts and paths are no nulls (`host_and_path`); repeated urls count as often as they
    occur; an empty table has no templates.
    """
    scratch = Scratch(urls.sparkSession)
    is_ = lambda b: F.sum(F.coalesce(F.col("blocked") == b, F.lit(False)).cast("long"))
    shapes = urls.select("host", shape(F.col("path")).alias("shape"), "blocked").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), is_(True).alias("blocked"), is_(False).alias("allowed"))
    rows = scratch.keep(shapes, "urltree-shapes")
    total, blocked, allowed = (x or 0 for x in rows.agg(F.sum("n"), F.sum("blocked"), F.sum("allowed")).first())
    hosts = rows.groupBy("host").agg(F.sum("n").alias("node_n"), F.sum("n").alias("_w"))
    rows = scratch.keep(looked_up(rows.withColumn("node", F.lit("")), hosts, ["host"], "_w", total), "urltree-rows")
    ended = []
    for depth in range(MOST_DEPTH + 1):
        ended.append(rows.where(F.size("shape") <= depth).drop("node_n"))
        going = rows.where(F.size("shape") > depth).withColumn("name", F.element_at("shape", depth + 1))
        if going.isEmpty():
            break
        after = F.try_element_at("shape", F.lit(depth + 2))
        of = {"ending": after.isNull(), "numbered": F.coalesce(F.contains(after, F.lit("{n}")), F.lit(False))}
        sums = [F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"), *(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in of.items())]
        segments = going.groupBy("host", "node", "name").agg(*sums, F.max("node_n").alias("node_n"))
        own = (F.col("n") >= LEAST_URLS) & (F.col("n") >= LEAST_SHARE * F.col("node_n"))
        branches = segments.withColumn("name", F.when(own, F.col("name")).otherwise("*")).groupBy("host", "node", "name").agg(*(F.sum(c).alias(c) for c in ("n", *SHARES)))
        nodes = branches.groupBy("host", "node").agg(F.collect_list(F.struct("name", "n", *SHARES)).alias("branches"))
        to = scratch.keep(_merged(nodes).join(branches.select("host", "node", "name", F.col("n").alias("_w")), ["host", "node", "name"]), "urltree-branches")
        met = looked_up(going.drop("node_n"), to.where("name <> '*'"), ["host", "node", "name"], "_w", total)
        rest = looked_up(met.where("branch is null").drop("branch", "urls"), to.where("name = '*'").drop("name"), ["host", "node"], "_w", total)
        next_ = met.where("branch is not null").unionByName(rest).withColumn("node", F.concat_ws("/", "node", "branch"))
        rows = scratch.keep(next_.withColumnRenamed("urls", "node_n").drop("name", "branch"), "urltree-rows")
    leaves = scratch.keep(reduce(DataFrame.unionByName, ended), "urltree-leaves")
    prior = blocked / (blocked + allowed) if blocked + allowed else 0.0
    templates = leaves.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    purity = (F.col("blocked") + PRIOR_WEIGHT * prior) / (F.col("blocked") + F.col("allowed") + PRIOR_WEIGHT)
    templates = templates.withColumn("purity", purity).withColumn("rejected", (F.col("purity") >= REJECT) & (F.col("blocked") > 0)).withColumn("_w", F.col("n"))
    own = leaves.select("host", "shape", "node", F.col("n").alias("shape_n"))
    out = stored(looked_up(own, templates, ["host", "node"], "_w", total).withColumnRenamed("node", "template"), "urltree-templates")
    scratch.drop_all_but()
    return out


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep``, host, path, rule and verdict of every row.

    A null url and one without ``://`` have an empty host and path, and the template of those.
    Repeated rows are answered as often as they occur and count as often in the templates; an
    empty table gives an empty one; rules of equal length go by verdict, host and path; columns
    that aren't in ``keep`` have no part in the result.
    """
    host, path = host_and_path(F.col(url))
    split = pages.select(*keep, host.alias("host"), path.alias("path"))
    own = split.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    templates = learn(own.select("host", "path", (F.col("_fit.verdict") == "block").alias("blocked")))
    # only shapes that urls without a rule have are looked up
    total = templates.agg(F.sum("shape_n")).first()[0] or 0
    found = looked_up(own.where("_fit is null").withColumn("shape", shape(F.col("path"))), templates.where("rejected").select("host", "shape", "rejected", "shape_n"), ["host", "shape"], "shape_n", total)
    names = [*keep, "host", "path"]
    by_rule = own.where("_fit is not null").select(*names, "_fit.rule", "_fit.verdict")
    by_tree = found.select(*names, F.lit(None).cast("string").alias("rule"), F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow").alias("verdict"))
    return by_rule.unionByName(by_tree)
