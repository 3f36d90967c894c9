"""URL filter: hand-written rules first, then a tree of path templates for each host.

A path becomes a shape: its segments, every run of digits as ``#``. Level by level, the segments below a node of a host's
tree are generalised: where there are more than ``BRANCHES`` of them, those with less than a ``BRANCHES``-th of the node's
pages are the wildcard ``*``. The at most ``BRANCHES`` + 1 branches left are then merged where they do not differ: the largest first,
a branch joins the first group whose shapes further down (chi-square over hashed shapes) and whose share of rejected labels
(two proportions) it shares within ``Z`` standard errors. What the levels leave of a shape is its template, and a template is
rejected where its labelled purity, smoothed by its host's and that by the overall one, reaches ``REJECT``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm.common import discard, look_up, materialize

#: Host and path, what they are judged.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BRANCHES = 32
#: Segments of a template; what a longer path has further down is ``**``.
LEVELS = 12
#: Hashed shapes below a branch, for the comparison of branches.
SHAPES = 32
Z = 3.0
#: Pages that the prior counts as, and the part of a page that each page without a label adds to it.
PRIOR, SILENT = 10.0, 0.1
REJECT = 0.8


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) text behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct of rule and verdict: the longest rule whose host is ``host`` or a parent of it and whose path begins ``path``; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        top, _, start = rule.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shape(path: Column) -> Column:
    """Segments of a path with ``#`` for digits; deep paths end in ``**``."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#"), "/")
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(parts)
    return F.when(F.size(parts) > LEVELS, F.concat(F.slice(parts, 1, LEVELS), F.array(F.lit("**")))).otherwise(parts)


def _differ(a: dict[int, int], b: dict[int, int]) -> bool:
    """Two-sample chi-square of counts by hashed shape, against the ``Z`` quantile by Wilson and Hilferty."""
    free = len(a.keys() | b.keys()) - 1
    if free == 0:
        return False
    ratio = math.sqrt(sum(b.values()) / sum(a.values()))
    x = sum((ratio * a.get(k, 0) - b.get(k, 0) / ratio) ** 2 / (a.get(k, 0) + b.get(k, 0)) for k in sorted(a.keys() | b.keys()))
    return x > free * (1 - 2 / (9 * free) + Z * math.sqrt(2 / (9 * free))) ** 3


def _unlike(la: int, ra: int, lb: int, rb: int) -> bool:
    """Shares of rejected labels (ra of la, rb of lb) that lie apart; without labels on both sides nothing speaks against a merge."""
    if not la or not lb:
        return False
    pooled = (ra + rb + 1) / (la + lb + 2)
    return abs((ra + 0.5) / (la + 1) - (rb + 0.5) / (lb + 1)) > Z * math.sqrt(pooled * (1 - pooled) * (1 / (la + 1) + 1 / (lb + 1)))


def merge_branches(branches: list[tuple[str, dict[int, int], int, int]]) -> dict[str, str]:
    """Segment to the name of its group, for segments (name, counts by hashed shape, labels, rejected labels) of one node."""
    groups: list[list] = []
    for name, counts, labels, rejected in sorted(branches, key=lambda b: (-sum(b[1].values()), b[0])):
        for g in groups:
            if not _differ(g[1], counts) and not _unlike(g[2], g[3], labels, rejected):
                g[0].append(name)
                g[1] = {k: g[1].get(k, 0) + counts.get(k, 0) for k in g[1].keys() | counts.keys()}
                g[2], g[3] = g[2] + labels, g[3] + rejected
                break
        else:
            groups.append([[name], counts, labels, rejected])
    many = [g for g in groups if len(g[0]) > 1]
    named = {id(g): "*" if k == 0 else f"*{k + 1}" for k, g in enumerate(sorted(many, key=lambda g: "*" not in g[0]))}
    return {name: named.get(id(g), name) for g in groups for name in g[0]}


def _merged(column: pd.Series) -> pd.Series:
    def one(cells) -> list[dict]:
        branches: dict[str, list] = {}
        for c in cells:
            b = branches.setdefault(c["seg"], [c["seg"], {}, 0, 0])
            b[1][c["below"]] = b[1].get(c["below"], 0) + c["n"]
            b[2], b[3] = b[2] + c["labels"], b[3] + c["rejected"]
        return [{"seg": seg, "into": into} for seg, into in merge_branches([tuple(b) for b in branches.values()]).items()]

    return column.map(one)


def path_templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` (host, shape array<string>; n, labels, rejected long; each host and shape once) with ``template``.

    One round for each level of the deepest path. Branches of a node are counted by (host, node, segment, hashed shape below)
    before anything meets, so a node's row holds at most (``BRANCHES`` + 1) * ``SHAPES`` cells however many pages its host has.
    """
    merge = F.pandas_udf(_merged, "array<struct<seg:string,into:string>>")
    rows = materialize(shapes.withColumn("template", F.lit("")).withColumn("at", F.lit(0)))
    while True:
        todo = rows.filter("at < size(shape)")
        left = todo.count()
        if left == 0:
            return rows.drop("at")
        open_ = todo.select("host", "template", F.expr("shape[at]").alias("seg"), F.expr(f"cast(pmod(xxhash64(slice(shape, at + 2, {LEVELS + 1})), {SHAPES}) as int)").alias("below"), "n", "labels", "rejected")
        cells = materialize(open_.groupBy("host", "template", "seg", "below").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("rejected").alias("rejected"), F.count(F.lit(1)).alias("rows")))
        segs = cells.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
        nodes = segs.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("pages"))
        many = nodes.filter(F.col("kinds") > BRANCHES)
        segs = segs.join(many, ["host", "template"], "left").withColumn("rare", F.coalesce(F.col("n") * BRANCHES < F.col("pages"), F.lit(False)))
        rare = segs.select("host", "template", "seg", "rare", "rows")
        counted = cells.drop("rows").join(rare, ["host", "template", "seg"]).withColumn("seg", F.when(F.col("rare"), F.lit("*")).otherwise(F.col("seg")))
        counted = counted.groupBy("host", "template", "seg", "below").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("rejected").alias("rejected"))
        groups = counted.groupBy("host", "template").agg(F.collect_list(F.struct("seg", "below", "n", "labels", "rejected")).alias("cells"))
        into = groups.select("host", "template", F.explode(merge("cells")).alias("m")).select("host", "template", F.col("m.seg").alias("key"), F.col("m.into").alias("into"))
        named = rare.withColumn("key", F.when(F.col("rare"), F.lit("*")).otherwise(F.col("seg"))).join(into, ["host", "template", "key"]).withColumn("seg", F.when(F.col("seg") == "", F.lit("/")).otherwise(F.col("seg")))
        step = materialize(named.filter("into <> seg").select("host", "template", "seg", "into", "rows"))
        moving = rows.withColumn("seg", F.expr("CASE WHEN at < size(shape) THEN if(shape[at] = '', '/', shape[at]) END"))
        moving = look_up(moving, step, ["host", "template", "seg"], ["into"], "rows", left, F.struct("host", "shape"))
        moved = materialize(
            moving.select("host", "shape", "n", "labels", "rejected", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("into", F.expr("shape[at]")))).alias("template"), F.expr("least(at + 1, size(shape))").alias("at"))
        )
        discard(rows, cells, step)
        rows = moved


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, label_col: str | None = None) -> DataFrame:
    """id, host, path, rule, verdict, template and purity for every row of ``pages``.

    The longest rule decides; elsewhere the template does. Labels are the rules' verdicts and, where no rule fits, those of
    ``label_col`` (true: rejected; null: none). A url that is null or has no ``://`` has an empty host and path. Every row
    counts and is judged by itself, repeated or not; an empty table gives an empty one; other columns are not read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    given = F.col(label_col).cast("boolean") if label_col else F.lit(None).cast("boolean")
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), given.alias("given")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    urls = urls.withColumn("shape", _shape(F.col("path"))).withColumn("label", F.coalesce(F.col("r.verdict") == "block", F.col("given")))
    sums = (F.count(F.lit(1)).alias("n"), F.count("label").alias("labels"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("rejected"))
    rows = materialize(path_templates(urls.groupBy("host", "shape").agg(*sums)))
    whole = rows.agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("rejected").alias("rejected"), F.count(F.lit(1)).alias("rows")).first()
    overall = (whole["rejected"] or 0) / whole["labels"] if whole["labels"] else 0.0
    weight = lambda t: F.lit(PRIOR) + SILENT * (F.col(f"{t}n") - F.col(f"{t}labels"))
    rate = lambda t, prior: (F.col(f"{t}rejected") + weight(t) * prior) / (F.col(f"{t}labels") + weight(t))
    add = lambda t: [F.sum(c).alias(f"{t}{c}") for c in ("n", "labels", "rejected")]
    templates = rows.groupBy("host", "template").agg(*add(""), F.count(F.lit(1)).alias("rows"))
    hosts = templates.groupBy("host").agg(*add("h_"), F.count(F.lit(1)).alias("held")).select("host", "held", rate("h_", F.lit(overall)).alias("prior"))
    templates = look_up(templates, hosts, ["host"], ["prior"], "held", whole["rows"], F.col("template"))
    templates = templates.select("host", "template", "rows", F.round(rate("", F.col("prior")), 6).alias("purity"))
    rows = look_up(rows, templates, ["host", "template"], ["purity"], "rows", whole["rows"], F.col("shape"))
    known = rows.select("host", F.to_json("shape").alias("key"), "n", "template", "purity")
    out = look_up(urls.withColumn("key", F.to_json("shape")), known, ["host", "key"], ["template", "purity"], "n", whole["n"] or 0, F.struct("id", "path"))
    verdict = F.coalesce("r.verdict", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
