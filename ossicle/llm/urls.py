"""URL filters: host and path rules, and a path-template tree for what no rule decides.

DataFrame operations only.  Per host, paths become templates: digits and long hexadecimal runs
are wildcards at once, and a segment turns into ``*`` under a parent that has more different
children than ``most_children``, level by level from the host; what lies below ``depth`` segments is one
wildcard.  Templates under one parent whose labelled bad shares don't differ significantly are merged: those with ``few`` labels
or more form branches, each template being compared with the whole branch so far, and the others then take
the evidence of the nearest branch on top of their own, while those without labels go by their host's.
A template is rejected if its branch's share of bad labelled pages, smoothed towards its host's and that towards
the whole table's by ``prior`` labels, reaches ``reject_at``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """Then up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.

    A rule ``host/path`` fits its host and all subdomains if the path starts with its path.
    Of rules as long as each other the first wins.  The rules are part of the plan: a short list.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, action in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}" if "/" in text else "")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """The path with digit and long hexadecimal runs as ``#``."""
    return F.regexp_replace(path, r"[0-9A-Fa-f]{16,}|[0-9]+", "#")


def _templates(shapes: DataFrame, most_children: int, depth: int, work: Workspace) -> DataFrame:
    """Adds template and parent to shapes (host, shape, ...); segments below ``depth`` fold into one.

    Each level is written, as the next one's plan holds it twice.
    """
    out = shapes.withColumn("_segs", F.split("shape", "/")).withColumns({"template": F.lit(""), "parent": F.lit("")})
    for level in range(2, depth + 2):
        seg = F.when(F.size("_segs") < level, F.lit(None)).otherwise(F.get("_segs", F.lit(level - 1)))
        if level == depth + 1:
            seg = F.when(seg.isNotNull(), F.lit("**"))
        out = out.withColumn("_seg", seg)
        kids = out.where("_seg is not null").groupBy("host", "template", "_seg").agg(F.count("*").alias("_c"))
        many = kids.groupBy("host", "template").agg(F.count("*").alias("_kids")).where(F.col("_kids") > most_children).drop("_kids")
        out = out.join(many.withColumn("_many", F.lit(True)), ["host", "template"], "left")
        name = F.when(F.col("_many").isNotNull() & (F.col("_seg") != ""), "*").otherwise(F.col("_seg"))
        grown = F.when(F.col("_seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), name))
        out = out.withColumn("parent", F.when(F.col("_seg").isNull(), F.col("parent")).otherwise(F.col("template"))).withColumn("template", grown).drop("_many", "_seg")
        out = work.write(out, f"level{level}")
    return out.drop("_segs")


def _apart(l1: Column, b1: Column, l2: Column, b2: Column, z: float) -> Column:
    """Whether two shares of bad labels, b of l, differ significantly (Wilson-like, half a label is added)."""
    pooled = (b1 + b2 + 0.5) / (l1 + l2 + 1.0)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / (l1 + 1.0) + 1 / (l2 + 1.0)))
    return F.abs((b1 + 0.5) / (l1 + 1.0) - (b2 + 0.5) / (l2 + 1.0)) > z * spread


def _branches(known: DataFrame, z: float) -> DataFrame:
    """(host, parent, bl, bb, names) from labelled templates: in order of their shares, each joins the branch so far unless it differs from all of that.

    A parent has ``most_children`` children and a wildcard at most, so its list is short.
    """
    each = F.array_sort(F.collect_list(F.struct(((F.col("b") + 0.5) / (F.col("l") + 1.0)).alias("share"), "template", "l", "b")))

    def step(done: Column, t: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fresh = F.struct(t["l"].alias("bl"), t["b"].alias("bb"), F.array(t["template"]).alias("names"))
        joined = F.struct((last["bl"] + t["l"]).alias("bl"), (last["bb"] + t["b"]).alias("bb"), F.concat(last["names"], F.array(t["template"])).alias("names"))
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((F.size(done) == 0) | _apart(last["bl"], last["bb"], t["l"], t["b"], z), F.concat(done, F.array(fresh))).otherwise(F.concat(before, F.array(joined)))

    none = F.expr("cast(array() as array<struct<bl:bigint,bb:bigint,names:array<string>>>)")
    return known.groupBy("host", "parent").agg(each.alias("_ts")).select("host", "parent", F.inline(F.aggregate("_ts", none, step)))


def _judged(found: DataFrame, most_children: int, depth: int, prior: float, z: float, reject_at: float, few: int, work: Workspace) -> DataFrame:
    """(host, shape, template, purity, rejected) from shapes with n, labelled and bad."""
    named = _templates(found, most_children, depth, work)
    stats = work.write(named.groupBy("host", "parent", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")), "templates")
    total = stats.agg(F.sum("b"), F.sum("l")).first()
    overall = (total[0] or 0) / max(total[1] or 0, 1)
    hosts = stats.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    branches = work.write(_branches(stats.where(F.col("l") >= few), z), "branches")
    own = branches.select("host", F.explode("names").alias("template"), "bl", "bb")
    # the rest changes no branch: with some labels it takes the evidence of the nearest branch, if it does not differ from that
    share = lambda b, l: (F.col(b) + 0.5) / (F.col(l) + 1.0)  # noqa: E731, E741
    near = stats.where((F.col("l") < few) & (F.col("l") > 0)).join(branches.drop("names"), ["host", "parent"])
    near = near.where(~_apart(F.col("bl"), F.col("bb"), F.col("l"), F.col("b"), z)).withColumn("_far", F.abs(share("bb", "bl") - share("b", "l")))
    near = near.groupBy("host", "template").agg(F.min(F.struct("_far", "bl", "bb", "l", "b")).alias("x"))
    near = near.select("host", "template", (F.col("x.bl") + F.col("x.l")).alias("bl"), (F.col("x.bb") + F.col("x.b")).alias("bb"))
    evidence = stats.join(own.unionByName(near), ["host", "template"], "left").withColumns({"bl": F.coalesce("bl", "l"), "bb": F.coalesce("bb", "b")})
    host_share = (F.col("hb") + prior * overall) / (F.col("hl") + prior)
    judged = evidence.join(hosts, "host").withColumn("purity", (F.col("bb") + prior * host_share) / (F.col("bl") + prior))
    judged = judged.withColumn("rejected", F.col("purity") >= reject_at)
    return named.select("host", "shape", "template").join(judged.select("host", "template", "purity", "rejected"), ["host", "template"])


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
    most_children: int = 16, depth: int = 5, prior: float = 8.0, z: float = 1.96, reject_at: float = 0.5, few: int = 8,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of pages.

    labels: (id, bad 0 or 1); an id with several labels is bad if one says so, null labels and
    labels of unknown pages are ignored.  The rule's verdict goes first, else block for a rejected
    template and allow for all others.  Null urls and urls without ``://`` have empty host and
    path and are judged as one host's; null ids have no label.  Repeated rows are judged each.
    """
    work = Workspace(pages.sparkSession, "urls")
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("shape", shape_of(F.col("path")))
    marks = labels.select(F.col(labels.columns[0]).cast("long").alias("page_id"), F.col(labels.columns[1]).cast("int").alias("bad")).dropna()
    marks = marks.groupBy("page_id").agg(F.max("bad").alias("bad"))
    shapes = rows.join(marks, "page_id", "left").groupBy("host", "shape")
    shapes = work.write(shapes.agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "shapes")
    known = work.write(_judged(shapes, most_children, depth, prior, z, reject_at, few, work), "known")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    said = F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow"))
    return rows.join(known, ["host", "shape"], "left").select("page_id", "host", "path", rule.alias("rule"), said.alias("verdict"), "template", "purity")
