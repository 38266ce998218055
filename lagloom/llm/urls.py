"""URL filter: given rules first, then path templates learnt per host.

The paths of a host form a tree of segments.  Level by level a segment stays as
it is where it carries enough of its node's pages and the labels below it
differ from those of its siblings; the others are merged into a wildcard:
segments too rare to say anything, and branches whose share of bad labels is
statistically the same as their node's.  A template is the chain of kept
segments and wildcards.  Its purity is the share of bad labels, smoothed towards
its host's, and that towards the share of all pages; a template is rejected
from ``reject`` on.

Only counts are moved: a node's pages are never gathered.  What a segment needs
is a number of pages, whatever the size of its host; a node may keep any number
of segments.  The levels go on until no page has a further segment in a node
that can still be divided, one with ``least`` pages and labels of both kinds;
what lies below the other nodes folds into one wildcard.  NULL urls and urls
without ``://`` have an empty host and path and are judged like any other.
Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.sources.writers import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.contains(F.coalesce(url, F.lit("")), F.lit("://"))
    rest = F.when(has, F.substr(url, F.position(F.lit("://"), url) + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; ``rules`` are (verdict, ``host/path``)."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def templates(pages: DataFrame, least: int, z: float) -> DataFrame:
    """``pages (row, host, path, bad)`` with ``template``; ``bad`` is 1, 0 or NULL (no label)."""
    columns = pages.columns
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    pages = cut_lineage(pages.withColumn("segments", segments).withColumn("template", F.lit("")), "templates")
    level, done = 0, None
    while True:
        pages = pages.withColumn("segment", F.get("segments", F.lit(level)))
        inner = pages.filter("segment IS NOT NULL")
        counts = [F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads")]
        node = inner.groupBy("host", "template").agg(*counts).withColumnsRenamed({c: f"node_{c}" for c in ("n", "labelled", "bads")})
        # in the others no branch can differ from its siblings, at this level or below
        node = node.filter((F.col("node_n") >= least) & (F.col("node_bads") > 0) & (F.col("node_bads") < F.col("node_labelled")))
        node = cut_lineage(node, "nodes")
        folded = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/" + WILD)))
        if node.isEmpty():
            last = pages.withColumn("template", folded).select(*columns, "template")
            return last if done is None else done.union(last)
        branch = inner.groupBy("host", "template", "segment").agg(*counts)
        enough = branch.filter(F.col("n") >= least).join(node, ["host", "template"])
        others = F.col("node_labelled") - F.col("labelled")
        rate = (F.col("node_bads") + 0.5) / (F.col("node_labelled") + 1)
        error = F.sqrt(rate * (1 - rate) * (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
        gap = F.col("bads") / F.greatest("labelled", F.lit(1)) - (F.col("node_bads") - F.col("bads")) / F.greatest(others, F.lit(1))
        differs = (F.col("labelled") > 0) & (others > 0) & (F.abs(gap) > z * error)
        kept = enough.filter(differs).select("host", "template", "segment", F.col("segment").alias("kept"))
        kept = cut_lineage(kept, "kept")  # a join with a stored side can split a large branch
        split = node.select("host", "template", F.lit(True).alias("split"))
        pages = pages.join(split, ["host", "template"], "left").join(kept, ["host", "template", "segment"], "left")
        goes_on = F.col("split").isNotNull() & F.col("segment").isNotNull()
        step = F.concat("template", F.lit("/"), F.coalesce("kept", F.lit(WILD)))
        pages = pages.withColumn("template", F.when(goes_on, step).otherwise(folded)).withColumn("goes_on", goes_on)
        pages = cut_lineage(pages.select(*columns, "segments", "template", "goes_on"), "templates")
        ended = pages.filter("NOT goes_on").select(*columns, "template")
        done = ended if done is None else done.union(ended)
        pages = pages.filter("goes_on").drop("goes_on")
        level += 1


def judged(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    labels: DataFrame,
    least: int = 5,
    z: float = 1.96,
    smoothing: float = 8.0,
    reject: float = 0.5,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    ``labels (host, path, bad)`` holds one row per labelled page address.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    one = labels.groupBy("host", "path").agg(F.max("bad").cast("int").alias("bad"))
    rows = templates(rows.join(one, ["host", "path"], "left"), least, z)
    counts = rows.groupBy("host", "template").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads"))
    counts = cut_lineage(counts, "counts")
    whole = counts.agg(F.sum("labelled").alias("labelled"), F.sum("bads").alias("bads")).first()
    prior = ((whole.bads or 0) + 0.5) / ((whole.labelled or 0) + 1)
    by_host = counts.groupBy("host").agg(
        ((F.sum("bads") + smoothing * prior) / (F.sum("labelled") + smoothing)).alias("host_purity")
    )
    purity = (F.col("bads") + smoothing * F.col("host_purity")) / (F.col("labelled") + smoothing)
    scored = counts.join(by_host, "host").select("host", "template", purity.alias("purity"))
    out = rows.join(scored, ["host", "template"], "left")
    rule, verdict = rule_for(rules, F.col("host"), F.col("path"))
    learnt = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "template", "purity")
