"""Mixing sources to target weights: hierarchical token budgets, then a seeded token prefix of each leaf.

A leaf is (domain, lang, source).  Weights are whole numbers per value of a
level, 1 unless given.  The total budget goes down the tree: a node's children
share it by weight; a child that holds less than its share gives the rest to
its siblings.  A child's capacity is that of all its leaves, so a shortage
moves to another branch only when all siblings are full.  Shares are whole
tokens, rounded down.

A leaf gives its tokens as often as its budget holds them whole (epochs), then
a prefix of the next epoch: its documents in an order drawn from seed, epoch and
id, while the running sum stays within what is left.  Nothing is sorted as a
whole: sums over prefixes of the drawn number find the one small bucket where
the budget ends, and only its rows are ordered; each document then compares its
number with the leaf's.

A token is a run of characters other than space and ``\\x09-\\x0D``; NULL text
has none.  NULL lang, source and domain are leaves of their own.  Rows without
``doc_id`` share one drawn number; repeated ids are taken together.  Documents without tokens
are taken while the prefix has not passed them.  An empty table gives an empty
one.  Children with equal capacity per weight are ordered by name.  A document
is taken or left whole, however long.  Further columns of the input, whatever
their names, come back untouched inside ``row``.  Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.sources.writers import cut_lineage

LEVELS = ("domain", "lang", "source")
BUCKET = 1024  # rows in the bucket where a prefix ends, about


def token_count(text="text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def drawn(seed: int, epoch: Column) -> Column:
    """32 hex digits from seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    given = weights.get(level, {})
    if not given:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for x in chain(*given.items())])
    return F.coalesce(F.element_at(table, F.coalesce(F.col(level), F.lit(""))), F.lit(1)).cast("long")


def share(children: DataFrame, parent: tuple[str, ...]) -> DataFrame:
    """``children (weight, capacity, budget of the parent)`` with ``share``: filled up to capacity, the rest by weight."""
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rise = of.orderBy((F.col("capacity") / F.col("weight")), "name")
    before = F.coalesce(F.sum("capacity").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(rise.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = F.col("capacity") * after <= F.col("weight") * (F.col("budget") - before)
    out = children.withColumn("full", full)
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(of)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(of)
    out = out.withColumn("left", left).withColumn("open", open_weight)
    part = F.expr("weight * left DIV open")
    return out.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("full", "left", "open")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], budget_permille: int, max_epochs: int) -> DataFrame:
    """``leaves (domain, lang, source, tokens)`` with ``share``, the tokens each has to give."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg(F.expr(f"sum(tokens) * {budget_permille} DIV 1000").alias("wanted"), F.sum("capacity").alias("most"))
    above, keys = None, ()
    for i, level in enumerate(LEVELS):
        own = LEVELS[: i + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", weight(level, weights)).withColumn("name", F.coalesce(level, F.lit("")))
        if above is None:
            row = total.select(F.least("wanted", "most").alias("budget")).first()
            nodes = nodes.withColumn("budget", F.lit(row.budget or 0).cast("long"))
        else:
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
            nodes = nodes.alias("n").join(above.alias("a"), same).select("n.*", F.col("a.share").alias("budget"))
        keys = own
        above = share(nodes, own[:-1]).select(*own, "share")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"a.{k}")) for k in LEVELS]
    return leaves.alias("l").join(above.alias("a"), same).select("l.*", "a.share")


def cutoffs(sized: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Leaves with ``whole`` epochs and ``cutoff``, the last drawn number of the next epoch's prefix (NULL: none)."""
    leaves = leaves.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("share DIV tokens")).otherwise(0))
    leaves = leaves.withColumn("rest", F.col("share") - F.col("whole") * F.col("tokens"))
    digits = F.ceil(F.log(16.0, F.greatest(F.col("rows") / F.lit(BUCKET), F.lit(1.0)))).cast("int")
    leaves = leaves.withColumn("digits", digits).withColumn("leaf", F.xxhash64(*[F.coalesce(k, F.lit("\0")) for k in LEVELS]))
    leaves = cut_lineage(leaves, "leaves")
    partial = leaves.filter("rest > 0 OR tokens = 0").select("leaf", "whole", "rest", "digits")
    rows = sized.withColumn("leaf", F.xxhash64(*[F.coalesce(k, F.lit("\0")) for k in LEVELS])).join(partial, "leaf")
    rows = rows.withColumn("number", drawn(seed, F.col("whole") + 1))
    rows = rows.withColumn("fine", F.expr("left(number, digits)")).withColumn("coarse", F.expr("left(number, digits DIV 2)"))
    fine = rows.groupBy("leaf", "rest", "coarse", "fine").agg(F.sum("n_tokens").alias("n"))
    fine = cut_lineage(fine, "prefixes")
    to_here = (Window.unboundedPreceding, Window.currentRow)
    coarse = fine.groupBy("leaf", "coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.withColumn("before", F.sum("n").over(Window.partitionBy("leaf").orderBy("coarse").rowsBetween(*to_here)) - F.col("n"))
    fine = fine.join(coarse.drop("n"), ["leaf", "coarse"])
    upto = F.sum("n").over(Window.partitionBy("leaf", "coarse").orderBy("fine").rowsBetween(*to_here))
    fine = fine.withColumn("before", F.col("before") + upto - F.col("n")).filter("before <= rest")
    last = fine.groupBy("leaf").agg(F.max(F.struct("fine", "before")).alias("edge"))
    edge = rows.join(last.select("leaf", F.col("edge.fine").alias("fine"), F.col("edge.before").alias("before")), ["leaf", "fine"])
    order = Window.partitionBy("leaf", "fine").orderBy("number").rangeBetween(*to_here)
    edge = edge.withColumn("sum", F.col("before") + F.sum("n_tokens").over(order)).filter("sum <= rest")
    within = edge.groupBy("leaf").agg(F.max("number").alias("exact"))
    # with no row of the last bucket inside, everything before that bucket is the prefix
    cut = last.join(within, "leaf", "left").select("leaf", F.coalesce("exact", F.col("edge.fine")).alias("cutoff"))
    return leaves.join(cut, "leaf", "left")


def mixed(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, Mapping[str, int]],
    budget_permille: int = 1000,
    max_epochs: int = 4,
    seed: int = 17,
) -> DataFrame:
    """One row per epoch a document is taken in: doc_id, domain, lang, source, n_tokens, epoch, and the input's ``row`` as a struct."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select("doc_id", domain.cast("string").alias("domain"), "lang", "source", token_count().alias("n_tokens"), row)
    sized = cut_lineage(rows.drop("row"), "sized")
    leaves = sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    cuts = cut_lineage(cutoffs(sized, budgets(leaves, weights, budget_permille, max_epochs), seed), "cutoffs")
    cuts = cuts.select("leaf", "whole", "cutoff")
    out = rows.withColumn("leaf", F.xxhash64(*[F.coalesce(k, F.lit("\0")) for k in LEVELS])).join(cuts, "leaf")
    inside = F.coalesce((drawn(seed, F.col("whole") + 1) <= F.col("cutoff")).cast("long"), F.lit(0))
    out = out.withColumn("times", F.col("whole") + inside).filter("times > 0")
    return out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("leaf", "whole", "cutoff", "times")
