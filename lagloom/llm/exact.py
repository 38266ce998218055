"""Exact duplicates through an extendible-hash index kept as a table in the shared folder.

Every text has a 64-bit key.  The directory starts with one bucket; a bucket
with more than ``capacity`` keys is split by the next bit of the key, doubling
the directory where no spare bit is left, so every key belongs to the shortest
prefix whose bucket fits.  Keys seen once need no text.  The texts of keys seen
more often go to the task that owns the key's bucket, which chains different
texts of one key by comparing their bytes.  The index (bucket, key, place in
the chain, digest, document that stays, number of copies) is written as a table
sorted by bucket, and every document looks its text up there.

Equal texts are first combined where they are read, so a text that fills a
third of the table reaches its owner as one row per task.  NULL counts as the
empty text.  The row with the largest ``doc_id`` stays; rows without ``doc_id``
stay only if no equal text has one, then all of them.  Repeated rows count as
copies.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.sources.session import ship
from lagloom.sources.writers import cut_lineage

CAPACITY = 1 << 14


def prefix(key: str, depth: int) -> Column:
    """The top ``depth`` bits of a 64-bit key; no bits give 0."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, depth, bucket) for every slot of the directory, and the directory's depth.

    ``keys (key)`` are distinct.  Each round doubles the directory four times
    until no slot is overfull; then every slot belongs to the shortest prefix
    that fits.  The table has about ``keys / capacity`` rows and is never collected.
    """
    depth = 0
    while True:
        slots = keys.groupBy(prefix("key", depth).alias("slot")).agg(F.count("*").alias("n"))
        worst = slots.agg(F.max("n")).first()[0] or 0
        if worst <= capacity or depth >= 60:
            break
        depth += 4
    above = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    above = above.withColumn("bucket", F.expr(f"shiftrightunsigned(slot, CAST({depth} - depth AS INT))"))
    fit = above.groupBy("depth", "bucket").agg(F.sum("n").alias("n")).filter((F.col("n") <= capacity) | (F.col("depth") == depth))
    chosen = above.drop("n").join(fit.select("depth", "bucket"), ["depth", "bucket"])
    chosen = chosen.groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("b"))
    return chosen.select("slot", "b.depth", "b.bucket"), depth


def chain(batches):
    """Owner task: rows arrive sorted by bucket and key; texts of one key are told apart byte by byte."""
    key, held = None, []
    done: list[tuple] = []
    names = ["bucket", "depth", "key", "link", "sha", "keep_id", "group_size"]

    def flushed():
        for link, (bucket, depth, raw, keep, size) in enumerate(held):
            done.append((bucket, depth, key, link, hashlib.sha256(raw).hexdigest(), keep, size))

    def batch_of(rows):
        schema = pa.schema([(n, pa.string() if n == "sha" else pa.int32() if n in ("depth", "link") else pa.int64()) for n in names])
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "depth", "key", "raw", "keep_id", "group_size")]
        for bucket, depth, k, raw, keep, size in zip(*columns):
            if k != key:
                flushed()
                key, held = k, []
            for i, other in enumerate(held):
                if other[2] == raw:
                    best = max((x for x in (other[3], keep) if x is not None), default=None)
                    held[i] = (bucket, depth, raw, best, other[4] + size)
                    break
            else:
                held.append((bucket, depth, raw, keep, size))
        if len(done) > 10_000:
            yield batch_of(done)
            done.clear()
    flushed()
    yield batch_of(done)


def build_index(docs: DataFrame, keyed: DataFrame, text: Column, key: Column, capacity: int = CAPACITY) -> DataFrame:
    counts = cut_lineage(
        keyed.groupBy("key").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.min("sha").alias("sha")),
        "keys",
    )
    slots, depth = directory(counts.select("key"), capacity)
    placed = counts.withColumn("slot", prefix("key", depth)).join(slots, "slot")
    single = placed.filter("group_size = 1").select(
        "bucket", "depth", "key", F.lit(0).alias("link"), "sha", "keep_id", "group_size"
    )
    many = placed.filter("group_size > 1").select("bucket", "depth", "key")
    texts = docs.select(F.col("doc_id").cast("long"), key.alias("key"), text.alias("text"))
    copies = texts.join(many.select("key"), "key", "left_semi").groupBy("key", "text")
    copies = copies.agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    copies = copies.join(many, "key").withColumn("raw", F.col("text").cast("binary")).drop("text")
    ship(docs.sparkSession)
    owned = copies.repartition("bucket").sortWithinPartitions("bucket", "key")
    schema = "bucket long, depth int, key long, link int, sha string, keep_id long, group_size long"
    chained = owned.mapInArrow(chain, schema)
    return cut_lineage(single.unionByName(chained).sortWithinPartitions("bucket", "key"), "index")


def exact_duplicates(docs: DataFrame, normalise=None, capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(normalise(F.col("text")) if normalise else F.col("text"), F.lit(""))
    key = F.xxhash64(text)
    keyed = docs.select(F.col("doc_id").cast("long"), key.alias("key"), F.sha2(text.cast("binary"), 256).alias("sha"))
    keyed = cut_lineage(keyed, "keyed")
    index = build_index(docs, keyed, text, key, capacity)
    out = keyed.join(index.select("key", "sha", "keep_id", "group_size"), ["key", "sha"], "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return out.select("doc_id", "keep_id", "group_size", kept, F.col("sha").alias("text_sha256"))
