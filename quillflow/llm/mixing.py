"""Operator 1: mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled (by a hash of id and text) and get a
virtual finish time: the source's tokens up to and with the document, divided by
the source's target.  A source whose target exceeds its size is queued again, up
to ``max_repeats`` times.  All queued documents are sorted by finish time and
the queue is cut at the total budget.

Neither the running sums of a source nor the global sort meet in one task.
Running sums have two levels: sums by bucket of the shuffle hash, then sums
within a bucket.  The global order has known even boundaries, since every source
emits its target's tokens per unit of virtual time: a histogram over slices of
finish time finds the slice with the cut, slices of that one follow until it has
EDGE rows at most, and only these are sorted.  All documents take their place by the
shuffle alone: a source misses its target by its longest document at most.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; equal rows share one place in the queue and are taken or left
together; an empty table gives an empty table; columns other than doc_id, text
and source play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize, small

WORD = r"[^\x20\x09-\x0D]+"
#: Virtual time is 1 where every source has emitted its target; the queue is not served beyond this time.
LAST_TIME = 4
#: Most rows of the slice with the cut that one task sorts; a larger slice is cut into slices again.
EDGE = 1 << 17


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """From (source, source_size): (sid, source, source_size, target).  Weights repeat over the sources by code point, null last; targets share the total by weight and stop at max_repeats times a source's size, the excess reshared (water filling in closed form).  One row per source: the windows here hold the list of sources, not documents."""
    order = W.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("sid", F.row_number().over(order)).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "sid")
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = ranked.withColumn("level", level).withColumn("ratio", F.col("cap") / F.col("w"))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "sid", "level"))).over(W.partitionBy())["level"]
    target = F.when(first.isNull() | (F.col("ratio") <= first), F.col("cap")).otherwise(first * F.col("w"))
    return leveled.withColumn("target", target).select("sid", "source", "source_size", "target")


def mix(docs: DataFrame, weights=(5, 2, 1), max_repeats: int = 3, seed: int = 17, buckets_log2: int = 12, slices: int = 4096) -> DataFrame:
    """(doc_id, size, source, source_size, target, repeats, taken) for every row of docs (doc_id, text, source)."""
    rows = docs.select(
        "doc_id", "source", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    rows = materialize(rows, "sizes", scan=True)
    targets = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "targets", few=True)
    t = small(targets.withColumnRenamed("source", "_source"))
    queued = rows.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queued = queued.withColumn("bucket", F.shiftrightunsigned("h", 64 - buckets_log2))
    sums = queued.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    ahead = F.coalesce(F.sum("s").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.select("sid", "bucket", ahead.alias("ahead"))
    # the default frame of an ordered window is RANGE: rows equal in (h, doc_id) share their sum
    within = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("h", "doc_id"))
    queued = queued.withColumn("within", within).join(ahead, ["sid", "bucket"]).withColumn("c", F.col("ahead") + F.col("within"))
    queued = materialize(queued.select("doc_id", "source", "h", "size", "source_size", "target", "c"), "queue")

    def finish(k: int):
        return F.when((F.col("target") > 0) & (F.col("size") > 0), (F.lit(k) * F.col("source_size") + F.col("c")) / F.col("target"))

    rounds = range(max_repeats)
    emitted = queued.select("h", "doc_id", "size", F.explode(F.array(*[finish(k) for k in rounds])).alias("f")).where(F.col("f") < LAST_TIME)
    left = targets.agg(F.coalesce(F.round(F.sum("target")), F.lit(0.0)).cast("long")).first()[0]
    low, width, last = 0.0, float(LAST_TIME), None
    for _ in range(4):  # 4096 ** 4 slices are finer than the finish times themselves
        step = width / slices
        here = emitted.withColumn("slice", F.least(F.floor((F.col("f") - F.lit(low)) / step), F.lit(slices - 1)))
        by_slice = here.groupBy("slice").agg(F.sum("size").alias("s"), F.count("*").alias("n"))  # slices rows at most
        running = by_slice.withColumn("through", F.sum("s").over(W.orderBy("slice")))
        cut = running.where(F.col("through") > left).orderBy("slice").first()
        if cut is None:
            last = (low + width, -(2**63))
            break
        left -= cut["through"] - cut["s"]
        emitted, low, width = here.where(F.col("slice") == cut["slice"]).drop("slice"), low + cut["slice"] * step, step
        if cut["n"] <= EDGE:
            break
    if last is None:
        edge = emitted.withColumn("through", F.sum("size").over(W.orderBy("f", "h", "doc_id")))
        key = edge.where(F.col("through") <= left).agg(F.max(F.struct("f", "h"))).first()[0]
        last = (key["f"], key["h"]) if key else (low, -(2**63))
    f_cut, h_cut = F.lit(last[0]), F.lit(last[1])
    served = [F.when((finish(k) < f_cut) | ((finish(k) == f_cut) & (F.col("h") <= h_cut)), 1).otherwise(0) for k in rounds]
    repeats = sum(served[1:], served[0])
    return queued.withColumn("repeats", repeats.cast("int")).select(
        "doc_id", "size", "source", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken")
    )
