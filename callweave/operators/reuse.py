"""Reuse distances of an access log: what a cache of any size would have hit, in one pass of joins.

The distance of an access is the number of other keys accessed since the last access to its
own. A cache that keeps the `size` keys used last hits exactly the accesses of a distance below
size. With prev the place of a key's access before, the distance of the access at place i is

    (first accesses before i) + (later accesses j < i with prev(j) < prev(i)) - prev(i)

The middle term is a count of pairs in order, taken blockwise: places and prevs are cut into
at most BLOCKS equal blocks. Pairs within a block of places, and pairs within a block of
prevs from different blocks of places, are counted in tasks of one block each; all other
pairs by a table of block sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import scratch

#: Blocks of places at most, and rows of a block at least.
BLOCKS, BLOCK_ROWS = 1000, 1 << 16


def before_and_below(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each point how many points have both a smaller x and a smaller y; the y are distinct.

    Points are merged upwards from runs of one: of two neighbouring runs in the order of x,
    the left one's points below a right one's are counted.
    """
    order = np.lexsort((-y, x))  # of equal x the greater y first, which is below none of the others
    ys, n = y[order], len(y)
    counts, place, width = np.zeros(n, np.int64), np.arange(n), 1
    while width < n:
        group, left = place // (2 * width), place // width % 2 == 0
        merged = np.lexsort((ys, group))
        lefts = np.cumsum(left[merged])
        first = np.searchsorted(group[merged], group[merged], side="left")
        own = lefts - (lefts[first] - left[merged][first])
        counts[merged] += np.where(left[merged], 0, own)
        width *= 2
    out = np.empty(n, np.int64)
    out[order] = counts
    return out


def places(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, place (from 1, by order, whose values are distinct) and prev, the place of the key's access before or null.

    Ranges of the sorted log are numbered for themselves, and a key's last place in each
    range is handed on, so that neither the log nor a hot key is ever in one task.
    """
    spark, at = log.sparkSession, scratch(log.sparkSession, "accesses")
    cut = log.select(F.col(key).alias("key"), F.struct(*order).alias("at")).repartitionByRange("at").withColumn("part", F.spark_partition_id())
    cut.write.parquet(at)
    rows = spark.read.schema(cut.schema).parquet(at)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    start = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy("at")))
    numbered = ranked.join(F.broadcast(start), F.col("part") == F.col("_part")).select("key", "part", (F.col("_start") + F.col("rank")).alias("place"))
    inside = numbered.withColumn("prev", F.lag("place").over(W.partitionBy("key", "part").orderBy("place")))
    last = numbered.groupBy("key", "part").agg(F.max("place").alias("last"))
    handed = last.select(F.col("key").alias("_key"), F.col("part").alias("_part"), F.lag("last").over(W.partitionBy("key").orderBy("part")).alias("_prev"))
    both = inside.join(handed, F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")))
    return both.select("key", "place", F.coalesce("prev", "_prev").alias("prev"))


def distances(log: DataFrame, key: str, order: list[str], blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, place, prev and distance of each access; distance is null for a key's first access.

    Null keys are a key. An empty log gives no rows.
    """
    spark, at = log.sparkSession, scratch(log.sparkSession, "places")
    found = places(log, key, order)
    found.write.parquet(at)
    rows = spark.read.schema(found.schema).parquet(at)
    n = rows.count()
    size = max(block_rows, -(-n // blocks), 1)
    block = lambda c: F.floor((F.col(c) - 1) / size).cast("int")
    rows = rows.withColumn("bi", block("place")).withColumn("bv", block("prev"))
    again = rows.where("prev is not null").select("place", "prev", "bi", "bv")

    def count(x: str, y: str):
        def run(table: pa.Table) -> pa.Table:
            values = [table.column(c).to_numpy().astype(np.int64) for c in (x, y)]
            return pa.table({"place": table.column("place"), "n": pa.array(before_and_below(*values), pa.int64())})

        return run

    def below(table: pa.Table) -> pa.Table:
        bi, bv, n = (table.column(c).to_numpy().astype(np.int64) for c in ("bi", "bv", "n"))
        grid = np.zeros((bi.max() + 2, bv.max() + 2), np.int64)
        grid[bi + 1, bv + 1] = n
        grid = grid.cumsum(0).cumsum(1)
        return pa.table({"_bi": pa.array(bi, pa.int32()), "_bv": pa.array(bv, pa.int32()), "_n": pa.array(grid[bi, bv], pa.int64())})

    near = again.groupBy("bi").applyInArrow(count("place", "prev"), "place long, n long")
    across = again.groupBy("bv").applyInArrow(count("bi", "prev"), "place long, n long")
    table = again.groupBy("bi", "bv").agg(F.count("*").alias("n")).withColumn("one", F.lit("one")).groupBy("one").applyInArrow(below, "_bi int, _bv int, _n long")  # BLOCKS squared rows at most
    far = again.join(table, (F.col("bi") == F.col("_bi")) & (F.col("bv") == F.col("_bv"))).select("place", F.col("_n").alias("n"))
    pairs = near.union(across).union(far).groupBy("place").agg(F.sum("n").alias("_pairs")).withColumnRenamed("place", "_place")

    firsts = rows.groupBy("bi").agg(F.count(F.when(F.col("prev").isNull(), 1)).alias("n"))
    firsts = firsts.select(F.col("bi").alias("_bi"), F.coalesce(F.sum("n").over(W.orderBy("bi").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_firsts"))
    inside = F.coalesce(F.sum(F.when(F.col("prev").isNull(), 1).otherwise(0)).over(W.partitionBy("bi").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = rows.withColumn("_inside", inside).join(F.broadcast(firsts), F.col("bi") == F.col("_bi"))
    out = counted.join(pairs, F.col("place") == F.col("_place"), "left")
    return out.select("key", "place", "prev", F.when(F.col("prev").isNotNull(), F.col("_firsts") + F.col("_inside") + F.col("_pairs") - F.col("prev")).alias("distance"))


def lru_hits(found: DataFrame, sizes: list[int]) -> DataFrame:
    """size, hits, misses and lookups of caches that keep the keys used last, for any sizes at once."""
    counts = found.agg(F.count("*").alias("lookups"), *[F.count(F.when(F.col("distance") < s, 1)).alias(f"h{s}") for s in sizes])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.col(f"h{s}").alias("hits")) for s in sizes])).alias("c")
    return counts.select("lookups", each).select("c.size", "c.hits", (F.col("lookups") - F.col("c.hits")).alias("misses"), "lookups")
