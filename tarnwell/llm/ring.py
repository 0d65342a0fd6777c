"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import written

#: The ring is cut into so many equal cells; a virtual node owns the cells up to its own, counter-clockwise.
CELLS = 4096
#: Rows of a cell are ranked in so many pieces of its range, and rows of one place in so many parts by their contents.
PIECES, PARTS = 64, 16


def ring_arcs(n_shards: int, vnodes: int) -> tuple[list[int], list[list[int]]]:
    """For each cell the number of its arc, and for each arc the shards in the order in which they stand clockwise."""
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % CELLS, s, v) for s in range(n_shards) for v in range(vnodes))
    cells = [p[0] for p in points]
    arcs = [bisect_left(cells, c) % len(points) for c in range(CELLS)]
    owners = []
    for a in range(len(points)):
        owners.append(list(dict.fromkeys(points[(a + i) % len(points)][1] for i in range(len(points)))))
    return arcs, owners


def fill(totals: dict[int, int], owners: list[list[int]], quota: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deal the arcs' keys to shards with bounded loads.

    In round r every arc that still has keys offers them to the r-th shard clockwise; a shard takes them in the arcs' order
    until its quota is reached, and what it cannot take continues clockwise.  Returns (arc, first, end, shard, first slot).
    The input has one number for each arc, whatever the data's size.
    """
    left, done, used, out = dict(totals), dict.fromkeys(totals, 0), [0] * len(quota), []
    for r in range(len(quota)):
        for arc in sorted(left):
            shard = owners[arc][r]
            n = min(left[arc], quota[shard] - used[shard])
            if n > 0:
                out.append((arc, done[arc], done[arc] + n, shard, used[shard]))
                done[arc] += n
                left[arc] -= n
                used[shard] += n
    return out


def bounded_ring_shards(df: DataFrame, key: str, n_shards: int = 8, vnodes: int = 32) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to every row.

    A row's place on the ring is a hash of its key alone.  Shard loads are bounded by quotas that differ by one row at most,
    and keys that overflow a full shard continue clockwise, so balance is exact and only overflowing keys leave the shard
    that plain consistent hashing gives them.  Which keys of an arc overflow is decided by the rows alone, so the same rows
    give the same shards whatever files they come from: rows are ranked by place and contents within a piece of a cell's range
    and a part by the hash of their contents, so no group of equal keys is gathered in a task.  Of rows that are equal in
    all columns, for which any order gives the same result, those of each task are ranked apart, and ranks start at running
    sums of counts.  Null keys have a place as any other; equal keys and repeated rows share a place and may be dealt
    to several shards when these are full; an empty table gives an empty result.  Columns of df keep their names; existing
    columns shard and slot are replaced.
    """
    spark = df.sparkSession
    arcs, owners = ring_arcs(n_shards, vnodes)
    cell = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - CELLS.bit_length() + 1).cast("int")
    arc_of = F.element_at(F.array(*[F.lit(a) for a in arcs]), cell + 1)
    fine = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - (CELLS * PIECES).bit_length() + 1).cast("int")  # the cell and the piece in it
    contents = F.xxhash64(F.lit(11), *[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind and c not in ("shard", "slot")])
    piece = fine * PARTS + F.pmod(contents, F.lit(PARTS)).cast("int")
    keyed = written(df.drop("shard", "slot").withColumns({"__arc": arc_of, "__pos": F.xxhash64(F.col(key)), "__row": contents, "__piece": piece, "__task": F.spark_partition_id()}), "ring")
    same = ["__arc", "__piece", "__pos", "__row", "__task"]
    alike = keyed.groupBy(*same).count()
    counts = alike.groupBy("__arc", "__piece").agg(F.sum("count").alias("count"))
    before = Window.partitionBy("__arc").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)  # at most PIECES x PARTS rows for each cell
    starts = counts.select("__arc", "__piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__arc", "__piece").orderBy("__pos", "__row", "__task").rowsBetween(Window.unboundedPreceding, -1)  # equal rows of a task are one
    starts = alike.withColumn("__before", F.coalesce(F.sum("count").over(within), F.lit(0))).join(starts, ["__arc", "__piece"]).select(*same, (F.col("__start") + F.col("__before")).alias("__start"))
    totals = {r[0]: r[1] for r in counts.groupBy("__arc").agg(F.sum("count")).collect()}  # one number for each arc
    n = sum(totals.values())
    quota = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    plan = spark.createDataFrame(fill(totals, owners, quota), "__arc int, __first long, __end long, shard int, __base long")
    rank = F.row_number().over(Window.partitionBy(*same).orderBy("__pos")) - 1
    ranked = keyed.withColumn("__rank", rank).join(starts, same).withColumn("__rank", F.col("__rank") + F.col("__start"))
    dealt = ranked.join(F.broadcast(plan), "__arc").where("__rank >= __first and __rank < __end")  # plan: shards x virtual nodes x shards rows at most
    return dealt.withColumn("slot", F.col("__rank") - F.col("__first") + F.col("__base")).drop(*same, "__start", "__rank", "__first", "__end", "__base")
