"""Consolidating pairwise matches into groups (problem 1)."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import unit_hash
from weftgraph.session import HOT_KEYS, Scratch, hot_keys, looked_up, shuffle_partitions


#: Directed edges of a level for each task.
EDGES_PER_TASK = 250_000


def _vertices(pairs: DataFrame, scratch: Scratch, seed: int) -> tuple[DataFrame, int]:
    """(v, key, n) for each node, v its 64-bit handle; another seed is tried if two keys ever share a handle."""
    while True:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
        keyed = ends.groupBy("key").agg(F.count(F.lit(1)).alias("n"))  # a hash aggregate, unlike the minimum of a string
        v = scratch.write(keyed.select(F.xxhash64("key", F.lit(seed)).alias("v"), "key", "n"))
        if v.groupBy("v").agg(F.count(F.lit(1)).alias("keys")).where("keys > 1").limit(1).count() == 0:
            return v, seed
        scratch.drop(v)
        seed += 1


def _hop(cold: DataFrame, hot: DataFrame | None, state: DataFrame, hot_ids: list) -> DataFrame:
    """Offers of one step: each vertex whose cluster is at least one step ahead proposes it to its neighbours."""
    senders = state.where("val <= -1").select(F.col("v").alias("s"), "val", "lab")
    offers = cold.join(senders, cold.src == senders.s)
    if hot is not None:
        few = F.broadcast(senders.where(F.col("s").isin(hot_ids)))  # at most HOT_KEYS rows
        offers = offers.unionByName(hot.join(few, hot.src == few.s))
    return offers.select(F.col("dst").alias("v"), (F.col("val") + 1).alias("val"), "lab")


def link_groups(
    pairs: DataFrame,
    a: str,
    b: str,
    *,
    beta: float = 0.3,
    steps: int = 4,
    max_levels: int = 200,
    seed: int = 17,
) -> DataFrame:
    """One row (``node_key``, ``group_key``) for each string that occurs in ``a`` or ``b``.

    Low-diameter decomposition: each vertex draws an exponential shift (rate ``beta``) and starts a
    cluster that much earlier; clusters grow for ``steps`` steps and a vertex joins the one that
    reaches it first.  Clusters then contract to single vertices and the procedure recurses on the
    edges between clusters, until none is left; the assignments of all levels compose to the groups.
    ``group_key`` is the smallest member in byte order.

    Vertices whose edges hold more than 1/HOT_KEYS of all are joined by broadcast (at most HOT_KEYS
    rows), all others by key, so that no task gets the neighbourhood of a hub; clusters and groups that hold as
    large a share are looked up the same way in the end.  Each level is cut off by a table in the shared
    folder, and its number of tasks goes with its edges.

    Rows with a NULL in ``a`` or ``b`` link nothing; a row with ``a`` = ``b`` makes a group of its
    own.  Repeated rows don't matter.  An empty input gives an empty result.  Only the two named
    columns are read, so that others may have any name.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark)
    parts = shuffle_partitions(spark)
    pairs = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null")
    vertices, seed = _vertices(pairs, scratch, seed)

    half = pairs.select(F.xxhash64("a", F.lit(seed)).alias("x"), F.xxhash64("b", F.lit(seed)).alias("y")).where("x <> y")
    counts, total = vertices.withColumnRenamed("v", "src"), vertices.agg(F.sum("n")).first()[0] or 0
    levels: list[DataFrame] = []
    previous = None
    while total:
        hot_ids = hot_keys(counts, "src", "n", total)
        both = half.select(F.explode(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst")))).alias("e")).select("e.*")
        is_hot = F.col("src").isin(hot_ids)
        tasks = min(parts, math.ceil(total / EDGES_PER_TASK))
        cold = (both.where(~is_hot) if hot_ids else both).repartition(tasks, "src").dropDuplicates(["src", "dst"]).sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
        hot = both.where(is_hot).dropDuplicates(["src", "dst"]).persist(StorageLevel.MEMORY_AND_DISK) if hot_ids else None
        ids = cold.select(F.col("src").alias("v")).distinct()
        if hot is not None:
            ids = ids.unionByName(hot.select(F.col("src").alias("v")).distinct())
        state = ids.select("v", (F.log(unit_hash(F.col("v"), len(levels))) / F.lit(beta)).alias("val"), F.col("v").alias("lab"))
        kept = [x for x in (cold, hot) if x is not None]
        for _ in range(steps):  # a table each, so that plans stay small
            after = scratch.write(state.unionByName(_hop(cold, hot, state, hot_ids)).groupBy("v").agg(F.min_by("lab", "val").alias("lab"), F.min("val").alias("val")))
            scratch.drop(state)
            state = after
        level = state.select("v", "lab")
        levels.append(level)

        # Contract. An edge with a hot end is taken from that end, so the join on the other end meets no hot key.
        to = F.col("dst").isin(hot_ids)
        own = level.select(F.col("v").alias("s"), F.col("lab").alias("x"))
        one = cold.where((F.col("src") < F.col("dst")) & ~to if hot_ids else F.col("src") < F.col("dst"))
        one = one.join(own, one.src == own.s).select("x", "dst")
        if hot is not None:
            few = F.broadcast(own.where(F.col("s").isin(hot_ids)))
            one = one.unionByName(hot.where(~to).join(few, F.col("src") == F.col("s")).select("x", "dst"))
        there = level.select(F.col("v").alias("d"), F.col("lab").alias("y"))
        between = one.join(there, one.dst == there.d).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        if hot is not None:
            ab = hot.where(to & (F.col("src") < F.col("dst")))  # at most HOT_KEYS squared, by key twice
            ab = ab.join(F.broadcast(own.where(F.col("s").isin(hot_ids))), F.col("src") == F.col("s")).select("x", "dst")
            ab = ab.join(F.broadcast(there.where(F.col("d").isin(hot_ids))), F.col("dst") == F.col("d")).where("x <> y")
            between = between.unionByName(ab.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
        half = scratch.write(between.distinct())
        for x in kept:
            x.unpersist()
        if previous is not None:
            scratch.drop(previous)
        previous = half
        total = 2 * half.count()
        counts = half.select(F.explode(F.array("x", "y")).alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        if len(levels) > max_levels:
            raise RuntimeError(f"no end after {max_levels} levels")

    if not levels:
        return vertices.select(F.col("key").alias("node_key"), F.col("key").alias("group_key"))
    first = levels[0].select(F.col("v").alias("w"), F.col("lab").alias("l"))
    base = scratch.write(vertices.join(first, vertices.v == first.w, "left").select("key", F.coalesce("l", "v").alias("lab")))
    least = base.groupBy("lab").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    if len(levels) == 1:
        named = scratch.write(least.select("lab", F.col("least").alias("group_key"), "n"))
        final = named.select(F.col("lab").alias("l"), "group_key")
    else:
        roots = levels[-1].select("v", F.col("lab").alias("root"))
        for level in reversed(levels[1:-1]):
            sizes = level.groupBy("lab").agg(F.count(F.lit(1)).alias("n"))
            up = roots.select(F.col("v").alias("w"), F.col("root").alias("r"))
            roots = looked_up(level, "lab", up, "w", hot_keys(sizes, "lab", "n", level.count()), "left").select("v", F.coalesce("r", "lab").alias("root"))
        named = scratch.write(least.join(roots, least.lab == roots.v, "left").select("lab", "least", F.coalesce("root", "lab").alias("root"), "n"))
        group = named.groupBy("root").agg(F.min("least").alias("group_key"), F.count(F.lit(1)).alias("labels")).withColumnRenamed("root", "r")
        final = looked_up(named.select("lab", "root"), "root", group.select("r", "group_key"), "r", hot_keys(group, "r", "labels", named.count())).select(F.col("lab").alias("l"), "group_key")
    return looked_up(base, "lab", final, "l", hot_keys(named, "lab", "n", base.count())).select(F.col("key").alias("node_key"), "group_key")


__all__ = ["HOT_KEYS", "link_groups"]
