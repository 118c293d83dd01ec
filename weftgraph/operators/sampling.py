"""Splits and samples in repeatable random order: rows are ordered by the md5 of their id and a seed."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions import columns as C
from weftgraph.operators.ranking import number_rows, number_within
from weftgraph.session import Scratch


def _positions(df: DataFrame, seed: int, *cols: str) -> DataFrame:
    """``df`` with ``at``, the row's place in hash order, from 0."""
    return number_rows(df, C.ordered_hash(*cols, seed=seed), *cols)


def edge_split(edges: DataFrame, *, train: float = 0.8, val: float = 0.1, seed: int = 0, dedup: bool = True) -> DataFrame:
    """(``u``, ``v``, ``split``): edges in hash order, cut at whole shares; the rest is test. Deduplicated first, so that no pair is in two splits."""
    e = edges.select(C.smaller("u", "v").alias("u"), C.larger("u", "v").alias("v")).distinct() if dedup else edges.select("u", "v")
    n = e.count()
    a, b = int(n * train), int(n * val)
    return _positions(e, seed, "u", "v").select("u", "v", F.when(F.col("at") < a, "train").when(F.col("at") < a + b, "val").otherwise("test").alias("split"))


def node_split(edges: DataFrame, *, train: float = 0.8, val: float = 0.1, seed: int = 0) -> DataFrame:
    """(``u``, ``v``, ``split``): nodes in hash order are cut at whole shares; edges between two splits are left out."""
    e = edges.select(C.smaller("u", "v").alias("u"), C.larger("u", "v").alias("v")).distinct()
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    n = nodes.count()
    a, b = int(n * train), int(n * val)
    label = _positions(nodes, seed, "node").select("node", F.when(F.col("at") < a, "train").when(F.col("at") < a + b, "val").otherwise("test").alias("split"))
    x, y = label.select(F.col("node").alias("x"), F.col("split").alias("sx")), label.select(F.col("node").alias("y"), F.col("split").alias("sy"))
    return e.join(x, F.col("u") == F.col("x")).join(y, F.col("v") == F.col("y")).where("sx = sy").select("u", "v", F.col("sx").alias("split"))


def holdout(hits: DataFrame, baits: DataFrame, repeats: int, *, fraction: float = 0.7, seed: int = 42, force: bool = False) -> DataFrame:
    """(``run_id``, ``id``, ``label``, ``is_seed``): hits of each repeat split into train and test; baits and train hits are seeds.

    Hits that are baits always train if ``force``. Of n other hits, at least one trains and, from two on, at least one
    tests; the number is ``fraction`` of them, halves to even. All repeats are one table.
    """
    runs = hits.sparkSession.range(repeats).select(F.col("id").cast("int").alias("run_id"))
    h = hits.select("id").distinct()
    fixed = h.join(baits.select(F.col("id").alias("b")).distinct(), F.col("id") == F.col("b"), "left_semi") if force else h.limit(0)
    free = h.join(fixed.select(F.col("id").alias("f")), F.col("id") == F.col("f"), "left_anti")
    each = free.join(F.broadcast(runs)).withColumn("h", C.ordered_hash("id", (F.col("run_id") + seed).cast("string")))  # one row per repeat
    n = F.col("n")
    train = F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(fraction)).cast("long"))))
    split = number_within(each, "run_id", "h", "id").select("run_id", "id", F.when(F.col("at") < train, "train_hit").otherwise("test_hit").alias("label"))
    split = split.unionByName(fixed.join(runs).select("run_id", "id", F.lit("train_hit").alias("label")))
    both = split.select("run_id", "id", "label", (F.col("label") == "train_hit").alias("is_seed"))
    if force:
        both = both.unionByName(baits.select("id").distinct().join(runs).select("run_id", "id", F.lit("other").alias("label"), F.lit(True).alias("is_seed")))
    return both.groupBy("run_id", "id").agg(F.max("label").alias("label"), F.max("is_seed").alias("is_seed"))


def matched_pool(seeds: DataFrame, eligible: DataFrame, size: int = 25) -> DataFrame:
    """(``seed_id``, ``id``, ``place``): for each seed the ``size`` eligible nodes nearest in weighted degree, the smaller degree first on ties.

    ``seeds(id, d)``, ``eligible(id, d)``. Eligible nodes are numbered by degree and id over range partitions; a seed's
    pool lies in the band of ``size`` places on either side of its own, which is joined by place. Nobody
    is compared with all nodes.
    """
    e, s = eligible.select("d", "id"), seeds.select("d", "id")
    band = number_rows(e, "d", "id").select(F.col("id").alias("near"), F.col("d").alias("nd"), F.col("at").alias("band_at"))
    both = number_rows(s.withColumn("kind", F.lit(0)).unionByName(e.withColumn("kind", F.lit(1))), "d", "kind", "id").where("kind = 0").select("id", "d", "at")
    own = number_rows(s, "d", "id").select(F.col("id").alias("own_id"), F.col("at").alias("own_at"))
    # Eligible nodes below the seed: all before it, less the seeds before it.
    at = both.join(own, F.col("id") == F.col("own_id")).select(F.col("id").alias("seed_id"), F.col("d").alias("target"), (F.col("at") - F.col("own_at")).alias("p"))
    near = at.select("seed_id", "target", "p", F.explode(F.sequence(F.col("p") - size, F.col("p") + size - 1)).alias("q")).join(band, F.col("q") == F.col("band_at"))
    # Below the target the walk goes down the band, above it up.
    walk = Window.partitionBy("seed_id").orderBy(F.abs(F.col("nd") - F.col("target")), F.col("q") >= F.col("p"), F.when(F.col("q") < F.col("p"), -F.col("q")).otherwise(F.col("q")))
    return near.withColumn("place", F.row_number().over(walk)).where(F.col("place") <= size).select("seed_id", F.col("near").alias("id"), "place")


def draw_matched(pools: list[tuple[str, list[str]]], seed: int) -> list[str]:
    """One unused node of each seed's pool, in hash order; the seeds are few, so this runs on the driver. Empty if a pool runs out."""
    used: list[str] = []
    for s, pool in sorted(pools, key=lambda x: hashlib.md5(f"{x[0]}:{seed}".encode()).hexdigest()):
        left = [x for x in pool if x not in used]
        if not left:
            return []
        used.append(min(left, key=lambda x: hashlib.md5(f"{s}:{x}:{seed}".encode()).hexdigest()))
    return used


def negative_pairs(edges: DataFrame, n: int, *, seed: int = 0, known: DataFrame | None = None) -> DataFrame:
    """(``u``, ``v``): about degree-proportional random pairs that are neither edges nor ``known``, distinct: ``n``, or all there are if fewer.

    All edge ends are numbered once in hash order; ends a few places apart are a random pair, so a node comes up
    as often as it has edges. Loops, edges and repeats drop out. Rounds take further distances until ``n`` pairs are
    there or every end has met every other. The first ``n`` in hash order are kept, by numbers over range partitions.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.write(edges.select(C.smaller("u", "v").alias("u"), C.larger("u", "v").alias("v")).where("u <> v").distinct())
    ends = e.select(F.explode(F.array("u", "v")).alias("x"), "u", "v").select("x", F.xxhash64("x", "u", "v", F.lit(seed)).alias("h"))
    ends = number_rows(ends, "h", "x").select("x", "at")
    total = ends.count()
    taken = e if known is None else e.unionByName(known.select(C.smaller("u", "v").alias("u"), C.larger("u", "v").alias("v"))).distinct()
    taken = taken.select(F.col("u").alias("a"), F.col("v").alias("b"))
    out, missing, done, r = None, n, 0, 0
    while out is None or (missing > 0 and done < total // 2):
        shifts = max(1, min(total // 2 - done, -(-3 * missing // (2 * max(1, total))) << r))
        far = ends.select(F.col("x").alias("q"), F.explode(F.sequence(F.lit(done + 1), F.lit(done + shifts))).alias("shift"), "at")
        pairs = ends.join(far.select("q", ((F.col("at") + F.col("shift")) % total).alias("at")), "at").where("x <> q").select(F.least("x", "q").alias("u"), F.greatest("x", "q").alias("v"))
        fresh = pairs.distinct().join(taken, (F.col("u") == F.col("a")) & (F.col("v") == F.col("b")), "left_anti")
        new = scratch.write(fresh if out is None else fresh.unionByName(out).distinct())
        if out is not None:
            scratch.drop(out)
        out = new
        missing, done, r = n - out.count(), done + shifts, r + 1
    scratch.drop(e)
    return _positions(out, seed, "u", "v").where(F.col("at") < n).select("u", "v")


def sample_rows(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows without replacement, in hash order."""
    return df.orderBy(C.ordered_hash(id_col, seed=seed), id_col).limit(k)
