"""Personalized PageRank for many seed sets in one loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftgraph.operators.graph import adjacency
from weftgraph.operators.ranking import number_rows
from weftgraph.session import Scratch, shuffle_partitions

#: Edges of one node that a task joins at once; nodes with more are split over several tasks.
EDGES_PER_PART = 200_000


@dataclass
class Ranked:
    """``scores`` (run_id, id, score) of all nodes, and per run the iterations, the last residual and whether it converged."""

    scores: DataFrame
    runs: dict[str, tuple[int, float, bool]]


def uniform_seeds(seeds: DataFrame) -> DataFrame:
    """(``run_id``, ``id``, ``p``): equal shares over the distinct seeds of each run."""
    one = seeds.select("run_id", "id").distinct()
    n = one.groupBy(F.col("run_id").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    return one.join(n, F.col("run_id") == F.col("r")).select("run_id", "id", (F.lit(1.0) / F.col("n")).alias("p"))


def pagerank(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    alpha: float = 0.85,
    tol: float | None = 1e-10,
    max_iter: int = 200,
    start: str = "seeds",
    stop: str = "l1",
    on_fail: str = "return",
    every: int = 5,
    graph_of: Callable[[Column], Column] | None = None,
) -> Ranked:
    """Personalized PageRank of all seed sets ``seeds(run_id, id, p)`` at once.

    ``next = alpha * P' s + ((1 - alpha) + alpha * mass on nodes without weight) * p``. ``start`` is
    ``seeds`` or ``uniform``; a run stops when its L1 residual is at most ``tol`` (``stop="l1"``) or the number of
    nodes times it (``"n_tol"``). ``tol=None`` makes exactly ``max_iter`` iterations and never looks.
    Without convergence the result says so, or ``on_fail="raise"`` makes it an error. Seeds outside the
    graph are ignored; a run without any is an error.

    ``graph_of`` gives the run of a node id where ``edges`` holds several graphs side by side, one for each run: then start,
    limit and scores are those of the run's own nodes.

    Each iteration is one join and one aggregate, for all runs. Transition shares are computed once and
    kept partitioned by source; nodes with more than EDGES_PER_PART edges are split over several
    parts, to each of which their score goes. Every ``every`` iterations a table in the shared folder
    cuts the lineage. Only one number per run comes to the driver.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    width = shuffle_partitions(spark)
    adj = adjacency(scratch.write(edges.select("u", "v", "w")))
    seeds = scratch.write(seeds.select("run_id", "id", "p"))
    # Nodes and runs become numbers, which are smaller to move and to compare than names.
    deg = number_rows(adj.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"), F.count(F.lit(1)).alias("n")), "id")
    deg = deg.select("id", F.col("at").alias("node"), "d", F.ceil(F.col("n") / EDGES_PER_PART).cast("int").alias("parts"))
    n_nodes = deg.count()
    to = deg.select(F.col("id").alias("t"), F.col("node").alias("dst_node"), F.col("parts").alias("dst_parts"))
    of = deg.where("d > 0").select(F.col("id").alias("f"), F.col("node").alias("src_node"), "d", "parts")
    steps = adj.where("w > 0").join(of, F.col("src") == F.col("f")).join(to, F.col("dst") == F.col("t"))
    steps = steps.select(F.col("src_node").alias("src"), F.pmod(F.xxhash64("dst_node"), "parts").cast("int").alias("part"), F.col("dst_node").alias("dst"), "dst_parts", (F.col("w") / F.col("d") * alpha).alias("share"))
    steps = steps.repartition(width, "src", "part").sortWithinPartitions("src", "part").persist(StorageLevel.MEMORY_AND_DISK)
    idle = deg.where("d <= 0").select(F.col("node").alias("idle"))
    some_idle = idle.limit(1).count() > 0

    given = [r[0] for r in seeds.select("run_id").distinct().orderBy("run_id").collect()]  # as many as the caller has runs
    names = spark.createDataFrame([(x, i) for i, x in enumerate(given)], StructType([seeds.schema["run_id"], StructField("run", LongType())]))
    known = seeds.join(names.select(F.col("run_id").alias("name"), "run"), F.col("run_id") == F.col("name"))
    known = scratch.write(known.join(deg.select(F.col("id").alias("k"), "node", "parts"), F.col("id") == F.col("k")).select("run", F.col("node").alias("id"), "p", "parts"))
    shares = known.groupBy(F.col("run").alias("r")).agg(F.sum("p").alias("total"))
    lacking = set(range(len(given))) - {r[0] for r in shares.select("r").collect()}
    lacking = [given[i] for i in lacking]
    if lacking or not given:
        raise ValueError(f"no seeds in the graph: {sorted(map(str, lacking))}")
    known = scratch.write(known.join(shares, F.col("run") == F.col("r")).select("run", "id", (F.col("p") / F.col("total")).alias("p"), "parts"))
    # The nodes of each run: all of them, as every node has a score in every run, or those of its own graph.
    if graph_of is None:
        members = deg.select(F.col("node").alias("id"), "parts").join(F.broadcast(names.select("run")))
        sizes = dict.fromkeys(range(len(given)), n_nodes)
    else:
        own = deg.select(graph_of(F.col("id")).cast(seeds.schema["run_id"].dataType).alias("own"), F.col("node").alias("id"), "parts")
        members = own.join(F.broadcast(names), F.col("own") == F.col("run_id")).select("id", "parts", "run")
        sizes = {r[0]: r[1] for r in members.groupBy("run").count().collect()}
    if start == "uniform":
        each = F.element_at(F.create_map(*[x for r, n in sizes.items() for x in (F.lit(r).cast("long"), F.lit(1.0 / n))]), F.col("run")) if graph_of else F.lit(1.0 / max(n_nodes, 1))
        state = members.select("run", "id", each.alias("score"), "parts")
    else:
        state = known.select("run", "id", F.col("p").alias("score"), "parts")

    limit = None if tol is None else {r: tol * (n if stop == "n_tol" else 1) for r, n in sizes.items()}

    def step(state: DataFrame) -> DataFrame:
        sent = state.select("run", F.col("id").alias("s"), "score", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
        moved = sent.join(steps, (F.col("s") == F.col("src")) & (F.col("q") == F.col("part"))).select("run", F.col("dst").alias("id"), (F.col("score") * F.col("share")).alias("new"), F.lit(0.0).alias("old"), F.col("dst_parts").alias("parts"))
        back = known.select("run", "id", (F.col("p") * (1 - alpha)).alias("new"), F.lit(0.0).alias("old"), "parts")
        both = moved.unionByName(back)
        if limit is not None:  # only the residual needs the scores before
            both = both.unionByName(state.select("run", "id", F.lit(0.0).alias("new"), F.col("score").alias("old"), "parts"))
        if some_idle:
            lost = state.join(idle, F.col("id") == F.col("idle"), "left_semi").groupBy(F.col("run").alias("r")).agg(F.sum("score").alias("lost"))
            both = both.unionByName(known.join(lost, F.col("run") == F.col("r")).select("run", "id", (F.col("p") * F.col("lost") * alpha).alias("new"), F.lit(0.0).alias("old"), "parts"))
        return both.groupBy("run", "id").agg(F.sum("new").alias("score"), F.sum("old").alias("old"), F.max("parts").alias("parts"))

    runs: dict[int, tuple[int, float, bool]] = {}
    finished: list[DataFrame] = []
    kept: list[DataFrame] = []
    table = None
    for i in range(1, max_iter + 1):
        after = step(state)
        if i % every == 0 or i == max_iter:
            written = scratch.write(after)
            for x in kept:
                x.unpersist()
            kept = []
            if table is not None and not finished:
                scratch.drop(table)
            after = table = written
        elif limit is not None or some_idle:  # the next step reads it more than once
            after = after.persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(after)
        if limit is not None:
            residual = {r[0]: r[1] for r in after.groupBy("run").agg(F.sum(F.abs(F.col("score") - F.col("old")))).collect()}
            done = [r for r, x in residual.items() if x <= limit[r]]
            runs |= {r: (i, x, x <= limit[r]) for r, x in residual.items()}
            if done:
                finished.append(scratch.write(after.where(F.col("run").isin(done)).select("run", "id", "score")))
                after = after.where(~F.col("run").isin(done))
                known = known.where(~F.col("run").isin(done))
            if len(done) == len(residual):
                state = None
                break
        else:
            runs = dict.fromkeys(range(len(given)), (i, float("nan"), False))
        state = after.select("run", "id", "score", "parts")
    if state is not None and limit is not None and on_fail == "raise":
        raise RuntimeError(f"no convergence after {max_iter} iterations")
    if state is not None:
        finished.append(state.select("run", "id", "score"))
    out = finished[0]
    for x in finished[1:]:
        out = out.unionByName(x)
    # Nodes that no mass has reached have score 0.
    zero = members.select("run", "id", F.lit(0.0).alias("score"))
    full = out.unionByName(zero).groupBy("run", "id").agg(F.sum("score").alias("score"))
    named = full.join(deg.select(F.col("id").alias("name"), "node"), F.col("id") == F.col("node")).select(F.col("run").alias("r"), F.col("name").alias("id"), "score")
    named = named.join(names, F.col("r") == F.col("run")).select("run_id", "id", "score")
    return Ranked(named, {given[r]: x for r, x in runs.items()})
