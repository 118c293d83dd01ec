"""Workflows: repeated holdout on one graph with null baselines, and one evaluation over many graphs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions import columns as C
from weftgraph.operators.ppr import pagerank
from weftgraph.operators.ranking import aggregate_rows, number_rows, rank_nodes, ranking_metrics, repeat_means, top_metrics
from weftgraph.operators.sampling import draw_matched, holdout
from weftgraph.operators.walks import Blocks, _load, _save
from weftgraph.session import Scratch, shuffle_partitions

#: Nodes of a range from which matched seeds are drawn.
RANGE_NODES = 1 << 17


def weighted_seeds(rows: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(``id``, ``p``) from ``rows(id, weight)``: weight 1 where it is no number, positive ones summed by id, normalized to 1; an error if none is left."""
    w = F.coalesce(C.number("weight"), F.lit(1.0))
    s = rows.select(C.normalize_id("id").alias("id"), w.alias("w")).where("id is not null and w > 0")
    if nodes is not None:
        s = s.join(nodes.select(F.col("id").alias("n")), F.col("id") == F.col("n"), "left_semi")
    s = s.groupBy("id").agg(F.sum("w").alias("w"))
    total = s.agg(F.sum("w")).first()[0]
    if not total:
        raise ValueError("no valid seeds")
    return s.select("id", (F.col("w") / F.lit(total)).alias("p"))


def score_rows(scores: DataFrame, split: DataFrame, baits: DataFrame) -> DataFrame:
    """Every node's score in each run with its rank (NULL for seeds) and flags."""
    seeds = split.where("is_seed").select("run_id", "id")
    ranked = rank_nodes(scores, exclude=seeds).select(F.col("run_id").alias("rr"), F.col("id").alias("ri"), "rank")
    flags = split.select(F.col("run_id").alias("fr"), F.col("id").alias("fi"), "label", "is_seed")
    b = baits.select(F.col("id").alias("b")).distinct()
    j = scores.join(ranked, (F.col("run_id") == F.col("rr")) & (F.col("id") == F.col("ri")), "left").join(flags, (F.col("run_id") == F.col("fr")) & (F.col("id") == F.col("fi")), "left").join(b, F.col("id") == F.col("b"), "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return j.select("run_id", "id", "score", "rank", flag(F.col("is_seed")).alias("is_seed"), flag(F.col("label") == "train_hit").alias("is_train_seed"), flag(F.col("label") == "test_hit").alias("is_test_hit"), flag(F.col("b").isNotNull()).alias("is_bait"))


def split_table(nodes: DataFrame, split: DataFrame, baits: DataFrame) -> DataFrame:
    """(``run_id``, ``protein_id``, ``split_label``, ``is_bait``, ``is_seed``): every node in each run, ``other`` where the split doesn't name it."""
    runs = split.select("run_id").distinct()
    own = split.select(F.col("run_id").alias("r"), F.col("id").alias("i"), "label", "is_seed")
    b = baits.select(F.col("id").alias("b")).distinct()
    all_ = nodes.select("id").distinct().join(F.broadcast(runs))  # as many runs as the caller asks for
    j = all_.join(own, (F.col("run_id") == F.col("r")) & (F.col("id") == F.col("i")), "left").join(b, F.col("id") == F.col("b"), "left")
    return j.select("run_id", F.col("id").alias("protein_id"), F.coalesce("label", F.lit("other")).alias("split_label"), F.col("b").isNotNull().alias("is_bait"), F.coalesce("is_seed", F.lit(False)).alias("is_seed"))


def evaluate(scores: DataFrame, split: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Metrics of each run: seeds left out, test hits positive."""
    tests = split.where("label = 'test_hit'").select(F.col("run_id").alias("tr"), F.col("id").alias("ti"))
    marked = scores.join(tests, (F.col("run_id") == F.col("tr")) & (F.col("id") == F.col("ti")), "left").select("run_id", "id", "score", F.col("ti").isNotNull().alias("test"))
    return ranking_metrics(rank_nodes(marked, exclude=split.where("is_seed"), hit=F.col("test")), ks)


def random_metrics(split: DataFrame, n_nodes: int, repeats: int, ks: Sequence[int], seed: int) -> DataFrame:
    """Metrics of rankings in random order, ``repeats`` of each run (run ids run:repeat).

    In a random order the places of the positives are a random subset of all places, so only these are drawn.
    """
    sizes = split.groupBy("run_id").agg((F.lit(n_nodes) - F.count_if(F.col("is_seed"))).alias("n"), F.count_if(F.col("label") == "test_hit").alias("p"))
    reps = split.sparkSession.range(repeats).select(F.col("id").alias("rep"))
    runs = sizes.join(F.broadcast(reps)).select(F.concat_ws(":", F.col("run_id").cast("string"), F.col("rep").cast("string")).alias("run_id"), "n", "p")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for run, n, p in b.itertuples(index=False):
                own = np.random.default_rng(int(hashlib.md5(f"{run}:{seed}".encode()).hexdigest()[:15], 16))
                at = np.sort(own.choice(n, min(n, p), replace=False)) + 1
                yield pd.DataFrame({"run_id": run, "rank": at.astype("int64"), "hit": 1, "hits": np.arange(1, len(at) + 1)})

    ranked = runs.mapInPandas(draw, "run_id string, rank long, hit int, hits long")
    return ranking_metrics(ranked, ks, sizes=runs.select("run_id", F.col("n").alias("num_candidates")))


def draw_nearest(own: Sequence[tuple[str, float, int]], d: Sequence[float], ids: Sequence[str], pool: int, seed: int, first: bool, last: bool) -> list[str] | None:
    """One of the ``pool`` unused nodes nearest in degree for each of ``own`` (id, degree, nodes below it), by id; ``d`` and ``ids`` by rising degree.

    Empty if a seed finds none; None if a pool might go on beyond the ``first`` or ``last`` node, where these aren't the ends of all nodes.
    """
    n, out = len(d), []
    below: dict[int, int] = {}  # from a used node to where the next unused one may be
    above: dict[int, int] = {}

    def free(i: int, links: dict[int, int]) -> int:
        passed = []
        while i in links:
            passed.append(i)
            i = links[i]
        for x in passed:
            links[x] = i
        return i

    for s, target, place in sorted(own):
        near, lo, hi = [], free(place - 1, below), free(place, above)
        while len(near) < pool:
            if (lo < 0 and not first) or (hi >= n and not last):
                return None
            if lo < 0 and hi >= n:
                break
            if lo >= 0 and (hi >= n or target - d[lo] <= d[hi] - target):
                near.append(lo)
                lo = free(lo - 1, below)
            else:
                near.append(hi)
                hi = free(hi + 1, above)
        names = [ids[x] for x in near]
        one = draw_matched([(s, names)], seed)
        if not one:
            return []
        x = near[names.index(one[0])]
        below[x], above[x] = x - 1, x + 1
        out += one
    return out


def matched_seeds(seeds: DataFrame, target: DataFrame, eligible: DataFrame, repeats: int, pool: int, seed: int) -> DataFrame:
    """(``run_id``, ``id``): for each repeat of each run (run ids run:repeat) an unused eligible node of like degree for each seed.

    Draws without replacement depend on one another only within a repeat and where pools meet. Seeds and nodes are numbered by degree
    together and cut into ranges between two seeds that are far apart; each range of a run is a group of its own that reads its
    nodes from the shared folder. A range in which a pool might go on beyond the cut is joined with those beside it and
    drawn again; the others keep theirs. A repeat in which a seed finds no node at all gives none.
    """
    spark = seeds.sparkSession
    scratch = Scratch(spark)
    root, width = f"{scratch.root}/nodes", RANGE_NODES
    placed = number_rows(target.select("id", "d", F.lit(0).alias("kind")).unionByName(eligible.select("id", "d", F.lit(1).alias("kind"))), "d", "kind", "id")
    inner = max(0, placed.count() - 1) // width
    b = F.least(F.lit(inner), F.floor(F.col("at") / width + 0.5).cast("int"))
    part = F.lit(0)
    if inner:
        # For each multiple of the width the middle of the widest gap between seeds around it.
        ends = spark.range(1, inner + 1).select(F.col("id").cast("int").alias("b"), F.explode(F.array(F.col("id") * width - width // 4, F.col("id") * width + width // 4)).alias("at"))
        around = placed.where("kind = 0").select(b.alias("b"), "at").where((F.col("b") > 0) & (F.abs(F.col("at") - F.col("b") * width) < width // 4)).unionByName(ends)
        gap = (F.lead("at").over(Window.partitionBy("b").orderBy("at")) - F.col("at")).alias("gap")
        best = around.select("b", "at", gap).where("gap is not null").groupBy("b").agg(F.max(F.struct("gap", (F.col("at") + F.ceil(F.col("gap") / 2)).alias("cut"))).alias("best"))
        cuts = dict(best.select("b", "best.cut").collect())  # one for each range
        part = F.when((b > 0) & (F.col("at") < F.element_at(F.array(*[F.lit(cuts[i]) for i in range(1, inner + 1)]), F.greatest(b, F.lit(1)))), b - 1).otherwise(b)

    def keep(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        _save(root, f"part-{rows['part'][0].as_py()}", (rows["at"].to_numpy(), rows["d"].to_numpy(), rows["id"].to_pylist()))
        return rows.select(["part"]).slice(0, 1)

    placed.where("kind = 1").select(part.alias("part"), "at", F.col("d").cast("double").alias("d"), "id").groupBy("part").applyInArrow(keep, "part int").count()
    places = placed.where("kind = 0").select(F.col("id").alias("s"), F.col("d").cast("double").alias("d"), "at", part.alias("part"))
    own = scratch.write(seeds.select(F.col("run_id").cast("string").alias("run"), F.col("id").alias("k")).join(places, F.col("k") == F.col("s")).select("run", "s", "d", "at", "part"))

    def draws(until: dict[int, int]) -> Callable[[pa.Table], pa.Table]:
        def draw(rows: pa.Table) -> pa.Table:
            run, lo = rows["run"][0].as_py(), rows["lo"][0].as_py()
            table = lambda run, ids: pa.table({"run_id": pa.array([run] * len(ids), pa.string()), "id": pa.array(ids, pa.string()), "lo": pa.array([lo] * len(ids), pa.int32())})
            at, d, ids = zip(*(_load(root, f"part-{i}", (np.zeros(0, np.int64), np.zeros(0), [])) for i in range(lo, until[lo])))
            at, d, ids = np.concatenate(at), np.concatenate(d).tolist(), [x for y in ids for x in y]
            mine = list(zip(rows["s"].to_pylist(), rows["d"].to_pylist(), np.searchsorted(at, rows["at"].to_numpy()).tolist()))
            out = []
            for rep in range(repeats):
                got = draw_nearest(mine, d, ids, pool, seed + rep, lo == 0, until[lo] == inner + 1)
                if got is None:
                    return table(run, [None])
                out.append(table(f"{run}:{rep}", got))
            return pa.concat_tables(out)

        return draw

    spans, todo, out, wider = [(i, i + 1) for i in range(inner + 1)], set(range(inner + 1)), None, 1
    while repeats > 0:
        of = F.element_at(F.array(*[F.lit(lo) for lo, hi in spans for _ in range(lo, hi)]), F.col("part") + 1)
        some = own.select("run", "s", "d", "at", of.alias("lo")).where(F.col("lo").isin(sorted(todo)))
        groups = some.repartition(shuffle_partitions(spark), "run", "lo").groupBy("run", "lo")  # a number of its own, else small groups end up in one task
        drawn = scratch.write(groups.applyInArrow(draws(dict(spans)), "run_id string, id string, lo int"))
        short = {r[0] for r in drawn.where("id is null").select("lo").distinct().collect()}
        out = drawn if out is None else out.unionByName(drawn)
        if not short:
            return out.select("run_id", "id")
        joined: list[tuple[int, int]] = []
        for lo, hi in sorted([(max(0, lo - wider), min(inner + 1, hi + wider)) for lo, hi in spans if lo in short] + spans):
            if joined and lo < joined[-1][1]:
                joined[-1] = joined[-1][0], max(hi, joined[-1][1])
            else:
                joined.append((lo, hi))
        todo = {lo for lo, _ in set(joined) - set(spans)}
        out = out.where(F.col("lo").isin([lo for lo, _ in set(joined) & set(spans)]))
        spans, wider = joined, 2 * wider
    return own.where("false").select(F.col("run").alias("run_id"), F.col("s").alias("id"))


class Outputs(dict):
    """Tables by name; ``scores``, a row for each node and run, is made when it is first asked for."""

    def __init__(self, scores: Callable[[], DataFrame], **tables: DataFrame):
        super().__init__(tables)
        self._scores = scores

    def __missing__(self, name: str) -> DataFrame:
        if name != "scores":
            raise KeyError(name)
        return self.setdefault(name, self._scores())


def run_holdout(
    edges: DataFrame,
    hits: DataFrame,
    baits: DataFrame,
    *,
    repeats: int = 20,
    fraction: float = 0.7,
    force: bool = False,
    alpha: float = 0.85,
    tol: float | None = 1e-10,
    max_iter: int = 200,
    ks: Sequence[int] = (10, 20, 50, 100, 200),
    random_repeats: int = 100,
    matched_repeats: int = 10,
    pool: int = 25,
    weighted: bool = True,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """``rows`` (method, run), ``summary`` (mean and deviation by method), ``split`` and ``scores`` of repeated holdout on one graph.

    Methods: ``ppr`` from train hits, ``degree``, ``random`` (means over shuffles) and ``degree_matched`` (means over
    PageRank from nodes of like degree). All repeats of a method are one job. Hits outside the graph don't count;
    no hit, or a single one without forced baits, is an error.
    """
    blocks = Blocks(edges)
    by = "weighted_degree" if weighted else "degree"
    deg = blocks.nodes
    inside = lambda x: x.select("id").distinct().join(deg.select(F.col("id").alias("n")), F.col("id") == F.col("n"), "left_semi")
    hits, baits = blocks.scratch.write(inside(hits)), blocks.scratch.write(inside(baits))
    n_hits = hits.count()
    if n_hits == 0 or (n_hits == 1 and not force):
        raise ValueError("too few hits in the graph")
    split = blocks.scratch.write(holdout(hits, baits, repeats, fraction=fraction, seed=seed, force=force))
    seeds = split.where("is_seed").select("run_id", "id")
    runs = [r[0] for r in seeds.select("run_id").distinct().orderBy("run_id").collect()]  # as many as the caller asks for
    names, null_seeds = [str(r) for r in runs], None
    if matched_repeats > 0:
        eligible = deg.join(hits.select(F.col("id").alias("h")), F.col("id") == F.col("h"), "left_anti").join(baits.select(F.col("id").alias("b")), F.col("id") == F.col("b"), "left_anti")
        target = seeds.select("id").distinct().join(deg.select(F.col("id").alias("n"), F.col(by).alias("d")), F.col("id") == F.col("n")).select("id", "d")
        null_seeds = matched_seeds(seeds, target, eligible.select("id", F.col(by).alias("d")), matched_repeats, pool, seed + 20_000_000)
        names += [r[0] for r in null_seeds.select("run_id").distinct().orderBy("run_id").collect()]
    # The runs and their null ones go together.
    numbers = edges.sparkSession.createDataFrame(list(enumerate(names)), "run long, name string")
    numbered = lambda x: x.join(F.broadcast(numbers), F.col("run_id").cast("string") == F.col("name")).select("run", "id")
    key = F.concat_ws(":", F.col("run_id").cast("string"), F.col("rep").cast("string"))
    all_seeds, tests = seeds.select(F.col("run_id").cast("string"), "id"), split.where("label = 'test_hit'").select(F.col("run_id").cast("string"), "id")
    if null_seeds is not None:
        reps = edges.sparkSession.range(matched_repeats).select(F.col("id").alias("rep"))
        all_seeds, tests = all_seeds.unionByName(null_seeds), tests.unionByName(tests.join(reps).select(key.alias("run_id"), "id"))
    all_seeds, tests = blocks.scratch.write(numbered(all_seeds)), blocks.scratch.write(numbered(tests))
    state, ends = blocks.walk(all_seeds, len(names), alpha=alpha, tol=tol, max_iter=max_iter)
    sizes = all_seeds.distinct().groupBy("run").agg((F.lit(blocks.n) - F.count(F.lit(1))).alias("num_candidates")).join(numbers, "run").select(F.col("name").alias("run_id"), "num_candidates")

    def metrics(score: Callable[[int, int], np.ndarray], n: int) -> DataFrame:
        some = F.col("run") < n
        ranked = blocks.scratch.write(blocks.ranked(score, n, all_seeds.where(some), tests.where(some))).join(F.broadcast(numbers), "run").select(F.col("name").alias("run_id"), "rank", "hit", "hits")
        return ranking_metrics(ranked, ks, sizes=sizes.where(F.col("run_id").isin(names[:n])))

    walked = metrics(blocks.scores_of(state, ends), len(names))
    own = lambda df, method: df.where(F.col("run_id").isin(names[: len(runs)])).withColumn("run_id", F.col("run_id").cast("int")).withColumn("method", F.lit(method))
    rows = own(walked, "ppr").unionByName(own(metrics(blocks.values_of(by), len(runs)), "degree"))
    columns = [c for c in rows.columns if c not in ("run_id", "method")]

    def nulls(many: DataFrame, method: str) -> DataFrame:
        """Means over the repeats of each run; ``many`` has run ids run:repeat."""
        got = many.withColumn("run_id", F.split("run_id", ":")[0].cast("int"))
        return repeat_means(got, ["run_id"], columns).withColumn("method", F.lit(method))

    if random_repeats > 0:
        rows = rows.unionByName(nulls(random_metrics(split, blocks.n, random_repeats, ks, seed + 10_000_000), "random"), allowMissingColumns=True)
    if len(names) > len(runs):
        rows = rows.unionByName(nulls(walked.where(F.col("run_id").contains(":")), "degree_matched"), allowMissingColumns=True)
    ppr = blocks.scores(state, ends[: len(runs)], edges.sparkSession.createDataFrame(list(enumerate(runs)), "run long, run_id int"))
    return Outputs(lambda: score_rows(ppr, split, baits), rows=rows, summary=aggregate_rows(rows, ["method"], ["run_id"]), split=split)


def evaluate_graphs(graphs: Mapping[str, DataFrame], seeds: DataFrame, labels: DataFrame, *, k: int = 200, alpha: float = 0.85, tol: float | None = 1e-10, max_iter: int = 500, digits: int | None = None) -> DataFrame:
    """One row per graph: nodes, seeds, positives and top-k metrics, best average precision first. All graphs take part in one PageRank.

    ``seeds(id, weight)`` weighted, ``labels(id, value)`` positive above 0; both count within the graph. Candidates are all
    nodes but the seeds. A graph without convergence is an error. ``digits`` rounds scores before ranking, so that ties are the
    same however sums run.
    """
    if not graphs:
        raise ValueError("no graphs")
    # All graphs side by side: ids carry the graph's name, and each graph is a run.
    named = lambda name, c: F.concat(F.lit(f"{name}\x1f"), c)
    edges, known = None, None
    for name, g in graphs.items():
        one = g.select(named(name, F.col("u")).alias("u"), named(name, F.col("v")).alias("v"), "w")
        edges = one if edges is None else edges.unionByName(one)
        s = weighted_seeds(seeds, g.select(F.explode(F.array("u", "v")).alias("id")).distinct()).select(F.lit(name).alias("run_id"), named(name, F.col("id")).alias("id"), "p")
        known = s if known is None else known.unionByName(s)
    scratch = Scratch(seeds.sparkSession)
    edges, known = scratch.write(edges), scratch.write(known)
    graph = lambda c: F.substring_index(c, "\x1f", 1)
    pos = labels.where("value > 0").select(F.col("id").alias("q")).distinct()
    scores = pagerank(edges, known, alpha=alpha, tol=tol, max_iter=max_iter, start="uniform", stop="n_tol", on_fail="raise", graph_of=graph).scores
    marked = scores.join(pos, F.substring_index("id", "\x1f", -1) == F.col("q"), "left").select("run_id", "id", (F.col("score") if digits is None else F.round("score", digits)).alias("score"), F.col("q").isNotNull().alias("hit"))
    ranked = scratch.write(rank_nodes(marked, exclude=known, hit=F.col("hit")))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().groupBy(graph(F.col("id")).alias("g1")).agg(F.count(F.lit(1)).alias("n_nodes"))
    n_seeds = known.groupBy(F.col("run_id").alias("g2")).agg(F.count(F.lit(1)).alias("n_seeds"))
    n_pos = ranked.groupBy(F.col("run_id").alias("g3")).agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("n_pos_eval"))
    out = top_metrics(ranked, k).withColumnRenamed("run_id", "graph")
    for n, g in ((nodes, "g1"), (n_seeds, "g2"), (n_pos, "g3")):
        out = out.join(n, F.col("graph") == F.col(g)).drop(g)
    score = F.nanvl("auprc", F.lit(None).cast("double"))
    return out.orderBy(score.desc_nulls_last(), F.col("recall_at_k").desc_nulls_last(), "graph")
