"""PageRank of many seed sets over blocks of edges, and ranks of few nodes among all, without a row for each node and run."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import adjacency
from weftgraph.operators.ranking import number_rows
from weftgraph.session import Scratch, shuffle_partitions

#: Edges of a block, edges of a node from which it is in several blocks, and runs that go together.
BLOCK_EDGES, HOT_EDGES, LANES = 1 << 19, 200_000, 8


def _save(root: str, name: str, value: object) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    part = f"{path}/{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:  # a task that runs again writes the same
        f.write(pickle.dumps(value, protocol=5))
    fs.move(part, f"{path}/{name}")


def _load(root: str, name: str, default: object = None) -> object:
    fs, path = pyarrow.fs.FileSystem.from_uri(root)
    if default is not None and fs.get_file_info(f"{path}/{name}").type == pyarrow.fs.FileType.NotFound:
        return default
    with fs.open_input_stream(f"{path}/{name}") as f:
        return pickle.loads(f.read())


def _delete(root: str, name: str) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(root)
    fs.delete_file(f"{path}/{name}")


class Blocks:
    """A graph as blocks of edges in the shared folder, by source. Node n, by order of ids from 0, belongs to block n modulo their number, at place n divided by it.

    A node with more than HOT_EDGES edges has copies in further blocks, each with a share of its edges and the same score.
    """

    def __init__(self, edges: DataFrame):
        spark = self.spark = edges.sparkSession
        self.scratch = Scratch(spark)
        self.root = f"{self.scratch.root}/blocks"
        edges = self.scratch.write(edges.select("u", "v", "w"))
        adj = adjacency(edges)
        deg = adj.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("weighted_degree"), F.count(F.lit(1)).alias("degree"))
        nodes = self.nodes = self.scratch.write(number_rows(deg, "id").withColumnRenamed("at", "node"))
        self.n, total = nodes.agg(F.count(F.lit(1)), F.sum("degree")).first()
        parts = self.parts = max(1, -(-int(total or 0) // BLOCK_EDGES))
        hot = [(r[0], min(parts, -(-r[1] // HOT_EDGES))) for r in nodes.where(F.col("degree") > HOT_EDGES).select("node", "degree").orderBy("node").collect()]  # at most total / HOT_EDGES
        self.hot = hot = [x for x in hot if x[1] > 1]
        copies = F.least(F.lit(parts), F.ceil(F.col("degree") / HOT_EDGES)).cast("int").alias("copies")
        self.copies = nodes.select("id", "node", copies)
        # The edges are joined with their ends before they are doubled.
        end = lambda x: nodes.select(F.col("id").alias(f"{x}_id"), F.struct("node", "weighted_degree", copies).alias(x))
        both = edges.where("w > 0").join(end("a"), F.col("u") == F.col("a_id")).join(end("b"), F.col("v") == F.col("b_id"))
        way = lambda x, y: F.struct(F.col(f"{x}.node").alias("s"), F.col(f"{y}.node").alias("dst"), F.col("w"), F.col(f"{x}.weighted_degree").alias("weighted_degree"), F.col(f"{x}.copies").alias("copies"))
        steps = both.select(F.inline(F.array(way("a", "b"), way("b", "a")))).where("weighted_degree > 0")
        part = F.pmod(F.col("s") + F.pmod(F.xxhash64("dst"), F.col("copies")), F.lit(parts)).cast("int").alias("part")
        root, slots = self.root, self.slots

        def build(rows: pa.Table) -> pa.Table:
            p = rows["part"][0].as_py()
            s, d, share = (rows[c].to_numpy() for c in ("s", "dst", "share"))
            order = np.lexsort((s, d))
            s, d, share = s[order], d[order], share[order]
            uniq, starts = np.unique(d, return_index=True)
            sends = []
            for t in range(parts):
                mine = np.flatnonzero((uniq % parts == t) | np.isin(uniq, [h for h, c in hot if (t - h) % parts < c]))
                sends.append(mine.astype(np.int32))
                _save(root, f"slots-{p}-{t}", slots(uniq[mine], t).astype(np.int32))
            _save(root, f"block-{p}", (slots(s, p).astype(np.int32), share, starts, sends))
            return pa.table({"part": pa.array([p], pa.int32())})

        self._each(steps.select(part, "s", "dst", (F.col("w") / F.col("weighted_degree")).alias("share")), build)
        idle = nodes.where("weighted_degree <= 0").select(F.pmod("node", F.lit(parts)).cast("int").alias("part"), "node")
        self._each(idle, lambda rows: (_save(root, f"idle-{rows['part'][0].as_py()}", rows["node"].to_numpy() // parts), rows.select(["part"]).slice(0, 1))[1])

    @property
    def slots(self) -> Callable[[np.ndarray, int], np.ndarray]:
        """Places of nodes in a block: its own ones first, then the copies."""
        parts, n, hot = self.parts, self.n, self.hot

        def run(node: np.ndarray, p: int) -> np.ndarray:
            extra = np.array([h for h, c in hot if h % parts != p and (p - h) % parts < c], np.int64)
            return np.where(node % parts == p, node // parts, (n - p + parts - 1) // parts + np.searchsorted(extra, node))

        return run

    def _each(self, rows: DataFrame, f: Callable[[pa.Table], pa.Table]) -> None:
        rows.groupBy("part").applyInArrow(f, "part int").count()

    def run(self, f: Callable[[int], Iterator[pa.Table]], schema: str) -> DataFrame:
        """Rows that ``f`` gives for each block, a task for each."""

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p in b.column(0).to_pylist():
                    for t in f(p):
                        yield from t.to_batches(1 << 14)

        return self.spark.range(0, self.parts, 1, self.parts).mapInArrow(call, schema)

    def put(self, rows: DataFrame, name: str, *columns: str, everywhere: bool = False) -> None:
        """Files ``name``-part of ``rows(run_id, id, ...)``, ``run`` being the number in order; with copies if they are asked for."""
        root = self.root
        j = rows.join(self.copies.withColumnRenamed("id", "i"), F.col("id") == F.col("i"))
        j = j.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1) if everywhere else F.array(F.lit(0))))
        part = F.pmod(F.col("node") + F.col("copy"), F.lit(self.parts)).cast("int").alias("part")
        self._each(j.select(part, "run", "node", *columns), lambda t: (_save(root, f"{name}-{t['part'][0].as_py()}", {c: t[c].to_numpy() for c in ("run", "node", *columns)}), t.select(["part"]).slice(0, 1))[1])

    def walk(self, seeds: DataFrame, n_runs: int, *, alpha: float, tol: float | None, max_iter: int) -> tuple[str, list[int]]:
        """Scores of PageRank from equal shares of ``seeds(run, run_id, id)``: the name of their files, and the last iteration of each run."""
        name, root, parts, n, slots, hot = f"w{uuid.uuid4().hex[:8]}", self.root, self.parts, self.n, self.slots, self.hot
        one = self.scratch.write(seeds.select("run", "id").distinct().join(self.nodes.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_semi"))
        many = one.groupBy(F.col("run").alias("r")).agg(F.count(F.lit(1)).alias("m"))
        if many.count() < n_runs:
            raise ValueError("no seeds in the graph")
        self.put(one.join(many, F.col("run") == F.col("r")).select("run", "id", (F.lit(1.0) / F.col("m")).alias("p")), f"{name}-seeds", "p", everywhere=True)
        none = {"run": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "p": np.zeros(0)}

        def iterate(lo: int, hi: int, i: int, last: bool) -> Callable[[int], Iterator[pa.Table]]:
            def run(p: int) -> Iterator[pa.Table]:
                width, own = hi - lo, (n - p + parts - 1) // parts
                extra = sum(h % parts != p and (p - h) % parts < c for h, c in hot)
                given = _load(root, f"{name}-seeds-{p}", none)
                at = np.flatnonzero((given["run"] >= lo) & (given["run"] < hi))
                place, lane, share = slots(given["node"][at], p), given["run"][at] - lo, given["p"][at]
                new, lost = np.zeros((width, own + extra)), np.zeros(width)  # a row for each run: gathering and adding are quickest along a row
                if i == 0:
                    new[lane, place] = share
                else:
                    for q in range(parts):
                        values, gone = _load(root, f"{name}-{lo}-{i - 1}-{q}-{p}", (None, None)) or (None, None)
                        if values is not None:
                            there = _load(root, f"slots-{q}-{p}")
                            for x, more in zip(new, values):
                                x[there] += more
                        if gone is not None:
                            lost += gone
                    new *= alpha
                    new[lane, place] += share * ((1 - alpha) + alpha * lost[lane])
                rest = np.full(width, np.nan)
                if tol is not None:
                    rest = np.abs(new[:, :own] - _load(root, f"{name}-state-{lo}-{i - 1}-{p}")).sum(axis=1) if i else np.full(width, np.inf)
                if tol is not None or last:
                    _save(root, f"{name}-state-{lo}-{i}-{p}", new[:, :own])
                if not last:
                    src, w, starts, sends = _load(root, f"block-{p}", (None, None, None, [None] * parts))
                    sums = [np.add.reduceat(x[src] * w, starts) for x in new] if src is not None else None
                    gone = new[:, _load(root, f"idle-{p}", np.zeros(0, np.int64))].sum(axis=1)
                    for t in range(parts):
                        _save(root, f"{name}-{lo}-{i}-{p}-{t}", (np.stack([x[sends[t]] for x in sums]) if sums is not None else None, gone))
                yield pa.table({"lane": np.arange(width), "rest": rest})

            return run

        def clear(lo: int, i: int, state: bool) -> None:
            for q in range(parts):
                for t in range(parts):
                    if not state:
                        _delete(root, f"{name}-{lo}-{i}-{q}-{t}")
                if state:
                    _delete(root, f"{name}-state-{lo}-{i}-{q}")

        ends = [0] * n_runs
        for lo in range(0, n_runs, LANES):
            hi, keep, live = min(lo + LANES, n_runs), set(), set(range(lo, min(lo + LANES, n_runs)))
            for i in range(max_iter + 1):
                last = i == max_iter
                rest = self.run(iterate(lo, hi, i, last), "lane long, rest double").groupBy("lane").agg(F.sum("rest")).collect()
                done = {lo + r[0] for r in rest if last or (tol is not None and r[1] <= tol)} & live
                for x in done:
                    ends[x] = i
                if i:
                    clear(lo, i - 1, False)
                    if tol is not None and i - 1 not in keep:
                        clear(lo, i - 1, True)
                keep |= {i} if done else set()
                live -= done
                if not live:
                    if not last:
                        clear(lo, i, False)
                    break
        return f"{name}-state", ends

    def scores(self, state: str, ends: list[int], runs: DataFrame) -> DataFrame:
        """(``run_id``, ``id``, ``score``) of all nodes; ``runs(run, run_id)``."""
        parts, n_runs, score = self.parts, len(ends), self.scores_of(state, ends)

        def read(p: int) -> Iterator[pa.Table]:
            for r in range(n_runs):
                x = score(p, r)
                yield pa.table({"run": np.full(len(x), r), "node": np.arange(len(x)) * parts + p, "score": x})

        got = self.run(read, "run long, node long, score double").withColumnRenamed("run", "r").hint("merge")  # by its plan it has a row for each block, and would be broadcast
        return got.join(self.nodes.select("id", F.col("node").alias("k")), F.col("node") == F.col("k")).join(F.broadcast(runs), F.col("r") == F.col("run")).select("run_id", "id", "score")

    def scores_of(self, state: str, ends: list[int]) -> Callable[[int, int], np.ndarray]:
        """Reads the scores of a block in a run."""
        root = self.root
        return lambda p, r: np.ascontiguousarray(_load(root, f"{state}-{r // LANES * LANES}-{ends[r]}-{p}")[r % LANES])

    def values_of(self, column: str) -> Callable[[int, int], np.ndarray]:
        """Reads a column of the nodes, the same in all runs."""
        root, parts = self.root, self.parts
        of = self.nodes.select(F.pmod("node", F.lit(parts)).cast("int").alias("part"), "node", F.col(column).cast("double").alias("x"))
        self._each(of, lambda t: (_save(root, f"{column}-{t['part'][0].as_py()}", t["x"].to_numpy()[np.argsort(t["node"].to_numpy())]), t.select(["part"]).slice(0, 1))[1])
        return lambda p, r: _load(root, f"{column}-{p}")

    def ranked(self, score: Callable[[int, int], np.ndarray], n_runs: int, seeds: DataFrame, tests: DataFrame) -> DataFrame:
        """(``run``, ``rank``, ``hit``, ``hits``) of the tests among all nodes but the seeds, by falling score and id. ``score(p, r)`` gives those of block p in run r.

        Only the tests' scores are gathered, in a file for each run and block; each block counts its nodes before each of them.
        """
        name, root, parts = f"r{uuid.uuid4().hex[:8]}", self.root, self.parts
        self.put(seeds.select("run", "id").distinct(), f"{name}-out", everywhere=False)
        self.put(tests.select("run", "id").distinct(), f"{name}-in", everywhere=False)
        none = {"run": np.zeros(0, np.int64), "node": np.zeros(0, np.int64)}

        def members(p: int, r: int) -> tuple[np.ndarray, np.ndarray]:
            out, in_ = _load(root, f"{name}-out-{p}", none), _load(root, f"{name}-in-{p}", none)
            gone = out["node"][out["run"] == r]
            return gone, np.setdiff1d(in_["node"][in_["run"] == r], gone)

        def gather(p: int) -> Iterator[pa.Table]:
            for r in range(n_runs):
                node = members(p, r)[1]
                _save(root, f"{name}-at-{r}-{p}", (node, score(p, r)[node // parts]))
            yield pa.table({"run": np.arange(1)})

        def count(p: int) -> Iterator[pa.Table]:
            for r in range(n_runs):
                node, s = (np.concatenate(x) for x in zip(*(_load(root, f"{name}-at-{r}-{q}") for q in range(parts))))
                order = np.lexsort((node, -s))
                node, s = node[order], s[order]
                own = score(p, r)
                others = np.ones(len(own), bool)
                for x in members(p, r):
                    others[x // parts] = False
                i = np.flatnonzero(others)
                both = np.lexsort((np.concatenate([i * parts + p, node]), -np.concatenate([own[i], s])))
                before = np.cumsum(both < len(i))[both >= len(i)]
                yield pa.table({"run": np.full(len(node), r), "hits": np.arange(1, len(node) + 1), "before": before.astype(np.int64)})

        self.run(gather, "run long").count()
        got = self.run(count, "run long, hits long, before long").groupBy("run", "hits").agg(F.sum("before").alias("b"))
        return got.select("run", (F.col("b") + F.col("hits")).alias("rank"), F.lit(1).alias("hit"), "hits")
