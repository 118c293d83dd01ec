"""Similarity graphs from vectors, per-anchor normalizations, and checks of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions import columns as C
from weftgraph.operators.edges import undirected_max
from weftgraph.operators.ranking import exact_quantiles, number_rows, running_sum
from weftgraph.session import Scratch, shuffle_partitions


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1)
    return v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-12)


#: Vectors read at once, anchors that meet them in one product, and anchors and places of lists that a task holds.
CHUNK, TILE, BLOCK, PLACES = 4096, 512, 8192, 1 << 20


def chunks(folder: str, part: int, parts: int, columns: list[str], rows: int = CHUNK) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of the files of a table in the shared folder, and the number of the first; every ``parts``-th file. Numbers rise in the order of files and rows."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    names = sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(path)) if x.path.endswith(".parquet"))
    for i in range(part, len(names), parts):
        at = i << 32
        with fs.open_input_file(names[i]) as f:
            for b in pq.ParquetFile(f).iter_batches(rows, columns=columns, use_threads=False):
                yield at, b
                at += b.num_rows


def _best(names: pa.Array, q: np.ndarray, m: int, read: Callable[[list[str]], Iterator[tuple[int, pa.RecordBatch]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, number of the vector and exact cosine of the ``m`` most similar of each anchor, in order.

    Products are made in single precision, and what they can't rule out by the bound of their error is computed again in double precision.
    """
    n, error = len(q), (q.shape[1] + 8) * 2.0**-23
    single, floor = q.astype(np.float32), np.full(n, -np.inf, np.float32)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    size = 0

    def settle() -> None:
        """Keep the first m of each anchor by similarity, ties by number."""
        nonlocal size
        a, k, c = (np.concatenate(x) for x in zip(*held))
        key = np.round(c, 12)
        order = np.lexsort((k, -key, a))
        order = order[np.arange(len(a)) - np.searchsorted(a[order], a[order], "left") < m]
        a, k, c, key = a[order], k[order], c[order], key[order]
        full = np.flatnonzero(np.bincount(a, minlength=n) >= m)
        least = key[np.searchsorted(a, full, "right") - 1]
        floor[full] = np.maximum(floor[full], (least - 2 * error).astype(np.float32))
        held[:] = [(a, k, c)]
        size = len(a)

    for first, b in read(["id", "emb"]):
        v = _rows(b.column(1))
        v32 = np.ascontiguousarray(v.T, np.float32)
        own = pc.index_in(b.column(0), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
        for lo in range(0, n, TILE):
            s = single[lo : lo + TILE] @ v32
            mine = np.flatnonzero((own >= lo) & (own < lo + TILE))
            s[own[mine] - lo, mine] = -np.inf
            least = floor[lo : lo + TILE]
            if s.shape[1] > m and np.isneginf(least).any():
                np.maximum(least, np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m] - np.float32(3 * error), out=least)
            a, col = np.divmod(np.flatnonzero(s > least[:, None]), s.shape[1])
            a += lo
            c = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[a[i : i + CHUNK]], v[col[i : i + CHUNK]]) for i in range(0, len(a), CHUNK)]])
            held.append((a, first + col, c))
            size += len(a)
            if size > 2 * m * n + 16 * CHUNK:
                settle()
    settle()
    return held[0]


def top_candidates(anchors: DataFrame, vectors: DataFrame, m: int, *, block_bytes: int = 16 << 20, positive: int | None = None) -> DataFrame:
    """(``u``, ``v``, ``c``): the ``m`` most similar vectors of each anchor by cosine, itself excluded, ties by id.

    ``anchors(id, emb)`` is a stated query set with each id once, ``vectors(id, emb)`` all rows, of one length and without NULL
    (see ``usable_vectors``). With ``positive`` an anchor that has so many similarities above 0 gives these only: no more count where
    weights rise with the similarity.

    The vectors are sorted by id into a table in the shared folder. Tasks split the anchors, and each reads this table in chunks
    against blocks of its anchors, of at most ``block_bytes``, with running lists, so that what a task holds is bounded by the chunk, the block and its lists, and what
    it gives out is complete. Where the anchors are too few for all tasks, files are split too, and the lists of the parts are joined.
    The work is anchors times vectors by definition; where that is too much, an approximate index belongs in its place.
    """
    spark = vectors.sparkSession
    scratch, width = Scratch(spark), shuffle_partitions(spark)
    table = scratch.write(vectors.select("id", "emb").repartitionByRange(width, "id").sortWithinPartitions("id"))
    folder = scratch.path(table)
    few = table if anchors is vectors else scratch.write(anchors.select("id", "emb"))
    parts = max(1, width // max(1, few.count() // TILE))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(rows: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
            names, q = rows["id"].combine_chunks(), _rows(rows["emb"].combine_chunks())
            read = lambda columns: chunks(folder, part, parts, columns)
            some = m if positive is None or parts > 1 else min(m, positive)
            a, k, c = _best(names, q, some, read)
            if some < m:  # the others need all their candidates
                less = np.bincount(a[np.round(c, 12) > 0], minlength=len(q)) < some
                a, k, c = (x[~less[a]] for x in (a, k, c))
                rest = np.flatnonzero(less)
                for lo in range(0, len(rest), max(64, PLACES // m)):
                    at = rest[lo : lo + max(64, PLACES // m)]
                    x, y, z = _best(names.take(pa.array(at)), q[at], m, read)
                    a, k, c = np.concatenate([a, at[x]]), np.concatenate([k, y]), np.concatenate([c, z])
            order = np.argsort(k, kind="stable")
            a, k, c = a[order], k[order], c[order]
            for first, b in read(["id"]):
                lo, hi = np.searchsorted(k, [first, first + b.num_rows])
                if hi > lo:
                    v = b.column(0).take(pa.array(k[lo:hi] - first))
                    yield from pa.table({"u": names.take(pa.array(a[lo:hi])), "v": v, "c": c[lo:hi]}, schema=pa.schema([("u", pa.string()), ("v", pa.string()), ("c", pa.float64())])).to_batches(1 << 14)

        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            for part in pc.unique(t["part"]).to_pylist():
                yield from lists(t.filter(pc.equal(t["part"], part)), part)

        for b in batches:
            block = max(1, min(BLOCK, PLACES // m, block_bytes * b.num_rows // max(1, 8 * len(b.column(1).flatten())))) if b.num_rows else 1
            for lo in range(0, b.num_rows, min(TILE, block)):
                held.append(b.slice(lo, min(TILE, block)))
                if sum(x.num_rows for x in held) >= block:
                    yield from flush()
        if held:
            yield from flush()

    ways = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    found = few.select("id", "emb", ways.alias("part")).repartition(width, "part", "id").mapInArrow(search, "u string, v string, c double")
    if parts == 1:
        return found
    best = Window.partitionBy("u").orderBy(F.round("c", 12).desc(), F.col("v"))
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= m).select("u", "v", "c")


def usable_vectors(df: DataFrame, id_col: str, emb: str, size: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``id``, ``emb``): rows with an id and a finite vector, not all zero, of ``size`` numbers if that is given."""
    ok = F.coalesce(C.all_finite(emb) & (F.size(emb) > 0 if size is None else F.size(emb) == size) & F.exists(emb, lambda x: x != 0), F.lit(False))
    return df.where(F.col(id_col).isNotNull() & ok).select(F.col(id_col).cast("string").alias("id"), F.col(emb).alias("emb"), *keep)


def softmax_weight(cands: DataFrame, tau: float = 0.1) -> DataFrame:
    """Weight of each candidate: softmax over all candidates of its anchor, shifted by the largest."""
    w = Window.partitionBy("u")
    e = F.exp((F.col("c") - F.max("c").over(w)) / tau)
    return cands.withColumn("e", e).withColumn("w", F.col("e") / (F.sum("e").over(w) + 1e-12)).drop("e")


def positive_cosine(cands: DataFrame) -> DataFrame:
    return cands.withColumn("w", F.greatest(F.col("c"), F.lit(0.0)))


def anchor_minmax(cands: DataFrame, score: str = "c") -> DataFrame:
    """Min-max within each anchor; 0 if all are alike."""
    w = Window.partitionBy("u")
    return cands.withColumn("w", C.minmax01(score, F.min(score).over(w), F.max(score).over(w)))


def anchor_sigmoid_z(cands: DataFrame, score: str = "c", temp: float = 1.0) -> DataFrame:
    """Sigmoid of the z-score within each anchor (population deviation plus 1e-12)."""
    w = Window.partitionBy("u")
    z = (F.col(score) - F.avg(score).over(w)) / (F.coalesce(F.stddev_pop(score).over(w), F.lit(0.0)) + 1e-12)
    return cands.withColumn("w", C.sigmoid(z / temp))


def best_edges(weighted: DataFrame, m: int, *, positive: bool = True) -> DataFrame:
    """The ``m`` heaviest candidates of each anchor, made undirected by the larger weight; above 0 only, unless told otherwise."""
    best = Window.partitionBy("u").orderBy(F.round("w", 12).desc(), F.col("v"))
    kept = weighted.where(~F.isnan("w")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= m)
    out = undirected_max(kept)
    return out.where("w > 0") if positive else out


def knn_graph(anchors: DataFrame, vectors: DataFrame, *, cand_m: int = 500, topm: int = 20, weight: str = "cos_pos", tau: float = 0.1) -> DataFrame:
    """(``u``, ``v``, ``w``): candidates by cosine, weighted (``cos_pos`` or ``row_softmax`` over all candidates), the best kept, undirected."""
    cands = top_candidates(anchors, vectors, cand_m, positive=None if weight == "row_softmax" else topm)
    return best_edges(softmax_weight(cands, tau) if weight == "row_softmax" else positive_cosine(cands), topm)


# Checks of an embedding table.


def finite_report(df: DataFrame, emb: str) -> DataFrame:
    """One row: vectors, how many hold a value that isn't finite, smallest and largest value, and the share of values near zero."""
    x = df.select(F.coalesce(C.all_finite(emb), F.lit(False)).alias("ok"), F.filter(F.col(emb), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))).alias("v"))
    near = F.size(F.filter("v", lambda v: F.abs(v) < 1e-6))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.min(F.array_min("v")).cast("double").alias("min"), F.max(F.array_max("v")).cast("double").alias("max"), (F.sum(near) / F.sum(F.size("v"))).alias("near_zero"))


def quantiles(df: DataFrame, column: str, qs: list[float]) -> DataFrame:
    """(``q``, ``value``): exact quantiles with linear interpolation."""
    return exact_quantiles(df, column, qs)


def knn_sanity(vectors: DataFrame, k: int = 512, top: int = 5, seed: int = 0) -> DataFrame:
    """(``kind``, ``q01``, ``q50``, ``q99``): quantiles of the cosine to the best, to the ``top``-th best and to any other vector within a sample of ``k``.

    The sample is the feature: a glance at an embedding. It is taken in hash order.
    """
    some = vectors.orderBy(C.ordered_hash("id", seed=seed), "id").limit(k)
    best = top_candidates(some, some, k)
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.round("c", 12).desc(), "v")))
    kinds = {"top1": ranked.where("r = 1"), f"top{top}": ranked.where(F.col("r") == top), "any": ranked.where("u < v")}
    out = None
    for kind, df in kinds.items():
        q = exact_quantiles(df, "c", [0.01, 0.5, 0.99]).groupBy().pivot("q", [0.01, 0.5, 0.99]).agg(F.first("value")).toDF("q01", "q50", "q99").select(F.lit(kind).alias("kind"), "q01", "q50", "q99")
        out = q if out is None else out.unionByName(q)
    return out


def rank_correlation(df: DataFrame, x: str, y: str, tie: str, *, average: bool = False) -> DataFrame:
    """One row ``rho``: correlation of ordinal ranks (ties by ``tie``), or of average ranks. Ranks are counted over range partitions."""
    df = df.select(x, y, tie)
    if average:
        def ranks(c: str) -> DataFrame:
            per = df.groupBy(F.col(c).alias(f"{c}_k")).agg(F.count(F.lit(1)).alias("n"))
            at = number_rows(per, f"{c}_k")
            ranked = running_sum(at, "at", "n")
            return ranked.select(f"{c}_k", (F.col("before") + (F.col("n") + 1) / 2).alias(f"{c}_r"))

        j = df.join(ranks(x), F.col(x) == F.col(f"{x}_k")).join(ranks(y), F.col(y) == F.col(f"{y}_k"))
        return j.agg(F.corr(f"{x}_r", f"{y}_r").alias("rho"))
    a = number_rows(df, x, tie).withColumnRenamed("at", "ax")
    b = number_rows(df, y, tie).select(F.col(tie).alias("t"), F.col("at").alias("ay"))
    return a.join(b, F.col(tie) == F.col("t")).agg(F.corr("ax", "ay").alias("rho"))
