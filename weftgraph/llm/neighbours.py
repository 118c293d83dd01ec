"""Most similar vectors for every vector (problem 2)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.keys import once
from weftgraph.operators.ranking import number_rows
from weftgraph.session import HOT_KEYS, Scratch, fits_broadcast

#: Dimensions of the projection that a curve runs through, and bits of each: 60 bits, which leave three to break ties.
AXES, BITS = 12, 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each cell (a row of coordinates below 2**bits), as its leading 63 bits.

    The coordinates are turned into the transposed index by undoing, from the coarsest bit on, the reflections
    and exchanges of axes that each level of the curve makes, then by a Gray decoding.
    """
    x = cells.astype(np.uint32).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(axes):
            upper = (x[i] & top) != 0
            swap = np.where(upper, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    key, used = np.zeros(x.shape[1], np.int64), 0
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            if used < 63:
                key = (key << 1) | ((x[i] >> np.uint32(level)) & np.uint32(1)).astype(np.int64)
                used += 1
    return key


def curve_keys(unit: np.ndarray, seed: int, mean: np.ndarray, spread: float) -> np.ndarray:
    """Keys of unit vectors along one shifted curve: a random rotation, AXES of its dimensions, a shift, Hilbert order."""
    rng = np.random.default_rng(seed)
    axes = min(AXES, unit.shape[1])
    turn = np.linalg.qr(rng.normal(size=(unit.shape[1], unit.shape[1])))[0][:, :axes].astype(np.float32)
    z = ((unit - mean) @ turn) / np.float32(spread)
    share = 1 / (1 + np.exp(-1.702 * np.clip(z, -8, 8)))  # about the share of a normal distribution below z
    cells = (share * 0.8 + 0.2 * rng.random(axes, dtype=np.float32)) * (1 << BITS)
    return hilbert(np.minimum(cells, (1 << BITS) - 1), BITS)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # so that squares stay in range
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _largest(s: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` largest values of each row, in no order: those of the columns' groups with the largest maxima, then of these."""
    n, width = s.shape
    groups = width // 8
    if groups <= keep or width % 8:
        return np.argpartition(s, width - keep, axis=1)[:, width - keep :]
    top = s.reshape(n, 8, groups).max(axis=1)
    best = np.argpartition(top, groups - keep, axis=1)[:, groups - keep :]
    columns = (best[:, None, :] + groups * np.arange(8)[None, :, None]).reshape(n, 8 * keep)
    values = np.take_along_axis(s, columns, axis=1)
    return np.take_along_axis(columns, np.argpartition(values, 7 * keep, axis=1)[:, 7 * keep :], axis=1)


def _best_in_range(ids: np.ndarray, vectors: np.ndarray, k: int, orders: int, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, similarity in millionths): up to k best of each row among the windows of several orders of a range."""
    n = len(ids)
    unit = _unit(vectors)
    small = unit.astype(np.float32)
    keep = 2 * k + 2
    if n < 2:
        return (np.empty(0, np.int64),) * 3
    mean = small.mean(axis=0)
    spread = float((small - mean).std()) or 1.0
    step, width = 256, 256 + 2 * window
    others, sims = np.zeros((n, orders * keep), np.int64), np.full((n, orders * keep), -3, np.float32)
    for r in range(orders):
        order = np.argsort(curve_keys(small, seed + r, mean, spread), kind="stable")
        sorted_ = small[order]
        for a in range(0, n, step):
            b = min(a + step, n)
            lo, hi = max(0, a - window), min(n, b + window)
            s = np.full((b - a, max(width, keep)), -3, np.float32)
            np.matmul(sorted_[a:b], sorted_[lo:hi].T, out=s[:, : hi - lo])
            s[np.arange(b - a), np.arange(a - lo, b - lo)] = -3
            best = _largest(s, keep)
            others[order[a:b], r * keep : (r + 1) * keep] = order[np.minimum(lo + best, n - 1)]
            sims[order[a:b], r * keep : (r + 1) * keep] = np.take_along_axis(s, best, axis=1)
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, n, 1 << 12):
        # Each candidate once, then the best by single precision, then those in double.
        c, s = others[a : a + (1 << 12)], sims[a : a + (1 << 12)]
        by = np.argsort(np.where(s > -3, c, n), axis=1)
        c, s = np.take_along_axis(c, by, axis=1), np.take_along_axis(s, by, axis=1)
        s[:, 1:][c[:, 1:] == c[:, :-1]] = -3
        best = np.argpartition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep :]
        c, s = np.take_along_axis(c, best, axis=1), np.take_along_axis(s, best, axis=1)
        exact = np.rint(np.einsum("rd,rkd->rk", unit[a : a + (1 << 12)], unit[c]) * 1e6).astype(np.int64)
        exact[s <= -3] = -(10**9)
        rank = np.lexsort((ids[c], -exact), axis=1)[:, :k]
        c, exact = np.take_along_axis(c, rank, axis=1), np.take_along_axis(exact, rank, axis=1)
        row, place = np.nonzero(exact > -(10**9))
        out.append((ids[a + row], ids[c[row, place]], exact[row, place]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """Rows as one block: ids, then the bytes of the numbers by place, which compress well."""
    planes = np.ascontiguousarray(vectors.astype("<f4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(ids.astype("<i8").tobytes() + planes.tobytes(), "zstd", asbytes=True)


def _unpack(block: bytes, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(block, 8 * n + 4 * n * size, "zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8, offset=8 * n).reshape(4, -1)
    return np.frombuffer(raw, "<i8", n), np.ascontiguousarray(planes.T).view("<f4").reshape(n, size)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)


def usable(c: Column, size: int) -> Column:
    """A vector of ``size`` finite numbers, not all zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == size) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def latest_usable(df: DataFrame, row_id: str, key: Column, vector: str, size: int) -> DataFrame:
    """(``r``, ``v``): of the usable vectors with one key, that of the largest row id."""
    rows = once(df, r=F.col(row_id).cast("long"), k=key, v=F.col(vector).cast("array<float>")).where(F.col("k").isNotNull() & F.col("r").isNotNull() & usable(F.col("v"), size))
    several = rows.groupBy("k").agg(F.max("r").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("kk"), "last")
    old = rows.select("r", "k").join(several, F.col("k") == F.col("kk")).where("r <> last").select(F.col("r").alias("old"))
    small = fits_broadcast(old)
    return rows.select("r", "v").join(F.broadcast(old) if small else old, F.col("r") == F.col("old"), "left_anti")


def curves_for(ranges: int) -> int:
    """Curves with which at least 95 of 100 neighbours share a range on some curve: four up to 16 ranges, one and a half more for each doubling.

    Measured on 80,000 vectors of the test data, cut into 5 to 500 ranges; see the README.
    """
    return 4 + math.ceil(1.5 * math.log2(max(1.0, ranges / 16)))


def nearest(
    rows: DataFrame,
    *,
    k: int = 5,
    size: int = 128,
    curves: int | None = None,
    orders: int = 4,
    window: int = 384,
    rows_per_range: int = 16_384,
    seed: int = 11,
) -> DataFrame:
    """(``row``, ``other``, ``sim``, ``rank``): the ``k`` most similar rows of each row of (``r``, ``v``), found approximately.

    Several Hilbert curves, each through another random projection with another shift, order all
    vectors. Each order is cut into ranges of about ``rows_per_range`` rows, which overlap by ``window`` rows on either
    side; within a range, ``orders`` further curves of its own bring near vectors together, and windows of ``window`` rows to
    either side are compared. The best of all windows of all curves merge by similarity: the cosine in double precision,
    in millionths; of equal ones the smaller row comes first. Mean and spread for the projections and the places at
    which ranges are cut come from all vectors; ranks are counted over range partitions. Vectors move once for each
    curve, in compressed blocks, to a task of their range; a range has a bounded size, however the vectors are spread.

    The more ranges, the more neighbours lie across a cut, so the number of curves grows with the logarithm of the
    number of ranges (see ``curves_for``) unless it is given.

    Of equal vectors only the ``k`` + 1 smallest rows take part in the search: no row can have another of
    them among its best. The others get their ``k`` equal ones. Groups of equal vectors with more than 1/HOT_KEYS of such
    rows are joined by broadcast. Rows must be unique and usable; empty input gives an empty result.
    """
    spark = rows.sparkSession
    schema = "row bigint, other bigint, sim bigint"
    marked = once(rows, "r", h1=F.xxhash64("v"), h2=F.xxhash64("v", F.lit(seed)))
    groups = Scratch(spark).write(marked.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "n"))
    crowded = groups.agg(F.sum("n")).first()[0] or 0
    extra = None
    if crowded:
        hot = F.col("n") > F.lit(crowded // HOT_KEYS)

        def by_group(left: DataFrame, right: DataFrame) -> DataFrame:
            """``left(h1, h2)`` with ``right(g1, g2, n)``, which has one row per group."""
            on = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
            return left.join(right.where(~hot), on).unionByName(left.join(F.broadcast(right.where(hot)), on))

        crowd = by_group(marked, groups).select("r", "g1", "g2")
        heads = crowd.withColumn("i", F.row_number().over(Window.partitionBy("g1", "g2").orderBy("r"))).where(F.col("i") <= k + 1)  # cut off before the shuffle, too
        head = heads.select(F.col("r").alias("hr"))
        rest = crowd.join(head, F.col("r") == F.col("hr"), "left_anti").select("r", F.col("g1").alias("h1"), F.col("g2").alias("h2"))
        firsts = heads.where(F.col("i") <= k).groupBy("g1", "g2").agg(F.sort_array(F.collect_list("r")).alias("firsts"))
        firsts = firsts.join(groups.withColumnsRenamed({"g1": "q1", "g2": "q2"}), (F.col("g1") == F.col("q1")) & (F.col("g2") == F.col("q2"))).select("g1", "g2", "n", "firsts")
        extra = by_group(rest, firsts).select(F.col("r").alias("row"), F.explode("firsts").alias("other"), F.lit(1_000_000).cast("long").alias("sim"))
        gone = rest.select(F.col("r").alias("gone"))
        rows = rows.join(F.broadcast(gone) if fits_broadcast(gone) else gone, F.col("r") == F.col("gone"), "left_anti")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(size + 1), 0
        for b in batches:
            if b.num_rows:
                u = _unit(_vectors(b.column(0), size))
                total += np.append(u.sum(axis=0), (u * u).sum())
                count += b.num_rows
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(range(size + 2), pa.int32()), pa.array(np.append(total, count), pa.float64())], ["i", "x"])

    sums = {r[0]: r[1] for r in rows.select("v").mapInArrow(moments, "i int, x double").groupBy("i").agg(F.sum("x")).collect()}
    if not sums:
        return spark.createDataFrame([], schema + ", rank int")
    n = int(sums[size + 1])
    mean = np.array([sums[i] for i in range(size)]) / n
    spread = math.sqrt(max(sums[size] / n - float(mean @ mean), 0) / size) or 1.0
    mean = mean.astype(np.float32)
    ranges = max(1, math.ceil(n / rows_per_range))
    curves = curves or curves_for(ranges)

    def keys(v: np.ndarray) -> list[np.ndarray]:
        u = _unit(v).astype(np.float32)
        tie = (v.view(np.uint32).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(61)).astype(np.int64)  # cells with more rows than a range are cut by it
        return [(curve_keys(u, seed * 1000 + c, mean, spread) << 3) | tie for c in range(curves)]

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = keys(_vectors(b.column(0), size))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(curves, dtype=np.int32), b.num_rows)), pa.array(np.concatenate(got))], ["curve", "key"])

    # A range goes from the place ``window`` rows before its cut to that behind the next one: (ends behind the cuts, ends before the cuts) of each curve.
    none = np.empty(0, np.int64)
    behind, before = [none] * curves, [none] * curves
    if ranges > 1:
        share = n // ranges
        reach = min(window, share // 2)
        at = F.col("at") - F.col("curve").cast("long") * n
        placed = number_rows(rows.select("v").mapInArrow(only_keys, "curve int, key bigint"), "curve", "key").select("curve", "key", at.alias("at"))
        ends = placed.where((F.col("at") >= share - reach) & (F.col("at") < (ranges - 1) * share + reach + 1)).withColumn("off", F.pmod(F.col("at") + reach, F.lit(share))).where(F.col("off").isin(0, 2 * reach))
        got: dict[tuple[int, bool], list[int]] = {}
        for c, key, off in ends.select("curve", "key", "off").collect():  # two numbers for each range and curve
            got.setdefault((c, off > 0), []).append(key)
        behind = [np.sort(np.array(got.get((c, True), []), np.int64)) for c in range(curves)]
        before = [np.sort(np.array(got.get((c, False), []), np.int64)) for c in range(curves)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            ids, v = (np.concatenate(x) for x in zip(*held))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for c, key in enumerate(keys(v)):
                first, last = np.searchsorted(behind[c], key, "left"), np.searchsorted(before[c], key, "right")
                both = np.flatnonzero(last > first)
                own, place = np.concatenate([np.arange(len(ids)), both]), np.concatenate([first, last[both]])
                order = np.argsort(place, kind="stable")
                own, place = own[order], place[order]
                edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:]):
                    part = own[a:b]
                    for column, x in zip(out, (c, int(place[a]), len(part), _pack(ids[part], v[part]))):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["curve", "place", "n", "block"])

        count = 0
        for b in batches:
            held.append((b.column(0).to_numpy(), _vectors(b.column(1), size)))
            count += b.num_rows
            if count >= 20_000:
                yield emit()
                held, count = [], 0
        if count:
            yield emit()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def best() -> pa.RecordBatch:
            ids, v = (np.concatenate(x) for x in zip(*parts))
            by_id = np.argsort(ids)
            found = _best_in_range(ids[by_id], v[by_id], k, orders, window, seed * 1000 + 100 + 16 * at[0])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["row", "other", "sim"])

        for b in batches:
            for c, p, m, block in zip(*(x.to_pylist() for x in b.columns)):
                if at not in (None, (c, p)):
                    yield best()
                    parts = []
                at = (c, p)
                parts.append(_unpack(block, m, size))
        if parts:
            yield best()

    # One task for each range of each curve, up to a number of tasks that the scheduler bears.
    tasks = min(curves * ranges, 20_000)
    packed = rows.mapInArrow(blocks, "curve int, place int, n int, block binary")
    packed = packed.repartitionById(tasks, ((F.col("place") * curves + F.col("curve")) % tasks).cast("int")).sortWithinPartitions("curve", "place")
    found = packed.mapInArrow(search, schema)
    if extra is not None:
        found = found.unionByName(extra)
    best = Window.partitionBy("row").orderBy(F.col("sim").desc(), F.col("other"))
    return found.dropDuplicates(["row", "other"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def similar_pairs(found: DataFrame) -> DataFrame:
    """(``row_id_1``, ``row_id_2``), smaller first, each pair once."""
    return found.select(F.least("row", "other").alias("row_id_1"), F.greatest("row", "other").alias("row_id_2")).distinct()
