"""References to records that do not exist (problem 6)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import once
from weftgraph.session import Scratch, fits_broadcast, shuffle_partitions

RESULT = "ref_table string, ref_column string, row_id bigint, reason string, t timestamp_ntz"
NEVER = np.iinfo(np.int64).max


def _probe(refs: pa.Table, parents: pa.Table, names: Sequence[tuple[str, str]]) -> pa.Table:
    """Binary search of a batch of references in the sorted parents of its range."""
    micros = lambda c: c.combine_chunks().cast(pa.timestamp("us")).cast(pa.int64())
    n = refs.num_rows
    reason = np.full(n, 0, dtype=np.int8)
    parents = parents.sort_by([("h", "ascending"), ("k", "ascending"), ("begin", "ascending")])
    h = parents["h"].to_numpy() if parents.num_rows else np.empty(0, np.int64)
    if n and len(h):
        k = parents["k"].combine_chunks()
        begin = micros(parents["begin"]).fill_null(NEVER).to_numpy(zero_copy_only=False)
        end = micros(parents["end"]).fill_null(NEVER).to_numpy(zero_copy_only=False)
        # One segment for each key; `alive` is the latest end among the rows of the segment so far.
        fresh = np.ones(len(h), bool)
        fresh[1:] = ~((h[1:] == h[:-1]) & pc.equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)) if len(h) > 1 else fresh[1:]
        start = np.flatnonzero(fresh)
        stop = np.append(start[1:], len(h))
        alive = end.copy()
        step, longest, seg = 1, int((stop - start).max()), np.repeat(np.arange(len(start)), stop - start)
        while step < longest:
            same = seg[step:] == seg[:-step]
            alive[step:] = np.where(same, np.maximum(alive[step:], alive[:-step]), alive[step:])
            step *= 2
        t = micros(refs["t"]).to_numpy(zero_copy_only=False)
        rh, rk, sh = refs["h"].to_numpy(), refs["k"].combine_chunks(), h[start]
        at = np.searchsorted(sh, rh)
        found = np.full(n, -1)
        todo = np.flatnonzero(at < len(sh))
        while len(todo):  # more than once only where two keys share a hash
            todo = todo[sh[at[todo]] == rh[todo]]
            equal = pc.equal(k.take(pa.array(start[at[todo]])), rk.take(pa.array(todo))).to_numpy(zero_copy_only=False)
            found[todo[equal]] = at[todo[equal]]
            todo = todo[~equal]
            at[todo] += 1
            todo = todo[at[todo] < len(sh)]
        hit = np.flatnonzero(found >= 0)
        lo, hi, th = start[found[hit]].copy(), stop[found[hit]].copy(), t[hit]
        first = lo.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            right = open_ & (begin[np.minimum(mid, len(begin) - 1)] <= th)
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        late = lo == first
        dead = alive[np.maximum(lo - 1, 0)] <= th
        reason[hit] = np.where(late, 1, np.where(dead, 2, 3))
    miss = np.flatnonzero(reason < 3)
    source = refs["source"].to_numpy()[miss] if n else np.empty(0, int)
    pick = lambda words, codes: pa.array(np.array(words, dtype=object)[codes], pa.string())
    return pa.table({
        "ref_table": pick([x for x, _ in names], source),
        "ref_column": pick([x for _, x in names], source),
        "row_id": refs["row_id"].take(pa.array(miss)).cast(pa.int64()),
        "reason": pick(["missing", "late", "deleted"], reason[miss]),
        "t": refs["t"].take(pa.array(miss)),
    })


def orphan_references(
    references: Sequence[tuple[str, str, DataFrame, Column, str, str]],
    parents: DataFrame,
    parent_key: Column,
    begin: str,
    end: str,
    *,
    rows_per_range: int = 64_000,
) -> DataFrame:
    """(``ref_table``, ``ref_column``, ``row_id``, ``reason``, ``t``) of each reference without a live parent at its time ``t``.

    ``references`` holds (table, column, rows, key, row id column, time column).  ``reason`` is
    ``missing`` if no parent has the key, else ``late`` if all begin after the reference's time, else
    ``deleted`` if all that have begun have ended by then.

    The hash space of the keys is cut into ranges of about ``rows_per_range`` references and parents; the parents of
    a range become arrays sorted by key and time, which whole batches of references probe by binary
    search.  A hash only finds the place, keys are compared in full.  A range that holds more references
    than its share (a hot key) is split by row, and its parents go to each part.

    A NULL key is no reference and no parent.  A NULL time of a reference counts as after all others, a
    NULL begin as never begun, a NULL end as not ended.  Repeated rows each come out.  Empty tables are
    allowed on both sides; columns that aren't named aren't read.
    """
    names = [(t, c) for t, c, *_ in references]
    spark = parents.sparkSession
    refs = None
    for i, (_, _, df, key, row_id, time) in enumerate(references):
        one = once(df, row_id=F.col(row_id).cast("long"), t=F.coalesce(F.col(time).cast("timestamp_ntz"), F.lit("9999-12-30").cast("timestamp_ntz")), k=key).where("k is not null").select(F.lit(i).alias("source"), "row_id", "t", "k")
        refs = one if refs is None else refs.unionByName(one)
    assert refs is not None
    hashed = lambda df, *keep: once(df, *keep, h=F.xxhash64("k"))
    refs = hashed(refs, "source", "row_id", "t", "k")

    live = once(parents, k=parent_key, begin=F.col(begin).cast("timestamp_ntz"), end=F.col(end).cast("timestamp_ntz")).where("k is not null")
    # Of rows with one key and begin only the latest end matters.
    live = live.groupBy("k", "begin").agg(F.max(F.coalesce("end", F.lit("9999-12-31").cast("timestamp_ntz"))).alias("end"))
    live = hashed(live, "k", "begin", "end")

    # As many ranges of the hash as both sides need, a power of two of them; those with more references than their share are split by row.
    total = sum(df.count() for _, _, df, *_ in references)  # those without a key included, which takes no reading of keys
    ranges = max(shuffle_partitions(spark), math.ceil((total + parents.count()) / rows_per_range))
    bits = max(1, (ranges - 1).bit_length())
    span = F.shiftrightunsigned(F.col("h"), 64 - bits)
    share = max(rows_per_range, 2 * total >> bits)
    refs, live = refs.withColumn("span", span), live.withColumn("span", span)
    # At most one of two ranges can have over twice the mean, so this table has a row for each hot range only.
    heavy = refs.groupBy(F.col("span").alias("hot")).agg(F.ceil(F.count(F.lit(1)) / F.lit(share)).alias("parts")).where("parts > 1")
    heavy = Scratch(spark).write(heavy)
    if heavy.limit(1).count():
        few = F.broadcast(heavy) if fits_broadcast(heavy) else heavy
        split = lambda df: df.join(few, F.col("span") == F.col("hot"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("hot")
        refs, live = split(refs), split(live)
    else:
        refs, live = refs.withColumn("parts", F.lit(1)), live.withColumn("parts", F.lit(1))
    refs = refs.withColumn("part", F.pmod(F.xxhash64("row_id", "source"), F.col("parts")).cast("int")).drop("parts")
    live = live.select("h", "k", "begin", "end", "span", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"))

    tasks = min(1 << bits, 1 << 16)
    refs, live = refs.repartition(tasks, "span", "part"), live.repartition(tasks, "span", "part")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        return _probe(left, right, names)

    return refs.groupBy("span", "part").cogroup(live.groupBy("span", "part")).applyInArrow(probe, RESULT)


def per_table_and_month(found: DataFrame) -> DataFrame:
    """Count of orphans by table, column, month and reason; ``month`` is the first day of the month of the reference's time, NULL without one."""
    month = F.when(F.year("t") < 9999, F.trunc(F.col("t").cast("date"), "month"))
    return found.groupBy("ref_table", "ref_column", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("n"))
