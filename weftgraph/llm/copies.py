"""Duplicates hidden by formatting differences (problem 4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import once
from weftgraph.session import HOT_KEYS, Scratch


def fingerprint(fields: Mapping[str, Sequence[str]], seed: int) -> Column:
    """Sum of the hashes of all (field name, value) pairs: the order of the pairs doesn't matter.

    Each hash gives up just enough high bits that the sum can't overflow.
    """
    n = sum(map(len, fields.values()))
    hashes = [F.shiftrightunsigned(F.xxhash64(F.lit(name), F.col(c), F.lit(seed)), (n - 1).bit_length() + 1) for name, cs in fields.items() for c in cs]
    return sum(hashes[1:], hashes[0])


def _same(cs: Sequence[str], other: str) -> Column:
    """Equality of two multisets of values, NULL equal to NULL, without sorting."""
    a, b = [F.col(c) for c in cs], [F.col(f"{other}{c}") for c in cs]
    if len(cs) == 1:
        return a[0].eqNullSafe(b[0])
    if len(cs) == 2:
        return (a[0].eqNullSafe(b[0]) & a[1].eqNullSafe(b[1])) | (a[0].eqNullSafe(b[1]) & a[1].eqNullSafe(b[0]))
    times = lambda xs, x: sum((F.when(y.eqNullSafe(x), 1).otherwise(0) for y in xs[1:]), F.when(xs[0].eqNullSafe(x), 1).otherwise(0))
    same = F.lit(True)
    for x in a:
        same = same & (times(a, x) == times(b, x))
    return same


def hidden_copies(df: DataFrame, row_id: str, fields: Mapping[str, Sequence[Column]], *, seed: int = 1) -> DataFrame:
    """(``keep_row_id``, ``row_id``) of each row that belongs to a set of two or more copies, the kept row included.

    ``fields`` maps a field name to its normalized values; several values under one name are a
    multiset, so their order doesn't matter.  Rows are copies if all multisets are equal, NULL alike.
    The kept row is the one with the smallest ``row_id``.

    Rows group by a 128-bit commutative fingerprint.  The members of groups of two or more are then
    compared field by field with the kept row; any that differ (a collision) go through another round
    with other hashes.  Groups with more than 1/HOT_KEYS of the grouped rows (at most HOT_KEYS) are
    joined by broadcast, so that no task gets all rows of a huge group.

    ``row_id`` must be unique; rows where it is NULL have no identity and can't be listed.  Empty input
    gives an empty result; columns that aren't named aren't read.
    """
    scratch = Scratch(df.sparkSession)
    names: dict[str, list[str]] = {}
    values: dict[str, Column] = {}
    for i, (name, cs) in enumerate(fields.items()):
        names[name] = [f"f{i}_{j}" for j in range(len(cs))]
        values |= dict(zip(names[name], cs))
    rows = once(df, r=F.col(row_id), **values).where("r is not null")
    return _round(rows, names, scratch, seed)


def _round(rows: DataFrame, names: dict[str, list[str]], scratch: Scratch, seed: int) -> DataFrame:
    flat = [c for cs in names.values() for c in cs]
    marked = once(rows, "r", *flat, h1=fingerprint(names, seed), h2=fingerprint(names, seed + 1))
    groups = scratch.write(marked.groupBy("h1", "h2").agg(F.min("r").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > F.lit(max(20_000, total // HOT_KEYS))
    by = groups.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "keep", "n")
    on = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    big = F.broadcast(by.where(hot))
    members = marked.join(by.where(~hot), on).unionByName(marked.join(big, on)).drop("h1", "h2", "g1", "g2")
    members = scratch.write(members)

    first = members.where("r = keep").select(F.col("keep").alias("k"), "n", *[F.col(c).alias(f"k_{c}") for c in flat])
    on = F.col("keep") == F.col("k")
    pairs = members.drop("n").where("r <> keep")
    pairs = pairs.join(first.where(~hot).drop("n"), on).unionByName(pairs.join(F.broadcast(first.where(hot)).drop("n"), on))
    same = F.lit(True)
    for cs in names.values():
        same = same & _same(cs, "k_")
    checked = scratch.write(pairs.select("r", "keep", same.alias("same"), *flat))
    scratch.drop(groups)
    good = checked.where("same").select(F.col("keep").alias("keep_row_id"), F.col("r").alias("row_id"))
    good = good.unionByName(good.select("keep_row_id", F.col("keep_row_id").alias("row_id")).distinct())
    bad = checked.where("not same").select("r", *flat)
    if bad.limit(1).count():
        good = good.unionByName(_round(bad, names, scratch, seed + 2))
    return good


def collapsed(copies: DataFrame) -> DataFrame:
    """(``keep_row_id``, ``n_copies``): one row for each set of copies."""
    return copies.groupBy("keep_row_id").agg(F.count(F.lit(1)).alias("n_copies"))


def collapse(df: DataFrame, row_id: str, copies: DataFrame) -> DataFrame:
    """``df`` with one row for each set of ``copies`` (the kept one) and each row without any, and ``n_copies``, at least 1."""
    gone = copies.where("row_id <> keep_row_id").select(F.col("row_id").alias("gone"))
    n = copies.groupBy(F.col("keep_row_id").alias("kept")).agg(F.count(F.lit(1)).alias("n_copies"))
    rest = df.join(gone, F.col(row_id) == F.col("gone"), "left_anti").join(n, F.col(row_id) == F.col("kept"), "left")
    return rest.select(*[F.col(f"`{c}`") for c in df.columns if c != "n_copies"], F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
