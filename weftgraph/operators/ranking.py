"""Ranking of nodes and evaluation against known positives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.session import Scratch, shuffle_partitions


def number_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``at``, each row's place in a global order, from 0: range partitions, lifted by the rows of those before."""
    place = Scratch(df.sparkSession).write(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    pid = F.shiftright("at", 33)
    counts = place.groupBy(pid.alias("pid")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    lift = counts.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    return place.withColumn("pid", pid).join(F.broadcast(lift), "pid").withColumn("at", F.col("at") - F.shiftleft("pid", 33) + F.col("n0")).drop("pid", "n0")


def running_sum(df: DataFrame, order: str, value: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over all rows before it by ``order``: sums within range partitions, lifted by those before."""
    spark = df.sparkSession
    part = Scratch(spark).write(df.repartitionByRange(shuffle_partitions(spark), order).withColumn("pid", F.spark_partition_id()))
    sums = part.groupBy("pid").agg(F.sum(value).alias("s"))
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    lift = sums.select("pid", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"))
    own = Window.partitionBy("pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return part.join(F.broadcast(lift), "pid").withColumn("before", F.coalesce(F.sum(value).over(own), F.lit(0)) + F.col("s0")).drop("pid", "s0")


def number_within(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """``df`` with ``at``, the row's place in its group, from 0, and ``n``, the group's rows: groups of any size, of which there are few.

    The global numbers of ``number_rows``, less the first one of the group.
    """
    placed = number_rows(df, group, *order)
    spans = placed.groupBy(F.col(group).alias("span_of")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    return placed.join(F.broadcast(spans), F.col(group) == F.col("span_of")).withColumn("at", F.col("at") - F.col("first")).drop("span_of", "first")


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float]) -> DataFrame:
    """(``q``, ``value``): exact quantiles with linear interpolation, NULL and NaN left out; NULL values if nothing is left.

    The values are numbered over range partitions, and only those on either side of a quantile are looked at.
    """
    x = F.col(column).cast("double")
    placed = number_rows(df.select(x.alias("x")).where("x is not null and not isnan(x)"), "x")
    last = placed.count() - 1
    wanted = {q: (int(q * last), min(int(q * last) + 1, last), q * last - int(q * last)) for q in qs} if last >= 0 else {}
    places = sorted({p for lo, hi, _ in wanted.values() for p in (lo, hi)})
    found = {r[0]: r[1] for r in placed.where(F.col("at").isin(places)).select("at", "x").collect()} if places else {}  # two for each q
    value = lambda q: found[wanted[q][0]] + (found[wanted[q][1]] - found[wanted[q][0]]) * wanted[q][2] if q in wanted else None
    return df.sparkSession.createDataFrame([(float(q), value(q)) for q in qs], "q double, value double")


def rank_nodes(scores: DataFrame, *, exclude: DataFrame | None = None, hit: Column | None = None) -> DataFrame:
    """(``run_id``, ``id``, ``score``, ``rank``, ``hit``, ``hits``): rank by falling score, ties by id, within each run; hits up to the rank.

    ``exclude(run_id, id)`` takes seeds out first. Rows are range-partitioned by run, score and id; ranks
    and hits are counted within a partition and lifted by the counts of the partitions before it (a
    table of partitions and runs), so a single long ranking needs no single task. NULL and NaN scores come last.
    """
    spark = scores.sparkSession
    scratch = Scratch(spark)
    if exclude is not None:
        x = exclude.select(F.col("run_id").alias("xr"), F.col("id").alias("xi"))
        scores = scores.join(x, (F.col("run_id") == F.col("xr")) & (F.col("id") == F.col("xi")), "left_anti")
    falling = F.nanvl(F.col("score"), F.lit(None).cast("double")).desc_nulls_last()
    flag = F.coalesce((hit if hit is not None else F.lit(False)).cast("int"), F.lit(0))
    ordered = scores.select("run_id", "id", "score", flag.alias("hit")).repartitionByRange(shuffle_partitions(spark), "run_id", falling, "id").sortWithinPartitions("run_id", falling, "id")
    place = scratch.write(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("at", 33)))
    counts = place.groupBy("pid", "run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"), F.min("at").alias("first"))
    before = Window.partitionBy("run_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    lift = counts.select(F.col("pid").alias("lp"), F.col("run_id").alias("lr"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"))
    j = place.join(lift, (F.col("pid") == F.col("lp")) & (F.col("run_id") == F.col("lr")))
    own = Window.partitionBy("pid", "run_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("run_id", "id", "score", (F.col("at") - F.col("first") + 1 + F.col("n0")).alias("rank"), "hit", (F.sum("hit").over(own) + F.col("h0")).alias("hits"))


def pr_curve(ranked: DataFrame) -> DataFrame:
    """(``run_id``, ``rank``, ``recall``, ``precision``) at each positive, after a first row of rank 0 with recall 0 and precision 1; no rows for runs without positives."""
    total = ranked.groupBy(F.col("run_id").alias("r")).agg(F.sum("hit").alias("p")).where("p > 0")
    rows = ranked.where("hit = 1").join(total, F.col("run_id") == F.col("r")).select("run_id", "rank", (F.col("hits") / F.col("p")).alias("recall"), (F.col("hits") / F.col("rank")).alias("precision"))
    zero = total.select(F.col("r").alias("run_id"), F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return rows.unionByName(zero)


def ranking_metrics(ranked: DataFrame, ks: Sequence[int], *, undefined: str = "nan", sizes: DataFrame | None = None) -> DataFrame:
    """One row per run: candidates, positives, average precision, rate, and recall, precision and enrichment at each k.

    With ``sizes(run_id, num_candidates)`` only the ranked positives are needed in ``ranked``.

    k is cut at the number of candidates. What isn't defined without positives or candidates is NaN, or NULL
    with ``undefined="null"``. One aggregate.
    """
    nope = F.lit(float("nan")) if undefined == "nan" else F.lit(None).cast("double")
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}")
    got = ranked.groupBy("run_id").agg(F.count(F.lit(1)).alias("num_candidates"), F.sum("hit").alias("num_positives"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("s"), *map(at, ks))
    if sizes is not None:
        all_ = sizes.select(F.col("run_id").alias("of"), F.col("num_candidates").alias("n_all"))
        got = all_.join(got, F.col("of") == F.col("run_id"), "left").select(F.col("of").alias("run_id"), F.col("n_all").alias("num_candidates"), *[F.coalesce(c, F.lit(0)).alias(c) for c in got.columns if c not in ("run_id", "num_candidates")])
    n, p = F.col("num_candidates"), F.col("num_positives")
    out = [F.when(p > 0, F.col("s") / p).otherwise(nope).alias("auprc"), F.when((n > 0) & (p > 0), p / n).otherwise(nope).alias("positive_rate")]
    for k in ks:
        cut, h = F.least(F.lit(k), n), F.col(f"h{k}")
        out += [F.when(p > 0, h / p).otherwise(nope).alias(f"recall_at_{k}"), (h / cut).alias(f"precision_at_{k}"), F.when(p > 0, (h / cut) / (p / n)).otherwise(nope).alias(f"enrichment_at_{k}")]
    return got.select("run_id", "num_candidates", "num_positives", *out)


def top_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """One row per run for a single k: recall over at least one positive, precision over what was returned, enrichment NULL without a base rate."""
    got = ranked.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("p"), F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("h"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("s"))
    pos, top, rate = F.greatest(F.lit(1), F.col("p")), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n"))), F.col("p") / F.greatest(F.lit(1), F.col("n"))
    return got.select("run_id", F.when(F.col("p") > 0, F.col("s") / F.col("p")).otherwise(F.lit(float("nan"))).alias("auprc"), (F.col("h") / pos).alias("recall_at_k"), (F.col("h") / top).alias("precision_at_k"), F.when(rate > 0, F.col("h") / top / rate).alias("enrichment_at_k"))


def aggregate_rows(rows: DataFrame, group: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Rows (``n_rows``), mean and sample standard deviation of every numeric column by group, NaN left out; 0 deviation for one value, NaN if there is none."""
    numeric = sorted(c for c, t in rows.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") and c not in group and c not in exclude)
    out = []
    for c in numeric:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        out += [F.coalesce(F.avg(x), F.lit(float("nan"))).alias(f"{c}_mean"), F.when(F.count(x) == 0, float("nan")).otherwise(F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias(f"{c}_std")]
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), *out)


def repeat_means(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean by group, NaN if any value is, and how many repeats there were."""
    return rows.groupBy(*group).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("null_repeats_completed"))


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Counts in equal bins between the smallest and largest value; the last bin includes its end. For plots."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    j = df.where(F.col(column).isNotNull() & ~F.isnan(column)).join(F.broadcast(span))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("int")
    return j.groupBy(*([by] if by else []), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_rows(df: DataFrame, order: str, n: int, ascending: bool = False, tie: str | None = None) -> DataFrame:
    """The first rows by one column, NULL and NaN last."""
    c = F.nanvl(F.col(order).cast("double"), F.lit(None).cast("double"))
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *([F.col(tie)] if tie else [])).limit(n)
