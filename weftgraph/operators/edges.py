"""Cleaning, merging and fusing of edge tables.

An edge table has the columns ``u``, ``v`` (string) and mostly ``w`` (double).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.functions.keys import once

#: Why a row is no edge; the first that applies counts.
REJECTS = ("rows_missing_id", "self_loops_removed", "rows_missing_score", "invalid_score_rows")


def classify_edges(df: DataFrame, a: str, b: str, score: str, *, uppercase: bool = False) -> DataFrame:
    """(``u``, ``v``, ``raw``, ``reject``): normalized ids, score as a number, and the reason for which a row is no edge, or NULL.

    The order is: an id missing, a self loop, a missing score, a score that isn't a finite number.
    """
    ids = once(df, u=C.normalize_id(F.col(a).cast("string"), uppercase), v=C.normalize_id(F.col(b).cast("string"), uppercase), s=C.strip(F.col(score).cast("string")))
    raw = C.number("s")
    bad = raw.isNull() | F.isnan(raw) | (F.abs(raw) == F.lit(float("inf")))
    reject = F.when(F.col("u").isNull() | F.col("v").isNull(), REJECTS[0]).when(F.col("u") == F.col("v"), REJECTS[1]).when(F.coalesce(F.col("s"), F.lit("")) == "", REJECTS[2]).when(bad, REJECTS[3])
    return ids.select("u", "v", raw.alias("raw"), reject.alias("reject"))


def undirected_max(df: DataFrame, w: str = "w", keep: str = "w") -> DataFrame:
    """Largest weight of each unordered pair. NaN weights must be filtered before: they would count as largest."""
    return df.groupBy(C.smaller("u", "v").alias("u"), C.larger("u", "v").alias("v")).agg(F.max(w).alias(keep))


def undirected_distinct(df: DataFrame) -> DataFrame:
    return df.select(C.smaller("u", "v").alias("u"), C.larger("u", "v").alias("v")).distinct()


def clean_edges(df: DataFrame, a: str, b: str, score: str, *, uppercase: bool = False) -> DataFrame:
    """Clean, undirected, deduplicated edges with scores normalized to [0, 1] by the range of the kept scores.

    Zero weights are kept. The range is that of the deduplicated edges, one row, attached by broadcast.
    """
    kept = undirected_max(classify_edges(df, a, b, score, uppercase=uppercase).where("reject is null"), "raw", "raw")
    span = kept.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return kept.join(F.broadcast(span)).select("u", "v", C.normalize_score("raw", "low", "high").alias("w"))


def clean_counts(df: DataFrame, a: str, b: str, score: str, *, uppercase: bool = False) -> DataFrame:
    """One row of counters: raw rows, each reject, duplicates collapsed, edges left. All but the first sum to the first."""
    marked = classify_edges(df, a, b, score, uppercase=uppercase)
    lo, hi = C.smaller("u", "v"), C.larger("u", "v")
    per = marked.groupBy(F.col("reject"), F.when(F.col("reject").isNull(), lo).alias("x"), F.when(F.col("reject").isNull(), hi).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("reject").isNull()
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(
        zero("n").alias("raw_rows"),
        *[zero(F.when(F.col("reject") == r, F.col("n"))).alias(r) for r in REJECTS],
        zero(F.when(kept, F.col("n") - 1)).alias("duplicate_edges_collapsed"),
        zero(F.when(kept, F.lit(1))).alias("valid_edges_after_cleaning"),
    )


def require_edges(df: DataFrame) -> DataFrame:
    """The same edges; an error if there are none."""
    if df.limit(1).count() == 0:
        raise ValueError("no valid edges")
    return df


def endpoints(df: DataFrame) -> DataFrame:
    """Distinct node ids of both ends."""
    return df.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def within_nodes(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ``nodes(id)``."""
    a, b = nodes.select(F.col("id").alias("na")).distinct(), nodes.select(F.col("id").alias("nb")).distinct()
    return df.join(a, F.col("u") == F.col("na"), "left_semi").join(b, F.col("v") == F.col("nb"), "left_semi")


def filtered_graph(df: DataFrame, *, nodes: DataFrame | None = None, min_w: float = 0.0) -> DataFrame:
    """Undirected edges above ``min_w``, without self loops, within ``nodes`` if given; the largest of duplicates."""
    df = df.where((F.col("u") != F.col("v")) & (F.col("w") > min_w) & ~F.isnan("w"))
    return undirected_max(within_nodes(df, nodes) if nodes is not None else df)


def merge_max(*tables: DataFrame) -> DataFrame:
    """Largest positive weight of each unordered pair over several tables; NaN is rejected, self loops too."""
    out = tables[0].select("u", "v", "w")
    for t in tables[1:]:
        out = out.unionByName(t.select("u", "v", "w"))
    return undirected_max(out.where(~F.isnan("w") & (F.col("u") != F.col("v")))).where("w > 0")


def channel(df: DataFrame, a: str, b: str, column: str, scale: float = 1000.0) -> DataFrame:
    """One evidence channel as weight."""
    return df.select(C.normalize_id(a).alias("u"), C.normalize_id(b).alias("v"), (F.col(column) / F.lit(scale)).alias("w")).where("u is not null and v is not null and u <> v and w is not null")


def _normalized(df: DataFrame, how: str) -> DataFrame:
    if how == "minmax":
        span = df.agg(F.min("w").alias("low"), F.max("w").alias("high"))
        return df.join(F.broadcast(span)).withColumn("nw", C.minmax01("w", "low", "high")).drop("low", "high")
    return df.withColumn("nw", C.clamp01("w") if how == "clip01" else F.col("w"))


def last_scores(scores: DataFrame, pos: str = "pos") -> DataFrame:
    """(``a``, ``b``, ``p``): the last score of each unordered pair by the order of ``pos``."""
    return scores.groupBy(C.smaller("u", "v").alias("a"), C.larger("u", "v").alias("b")).agg(F.max_by("w", pos).alias("p"))


def reweight(base: DataFrame, scores: DataFrame, *, beta: float = 1.0, kind: str = "exp", norm: str = "minmax") -> DataFrame:
    """Every base row with its normalized weight times the gate of the pair's score, 0 where there is none.

    Rows, orientation and zero weights are kept; ``scores(u, v, w, pos)``, the last of a pair counts.
    """
    p = last_scores(scores)
    j = _normalized(base, norm).join(p, (C.smaller("u", "v") == F.col("a")) & (C.larger("u", "v") == F.col("b")), "left")
    return j.select(*base.columns[:2], (F.col("nw") * C.gate(F.coalesce("p", F.lit(0.0)), beta, kind)).alias("w"))


def gated_mix(base: DataFrame, scores: DataFrame, *, lam: float = 0.5, beta: float = 1.0, kind: str = "exp", norm: str = "minmax") -> DataFrame:
    """Sum over both tables of ``lam`` times the gated base weight and ``1 - lam`` times the score, by unordered pair; positive sums only.

    A pair given several times counts each time, but the gate uses its last score. One union and one aggregate.
    """
    gated = reweight(base, scores, beta=beta, kind=kind, norm=norm).select("u", "v", (F.col("w") * lam).alias("w"))
    plain = scores.select("u", "v", (F.col("w") * (1 - lam)).alias("w"))
    return gated.unionByName(plain).groupBy(C.smaller("u", "v").alias("u"), C.larger("u", "v").alias("v")).agg(F.sum("w").alias("w")).where("w > 0")
