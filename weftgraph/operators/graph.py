"""Graphs as symmetric edge tables: degrees, components, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ranking import exact_quantiles
from weftgraph.session import Scratch, hot_keys, looked_up


def adjacency(edges: DataFrame) -> DataFrame:
    """(``src``, ``dst``, ``w``): both directions of deduplicated undirected edges."""
    return edges.select(F.inline(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), F.col("w")))))


def degrees(edges: DataFrame) -> DataFrame:
    """(``id``, ``degree``, ``weighted_degree``)."""
    return adjacency(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weighted_degree"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``id``, ``component``): the smallest id that each node is connected with.

    Alternates two rewritings of the edges until they change nothing: each node links its larger
    neighbours with the smallest node around it, then its smaller ones. Both keep what is connected and
    end in stars, after a number of rounds that grows with the logarithm of the size. Minima are combined
    before the shuffle; the neighbours of a node with more than 1/HOT_KEYS of all edges, such as the root of a star, are
    joined by broadcast. Each round is cut off by a table in the shared folder; an error after ``max_rounds``.
    """
    scratch = Scratch(edges.sparkSession)
    nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    pairs = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).distinct())

    def state(p: DataFrame) -> tuple:
        return tuple(p.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first())

    now = state(pairs)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hot = hot_keys(both.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "x", "n", 2 * now[0])
        low = both.groupBy(F.col("x").alias("c")).agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = looked_up(both.where("y > x"), "x", low, "c", hot).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy(F.col("x").alias("c")).agg(F.min("y").alias("m"))
        j = looked_up(large, "x", low, "c", hot)  # no node has more edges here than before
        small = j.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select(F.col("c").alias("x"), F.col("m").alias("y"))).distinct()
        new = scratch.write(small)
        after = state(new)
        scratch.drop(pairs)
        pairs = new
        if after == now:
            return nodes.join(pairs, F.col("id") == F.col("x"), "left").select("id", F.coalesce("y", "id").alias("component"))
        now = after
    raise RuntimeError("components did not settle")


def component_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: min, max, mean and median; zeros if there is no row."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    middle = exact_quantiles(df, column, [0.5]).select(z(F.col("value")).alias("median"))
    return df.agg(z(F.min(column)).alias("min"), z(F.max(column)).alias("max"), z(F.avg(column)).alias("mean")).join(middle)  # one row each


def graph_stats(edges: DataFrame, top: int = 10) -> DataFrame:
    """One row: nodes, edges, summaries of degrees and weights, and components with the ``top`` largest sizes."""
    deg = degrees(edges)
    s = lambda df, c, n: summary(df, c).select(F.struct("min", "max", "mean", "median").alias(n))
    sizes = component_sizes(components(edges))
    largest = sizes.orderBy(F.col("size").desc()).limit(top).agg(F.sort_array(F.collect_list("size"), asc=False).alias("sizes_top_10"))
    parts = sizes.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_size")).join(largest).select(F.struct("count", "largest_size", "sizes_top_10").alias("connected_components"))
    out = deg.agg(F.count(F.lit(1)).alias("num_nodes")).join(edges.agg(F.count(F.lit(1)).alias("num_edges")))
    for x in (s(deg, "degree", "degree"), s(deg, "weighted_degree", "weighted_degree"), s(edges, "w", "edge_weight"), parts):
        out = out.join(x)  # each side has one row
    return out
