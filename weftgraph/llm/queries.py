"""Queries of the llm problems and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.keys import id_key, once
from weftgraph.llm.copies import collapse, collapsed, hidden_copies
from weftgraph.llm.garble import garbled_texts
from weftgraph.llm.groups import link_groups
from weftgraph.llm.leaks import leaked_passages
from weftgraph.llm.neighbours import latest_usable, nearest, similar_pairs
from weftgraph.llm.overlaps import split_overlaps
from weftgraph.llm.pieces import split_oversized
from weftgraph.llm.tokens import encode_corpus

SCORES = ("combined_score", "neighborhood", "fusion", "cooccurence", "coexpression", "experimental", "database", "textmining")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    edges = once(_table(spark, d, "string_edges_head").where("combined_score is not null"), a=id_key("node_a"), b=id_key("node_b")).where("a <> b")
    return link_groups(edges, "a", "b")


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("group_key").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(nearest(latest_usable(_table(spark, d, "emb"), "row_id", id_key("ids"), "emb", 128)))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    edges = once(_table(spark, d, "string_edges_head"), "row_id", *SCORES, a=id_key("node_a"), b=id_key("node_b")).where("a is not null and b is not null")
    return hidden_copies(edges, "row_id", {"node": [F.col("a"), F.col("b")]} | {c: [F.col(c)] for c in SCORES})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).where("row_id <> keep_row_id")


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(_copies(spark, d))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Each edge once, with the number of its copies, by the row that stands for it."""
    edges = _table(spark, d, "string_edges_head").where(id_key("node_a").isNotNull() & id_key("node_b").isNotNull())
    return collapse(edges.select("row_id", *SCORES), "row_id", _copies(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    held_out = F.when(F.col("split").isin("val", "test"), True).when(F.col("split") == "train", False)
    return split_overlaps(_table(spark, d, "string_edges_head"), "row_id", id_key("node_a"), id_key("node_b"), held_out)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rows that overlap training rows, by split and source."""
    rows = _table(spark, d, "string_edges_head").select("row_id", "split", "source").where(F.col("split").isin("val", "test"))
    ids = p5_found(spark, d)
    ids = ids.select(F.col("row_id_1").alias("r")).unionByName(ids.select(F.col("row_id_2").alias("r"))).distinct()
    return rows.join(ids, rows.row_id == ids.r).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_table(spark, d, "seqs_parser"), "row_id", "seq")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_table(spark, d, "documents"), "doc_id", "text")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 12 consecutive words of a passage, or with one of them replaced, dropped or one more between."""
    return leaked_passages(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "eval_passages"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_near(spark, d).where("edits = 0").select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled_texts(_table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


KEY = "nullif(upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')), '')"
A, B = KEY.format("node_a"), KEY.format("node_b")

_P1 = f"""
WITH RECURSIVE e AS (SELECT DISTINCT {A} AS a, {B} AS b FROM string_edges_head WHERE combined_score IS NOT NULL),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a AS node, a AS label FROM both_ways UNION SELECT w.b, r.label FROM r JOIN both_ways w ON r.node = w.a WHERE r.label < w.b),
g AS (SELECT node, min(label) AS label FROM r GROUP BY node)
SELECT node AS node_key, label AS group_key FROM g"""
_P4 = f"""
WITH e AS (SELECT row_id, {', '.join(SCORES)}, least({A}, {B}) AS x, greatest({A}, {B}) AS y FROM string_edges_head WHERE {A} IS NOT NULL AND {B} IS NOT NULL),
k AS (SELECT row_id, min(row_id) OVER w AS keep_row_id, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY x, y, {', '.join(SCORES)}))
"""
_BLANK = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_P7 = rf"""
WITH RECURSIVE s AS (SELECT row_id, regexp_replace(seq, '{_BLANK}', '', 'g') AS t FROM seqs_parser),
long AS (SELECT row_id, t, length(t) AS n FROM s WHERE length(t) > 1022),
cut AS (SELECT row_id, list(i) AS cuts FROM (SELECT row_id, t, n, unnest(range(1, n + 1)) AS i FROM long)
  WHERE t[i] IN ('X', 'x', '*', '-') AND (i = n OR t[i + 1] NOT IN ('X', 'x', '*', '-')) GROUP BY row_id),
f AS (SELECT l.row_id, l.n, coalesce(c.cuts, []) AS cuts FROM long l LEFT JOIN cut c USING (row_id)),
p AS (
  SELECT row_id, n, cuts, 1::BIGINT AS piece_no, 1::BIGINT AS start_pos,
    coalesce(list_max(list_filter(cuts, lambda x: x BETWEEN 512 AND 1022)), 1022)::BIGINT AS end_pos FROM f
  UNION ALL
  SELECT row_id, n, cuts, piece_no + 1, end_pos - 253,
    (CASE WHEN n - (end_pos - 253) + 1 <= 1022 THEN n ELSE coalesce(list_max(list_filter(cuts, lambda x: x BETWEEN end_pos + 258 AND end_pos + 768)), end_pos + 768) END)::BIGINT
  FROM p WHERE end_pos < n)
SELECT row_id, piece_no, start_pos, end_pos FROM p"""

_P5 = f"""
WITH e AS (SELECT row_id, split, source, split IN ('val', 'test') AS out, {A} AS a, {B} AS b FROM string_edges_head
  WHERE split IN ('train', 'val', 'test') AND {A} IS NOT NULL AND {B} IS NOT NULL),
w AS (SELECT row_id, out, a, b FROM e UNION SELECT row_id, out, b, a FROM e),
p AS (SELECT DISTINCT least(t.row_id, h.row_id) AS row_id_1, greatest(t.row_id, h.row_id) AS row_id_2
  FROM w t JOIN w h ON t.a = h.a AND NOT t.out AND h.out AND abs(length(t.b) - length(h.b)) <= 1 AND levenshtein(t.b, h.b) <= 1)
"""
_P9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_passages),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _P5 + "SELECT row_id_1, row_id_2 FROM p",
        "p5_report": _P5 + "SELECT split, source, count(*) AS n FROM e WHERE out AND row_id IN (SELECT row_id_1 FROM p UNION SELECT row_id_2 FROM p) GROUP BY split, source",
        "p9_found": _P9,
        "p1_found": _P1,
        "p1_group_sizes": f"SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM ({_P1}) GROUP BY group_key) GROUP BY size",
        "p4_found": _P4 + "SELECT keep_row_id, row_id FROM k WHERE row_id <> keep_row_id",
        "p4_copies": _P4 + "SELECT keep_row_id, count(*) AS n_copies FROM k WHERE n > 1 GROUP BY keep_row_id",
        "p4_collapsed": _P4 + f"SELECT min(row_id) AS row_id, {', '.join(SCORES)}, count(*) AS n_copies FROM e GROUP BY x, y, {', '.join(SCORES)}",
        "p7_found": _P7,
    }
