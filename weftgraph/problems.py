"""The queries of the general problems, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.functions.keys import id_key
from weftgraph.operators.references import orphan_references, per_table_and_month
from weftgraph.sources.lines import parse_lines


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "string_edges_head_lines").where("line_no is null or line_no <> 1")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(_lines(spark, d), "line_id", "line")[0]


def p3_edges(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(_lines(spark, d), "line_id", "line")[1]


def _references(spark: SparkSession, d: str) -> list:
    edges, seqs, emb = (_table(spark, d, t) for t in ("string_edges_head", "seqs_parser", "emb"))
    uses = [("string_edges_head", "node_a", edges), ("string_edges_head", "node_b", edges), ("seqs_parser", "string_id", seqs), ("emb", "ids", emb)]
    return [(t, c, df, id_key(c), "row_id", "loaded_at") for t, c, df in uses]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_references(spark, d), _table(spark, d, "string_info_head"), id_key("string_id"), "loaded_at", "deleted_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("t")


def p6_months(spark: SparkSession, d: str) -> DataFrame:
    return per_table_and_month(_orphans(spark, d))


_KEY = "nullif(upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')), '')"
_BLANK = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
_FIELD = r'"(?:[^"]|"")*"|[^\x{9}"]*'
_P3 = rf"""
WITH l AS (SELECT line_id, regexp_replace(line, '\x{{d}}\z', '') AS t FROM string_edges_head_lines WHERE line_no IS NULL OR line_no <> 1),
f AS (SELECT line_id, t, regexp_full_match(t, '(?s)(?:{_FIELD})(?:\x{{9}}(?:{_FIELD}))*') AS sound,
  list_transform(regexp_extract_all(chr(9) || t, '(?s)\x{{9}}({_FIELD})', 1),
    lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:length(x) - 1], '""', '"') ELSE x END) AS c FROM l),
v AS (SELECT line_id, c, CASE
  WHEN NOT sound THEN 'broken_quote' WHEN t IS NULL OR len(c) <> 10 THEN 'column_count'
  WHEN regexp_full_match(c[1], '{_BLANK}') OR regexp_full_match(c[2], '{_BLANK}') THEN 'missing_id'
  WHEN regexp_full_match(c[3], '{_BLANK}') THEN 'missing_score'
  WHEN NOT regexp_full_match(c[3], ' *0*(1000|[0-9]{{1,3}}) *') THEN 'invalid_score'
  WHEN len(list_filter(c[4:10], lambda x: NOT regexp_full_match(x, '{_BLANK}') AND NOT regexp_full_match(x, ' *0*(1000|[0-9]{{1,3}}) *'))) > 0 THEN 'invalid_channel'
  END AS reason FROM f)
"""
_NAMES = ("neighborhood", "fusion", "cooccurence", "coexpression", "experimental", "database", "textmining")
_P6 = f"""
WITH p AS (SELECT {_KEY.format('string_id')} AS k, loaded_at, deleted_at FROM string_info_head),
r AS (
  SELECT 'string_edges_head' AS ref_table, 'node_a' AS ref_column, row_id, {_KEY.format('node_a')} AS k, loaded_at AS t FROM string_edges_head UNION ALL
  SELECT 'string_edges_head', 'node_b', row_id, {_KEY.format('node_b')}, loaded_at FROM string_edges_head UNION ALL
  SELECT 'seqs_parser', 'string_id', row_id, {_KEY.format('string_id')}, loaded_at FROM seqs_parser UNION ALL
  SELECT 'emb', 'ids', row_id, {_KEY.format('ids')}, loaded_at FROM emb),
j AS (SELECT ref_table, ref_column, row_id, t, count(p.k) AS n, count(*) FILTER (p.loaded_at <= t) AS begun,
  count(*) FILTER (p.loaded_at <= t AND (p.deleted_at IS NULL OR p.deleted_at > t)) AS live
  FROM r LEFT JOIN p ON r.k = p.k WHERE r.k IS NOT NULL GROUP BY ref_table, ref_column, row_id, t),
o AS (SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS reason FROM j WHERE live = 0)
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3 + "SELECT line_id, reason FROM v WHERE reason IS NOT NULL",
        "p3_edges": _P3 + "SELECT line_id, c[1] AS node_a, c[2] AS node_b, CAST(trim(c[3], ' ') AS INT) AS combined_score, "
        + ", ".join(f"TRY_CAST(nullif(trim(c[{i}], ' '), '') AS INT) AS {n}" for i, n in enumerate(_NAMES, 4)) + " FROM v WHERE reason IS NULL",
        "p6_found": _P6 + "SELECT ref_table, ref_column, row_id, reason FROM o",
        "p6_months": _P6 + "SELECT ref_table, ref_column, date_trunc('month', t)::DATE AS month, reason, count(*) AS n FROM o GROUP BY ALL",
    }
