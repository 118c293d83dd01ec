"""Queries over the test tables, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import problems
from weftgraph.functions import columns as C
from weftgraph.functions.keys import id_key
from weftgraph.functions.text import BLANKS
from weftgraph.operators import edges as E
from weftgraph.operators import graph as G
from weftgraph.operators import ranking as R
from weftgraph.operators import sampling as L
from weftgraph.operators import scorers as M
from weftgraph.operators import vectors as V
from weftgraph.operators.ppr import pagerank, uniform_seeds
from weftgraph.plans import protocol as P
from weftgraph.session import Scratch
from weftgraph.sources import files as S
from weftgraph.sources import sinks as K

_all: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
KS = (10, 50)


def query(sql: str | None = None):
    def add(f):
        _all[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Inputs: the scored edges, the proteins with some kinds of annotation as hits and baits, vectors and sequences.


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "string_edges_head")


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return E.clean_edges(_raw(spark, d), "node_a", "node_b", "combined_score")


def _second(spark: SparkSession, d: str) -> DataFrame:
    """A second score of pairs, several per pair: the experimental channel, in order of row_id."""
    return _raw(spark, d).select(C.normalize_id("node_a").alias("u"), C.normalize_id("node_b").alias("v"), (F.col("experimental") / 1000.0).alias("w"), F.col("row_id").alias("pos")).where("u <> v and w > 0")


def _base(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select(C.normalize_id("node_a").alias("u"), C.normalize_id("node_b").alias("v"), F.col("combined_score").cast("double").alias("w")).where("u <> v and w is not null")


def _kind(spark: SparkSession, d: str, word: str) -> DataFrame:
    return _t(spark, d, "string_info_head").where(F.startswith("annotation", F.lit(word))).select(C.normalize_id("string_id").alias("id")).where("id is not null").distinct()


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned edges as a table of their own, for queries that read them more than once."""
    return Scratch(spark).write(_clean(spark, d))


def _seeds(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    """Two runs: the isomerases and the scaffold proteins of the graph."""
    nodes = E.endpoints(edges).select(F.col("id").alias("n"))
    both = _kind(spark, d, "Isomerase").withColumn("run_id", F.lit("isomerase")).unionByName(_kind(spark, d, "Scaffold").withColumn("run_id", F.lit("scaffold")))
    return Scratch(spark).write(uniform_seeds(both.join(nodes, F.col("id") == F.col("n"), "left_semi")))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return V.usable_vectors(_t(spark, d, "embeddings"), "vec_id", "embedding")


def _seqs(spark: SparkSession, d: str) -> DataFrame:
    """One cleaned sequence per protein as spelled: the last row's."""
    s = _t(spark, d, "seqs_parser").select(C.normalize_id("string_id").alias("id"), F.call_function("translate", "seq", F.lit(BLANKS), F.lit("")).alias("seq"), "row_id").where("id is not null and seq <> ''")
    return s.groupBy("id").agg(F.max_by("seq", "row_id").alias("seq"))


KEY = "nullif(upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')), '')"
_BL = "'" + BLANKS + "'"
_ID = f"nullif(trim({{0}}, {_BL}), '')"
_U, _V = _ID.format("node_a"), _ID.format("node_b")
_RAW = f"""rej AS (SELECT *, CASE WHEN u IS NULL OR v IS NULL THEN 'rows_missing_id' WHEN u = v THEN 'self_loops_removed' WHEN s IS NULL THEN 'rows_missing_score' END AS reject
  FROM (SELECT row_id, {_U} AS u, {_V} AS v, combined_score AS s FROM string_edges_head)),
ded AS (SELECT least(u, v) AS u, greatest(u, v) AS v, max(s)::DOUBLE AS raw FROM rej WHERE reject IS NULL GROUP BY ALL)"""
_CLEAN = _RAW + """,
span AS (SELECT min(raw) AS low, max(raw) AS high FROM ded),
cl AS MATERIALIZED (SELECT u, v, least(1.0, greatest(0.0, CASE WHEN low >= 0 AND high <= 1 THEN raw WHEN low >= 0 AND high <= 1000 THEN raw / 1000.0
  WHEN high > low THEN (raw - low) / (high - low) ELSE (raw > 0)::INT::DOUBLE END)) AS w FROM ded, span)"""
_ADJ = _CLEAN + """,
adj AS MATERIALIZED (SELECT u AS src, v AS dst, w FROM cl UNION ALL SELECT v, u, w FROM cl),
deg AS MATERIALIZED (SELECT src AS id, count(*) AS degree, sum(w) AS weighted_degree FROM adj GROUP BY src)"""
_KIND = f"(SELECT DISTINCT {_ID.format('string_id')} AS id FROM string_info_head WHERE starts_with(annotation, '{{0}}') AND {_ID.format('string_id')} IS NOT NULL)"
_SEEDS = _ADJ + f""",
two AS (SELECT 'isomerase' AS run_id, id FROM {_KIND.format('Isomerase')} UNION ALL SELECT 'scaffold', id FROM {_KIND.format('Scaffold')}),
seeds AS MATERIALIZED (SELECT run_id, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY run_id) AS p FROM two WHERE id IN (SELECT id FROM deg))"""
_SECOND = f"f AS (SELECT {_U} AS u, {_V} AS v, experimental / 1000.0::DOUBLE AS w, row_id AS pos FROM string_edges_head WHERE {_U} <> {_V} AND experimental > 0)"
_BASE = f"b AS (SELECT {_U} AS u, {_V} AS v, combined_score::DOUBLE AS w FROM string_edges_head WHERE {_U} <> {_V} AND combined_score IS NOT NULL)"


_KEYED = f"s AS (SELECT {KEY.format('string_id')} AS id, translate(seq, {_BL}, '') AS seq, row_id FROM seqs_parser), q AS MATERIALIZED (SELECT id, arg_max(seq, row_id) AS seq FROM s WHERE id IS NOT NULL AND seq <> '' GROUP BY id)"


def _keyed(spark, d):
    """One cleaned sequence per id key: the last row's."""
    s = _t(spark, d, "seqs_parser").select(id_key("string_id").alias("id"), F.call_function("translate", "seq", F.lit(BLANKS), F.lit("")).alias("seq"), "row_id").where("id is not null and seq <> ''")
    return s.groupBy("id").agg(F.max_by("seq", "row_id").alias("seq"))


_USED = f"""vec AS (SELECT row_id, {KEY.format('ids')} AS id, emb::DOUBLE[] AS x FROM emb WHERE len(emb) = 128 AND len(list_filter(emb, lambda v: v IS NOT NULL AND isfinite(v))) = 128 AND len(list_filter(emb, lambda v: v <> 0)) > 0),
used AS MATERIALIZED (SELECT id, arg_max(x, row_id) AS x FROM vec WHERE id IS NOT NULL GROUP BY id)"""


def _proteins(spark, d):
    """(``id``, ``emb``): of the usable vectors of a protein that of the last row."""
    v = V.usable_vectors(_t(spark, d, "emb").withColumn("k", id_key("ids")), "k", "emb", 128, keep=("row_id",))
    return v.groupBy("id").agg(F.max_by("emb", "row_id").alias("emb"))


def _ppr_sql(iterations: int, start: str = "SELECT run_id, id, p AS score FROM seeds", alpha: float = 0.85, ctes: str = _SEEDS) -> str:
    out = ctes + f""",
st AS MATERIALIZED (SELECT src, dst, w / weighted_degree * {alpha} AS share FROM adj JOIN deg ON src = id WHERE weighted_degree > 0 AND w > 0),
s0 AS MATERIALIZED ({start})"""
    for i in range(1, iterations + 1):
        out += f""",
s{i} AS MATERIALIZED (SELECT run_id, id, sum(x) AS score FROM (
  SELECT run_id, dst AS id, score * share AS x FROM s{i - 1} JOIN st ON id = src UNION ALL SELECT run_id, id, p * {1 - alpha} FROM seeds UNION ALL
  SELECT run_id, seeds.id, p * lost * {alpha} FROM seeds JOIN (SELECT run_id, sum(score) AS lost FROM s{i - 1} JOIN deg USING (id) WHERE weighted_degree <= 0 GROUP BY run_id) USING (run_id)) GROUP BY run_id, id)"""
    return out + f""",
scores AS MATERIALIZED (SELECT r.run_id, d.id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT run_id FROM seeds) r CROSS JOIN deg d LEFT JOIN s{iterations} s ON s.run_id = r.run_id AND s.id = d.id)"""


# Cleaning


@query(f"WITH {_RAW} SELECT count(*) AS raw_rows, " + ", ".join(f"count(*) FILTER (reject = '{r}') AS {r}" for r in E.REJECTS) + ", count(*) FILTER (reject IS NULL) - (SELECT count(*) FROM ded) AS duplicate_edges_collapsed, (SELECT count(*) FROM ded) AS valid_edges_after_cleaning FROM rej")
def edges_clean_counts(spark, d):
    return E.clean_counts(_raw(spark, d), "node_a", "node_b", "combined_score")


@query(f"WITH {_RAW} SELECT u, v, raw AS w FROM ded")
def edges_dedup_max(spark, d):
    return E.undirected_max(_base(spark, d))


@query(f"WITH {_BASE} SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM b")
def edges_distinct_undirected(spark, d):
    return E.undirected_distinct(_base(spark, d))


def _priced(spark, d, column):
    df = _t(spark, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("a"), F.concat(F.lit("S"), "l_suppkey").alias("b"), column)
    return E.clean_edges(df, "a", "b", column).select("u", "v", F.round("w", 6).alias("w"))


_PRICED = "WITH m AS (SELECT 'P' || l_partkey AS u, 'S' || l_suppkey AS v, max({0}) AS x FROM lineitem GROUP BY ALL) SELECT u, v, round({1}, 6) AS w FROM m"


@query(_PRICED.format("l_discount", "x"))
def score_norm_identity(spark, d):
    return _priced(spark, d, "l_discount")


@query(f"WITH {_CLEAN} SELECT u, v, round(w, 6) AS w FROM cl")
def score_norm_div1000(spark, d):
    return _clean(spark, d).select("u", "v", F.round("w", 6).alias("w"))


@query(_PRICED.format("l_extendedprice", "(x - (SELECT min(x) FROM m)) / (SELECT max(x) - min(x) FROM m)"))
def score_norm_minmax(spark, d):
    return _priced(spark, d, "l_extendedprice")


@query(f"WITH {_BASE} SELECT u, v, round((w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()), 6) AS w FROM b")
def edges_minmax01(spark, d):
    return E._normalized(_base(spark, d), "minmax").select("u", "v", F.round("nw", 6).alias("w"))


@query(f"WITH {_BASE} SELECT u, v, least(1.0, greatest(0.0, w))::DOUBLE AS w FROM b")
def edges_clip01(spark, d):
    return E._normalized(_base(spark, d), "clip01").select("u", "v", F.col("nw").alias("w"))


@query(f"WITH {_CLEAN}, n AS {_KIND.format('')} SELECT u, v, round(w, 6) AS w FROM cl WHERE w > 0.3 AND u IN (SELECT id FROM n) AND v IN (SELECT id FROM n)")
def edges_min_weight_whitelist(spark, d):
    return E.filtered_graph(_clean(spark, d), nodes=_kind(spark, d, ""), min_w=0.3).select("u", "v", F.round("w", 6).alias("w"))


@query(f"WITH {_BASE}, {_SECOND}, m AS (SELECT u, v, w / 1000 AS w FROM b UNION ALL SELECT u, v, w FROM f) SELECT least(u, v) AS u, greatest(u, v) AS v, round(max(w), 6) AS w FROM m WHERE w > 0 GROUP BY ALL")
def edges_merge_max(spark, d):
    return E.merge_max(_base(spark, d).withColumn("w", F.col("w") / 1000), _second(spark, d)).select("u", "v", F.round("w", 6).alias("w"))


@query(f"WITH {_CLEAN}, n AS {_KIND.format('')} SELECT u, v FROM cl WHERE u IN (SELECT id FROM n) AND v IN (SELECT id FROM n)")
def endpoint_semi_join(spark, d):
    return E.within_nodes(_clean(spark, d), _kind(spark, d, "")).select("u", "v")


@query(f"WITH {_CLEAN} SELECT u AS id FROM cl UNION SELECT v FROM cl")
def nodes_distinct_union(spark, d):
    return E.endpoints(_clean(spark, d))


@query(f"SELECT {_U} AS u, {_V} AS v, coexpression / 1000.0::DOUBLE AS w FROM string_edges_head WHERE {_U} <> {_V} AND coexpression IS NOT NULL")
def channel_projection(spark, d):
    return E.channel(_raw(spark, d), "node_a", "node_b", "coexpression")


# Sets, seeds, labels, hits


@query(f"WITH {_ADJ} SELECT id FROM deg WHERE id IN (SELECT id FROM {_KIND.format('Isomerase')})")
def hits_intersect_graph(spark, d):
    n = E.endpoints(_clean(spark, d))
    return _kind(spark, d, "Isomerase").intersect(n)


@query(f"WITH {_ADJ} SELECT id FROM deg WHERE id NOT IN (SELECT id FROM {_KIND.format('Isomerase')}) AND id NOT IN (SELECT id FROM {_KIND.format('Scaffold')})")
def nulls_eligible_anti(spark, d):
    return E.endpoints(_clean(spark, d)).subtract(_kind(spark, d, "Isomerase")).subtract(_kind(spark, d, "Scaffold"))


@query(f"WITH s AS (SELECT {_ID.format('string_id')} AS id, coalesce(protein_size, 1)::DOUBLE AS w FROM string_info_head), k AS (SELECT id, sum(w) AS w FROM s WHERE id IS NOT NULL AND w > 0 GROUP BY id) SELECT id, round(w / (SELECT sum(w) FROM k), 12) AS p FROM k")
def seeds_normalized(spark, d):
    return P.weighted_seeds(_t(spark, d, "string_info_head").select(F.col("string_id").alias("id"), F.col("protein_size").alias("weight"))).select("id", F.round("p", 12).alias("p"))


@query(f"WITH s AS (SELECT {_ID.format('string_id')} AS id, protein_size - 300 AS x, row_id FROM string_info_head) SELECT id, CASE WHEN arg_max(x, row_id) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM s WHERE id IS NOT NULL AND x IS NOT NULL GROUP BY id")
def labels_last_wins(spark, d):
    return S.labels(_t(spark, d, "string_info_head").select(F.col("string_id").alias("id"), (F.col("protein_size") - 300).alias("value"), F.col("row_id").alias("pos")))


@query(f"SELECT DISTINCT {_ID.format('string_id')} AS id FROM string_info_head WHERE {_ID.format('string_id')} IS NOT NULL AND (lower(trim(preferred_name, {_BL})) IN ('1', 'true', 't', 'yes', 'y', 'high', 'hc', 'hit') OR protein_size % 2 <> 0)")
def truthy_hits(spark, d):
    df = _t(spark, d, "string_info_head").withColumn("conf", F.when(F.lower(C.strip("preferred_name")).isin(*C.TRUTHY), F.lit("Yes")).otherwise((F.col("protein_size") % 2).cast("string")))
    return S.hit_table(df, "string_id", conf="conf")[0]


@query(f"""WITH x AS (SELECT unnest(CASE WHEN contains(annotation, ';') THEN string_split(annotation, ';') WHEN contains(annotation, '|') THEN string_split(annotation, '|') ELSE string_split(annotation, ',') END) AS b FROM string_info_head WHERE {_ID.format('string_id')} IS NOT NULL)
SELECT DISTINCT trim(b, {_BL}) AS id FROM x WHERE trim(b, {_BL}) <> ''""")
def multi_value_baits(spark, d):
    return S.hit_table(_t(spark, d, "string_info_head"), "string_id", bait="annotation")[1]


# Graph


@query(f"WITH {_ADJ} SELECT id, round(weighted_degree, 6) AS weighted_degree FROM deg")
def degree_weighted(spark, d):
    return G.degrees(_clean(spark, d)).select("id", F.round("weighted_degree", 6).alias("weighted_degree"))


@query(f"WITH {_ADJ} SELECT id, degree FROM deg")
def degree_unweighted(spark, d):
    return G.degrees(_clean(spark, d)).select("id", "degree")


_COMP = _ADJ + """, r AS (SELECT src AS id, src AS label FROM adj UNION SELECT a.dst, r.label FROM r JOIN adj a ON r.id = a.src WHERE r.label < a.dst),
comp AS (SELECT id, min(label) AS component FROM r GROUP BY id)"""


@query(f"WITH RECURSIVE {_COMP} SELECT size, count(*) AS components FROM (SELECT count(*) AS size FROM comp GROUP BY component) GROUP BY size")
def components_sizes(spark, d):
    return G.component_sizes(G.components(_clean(spark, d))).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


_SUM = "round(min({0}), 6) AS {1}_min, round(max({0}), 6) AS {1}_max, round(avg({0}), 6) AS {1}_mean, round(median({0}), 6) AS {1}_median"


@query(f"""WITH RECURSIVE {_COMP}, a AS (SELECT count(*) AS num_nodes, {_SUM.format('degree', 'degree')}, {_SUM.format('weighted_degree', 'weighted')} FROM deg),
b AS (SELECT count(*) AS num_edges, {_SUM.format('w', 'weight')} FROM cl), c AS (SELECT count(*) AS size FROM comp GROUP BY component)
SELECT *, (SELECT count(*) FROM c) AS components, (SELECT max(size) FROM c) AS largest, (SELECT array_to_string(list(size ORDER BY size DESC)[1:10], ',') FROM c) AS top_10 FROM a, b""")
def graph_summary_stats(spark, d):
    g = G.graph_stats(_clean(spark, d))
    parts = [F.round(F.col(f"{c}.{s}"), 6).alias(f"{n}_{s}") for c, n in (("degree", "degree"), ("weighted_degree", "weighted"), ("edge_weight", "weight")) for s in ("min", "max", "mean", "median")]
    cc = "connected_components"
    return g.select("num_nodes", "num_edges", *parts, F.col(f"{cc}.count").alias("components"), F.col(f"{cc}.largest_size").alias("largest"), F.array_join(F.col(f"{cc}.sizes_top_10"), ",").alias("top_10"))


def _scores(spark, d, iterations=20, digits=10, **kw):
    """(scores, seeds) of both runs."""
    edges = _graph(spark, d)
    seeds = _seeds(spark, d, edges)
    s = pagerank(edges, seeds, tol=None, max_iter=iterations, **kw).scores
    return s.select("run_id", "id", F.round("score", digits).alias("score")), seeds


_SC = "SELECT run_id, id, round(score, 10) AS score FROM scores"
_RANKED = f"rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id) AS rank FROM ({_SC}) q WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.run_id = q.run_id AND s.id = q.id))"


@query(f"WITH {_ppr_sql(20)} SELECT run_id, id, round(score, 8) AS score FROM scores")
def ppr_multi_seed(spark, d):
    return _scores(spark, d, digits=8)[0]


@query(f"WITH {_ppr_sql(20)} SELECT id, round(score, 8) AS score FROM scores WHERE run_id = 'isomerase'")
def ppr_scores_20it(spark, d):
    edges = _graph(spark, d)
    s = pagerank(edges, _seeds(spark, d, edges).where("run_id = 'isomerase'"), tol=None, max_iter=20).scores
    return s.select("id", F.round("score", 8).alias("score"))


@query(f"WITH {_ppr_sql(20)}, {_RANKED} SELECT run_id, id, round(score, 8) AS score, rank FROM rk WHERE rank <= 20")
def ppr_top20(spark, d):
    scores, seeds = _scores(spark, d)
    r = R.rank_nodes(scores, exclude=seeds)
    return r.where("rank <= 20").select("run_id", "id", F.round("score", 8).alias("score"), "rank")


_UNIFORM = "SELECT r.run_id, d.id, 1.0::DOUBLE / (SELECT count(*) FROM deg) AS score FROM (SELECT DISTINCT run_id FROM seeds) r CROSS JOIN deg d"


@query(f"WITH {_ppr_sql(10, _UNIFORM)} SELECT run_id, id, round(score, 8) AS score FROM scores")
def ppr_uniform_start(spark, d):
    return _scores(spark, d, 10, 8, start="uniform")[0]


# Ranking and evaluation: proteins of other kinds as positives


_POS = _KIND.format("Transporter")
_EVAL = f"{_ppr_sql(20)}, {_RANKED}, pos AS {_POS}, h AS (SELECT rk.*, (id IN (SELECT id FROM pos))::INT AS hit FROM rk), c AS (SELECT *, sum(hit) OVER (PARTITION BY run_id ORDER BY rank) AS hits, sum(hit) OVER (PARTITION BY run_id) AS p, count(*) OVER (PARTITION BY run_id) AS n FROM h)"


def _evaluated(spark, d):
    pos = _kind(spark, d, "Transporter").select(F.col("id").alias("q"))
    scores, seeds = _scores(spark, d)
    s = scores.join(pos, F.col("id") == F.col("q"), "left").select("run_id", "id", "score", F.col("q").isNotNull().alias("pos"))
    return R.rank_nodes(s, exclude=seeds, hit=F.col("pos"))


_AT = ", ".join(f"round(sum(hit) FILTER (rank <= {k}) / any_value(p), 6) AS recall_at_{k}, round(sum(hit) FILTER (rank <= {k}) / least({k}, count(*)), 6) AS precision_at_{k}, round(sum(hit) FILTER (rank <= {k}) / least({k}, count(*)) / (any_value(p) / count(*)), 6) AS enrichment_at_{k}" for k in KS)


def _rounded(df, skip=("run_id", "method", "graph")):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_EVAL} SELECT run_id, count(*) AS num_candidates, any_value(p)::BIGINT AS num_positives, round(sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) / any_value(p), 6) AS auprc, round(any_value(p) / count(*), 6) AS positive_rate, {_AT} FROM c GROUP BY run_id")
def rank_metrics_at_k(spark, d):
    return _rounded(R.ranking_metrics(_evaluated(spark, d), KS))


@query(f"WITH {_EVAL} SELECT run_id, rank, round(hits / p, 6) AS recall, round(hits / rank, 6) AS precision FROM c WHERE hit = 1 UNION ALL SELECT DISTINCT run_id, 0, 0.0, 1.0 FROM c WHERE p > 0")
def pr_curve(spark, d):
    return _rounded(R.pr_curve(_evaluated(spark, d)))


@query(f"WITH {_EVAL} SELECT run_id, round(sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) / any_value(p), 6) AS auprc, round(sum(hit) FILTER (rank <= 200) / greatest(1, any_value(p)), 6) AS recall_at_k, round(sum(hit) FILTER (rank <= 200) / least(200, count(*)), 6) AS precision_at_k, round(sum(hit) FILTER (rank <= 200) / least(200, count(*)) / (any_value(p) / count(*)), 6) AS enrichment_at_k FROM c GROUP BY run_id")
def average_precision(spark, d):
    return _rounded(R.top_metrics(_evaluated(spark, d), 200))


@query(f"WITH {_ADJ} SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM deg")
def degree_rank_baseline(spark, d):
    s = G.degrees(_clean(spark, d)).select(F.lit(0).alias("run_id"), "id", F.col("degree").cast("double").alias("score"))
    return R.rank_nodes(s).select("id", F.col("score").cast("long").alias("degree"), "rank")


@query(f"WITH {_ADJ}, x AS (SELECT r AS run_id, id, md5(id || ':' || r || ':7') AS h FROM deg, range(3) t(r)) SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY h, id) AS rank FROM x")
def random_rank_baseline(spark, d):
    runs = spark.range(3).select(F.col("id").alias("run_id"))
    s = E.endpoints(_clean(spark, d)).join(F.broadcast(runs)).select("run_id", "id", C.ordered_hash("id", F.col("run_id"), seed=7).alias("h"))
    return R.number_within(s, "run_id", "h", "id").select("run_id", "id", (F.col("at") + 1).alias("rank"))


@query(f"""WITH {_ADJ}, s AS (SELECT id AS seed_id, weighted_degree AS t FROM deg WHERE id IN (SELECT id FROM {_KIND.format('Scaffold')})),
e AS (SELECT id, round(weighted_degree, 9) AS d FROM deg WHERE id NOT IN (SELECT id FROM {_KIND.format('Isomerase')}) AND id NOT IN (SELECT id FROM {_KIND.format('Scaffold')})),
o AS (SELECT seed_id, id, d, round(t, 9) AS t, row_number() OVER (ORDER BY id) AS i FROM e, s),
w AS (SELECT seed_id, id, row_number() OVER (PARTITION BY seed_id ORDER BY abs(d - t), CASE WHEN d < t THEN 0 ELSE 1 END, CASE WHEN d < t THEN -i ELSE i END) AS place FROM o) SELECT seed_id, id, place FROM w WHERE place <= 25""")
def matched_seed_pool(spark, d):
    deg = G.degrees(_clean(spark, d)).select("id", F.round("weighted_degree", 9).alias("d"))
    iso, sc = _kind(spark, d, "Isomerase"), _kind(spark, d, "Scaffold")
    only = lambda k, how: deg.join(k.select(F.col("id").alias("k")), F.col("id") == F.col("k"), how)
    free = only(iso, "left_anti").join(sc.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti")
    return L.matched_pool(only(sc, "left_semi"), free, 25)


_AGG = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {c}_std" for c in ("fusion", "neighborhood", "textmining"))


@query(f"SELECT source, count(*) AS n_rows, {_AGG} FROM string_edges_head GROUP BY source")
def metrics_aggregate(spark, d):
    return _rounded(R.aggregate_rows(_raw(spark, d).select("source", *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("fusion", "neighborhood", "textmining")]), ["source"]), skip=("source",))


@query("SELECT source, round(avg(fusion), 6) AS fusion, count(*) AS null_repeats_completed FROM string_edges_head GROUP BY source")
def repeat_mean(spark, d):
    return _rounded(R.repeat_means(_raw(spark, d), ["source"], ["fusion"]), skip=("source",))


@query(f"WITH {_CLEAN} SELECT least(29, floor((w - (SELECT min(w) FROM cl)) / (SELECT max(w) - min(w) FROM cl) * 30))::INT AS bin, count(*) AS n FROM cl GROUP BY bin")
def weight_histogram(spark, d):
    return R.histogram(_clean(spark, d), "w", 30)


# Splits


@query(f"""WITH {_ADJ}, h AS (SELECT id FROM {_KIND.format('Isomerase')}), b AS (SELECT id FROM {_KIND.format('Isomerase protein')} UNION SELECT id FROM {_KIND.format('Scaffold')}),
x AS (SELECT r::INT AS run_id, id, md5(id || ':' || (r + 42) || ':0') AS h FROM h, range(5) t(r) WHERE id NOT IN (SELECT id FROM b)),
y AS (SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY h, id) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM x),
z AS (SELECT run_id, id, CASE WHEN i <= CASE WHEN n = 1 THEN 1 ELSE greatest(1, least(n - 1, round_even(n * 0.7::DOUBLE, 0)::BIGINT)) END THEN 'train_hit' ELSE 'test_hit' END AS label FROM y
  UNION ALL SELECT r::INT, id, 'train_hit' FROM h, range(5) t(r) WHERE id IN (SELECT id FROM b))
SELECT run_id, id, max(label) AS label, max(seed) AS is_seed FROM (SELECT run_id, id, label, label = 'train_hit' AS seed FROM z UNION ALL SELECT r::INT, id, 'other', true FROM b, range(5) t(r)) GROUP BY run_id, id""")
def holdout_split(spark, d):
    return L.holdout(_kind(spark, d, "Isomerase"), _kind(spark, d, "Scaffold"), 5, force=True)


@query(f"WITH {_BASE}, e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM b), o AS (SELECT u, v, row_number() OVER (ORDER BY md5(u || ':' || v || ':0'), u, v) - 1 AS i, count(*) OVER () AS n FROM e) SELECT u, v, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o")
def edge_split(spark, d):
    return L.edge_split(_base(spark, d))


@query(f"WITH {_BASE}, e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM b), k AS (SELECT u AS x FROM e UNION SELECT v FROM e), o AS (SELECT x, row_number() OVER (ORDER BY md5(x || ':0'), x) - 1 AS i, count(*) OVER () AS n FROM k), l AS (SELECT x, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o) SELECT u, v, a.split FROM e JOIN l a ON u = a.x JOIN l c ON v = c.x AND a.split = c.split")
def node_split(spark, d):
    return L.node_split(_base(spark, d))


@query()
def negative_pairs(spark, d):
    e = _base(spark, d)
    return L.negative_pairs(e, E.undirected_distinct(e).count())


@query(f"SELECT row_id FROM emb ORDER BY md5(row_id || ':3'), row_id LIMIT 100")
def sampled_rows(spark, d):
    return L.sample_rows(_t(spark, d, "emb").select("row_id"), "row_id", 100, 3)


# Vectors


_UNIT = "e AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS x FROM embeddings), n AS MATERIALIZED (SELECT id, list_transform(x, y -> y / (sqrt(list_dot_product(x, x)) + 1e-12)) AS x FROM e)"
_CAND = _UNIT.replace("y ->", "lambda y:") + ", p AS (SELECT a.id AS u, b.id AS v, list_dot_product(a.x, b.x) AS c FROM n a JOIN n b ON a.id <> b.id), k AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(c, 12) DESC, v) AS r FROM p) WHERE r <= {0})"
_BEST = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(w, 12) DESC, v) AS q FROM wt) WHERE q <= {0}), g AS (SELECT least(u, v) AS u, greatest(u, v) AS v, max(w) AS w FROM t GROUP BY ALL)"


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def l2_norms(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(C.norm("embedding"), 6).alias("norm"))


@query(f"WITH {_CAND.format(1)} SELECT u, v, round(c, 6) AS c FROM k WHERE u::BIGINT % 20 = 0")
def cosine_top1(spark, d):
    v = _vectors(spark, d)
    return V.top_candidates(v.where(F.col("id").cast("long") % 20 == 0), v, 1).select("u", "v", F.round("c", 6).alias("c"))


@query(f"WITH {_CAND.format(50)}, wt AS (SELECT *, greatest(c, 0.0) AS w FROM k), {_BEST.format(20)} SELECT u, v, round(w, 6) AS w FROM g WHERE w > 0")
def knn_cos_pos(spark, d):
    v = _vectors(spark, d)
    return _rounded(V.knn_graph(v, v, cand_m=50, topm=20))


@query(f"WITH {_CAND.format(50)}, ex AS (SELECT *, exp((c - max(c) OVER (PARTITION BY u)) / 0.1::DOUBLE) AS e FROM k), wt AS (SELECT *, e / (sum(e) OVER (PARTITION BY u) + 1e-12) AS w FROM ex), {_BEST.format(20)} SELECT u, v, round(w, 6) AS w FROM g WHERE w > 0")
def knn_row_softmax(spark, d):
    v = _vectors(spark, d)
    return _rounded(V.knn_graph(v, v, cand_m=50, topm=20, weight="row_softmax", tau=0.1))


@query(f"WITH {_CAND.format(20)}, m AS (SELECT *, min(c) OVER (PARTITION BY u) AS lo, max(c) OVER (PARTITION BY u) AS hi FROM k) SELECT u, v, round(CASE WHEN hi > lo + 1e-12 THEN (c - lo) / (hi - lo) ELSE 0 END, 6) AS w FROM m")
def row_minmax(spark, d):
    v = _vectors(spark, d)
    return _rounded(V.anchor_minmax(V.top_candidates(v, v, 20)).select("u", "v", "w"))


@query(f"WITH {_CAND.format(20)} SELECT u, v, round(1 / (1 + exp(-(c - avg(c) OVER (PARTITION BY u)) / (stddev_pop(c) OVER (PARTITION BY u) + 1e-12))), 6) AS w FROM k")
def row_sigmoid_z(spark, d):
    v = _vectors(spark, d)
    return _rounded(V.anchor_sigmoid_z(V.top_candidates(v, v, 20)).select("u", "v", "w"))


@query(f"WITH {_USED}, q AS (SELECT [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]::DOUBLE[] AS q), n AS (SELECT sqrt(list_dot_product(x, x)) AS x FROM used) SELECT unnest(q) AS q, round(unnest((SELECT quantile_cont(x, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]) FROM n)), 6) AS value FROM q")
def embed_quantiles(spark, d):
    n = _proteins(spark, d).select(C.norm("emb").alias("x"))
    return _rounded(V.quantiles(n, "x", [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]), skip=("q",))


@query("""WITH x AS (SELECT emb, list_filter(emb, lambda v: v IS NOT NULL AND isfinite(v)) AS v FROM emb)
SELECT count(*) AS n, count(*) FILTER (emb IS NULL OR len(v) < len(emb)) AS bad, min(list_min(v))::DOUBLE AS min, max(list_max(v))::DOUBLE AS max, round(sum(len(list_filter(v, lambda y: abs(y) < 1e-6))) / sum(len(v)), 9) AS near_zero FROM x""")
def embed_finite(spark, d):
    r = V.finite_report(_t(spark, d, "emb"), "emb")
    return r.select("n", "bad", "min", "max", F.round("near_zero", 9).alias("near_zero"))


_SEQ = f"s AS (SELECT {_ID.format('string_id')} AS id, translate(seq, {_BL}, '') AS seq, row_id FROM seqs_parser), q AS MATERIALIZED (SELECT id, arg_max(seq, row_id) AS seq FROM s WHERE id IS NOT NULL AND seq <> '' GROUP BY id)"


@query(f"WITH {_USED}, {_KEYED}, l AS (SELECT q.id, length(seq) AS n, round(sqrt(list_dot_product(x, x)), 9) AS m FROM q JOIN used ON q.id = used.id) SELECT round(corr(a, b), 6) AS rho FROM (SELECT row_number() OVER (ORDER BY n, id) AS a, row_number() OVER (ORDER BY m, id) AS b FROM l)")
def length_norm_spearman(spark, d):
    """Rank correlation of the length of a protein's sequence with the norm of its vector."""
    v = _proteins(spark, d).select(F.col("id").alias("i"), F.round(C.norm("emb"), 9).alias("m"))
    s = _keyed(spark, d).join(v, F.col("id") == F.col("i")).select("id", F.length("seq").alias("n"), "m")
    return _rounded(V.rank_correlation(s, "n", "m", "id"))


@query(f"""WITH {_USED}, s AS (SELECT id, list_transform(x, lambda y: y / (sqrt(list_dot_product(x, x)) + 1e-12)) AS x FROM used ORDER BY md5(id || ':0'), id LIMIT 512), p AS MATERIALIZED (SELECT a.id AS u, b.id AS v, list_dot_product(a.x, b.x) AS c FROM s a JOIN s b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(c, 12) DESC, v) AS r FROM p), w AS (SELECT 'top1' AS kind, c FROM k WHERE r = 1 UNION ALL SELECT 'top5', c FROM k WHERE r = 5 UNION ALL SELECT 'any', c FROM p WHERE u < v)
SELECT kind, round(quantile_cont(c, 0.01), 4) AS q01, round(quantile_cont(c, 0.5), 4) AS q50, round(quantile_cont(c, 0.99), 4) AS q99 FROM w GROUP BY kind""")
def embed_knn_sanity(spark, d):
    return V.knn_sanity(_proteins(spark, d), 512).select("kind", *[F.round(c, 4).alias(c) for c in ("q01", "q50", "q99")])


@query(f"WITH {_UNIT.replace('y ->', 'lambda y:')}, a AS (SELECT vec_id::VARCHAR AS u, (vec_id + 1)::VARCHAR AS v FROM embeddings) SELECT u, v, round(list_sum(list_transform(list_zip(x.x, y.x), lambda z: abs(z[1] - z[2]))), 6) AS diff, round(list_dot_product(x.x, y.x), 6) AS prod, 4 * len(x.x) AS size FROM a JOIN n x ON x.id = u JOIN n y ON y.id = v")
def pair_features(spark, d):
    unit = _vectors(spark, d).select("id", C.l2_normalize("emb").alias("x"))
    a = unit.select(F.col("id").alias("u"), F.col("x").alias("a"), (F.col("id").cast("long") + 1).cast("string").alias("v"))
    f = a.join(unit.select(F.col("id").alias("w"), F.col("x").alias("b")), F.col("v") == F.col("w")).select("u", "v", C.pair_features("a", "b").alias("f"))
    k = (F.size("f") / 4).cast("int")
    total = lambda i: F.round(F.aggregate(F.slice("f", k * i + 1, k), F.lit(0.0), lambda s, x: s + x), 6)
    return f.select("u", "v", total(2).alias("diff"), total(3).alias("prod"), F.size("f").cast("long").alias("size"))


# Fusion


_LAST = "l AS (SELECT least(u, v) AS a, greatest(u, v) AS b, arg_max(w, pos) AS p FROM f GROUP BY ALL)"
_FUSE = f"{_BASE}, {_SECOND}, {_LAST}, r AS (SELECT b.u, b.v, (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) * {{0}} AS w FROM b LEFT JOIN l ON least(b.u, b.v) = l.a AND greatest(b.u, b.v) = l.b)"
_GATE = {"exp": "exp(coalesce(p, 0))", "linear": "(1 + coalesce(p, 0))"}
_MIX = "SELECT least(u, v) AS u, greatest(u, v) AS v, round(sum(w), 6) AS w FROM (SELECT u, v, 0.7::DOUBLE * w AS w FROM r UNION ALL SELECT u, v, 0.3::DOUBLE * w FROM f) GROUP BY ALL HAVING sum(w) > 0"


@query(f"WITH {_FUSE.format(_GATE['exp'])} SELECT u, v, round(w, 6) AS w FROM r")
def reweight_exp(spark, d):
    return _rounded(E.reweight(_base(spark, d), _second(spark, d)))


@query(f"WITH {_FUSE.format(_GATE['linear'])} SELECT u, v, round(w, 6) AS w FROM r")
def reweight_linear(spark, d):
    return _rounded(E.reweight(_base(spark, d), _second(spark, d), kind="linear"))


@query(f"WITH {_FUSE.format(_GATE['exp'])} {_MIX}")
def gated_mix_exp(spark, d):
    return _rounded(E.gated_mix(_base(spark, d), _second(spark, d), lam=0.7))


@query(f"WITH {_FUSE.format(_GATE['linear'])} {_MIX}")
def gated_mix_linear(spark, d):
    return _rounded(E.gated_mix(_base(spark, d), _second(spark, d), lam=0.7, kind="linear"))


# Sequences


@query(f"WITH {_SEQ}, w AS (SELECT id, seq, unnest(range(0, greatest(0, ceil((length(seq) - 1022) / 768.0))::BIGINT * 768 + 1, 768)) AS start FROM q) SELECT id, start::INT AS start, substr(seq, start + 1, 1022) AS win FROM w")
def seq_windows(spark, d):
    return _seqs(spark, d).select("id", F.explode(C.windows("seq", 1022, 768)).alias("w")).select("id", F.col("w.start").alias("start"), F.col("w.window").alias("win"))


@query(f"WITH {_SEQ} SELECT (length(seq) // 128) * 128 AS bucket, count(*) AS n FROM q GROUP BY bucket")
def seq_length_buckets(spark, d):
    return _seqs(spark, d).groupBy(C.length_bucket("seq", 128).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_PAIRS = f"{_BASE}, pr AS (SELECT DISTINCT u, v FROM b), {_SEQ}, j AS (SELECT u, v, x.seq AS a, y.seq AS b FROM pr JOIN q x ON x.id = u JOIN q y ON y.id = v)"


def _pairs(spark, d):
    return _base(spark, d).select("u", "v").distinct()


@query(f"WITH {_PAIRS} SELECT u, v, a || repeat('X', 10) || b AS text FROM j")
def linker_pairs(spark, d):
    s = _seqs(spark, d)
    a, b = s.select(F.col("id").alias("x"), F.col("seq").alias("a")), s.select(F.col("id").alias("y"), F.col("seq").alias("b"))
    return _pairs(spark, d).join(a, F.col("u") == F.col("x")).join(b, F.col("v") == F.col("y")).select("u", "v", C.linked("a", "b").alias("text"))


@query(f"WITH {_SEQ} SELECT id, array_to_string(string_split(seq, ''), ' ') AS text FROM q")
def char_spaced(spark, d):
    return _seqs(spark, d).select("id", C.spaced("seq").alias("text"))


@query(f"WITH {_SEQ} SELECT id, array_to_string(list_transform(range(0, length(seq), 60), lambda i: substr(seq, i + 1, 60)), chr(10)) AS text FROM q")
def fasta_wrap(spark, d):
    return _seqs(spark, d).select("id", C.wrapped("seq").alias("text"))


_KM = "list_transform(range(1, length({0}) - {1} + 2), lambda i: substr({0}, i, {1}))"


@query(f"""WITH {_SEQ}, w AS (SELECT id, start, substr(seq, start + 1, 1022) AS t FROM (SELECT id, seq, unnest(range(0, greatest(0, ceil((length(seq) - 1022) / 768.0))::BIGINT * 768 + 1, 768)) AS start FROM q)),
c AS (SELECT id, start, ('0x' || substr(md5(m), 1, 6))::BIGINT % 32 AS b, count(*) AS x FROM (SELECT id, start, unnest({_KM.format('t', 3)}) AS m FROM w) GROUP BY ALL),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id) SELECT id, b::INT AS bucket, round(sum(x) / any_value(n), 6) AS value FROM c JOIN n USING (id) GROUP BY id, b""")
def kmer_embedding(spark, d):
    e = M.embed(_seqs(spark, d), "id", "seq")
    return e.select("id", F.posexplode("emb").alias("bucket", "value")).where("value > 0").select("id", "bucket", F.round("value", 6).alias("value"))


@query(f"WITH {_PAIRS}, k AS (SELECT u, v, list_distinct({_KM.format('a', 3)}) AS x, list_distinct({_KM.format('b', 3)}) AS y FROM j), n AS (SELECT u, v, len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS n FROM k) SELECT u, v, round(CASE WHEN n > 0 THEN i / n ELSE 0 END, 6) AS c FROM n")
def kmer_coupling(spark, d):
    return _rounded(M.score_pairs(_pairs(spark, d), _seqs(spark, d)))


_LL = "CASE WHEN length({0}) > 1 THEN -ln((len(list_distinct(" + _KM.format("{0}", 2) + ")) + 1.0) / length({0})) ELSE 0 END"


@query(f"WITH {_PAIRS}, k AS (SELECT u, v, a, b, a || repeat('X', 10) || b AS t FROM j) SELECT u, v, round({_LL.format('t')} - {_LL.format('a')} - {_LL.format('b')}, 6) AS c FROM k")
def likelihood_gain(spark, d):
    return _rounded(M.likelihood_gain(_pairs(spark, d), _seqs(spark, d)))


_MASKED = f"""{_PAIRS}, m AS MATERIALIZED (SELECT id, seq, CASE WHEN length(seq) <= 8 THEN repeat('X', length(seq)) ELSE
  array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN list_contains(p, i) THEN 'X' ELSE seq[i] END), '') END AS mask
  FROM (SELECT id, seq, list_transform(list_sort(list_transform(range(1, length(seq) + 1), lambda i: {{'h': md5(md5(seq) || ':' || i || ':0'), 'i': i}}))[1:8], lambda x: x.i) AS p FROM q)),
km AS MATERIALIZED (SELECT id, list_distinct({_KM.format('seq', 3)}) AS x, list_distinct({_KM.format('mask', 3)}) AS y FROM m),
lo AS (SELECT u, v, len(list_intersect(a.x, b.x)) / greatest(1, len(list_distinct(list_concat(a.x, b.x)))) AS f, len(list_intersect(a.y, b.x)) / greatest(1, len(list_distinct(list_concat(a.y, b.x)))) AS g,
  len(list_intersect(a.x, b.y)) / greatest(1, len(list_distinct(list_concat(a.x, b.y)))) AS h FROM pr JOIN km a ON a.id = u JOIN km b ON b.id = v)"""


@query(f"WITH {_MASKED} SELECT u, v, round((greatest(0, f - g) + greatest(0, f - h)) / 2, 6) AS c FROM lo")
def masked_coupling(spark, d):
    return _rounded(M.masked_coupling(_pairs(spark, d), _seqs(spark, d)))


_PROTEINS = _USED + ", n AS MATERIALIZED (SELECT id, list_transform(x, lambda y: y / (sqrt(list_dot_product(x, x)) + 1e-12)) AS x FROM used), p AS (SELECT a.id AS u, b.id AS v, list_dot_product(a.x, b.x) AS c FROM n a JOIN n b ON a.id <> b.id), k AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(c, 12) DESC, v) AS r FROM p) WHERE r <= {0})"


@query(f"""WITH {_PROTEINS.format(40)}, {_KEYED}, km AS MATERIALIZED (SELECT id, list_distinct({_KM.format('seq', 3)}) AS x FROM q),
sc AS (SELECT u, v, CASE WHEN len(list_distinct(list_concat(a.x, b.x))) > 0 THEN len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) ELSE 0 END AS c FROM k JOIN km a ON a.id = u JOIN km b ON b.id = v),
mm AS (SELECT *, min(c) OVER (PARTITION BY u) AS lo, max(c) OVER (PARTITION BY u) AS hi FROM sc), wt AS (SELECT u, v, CASE WHEN hi > lo + 1e-12 THEN (c - lo) / (hi - lo) ELSE 0 END AS w FROM mm), {_BEST.format(20)}
SELECT u, v, round(w, 6) AS w FROM g WHERE w > 0""")
def pair_score_graph(spark, d):
    return _rounded(M.pair_score_graph(_proteins(spark, d), _keyed(spark, d), cand_m=40, topm=20))


@query(f"WITH {_PROTEINS.format(500)}, wt AS (SELECT *, greatest(c, 0.0) AS w FROM k), {_BEST.format(20)} SELECT u, v, round(w, 5) AS w FROM g WHERE w > 0")
def protein_knn_graph(spark, d):
    """The similarity graph of the proteins' vectors, with 500 candidates each."""
    v = _proteins(spark, d)
    return V.knn_graph(v, v, cand_m=500, topm=20).select("u", "v", F.round("w", 5).alias("w"))


# Reports and workflows


@query("SELECT row_id, protein_size FROM string_info_head ORDER BY protein_size DESC NULLS LAST, row_id LIMIT 6")
def top_n_sorted(spark, d):
    return R.top_rows(_t(spark, d, "string_info_head").select("row_id", "protein_size"), "protein_size", 6, tie="row_id")


_CH = _BASE.replace("b AS (", "c0 AS (").replace("combined_score", "{0}")


def _folder_sql() -> str:
    parts = []
    for name, column in (("combined", "combined_score"), ("textmining", "textmining")):
        ctes = f"""cl AS MATERIALIZED (SELECT least(u, v) AS u, greatest(u, v) AS v, max(w) AS w FROM (SELECT {_U} AS u, {_V} AS v, {column} / 1000.0::DOUBLE AS w FROM string_edges_head) WHERE u <> v AND w > 0 GROUP BY ALL),
adj AS MATERIALIZED (SELECT u AS src, v AS dst, w FROM cl UNION ALL SELECT v, u, w FROM cl), deg AS MATERIALIZED (SELECT src AS id, sum(w) AS weighted_degree FROM adj GROUP BY src),
seeds AS MATERIALIZED (SELECT '{name}' AS run_id, id, 1.0::DOUBLE / count(*) OVER () AS p FROM {_KIND.format('Scaffold')} WHERE id IN (SELECT id FROM deg))"""
        parts.append(f"""(WITH {_ppr_sql(10, _UNIFORM, ctes=ctes)}, {_RANKED}, h AS (SELECT rk.*, (id IN (SELECT id FROM {_POS}))::INT AS hit FROM rk)
SELECT '{name}' AS graph, (SELECT count(*) FROM deg) AS n_nodes, (SELECT count(*) FROM seeds) AS n_seeds, sum(hit)::BIGINT AS n_pos_eval, round(sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) / sum(hit), 6) AS auprc, round(sum(hit) FILTER (rank <= 200) / greatest(1, sum(hit)), 6) AS recall_at_k,
round(sum(hit) FILTER (rank <= 200) / least(200, count(*)), 6) AS precision_at_k, round(sum(hit) FILTER (rank <= 200) / least(200, count(*)) / (sum(hit) / count(*)), 6) AS enrichment_at_k FROM (SELECT *, sum(hit) OVER (ORDER BY rank) AS hits FROM h))""")
    return " UNION ALL ".join(parts)


@query(_folder_sql())
def folder_eval(spark, d):
    raw = _raw(spark, d)
    pick = lambda c: E.filtered_graph(E.channel(raw, "node_a", "node_b", c))
    seeds = _kind(spark, d, "Scaffold").withColumn("weight", F.lit(1))
    pos = _kind(spark, d, "Transporter").withColumn("value", F.lit(1))
    out = P.evaluate_graphs({"combined": pick("combined_score"), "textmining": pick("textmining")}, seeds, pos, tol=None, max_iter=10, digits=10)
    return _rounded(out.select("graph", "n_nodes", "n_seeds", "n_pos_eval", "auprc", "recall_at_k", "precision_at_k", "enrichment_at_k"))


@query()
def holdout_workflow(spark, d):
    return P.run_holdout(_clean(spark, d), _kind(spark, d, "Isomerase"), _kind(spark, d, "Scaffold"), repeats=5, random_repeats=100, matched_repeats=2, tol=None, max_iter=20, ks=KS)["summary"]


@query()
def pair_mlp_graph(spark, d):
    from weftgraph.operators import learn

    v = _vectors(spark, d)
    g = V.knn_graph(v, v, cand_m=10, topm=5)
    split = L.edge_split(g).cache()
    part = lambda s: learn.with_features(learn.labelled(split.where(F.col("split") == s), known=g), v).select("label", "features")
    model, _ = learn.fit_pair_model(part("train"), part("val"), 64, hidden=16, epochs=2)
    return learn.pair_graph(model, v, v, cand_m=20, topm=5)


# Sources and sinks: written to the shared folder, read back


def _folder(spark) -> str:
    return Scratch(spark).root


@query(f"WITH {_KEYED} SELECT id, seq FROM q")
def fasta_written_and_read(spark, d):
    path = f"{_folder(spark)}/fasta"
    K.write_fasta(_keyed(spark, d), path)
    return S.read_fasta(spark, path)


@query(f"WITH {_KEYED} SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS pos, length(seq)::DOUBLE AS value FROM q")
def lengths_written_and_read(spark, d):
    path = f"{_folder(spark)}/lengths"
    K.write_lengths(_keyed(spark, d), path)
    return S.read_numbers(spark, path)


@query(f"SELECT {_ID.format('ids')} AS id FROM emb WHERE {_ID.format('ids')} IS NOT NULL")
def ids_written_and_read(spark, d):
    path = f"{_folder(spark)}/ids"
    K.write_ids(_t(spark, d, "emb").select(C.normalize_id("ids").alias("id")).where("id is not null"), path)
    return S.read_ids(spark, path)


@query(f"SELECT DISTINCT {KEY.format('ids')} AS id FROM emb WHERE {KEY.format('ids')} IS NOT NULL")
def node_sets_read(spark, d):
    path = f"{_folder(spark)}/ids"
    K.write_ids(_t(spark, d, "emb").select(id_key("ids").alias("id")).where("id is not null"), path)
    return S.read_id_set(spark, path).intersect(S.read_nodes(spark, path))


@query(f"WITH {_CLEAN} SELECT u, v, round(w, 6) AS w FROM cl")
def edges_written_and_read(spark, d):
    path = f"{_folder(spark)}/edges"
    K.write_edges(_clean(spark, d), path)
    return _rounded(S.read_edges3(spark, path).select("u", "v", "w"))


@query(f"""WITH c AS (SELECT least(u, v) AS u, greatest(u, v) AS v, max(w) AS w FROM (SELECT {_U} AS u, {_V} AS v, combined_score / 1000.0::DOUBLE AS w FROM string_edges_head) WHERE u <> v AND w > 0 GROUP BY ALL),
t AS (SELECT least(u, v) AS u, greatest(u, v) AS v, max(w) AS w FROM (SELECT {_U} AS u, {_V} AS v, textmining / 1000.0::DOUBLE AS w FROM string_edges_head) WHERE u <> v AND w > 0 GROUP BY ALL)
SELECT 'combined' AS graph, count(*) AS edges, round(sum(w), 3) AS weight FROM c UNION ALL SELECT 'textmining', count(*), round(sum(w), 3) FROM t""")
def graph_folder_read(spark, d):
    folder = _folder(spark)
    for name, column in (("combined", "combined_score"), ("textmining", "textmining")):
        K.write_edges(E.filtered_graph(E.channel(_raw(spark, d), "node_a", "node_b", column)), f"{folder}/graphs/{name}.tsv")
    out = None
    for name, g in S.read_graph_folder(spark, f"{folder}/graphs/*.tsv").items():
        one = g.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("w"), 3).alias("weight")).select(F.lit(name).alias("graph"), "edges", "weight")
        out = one if out is None else out.unionByName(one)
    return out


_SPLIT = f"{_BASE}, e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM b), o AS (SELECT u, v, row_number() OVER (ORDER BY md5(u || ':' || v || ':0'), u, v) - 1 AS i, count(*) OVER () AS n FROM e), sp AS (SELECT u, v, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o)"


@query(f"WITH {_SPLIT} SELECT u, v, split FROM sp WHERE NOT starts_with(u, 'node')")
def split_written_and_read(spark, d):
    path = f"{_folder(spark)}/split"
    K.write_split(L.edge_split(_base(spark, d)), path)
    parts = [S.read_edges2(spark, f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_SPLIT} SELECT split, count(DISTINCT x) AS nodes FROM (SELECT split, u AS x FROM sp UNION ALL SELECT split, v FROM sp) GROUP BY split")
def node_split_written_and_read(spark, d):
    path = f"{_folder(spark)}/nodes"
    K.write_node_split(L.edge_split(_base(spark, d)), path)
    parts = [S.read_ids(spark, f"{path}/split={s}").agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(s).alias("split"), "nodes") for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH x AS (SELECT emb, list_filter(emb, lambda v: v IS NOT NULL AND isfinite(v)) AS v, ids, row_id FROM emb)
SELECT row_id::VARCHAR AS id, round(list_sum(list_transform(v, lambda y: y::DOUBLE)), 4) AS total FROM x WHERE len(emb) = 128 AND len(v) = 128 AND len(list_filter(v, lambda y: y <> 0)) > 0""")
def vectors_written_and_read(spark, d):
    path = f"{_folder(spark)}/vectors"
    K.write_vectors(V.usable_vectors(_t(spark, d, "emb"), "row_id", "emb", 128), path)
    total = F.aggregate("emb", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(path).select("id", F.round(total, 4).alias("total"))


@query("SELECT * FROM (VALUES ('alpha', '0.85'), ('folder', 'a b'), ('repeats', '20')) t(k, v)")
def meta_written_and_read(spark, d):
    path = f"{_folder(spark)}/meta"
    K.write_meta(spark, {"repeats": 20, "alpha": 0.85, "folder": "a b"}, path)
    return spark.read.option("sep", "\t").schema("k string, v string").csv(path)


@query("SELECT report_id, batch_name, connected_components.count AS components, cleaning.raw_rows AS raw_rows FROM graph_stats")
def json_written_and_read(spark, d):
    path = f"{_folder(spark)}/json"
    t = _t(spark, d, "graph_stats")
    K.write_json(t.select("report_id", "batch_name", "connected_components", "cleaning"), path)
    back = spark.read.schema(t.select("report_id", "batch_name", "connected_components", "cleaning").schema).json(path)
    return back.select("report_id", "batch_name", F.col("connected_components.count").alias("components"), F.col("cleaning.raw_rows").alias("raw_rows"))


@query("""SELECT row_id::VARCHAR AS row_id, fusion::VARCHAR AS fusion, CASE WHEN split = 'train' THEN '1' WHEN split IS NOT NULL THEN '0' END AS is_train, 'nan' AS rate, NULL::VARCHAR AS seq FROM string_edges_head
UNION ALL SELECT row_id::VARCHAR, NULL, NULL, NULL, nullif(string_id, '') FROM seqs_parser WHERE string_id NOT LIKE '%"%'""")
def ragged_rows_written_and_read(spark, d):
    path = f"{_folder(spark)}/rows"
    a = _raw(spark, d).select("row_id", "fusion", (F.col("split") == "train").alias("is_train"), F.lit(float("nan")).alias("rate"))
    b = _t(spark, d, "seqs_parser").select("row_id", F.col("string_id").alias("seq")).where(~F.contains("seq", F.lit('"')))
    K.write_rows(K.union_ragged(a, b), path)
    got = S.read_table(spark, path, ("row_id", "fusion", "is_train", "rate", "seq"), "\t")
    return got


@query(f"WITH {_ADJ}, r AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM deg) SELECT id FROM r WHERE rank <= 200")
def top_written_and_read(spark, d):
    path = f"{_folder(spark)}/top"
    s = G.degrees(_clean(spark, d)).select(F.lit(0).alias("run_id"), "id", F.col("degree").cast("double").alias("score"))
    K.write_top(R.rank_nodes(s), path, 200)
    return S.read_ids(spark, path)


@query(f"WITH h AS (SELECT {_ID.format('string_id')} AS id, preferred_name FROM string_info_head) SELECT count(*) AS raw_rows, count(*) FILTER (id IS NULL) AS rows_missing_protein, count(DISTINCT id) AS high_conf_hit_count, (SELECT count(DISTINCT trim(b, {_BL})) FROM (SELECT unnest(CASE WHEN contains(preferred_name, ';') THEN string_split(preferred_name, ';') WHEN contains(preferred_name, '|') THEN string_split(preferred_name, '|') ELSE string_split(preferred_name, ',') END) AS b FROM h WHERE id IS NOT NULL) WHERE trim(b, {_BL}) <> '') AS bait_count FROM h")
def hit_table_counts(spark, d):
    t = _t(spark, d, "string_info_head")
    hits, baits = S.hit_table(t, "string_id", bait="preferred_name")
    return S.hit_counts(t, "string_id", hits, baits)


@query(f"WITH {_KEYED} SELECT row_id AS pos, {KEY.format('string_id')} AS id, seq FROM string_info_head JOIN q ON {KEY.format('string_id')} = id")
def sequences_of_records(spark, d):
    ids = _t(spark, d, "string_info_head").select(F.col("row_id").alias("pos"), id_key("string_id").alias("id"))
    return S.sequences_of(ids, _keyed(spark, d))


@query(f"WITH {_KEYED} SELECT row_id AS pos, id, length(q.seq) AS n FROM seqs_parser p JOIN q ON {KEY.format('p.string_id')} = id")
def required_sequences(spark, d):
    s = _keyed(spark, d)
    ids = _t(spark, d, "seqs_parser").select(F.col("row_id").alias("pos"), id_key("string_id").alias("id"))
    known = ids.join(s.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_semi")
    return S.required(known, s).select("pos", "id", F.length("seq").alias("n"))


@query("WITH o AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM emb) SELECT row_id FROM o WHERE i // ceil(n / 7.0)::BIGINT = 3")
def shard_of_rows(spark, d):
    return S.shard(_t(spark, d, "emb").select("row_id"), 3, 7, "row_id")


@query("SELECT CASE source WHEN 'a' THEN 'A' ELSE source END AS label, count(*) AS n FROM (SELECT coalesce(CASE split WHEN 'train' THEN 'Train' WHEN 'val' THEN 'Validation' ELSE split END, '') AS source FROM string_edges_head) GROUP BY label")
def mapped_labels(spark, d):
    return _raw(spark, d).groupBy(F.coalesce(C.mapped("split", {"train": "Train", "val": "Validation"}), F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT coalesce(source, 'none') || '.tsv' AS graph, coalesce(source, 'none') AS label, round(avg(fusion), 4) AS auprc, round(avg(database), 4) AS p, round(avg(textmining), 4) AS r FROM string_edges_head GROUP BY source)
SELECT label, unnest(['auprc', 'precision@k', 'recall@k']) AS metric, unnest([auprc, p, r]) AS value FROM g""")
def summary_read(spark, d):
    path = f"{_folder(spark)}/summary"
    g = _raw(spark, d).groupBy(F.concat(F.coalesce("source", F.lit("none")), F.lit(".tsv")).alias("graph")).agg(*[F.round(F.avg(c), 4).alias(n) for c, n in (("fusion", "auprc"), ("database", "precision@k"), ("textmining", "recall@k"), ("coexpression", "enrich_factor@k"))])
    g.coalesce(1).write.option("header", True).option("sep", "\t").csv(path)
    return K.summary_bars(S.read_summary(spark, path, "auprc"))


@query(f"WITH {_ADJ}, h AS (SELECT id FROM {_KIND.format('Isomerase')}), b AS (SELECT id FROM {_KIND.format('Scaffold')}) SELECT r::INT AS run_id, count(*) AS nodes, count(*) FILTER (id IN (SELECT id FROM b)) AS baits FROM deg, range(3) t(r) GROUP BY r")
def split_table_counts(spark, d):
    nodes, baits = E.endpoints(_clean(spark, d)), _kind(spark, d, "Scaffold")
    t = P.split_table(nodes, L.holdout(_kind(spark, d, "Isomerase"), baits, 3), baits)
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_bait").alias("baits"))


@query(f"WITH {_BASE}, e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM b) SELECT count(*) AS pairs, count(*) AS distinct_pairs, 0::BIGINT AS loops, 0::BIGINT AS edges FROM e")
def negative_pairs_hold(spark, d):
    """As many negatives as edges, none twice, no loop and no edge."""
    e = E.undirected_distinct(_base(spark, d))
    n = L.negative_pairs(e, e.count())
    hit = n.join(e.select(F.col("u").alias("a"), F.col("v").alias("b")), (F.col("u") == F.col("a")) & (F.col("v") == F.col("b")), "left")
    return hit.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("u", "v").alias("distinct_pairs"), F.count_if(F.col("u") == F.col("v")).alias("loops"), F.count("a").alias("edges"))


@query(f"WITH {_SEEDS} SELECT DISTINCT run_id, true AS converged, 1.0::DOUBLE AS mass FROM seeds")
def ppr_converged(spark, d):
    """Until the residual is at most a millionth per node, from the uniform start."""
    edges = _graph(spark, d)
    got = pagerank(edges, _seeds(spark, d, edges), tol=1e-6, start="uniform", stop="n_tol", on_fail="raise")
    mass = got.scores.groupBy("run_id").agg(F.round(F.sum("score"), 6).alias("mass"))
    done = spark.createDataFrame([(r, x[2]) for r, x in got.runs.items()], "run_id string, converged boolean")
    return done.join(mass, "run_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all | problems.queries()


def oracle_sql() -> dict[str, str]:
    return _sql | problems.oracle_sql()
