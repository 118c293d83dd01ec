"""Hand-derived fixtures of the core operators."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.functions.keys import id_key
from weftgraph.operators import edges as E
from weftgraph.operators import graph as G
from weftgraph.operators import learn
from weftgraph.operators import ranking as R
from weftgraph.operators import sampling as L
from weftgraph.operators import scorers as M
from weftgraph.operators import vectors as V
from weftgraph.operators import walks as W
from weftgraph.operators.ppr import pagerank, uniform_seeds
from weftgraph.operators.references import orphan_references
from weftgraph.plans import protocol as P
from weftgraph.session import Scratch
from weftgraph.sources import files, sinks
from weftgraph.sources.lines import parse_lines

RAW = [("A", "B", "900"), ("B", "A", "800"), ("A", "C", "300"), ("C", "C", "500"), ("B", "C", ""), ("C", "D", "abc"), ("", "D", "400"), ("C", "D", "150")]


@pytest.fixture(scope="module")
def clean(spark):
    return E.clean_edges(spark.createDataFrame(RAW, "a string, b string, s string"), "a", "b", "s").cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def near(got, want, tol=1e-6):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:-1] == w[:-1] and abs(g[-1] - w[-1]) < tol, (g, w)


def test_cleaning_counts_and_edges(spark, clean):
    c = E.clean_counts(spark.createDataFrame(RAW, "a string, b string, s string"), "a", "b", "s").first()
    assert tuple(c) == (8, 1, 1, 1, 1, 1, 3)
    near(rows(clean, "u", "v", "w"), [("A", "B", 0.9), ("A", "C", 0.3), ("C", "D", 0.15)])


def test_empty_edges(spark):
    df = spark.createDataFrame([], "a string, b string, s string")
    assert E.clean_edges(df, "a", "b", "s").count() == 0
    assert tuple(E.clean_counts(df, "a", "b", "s").first()) == (0,) * 7
    with pytest.raises(ValueError):
        E.require_edges(df)


def test_degrees_components_stats(spark, clean):
    near(rows(G.degrees(clean), "id", "degree", "weighted_degree"), [("A", 2, 1.2), ("B", 1, 0.9), ("C", 2, 0.45), ("D", 1, 0.15)])
    more = clean.unionByName(spark.createDataFrame([("x", "y", 0.5)], "u string, v string, w double"))
    assert rows(G.components(more), "id", "component") == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "A"), ("x", "x"), ("y", "x")]
    s = G.graph_stats(more).first()
    assert (s.num_nodes, s.num_edges, s.connected_components["count"], s.connected_components["sizes_top_10"]) == (6, 4, 2, [4, 2])


def test_long_path_is_one_component(spark):
    path = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}", 1.0) for i in range(300)], "u string, v string, w double")
    assert G.components(path).select("component").distinct().collect()[0][0] == "0000"


def test_pagerank_reaches_the_linear_solution(spark, clean):
    seeds = uniform_seeds(spark.createDataFrame([("r", "A")], "run_id string, id string"))
    got = pagerank(clean, seeds)
    near(rows(got.scores, "id", "score"), [("A", 0.50082119), ("B", 0.31927351), ("C", 0.14018595), ("D", 0.03971935)], 1e-8)
    assert got.runs["r"][0] == 146 and got.runs["r"][2]
    ranked = R.rank_nodes(got.scores.withColumn("p", F.col("id") == "C"), exclude=seeds, hit=F.col("p"))
    assert rows(ranked, "rank", "id") == [(1, "B"), (2, "C"), (3, "D")]
    m = R.ranking_metrics(ranked, [1, 2]).first()
    assert (m.auprc, m.recall_at_1, m.precision_at_2, m.enrichment_at_2) == (0.5, 0.0, 0.5, 1.5)


def test_pagerank_dangling_and_missing_seeds(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 0.0)], "u string, v string, w double")
    s = pagerank(e, uniform_seeds(spark.createDataFrame([("r", "c"), ("r", "a")], "run_id string, id string")), tol=None, max_iter=7).scores
    assert abs(s.agg(F.sum("score")).first()[0] - 1) < 1e-12
    with pytest.raises(ValueError):
        pagerank(e, uniform_seeds(spark.createDataFrame([("r", "zz")], "run_id string, id string")))


def test_fusion(spark):
    base = spark.createDataFrame([("A", "B", 900.0), ("B", "A", 700.0), ("A", "C", 300.0), ("C", "D", 150.0)], "u string, v string, w double")
    f = spark.createDataFrame([("A", "B", 0.8, 1), ("B", "D", 0.5, 2), ("A", "B", 0.6, 3)], "u string, v string, w double, pos int")
    near(rows(E.reweight(base, f), "u", "v", "w"), [("A", "B", 1.82212), ("A", "C", 0.2), ("B", "A", 1.33622), ("C", "D", 0.0)], 1e-5)
    near(rows(E.reweight(base, f, kind="linear"), "u", "v", "w"), [("A", "B", 1.6), ("A", "C", 0.2), ("B", "A", 1.173333), ("C", "D", 0.0)], 1e-5)
    near(rows(E.gated_mix(base, f, lam=0.7), "u", "v", "w"), [("A", "B", 2.63084), ("A", "C", 0.14), ("B", "D", 0.15)], 1e-5)


def test_nan_is_rejected_in_either_order(spark):
    for r in ([float("nan"), 0.5], [0.5, float("nan")]):
        df = spark.createDataFrame([("A", "B", x) for x in r], "u string, v string, w double")
        assert rows(E.merge_max(df), "u", "v", "w") == [("A", "B", 0.5)]


def test_average_precision_and_curve(spark):
    s = spark.createDataFrame([("r", f"n{i}", 1.0 - i / 10, i in (0, 2)) for i in range(5)], "run_id string, id string, score double, p boolean")
    ranked = R.rank_nodes(s, hit=F.col("p"))
    m = R.ranking_metrics(ranked, [10]).first()
    assert abs(m.auprc - 5 / 6) < 1e-12 and (m.precision_at_10, m.recall_at_10, m.enrichment_at_10) == (0.4, 1.0, 1.0)
    assert abs(R.top_metrics(ranked, 10).first().auprc - 5 / 6) < 1e-12
    near(rows(R.pr_curve(ranked), "rank", "recall", "precision"), [(0, 0.0, 1.0), (1, 0.5, 1.0), (3, 1.0, 2 / 3)])
    none = R.rank_nodes(s.withColumn("p", F.lit(False)), hit=F.col("p"))
    assert math.isnan(R.ranking_metrics(none, [1]).first().auprc) and R.top_metrics(none, 1).first().enrichment_at_k is None


def test_anchor_normalizations(spark):
    c = spark.createDataFrame([("u", "a", 0.9), ("u", "b", 0.6), ("u", "c", 0.3), ("w", "a", 0.4), ("w", "b", 0.4)], "u string, v string, c double")
    near(rows(V.anchor_minmax(c), "u", "v", "w"), [("u", "a", 1.0), ("u", "b", 0.5), ("u", "c", 0.0), ("w", "a", 0.0), ("w", "b", 0.0)])
    near(rows(V.anchor_sigmoid_z(c), "u", "v", "w"), [("u", "a", 0.772897), ("u", "b", 0.5), ("u", "c", 0.227103), ("w", "a", 0.5), ("w", "b", 0.5)])
    near(rows(V.softmax_weight(c.where("u = 'u'")), "u", "v", "w"), [("u", "a", 0.950330), ("u", "b", 0.047314), ("u", "c", 0.002356)])


@pytest.mark.parametrize("n,win,stride,starts", [(5, 10, 4, [0]), (10, 10, 4, [0]), (11, 10, 4, [0, 4]), (18, 10, 4, [0, 4, 8]), (2000, 1022, 768, [0, 768, 1536])])
def test_windows(spark, n, win, stride, starts):
    assert spark.range(1).select(C.window_starts(F.lit(n), win, stride)).first()[0] == starts


@pytest.mark.parametrize("n,f,train", [(0, 0.7, 0), (1, 0.7, 1), (2, 0.7, 1), (5, 0.5, 2), (3, 1.0, 2), (3, 0.0, 1)])
def test_holdout_sizes(spark, n, f, train):
    ids = spark.createDataFrame([(f"h{i}",) for i in range(n)], "id string")
    got = L.holdout(ids, ids.limit(0), 2, fraction=f)
    assert got.where("is_seed and run_id = 1").count() == train and got.where("run_id = 0").count() == n


def test_multi_values_and_truth(spark):
    v = spark.createDataFrame([("a;b|c",), ("a|b,c",), (" ; x ;",), ("",), (None,)], "s string").select(C.split_multi("s")).collect()
    assert [r[0] for r in v] == [["a", "b|c"], ["a", "b,c"], ["x"], [], []]
    t = spark.createDataFrame([(x,) for x in ("Yes", "HC", "2", "-1", "nan", "no", "0", "0.0", " ", None)], "s string").select(C.is_truthy("s")).collect()
    assert [r[0] for r in t] == [True] * 5 + [False] * 5


def test_significant_digits(spark):
    xs = [0.5, 1.0, 0.0, 123456789.0, 0.00001234567, -2.5, 0.1234567, 1e-4, 999999.5, float("nan"), 100000.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.significant("x")).collect()]
    assert got == ["%.6g" % x for x in xs]


def test_splits_cover_and_dont_overlap(spark):
    e = spark.createDataFrame([(f"a{i % 7}", f"b{i}", 1.0) for i in range(40)], "u string, v string, w double")
    s = L.edge_split(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    assert rows(s.groupBy("split").count(), "split", "count") == [("test", 4), ("train", 32), ("val", 4)]
    n = L.negative_pairs(e, 30)
    assert n.join(e, ["u", "v"]).count() == 0 and n.distinct().count() == n.count() and n.where("u = v").count() == 0


def test_negative_pairs_of_a_hub_are_as_many_as_asked(spark):
    hub = spark.createDataFrame([("hub", f"n{i:02d}") for i in range(30)], "u string, v string")
    known = spark.createDataFrame([(f"n{i:02d}", "n00") for i in range(1, 30)], "u string, v string")
    n = L.negative_pairs(hub, 30, known=known)
    assert n.count() == 30 == n.distinct().count() and n.where("u = 'hub' or v = 'hub' or u = 'n00' or v = 'n00' or u >= v").count() == 0
    dense = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(6) for j in range(i + 1, 6) if (i, j) != (2, 4)], "u string, v string")
    assert rows(L.negative_pairs(dense, 3), "u", "v") == [("n2", "n4")]
    assert learn.labelled(hub, known=known).where("label = 0").count() == 30
    assert L.negative_pairs(hub.limit(0), 3).count() == 0 == L.negative_pairs(hub, 0).count()


def test_holdout_workflow(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + j) % 30}", 0.2 + (i % 5) / 10) for i in range(30) for j in (1, 3)], "u string, v string, w double").where("u <> v")
    e = E.undirected_max(e)
    hits = spark.createDataFrame([(f"n{i}",) for i in range(6)], "id string")
    out = P.run_holdout(e, hits, hits.limit(0), repeats=2, random_repeats=2, matched_repeats=2, tol=None, max_iter=4, ks=[5], pool=5)
    assert sorted(r.method for r in out["rows"].collect()) == sorted(["ppr", "degree", "random", "degree_matched"] * 2)
    assert out["scores"].where("is_seed = 1 and rank is not null").count() == 0
    assert out["summary"].count() == 4
    with pytest.raises(ValueError):
        P.run_holdout(e, hits.limit(0), hits.limit(0))


@pytest.mark.parametrize("bounds", [(1 << 19, 200_000, 8), (60, 8, 6)])
@pytest.mark.parametrize("tol,force", [(None, False), (1e-9, True)])
def test_holdout_over_blocks(spark, monkeypatch, bounds, tol, force):
    """PageRank moved a row for each edge and run in every iteration, and all nodes of all runs were sorted for the ranks of a few."""
    for name, value in zip(("BLOCK_EDGES", "HOT_EDGES", "LANES"), bounds):
        monkeypatch.setattr(W, name, value)
    e = [(f"n{i:02d}", f"n{(i * 7 + j) % 40:02d}", 0.2 + (i % 5) / 10) for i in range(40) for j in (1, 3)] + [("hub", f"n{i:02d}", 0.3) for i in range(0, 40, 2)] + [("hub", "idle", 0.0), ("x", "y", 1.0)]
    e = E.undirected_max(spark.createDataFrame(e, "u string, v string, w double").where("u <> v"))
    hits, baits = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in ([f"n{i:02d}" for i in range(9)] + ["x", "none"], ["n03", "hub", "idle"]))
    args = dict(alpha=0.85, tol=tol, max_iter=5)
    out = P.run_holdout(e, hits, baits, repeats=2, force=force, random_repeats=0, matched_repeats=2, ks=[5], pool=5, **args)
    assert sorted(r.method for r in out["rows"].collect()) == sorted(["ppr", "degree", "degree_matched"] * 2)
    split = out["split"].cache()
    seeds = split.where("is_seed").select("run_id", "id")
    want = pagerank(e, uniform_seeds(seeds), **args).scores.cache()
    near(rows(out["scores"], "run_id", "id", "score"), rows(want, "run_id", "id", "score"), 1e-12)
    deg = G.degrees(e).select("id", F.col("weighted_degree").alias("score")).join(seeds.select("run_id").distinct()).select("run_id", "id", "score")
    for method, scores in (("ppr", want), ("degree", deg)):
        for got, expect in zip(out["rows"].where(F.col("method") == method).orderBy("run_id").collect(), P.evaluate(scores.select("run_id", "id", "score"), split, [5]).orderBy("run_id").collect()):
            assert (got.num_candidates, got.num_positives) == (expect.num_candidates, expect.num_positives)
            assert abs(got.auprc - expect.auprc) < 1e-9 and abs(got.recall_at_5 - expect.recall_at_5) < 1e-9


def test_files_round_trip(spark, tmp_path):
    d = str(tmp_path)
    seqs = spark.createDataFrame([("p1", "A" * 130), ("p2", "MKV")], "id string, seq string")
    sinks.write_fasta(seqs, d + "/fa")
    assert rows(files.read_fasta(spark, d + "/fa"), "id", "seq") == rows(seqs, "id", "seq")
    sinks.write_edges(spark.createDataFrame([("a", "b", 0.123456789), ("c", "c", 1.0)], "u string, v string, w double"), d + "/e")
    assert rows(files.read_edges3(spark, d + "/e"), "u", "v", "w") == [("a", "b", 0.123457)]
    (tmp_path / "t.tsv").write_text("﻿id\tx\np\t1\n")
    assert files.read_table(spark, d + "/t.tsv", ("id",)).columns == ["id", "x"]
    with pytest.raises(ValueError):
        files.read_table(spark, d + "/t.tsv", ("zz",))
    sinks.write_rows(spark.createDataFrame([(1, float("nan"), True, None)], "a int, b double, c boolean, d string"), d + "/r")
    assert files.read_table(spark, d + "/r", sep="\t").first()["b"] == "nan"


def test_text_before_the_first_record_is_no_record(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\nMORE\n>p1 x\nAC\nGT\n>p2\n>p3\nM K\n")
    (tmp_path / "b.fa").write_text(">p1\nTT\n")
    assert rows(files.read_fasta(spark, str(tmp_path)), "id", "seq") == [("p1", "TT"), ("p3", "MK")]
    assert ("p2", "") in rows(files.read_fasta(spark, str(tmp_path), keep_empty=True), "id", "seq")


def test_more_files(spark, tmp_path):
    import numpy as np

    d = str(tmp_path)
    (tmp_path / "e.tsv").write_text("node_a\tnode_b\nNODE1\tx\na\tb\textra\nc\tc\n\nshort\n")
    assert rows(files.read_edges2(spark, d + "/e.tsv"), "u", "v") == [("NODE1", "x"), ("a", "b")]
    (tmp_path / "n.txt").write_text(" 3\n4.5\n")
    assert rows(files.read_numbers(spark, d + "/n.txt"), "pos", "value") == [(0, 3.0), (1, 4.5)]
    (tmp_path / "bad.txt").write_text("3\nx\n")
    with pytest.raises(Exception, match="not a number"):
        files.read_numbers(spark, d + "/bad.txt").collect()
    np.savez(d + "/v.npz", ids=np.array(["a", "b"]), emb=np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert rows(files.read_npz(spark, d + "/v.npz"), "id", "emb") == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    assert files.read_id_set(spark, "") is None
    with pytest.raises(Exception):
        files.read_graph_folder(spark, d + "/none*.tsv")
    (tmp_path / "s.tsv").write_text("graph\tauprc\trecall@k\tprecision@k\tenrich_factor@k\ng.tsv\t0.1\t1\t1\t1\nh.tsv\t0.3\t1\t1\t1\n")
    got = files.read_summary(spark, d + "/s.tsv", "auprc", {"g": "G"}).collect()
    assert [r.label for r in got] == ["h", "G"]
    with pytest.raises(ValueError):
        files.read_summary(spark, d + "/e.tsv", "auprc")
    assert sinks.plot(sinks.summary_bars(files.read_summary(spark, d + "/s.tsv", "auprc"), top=1), d + "/p.png", "metric", "value", kind="bar").startswith(("ok", "skipped"))
    sinks.write_meta(spark, {"b": 1, "a": None}, d + "/m")
    assert [r[0] for r in spark.read.text(d + "/m").collect()] == ["a\tNone", "b\t1"]
    sinks.write_json_value(spark, {"b": [1], "a": 2}, d + "/j")
    assert spark.read.text(d + "/j").first()[0] == '{"a": 2, "b": [1]}'


def test_lookups_and_shards(spark):
    ids = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "zz")], "pos long, id string")
    seqs = spark.createDataFrame([("a", "AA"), ("b", "BB"), ("c", "")], "id string, seq string")
    assert rows(files.sequences_of(ids, seqs), "pos", "id", "seq") == [(0, "b", "BB"), (1, "a", "AA"), (2, "b", "BB")]
    assert files.required(ids.where("pos < 3"), seqs).count() == 3
    with pytest.raises(Exception, match="no sequence: zz"):
        files.required(ids, seqs).collect()
    parts = [rows(files.shard(ids, i, 3, "pos"), "pos") for i in range(3)]
    assert parts == [[(0,), (1,)], [(2,), (3,)], []]
    with pytest.raises(ValueError):
        files.shard(ids, 3, 3, "pos")
    assert C.k_list(" 50, 10,,10") == [10, 50]
    for bad in ("", "0", "5,-1"):
        with pytest.raises(ValueError):
            C.k_list(bad)


def test_baits_of_rows_without_an_id_dont_count(spark):
    t = spark.createDataFrame([("p1", "x;y"), (" ", "z"), (None, "w"), ("p1", "x")], "id string, b string")
    hits, baits = files.hit_table(t, "id", bait="b")
    assert rows(hits, "id") == [("p1",)] and rows(baits, "id") == [("x",), ("y",)]
    assert tuple(files.hit_counts(t, "id", hits, baits).first()) == (4, 2, 1, 2)


def test_numbers_over_range_partitions(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, 101).astype(float)
    df = spark.createDataFrame([(f"g{i % 2}", float(v), i) for i, v in enumerate(x)] + [("g0", float("nan"), 101), ("g1", None, 102)], "g string, x double, i int")
    got = {r.q: r.value for r in R.exact_quantiles(df, "x", [0.0, 0.13, 0.5, 1.0]).collect()}
    assert all(abs(got[q] - np.quantile(x, q)) < 1e-12 for q in got)
    assert [r.value for r in R.exact_quantiles(df.limit(0), "x", [0.5]).collect()] == [None]
    placed = R.number_within(df.where("i < 101"), "g", "x", "i").collect()
    for g in ("g0", "g1"):
        mine = sorted((r.at, r.x, r.i) for r in placed if r.g == g)
        assert [a for a, *_ in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine) and {r.n for r in placed if r.g == g} == {len(mine)}
    y = x[::-1].copy()
    both = spark.createDataFrame([(float(a), float(b), i) for i, (a, b) in enumerate(zip(x, y))], "a double, b double, i int")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert abs(V.rank_correlation(both, "a", "b", "i", average=True).first().rho - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9


def test_pools_by_degree_against_all_nodes(spark):
    import random

    rng = random.Random(3)
    seeds = [(f"s{i}", float(rng.randrange(8))) for i in range(9)]
    nodes = [(f"n{i:02d}", float(rng.randrange(8))) for i in range(40)]
    df = lambda x: spark.createDataFrame(x, "id string, d double")
    got = rows(L.matched_pool(df(seeds), df(nodes), 5), "seed_id", "place", "id")
    order = {n: i for i, n in enumerate(sorted(nodes, key=lambda x: (x[1], x[0])))}
    want = []
    for s, t in seeds:
        best = sorted(nodes, key=lambda n: (abs(n[1] - t), 0 if n[1] < t else 1, -order[n] if n[1] < t else order[n]))[:5]
        want += [(s, i, n[0]) for i, n in enumerate(best, 1)]
    assert got == sorted(want)


def test_pools_that_run_out_are_drawn_again(spark):
    seeds = spark.createDataFrame([(0, f"s{i}") for i in range(12)], "run_id int, id string")
    target = spark.createDataFrame([(f"s{i}", 1.0) for i in range(12)], "id string, d double")
    nodes = spark.createDataFrame([(f"n{i:02d}", float(i)) for i in range(20)], "id string, d double")
    got = P.matched_seeds(seeds, target, nodes, 3, 3, 5)
    assert rows(got.groupBy("run_id").agg(F.count_distinct("id").alias("n")), "run_id", "n") == [("0:0", 12), ("0:1", 12), ("0:2", 12)]
    assert P.matched_seeds(seeds, target, nodes.limit(5), 1, 3, 5).count() == 0  # fewer nodes than seeds


@pytest.mark.parametrize("width", [1 << 17, 64, 8])
def test_seeds_of_one_degree_are_drawn_without_a_round_for_each(spark, monkeypatch, width):
    """a pool that ran out began a round over all nodes, one for nearly every seed of a common degree."""
    monkeypatch.setattr(P, "RANGE_NODES", width)
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: (written.append(1), write(self, df))[1])
    target = [(f"s{i:02d}", 5.0) for i in range(30)] + [(f"t{i}", 1.5 + 3 * i) for i in range(6)] + [("u", -2.0)]
    nodes = [(f"n{i:03d}", float(i // 20) if i < 200 else i / 10) for i in range(300)]
    runs = {0: [s for s, _ in target], 1: [s for s, _ in target if s < "s12" or s > "t3"]}
    df = lambda x, schema: spark.createDataFrame(x, schema)
    got = P.matched_seeds(df([(r, s) for r, ids in runs.items() for s in ids], "run_id int, id string"), df(target, "id string, d double"), df(nodes, "id string, d double"), 2, 4, 5)
    want, order = [], {n: i for i, n in enumerate(sorted(nodes, key=lambda x: (x[1], x[0])))}
    for r, ids in runs.items():
        for rep in range(2):
            used = set()
            for s in sorted(ids):
                t = dict(target)[s]
                near = sorted((n for n in nodes if n[0] not in used), key=lambda n: (abs(n[1] - t), 0 if n[1] < t else 1, -order[n] if n[1] < t else order[n]))[:4]
                used |= set(L.draw_matched([(s, [n[0] for n in near])], 5 + rep))
            want += [(f"{r}:{rep}", x) for x in used]
    assert rows(got, "run_id", "id") == sorted(want)
    assert len(written) <= 8


def test_hubs_go_by_broadcast(spark, monkeypatch):
    hub = spark.createDataFrame([("hub" if i % 2 else f"a{i}", f"n{i:03d}", 1.0) for i in range(200)] + [("a0", "z", 1.0), ("z", "a2", 1.0)], "u string, v string, w double")
    want = rows(G.components(hub), "id", "component")
    monkeypatch.setattr(G, "hot_keys", lambda c, k, n, total: [r[0] for r in c.where(F.col(n) > 20).select(k).collect()])
    assert rows(G.components(hub), "id", "component") == want
    assert len({c for _, c in want}) == 1 + 100 - 1


def test_best_lists_run_over_batches(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(90, 4)), 1)
    v[30:60] = v[30]
    df = spark.createDataFrame([(f"v{i:02d}", x.tolist()) for i, x in enumerate(v)], "id string, emb array<double>")
    df = V.usable_vectors(df, "id", "emb", 4).repartition(3)
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    s = np.round(u @ u.T, 12)
    want = sorted((f"v{i:02d}", f"v{j:02d}") for i in range(90) for j in sorted((j for j in range(90) if j != i), key=lambda j: (-s[i, j], j))[:7])
    assert rows(V.top_candidates(df, df, 7, block_bytes=1000), "u", "v") == want
    assert V.top_candidates(df.limit(0), df, 7).count() == 0


def test_best_lists_are_made_in_little_memory(spark):
    """anchors met a chunk of vectors in one product, and 16,000 of them took 2 GB in each task."""
    import threading
    from pathlib import Path

    import numpy as np

    v = np.random.default_rng(3).normal(size=(16_000, 8))
    df = spark.createDataFrame([(f"v{i:05d}", x.tolist()) for i, x in enumerate(v)], "id string, emb array<double>")
    most, over = [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            for p in Path("/proc").glob("[0-9]*/status"):
                try:
                    text = p.read_text()
                    if "pyspark.daemon" in (p.parent / "cmdline").read_text().replace("\0", " "):
                        most.append(int(text.split("VmRSS:")[1].split()[0]) >> 10)
                except (OSError, IndexError):
                    pass

    thread = threading.Thread(target=watch)
    thread.start()
    got = {r.u: r.v for r in V.top_candidates(df, df, 20).groupBy("u").agg(F.max_by("v", "c").alias("v"), F.count("v").alias("n")).where("n = 20").collect()}
    over.set()
    thread.join()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 16_000, 500):
        s = u @ u[i]
        s[i] = -1
        assert got[f"v{i:05d}"] == f"v{s.argmax():05d}"
    assert len(got) == 16_000 and 0 < max(most) < 900


@pytest.mark.parametrize("bounds", [(8 << 20, 64 << 20, 1 << 20), (40, 200, 300)])
def test_pairs_are_scored_without_moving_their_sets(spark, monkeypatch, bounds):
    """each pair took both lists of k-mers through two shuffles."""
    import random

    r = random.Random(1)
    seqs = {f"s{i:02d}": "".join(r.choice("ABÄ\U0001d11ex") for _ in range(r.choice((0, 1, 2, 3, 5, 30, 90)))) for i in range(40)}
    df = spark.createDataFrame([*seqs.items(), ("null", None)], "id string, seq string")
    pairs = [(f"s{i:02d}", f"s{j:02d}") for i in range(42) for j in range(41) if i != j and r.random() < 0.6] + [("s01", "null"), ("s02", "s03"), ("s02", "s03")]
    mers = {k: {x[i : i + 3] for i in range(len(x) - 2)} for k, x in seqs.items()}
    want = sorted((u, v, len(mers[u] & mers[v]) / max(1, len(mers[u] | mers[v]))) for u, v in pairs if u in mers and v in mers)
    for name, value in zip(("CODES", "BITS", "PAIRS"), bounds):
        monkeypatch.setattr(M, name, value)
    got = M.score_pairs(spark.createDataFrame(pairs, "u string, v string").repartition(2), df)
    near(rows(got, "u", "v", "c"), want, 1e-12)
    assert "Exchange" not in M.score_pairs(spark.range(0).selectExpr("'a' u", "'b' v"), df)._jdf.queryExecution().executedPlan().toString()


def test_weights_of_unlike_vectors_tie(spark):
    """Below 0 all weights are 0, and the smaller ids come first; an anchor with few similarities above 0 needs its other candidates."""
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.1]), ("c", [0.0, 1.0]), ("d", [1.0, 1.0]), ("e", [-1.0, -1.0]), ("f", [1e-13, -1.0])], "id string, emb array<double>")
    for topm in (1, 2, 3, 5):
        want = V.best_edges(V.positive_cosine(V.top_candidates(df, df, 5)), topm)
        assert rows(V.knn_graph(df, df, cand_m=5, topm=topm), "u", "v", "w") == rows(want, "u", "v", "w")


def test_graphs_side_by_side(spark):
    g = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 0.5), ("d", "e", 0.2)], "u string, v string, w double")
    seeds, pos = spark.createDataFrame([("a", 1)], "id string, weight int"), spark.createDataFrame([("c", 1.0), ("e", 1.0), ("b", 0.0)], "id string, value double")
    both = {r.graph: r for r in P.evaluate_graphs({"one": g, "two": g.where("u <> 'd'")}, seeds, pos, k=2, tol=None, max_iter=5).collect()}
    for name, edges in (("one", g), ("two", g.where("u <> 'd'"))):
        alone = P.evaluate_graphs({name: edges}, seeds, pos, k=2, tol=None, max_iter=5).first()
        assert {k: v for k, v in alone.asDict().items() if k != "auprc"} == {k: v for k, v in both[name].asDict().items() if k != "auprc"} and abs(alone.auprc - both[name].auprc) < 1e-12
    assert both["one"].n_nodes == 5 and both["two"].n_nodes == 4


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from weftgraph import session

    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="far", master="spark://x:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        session.scratch_root(far)


def test_models_are_written(spark, tmp_path):
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel

    df = spark.createDataFrame([(f"v{i}", [float(i % 2), 1.0]) for i in range(8)], "id string, emb array<double>")
    pairs = spark.createDataFrame([(f"v{i}", f"v{j}", float((i + j) % 2 == 0)) for i in range(8) for j in range(i)], "u string, v string, label double")
    data = learn.with_features(pairs, df).select("label", "features")
    model, loss = learn.fit_pair_model(data, data, 2, hidden=4, epochs=1)
    sinks.write_model(model, str(tmp_path / "m"))
    assert MultilayerPerceptronClassificationModel.load(str(tmp_path / "m")).weights == model.weights and loss > 0


def test_streaming_merge(spark, tmp_path):
    from weftgraph.streaming.merge import merge_into

    src, out = str(tmp_path / "s"), {}
    for part in ([("a", "b", 0.1), ("b", "a", 0.7)], [("a", "b", 0.3), ("x", "x", 1.0), ("c", "a", float("nan"))]):
        spark.createDataFrame(part, "u string, v string, w double").write.mode("append").parquet(src)
    stream = spark.readStream.schema("u string, v string, w double").parquet(src)

    def write(df):
        out["rows"] = [tuple(r) for r in df.collect()]

    read = lambda: spark.createDataFrame(out["rows"], "u string, v string, w double") if out.get("rows") else None
    merge_into(stream, read, write, str(tmp_path / "c")).awaitTermination()
    assert out["rows"] == [("a", "b", 0.7)]


LINES = {
    1: 'a\tb\t1' + "\t0" * 7,
    2: '"a\tx"\t"b""c"\t" 007 "' + "\t" * 7,
    3: '"a\tb\t1' + "\t0" * 7,
    4: 'a"\tb\t1' + "\t0" * 7,
    5: '"a"x\tb\t1' + "\t0" * 7,
    6: "a\tb\t1",
    7: "",
    8: None,
    9: "\xa0\tb\tx" + "\t0" * 7,
    10: 'a\t""\t1' + "\t0" * 7,
    11: "a\tb\t " + "\t0" * 7,
    12: "a\tb\t1001" + "\t0" * 7,
    13: "a\tb\t+5" + "\t0" * 7,
    14: "a\tb\t00001000" + "\t0" * 6 + "\t1 \r",
    15: "a\tb\t1" + "\t0" * 6 + "\t1.5",
    16: "a\tb\t٣" + "\t0" * 7,
    17: 'a\\t\\b\t"\\t\t"\t1' + "\t0" * 7,
    18: "a\tb\t1" + "\t0" * 7 + "\t",
    19: '"' + 'x""' * 50_000 + '"\tb\t1' + "\t0" * 7,
}
BAD = {3: "broken_quote", 4: "broken_quote", 5: "broken_quote", 6: "column_count", 7: "column_count", 8: "column_count", 9: "missing_id", 10: "missing_id", 11: "missing_score", 12: "invalid_score", 13: "invalid_score", 15: "invalid_channel", 16: "invalid_score", 18: "column_count"}


@pytest.mark.parametrize("bound", [8 << 20, 0])
def test_lines(spark, bound):
    df = spark.createDataFrame(list(LINES.items()), "line_id long, line string").withColumn("cells", F.lit(1)).withColumn("rank", F.lit(2))
    bad, good = parse_lines(df, "line_id", "line", broadcast_bytes=bound)
    assert {r.line_id: r.reason for r in bad.collect()} == BAD
    got = {r.line_id: r for r in good.collect()}
    assert set(got) == set(LINES) - set(BAD)
    assert (got[2].node_a, got[2].node_b, got[2].combined_score, got[2].textmining) == ("a\tx", 'b"c', 7, None)
    assert (got[14].combined_score, got[14].textmining) == (1000, 1)
    assert (got[17].node_a, got[17].node_b) == ("a\\t\\b", "\\t\t")
    empty = parse_lines(df.limit(0), "line_id", "line")
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_references(spark):
    t = lambda n: datetime(2024, 1, n)
    parents = spark.createDataFrame(
        [("A-1", t(2), None), ("b 2", t(2), t(5)), ("B2", t(8), t(9)), ("c3", t(1), t(3)), ("C3", t(1), t(7)), ("", t(1), None), (None, t(1), None), ("D4", None, None)],
        "string_id string, begin timestamp, finish timestamp",
    )
    refs = spark.createDataFrame(
        [(1, "a1", t(3)), (2, "a1", t(1)), (3, "B-2", t(3)), (4, "b2", t(6)), (5, "b2", t(8)), (6, "b2", t(9)), (7, "zz", t(3)), (8, "c3", t(4)), (9, "c3", t(7)), (10, "--", t(3)), (11, None, t(3)), (12, "a1", None), (13, "d4", t(3)), (7, "zz", t(3))],
        "row_id long, ref string, at timestamp",
    ).withColumn("h", F.lit(0)).withColumn("k", F.lit("x"))
    use = lambda r: [("t", "ref", r, id_key("ref"), "row_id", "at")]
    want = sorted([(2, "late"), (4, "deleted"), (6, "deleted"), (7, "missing"), (7, "missing"), (9, "deleted"), (13, "late")])
    for per in (250_000, 2):  # 2: hot keys are split
        assert rows(orphan_references(use(refs), parents, id_key("string_id"), "begin", "finish", rows_per_range=per), "row_id", "reason") == want
    assert orphan_references(use(refs.limit(0)), parents, id_key("string_id"), "begin", "finish").count() == 0
    assert orphan_references(use(refs), parents.limit(0), id_key("string_id"), "begin", "finish").count() == 12


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert entry.entry(spark).count() == 40
