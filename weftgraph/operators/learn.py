"""Supervised edge scores: pair features and a multilayer perceptron."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators.sampling import negative_pairs
from weftgraph.operators.vectors import best_edges, top_candidates


def with_features(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs(u, v, ...)`` with ``features``, those of both L2-normalized vectors; pairs without both vectors drop out."""
    unit = vectors.select("id", C.l2_normalize("emb").alias("x"))
    a, b = unit.select(F.col("id").alias("ia"), F.col("x").alias("xa")), unit.select(F.col("id").alias("ib"), F.col("x").alias("xb"))
    j = pairs.join(a, F.col("u") == F.col("ia")).join(b, F.col("v") == F.col("ib"))
    return j.withColumn("features", array_to_vector(C.pair_features("xa", "xb"))).drop("ia", "ib", "xa", "xb")


def labelled(edges: DataFrame, *, neg_ratio: float = 1.0, seed: int = 0, known: DataFrame | None = None) -> DataFrame:
    """(``u``, ``v``, ``label``): edges, and degree-proportional negatives, none of which is in ``edges`` or ``known``."""
    n = int(edges.count() * neg_ratio)
    neg = negative_pairs(edges, n, seed=seed, known=known)
    return edges.select("u", "v", F.lit(1.0).alias("label")).unionByName(neg.select("u", "v", F.lit(0.0).alias("label")))


def log_loss(model: MultilayerPerceptronClassificationModel, data: DataFrame) -> float:
    p = vector_to_array(F.col("probability"))
    p1 = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p[1]))
    return model.transform(data).agg(F.avg(-F.when(F.col("label") == 1, F.log(p1)).otherwise(F.log(1 - p1)))).first()[0]


def fit_pair_model(train: DataFrame, val: DataFrame, dim: int, *, hidden: int = 512, epochs: int = 5, seed: int = 0, steps: float = 0.03) -> tuple[MultilayerPerceptronClassificationModel, float]:
    """(model, validation loss): two hidden layers; of checkpoints after growing numbers of passes the best on ``val``. No dropout, which the library lacks."""
    train, val = train.cache(), val.cache()
    best, least, weights = None, float("inf"), None
    for e in range(epochs):
        mlp = MultilayerPerceptronClassifier(layers=[4 * dim, hidden, hidden, 2], maxIter=10, seed=seed, stepSize=steps)
        if weights is not None:
            mlp = mlp.setInitialWeights(weights)
        model = mlp.fit(train)
        weights = model.weights
        loss = log_loss(model, val)
        if loss < least:
            best, least = model, loss
    train.unpersist()
    val.unpersist()
    return best, least


def pair_graph(model: MultilayerPerceptronClassificationModel, anchors: DataFrame, vectors: DataFrame, *, cand_m: int = 500, topm: int = 20, score: str = "sigmoid") -> DataFrame:
    """(``u``, ``v``, ``w``): candidates by cosine, scored by the model (probability, or raw logit), the best kept, undirected."""
    cands = top_candidates(anchors, vectors, cand_m)
    out = model.transform(with_features(cands, vectors))
    raw = vector_to_array(F.col("rawPrediction"))
    w = vector_to_array(F.col("probability"))[1] if score == "sigmoid" else raw[1] - raw[0]
    return best_edges(out.select("u", "v", w.alias("w")), topm, positive=False)
