"""Scores of sequence pairs: an interface for models, and deterministic stand-ins.

A model (an encoder, a masked or an attention model) is a Python callable that scores a batch of texts or pairs; it runs
in Arrow batches, loaded once per worker. No model is shipped. The stand-ins are statistics of k-mers;
they have the shape of the model scores and none of their meaning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from weftgraph.functions import columns as C
from weftgraph.functions.keys import once
from weftgraph.operators.edges import merge_max
from weftgraph.operators.vectors import anchor_minmax, anchor_sigmoid_z, best_edges, chunks, top_candidates
from weftgraph.session import Scratch

DIMENSIONS = 32


def kmer_counts(windows: DataFrame, k: int = 3, size: int = DIMENSIONS) -> DataFrame:
    """Stand-in encoder: (``id``, ``n``, ``v``), counts of the k-mers of each window by hash bucket."""
    bucket = F.conv(F.substring(F.md5("kmer"), 1, 6), 16, 10).cast("int") % size
    some = windows.select("id", "n", F.explode(C.kmers("window", k)).alias("kmer")).groupBy("id", "n", bucket.alias("b")).agg(F.count(F.lit(1)).alias("x"))
    got = some.groupBy(F.col("id").alias("i2"), F.col("n").alias("n2")).agg(F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("m"))
    j = windows.join(got, (F.col("id") == F.col("i2")) & (F.col("n") == F.col("n2")), "left")
    value = lambda b: F.coalesce(F.element_at("m", b), F.lit(0)).cast("double")
    return j.select("id", "n", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value).alias("v"))


# The stand-ins are expressions on columns, so they stay in the JVM; a model comes in as a Python function in their place.


def _mers(chars: str, k: int) -> Column:
    """Stretches of ``k`` characters of a column of characters, which must be a column of its own: a lambda would split the text again for each."""
    n = F.size(chars)
    at = F.sequence(F.lit(0), n - k)
    return F.when(n >= k, F.transform(at, lambda i: F.concat(*[F.get(chars, i + j) for j in range(k)]))).otherwise(F.array().cast("array<string>"))


def _overlap(x: str, y: str) -> Column:
    """Stand-in pair score: shared over all distinct k-mers; 0 if there are none."""
    both = F.size(F.array_intersect(x, y))
    all_ = F.size(x) + F.size(y) - both
    return F.when(all_ > 0, both / all_).otherwise(F.lit(0.0))


#: Codes of sets that are searched at once, bytes of their bits, and pairs.
CODES, BITS, PAIRS = 8 << 20, 64 << 20, 1 << 20


def _coded_sets(seqs: DataFrame, k: int = 3) -> DataFrame:
    """(``id``, ``n``, ``x``): the number of distinct k-mers of each sequence, and they as numbers, 21 bits for each character, so ``k`` is 3 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                out.append(np.unique(sum(points[j : len(points) - k + 1 + j] << (21 * (k - 1 - j)) for j in range(k))) if len(points) >= k else np.zeros(0, np.int64))
            yield pa.record_batch({"id": b.column(0).cast(pa.string()), "n": pa.array([len(x) for x in out], pa.int64()), "x": pa.array(out, pa.list_(pa.int64()))})

    return seqs.where("seq is not null").select("id", "seq").mapInArrow(run, "id string, n long, x array<long>")


def _shared(folder: str, u: pa.Array, v: pa.Array, most_codes: int, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs have both sets, and the share that these have in common. Sets are read in chunks; those of ``u`` are held in parts of about ``most_codes`` codes and ``most_bits`` bytes."""
    read = lambda columns: (b for _, b in chunks(folder, 0, 1, columns, 1024))
    names, other = u.unique(), v.unique()
    a, b = (pc.index_in(x, value_set=y).to_numpy() for x, y in ((u, names), (v, other)))
    sizes = [np.full(len(x), -1) for x in (names, other)]
    for rows in read(["id", "n"]):
        n = rows.column(1).to_numpy()
        for x, size in zip((names, other), sizes):
            at = pc.index_in(rows.column(0), value_set=x).fill_null(-1).to_numpy()
            size[at[at >= 0]] = n[at >= 0]
    both = np.flatnonzero((sizes[0][a] >= 0) & (sizes[1][b] >= 0))
    score = np.zeros(len(u))

    def part(of: np.ndarray) -> None:
        """Scores of the pairs of these sequences."""
        some = names.take(pa.array(of))
        got = [np.zeros(0, np.int64)] * len(of)
        for rows in read(["id", "x"]):
            at = pc.index_in(rows.column(0), value_set=some).fill_null(-1).to_numpy()
            flat, ends = rows.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(rows.column(1)).to_numpy())])
            for i in np.flatnonzero(at >= 0):
                got[at[i]] = flat[ends[i] : ends[i + 1]].copy()  # a view would hold the whole chunk
        pa.default_memory_pool().release_unused()
        words = np.unique(np.concatenate(got))
        width = -(-max(1, len(words)) // 64) * 64
        if len(of) > 1 and len(of) * width // 8 > most_bits:
            part(of[: len(of) // 2])
            part(of[len(of) // 2 :])
            return
        step = max(1, (most_bits // 4) // width)

        def bits(sets: list[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(sets), width // 64), np.uint64)
            for lo in range(0, len(sets), step):
                few = sets[lo : lo + step]
                row, code = np.repeat(np.arange(len(few)), [len(x) for x in few]), np.concatenate(few)
                at = np.minimum(np.searchsorted(words, code), len(words) - 1)
                there = words[at] == code
                m = np.zeros((len(few), width), bool)
                m[row[there], at[there]] = True
                out[lo : lo + step] = np.packbits(m, axis=1).view(np.uint64)
            return out

        place = np.full(len(names), -1)
        place[of] = np.arange(len(of))
        mine = both[place[a[both]] >= 0]
        mine = mine[np.argsort(b[mine], kind="stable")]
        if not len(words):
            return
        left = bits(got)
        for rows in read(["id", "x"]):
            at = pc.index_in(rows.column(0), value_set=other).fill_null(-1).to_numpy()
            flat, ends = rows.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(rows.column(1)).to_numpy())])
            here = np.flatnonzero(at >= 0)
            for lo in range(0, len(here), step):
                few = here[lo : lo + step]
                right = bits([flat[ends[i] : ends[i + 1]] for i in few])
                first, last = np.searchsorted(b[mine], at[few], "left"), np.searchsorted(b[mine], at[few], "right")
                pairs, row = np.concatenate([mine[x:y] for x, y in zip(first, last)]), np.repeat(np.arange(len(few)), last - first)
                for x in range(0, len(pairs), 2048):
                    score[pairs[x : x + 2048]] = np.bitwise_count(left[place[a[pairs[x : x + 2048]]]] & right[row[x : x + 2048]]).sum(axis=1)

    of = np.unique(a[both])
    for x in np.split(of, np.flatnonzero(np.diff(np.cumsum(sizes[0][of]) // most_codes)) + 1):
        if len(x):
            part(x)
    all_ = sizes[0][a[both]] + sizes[1][b[both]] - score[both]
    return both, np.divide(score[both], all_, out=np.zeros(len(both)), where=all_ > 0)


def _kmer_scores(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """Stand-in pair score: shared over all distinct 3-mers. The sets are a table in the shared folder, which tasks read in chunks; a pair moves as two ids and never with its sets."""
    scratch = Scratch(pairs.sparkSession)
    folder = scratch.path(scratch.write(_coded_sets(seqs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            u, v = (t[x].combine_chunks() for x in ("u", "v"))
            at, c = _shared(folder, u, v, CODES, BITS)
            yield from pa.table({"u": u.take(pa.array(at)), "v": v.take(pa.array(at)), "c": c}).to_batches(1 << 14)

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= PAIRS:
                yield from flush()
        if held:
            yield from flush()

    return pairs.select("u", "v").where("u is not null and v is not null").mapInArrow(run, "u string, v string, c double")


def kmer_likelihood(df: DataFrame, text: Column, *keep: str, k: int = 2, sample: int = 0, seed: int = 0) -> DataFrame:
    """``keep`` and ``l``, a stand-in for a mean log-probability: minus the logarithm of the distinct k-mers (plus one) over the length; 0 for shorter texts.

    With ``sample`` only the k-mers at so many sampled positions count.
    """
    named = once(df, *keep, text=text)
    chars = once(named, *keep, "text", chars=F.split("text", ""), at=C.sampled_positions("text", sample, seed) if sample else F.lit(None).cast("array<int>"))
    mers = once(chars, *keep, "at", mers=_mers("chars", k))
    some = F.when(F.col("at").isNull(), F.col("mers")).otherwise(F.transform(F.filter("at", lambda i: i <= F.size("mers")), lambda i: F.get("mers", i - 1)))
    got = once(mers, *keep, some=some)
    n = F.size("some")
    return got.select(*keep, F.when(n > 0, -F.log((F.size(F.array_distinct("some")) + 1.0) / (n + 1.0))).otherwise(F.lit(0.0)).alias("l"))


def embed(df: DataFrame, id_col: str, seq: str, *, encoder: Callable[[list[str]], list[list[float]]] | None = None, win: int = 1022, stride: int = 768, normalize: bool = False) -> DataFrame:
    """(``id``, ``emb``): mean over the vectors of overlapping windows, all windows alike. NULL and empty sequences have none."""
    w = df.where(F.length(seq) > 0).select(F.col(id_col).alias("id"), F.posexplode(C.windows(seq, win, stride)).alias("n", "w")).select("id", "n", F.col("w.window").alias("window"))
    if encoder is None:
        v = kmer_counts(w)
    else:
        run = F.pandas_udf(lambda s: pd.Series(encoder(s.tolist())), ArrayType(DoubleType()))
        v = w.select("id", run("window").alias("v"))
    # Vectors of one window need no mean; those of several are summed by place in Arrow, one row for each vector.
    def mean(t: pa.Table) -> pa.Table:
        m = np.array(t["v"].to_pylist(), np.float64).mean(axis=0)
        return pa.table({"id": t["id"].slice(0, 1), "emb": pa.array([m.tolist()], pa.list_(pa.float64()))})

    many = w.where("n > 0").select(F.col("id").alias("m")).distinct()
    one = v.join(many, F.col("id") == F.col("m"), "left_anti").select("id", F.col("v").alias("emb"))
    more = v.join(many, F.col("id") == F.col("m"), "left_semi").select("id", "v").groupBy("id").applyInArrow(mean, "id string, emb array<double>")
    out = one.unionByName(more)
    return out.select("id", C.l2_normalize("emb").alias("emb")) if normalize else out


def _joined(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with both sequences, ``sa`` and ``sb``; pairs without both drop out."""
    a, b = seqs.select(F.col("id").alias("ia"), F.col("seq").alias("sa")), seqs.select(F.col("id").alias("ib"), F.col("seq").alias("sb"))
    return pairs.join(a, F.col("u") == F.col("ia")).join(b, F.col("v") == F.col("ib")).drop("ia", "ib")


def score_pairs(pairs: DataFrame, seqs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] | None = None, batch: int = 64) -> DataFrame:
    """(``u``, ``v``, ``c``): score of the sequences of each pair by ``scorer``, at most ``batch`` pairs at once; shared k-mers without one."""
    if scorer is None:
        return _kmer_scores(pairs, seqs)

    def call(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([s for lo in range(0, len(x), batch) for s in scorer(x[lo : lo + batch].tolist(), y[lo : lo + batch].tolist())], dtype="float64")

    return _joined(pairs, seqs).select("u", "v", F.pandas_udf(call, DoubleType())("sa", "sb").alias("c"))


def likelihood_gain(pairs: DataFrame, seqs: DataFrame, *, linker: int = 10, sample: int = 0, seed: int = 0, likelihood: Callable[[list[str]], list[float]] | None = None) -> DataFrame:
    """(``u``, ``v``, ``c``): likelihood of the linked pair minus those of its parts; each single sequence is scored once.

    ``sample`` positions of each text count, all if it is 0; a model given as ``likelihood`` samples by itself.
    """
    def scored(df: DataFrame, text: Column, *keep: str) -> DataFrame:
        if likelihood is None:
            return kmer_likelihood(df, text, *keep, sample=sample, seed=seed)
        run = F.pandas_udf(lambda x: pd.Series(likelihood(x.tolist()), dtype="float64"), DoubleType())
        return df.select(*keep, run(text).alias("l"))

    single = scored(seqs, F.col("seq"), "id", "seq")
    a = single.select(F.col("id").alias("ia"), F.col("seq").alias("sa"), F.col("l").alias("la"))
    b = single.select(F.col("id").alias("ib"), F.col("seq").alias("sb"), F.col("l").alias("lb"))
    j = pairs.join(a, F.col("u") == F.col("ia")).join(b, F.col("v") == F.col("ib"))
    return scored(j, C.linked("sa", "sb", linker), "u", "v", "la", "lb").select("u", "v", (F.col("l") - F.col("la") - F.col("lb")).alias("c"))


def masked_coupling(pairs: DataFrame, seqs: DataFrame, *, k: int = 8, seed: int = 0) -> DataFrame:
    """(``u``, ``v``, ``c``): loss of shared k-mers when ``k`` sampled positions of one side are masked, none below 0, both sides averaged.

    Each sequence is masked once and not once for each pair.
    """
    chars = once(seqs.where("seq is not null"), "id", chars=F.split("seq", ""), at=C.sampled_positions("seq", k, seed))
    hidden = F.transform("chars", lambda c, i: F.when(F.array_contains("at", i + 1), F.lit("X")).otherwise(c))
    both = once(chars, "id", "chars", hidden=hidden)
    s = both.select("id", F.array_distinct(_mers("chars", 3)).alias("x"), F.array_distinct(_mers("hidden", 3)).alias("y"))
    a = s.select(F.col("id").alias("ia"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = s.select(F.col("id").alias("ib"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    j = pairs.join(a, F.col("u") == F.col("ia")).join(b, F.col("v") == F.col("ib"))
    got = once(j, "u", "v", f=_overlap("xa", "xb"), g=_overlap("ya", "xb"), h=_overlap("xa", "yb"))
    loss = lambda c: F.greatest(F.lit(0.0), F.col("f") - F.col(c))
    return got.select("u", "v", ((loss("g") + loss("h")) / 2).alias("c"))


def pair_score_graph(vectors: DataFrame, seqs: DataFrame, *, method: str = "coupling", cand_m: int = 500, topm: int = 20, norm: str = "minmax", temp: float = 1.0, append: DataFrame | None = None, scorer: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:
    """(``u``, ``v``, ``w``): candidates by cosine, scored in pairs, normalized within each anchor, the best kept, undirected; with ``append``, merged with that graph.

    ``method`` is ``coupling``, ``likelihood`` or ``masked``, or ``scorer`` scores; ``norm`` is ``clip01``, ``minmax`` or ``sigmoid_z``.
    """
    known = seqs.select(F.col("id").alias("known"))  # pairs of an anchor without a sequence would drop out after the search
    cands = top_candidates(vectors.join(known, F.col("id") == F.col("known"), "left_semi"), vectors, cand_m).select("u", "v")
    score = {"coupling": score_pairs, "likelihood": likelihood_gain, "masked": masked_coupling}[method]
    scored = score_pairs(cands, seqs, scorer) if scorer else score(cands, seqs)
    scored = scored.where(~F.isnan("c"))
    if norm == "clip01":
        weighted = scored.withColumn("w", C.clamp01("c"))
    else:
        weighted = anchor_minmax(scored) if norm == "minmax" else anchor_sigmoid_z(scored, temp=temp)
    g = best_edges(weighted, topm)
    return g if append is None else merge_max(append, g)
