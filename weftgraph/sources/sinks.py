"""Writers of the file formats."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import columns as C


def write_edges(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """u, v and the weight with six significant digits, tab-separated; ``mode="append"`` adds part files."""
    df.select("u", "v", C.significant("w").alias("w")).write.mode(mode).option("sep", "\t").option("quote", "").csv(path)


def write_ids(df: DataFrame, path: str) -> None:
    df.select(F.col("id").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """``df(id, seq)`` as FASTA with wrapped lines."""
    df.select(F.concat(F.lit(">"), "id", F.lit("\n"), C.wrapped("seq", width)).alias("value")).write.mode("overwrite").text(path)


def write_lengths(df: DataFrame, path: str) -> None:
    """Length of each sequence, one per line, in the order of ids."""
    df.orderBy("id").select(F.length("seq").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("id", "emb").write.mode("overwrite").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """Edges in one folder per split."""
    df.select("u", "v", "split").write.mode("overwrite").partitionBy("split").option("sep", "\t").option("quote", "").csv(path)


def write_node_split(df: DataFrame, path: str) -> None:
    """The distinct nodes of ``df(u, v, split)`` in one folder per split."""
    df.select(F.explode(F.array("u", "v")).alias("id"), "split").distinct().write.mode("overwrite").partitionBy("split").text(path)


def write_model(model, path: str) -> None:
    """A fitted model in the library's own format; ``type(model).load`` reads it."""
    model.write().overwrite().save(path)


def union_ragged(*tables: DataFrame) -> DataFrame:
    """All rows; columns in the order in which they first occur, NULL where a table lacks one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_meta(spark: SparkSession, values: Mapping[str, object], path: str) -> None:
    """Sorted key and value lines."""
    spark.createDataFrame([(k, str(v)) for k, v in sorted(values.items())], "k string, v string").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, fields in sorted order."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_json_value(spark: SparkSession, value: object, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_rows(df: DataFrame, path: str) -> None:
    """Table with header, NULL blank, NaN as nan, booleans as 1 and 0."""
    out = df.select(*[F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])
    # The writer has no word for NaN of its own, so numbers become text here.
    out = out.select(*[F.when(F.isnan(c), F.lit("nan")).otherwise(F.col(c).cast("string")).alias(c) if t in ("double", "float") else F.col(c) for c, t in out.dtypes])
    writer = out.write.mode("overwrite").option("header", True).option("sep", "\t").option("nullValue", "").option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_top(ranked: DataFrame, path: str, k: int) -> None:
    """Ids of the first ``k`` ranks, in order."""
    ranked.where(F.col("rank") <= k).orderBy("rank").select(F.col("id").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def summary_bars(summary: DataFrame, metrics: tuple[str, ...] = ("auprc", "precision@k", "recall@k"), top: int | None = None) -> DataFrame:
    """(``label``, ``metric``, ``value``): bars of a summary table, of its ``top`` first graphs if given. For plots."""
    rows = summary if top is None else summary.limit(top)
    return rows.select("label", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in metrics])).alias("m")).select("label", "m.metric", "m.value")


def plot(df: DataFrame, path: str, x: str, y: str, title: str = "", by: str | None = None, kind: str = "line") -> str:
    """Plot of a small plot table: ``line`` for curves, ``bar`` and ``barh`` for summaries and histograms; ``skipped`` where the plotting library is absent."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return "skipped: matplotlib is not installed"
    pdf = df.toPandas()
    fig, ax = pyplot.subplots()
    for name, part in pdf.groupby(by) if by else [("", pdf)]:
        if kind == "line":
            part = part.sort_values(x)
        {"line": ax.plot, "bar": ax.bar, "barh": ax.barh}[kind](part[x], part[y], label=str(name))
    ax.set_xlabel(x)
    ax.set_ylabel(y)
    ax.set_title(title)
    if by:
        ax.legend()
    fig.savefig(path)
    pyplot.close(fig)
    return "ok"
