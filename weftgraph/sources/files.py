"""Readers of the file formats: delimited tables, id lists, FASTA, archives of vectors. All rows are text until a caller casts them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.operators.ranking import number_rows


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(``id``): stripped lines that aren't blank, duplicates kept."""
    return spark.read.text(path).select(C.normalize_id("value").alias("id")).where("id is not null")


def read_id_set(spark: SparkSession, path: str) -> DataFrame | None:
    """Distinct ids; None for an empty path, which means no restriction."""
    return read_ids(spark, path).distinct() if path else None


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(``id``): first word of each line, distinct."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("id")).where("id <> ''").distinct()


def read_fasta(spark: SparkSession, path: str, *, keep_empty: bool = False) -> DataFrame:
    """(``id``, ``seq``): records by their first word after >, white space removed; of repeated ids the last of the last file.

    Records are split by the reader, so large files are read in parallel. Without ``keep_empty`` records without
    a sequence drop out before the last is chosen. Text before the first > belongs to no record.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    # The first record of a file is whatever comes before its first "\n>": a record only if the file begins with ">".
    head = raw.where("block = 0").groupBy("file").agg(F.min("at").alias("head")).withColumnRenamed("file", "f")
    raw = raw.join(F.broadcast(head), (F.col("file") == F.col("f")) & (F.col("at") == F.col("head")), "left")  # one row per file
    text = F.regexp_replace("value", "^>", "")
    rec = raw.where(F.col("head").isNull() | F.ltrim("value").startswith(">")).select("file", "block", "at", F.regexp_extract(text, r"^\s*(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s+", "").alias("seq"))
    rec = rec.where("id <> ''")
    if not keep_empty:
        rec = rec.where("seq <> ''")
    return rec.groupBy("id").agg(F.max_by("seq", F.struct("file", "block", "at")).alias("seq"))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """, for .csv, tab for .tsv and .txt, else whichever is more frequent in the first lines."""
    low = path.lower()
    if low.endswith(".csv"):
        return ","
    if low.endswith((".tsv", ".txt")):
        return "\t"
    head = "\n".join(r[0] for r in spark.read.text(path).limit(50).collect())[:4096]
    return "\t" if head.count("\t") >= head.count(",") else ","


def read_table(spark: SparkSession, path: str, columns: tuple[str, ...] = (), sep: str | None = None) -> DataFrame:
    """Table with a header, every column text, a byte-order mark tolerated; an error if a required column is missing."""
    df = spark.read.option("header", True).option("sep", sep or sniff_delimiter(spark, path)).option("nullValue", None).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t", -1).alias("f"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"))


def read_edges2(spark: SparkSession, path: str, *, skip_header: bool = True) -> DataFrame:
    """(``u``, ``v``): tab-separated pairs; blank and short rows, self loops and header rows are left out."""
    e = _fields(spark, path).where(F.size("f") >= 2).select(C.strip(F.col("f")[0]).alias("u"), C.strip(F.col("f")[1]).alias("v")).where("u <> '' and v <> '' and u <> v")
    return e.where(~F.startswith("u", F.lit("node"))) if skip_header else e


def read_edges3(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """(``u``, ``v``, ``w``, ``file``, ``pos``): weighted pairs of one or many files; self loops are left out. A bad number drops the row, or is an error if ``strict``."""
    e = _fields(spark, path).where(F.size("f") >= 3).select(F.col("f")[0].alias("u"), F.col("f")[1].alias("v"), C.strip(F.col("f")[2]).alias("s"), "file", "pos").where("u <> v")
    if strict:
        return e.select("u", "v", F.col("s").cast("double").alias("w"), "file", "pos")
    return e.select("u", "v", C.number("s").alias("w"), "file", "pos").where("w is not null")


def read_graph_folder(spark: SparkSession, pattern: str) -> dict[str, DataFrame]:
    """Edge tables by name of the file, or of the .tsv folder that holds its parts; an error if there is none. The files are listed, not read."""
    name = lambda c: F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?(?:/part-[^/]*)?$", 1)
    df = read_edges3(spark, pattern).withColumn("graph", name("file"))
    names = [r[0] for r in spark.read.format("binaryFile").load(pattern).select(name("path").alias("graph")).distinct().orderBy("graph").collect()]
    if not names:
        raise ValueError(f"no files: {pattern}")
    return {n: df.where(F.col("graph") == n).select("u", "v", "w") for n in names}


def labels(rows: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(``id``, ``value``) from ``rows(id, value, pos)``: 1 if the last value of an id is above 0, else 0; rows without a number don't count."""
    r = rows.select(C.normalize_id("id").alias("id"), C.number("value").alias("x"), "pos").where("id is not null and x is not null")
    if nodes is not None:
        r = r.join(nodes.select(F.col("id").alias("n")), F.col("id") == F.col("n"), "left_semi")
    return r.groupBy("id").agg(F.max_by("x", "pos").alias("x")).select("id", F.when(F.col("x") > 0, 1.0).otherwise(0.0).alias("value"))


def hit_table(df: DataFrame, id_col: str, *, conf: str | None = None, words: tuple[str, ...] = C.TRUTHY, bait: str | None = None, uppercase: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits ``id``, baits ``id``): distinct ids of confident rows, all rows if no column says so, and distinct ids in the bait lists. Rows without an id give neither."""
    k = C.normalize_id(F.col(id_col).cast("string"), uppercase)
    ok = C.is_truthy(F.col(conf).cast("string"), words) if conf else F.lit(True)
    hits = df.where(ok).select(k.alias("id")).where("id is not null").distinct()
    if bait is None:
        return hits, hits.limit(0)
    b = df.where(k.isNotNull()).select(F.explode(C.split_multi(F.col(bait).cast("string"))).alias("b"))
    return hits, b.select(C.normalize_id("b", uppercase).alias("id")).where("id is not null").distinct()


def hit_counts(df: DataFrame, id_col: str, hits: DataFrame, baits: DataFrame, *, uppercase: bool = False) -> DataFrame:
    """One row: ``raw_rows``, ``rows_missing_protein``, ``high_conf_hit_count`` and ``bait_count`` of a hit table."""
    missing = C.normalize_id(F.col(id_col).cast("string"), uppercase).isNull()
    rows = df.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(missing).alias("rows_missing_protein"))
    return rows.join(hits.agg(F.count(F.lit(1)).alias("high_conf_hit_count"))).join(baits.agg(F.count(F.lit(1)).alias("bait_count")))  # one row each


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(``pos``, ``value``): one number per line, in order of ``pos``, from 0; an error where a line holds none."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), C.strip("value").alias("s"))
    value = C.number("s")
    bad = F.concat(F.lit("not a number: "), F.coalesce("s", F.lit("")))
    numbers = lines.select("pos", F.when(value.isNull(), F.raise_error(bad).cast("double")).otherwise(value).alias("value"))
    return number_rows(numbers, "pos").select(F.col("at").alias("pos"), "value")


def read_summary(spark: SparkSession, path: str, sort_by: str, names: dict[str, str] | None = None) -> DataFrame:
    """A summary table of graphs with numbers and ``label``, the graph's name by ``names``, else without .tsv; largest ``sort_by`` first if there is such a column."""
    df = read_table(spark, path, ("graph", "auprc", "recall@k", "precision@k", "enrich_factor@k"), "\t")
    df = df.select("graph", *[C.number(F.col(f"`{c}`")).alias(c) for c in df.columns if c != "graph"])
    df = df.withColumn("label", C.mapped(F.replace("graph", F.lit(".tsv"), F.lit("")), names or {}))
    return df.orderBy(F.col(f"`{sort_by}`").desc_nulls_last()) if sort_by in df.columns else df


def shard(df: DataFrame, index: int, count: int, *order: str) -> DataFrame:
    """Part ``index`` (from 0) of ``count`` contiguous parts of equal size, the last ones shorter, by ``order``."""
    if count < 1 or not 0 <= index < count:
        raise ValueError("0 <= index < count must hold")
    placed = number_rows(df, *order)
    size = max(1, -(-placed.count() // count))
    return placed.where((F.col("at") >= index * size) & (F.col("at") < (index + 1) * size)).drop("at")


def sequences_of(ids: DataFrame, seqs: DataFrame) -> DataFrame:
    """(``pos``, ``id``, ``seq``): rows of ``ids(pos, id)`` whose id has a sequence in ``seqs(id, seq)`` that isn't empty; the order is kept in ``pos``."""
    s = seqs.where(F.length("seq") > 0).select(F.col("id").alias("i"), "seq")
    return ids.join(s, F.col("id") == F.col("i")).select("pos", "id", "seq")


def required(ids: DataFrame, seqs: DataFrame) -> DataFrame:
    """(``pos``, ``id``, ``seq``) of every row of ``ids(pos, id)``; an error where an id has no sequence."""
    s = seqs.select(F.col("id").alias("i"), "seq")
    j = ids.join(s, F.col("id") == F.col("i"), "left")
    missing = F.raise_error(F.concat(F.lit("no sequence: "), F.col("id"))).cast("string")
    return j.select("pos", "id", F.when(F.col("i").isNull(), missing).otherwise(F.col("seq")).alias("seq"))


def read_npz(spark: SparkSession, path: str, ids: str = "ids", emb: str = "emb") -> DataFrame:
    """(``id``, ``emb``) from archives of vectors. Each archive is read whole by one task, so this is for conversion to Parquet."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for b in batches:
            for raw in b.column(0).to_pylist():
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    names, v = [str(x) for x in z[ids]], z[emb].astype(np.float32)
                for lo in range(0, len(names), 4096):
                    part = v[lo : lo + 4096]
                    flat = pa.array(part.ravel())
                    offsets = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 4096]), pa.ListArray.from_arrays(offsets, flat)], ["id", "emb"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(load, "id string, emb array<float>")
