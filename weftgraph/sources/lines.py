"""Delimited lines that fail to parse (problem 3)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import is_blank
from weftgraph.session import Scratch, fits_broadcast

@dataclass(frozen=True)
class Field:
    """What a field must hold: ``kind`` is text or score; ``missing`` and ``invalid`` name the reasons, None if allowed."""

    name: str
    kind: str
    missing: str | None = None
    invalid: str | None = None


EDGE_FIELDS = (
    Field("node_a", "text", missing="missing_id"),
    Field("node_b", "text", missing="missing_id"),
    Field("combined_score", "score", missing="missing_score", invalid="invalid_score"),
    *(Field(n, "score", invalid="invalid_channel") for n in ("neighborhood", "fusion", "cooccurence", "coexpression", "experimental", "database", "textmining")),
)
REASONS = ("broken_quote", "column_count", "missing_id", "missing_score", "invalid_score", "invalid_channel")


def _structure(line: Column, sep: str) -> tuple[Column, Column]:
    """(quotes are sound, fields) of a line, given also as the column ``pieces``, cut at its quotes.

    The pieces are a column of their own, since a lambda would cut the line again for each of them. They
    alternate between outside and inside.  An even piece between two quotes
    is either empty (a doubled quote) or starts and ends with a separator.
    """
    pieces, last = F.col("pieces"), F.col("last")
    edge = lambda p, i: (p == "") | (((i == 0) | F.startswith(p, F.lit(sep))) & ((i == last) | F.endswith(p, F.lit(sep))))
    sound = (last % 2 == 0) & F.forall(F.transform(pieces, lambda p, i: (i % 2 == 1) | edge(p, i)), lambda x: x)
    # Separators inside quotes are kept from the split as \t, the escape itself as \b.
    bare = lambda p: F.replace(p, F.lit("\\"), F.lit("\\b"))
    mid = lambda p, i: (p == "") & (i > 0) & (i < last)
    text = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.replace(bare(p), F.lit(sep), F.lit("\\t"))).when(mid(p, i), F.lit('"')).otherwise(bare(p)))
    quoted = F.transform(F.split(F.array_join(text, ""), sep, -1), lambda f: F.replace(F.replace(f, F.lit("\\t"), F.lit(sep)), F.lit("\\b"), F.lit("\\")))
    plain = F.split(line, sep, -1)
    has = F.contains(line, F.lit('"'))
    return ~has | sound, F.when(has, quoted).otherwise(plain)


def _reason(fields: Sequence[Field], reasons: Sequence[str]) -> Column:
    """Rank of the reason for which a distinct (col, value) is invalid; NULL for a valid one. Here each value is cast, once."""
    v = F.col("value")
    blank = is_blank(v)
    digits = F.ltrim(F.trim(v), F.lit("0"))
    number = F.when((F.length(F.trim(v)) > 0) & (F.call_function("translate", F.trim(v), F.lit("0123456789"), F.lit("")) == ""), F.when(F.length(digits) <= 4, F.expr("try_cast(concat('0', ltrim('0', trim(value))) as int)")))
    score = number.isNotNull() & (number <= 1000)
    out = F.lit(None).cast("int")
    for i, f in enumerate(fields):
        rank = lambda name: F.lit(list(reasons).index(name) if name else None).cast("int")
        bad = F.when(blank, rank(f.missing))
        if f.kind == "score":
            bad = bad.when(~score, rank(f.invalid))
        out = F.when(F.col("col") == i, bad).otherwise(out)
    return out


def parse_lines(
    lines: DataFrame,
    line_id: str,
    line: str,
    *,
    fields: Sequence[Field] = EDGE_FIELDS,
    reasons: Sequence[str] = REASONS,
    sep: str = "\t",
    broadcast_bytes: int = 8 << 20,
) -> tuple[DataFrame, DataFrame]:
    """(rejects, loaded): rejects (``line_id``, ``reason``) with the first reason that applies; loaded, the other lines' fields.

    Each distinct value of a column is cast once.  Those that fail make a dictionary of invalid values
    with reasons, which joins back to the cells of lines whose structure is sound: by broadcast if its
    measured size is under ``broadcast_bytes``, else by value.  In text columns only blank values can fail,
    so only those enter it.

    ``line_id`` must be unique.  A NULL line has no field (``column_count``), an empty one has one.  One final
    carriage return is no part of a line.  Empty input gives two empty results.
    """
    scratch = Scratch(lines.sparkSession)
    text = F.when(F.endswith(F.col("line"), F.lit("\r")), F.expr("substr(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    named = lines.select(F.col(line_id).alias("line_id"), F.col(line).alias("line")).select("line_id", text.alias("line"))
    sound, cells = _structure(F.col("line"), sep)
    rank = list(reasons).index
    shape = F.when(~sound, rank("broken_quote")).when(F.coalesce(F.size(cells), F.lit(0)) != len(fields), rank("column_count"))
    shape = F.when(F.col("line").isNull(), rank("column_count")).otherwise(shape)
    pieces = F.split("line", '"', -1)
    named = named.select("line_id", "line", F.inline(F.array(F.struct(pieces.alias("pieces")))))
    named = named.select("line_id", "line", "pieces", F.inline(F.array(F.struct((F.size("pieces") - 1).alias("last")))))
    split = named.select("line_id", F.inline(F.array(F.struct(shape.alias("shape"), cells.alias("cells")))))

    text_cols = [i for i, f in enumerate(fields) if f.kind == "text"]
    flat = split.where("shape is null").select("line_id", F.posexplode("cells").alias("col", "value"))
    flat = flat.where(~F.col("col").isin(text_cols) | is_blank(F.col("value")))
    invalid = scratch.write(flat.select("col", "value").distinct().select("col", "value", _reason(fields, reasons).alias("rank")).where("rank is not null"))
    small = fits_broadcast(invalid, broadcast_bytes)
    bad = flat.join(F.broadcast(invalid) if small else invalid, ["col", "value"]).groupBy("line_id").agg(F.min("rank").alias("rank"))
    words = F.array(*map(F.lit, reasons))
    rejects = split.where("shape is not null").select("line_id", F.col("shape").alias("rank")).unionByName(bad)
    rejects = rejects.select("line_id", F.get(words, F.col("rank")).alias("reason"))
    ok = split.where("shape is null").join(rejects.select(F.col("line_id").alias("rejected")), F.col("line_id") == F.col("rejected"), "left_anti")
    value = lambda i, f: F.get("cells", F.lit(i)) if f.kind == "text" else F.expr(f"try_cast(trim(get(cells, {i})) as int)")
    return rejects, ok.select("line_id", *[value(i, f).alias(f.name) for i, f in enumerate(fields)])
