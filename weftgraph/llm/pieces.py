"""Splitting oversized items at natural boundaries (problem 7)."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import BLANKS

#: A natural boundary of a sequence: a run of masked residues, stops or gaps.
BOUNDARY = r"[Xx*\-]+"


def agglomerate(length: int, cuts: Sequence[tuple[int, float]], limit: int, overlap: int, least: int = 0, order: str = "strength") -> list[tuple[int, int]]:
    """Pieces (start, end) from 1 of a text of ``length``, merged from the atoms between ``cuts``, which are (position, strength).

    A heap holds the boundaries between adjacent segments, weakest first: by strength, ties from the left,
    or with ``order="position"`` by place alone. The two segments of the weakest boundary merge if their size and the
    overlap with the piece before fit into ``limit``; else the boundary stays. A segment that doesn't fit by
    itself is divided at the limit. If the left one has fewer than ``least`` characters, the
    boundary moves on to the limit instead, so that the right one fills it up.
    """
    ends = sorted({c for c, _ in cuts if 0 < c < length})
    left = dict(zip([*ends, length], [0, *ends]))
    right = {a: b for b, a in left.items()}
    strength = dict(cuts)
    heap = [(0.0 if order == "position" else strength[e], e) for e in ends] + [(float("inf"), length)]
    heapq.heapify(heap)

    def divide(a: int, e: int, at: int) -> None:
        """Put a boundary between ``a`` and ``e`` that stays."""
        left[at], right[a], left[e], right[at] = a, at, at, e

    while heap:
        weight, e = heapq.heappop(heap)
        a = left[e]
        shared = overlap if a else 0
        full = a - shared + limit  # the last place that the left segment can reach
        if e > full:
            divide(a, e, full)
            heapq.heappush(heap, (weight, e))
        elif e < length:
            b = right[e]
            if b > full and e - a + shared >= least:
                continue
            right[a], left[b] = b, a
            if b > full:
                divide(a, b, full)
    pieces, a = [], 0
    while a < length:
        pieces.append((a - overlap + 1 if a else 1, right[a]))
        a = right[a]
    return pieces


def split_oversized(
    df: DataFrame,
    row_id: str,
    text: str,
    *,
    limit: int = 1022,
    overlap: int = 254,
    least: int = 512,
    boundary: str = BOUNDARY,
    order: str = "position",
) -> DataFrame:
    """(``row_id``, ``piece_no``, ``start_pos``, ``end_pos``) of the pieces of each text of more than ``limit`` characters.

    Positions count the characters without white space, from 1, both ends included. The atoms between
    boundaries (the ends of longest runs of ``boundary``) merge by a heap of adjacent pairs (see ``agglomerate``):
    ``order="position"`` takes the leftmost boundary for the weakest, so each piece takes all it can and
    ends at a boundary once it has ``least`` characters; ``order="strength"`` merges at the shortest
    runs first, so that pieces end at the longest ones.

    NULL, blank and short texts have no pieces. Repeated rows each have theirs. Whole texts are read,
    of any length; columns that aren't named aren't.
    """
    if not 0 <= overlap < least <= limit:
        raise ValueError("0 <= overlap < least <= limit must hold")
    clean = F.call_function("translate", F.col(text), F.lit(BLANKS), F.lit(""))
    long = df.select(F.col(row_id).cast("long").alias("row_id"), F.inline(F.array(F.struct(clean.alias("text"))))).where(F.length("text") > limit)
    run = re.compile(boundary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for rid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = [(m.end(), m.end() - m.start()) for m in run.finditer(t)]
                got = agglomerate(len(t), runs, limit, overlap, least if order == "position" else 0, order)
                for i, (a, b) in enumerate(got, 1):
                    for column, x in zip(out, (rid, i, a, b)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["row_id", "piece_no", "start_pos", "end_pos"])

    return long.mapInArrow(cut, "row_id bigint, piece_no bigint, start_pos bigint, end_pos bigint")
