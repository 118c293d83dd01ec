"""Same or near-same records across splits (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import once
from weftgraph.session import Scratch, fits_broadcast, shuffle_partitions

#: Rows of which a suffix array is built at once; a key with more of them is exchanged by its suffixes.
ROWS = 20_000
#: Characters of circular suffixes that are held at once.
CHARS = 4 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the concatenated texts, start and length of each): a character is a code point everywhere here."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if (raw >= 0x80).any():
        offsets = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
        raw = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    flat = np.append(raw.astype(np.int32), np.int32(-1))  # never empty
    return flat, offsets[:-1], np.diff(offsets)


def _shared(flat: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """How many characters from places ``x`` and ``y`` on are alike, at most ``most``; ``step`` -1 reads backwards."""
    out = np.zeros(len(x), np.int64)
    live, at, ahead = np.flatnonzero(most > 0), 0, np.arange(32)
    while len(live):
        here = at + ahead
        inside = here < most[live, None]
        a = flat[np.where(inside, x[live, None] + step * here, 0)]
        b = flat[np.where(inside, y[live, None] + step * here, 0)]
        same = (a == b) & inside
        n = np.where(same.all(axis=1), 32, same.argmin(axis=1))
        out[live] += n
        live, at = live[n == 32], at + 32
    return out


def _nearest_span(flat: np.ndarray, at: np.ndarray, n: np.ndarray, group: np.ndarray, step: int = 1) -> np.ndarray:
    """Longest beginning (or, read backwards, end) that each text shares with another one of its group; texts are in order."""
    most = np.where(group[1:] == group[:-1], np.minimum(n[1:], n[:-1]), 0)
    with_next = _shared(flat, at[:-1], at[1:], most, step)
    out = np.zeros(len(at), np.int64)
    out[:-1] = with_next
    out[1:] = np.maximum(out[1:], with_next)
    return out


def _expand(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value): the values ``lo``, ``lo`` + 1, ... of each owner, ``count`` of them."""
    owner = np.repeat(np.arange(len(lo)), count)
    first = np.cumsum(count) - count
    return owner, np.arange(len(owner)) - first[owner] + lo[owner]


def _circular(flat: np.ndarray, at: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, starts) of the circular suffixes of texts from ``place`` on: to the text's end, its mark 0, and on from its beginning."""
    size = n + 1
    own, step = _expand(np.zeros(len(n), np.int64), size)
    pos = place[own] + step
    pos -= np.where(pos >= size[own], size[own], 0)
    end = pos == n[own]
    chars = np.where(end, 0, flat[np.where(end, 0, at[own] + pos)] + 1)
    return chars, np.cumsum(size) - size


def _suffix_pairs(chars: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, held_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(train, held out) places of suffixes of one group and two splits that are alike but for one last character.

    The suffixes are sorted. Those alike in all but the last character of the longer lie side by side, so each looks
    at the next ones as long as the smallest common prefix on the way allows a match.
    """
    wide = chars.astype(">u4" if chars.max(initial=0) > 255 else "u1")
    bounds = np.append(start, len(chars)) * wide.itemsize
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(wide.tobytes())])
    order = pc.sort_indices(pa.table({"g": group, "t": texts}), [("g", "ascending"), ("t", "ascending")]).to_numpy()
    start, size, g, out = start[order], size[order], group[order], held_out[order]
    common = np.append(np.where(g[1:] == g[:-1], _shared(chars, start[:-1], start[1:], np.minimum(size[1:], size[:-1])), -1), -1) if len(g) else np.empty(0, np.int64)
    x, y = [], []
    k, least, d = np.arange(len(g)), common.copy(), 1
    while True:
        on = least >= size[k] - 1
        k, least = k[on], least[on]
        if not len(k):
            break
        j = k + d
        good = (least >= np.maximum(size[k], size[j]) - 1) & (out[k] != out[j])
        a, b = k[good], j[good]
        x.append(order[np.where(out[a], b, a)])
        y.append(order[np.where(out[a], a, b)])
        least = np.minimum(least, common[j])
        d += 1
    return (np.concatenate(x), np.concatenate(y)) if x else (np.empty(0, np.int64),) * 2


MARKS = "x bigint, y bigint, a string, h bigint, b string, place int, held_out boolean"
_NAMES = [c.split()[0] for c in MARKS.split(", ")]


def _marks(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    none = [pa.nulls(n, t) for t in (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_())]
    none[1] = pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), *none], _NAMES)


def _blocks(cost: np.ndarray, group: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Slices of about CHARS of ``cost``; no group is cut if ``group`` is given."""
    total, lo, n = np.cumsum(cost), 0, len(cost)
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + CHARS, "right")))
        if group is not None and hi < n:
            left = int(np.searchsorted(group, group[hi - 1], "left"))
            hi = left if left > lo else int(np.searchsorted(group, group[lo], "right"))
        yield lo, hi
        lo = hi


def _overlaps(t: pa.Table, elsewhere: set[str]) -> Iterator[pa.RecordBatch]:
    """Pairs within the keys of a sorted table; of keys that may have rows ``elsewhere`` the open suffixes, to be exchanged."""
    t = t.combine_chunks()
    a = t["a"].combine_chunks().dictionary_encode()
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    group = a.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    away = np.isin(group, [i for i, k in enumerate(a.dictionary.to_pylist()) if k in elsewhere])
    out = t["held_out"].to_numpy(zero_copy_only=False).astype(bool)
    evals = np.bincount(group, out)
    keep = np.flatnonzero(((evals[group] > 0) & (evals[group] < np.bincount(group)[group])) | away)
    if not len(keep):
        return
    group, away, out = group[keep], away[keep], out[keep]
    texts = t["b"].combine_chunks().take(pa.array(keep))
    rep = t["rep"].to_numpy()[keep]
    flat, at, n = _codes(texts)
    # Spans that each text shares at its beginning and at its end with some other: what they cover together must be all but one character.
    left = _nearest_span(flat, at, n, group)
    back = pc.sort_indices(pa.table({"g": group, "r": pc.utf8_reverse(texts)}), [("g", "ascending"), ("r", "ascending")]).to_numpy()
    right = np.empty(len(n), np.int64)
    right[back] = _nearest_span(flat, at[back] + n[back] - 1, n[back], group[back], -1)
    # A key that goes on elsewhere is known only between its rows here, from the left.
    right[away] = n[away]
    edge = np.flatnonzero(away & (np.append(True, group[1:] != group[:-1]) | np.append(group[1:] != group[:-1], True)))
    left[edge] = n[edge]
    lo, hi = np.maximum(0, n - right), np.minimum(n, left + 1)
    count = np.maximum(0, hi - lo + 1)
    cost = count * (n + 1)

    here = np.flatnonzero(~away & (count > 0))
    for i, j in _blocks(cost[here], group[here]):
        rows = here[i:j]
        if cost[rows].sum() > 4 * CHARS:  # one key with many open suffixes
            away[rows] = True
            continue
        own, place = _expand(lo[rows], count[rows])
        own = rows[own]
        chars, start = _circular(flat, at[own], n[own], place)
        x, y = _suffix_pairs(chars, start, n[own] + 1, group[own], out[own])
        pair = np.unique(np.stack([rep[own[x]], rep[own[y]]]), axis=1)
        yield _marks(pair[0], pair[1])

    there = np.flatnonzero(away & (count > 0))
    keys = t["a"].combine_chunks().take(pa.array(keep))
    for i, j in _blocks(cost[there]):
        rows = there[i:j]
        own, place = _expand(lo[rows], count[rows])
        own = rows[own]
        chars, start = _circular(flat, at[own], n[own], place)
        size = n[own] + 1
        # Suffixes alike but for one character share one of these beginnings: multiples of three just below their sizes.
        for length, some in ((size - 1 - (size - 1) % 3, np.arange(len(own))), (size, np.flatnonzero(size % 3 == 0))):
            if len(some):
                h = _beginnings(chars, start[some], length[some])
                o = pa.array(own[some])
                yield pa.RecordBatch.from_arrays([pa.array(rep[own[some]], pa.int64()), pa.nulls(len(some), pa.int64()), keys.take(o).cast(pa.string()), pa.array(h, pa.int64()), texts.take(o).cast(pa.string()), pa.array(place[some], pa.int32()), pa.array(out[own[some]])], _NAMES)


def _beginnings(chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the first ``length`` characters from each start; it gathers suffixes and decides nothing."""
    own, step = _expand(np.zeros(len(start), np.int64), length)
    h = np.zeros(len(start), np.uint64)
    value = (chars[start[own] + step].astype(np.uint64) + np.uint64(1)) * PRIME ** (step.astype(np.uint64) + np.uint64(1))
    some = length > 0
    if some.any():
        h[some] = np.add.reduceat(value, (np.cumsum(length) - length)[some])
    h ^= h >> np.uint64(31)
    return (h * PRIME).astype(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix arrays of one range of the sorted texts. Its first and last key may go on in other ranges."""
    held: list[pa.RecordBatch] = []
    rows, first = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0)[0].as_py() if first is None else first
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        t = pa.Table.from_batches(held)
        last = t["a"][-1]
        cut = rows - int(pc.sum(pc.equal(t["a"], last)).as_py())
        if not cut:
            first, cut = last.as_py(), rows
        yield from _overlaps(t.slice(0, cut), {first})
        held = t.slice(cut).combine_chunks().to_batches()
        rows -= cut
    if rows:
        t = pa.Table.from_batches(held)
        yield from _overlaps(t, {first, t["a"][-1].as_py()})


PAIRS = "train bigint, held_out bigint"


def _exchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of exchanged suffixes, sorted by their gathering hash; pairs found before pass."""
    def pairs(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        done = pc.is_null(t["a"]).to_numpy(zero_copy_only=False)
        x, y = t["x"].to_numpy()[done], t["y"].filter(pc.is_valid(t["y"])).to_numpy()
        s = t.filter(pa.array(~done)).combine_chunks()
        if s.num_rows:
            a = s["a"].combine_chunks().dictionary_encode()
            flat, at, n = _codes(s["b"].combine_chunks())
            chars, start = _circular(flat, at, n, s["place"].to_numpy().astype(np.int64))
            rep = s["x"].to_numpy()
            i, j = _suffix_pairs(chars, start, n + 1, a.indices.to_numpy(zero_copy_only=False).astype(np.int64), s["held_out"].to_numpy(zero_copy_only=False).astype(bool))
            x, y = np.concatenate([x, rep[i]]), np.concatenate([y, rep[j]])
        pair = np.unique(np.stack([x, y]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in pair], ["train", "held_out"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < CHARS:
            continue
        t = pa.Table.from_batches(held)
        h = t["h"].to_numpy()
        cut = int(np.searchsorted(h, h[-1], "left"))
        if cut:
            yield pairs(t.slice(0, cut))
            t = t.slice(cut).combine_chunks()
            held, size = t.to_batches(), t.nbytes
    if held:
        yield pairs(pa.Table.from_batches(held))


def split_overlaps(df: DataFrame, row_id: str, first: Column, second: Column, held_out: Column) -> DataFrame:
    """(``row_id_1``, ``row_id_2``), smaller first: rows of two sides whose pair of keys is the same or one character apart.

    ``held_out`` is true for rows of an evaluation split, false for training rows, NULL for others. Keys
    count in either order, and at most one character may be inserted, dropped or replaced in both together.

    A record is the text of its two keys, in both orders. As at most one key differs, the suffix array is sparse at
    first: the suffixes that start at a key, sorted in ranges over the cluster, so that a hot key is spread as well.
    Neighbours in it and in the array of the reversed texts show the longest span that each text shares at its beginning
    and at its end; only where the two cover all but one character can it have a partner, and the edit
    must be where they meet. From those places on the circular suffixes (on to the end, then from the beginning) are sorted:
    of two records one edit apart they are alike but for the last character, so they lie side by side,
    and common prefixes tell the pairs. The work is in proportion to texts and pairs, however many share a key.

    Each range of the sorted texts is searched where it lies, by blocks of whole keys. The suffixes of keys that
    may go on in another range, or have over ROWS rows, are gathered by a hash of their beginning first; the
    search is the same, and no hash decides.

    Copies are folded to one record per side before and unfolded after the search. NULL keys take no part, empty ones are
    texts like others; empty input gives an empty result; columns that aren't named aren't read. ``row_id`` must be unique.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    parts = shuffle_partitions(spark)
    rows = once(df.where(held_out.isNotNull()), rid=F.col(row_id).cast("long"), out=held_out, a=first, b=second).where("a is not null and b is not null")
    rows = rows.select("rid", "out", F.least("a", "b").alias("k1"), F.greatest("a", "b").alias("k2"))
    reps = scratch.write(rows.groupBy("k1", "k2", "out").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n")))

    ends = F.array(F.struct(F.col("k1").alias("a"), F.col("k2").alias("b")), F.struct(F.col("k2").alias("a"), F.col("k1").alias("b")))
    entries = reps.select("rep", F.col("out").alias("held_out"), F.inline(F.when(F.col("k1") == F.col("k2"), F.slice(ends, 1, 1)).otherwise(ends))).select("a", "b", "rep", "held_out")
    marks = entries.repartitionByRange(4 * parts, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_scan, MARKS)
    found = scratch.write(marks.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_exchanged, PAIRS).distinct())

    # Unfold the copies of the matched records.
    matched = found.select(F.col("train").alias("m")).unionByName(found.select(F.col("held_out").alias("m"))).distinct()
    many = reps.where("n > 1").select("rep", "k1", "k2", "out")
    many = scratch.write(many.join(matched, many.rep == matched.m).select("rep", F.col("k1").alias("x"), F.col("k2").alias("y"), F.col("out").alias("z")))
    few = F.broadcast(many) if fits_broadcast(many) else many
    members = scratch.write(rows.join(few, (F.col("k1") == F.col("x")) & (F.col("k2") == F.col("y")) & (F.col("out") == F.col("z"))).select("rep", "rid"))
    of = lambda p: members.select(F.col("rep").alias(f"{p}_rep"), F.col("rid").alias(f"{p}_rid"))
    full = found.join(of("t"), F.col("train") == F.col("t_rep"), "left").join(of("e"), F.col("held_out") == F.col("e_rep"), "left")
    x, y = F.coalesce("t_rid", "train"), F.coalesce("e_rid", "held_out")
    return full.select(F.least(x, y).alias("row_id_1"), F.greatest(x, y).alias("row_id_2"))
