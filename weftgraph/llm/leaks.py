"""Evaluation texts leaking into training text (problem 9)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are the longest runs of letters or digits, in lower case.
WORD = re.compile(r"[^\W_]+")
RESULT = "doc_id bigint, item_id bigint, edits int"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def walk(windows: np.ndarray, bits: np.ndarray, steps: int, rows: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The CGK embedding of windows (rows of word numbers), one step after another.

    Each step writes the current word and moves on to the next one or stays, as a random bit of step and word says.
    Past the end it writes 0. Of two windows k edits apart the walks meet again soon after each edit
    with good odds, so edit distance becomes Hamming distance. ``bits`` is (steps, words), or with
    ``rows`` (functions, steps, words) and a function for each row.
    """
    n, size = windows.shape
    row, at = np.arange(n), np.zeros(n, np.int32)
    padded = np.concatenate([windows, np.zeros((n, 1), windows.dtype)], axis=1)
    for j in range(steps):
        word = padded[row, at]
        yield word
        at = np.minimum(at + (bits[j, word] if rows is None else bits[rows, j, word]), size)


@lru_cache(16)
def collision_rate(size: int, edits: int, steps: int, sample: int, trials: int = 600) -> float:
    """Probability, measured, that windows ``edits`` edits apart agree on ``sample`` random steps of a random walk: that of the worst edits.

    Edits of all kinds at all places (pairs of places and more at random) are made in windows of distinct words,
    followed by other words as in a text, and embedded by ``trials`` random functions each.
    """
    if edits == 0:
        return 1.0
    rng = np.random.default_rng(1)
    kinds = [(k, p) for k in "rid" for p in range(size) if k == "r" or p]  # at the first place an insertion or a deletion is another window, or a replacement
    scripts = [[kp] for kp in kinds] if edits == 1 else [[kinds[i] for i in rng.choice(len(kinds), edits, replace=False)] for _ in range(150)]
    worst = 1.0
    for script in scripts:
        other = list(range(1, size + edits + 1))
        other[size:] = range(size + 50, size + 50 + edits)
        for i, (kind, p) in enumerate(sorted(script, key=lambda x: -x[1])):
            other[p : p + (kind != "i")] = [] if kind == "d" else [size + 20 + i]
        both = np.array([range(1, size + 1), (other + list(range(size + 80, size + 80 + size)))[:size]], np.int32)
        bits = rng.integers(0, 2, (trials, steps, size + 100), dtype=np.int8)
        a, b = (np.stack(list(walk(np.tile(x, (trials, 1)), bits, steps, np.arange(trials)))) for x in both)
        alike = (a == b).sum(axis=0)
        worst = min(worst, float(np.mean([math.comb(int(k), sample) for k in alike])) / math.comb(steps, sample))
    return worst


def repetitions(edits: int, size: int, steps: int, sample: int, recall: float) -> int:
    """How often steps must be sampled, each time from another walk, so that windows within ``edits`` agree at least once with probability ``recall``."""
    rate = collision_rate(size, edits, steps, sample)
    return 1 if rate >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - rate)))


class PassageIndex:
    """Windows of one block of passages, embedded by several random walks, with a key of a few sampled steps of each.

    Words are numbers of the block's vocabulary; 0 stands for any other word and equals none.
    """

    def __init__(self, passages: list[tuple[int, str]], size: int, edits: int, recall: float, seed: int):
        self.size, self.edits, self.steps, self.sample = size, edits, 3 * size // 2, max(2, 5 * size // 12)  # few walks get past the end in so many steps
        self.times = repetitions(edits, size, self.steps, self.sample, recall)
        texts = [(i, words(t or "")) for i, t in passages]
        self.vocabulary: dict[str, int] = {}
        for _, ws in texts:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        ids = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in texts]
        self.items = np.concatenate([np.full(max(0, len(x) - size + 1), i, np.int64) for (i, _), x in zip(texts, ids)] or [np.empty(0, np.int64)])
        rows = [np.lib.stride_tricks.sliding_window_view(x, size) for x in ids if len(x) >= size]
        self.windows = np.concatenate(rows) if rows else np.empty((0, size), np.int32)
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(0, 2, (self.times, self.steps, len(self.vocabulary) + 1), dtype=np.int8)
        self.places = [np.sort(rng.choice(self.steps, self.sample, replace=False)) for _ in range(self.times)]
        self.odd = rng.integers(0, 1 << 62, (self.times, self.sample), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.tables = []
        for r in range(self.times):
            keys = self.keys(self.windows, r)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def keys(self, windows: np.ndarray, r: int) -> np.ndarray:
        """Key of each window: a hash of the sampled steps of walk ``r``."""
        h, k = np.zeros(len(windows), np.uint64), 0
        for j, word in enumerate(walk(windows, self.bits[r], int(self.places[r][-1]) + 1)):
            if j == self.places[r][k]:
                h = (h ^ (word.astype(np.uint64) + np.uint64(1))) * self.odd[r][k]
                h ^= h >> np.uint64(29)
                k += 1
        return h

    def distance(self, stretches: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Least edit distance of each window to a beginning of its stretch of text."""
        n, size = windows.shape
        out = np.full(n, size, np.int64)
        equal = ((stretches[:, :size] == windows) & (windows > 0)).all(axis=1)
        out[equal] = 0
        # Words that stand at most ``edits`` places apart in both: all but ``edits`` of them, or the distance is larger.
        padded = np.pad(stretches, ((0, 0), (self.edits, 0)))
        near = (windows == padded[:, :size]) & (windows > 0)
        for shift in range(1, 2 * self.edits + 1):
            near |= windows == padded[:, shift : shift + size]
        rest = np.flatnonzero(~equal & (near.sum(axis=1) >= size - self.edits))
        if self.edits and len(rest):
            a, b = windows[rest], stretches[rest]
            row = np.tile(np.arange(b.shape[1] + 1), (len(rest), 1))
            for i in range(size):
                new = np.empty_like(row)
                new[:, 0] = i + 1
                differ = (a[:, i : i + 1] != b) | (b == 0)
                for j in range(b.shape[1]):
                    new[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + differ[:, j])
                row = new
            out[rest] = row.min(axis=1)
        return out

    def probe(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the document, item, edits) of each leak in a batch of documents, given as word numbers."""
        size, reach = self.size, self.size + self.edits
        gap = np.zeros(reach, np.int32)  # no window spans two documents
        flat = np.concatenate([x for d in docs for x in (d, gap)] or [gap])
        owner = np.repeat(np.arange(len(docs)), [len(d) + reach for d in docs])
        none = (np.empty(0, np.int64),) * 3
        if not len(docs) or not len(self.windows):
            return none
        unknown = np.concatenate([[0], np.cumsum(flat == 0)])
        start = np.flatnonzero((unknown[size:-1] - unknown[: -size - 1])[: len(flat) - reach + 1] <= self.edits)
        found = []
        for lo in range(0, len(start), 1 << 15):
            part = start[lo : lo + (1 << 15)]
            stretches = flat[part[:, None] + np.arange(reach)]
            pairs = []
            for r, (table, order) in enumerate(self.tables):
                keys = self.keys(stretches[:, :size], r)
                a, b = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
                n = b - a
                mine = np.repeat(np.arange(len(part)), n)
                theirs = order[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                pairs.append(mine * len(self.windows) + theirs)
            pairs = np.unique(np.concatenate(pairs))
            for k in range(0, len(pairs), 1 << 15):
                m, t = np.divmod(pairs[k : k + (1 << 15)], len(self.windows))
                d = self.distance(stretches[m], self.windows[t])
                good = d <= self.edits
                found.append(np.stack([owner[part[m[good]]], self.items[t[good]], d[good]]))
        if not found:
            return none
        doc, item, d = np.concatenate(found, axis=1)
        order = np.lexsort((d, item, doc))
        doc, item, d = doc[order], item[order], d[order]
        first = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))[: len(doc)]
        return doc[first], item[first], d[first]


def _blocks(passages: DataFrame, max_bytes: int) -> Iterator[list[tuple[int, str]]]:
    block, held = [], 0
    for item, text in passages.toLocalIterator():
        block.append((item, text))
        held += len(text)
        if held >= max_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaked_passages(
    docs: DataFrame,
    doc_id: str,
    text: str,
    passages: DataFrame,
    item_id: str,
    item_text: str,
    *,
    size: int = 12,
    edits: int = 1,
    recall: float = 0.99,
    block_bytes: int = 1 << 20,
    seed: int = 5,
) -> DataFrame:
    """(``doc_id``, ``item_id``, ``edits``): documents with a stretch at most ``edits`` word edits from ``size`` consecutive words of a passage.

    Every window of ``size`` words, of passages and documents alike, goes through CGK embeddings, which turn
    edit distance into Hamming distance; windows whose walks agree on a few sampled steps are candidates.
    Each repetition has a walk and steps of its own, and there are as many as reach ``recall`` for the
    worst edits, by their measured rate of collisions. The exact edit distance decides: the least over
    the stretches of text that begin with the window, up to ``edits`` words longer or shorter than it. Equal
    windows agree on all walks, so what is ``edits`` 0 in the result is complete. Document windows with more than
    ``edits`` words that no passage has can't match and are skipped.

    Passages are a stated query set: they are read in blocks of ``block_bytes`` of text, and each block's
    index, bounded by that, goes to all workers for one pass over the documents, which never move. NULL and empty
    texts and passages of fewer words match nothing. Repeated rows with one id give one row. Columns that aren't named aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= 2 * (size - edits) - 1)
    out = None
    for block in _blocks(passages.select(F.col(item_id).cast("long"), F.col(item_text)).where(F.col(item_text).isNotNull()), block_bytes):
        shared = spark.sparkContext.broadcast(PassageIndex(block, size, edits, recall, seed))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            number = index.vocabulary.get
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    ids = [np.array([number(w, 0) for w in words(t)], np.int32) for t in part.column(1).to_pylist()]
                    doc, item, d = index.probe(ids)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(d, pa.int32())], ["doc_id", "item_id", "edits"])

        found = docs.mapInArrow(find, RESULT)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], RESULT)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
