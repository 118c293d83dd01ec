"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8)."""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"


@lru_cache(2)
def _pattern(folder: str) -> str:
    """The pattern that cuts a text into pieces, as published with the vocabulary."""
    spec = importlib.util.spec_from_file_location("public_tokenizers_at", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


#: Pairs of neighbouring tokens that a worker keeps in mind.
PAIRS = 1 << 19


class BackwardBPE:
    """Exact byte-pair encoding in linear time.

    A sequence of tokens is the encoding of its bytes if and only if each two neighbours are the encoding
    of their own bytes. So the text is read left to right with the longest token that matches and fits its
    left neighbour; at a dead end the last token gives way to its next shorter prefix. Positions from
    which no encoding goes on are marked, so each is tried once.

    ``ranks`` maps the bytes of a token to its id; lower ids merge first. Bytes are mapped to Latin-1
    characters, since the automaton works on strings.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ids = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.names = {v: k for k, v in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.trie = ahocorasick.Automaton()
        for k, v in self.ids.items():
            self.trie.add_word(k, v)
        self.cut = regex.compile(pattern).findall
        self.fits: dict[tuple[int, int], bool] = {}  # emptied when it has PAIRS pairs
        self.shorter: dict[int, int] = {}
        self.pieces: dict[str, list[int]] = {}

    def merged(self, s: str) -> list[str]:
        """Plain byte-pair encoding of a short string, the definition."""
        parts = list(s)
        while len(parts) > 1:
            rank, i = min((self.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            both = parts[i] + parts[i + 1]
            out, j = [], 0
            while j < len(parts):
                if j + 1 < len(parts) and parts[j] + parts[j + 1] == both:
                    out.append(both)
                    j += 2
                else:
                    out.append(parts[j])
                    j += 1
            parts = out
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether two tokens may stand next to each other."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            x, y = self.names[a], self.names[b]
            known = self.fits[a, b] = self.merged(x + y) == [x, y]
        return known

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of a token; -1 if there is none."""
        known = self.shorter.get(token)
        if known is None:
            n = self.trie.longest_prefix(self.names[token][:-1])
            name = self.names[token][:n]
            while name and name not in self.ids:
                name = name[:-1]
            known = self.shorter[token] = self.ids[name] if name else -1
        return known

    def match(self, s: str, at: int) -> int:
        """The longest token at a position."""
        window = s[at : at + self.longest]
        n = self.trie.longest_prefix(window)
        while window[:n] not in self.ids:
            n -= 1
        return self.ids[window[:n]]

    def piece(self, s: str) -> list[int]:
        """Ids of a piece, given as Latin-1."""
        if s in self.ids:
            return [self.ids[s]]
        out: list[int] = []
        dead = bytearray(len(s) + 1)
        at, token = 0, self.match(s, 0)
        while True:
            end = at + len(self.names[token])
            if not dead[end] and (not out or self.fit(out[-1], token)):
                out.append(token)
                at = end
                if at == len(s):
                    return out
                token = self.match(s, at)
                continue
            shorter = self.prefix(token)
            if shorter >= 0:
                token = shorter
                continue
            dead[at] = 1
            token = out.pop()
            at -= len(self.names[token])
            # the token that led here is refused by the mark at its end

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.cut(text):
            ids = self.pieces.get(word)
            if ids is None:
                ids = self.piece(word.encode("utf-8").decode("latin-1"))
                if len(word) <= 64:
                    if len(self.pieces) >= 500_000:
                        self.pieces.clear()
                    self.pieces[word] = ids
            out += ids
        return out


@lru_cache(2)
def load(folder: str, name: str) -> BackwardBPE:
    """The tokenizer of a rank file; one for each worker process."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return BackwardBPE(ranks, _pattern(folder))


def encode_corpus(df: DataFrame, doc_id: str, text: str, *, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(``doc_id``, ``ids``): the token ids of each text by a public byte-level tokenizer of ``folder``.

    Special tokens are never produced; their names in a text are ordinary text. NULL and empty texts have
    an empty list. Every row comes out once, repeated ones too, with its whole text. Each worker loads the
    vocabulary from ``folder`` (present on every machine) and remembers the pieces and the pairs of
    neighbours it has seen. Columns that aren't named aren't read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(folder, name)
        for batch in batches:
            ids = [bpe.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id bigint, ids array<int>")
