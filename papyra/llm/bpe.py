"""Byte-level BPE by two-tier lookup: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import read, ship, worker_cache

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Encoded pre-tokens that a worker remembers, and the longest it does: together the bound of that memory.
MEMO_ENTRIES, MEMO_CHARS = 500_000, 48
#: The pattern under which texts can be cut at single spaces, and what it counts as white space (or Python does).
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANKS = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() or regex.match(r"\s", c))

assert sys.byteorder == "little" and array("I").itemsize == 4


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash (hash and displace) from byte strings to their ranks: n slots for n keys."""

    def __init__(self, ranks: dict[bytes, int]):
        n = len(ranks)
        self.n, self.buckets = n, max(1, n // 3)
        groups: dict[int, list] = {}
        for key in ranks:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        taken = bytearray(n)
        free = None
        for b, group in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(group) == 1:
                # Buckets of one key come last and take the free slots directly.
                if free is None:
                    free = iter([i for i in range(n) if not taken[i]])
                slots, d = [next(free)], None
                self.shift[b] = -slots[0] - 1
            else:
                d = 0
                while True:
                    slots = [self._slot(h, d) for h, _ in group]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for s, (_, key) in zip(slots, group, strict=True):
                taken[s], self.keys[s] = 1, key
        self.ranks = [ranks[k] for k in self.keys]

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 17) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF)) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else ((h >> 17) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF)) % self.n
        return self.ranks[s] if self.keys[s] == key else None


def merge(piece: bytes, rank_of) -> list[int]:
    """BPE of one pre-token: the pair of lowest rank, leftmost first, merges; O(n log n) by heap and linked bytes."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0: merged away
    before = list(range(-1, n))
    heap = []
    for i in range(n - 1):
        r = rank_of(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, stop = pop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid], before[stop] = stop, 0, i
        if stop < n:
            after = end[stop]
            r = rank_of(piece[i:after])
            if r is not None:
                push(heap, (r, i, after))
        p = before[i]
        if p >= 0:
            r = rank_of(piece[p:stop])
            if r is not None:
                push(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(rank_of(piece[i : end[i]]))
        i = end[i]
    return out


class Memo(dict):
    """Text piece -> little-endian ids; bounded, and only a shortcut for what `of` returns."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, piece: str) -> bytes:
        out = self.of(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = out
        return out


class Codec:
    def __init__(self, table: PerfectHash, pattern: str):
        self.table = table
        self.split = regex.compile(pattern).findall
        self.parts = dict(zip(table.keys, table.ranks, strict=True)).get  # ranks of what merges inside a pre-token
        self.tokens, self.words = Memo(self._token), Memo(self._word)
        self.by_space = pattern == SPACED
        self.bytes_of = [b""] * (max(table.ranks, default=-1) + 1)
        for r, k in zip(table.ranks, table.keys, strict=True):
            self.bytes_of[r] = k

    def _token(self, token: str) -> bytes:
        """The two tiers: a pre-token of the vocabulary by perfect hash, any other by merging."""
        piece = token.encode()
        whole = self.table.get(piece)
        return array("I", [whole] if whole is not None else merge(piece, self.parts)).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.split(" " + word)))

    def encode(self, text: str) -> bytes:
        """Ids of a text, little-endian.

        Under the pattern SPACED a match begins at every single space between two characters that aren't white
        space, whatever stands elsewhere, so words are looked up whole. Texts with other spaces are split at once.
        """
        words = text.split(" ")
        if self.by_space and len(words) > 1 and all(words) and not self._blank_edges(words):
            return b"".join([*map(self.tokens.__getitem__, self.split(words[0])), *map(self.words.__getitem__, words[1:])])
        return b"".join(map(self.tokens.__getitem__, self.split(text)))

    @staticmethod
    def _blank_edges(words: list[str]) -> bool:
        return any(map(_BLANKS.intersection, {w[0] + w[-1] for w in words}))

    def decode(self, ids: bytes) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _codec(df: DataFrame, path: str | None, pattern: str | None):
    """A function that gives a Python worker its codec. The vocabulary file bounds what is broadcast."""
    import public_tokenizers

    ship(df.sparkSession)
    table = df.sparkSession.sparkContext.broadcast(PerfectHash(load_ranks(path or public_tokenizers.path(VOCABULARY))))
    pattern = pattern or public_tokenizers.PATTERN
    # What a task has memorised serves the worker's next one.
    return lambda: worker_cache((table._path, pattern), lambda: Codec(table.value, pattern))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id and ids (array<int>) of every row; null and empty texts give no ids. Other columns are ignored."""
    make = _codec(df, path, pattern)
    source = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            ids = [np.frombuffer(codec.encode(t.as_py()), "<u4").astype("int32") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id and the decoded bytes of every row; null ids decode to no bytes."""
    make = _codec(df, path, pattern)
    source = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.expr("cast(array() as array<int>)")).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            out = [codec.decode(np.array(x.as_py(), "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_id", "decoded"])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, decoded binary").withColumnRenamed("_id", id_col)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass over the rows: id, n_tokens, ids_sha256, decoded_sha256.

    A row's result depends on its text alone: null texts count as empty (no ids), repeated rows and null ids are kept,
    an empty table gives an empty result, columns other than the two named are ignored. No shuffle.
    """
    make = _codec(df, path, pattern)
    source = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            n, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                n.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
