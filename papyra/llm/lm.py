"""LM scoring by a weighted backoff automaton over words, learnt from all n-grams."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import fold, read, ship, worker_cache, written

ADD = 0.5
#: Weight of the shorter context in words, for bigrams and trigrams (Dirichlet priors).
MU = (1000.0, 5.0)
#: Words of the documents that ask together, and bytes of text for each bucket that answers.
CHUNK, BUCKET = 1_000_000, 16 << 20
#: Bits by which fingerprints of bigrams and trigrams exceed what numbers them all: one in 2**SPARE is mistaken for another.
SPARE = 20
END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds white space
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Hashes(dict):
    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def token_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words (A-Z lower-cased) and its end."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(worker_cache("tokens", Hashes).__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers by planes of bytes, compressed; planes of zeros at the top go."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    k = x.itemsize
    while k > 1 and not planes[k - 1].any():
        k -= 1
    body = planes[:k].tobytes()
    return len(x).to_bytes(8, "little") + bytes([k]) + pa.compress(body, "zstd", asbytes=True)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    n, k = int.from_bytes(blob[:8], "little"), blob[8]
    planes = np.frombuffer(pa.decompress(blob[9:], n * k, "zstd", asbytes=True), np.uint8).reshape(k, n)
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :k] = planes.T
    return out.reshape(-1).view(kind)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


class Grams:
    """The distinct words, and fingerprints of the distinct bigrams and trigrams, of a chunk of documents, in order.

    token is the word of each place; two and three number the bigram and trigram that end there, -1 where there is none.
    """

    def __init__(self, words: np.ndarray, token: np.ndarray, sizes: np.ndarray, bits: int):
        self.words, self.token, self.sizes = words, token, sizes
        place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at_two, at_three = np.flatnonzero(place > 0), np.flatnonzero(place > 1)
        h = words[token]
        pair = np.zeros(len(h), np.uint64)
        pair[1:] = _mixed(h[:-1] * _A + h[1:])
        triple = _mixed(pair[at_three - 1] * _C + h[at_three] + _A)
        self.grams, inverse = np.unique(np.concatenate([pair[at_two], triple]) >> np.uint64(64 - bits), return_inverse=True)
        self.two, self.three = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        self.two[at_two], self.three[at_three] = inverse[: len(at_two)], inverse[len(at_two) :]


def _chunks(size: int, columns: list[str]) -> Callable:
    """Batches of (_id, _text, ...) as chunks of about `size` words: (number, columns, words, token, sizes). A document is never split.

    Chunks are numbered by partition and place, alike in every pass over the same table.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        kept: list[list[pa.Array]] = [[] for _ in columns]
        n = 0

        def chunk() -> tuple:
            words, token = np.unique(np.concatenate(held), return_inverse=True)
            return number, [pa.concat_arrays(k) for k in kept], words, token, np.fromiter(map(len, held), np.int64, len(held))

        for batch in batches:
            done = 0
            for i, text in enumerate(batch.column("_text")):
                held.append(token_hashes(text.as_py()))
                n += len(held[-1])
                if n >= size:
                    for k, c in zip(kept, columns, strict=True):
                        k.append(batch.column(c).slice(done, i + 1 - done))
                    yield chunk()
                    number, done, held, kept, n = number + 1, i + 1, [], [[] for _ in columns], 0
            if done < batch.num_rows:
                for k, c in zip(kept, columns, strict=True):
                    k.append(batch.column(c).slice(done))
        if held:
            yield chunk()

    return of


_ASKED = pa.schema([("_bucket", pa.int32()), ("_chunk", pa.int64()), ("_words", pa.binary()), ("_grams", pa.binary()), ("_counts", pa.binary())])
_ASKED_SQL = "_bucket int, _chunk bigint, _words binary, _grams binary, _counts binary"
_ANSWER = pa.schema([("_bucket", pa.int32()), ("_chunk", pa.int64()), ("_words", pa.binary()), ("_grams", pa.binary()), ("_tokens", pa.int64()), ("_types", pa.int64())])
_ANSWER_SQL = "_bucket int, _chunk bigint, _words binary, _grams binary, _tokens bigint, _types bigint"


def _ask(size: int, buckets: int, bits: int) -> Callable:
    """For each chunk and each bucket (a range of hashes): the words and fingerprints that fall there, with their counts in learnt text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (train,), words, token, sizes in _chunks(size, ["_train"])(batches):
            g = Grams(words, token, sizes, bits)
            learnt = np.repeat(train.to_numpy(zero_copy_only=False), sizes)
            of_words = np.bincount(token[learnt], minlength=len(words)).astype(np.uint32)
            both = np.concatenate([k[learnt & (k >= 0)] for k in (g.two, g.three)])
            of_grams = np.bincount(both, minlength=len(g.grams)).astype(np.uint32)
            edges = [(k << 64) // buckets for k in range(1, buckets)]
            cut = np.concatenate([[0], np.searchsorted(words, np.array(edges, np.uint64)), [len(words)]])
            cut_grams = np.concatenate([[0], np.searchsorted(g.grams, np.array([e >> 64 - bits for e in edges], np.uint64)), [len(g.grams)]])
            for k in range(buckets):
                a, b, c, d = cut[k], cut[k + 1], cut_grams[k], cut_grams[k + 1]
                if a < b or c < d:
                    blobs = pack_sorted(words[a:b]), pack_sorted(g.grams[c:d]), pack(np.concatenate([of_words[a:b], of_grams[c:d]]))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((k, number, *blobs), _ASKED.types, strict=True)], schema=_ASKED)

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """Sums a bucket's counts and answers each chunk in the order in which it asked. The first row of a bucket has its totals."""
    words = [unpack_sorted(b.as_py()) for b in asked["_words"]]
    grams = [unpack_sorted(b.as_py()) for b in asked["_grams"]]
    counts = [unpack(b.as_py(), np.uint32) for b in asked["_counts"]]

    def summed(keys: list[np.ndarray], parts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        # Sums of integers, exact in doubles up to 2**53.
        total = np.bincount(at, weights=np.concatenate(parts), minlength=len(found)).astype(np.uint64)
        return np.split(total[at], np.cumsum([len(k) for k in keys])[:-1]), total

    first, total = summed(words, [c[: len(w)] for w, c in zip(words, counts, strict=True)])
    second, _ = summed(grams, [c[len(w) :] for w, c in zip(words, counts, strict=True)])
    blobs = [pa.array([pack(x) for x in part], pa.binary()) for part in (first, second)]
    rest = [0] * (len(first) - 1)
    return pa.table([asked["_bucket"], asked["_chunk"], *blobs, pa.array([int(total.sum()), *rest], pa.int64()), pa.array([int((total > 0).sum()), *rest], pa.int64())], schema=_ANSWER)


def _hold(size: int) -> Callable:
    """What a chunk needs to be scored: its ids, the words of its places, the sizes of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (ids,), words, token, sizes in _chunks(size, ["_id"])(batches):
            rank = np.argsort(-np.bincount(token), kind="stable")  # small numbers for frequent words
            number_of = np.empty(len(words), np.uint32)
            number_of[rank] = np.arange(len(words), dtype=np.uint32)
            blobs = pack_sorted(words), pack(number_of[token]), pack(rank.astype(np.uint32)), pack(sizes.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
                ["_chunk", "_words", "_token", "_rank", "_sizes", "_ids"],
            )

    return run


class Automaton:
    """The states and arcs that the documents of a chunk can take.

    Each n-gram that was seen is an arc from the state of its context, with its smoothed log probability, to the state of
    its own longest part that can be a context. Words not seen after a state leave it by its failure arc, which costs the
    logarithm of the context's weight and leads to the state of the shorter context; the empty context takes any word.
    Arcs and states share numbers: a word, then grams (bigrams and trigrams mixed), then the empty context.
    """

    def __init__(self, g: Grams, counts: np.ndarray, total: int, distinct: int, mu: tuple[float, float] = MU):
        n, end = len(g.words), len(counts)
        self.empty = end
        c = counts.astype(float)
        two, three = np.flatnonzero(g.two >= 0), np.flatnonzero(g.three >= 0)
        lower, context = np.full(end + 1, end), np.full(end + 1, end)
        lower[n + g.two[two]], context[n + g.two[two]] = g.token[two], g.token[two - 1]
        lower[n + g.three[three]], context[n + g.three[three]] = n + g.two[three], n + g.two[three - 1]
        kinds = np.zeros((2, end), bool)
        kinds[0, n + g.two[two]], kinds[1, n + g.three[three]] = True, True
        bigrams, trigrams = map(np.flatnonzero, kinds)
        p = np.zeros(end)
        p[:n] = (c[:n] + ADD) / (total + ADD * (distinct + 1))
        weight = np.ones(end + 1)
        weight[:n] = mu[0] / (c[:n] + mu[0])
        weight[bigrams] = mu[1] / (c[bigrams] + mu[1])
        for grams, m in ((bigrams, mu[0]), (trigrams, mu[1])):
            p[grams] = (c[grams] + m * p[lower[grams]]) / (c[context[grams]] + m)
        self.base = np.log10(p[:n])
        to = np.arange(end + 1)
        to[trigrams] = lower[trigrams]
        to[:n][counts[:n] == 0] = end
        pairs = np.zeros(end + 1, np.int8)
        pairs[bigrams] = 1
        # Arrays of plain numbers are read one by one faster than NumPy's.
        self.log, self.weight, self.to, self.fail, self.pairs = (array(t, x.tobytes()) for t, x in (("d", np.log10(p)), ("d", np.log10(weight)), ("q", to), ("q", lower), ("b", pairs)))
        # The arcs that leave states of two words, one and none at each place; -1 where the n-gram wasn't seen.
        seen = np.append(counts > 0, False)
        self.arcs = *(np.where((k >= 0) & seen[n + k], n + k, -1) for k in (g.three, g.two)), g.token

    def traverse(self, first: int, last: int) -> float:
        """The log probability of the words from place first to last (a document), from left to right."""
        log, weight, to, fail, pairs = self.log, self.weight, self.to, self.fail, self.pairs
        empty = state = self.empty
        total = 0.0
        for three, two, one in zip(*(a[first:last].tolist() for a in self.arcs), strict=True):
            if state != empty:
                if pairs[state]:
                    if three >= 0:
                        total += log[three]
                        state = to[three]
                        continue
                    total += weight[state]
                    state = fail[state]
                if two >= 0:
                    total += log[two]
                    state = to[two]
                    continue
                total += weight[state]
            total += log[one]
            state = to[one]
        return total


def _score(bits: int, total: int, distinct: int) -> Callable:
    """A row for each document of a chunk, from what the chunk holds and the answers to it."""

    def run(answers: pa.Table, own: pa.Table) -> pa.Table:
        words = unpack_sorted(own["_words"][0].as_py())
        token = unpack(own["_rank"][0].as_py(), np.uint32)[unpack(own["_token"][0].as_py(), np.uint32)].astype(np.int64)
        sizes = unpack(own["_sizes"][0].as_py(), np.uint64).astype(np.int64)
        g = Grams(words, token, sizes, bits)
        answers = answers.sort_by("_bucket")
        of_words, of_grams = (np.concatenate([np.empty(0, np.uint64), *(unpack(b.as_py(), np.uint64) for b in answers[c])]) for c in ("_words", "_grams"))
        if len(of_words) != len(words) or len(of_grams) != len(g.grams):
            raise ValueError("the documents were read differently in two passes; write them to a table first")
        auto = Automaton(g, np.concatenate([of_words, of_grams]), total, distinct)
        first = np.cumsum(sizes) - sizes
        known = np.add.reduceat((of_words > 0)[token].astype(np.int64), first)
        score = [auto.traverse(a, b) for a, b in zip(first.tolist(), (first + sizes).tolist(), strict=True)]
        base = np.add.reduceat(auto.base[token], first)
        return pa.table([own["_ids"].combine_chunks().flatten(), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score, pa.float64())], ["_id", "_n", "_known", "_base", "_score"])

    return run


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_fold: int | None = 1, folds: int = 5, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Words are runs without ASCII white space, A-Z lower-cased, then one end. The model learns from the rows whose
    crc32(id as text) mod folds isn't held_out_fold (None: from all). base_score uses smoothed unigrams of all words;
    score the automaton of all trigrams, bigrams and words, each smoothed by the next shorter (Dirichlet priors MU), down
    to the same unigrams.

    Nothing of the model is collected, broadcast or left out. Each chunk of documents (about `chunk` words) asks the
    buckets of a hash range (about `bucket` bytes of text each, so their number grows with the corpus) for its distinct
    n-grams, with the counts that it has itself; a bucket sums what it gets and answers each chunk. The answers, written
    as a table, meet the chunk's words, which are read again; so df must read alike each time, as a table does (a frame
    whose rows move between reads raises ValueError). Words are told apart by 64-bit hashes, longer n-grams by
    fingerprints of which one in 2**SPARE meets another's.

    Null texts are empty (one end token); null ids are in fold crc32(''); rows that repeat an id each get their own row;
    an empty table gives an empty result; other columns are ignored. A document is never split: a worker holds some 150
    bytes for each of its words.
    """
    spark = df.sparkSession
    ship(spark)
    source = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    train = F.lit(True) if held_out_fold is None else fold(F.col("_id"), folds) != held_out_fold
    size = source.agg(F.coalesce(F.sum(F.octet_length("_text") + 1), F.lit(0)).alias("n")).first().n
    buckets = 1 + size // bucket
    bits = min(64, (size + 1).bit_length() + SPARE)  # a text has fewer bigrams and trigrams, together, than bytes

    # Both passes read the same columns, so that they are dealt to partitions alike.
    source = source.select("_id", "_text", train.alias("_train"))
    asked = source.mapInArrow(_ask(chunk, buckets, bits), _ASKED_SQL)
    answers = written(asked.groupBy("_bucket").applyInArrow(_answer, _ANSWER_SQL))
    total = answers.agg(F.coalesce(F.sum("_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("_types"), F.lit(0)).alias("v")).first()
    own = source.mapInArrow(_hold(chunk), f"_chunk bigint, _words binary, _token binary, _rank binary, _sizes binary, _ids array<{kind}>")
    out = answers.select("_chunk", "_bucket", "_words", "_grams").groupBy("_chunk").cogroup(own.groupBy("_chunk"))
    out = out.applyInArrow(_score(bits, total.n, total.v), f"_id {kind}, _n bigint, _known bigint, _base double, _score double")
    held = fold(F.col("_id"), folds) == held_out_fold if held_out_fold is not None else F.lit(False)
    return out.select(
        F.col("_id").alias(id_col), held.alias("held_out"), F.col("_n").alias("n_tokens"), F.col("_known").alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"),
    )


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))
