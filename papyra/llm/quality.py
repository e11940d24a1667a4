"""Quality classifier: a linear-chain conditional random field over lines, aggregated by length to documents."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import fold, labelled_sample, logistic, read, ship

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4000
THRESHOLD = 0.3
#: Documents whose lines are labelled together; bounds a worker's memory with CHUNK_CHARS.
CHUNK_DOCS, CHUNK_CHARS = 512, 2_000_000
#: Lines, and bytes, whose features are held at once; a longer text is labelled over blocks of lines. Lines learnt from, at most.
BLOCK_LINES, BLOCK_BYTES, FIT_LINES = 4096, 1 << 20, 150_000
_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")

_CLASSES = 10
_TABLE = np.full(256, 9, np.int64)  # other printable ASCII
_TABLE[128:] = 0
_TABLE[ord("a") : ord("z") + 1] = 1
_TABLE[ord("A") : ord("Z") + 1] = 2
_TABLE[ord("0") : ord("9") + 1] = 3
_TABLE[[9, 11, 12, 13, 32]] = 4
_TABLE[[ord(c) for c in ".,;:"]] = 5
_TABLE[[ord(c) for c in "!?"]] = 6
_TABLE[[ord(c) for c in "#$%&*@^~"]] = 7
_TABLE[[ord(c) for c in "|<>{}[]=+\\/_"]] = 8


def _class_counts(lines: list[bytes]) -> np.ndarray:
    """Bytes of each class in each line, a bounded number of bytes at a time."""
    out = np.zeros((len(lines), _CLASSES))
    i = 0
    while i < len(lines):
        j, held = i, 0
        while j < len(lines) and (j == i or held + len(lines[j]) <= BLOCK_BYTES):
            held += len(lines[j])
            j += 1
        if j == i + 1:
            for k in range(0, held, BLOCK_BYTES):
                out[i] += np.bincount(_TABLE[np.frombuffer(lines[i][k : k + BLOCK_BYTES], np.uint8)], minlength=_CLASSES)
        else:
            at = np.repeat(np.arange(j - i), np.fromiter(map(len, lines[i:j]), np.int64, j - i))
            body = np.frombuffer(b"".join(lines[i:j]), np.uint8)
            out[i:j] = np.bincount(at * _CLASSES + _TABLE[body], minlength=(j - i) * _CLASSES).reshape(-1, _CLASSES)
        i = j
    return out


def _words(line: bytes) -> tuple[int, int]:
    """(words, distinct words); those of a long line aren't held all at once."""
    if len(line) <= BLOCK_BYTES:
        w = line.split()
        return len(w), len(set(w))
    n, seen = 0, set()
    for m in _WORD.finditer(line):
        n += 1
        seen.add(xxhash.xxh3_64_intdigest(m[0]))
    return n, len(seen)


def _own_features(lines: list[bytes], repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line by itself, lengths in bytes)."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    classes = _class_counts(lines)
    words = np.array([_words(x) for x in lines], float).reshape(-1, 2)
    n = np.maximum(length, 1.0)
    share = classes / n[:, None]
    alpha = np.maximum(classes[:, 0] / 2 + classes[:, 1] + classes[:, 2], 1)
    upper = classes[:, 2] / alpha
    distinct = words[:, 1] / np.maximum(words[:, 0], 1)
    own = np.column_stack([
        share[:, [0, 3, 4, 5, 6, 7, 8, 9]], upper, distinct, repeated, np.log1p(length) / 10, np.minimum(n / np.maximum(words[:, 0], 1), 40) / 20,
        length == 0, words[:, 0] < 4, upper > 0.3, share[:, 6] > 0.02, share[:, 7] > 0.02, share[:, 7] > 0.1, share[:, 8] > 0.02, share[:, 3] > 0.1,
        distinct < 0.7, distinct < 0.4, (share[:, 5] < 0.005) & (words[:, 0] > 12), share[:, 5] > 0.05,
    ]).astype(np.float64)
    return own, length


def _with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A constant, each line's features, those of the lines before and after it in its document, and whether it is first or last."""
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([np.ones(len(own)), own, before, after, first, last])


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line with its neighbours', line lengths in bytes, lines per document)."""
    per_doc = [t.encode().split(b"\n") for t in texts]
    counts = np.array([len(x) for x in per_doc], np.int64)
    repeated: list[bool] = []
    for doc in per_doc:
        seen = Counter(doc)
        repeated += [seen[x] > 1 and len(x) > 0 for x in doc]
    own, length = _own_features([x for doc in per_doc for x in doc], np.array(repeated, bool))
    first = np.zeros(len(own), bool)
    first[(np.cumsum(counts) - counts)] = True
    return _with_neighbours(own, first), length, counts


def line_blocks(text: str, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, lengths) of some lines of one document at a time, the same as line_features gives; few lines are held."""
    raw = text.encode()
    ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), len(raw))
    starts = np.append(0, ends[:-1] + 1)

    def lines(a: int, b: int) -> list[bytes]:
        return raw[starts[a] : ends[b - 1]].split(b"\n")

    def hashes(part: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part))

    everything = np.empty(len(ends), np.uint64)
    for a in range(0, len(ends), size):
        b = min(a + size, len(ends))
        everything[a:b] = hashes(lines(a, b))
    everything.sort()
    twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
    del everything
    for a in range(0, len(ends), size):
        b = min(a + size, len(ends))
        c, d = max(a - 1, 0), min(b + 1, len(ends))  # with the neighbours
        part = lines(c, d)
        own, length = _own_features(part, np.isin(hashes(part), twice) & (ends[c:d] > starts[c:d]))
        first = np.zeros(d - c, bool)
        first[0] = True  # what it takes for first or last without being so is cut off
        yield _with_neighbours(own, first)[a - c : d - c - (d - b)], length[a - c : d - c - (d - b)]


def marginals(emission: np.ndarray, transition: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transitions per document, log partition per document).

    emission is the score of good against bad (0). Forward and backward passes step over line numbers, for all
    documents at once: sorted by length, those that still have a line form a prefix.
    """
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    active = np.searchsorted(-size, -np.arange(size.max() if len(size) else 0), side="left")
    e = np.zeros((len(emission), 2))
    e[:, 1] = emission
    m = np.exp(transition - transition.max())
    alpha, scale = np.empty_like(e), np.empty(len(e))
    shift = e.max(axis=1)
    e = np.exp(e - shift[:, None])
    for t, k in enumerate(active):
        i = start[:k] + t
        a = e[i] if t == 0 else (alpha[i - 1] @ m) * e[i]
        scale[i] = s = a.sum(axis=1)
        alpha[i] = a / s[:, None]
    beta = np.ones_like(e)
    pairs = np.zeros((len(counts), 2, 2))
    for t in range(len(active) - 1, 0, -1):
        k = active[t]
        i = start[:k] + t
        right = e[i] * beta[i] / scale[i][:, None]
        beta[i - 1] = right @ m.T
        pairs[order[:k]] += alpha[i - 1][:, :, None] * m * right[:, None, :]
    p = alpha * beta
    p = p / p.sum(axis=1, keepdims=True)
    log = np.log(scale) + shift
    first = np.cumsum(counts) - counts
    z = np.add.reduceat(log, first) + (counts - 1) * transition.max() if len(counts) else np.zeros(0)
    return p[:, 1], pairs, z


def _fitted(texts: list[str], y: list[int], most: int = FIT_LINES) -> list[int]:
    """Which texts the field is fitted on: as many as come to `most` lines, those with over a hundredth of that last.

    A label all of whose texts would be left out raises ValueError.
    """
    lines = [t.count("\n") + 1 for t in texts]
    kept, total = [], 0
    for i in sorted(range(len(texts)), key=lambda i: (lines[i] > most // 100, i)):
        total += lines[i]
        if total > most:
            break
        kept.append(i)
    if lost := set(y) - {y[i] for i in kept}:
        raise ValueError(f"no text with label {sorted(lost)} fits the {most} lines that are learnt from")
    if len(kept) < len(texts):
        warnings.warn(f"{len(texts) - len(kept)} of {len(texts)} labelled texts don't fit the {most} lines that are learnt from", stacklevel=3)
    return sorted(kept)


def fit(texts: list[str], y: list[int], rounds: int = 200, l2: float = 1e-3) -> dict:
    """Conditional likelihood of the lines' labels (each has its document's), weighted so that documents count alike."""
    target = np.array(y, float)
    if len(set(y)) < 2:
        return {"prior": float(np.clip(target.mean() if len(y) else 0.5, 0.01, 0.99))}
    at = _fitted(texts, y)
    texts, target = [texts[i] for i in at], target[at]
    x, length, counts = line_features(texts)
    mean, dev = x.mean(axis=0), x.std(axis=0)
    mean[0], dev = 0, np.where(dev < 1e-9, 1, dev)
    x = (x - mean) / dev
    line_y = np.repeat(target, counts)
    doc_weight = 1 / np.sqrt(counts)
    doc_weight *= len(counts) / doc_weight.sum()
    weight = np.repeat(doc_weight, counts)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = np.zeros((len(counts), 2, 2))
    seen[np.arange(len(counts)), target.astype(int), target.astype(int)] = counts - 1
    moments = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    for step in range(1, rounds + 1):
        p, pairs, _ = marginals(x @ w, t, counts)
        g = np.concatenate([((line_y - p) * weight) @ x, ((seen - pairs) * doc_weight[:, None, None]).sum(axis=0).ravel()]) / len(counts)
        g -= l2 * np.concatenate([w, t.ravel() * 10])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[: len(w)], t + move[len(w) :].reshape(2, 2)
    model = {"mean": mean, "dev": dev, "w": w, "t": t}
    model["a"] = logistic(_aggregate(model, x, length, counts), target)
    return model


def _aggregate(model: dict, x: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Calibration inputs of each document: logits of the length-weighted mean marginal and of the mean line logit."""
    p, _, _ = marginals(x @ model["w"], model["t"], counts)
    first = np.cumsum(counts) - counts
    weight = length + 1.0
    m = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)
    m = np.clip(m, 1e-4, 1 - 1e-4)
    free = np.add.reduceat(np.clip(x @ model["w"], -20, 20) * weight, first) / np.add.reduceat(weight, first)
    return np.column_stack([np.ones(len(m)), np.log(m / (1 - m)), free])


def long_marginals(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(good) of each line of one document, as `marginals`, message by message: two numbers for each line are held."""
    m = np.exp(transition - transition.max())
    (a, b), (c, d) = m.tolist()
    forward = np.empty(len(emission))
    good = 0.0  # share of the message that says good
    for at in range(0, len(emission), BLOCK_LINES):
        out = []
        for i, e in enumerate(np.exp(np.clip(emission[at : at + BLOCK_LINES], -300, 300)).tolist()):
            if at + i == 0:
                x, y = 1.0, e
            else:
                x, y = (1 - good) * a + good * c, ((1 - good) * b + good * d) * e
            good = y / (x + y)
            out.append(good)
        forward[at : at + BLOCK_LINES] = out
    back = 0.5
    for at in range((len(emission) - 1) // BLOCK_LINES * BLOCK_LINES, -1, -BLOCK_LINES):
        out = []
        for e, f in zip(np.exp(np.clip(emission[at : at + BLOCK_LINES], -300, 300)).tolist()[::-1], forward[at : at + BLOCK_LINES].tolist()[::-1], strict=True):
            y = f * back
            out.append(y / (y + (1 - f) * (1 - back)))
            x, y = 1 - back, back * e
            x, y = a * x + b * y, c * x + d * y
            back = y / (x + y)
        forward[at : at + BLOCK_LINES] = out[::-1]
    return forward


def _long_aggregate(model: dict, text: str) -> np.ndarray:
    """_aggregate's row of one document, over blocks of its lines."""
    emissions, weights = [], []
    for x, length in line_blocks(text, BLOCK_LINES):
        emissions.append(((x - model["mean"]) / model["dev"]) @ model["w"])
        weights.append(length + 1.0)
    emission, weight = np.concatenate(emissions), np.concatenate(weights)
    m = np.clip((long_marginals(emission, model["t"]) * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    return np.array([1.0, np.log(m / (1 - m)), (np.clip(emission, -20, 20) * weight).sum() / weight.sum()])


def _groups(texts: list[str]) -> Iterator[tuple[int, int, bool]]:
    """(from, to, long): texts that together have at most BLOCK_LINES lines and BLOCK_BYTES characters, or a single longer one."""
    start = lines = size = 0
    for i, t in enumerate(texts):
        n = t.count("\n") + 1
        long = n > BLOCK_LINES or len(t) > BLOCK_BYTES
        if i > start and (long or lines + n > BLOCK_LINES or size + len(t) > BLOCK_BYTES):
            yield start, i, False
            start, lines, size = i, 0, 0
        if long:
            yield i, i + 1, True
            start = i + 1
        else:
            lines, size = lines + n, size + len(t)
    if start < len(texts):
        yield start, len(texts), False


def score(model: dict, texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    if "prior" in model:
        return np.full(len(texts), model["prior"])
    found = []
    for a, b, long in _groups(texts):
        if long:
            found.append(_long_aggregate(model, texts[a])[None])
        else:
            x, length, counts = line_features(texts[a:b])
            found.append(_aggregate(model, (x - model["mean"]) / model["dev"], length, counts))
    return 1 / (1 + np.exp(-np.clip(np.concatenate(found) @ model["a"], -30, 30)))


def chunks(column: pa.Array, docs: int = CHUNK_DOCS, chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, held = [], 0
    for value in column:
        text = value.as_py()
        if part and (len(part) >= docs or held + len(text) > chars):
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", scorer=score) -> DataFrame:
    """(id, score) of every row; one pass, no shuffle."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scorer(held.value, part) for part in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], ["_id", "score"])

    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, score double").withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose score (as in classify) is at least threshold; one pass, no shuffle."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, "quality", sample, id_col, text_col)))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(model.value, part) for part in chunks(batch.column(at).fill_null(""))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    The field labels every line good or bad from its own and its neighbours' features; forward-backward marginals,
    weighted by line length, make the document's score, calibrated to the probability of label 1. It is fitted on at
    most `sample` labelled documents outside fold 0. Null texts count as empty (one empty line). With no labelled
    rows, or labels of one kind, the score is the labels' mean (0.5 without any). Null ids are in fold crc32('') and
    never learnt from; repeated rows score alike; an empty table gives an empty result; other columns are ignored. Texts
    of many lines are labelled over blocks of BLOCK_LINES with messages carried between them, some 40 bytes for each line.
    """
    model = fit(*labelled_sample(docs, labels, label, sample, id_col, text_col))
    out = score_documents(docs, model, id_col, text_col)
    return out.select(id_col, (fold(F.col(id_col)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
