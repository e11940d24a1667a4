"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import fold, labelled_sample, logistic, read
from papyra.llm.quality import score_documents

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 12000
THRESHOLD = 0.5
#: Weight in documents of the prior that a token's prefix is, and what every token's log-odds are lowered by.
PRIOR, DRIFT = 20.0, -1.0
#: Documents that must hold a token or prefix; fewer leave it to its prefix.
LEAST = 2
#: E-value up to which a segment is significant.
SIGNIFICANT = 0.5

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


#: Bytes of the prefixes that are the priors of words, the shorter of the longer.
STEMS = (4, 5, 6, 7)
#: Words whose log-odds a worker remembers.
MEMO_WORDS = 300_000


def tokens(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def stems(words: Iterable[bytes]) -> Iterable[bytes]:
    """The prefixes of each word, in turn; they can't equal a word, as they end in a space and their length."""
    for k in STEMS:
        end = b" %d" % k
        yield from [w[:k] + end for w in words]


class Odds(dict):
    """Log-odds of words with the drift: their own, or of their longest prefix that is known, else the drift alone."""

    def __init__(self, known: dict[bytes, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self.known.get(word)
        if found is None:
            found = next((v for s in reversed(list(stems([word]))) if (v := self.known.get(s)) is not None), 0.0)
        out = self[word] = found + DRIFT
        return out

    def __reduce__(self):
        return Odds, (self.known,)


def log_odds(counts: dict[bytes, list[int]], n_toxic: int, n_clean: int, leave: int | None = None) -> dict[bytes, float]:
    """Log-odds that a document with the token is toxic, against any document, of all tokens and prefixes.

    The prior of a token is a Dirichlet (of two kinds: Beta) around its longest prefix's share, that of the shortest prefix around
    the share of toxic documents. leave: a label; one document of that label is left out of each count, which gives
    the documents learnt from log-odds as if they were new.
    """
    toxic, clean = n_toxic - (leave == 1), n_clean - (leave == 0)
    base = toxic / (toxic + clean)
    share: dict[bytes, float] = {}
    # Prefixes by length, then words: each after its own prefixes.
    for k in sorted(counts, key=lambda k: (k[-2:-1] != b" ", k[-1:])):
        prior = base
        for s in stems([k[:-2]] if k[-2:-1] == b" " else [k]):
            if s == k:
                break
            prior = share.get(s, prior)
        t, c = counts[k]
        t, c = max(t - (leave == 1), 0), max(c - (leave == 0), 0)
        share[k] = (t + PRIOR * prior) / (t + c + PRIOR)
    zero = math.log(base / (1 - base))
    return {k: math.log(p / (1 - p)) - zero for k, p in share.items()}


def segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence of scores, in linear time; none is held but runs of one sign."""
    good = x > 0
    if not good.any():
        return []
    edges = np.append(0, np.flatnonzero(good[1:] != good[:-1]) + 1)
    ends = np.append(edges[1:], len(x))
    stack: list[tuple[float, float, int, int]] = []  # cumulative before, cumulative after, start, end
    total = 0.0
    for a, b, s, up in zip(edges.tolist(), ends.tolist(), np.add.reduceat(x, edges).tolist(), good[edges].tolist(), strict=True):
        left, total = total, total + s
        if not up:
            continue
        right, start = total, a
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, start, b))
                break
            left, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for l, r, a, b in stack]  # noqa: E741


def decay(scores: np.ndarray, counts: np.ndarray) -> float:
    """The lambda > 0 at which the mean of exp(lambda score) is 1, over scores that occur so often; 1 where there is none."""
    share = counts / counts.sum()
    if scores.max() <= 0 or (share * scores).sum() >= 0:
        return 1.0
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * scores, 50))).sum() < 1 else (low, mid)
    return low


def token_scores(odds: Odds, text: str) -> np.ndarray:
    words = tokens(text)
    return np.fromiter(map(odds.__getitem__, words), float, len(words))


def passages(model: dict, text: str) -> tuple[int, list[tuple[int, int, float]]]:
    """(tokens, maximal segments) of a text."""
    x = token_scores(model["odds"], text)
    return len(x), segments(x)


def _inputs(model: dict, n: int, found: list[tuple[int, int, float]]) -> list[float]:
    """What the calibration weighs: the best segment's extreme-value surprise, those of significant ones in sum and number, the length."""
    lam, k = model["lambda"], model["k"]
    es = [k * max(n, 1) * math.exp(-min(lam * s, 700)) for _, _, s in found]
    best = -math.log(max(-math.expm1(-min(es)), 1e-30)) if es else 0.0
    strong = [lam * s - math.log(k * max(n, 1)) for (_, _, s), e in zip(found, es, strict=True) if e <= SIGNIFICANT]
    return [1.0, min(best, 40.0) / 10, math.log1p(max(sum(strong), 0.0)), math.log1p(len(strong)), math.log1p(n) / 5]


def fit(texts: list[str], y: list[int]) -> dict:
    """Log-odds of all tokens; then, with each text's own document left out of them, the extreme-value statistics of clean texts and the calibration."""
    if len(set(y)) < 2:
        return {"prior": float(np.clip(np.mean(y) if y else 0.5, 0.01, 0.99))}
    counts: dict[bytes, list[int]] = {}
    for text, label in zip(texts, y, strict=True):
        once = set(tokens(text))
        once.update(set(stems(once)))
        for k in once:
            counts.setdefault(k, [0, 0])[1 - label] += 1
    counts = {k: c for k, c in counts.items() if sum(c) >= LEAST}
    n_toxic, n_clean = sum(y), len(y) - sum(y)
    found: list = [None] * len(texts)
    clean: Counter = Counter()
    for label in (0, 1):
        # The share of a kind with one document can't be told without it.
        odds = Odds(log_odds(counts, n_toxic, n_clean, label if (n_clean, n_toxic)[label] > 1 else None))
        for i, text in enumerate(texts):
            if y[i] == label:
                x = token_scores(odds, text)
                found[i] = len(x), segments(x)
                if not label:
                    clean.update(dict(zip(*np.unique(np.round(x, 3), return_counts=True), strict=True)))
    model = {"odds": Odds(log_odds(counts, n_toxic, n_clean)), "k": 1.0, "lambda": 1.0}
    if clean:
        model["lambda"] = decay(np.array(list(clean)), np.array(list(clean.values()), float))
    # P(best segment <= x) = exp(-K n exp(-lambda x)) over clean documents gives K by maximum likelihood.
    best = [(n, max((s for _, _, s in part), default=0.0)) for (n, part), label in zip(found, y, strict=True) if not label and n]
    model["k"] = float(np.clip(len(best) / max(sum(n * math.exp(-model["lambda"] * s) for n, s in best), 1e-9), 1e-6, 10)) if best else 1.0
    model["a"] = logistic(np.array([_inputs(model, n, part) for n, part in found]), np.array(y, float))
    return model


def score(model: dict, texts: list[str]) -> np.ndarray:
    if "prior" in model:
        return np.full(len(texts), model["prior"])
    x = np.array([_inputs(model, *passages(model, t)) for t in texts]).reshape(-1, 5)
    return 1 / (1 + np.exp(-np.clip(x @ model["a"], -30, 30)))


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Every token is scored by its log-odds (fitted on at most `sample` labelled documents outside fold 0), those of clean
    documents' words negative; the maximal
    scoring segments of a whole text are found in linear time, each with an extreme-value E-value; the best one and
    the significant ones together give the score, calibrated to the probability of label 1. Null texts count as
    empty. Without labels of both kinds the score is the labels' mean (0.5 without any). Null ids are never learnt
    from; repeated rows score alike; an empty table gives an empty result; other columns are ignored.
    """
    model = fit(*labelled_sample(docs, labels, label, sample, id_col, text_col))
    out = score_documents(docs, model, id_col, text_col, score)
    return out.select(id_col, (fold(F.col(id_col)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
