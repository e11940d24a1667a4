"""Quality, toxicity, LM scores and BPE."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import string
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import bpe, lm, quality, toxicity
from papyra.llm.common import fold, labelled_sample

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def crc(x, k=5):
    return zlib.crc32(str(x).encode()) % k if x is not None else zlib.crc32(b"") % k


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in (None, 0, 1, 17, -3, 10**12)], "i bigint")
    assert [r.f for r in rows.select(fold(rows.i).alias("f")).collect()] == [crc(i) for i in (None, 0, 1, 17, -3, 10**12)]


def sequences(n):
    return itertools.product((0, 1), repeat=n)


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    counts = np.array([4, 1, 3])
    emission, transition = rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs, z = quality.marginals(emission, transition, counts)
    at = 0
    for d, n in enumerate(counts):
        weights = {y: math.exp(sum(emission[at + i] * y[i] for i in range(n)) + sum(transition[a, b] for a, b in itertools.pairwise(y))) for y in sequences(n)}
        total = sum(weights.values())
        assert z[d] == pytest.approx(math.log(total))
        for i in range(n):
            assert p[at + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
        for a, b in sequences(2):
            assert pairs[d, a, b] == pytest.approx(sum(w * sum((y[i], y[i + 1]) == (a, b) for i in range(n - 1)) for y, w in weights.items()) / total)
        at += n


@pytest.mark.parametrize(("run", "column"), [(quality.classify, "quality"), (toxicity.detect, "toxic")])
def test_classifiers_on_odd_rows(odd, odd_rows, nothing, labels, no_labels, run, column):
    found = run(odd, labels).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 and r.held_out == (crc(r.doc_id) == 0) and r.predicted == int(r.score >= (0.3 if column == "quality" else 0.5)) for r in found)
    assert run(nothing, labels).collect() == []
    assert {r.score for r in run(odd, no_labels).collect()} == {0.5}


@pytest.mark.parametrize(("query", "column", "least"), [(quality.op1_quality, 0, 0.95), (toxicity.op10_toxicity, 1, 0.75)])
def test_classifiers_on_held_out_rows(spark, query, column, least):
    """Area under the curve of held-out labels, at sf0.01."""
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: (r.quality, r.toxic)[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scores = collections.defaultdict(list)
    for r in query(spark, sf).where("held_out").collect():
        if r.doc_id in known:
            scores[known[r.doc_id]].append(r.score)
    wins = [(a > b) + 0.5 * (a == b) for a in scores[1] for b in scores[0]]
    assert sum(wins) / len(wins) >= least


def test_texts_of_many_lines_score_by_blocks():
    """Blocks with carried messages give what the whole gives; lines repeat across blocks."""
    r = random.Random(12)
    line = lambda: " ".join(r.choice(["the", "of", "Word", "12", "##", "été", "x;"]) for _ in range(r.randrange(9)))
    texts = ["\n".join(line() for _ in range(r.randrange(1, 40))) for _ in range(60)]
    model = quality.fit(texts, [i % 2 for i in range(60)], rounds=20)
    long = "\n".join(line() for _ in range(3 * quality.BLOCK_LINES + 17))
    x, length, counts = quality.line_features([long])
    blocks = list(quality.line_blocks(long, 1000))
    assert np.allclose(np.concatenate([b for b, _ in blocks]), x) and (np.concatenate([n for _, n in blocks]) == length).all()
    p, _, _ = quality.marginals(((x - model["mean"]) / model["dev"]) @ model["w"], model["t"], counts)
    assert np.allclose(quality.long_marginals(((x - model["mean"]) / model["dev"]) @ model["w"], model["t"]), p)
    whole = quality._aggregate(model, (x - model["mean"]) / model["dev"], length, counts) @ model["a"]
    assert quality.score(model, ["a", long, "", texts[0]])[1] == pytest.approx(1 / (1 + math.exp(-whole[0])))
    assert quality.score(model, ["a", long, "", texts[0]])[3] == pytest.approx(quality.score(model, [texts[0]])[0])


def test_memory_for_texts_of_many_lines():
    """A million short lines, and a million words in one line, are scored in bounded memory."""
    import tracemalloc

    model = quality.fit(["Good words, in a line.\nAnd more of them."] * 3 + ["## @@ ||\n12 12"] * 3, [1, 1, 1, 0, 0, 0], rounds=5)
    for text in ("ab\n" * 1_000_000, "ab " * 1_000_000):
        tracemalloc.start()
        assert 0 <= quality.score(model, [text])[0] <= 1
        assert tracemalloc.get_traced_memory()[1] < 120 << 20
        tracemalloc.stop()


def test_lines_learnt_from_are_bounded():
    texts = ["a\nb"] * 10 + ["x\n" * 500] + ["c"]
    with pytest.warns(UserWarning, match="1 of 12"):
        assert quality._fitted(texts, [0] * 11 + [1], most=100) == [*range(10), 11]
    with pytest.raises(ValueError, match="no text with label"):
        quality._fitted(texts, [0] * 10 + [1, 0], most=100)


def test_keep_good_keeps_rows_whole(odd, labels):
    kept = quality.keep_good(odd, labels, threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality.keep_good(odd, labels, threshold=1.1).count() == 0


def segments_by_definition(x):
    """Repeatedly the best segment (leftmost, shortest), then the same left and right of it."""
    if not len(x):
        return []
    best = max(((sum(x[i:j]), -i, -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=None)
    total, _, _, i, j = best
    if total <= 0:
        return []
    return segments_by_definition(x[:i]) + [(i, j, total)] + [(a + j, b + j, s) for a, b, s in segments_by_definition(x[j:])]


def test_segments():
    r = random.Random(2)
    for _ in range(200):
        x = [r.choice([-1.0625, -1.0625, -0.5, 3.0, 1.5, 5.25]) for _ in range(r.randrange(1, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(x))] == [(a, b) for a, b, _ in segments_by_definition(x)]
    assert toxicity.segments(np.zeros(0)) == []


def test_log_odds_by_definition():
    """The share of toxic documents among those with a token, with its prefixes' as prior, one after another."""
    counts = {b"good": [0, 30], b"good 4": [1, 40], b"goodness": [2, 2], b"goodn 5": [3, 3], b"bad": [9, 0]}
    logit = lambda p: math.log(p / (1 - p))
    four = (1 + 20 * 0.2) / (41 + 20)
    five = (3 + 20 * four) / (6 + 20)
    want = {b"good 4": four, b"goodn 5": five, b"goodness": (2 + 20 * five) / 24, b"good": 20 * four / 50, b"bad": (9 + 20 * 0.2) / 29}
    assert toxicity.log_odds(counts, 20, 80) == pytest.approx({k: logit(p) - logit(0.2) for k, p in want.items()})
    odds = toxicity.Odds(toxicity.log_odds(counts, 20, 80))
    assert odds[b"goodnite"] == pytest.approx(logit(five) - logit(0.2) + toxicity.DRIFT) and odds[b"else"] == toxicity.DRIFT
    assert toxicity.log_odds(counts, 20, 80, 1)[b"bad"] == pytest.approx(logit((8 + 20 * 19 / 99) / 28) - logit(19 / 99))


def test_toxic_documents_are_told_at_the_threshold(spark):
    """Precision and recall of held-out labels at sf0.1."""
    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    told = collections.Counter((known[r.doc_id], r.predicted) for r in toxicity.op10_toxicity(spark, sf).where("held_out").collect() if r.doc_id in known)
    assert told[1, 1] / (told[1, 1] + told[1, 0]) >= 0.9 and told[1, 1] / (told[1, 1] + told[0, 1]) >= 0.95


def test_toxic_passages_in_long_texts():
    r = random.Random(4)
    clean = lambda n: " ".join(f"w{int(r.paretovariate(0.6)) % 3000}" for _ in range(n))
    nasty = lambda n: " ".join(r.choice(["scumbag", "wretch", "filthmonger"]) if r.random() < 0.4 else f"w{r.randrange(3000)}" for _ in range(n))
    texts = [clean(100) for _ in range(150)] + [clean(60) + " " + nasty(30) for _ in range(50)]
    model = toxicity.fit(texts, [0] * 150 + [1] * 50)
    found = toxicity.score(model, [clean(4000), clean(2000) + " " + nasty(40) + " " + clean(2000), ""])
    assert found[0] < 0.5 < found[1] and found[2] < 0.5


def lm_by_definition(rows, held_out=1):
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for k, (_, t) in enumerate(rows)}
    counts = collections.Counter(w for k, (i, _) in enumerate(rows) if crc(i) != held_out for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, crc(i) == held_out, len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[k]), 5)) for k, (i, _) in enumerate(rows)), key=repr)


def found_lm(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 1, "bucket": 50}])
def test_lm_on_odd_rows(odd, odd_rows, nothing, sizes):
    assert found_lm(lm.lm_scores(odd, **sizes)) == lm_by_definition(odd_rows)
    assert lm.lm_scores(nothing).collect() == []


def test_lm_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = lm.op5_lm(spark, sf)
    assert found_lm(out) == lm_by_definition(rows)
    wanted = dict(scores_by_definition(rows))
    assert all(r.score == pytest.approx(wanted[r.doc_id], abs=1e-4) for r in out.collect())
    held = [r for r in out.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # contexts tell something about texts not seen


def test_lm_probabilities_add_up(spark):
    """In every context the probabilities of all words, the end and one unknown word make 1."""
    r = random.Random(6)
    rows = [(i, " ".join(f"w{int(r.paretovariate(1)) % 40}" for _ in range(30))) for i in range(75) if crc(i) != 1]
    words = sorted({w for _, t in rows for w in t.split()})
    contexts = ["", "w1 w2", "w1 w1", "w3", "w2 w7", "unseen", "w1 unseen"]
    asked = [f"{c} {w}".strip() for c in contexts for w in [*words, "neverseen"]] + contexts
    known = [i for i in range(10**6) if crc(i) == 1][: len(asked)]
    found = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame([*rows, *zip(known, asked, strict=True)], "doc_id bigint, text string")).collect()}
    by_text = {t: found[i].score for i, t in zip(known, asked, strict=True)}
    grams = scores_by_definition([*rows, *((i, t) for i, t in zip(known, asked, strict=True))])
    assert dict(grams) == {i: round(x.score, 5) for i, x in found.items()}
    p = probabilities([*rows, *zip(known, asked, strict=True)])
    for c in contexts:
        before = [w for w in c.split()][-2:]
        assert sum(p((*before, w)) for w in [*words, None, "neverseen"]) == pytest.approx(1, abs=1e-9), c
        prefix = sum(math.log10(p(tuple(c.split()[max(0, j - 2) : j + 1]))) for j in range(len(c.split())))
        assert by_text[c] == pytest.approx(prefix + math.log10(p((*before, None))), abs=1e-6)


def tiktoken_of():
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_by_library(rows):
    encoding = tiktoken_of()
    out = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_bpe_on_odd_rows(odd, odd_rows, nothing):
    assert sorted(map(tuple, bpe.round_trip(odd).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr) == bpe_by_library(odd_rows)
    assert bpe.round_trip(nothing).collect() == []


def test_bpe_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, bpe.op6_bpe(spark, sf).collect()), key=repr) == bpe_by_library(rows)


def test_bpe_of_spaces_and_scripts():
    import public_tokenizers

    encoding, codec = tiktoken_of(), bpe.Codec(bpe.PerfectHash(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))), public_tokenizers.PATTERN)
    r = random.Random(8)
    pieces = ["a", " ", "  ", "\n", "\t", "'s", "'LL", "12", "é", "日本", "!?", " ", "　", "​", "x" * 70, "_", "😀", "\r\n", "don't", " '", "\u0085", " ", "\x1c"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(3000)] + [" ".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(3000)]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_encode_then_decode(odd):
    ids = bpe.encode(odd)
    back = {(r.doc_id, bytes(r.decoded)) for r in bpe.decode(ids).collect()}
    assert back == {(r.doc_id, (r.text or "").encode()) for r in odd.select("doc_id", "text").collect()}


def test_perfect_hash():
    keys = {str(i).encode(): i for i in range(2000)}
    table = bpe.PerfectHash(keys)
    assert all(table.get(k) == v for k, v in keys.items()) and table.get(b"x") is None and table.n == 2000


def probabilities(rows, held_out=1):
    """p(context and word), by the formulas: Dirichlet priors from trigrams to bigrams to unigrams of all words."""
    grams = collections.Counter()
    for i, t in rows:
        if crc(i) != held_out:
            t = [*(t or "").translate(LOWER).split(), None]
            for k in range(3):
                grams.update(tuple(t[j - k : j + 1]) for j in range(k, len(t)))
    words = {g: c for g, c in grams.items() if len(g) == 1}
    n, v = sum(words.values()), len(words)

    def p(g):
        if len(g) == 1:
            return (grams[g] + 0.5) / (n + 0.5 * (v + 1))
        m = lm.MU[len(g) - 2]
        return (grams[g] + m * p(g[1:])) / (grams[g[:-1]] + m)

    return p


def scores_by_definition(rows, held_out=1):
    p = probabilities(rows, held_out)
    texts = [[*(t or "").translate(LOWER).split(), None] for _, t in rows]
    return [(i, round(sum(math.log10(p(tuple(t[max(0, j - 2) : j + 1]))) for j in range(len(t))), 5)) for (i, _), t in zip(rows, texts, strict=True)]


@pytest.mark.parametrize("sizes", [{}, {"chunk": 700, "bucket": 9000}])
def test_lm_counts_ngrams_of_rare_words(spark, sizes):
    """Words beyond the 1,024 most frequent ones, in fixed phrases: bigrams and trigrams of all of them count."""
    r = random.Random(9)
    phrases = [" ".join(f"r{k}x{j}" for j in range(5)) for k in range(600)]
    rows = [(i, " ".join(r.choice(phrases) for _ in range(20))) for i in range(200)]
    found = [(d.doc_id, round(d.score, 5)) for d in lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), **sizes).collect()]
    assert sorted(found) == sorted(scores_by_definition(rows))


def test_long_texts_leave_room_in_the_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    first = labels.where(fold(labels.doc_id) != 0).selectExpr("doc_id").orderBy(F.xxhash64("doc_id")).first()[0]
    docs = spark.createDataFrame([(i, "x" * 5000 if i == first else f"text {i}") for i in range(40)], "doc_id bigint, text string")
    with pytest.warns(UserWarning, match="1 of"):
        texts, known = labelled_sample(docs, labels, "quality", 100, chars=1000, long=500)
    assert sorted(texts) == sorted(f"text {i}" for i in range(40) if crc(i) != 0 and i != first) and set(known) == {0, 1}
    with pytest.raises(ValueError, match="no text with quality"):
        labelled_sample(docs, labels, "quality", 100, chars=0)
