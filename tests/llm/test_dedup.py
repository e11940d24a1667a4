"""Exact and near dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import string

import pytest

from compare import differences
from papyra.llm import exact_dedup as ex
from papyra.llm.components import components
from papyra.llm.near_dedup import _CHUNK_BITS, _MASKS, DISTANCE, K, cell_links, first_met, near_dedup, op4_near_dedup, shingles, signature

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_exact_on_odd_rows(odd, odd_rows):
    found = ex.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == exact(odd_rows)


@pytest.mark.parametrize("bits, max_bits", [(0.06, 64), (1, 1 << 10), (32, 1 << 20), (1, 64 * 4), (32, 1 << 13)])
def test_exact_with_full_filters_and_many(spark, bits, max_bits):
    """A filter too small for its rows only lets more rows pass; more rows than one filter holds have several."""
    rows = [(i, f"text {i % 300 if i % 3 else 'hot'}") for i in range(1000)]
    found = ex.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), bits_per_row=bits, max_bits=max_bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found), key=repr) == exact(rows)


@pytest.mark.parametrize("k", [1, 3, 7, 64])
def test_ranges_of_hashes(spark, k):
    hashes = [random.Random(k).getrandbits(64) - 2**63 for _ in range(500)] + [-(2**63), 2**63 - 1, 0, -1] + [ex.least(i, k) + d for i in range(1, k) for d in (-1, 0)]
    found = {r._h: r.s for r in spark.createDataFrame([(h,) for h in hashes], "_h bigint").select("_h", ex.slice_column(k).alias("s")).collect()}
    assert all(ex.least(found[h], k) <= h < ex.least(found[h] + 1, k) and 0 <= found[h] < k for h in hashes)


def test_exact_query(spark, sf):
    assert differences(ex.op3_exact_dedup(spark, sf), sf, ex.SQL) == ""


def test_empty(nothing):
    assert ex.exact_dedup(nothing).collect() == []
    assert near_dedup(nothing).collect() == []


def sets_of(rows, n):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(n, len(w))
        out.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    return out


def near(rows, n):
    """component_id and size of each row, by comparing all pairs that share a shingle."""
    sets = sets_of(rows, n)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = collections.Counter((a, b) for at in where.values() for j, a in enumerate(at) for b in at[j + 1 :])
    for (a, b), k in shared.items():
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            parent[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = find(i)
            least[r] = min(least.get(r, key), key)
    return [(key, len(sets[i]), None if key is None else least[find(i)], key is not None and least[find(i)] == key) for i, (key, _) in enumerate(rows)]


def found_near(df, n):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(df, n=n).collect()), key=repr)


def test_near_on_odd_rows(odd, odd_rows):
    assert found_near(odd, 4) == sorted(near(odd_rows, 4), key=repr)


def test_near_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op4_near_dedup(spark, sf).collect()), key=repr)
    assert found == sorted(near(rows, 4), key=repr)


def test_near_in_a_large_group(spark):
    """A group of near copies in which most pairs fall short of the threshold, but chains of links hold it together."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 8])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{r.randrange(10**6)}" for _ in range(60))) for i in range(30)]
    assert found_near(spark.createDataFrame(rows, "doc_id bigint, text string"), 4) == sorted(near(rows, 4), key=repr)


def test_signatures_within_the_distance_share_a_key():
    r = random.Random(1)
    for _ in range(200):
        changed = set(r.sample(range(K), DISTANCE))
        assert any(not changed & set(kept.tolist()) for *_, kept in _MASKS)


def test_pairs_are_first_met_once():
    """Of the keys that a pair shares, exactly one counts as the first."""
    import numpy as np

    r = np.random.default_rng(7)
    for n in (0, 1, 5, 14, 20, DISTANCE):
        for _ in range(20):
            a = r.integers(0, 2**16, K, dtype=np.uint16)
            b = a.copy()
            b[r.choice(K, n, replace=False)] += 1
            shared = [(i << _CHUNK_BITS) | chunk for _, chunk, i, kept in _MASKS if (a[kept] == b[kept]).all()]
            assert sum(len(first_met(key, a[None], b[None])) for key in shared) == 1


def test_similar_sets_have_close_signatures():
    words = [f"w{i}" for i in range(400)]
    a, b = shingles(" ".join(words), 4), shingles(" ".join([*words[:-20], *(f"x{i}" for i in range(20))]), 4)
    assert (signature(a) != signature(b)).sum() <= DISTANCE


def test_cell_links():
    import numpy as np

    s = [np.array(x, np.int64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [50, 51], [50, 51])]
    comp = np.array([10, 7, 30, 31])
    assert sorted(cell_links(comp, s, comp, s, 80)) == [(10, 7), (31, 30)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (1, 0)], "u bigint, v bigint")
    found = {r.u: r.label for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components(links.limit(0)).collect() == []


def test_unlike_sets_that_share_a_number(spark, monkeypatch):
    """Numbers of sets that clash are told by the digests and made anew."""
    from papyra.llm import near_dedup as module

    number = module._number
    monkeypatch.setattr(module, "_number", lambda c, salt=None: number(c, salt) if salt is not None else number(c) % 4)
    r = random.Random(2)
    base = " ".join(f"w{r.randrange(50)}" for _ in range(40))
    rows = [(i, base + (f" x{i}" if i % 3 else "")) for i in range(12)] + [(100 + i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(20)] + [(200, None)]
    assert found_near(spark.createDataFrame(rows, "doc_id bigint, text string"), 4) == sorted(near(rows, 4), key=repr)


def test_tables_between_steps_go(spark, sf):
    """What is written and not read by the result is removed."""
    import os

    from papyra.llm.common import scratch, shared_folder, written

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark) as keep:
        a = written(spark.range(5))
        b = written(a.where("id > 1"))
        keep(b)
    assert len(set(os.listdir(folder)) - before) == 1 and b.count() == 3
    out = op4_near_dedup(spark, sf)
    assert len(set(os.listdir(folder)) - before) <= 4 and out.count() > 0
