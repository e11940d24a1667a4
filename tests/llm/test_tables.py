"""Sharding, URL filter, tool calls, decontamination and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import string

import pytest

import corpus_pipeline
from compare import differences
from papyra.llm import bpe, decontaminate, exact_dedup, quality, sharding, tool_calls, url_filter
from papyra.llm.common import read
from papyra.llm.near_dedup import near_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# Sharding.
def shards_by_definition(rows, most):
    hashed = [(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), i, len((t or "").encode())) for i, t in rows]
    out = []

    def split(part, depth, bits):
        size = sum(n for _, _, n in part)
        if size <= most or len({h for h, _, _ in part}) == 1:
            out.extend((i, n, depth, bits, size, len(part), size <= most) for _, i, n in part)
            return
        for bit in (0, 1):
            if own := [x for x in part if x[0] >> (59 - depth) & 1 == bit]:
                split(own, depth + 1, bits + str(bit))

    split(hashed, 0, "")
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [10, 60, 10_000, 10**7])
def test_shards_of_odd_rows(odd, odd_rows, nothing, most):
    found = sharding.extendible_shards(odd, shard_bytes=most).select("doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_docs", "fits").collect()
    assert sorted(map(tuple, found), key=repr) == shards_by_definition(odd_rows, most)
    assert sharding.extendible_shards(nothing, shard_bytes=most).collect() == []


def test_shards_split_unevenly(spark):
    """One huge text among small ones makes a deep path and leaves the rest shallow."""
    rows = [(i, "x" * (5000 if i == 7 else 10)) for i in range(500)]
    found = sharding.extendible_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_bytes=600).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.depth, r.shard, r.shard_bytes, r.shard_docs, r.fits) for r in found), key=repr) == shards_by_definition(rows, 600)
    assert [r.doc_id for r in found if not r.fits] == [7]


def test_sharding_query(spark, sf):
    assert differences(sharding.op2_sharding(spark, sf), sf, sharding.SQL) == ""


def test_written_shards(spark, sf, tmp_path):
    docs = read(spark, sf, "documents")
    sharding.write_shards(docs, f"{tmp_path}/out", shard_bytes=50_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    sizes = {r.shard: r.b for r in back.groupBy("shard").agg({"text": "count"}).withColumnRenamed("count(text)", "b").collect()}
    assert back.count() == docs.count() and len(sizes) > 3
    assert max(sum(len(r.text.encode()) for r in part) for part in _by(back.collect(), lambda r: r.shard).values()) <= 50_000 or any(len(r.text.encode()) > 50_000 for r in docs.collect())


def _by(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


# URL filter.
ODD_URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.org/es/1"), (4, "http://example.org/es/1"), (5, "https://a.example.org/en/12?x#y"), (None, "http://example.org"), (6, "http://b.com/fr/"),
    (7, "http://com/de/"), (8, "x://xcom/de/"), (9, "http://a.org?/es/"), (10, "http://example.org/es"), (11, "://"), (12, "http://" + "a." * 2000 + "com/de/x"), (13, "http://b.com/x#/fr/"), (14, "ftp://x.co.uk/a"), (15, "http://notexample.org/es/"),
]


def rule_of(host, path):
    fit = [(len(h + p), kind == "block", h + p, kind) for kind, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fit)[2], max(fit)[3]) if fit else (None, None)


def test_url_rules(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ODD_URLS], "page_id bigint, url string, host string, `_n` string")
    found = url_filter.url_filter(df).collect()
    wanted = []
    for i, url in ODD_URLS:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
        wanted.append((i, host, path, *rule_of(host, path)))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in found), key=repr) == sorted(wanted, key=repr)
    assert {r.verdict for r in found} <= {"allow", "block"}
    assert url_filter.url_filter(df.limit(0)).collect() == []


def test_hosts_of_bad_repute_are_blocked(spark):
    rows = [(i, f"http://bad.com/de/{i}") for i in range(40)] + [(100 + i, f"http://good.com/fr/{i}") for i in range(40)] + [(900, "http://bad.com/x"), (901, "http://good.com/x"), (902, "http://new.com/x")]
    found = {r.page_id: r.verdict for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert (found[900], found[901], found[902]) == ("block", "allow", "allow")


def test_many_rules_are_joined(spark, monkeypatch):
    """Beyond what the plan takes, the same rules fit."""
    df = spark.createDataFrame(ODD_URLS, "page_id bigint, url string")
    rules = [*url_filter.RULES, ("block", "org", "/en"), ("allow", "b.com", ""), *((("allow", "block")[i % 2], f"h{i}.net", "/") for i in range(40))]
    get = lambda: sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df, rules=rules).collect()), key=repr)
    compiled = get()
    monkeypatch.setattr(url_filter, "MAX_RULES", 0)
    assert get() == compiled and any(r[3] for r in compiled)


def test_domains_of_hosts(spark):
    """Ports and users don't make a domain, and suffixes are as given."""
    bad = [(i, f"http://u@a.evil.com:80{i % 10}/de/{i}") for i in range(40)]
    rows = [*bad, (900, "http://evil.com/x"), (901, "http://b.evil.com:99/x"), *((200 + i, f"http://{i}.good.com/fr/") for i in range(200)), *((500 + i, f"http://s{i}.gov.xx/fr/") for i in range(30)), (903, "http://new.gov.xx/x")]
    found = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string"), suffixes=("gov.xx", "a.gov.xx")).collect()}
    assert found[900].bad_bound > found[903].bad_bound and found[901].bad_bound > found[903].bad_bound


def test_url_query(spark, sf):
    assert differences(url_filter.op7_url_filter(spark, sf), sf, url_filter.SQL) == ""


# Tool calls.
def call(*calls, content="c"):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(key, content="r"):
    return json.dumps({"tool_call_id": key, "content": content})


CHAT = [
    (1, 0, "user", "hello"), (1, 1, "assistant", call(("a", "search", '{"query": "x", "limit": 3}'), ("b", "lookup", '{"id": "no"}'))), (1, 2, "tool", result("a")), (1, 3, "tool", result("zz")),
    (2, 0, "tool", result("q")), (2, 1, "assistant", call(("q", "calculator", "not json"), ("n", "unknown", "{}"))), (2, 2, "assistant", '{"broken'), (None, 0, "tool", result("a")), (3, None, None, None),
    (1, 4, "user", '{"content": "just json"}'), (4, 0, "assistant", call(("d", "search", '{"limit": 1.5, "query": "y"}'))), (4, 1, "tool", result("d")), (4, 1, "tool", result("d")), (4, 2, "user", ""),
]


def test_tool_calls(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHAT], "conv_id bigint, turn bigint, role string, text string, `_conv` string")
    rows = _by(tool_calls.link_tool_calls(df).collect(), lambda r: (r.conv_id, r.turn))
    assert sum(map(len, rows.values())) == len(CHAT)
    one = rows[1, 1][0]
    assert (one.link, one.n_calls, one.n_unanswered, one.n_invalid) == ("call", 2, 1, 1)
    assert one.message == '{"content":"c","role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search"},{"arguments":{"id":"no"},"id":"b","name":"lookup"}]}'
    assert [(r.link, r.place, r.level) for r in rows[1, 2]] == [("linked", 2, 1)] and rows[1, 3][0].link == "orphan"
    early = rows[2, 0][0]
    assert (early.link, early.place, early.level) == ("linked", 1, 1)  # a result that came before its call goes after it
    assert (rows[2, 1][0].n_invalid, rows[2, 1][0].n_unanswered) == (2, 1)
    assert json.loads(rows[2, 1][0].message)["tool_calls"][0]["arguments"] == "not json"
    assert rows[2, 2][0].message == '{"content":"{\\"broken","role":"assistant"}' and rows[None, 0][0].link == "orphan"
    assert [r.link for r in rows[4, 1]] == ["linked", "linked"] and rows[4, 0][0].n_invalid == 1
    assert rows[3, None][0].message == '{"content":""}' and rows[4, 2][0].message == '{"content":"","role":"user"}'
    order = sorted((r for r in sum(rows.values(), []) if r.conv_id == 2), key=lambda r: (r.place, r.level, r.turn))
    assert [r.turn for r in order] == [1, 0, 2]
    assert tool_calls.link_tool_calls(df.limit(0)).collect() == []


def linked_by_definition(rows):
    """(conversation, turn, content): (link, place, unanswered) of messages with one call or result each."""
    made, out = collections.defaultdict(set), {}
    for conv, turn, _, call, _ in rows:
        if call is not None and conv is not None and turn is not None:
            made[conv, call].add(turn)
    at = {}
    for conv, turn, _, _, got in rows:
        if got is not None and conv is not None and turn is not None and (turns := made[conv, got]):
            at[conv, got, turn] = max((t for t in turns if t <= turn), default=min(turns))
    answered = {(conv, got, t) for (conv, got, _), t in at.items()}
    for conv, turn, content, call, got in rows:
        if call is not None:
            out[conv, turn, content] = ("call", turn, int((conv, call, turn) not in answered))
        else:
            found = at.get((conv, got, turn))
            out[conv, turn, content] = ("orphan", turn, 0) if found is None else ("linked", max(turn, found), 0)
    return out


def test_identifiers_that_are_used_again(spark):
    """Against brute force: some conversations reuse identifiers, one holds most rows and one identifier; rows repeat."""
    r = random.Random(3)
    rows = []
    for i in range(900):
        conv, turn = r.choice([None, 1, 1, 1, 1, 2, 3, 4, 5]), r.choice([None, *range(60)])
        key = "hot" if conv == 1 and r.random() < 0.7 else f"k{r.randrange(4)}"
        rows.append((conv, turn, f"m{i}", *((key, None) if r.random() < 0.4 else (None, key))))
    rows += rows[:50]
    df = spark.createDataFrame([(c, t, "assistant" if a else "tool", call((a, "search", '{"query": "x"}'), content=m) if a else result(b, content=m)) for c, t, m, a, b in rows], "conv_id bigint, turn bigint, role string, text string")
    found = tool_calls.link_tool_calls(df).collect()
    assert len(found) == len(rows)
    assert {(x.conv_id, x.turn, json.loads(x.message)["content"]): (x.link, x.place, x.n_unanswered) for x in found} == linked_by_definition(rows)


def test_schemas(spark):
    """Types, required and allowed values, for more tools than a person would write down."""
    schemas = {f"t{i}": {"required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"enum": ["x", 1, None]}, "c": {"type": "number"}}} for i in range(700)} | {"free": {}}
    given = [("t5", '{"a": 1}', 0), ("t699", '{"a": "1"}', 1), ("t0", "{}", 1), ("t1", '{"a": 1, "b": "x", "c": 1.5}', 0), ("t1", '{"a": 1, "b": 2}', 1), ("t1", '{"a": 1, "b": 1, "c": "z"}', 1), ("free", '{"z": []}', 0), ("free", "[1]", 1), ("none", "{}", 1), ("t2", None, 1), ("t2", "junk", 1)]
    df = spark.createDataFrame([(i, 0, "assistant", call((f"k{i}", n, a))) for i, (n, a, _) in enumerate(given)], "conv_id bigint, turn bigint, role string, text string")
    found = {x.conv_id: x.n_invalid for x in tool_calls.link_tool_calls(df, schemas=schemas).collect()}
    assert found == {i: bad for i, (*_, bad) in enumerate(given)}


def test_tool_call_query(spark, sf):
    assert differences(tool_calls.op8_tool_calls(spark, sf), sf, tool_calls.SQL) == ""


# Decontamination.
def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def hits_by_definition(docs, items, window=13):
    windows = collections.defaultdict(set)
    for key, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add("" if key is None else str(key))
    out = []
    for key, text in docs:
        w, hit, found, longest = words_of(text), set(), set(), 0
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
                    longest = max(longest, n)
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), longest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, odd_rows, monkeypatch, most):
    """Broadcast or shuffled, the same rows."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    r = random.Random(9)
    passage = [f"p{r.randrange(30)}" for _ in range(40)]
    items = [(1, " ".join(passage)), (2, "Word"), (3, None), (4, "...!"), (5, "one two three FOUR five six"), (None, " ".join(passage[5:30])), (6, "a a a a a a a a a a a a a a a"), (6, "tool call")]
    docs = [*odd_rows, (20, "x y " + " ".join(passage[3:25]) + " z"), (21, "a " * 40), (22, " ".join(passage * 3)), (23, "a " * 14 + "b " * 700)]
    names = ["row", "_id", "_all", "_found", "item_id"]
    df = spark.createDataFrame([(*d, *("x" for _ in names)) for d in docs], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, `_words` string")
    found = decontaminate.decontaminate(df, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")
    assert sorted(map(tuple, found.collect()), key=repr) == hits_by_definition(docs, items)
    assert decontaminate.decontaminate(df.limit(0), bench).collect() == []
    assert {x.n_hit for x in decontaminate.decontaminate(df, bench.limit(0)).collect()} == {0}


def test_decontamination_query(spark, sf):
    assert differences(decontaminate.op9_decontaminate(spark, sf), sf, decontaminate.SQL) == ""


# Pipeline.
def test_pipeline_against_the_stages_one_by_one(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    first = {}
    for i in sorted(good, reverse=True):
        first.setdefault((rows[i] or "").translate(LOWER), i)
    kept = docs.where(docs.doc_id.isin(sorted(first.values())))
    near = {r.doc_id for r in near_dedup(kept, n=5).where("kept").collect()}
    bench = [tuple(r) for r in read(spark, sf, "benchmark").select("item_id", "text").collect()]
    clean = {i for i, *_, bad, longest in hits_by_definition([(i, rows[i]) for i in near], bench) if not bad and longest < 13}
    wanted = {tuple(r) for r in bpe.round_trip(docs.where(docs.doc_id.isin(sorted(clean)))).collect()}
    found = corpus_pipeline.run(spark, sf).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


def test_no_benchmark_passage_stays(spark, tmp_path):
    """A passage of 13 words goes even in a long text, and of an item of fewer words only what is mostly that."""
    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, item), (2, "the cat")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(5000))
    passage, short = " ".join(item.split()[4:17]), " ".join(item.split()[4:16])
    docs = [(1, f"{long} {passage} {long}"), (2, f"{long} {short} {long}"), (3, f"{long} the cat"), (4, "the cat sat"), (5, None), (6, long)]
    kept = corpus_pipeline.clean(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6]


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Stages keep all columns, whatever their names, and take null ids, repeated ids and an empty table."""
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "word")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    texts = [r.text for r in docs.collect()]
    # Null and empty texts are one group, of which the row with id 2 stays (it is there twice); 'word' is a benchmark item.
    assert sum(not (t or "").strip() for t in texts) == 3 and not any((t or "").lower() == "word" for t in texts)
    assert len(texts) == 1 + len({(t or "").translate(LOWER) for t in texts}) == 9
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(texts)
    none = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_exact_stage_keeps_the_largest_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A b"), (5, "a B"), (5, "other"), (None, "a b")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.exact(spark, docs, str(tmp_path)).collect()) == [(5, "a B"), (5, "other")]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("schema", [
    {"additionalProperties": False}, {"type": "array"}, {"properties": {"a": {"type": "integer", "minimum": 1}}}, {"properties": {"a": {"type": "string", "pattern": "x"}}},
    {"properties": {"a": {"type": "object", "properties": {}}}}, {"properties": {"a": {"type": "array", "items": {"type": "string"}}}}, {"properties": {"a": {"type": ["string", "null"]}}}, {"properties": {"a": False}},
])
def test_schema_keywords_that_are_not_checked_raise(schema):
    with pytest.raises(ValueError, match="can't be checked"):
        tool_calls.faults_of({"t": schema})


def test_notes_in_schemas_are_no_rules():
    assert tool_calls.faults_of({"t": {"type": "object", "description": "d", "properties": {"a": {"type": "number", "title": "x"}}}})
