"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import LOWER, UPPER, ascii_lower, checkpoint, read

WINDOW = 13
SHINGLE = 5
MIN_SHARE_INVERSE = 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most bytes that are broadcast, of words, windows or documents that are hit; beyond, words go in blocks, the other joins shuffle.
BROADCAST_BYTES = 128 << 20


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) maximal runs of ASCII letters, digits and non-ASCII characters; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def windows_of(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows with the ids of their items: _w (id), _words, _len, _items."""
    words = items.select(F.col(item_col).cast("string").alias("_item"), words_of(F.col(text_col)).alias("_all")).where("size(_all) > 0")
    each = words.select("_item", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(_all) - {window - 1})), i -> slice(_all, i, {window}))")).alias("_words"))
    each = each.groupBy("_words").agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    return each.select(F.xxhash64(F.col("_words"), F.lit("w")).alias("_w"), "_words", F.size("_words").alias("_len"), "_items")


def anchors_of(windows: DataFrame, counts: DataFrame, shingle: int) -> DataFrame:
    """For each window whose words all occur: its rarest shingle (_s, _k words, from _off on) and that one's rarest word (_word, _woff words in).

    A shingle is as frequent as its rarest word at most, which is what they are ordered by; equal ones by their hash, so
    that neighbouring windows share one. That one shingle is the prefix that the window needs.
    """
    spread = windows.select("_w", F.posexplode("_words").alias("_i", "_word")).join(counts, "_word", "left")
    known = spread.groupBy("_w").agg(F.min(F.coalesce("_df", F.lit(0))).alias("_least"), F.expr("transform(array_sort(collect_list(struct(_i, coalesce(_df, 0L) as df))), x -> x.df)").alias("_dfs"))
    best = F.expr(
        "array_min(transform(sequence(0, _len - _k), j -> struct(array_min(slice(_dfs, j + 1, _k)) as df, xxhash64(slice(_words, j + 1, _k)) as s, j as off)))"
    )
    found = windows.join(known.where("_least > 0"), "_w").withColumn("_k", F.least("_len", F.lit(shingle))).withColumn("_b", best)
    found = found.withColumn("_woff", F.expr("cast(array_position(slice(_dfs, _b.off + 1, _k), _b.df) - 1 as int)"))
    return found.select("_w", "_words", "_len", "_k", F.col("_b.off").alias("_off"), F.col("_b.s").alias("_s"), "_woff", F.expr("element_at(_words, _b.off + _woff + 1)").alias("_word"))


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes: with the id, what a row is known by."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("_h"), F.xxhash64(F.lit("t"), text).alias("_g")]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row for each id and text in which a window occurs: _id, _h, _g, n_words, n_hit, longest, _items; checkpointed.

    Two passes over the texts. The first counts the benchmark's words in them. The second looks for the rarest word of
    each window's rarest shingle, then the shingle around it, then, where position and length leave room, the window word
    by word, all on the spot. Only words around such shingles move, if they do at all: the benchmark's words are broadcast
    in blocks of BROADCAST_BYTES (one pass each), its windows up to that size.
    """
    blank = F.coalesce(F.col(item_col).cast("string"), F.lit(""))
    windows = checkpoint(windows_of(items.withColumn(item_col, blank), item_col, item_text, window))
    words = checkpoint(windows.select(F.explode("_words").alias("_word")).distinct())

    def blocks(table: DataFrame, size: Column) -> list[DataFrame]:
        total = table.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first().b
        n = 1 + int(total) // BROADCAST_BYTES if BROADCAST_BYTES else 3
        return [F.broadcast(table.where(F.pmod(F.xxhash64("_word"), F.lit(n)) == k)) for k in range(n)]

    def each(run, parts: list[DataFrame]) -> DataFrame:
        out = run(parts[0])
        for part in parts[1:]:
            out = out.unionByName(run(part))
        return out

    texts = docs.select(F.col(id_col).alias("_id"), *text_key(F.col(text_col)), words_of(F.col(text_col)).alias("_all"))
    every = texts.select(F.explode("_all").alias("_word"))
    counts = checkpoint(each(lambda part: every.join(part, "_word").groupBy("_word").agg(F.count(F.lit(1)).alias("_df")), blocks(words, F.octet_length("_word") + 40)))

    anchors = checkpoint(anchors_of(windows, small(counts, counts.agg(F.coalesce(F.sum(F.octet_length("_word") + 48), F.lit(0)).alias("b")).first().b), shingle))
    probes = checkpoint(anchors.groupBy("_word").agg(F.collect_set(F.struct("_woff", "_k")).alias("_at")))
    places = texts.select("_id", "_h", "_g", "_all", F.posexplode("_all").alias("_pos", "_word"))

    def probe(part: DataFrame) -> DataFrame:
        near = places.join(part, "_word").select("_id", "_h", "_g", "_all", "_pos", F.explode("_at").alias("_a"))
        near = near.select("_id", "_h", "_g", "_all", F.size("_all").alias("_n"), (F.col("_pos") - F.col("_a._woff")).alias("_p"), F.col("_a._k").alias("_k"))
        near = near.where("_p >= 0 and _p + _k <= _n").withColumn("_from", F.expr(f"greatest(0, _p - {window} + _k)"))
        return near.select("_id", "_h", "_g", "_n", "_p", "_k", F.expr("xxhash64(slice(_all, _p + 1, _k))").alias("_s"), "_from", F.expr(f"slice(_all, _from + 1, _p - _from + {window})").alias("_around"))

    near = each(probe, blocks(probes, F.octet_length("_word") + 16 * F.size("_at") + 60))
    window_bytes = anchors.agg(F.coalesce(F.sum(F.length(F.array_join("_words", "")) + 24 * F.size("_words") + 100), F.lit(0)).alias("b")).first().b
    found = near.join(small(anchors.select("_w", "_words", "_len", "_off", "_s", "_k"), window_bytes), ["_s", "_k"]).withColumn("_start", F.col("_p") - F.col("_off"))
    found = found.where("_start >= 0 and _start + _len <= _n and slice(_around, _start - _from + 1, _len) = _words")
    found = checkpoint(found.groupBy("_id", "_h", "_g", "_n", "_start", "_len", "_w").count())  # rows that repeat id and text come to one
    item_bytes = windows.agg(F.coalesce(F.sum(40 * F.size("_items") + 60), F.lit(0)).alias("b")).first().b
    found = found.join(small(windows.select("_w", "_items"), item_bytes), "_w")
    found = found.groupBy("_id", "_h", "_g", F.col("_n").cast("long").alias("n_words")).agg(
        F.sort_array(F.collect_set(F.struct("_start", "_len"))).alias("_spans"), F.max("_len").cast("long").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_items"),
    )
    covered = "aggregate(_spans, named_struct('n', 0L, 'to', 0L), (a, c) -> named_struct('n', a.n + greatest(0L, c._start + c._len - greatest(a.to, c._start)), 'to', greatest(a.to, cast(c._start + c._len as bigint))), a -> a.n)"
    return checkpoint(found.select("_id", "_h", "_g", "n_words", F.expr(covered).alias("n_hit"), "longest", "_items"))


def is_contaminated(inverse: int = MIN_SHARE_INVERSE) -> Column:
    return (F.col("n_hit") > 0) & (inverse * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, inverse: int = MIN_SHARE_INVERSE) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest window that occurs, 0: none).

    A window is any `window` consecutive words of an item (an item of fewer words is one window). How they are found is
    said at `contamination`; here its rows meet the documents (by broadcast up to BROADCAST_BYTES, else only ids, hashes and
    numbers of words shuffle).

    Null and empty texts have no words: nothing is hit. Null item ids are the text ''. Items without words and empty
    tables give no windows. Rows that repeat an id each get a row of their own text. Other columns are ignored.
    """
    found = contamination(docs, items, id_col, text_col, item_col, item_text, window, shingle)
    none = F.sha2(F.lit(""), 256)
    hits = found.select(
        F.col("_id").alias("_key"), "_h", "_g", "n_hit", "longest", F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
    )
    rows = docs.select(F.col(id_col).alias("_id"), *text_key(F.col(text_col)), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    out = rows.join(small(hits, 200 * hits.count()), rows["_id"].eqNullSafe(hits["_key"]) & (rows["_h"] == hits["_h"]) & (rows["_g"] == hits["_g"]), "left")
    zero = F.lit(0).cast("long")
    out = out.select("_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.coalesce("longest", zero).alias("longest"))
    return out.select(F.col("_id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", is_contaminated(inverse).alias("contaminated"), "longest")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


SQL = f"""
with d as (select doc_id, {_sql_words('text')} as w from documents),
b as (select item_id, {_sql_words('text')} as w from benchmark),
bw as (select distinct item_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') as k, least(len(w), {WINDOW}) as n from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, ns where len(w) >= n)),
hit as (select distinct doc_id, item_id, dw.i, dw.n from dw join bw on dw.k = bw.k and dw.n = bw.n),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hit) group by doc_id),
its as (select doc_id, max(n) as longest, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hit group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and {MIN_SHARE_INVERSE} * coalesce(n_hit, 0) >= len(d.w) as contaminated, coalesce(longest, 0)::bigint as longest
from d left join pos using (doc_id) left join its using (doc_id)
"""
